"""Parsers that need memory of what they read before, as Arrow functions. Each distinct value of a batch is parsed once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "strings": pa.list_(pa.string())}
NAMES = {"string": "string", "double": "double", "boolean": "boolean", "strings": "array<string>"}


def parser(parse: Callable, **fields: str) -> Callable[..., Column]:
    """parse(*texts) -> dict of fields, as a function of columns that gives a struct. Where the first text is null so is the struct."""
    kind = pa.struct([(k, TYPES[v]) for k, v in fields.items()])

    def run(*columns: pa.Array) -> pa.Array:
        if len(columns) == 1:
            coded = columns[0].dictionary_encode()
            return pa.array([None if v is None else parse(v) for v in coded.dictionary.to_pylist()], kind).take(coded.indices)
        seen: dict = {}
        rows = list(zip(*(c.to_pylist() for c in columns)))
        for r in rows:
            if r not in seen:
                seen[r] = None if r[0] is None else parse(*r)
        return pa.array([seen[r] for r in rows], kind)

    ddl = f"struct<{', '.join(f'{k}: {NAMES[v]}' for k, v in fields.items())}>"
    if parse.__code__.co_argcount == 1:

        def one(text: pa.Array) -> pa.Array:
            return run(text)

        return lambda *c: F.arrow_udf(one, ddl)(*c)

    def many(*texts: pa.Array) -> pa.Array:
        return run(*texts)

    return lambda *c: F.arrow_udf(many, ddl)(*c)
