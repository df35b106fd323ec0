"""Shuffles of arrays: a task sends each reducer a few rows of packed values instead of a row for each value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a task holds before it sends them on.
HOLD = 3_000_000
SCHEMA = "bucket int, kind int, a binary, b binary, c binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


class Sender:
    """Gathers arrays a, b, c of equal length for buckets, and yields them as packed rows."""

    def __init__(self, buckets: int, kind: int = 0):
        self.buckets, self.kind, self.held, self.n = buckets, kind, [], 0

    def add(self, bucket: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int32), a, b, c))
        self.n += len(a)
        if self.n >= HOLD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            bucket, a, b, c = (np.concatenate(x) for x in zip(*self.held))
            order = np.argsort(bucket, kind="stable")
            bucket, a, b, c = bucket[order], a[order], b[order], c[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end = np.r_[start[1:], len(bucket)]
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(start, end)], pa.binary())
            kinds = pa.array(np.full(len(start), self.kind), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), kinds, cut(a), cut(b), cut(c)], schema=ARROW)
        self.held, self.n = [], 0


def gather(batches, types: dict[int, tuple]) -> dict[int, list[tuple]]:
    """kind -> [(bucket, a, b, c)] of all rows of a reducer, unpacked by the three types of the kind."""
    out: dict[int, list[tuple]] = {k: [] for k in types}
    for batch in batches:
        for bucket, kind, *packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
            out[kind].append((bucket, *(np.frombuffer(x, t) for x, t in zip(packed, types[kind]))))
    return out


def joined(rows: list[tuple], types: tuple) -> tuple[np.ndarray, ...]:
    """(bucket, a, b, c) of rows as one array each."""
    if not rows:
        return (np.zeros(0, np.int64), *(np.zeros(0, t) for t in types))
    return (np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows]), *(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3)))


def exchange(df: DataFrame, run: Callable, reducers: int, schema: str = SCHEMA) -> DataFrame:
    """The rows of a bucket meet in one task, which run() turns into rows of schema. Buckets are dealt to tasks in turn, so that none has more of them than others."""
    return df.repartitionById(reducers, F.col("bucket") % reducers).mapInArrow(run, schema)
