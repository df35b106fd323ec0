"""Where rows go: JSON lines, gzipped datasets, a durable queue, a service with the queue to fall back on, and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def as_json(*columns: str) -> Column:
    """The columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def write_dataset(rows: DataFrame, path: str) -> None:
    """rows as gzipped JSON lines, as many files as partitions."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def append(rows: DataFrame, queue: str) -> bool:
    """Adds rows to the queue, one JSON object a line; whether that could be done."""
    try:
        rows.write.mode("append").json(queue)
        return True
    except Exception:  # the caller is told, and keeps the rows
        return False


def queued(spark: SparkSession, queue: str, schema: str) -> DataFrame:
    """The queue's rows; lines that aren't such objects are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(queue)


def readable(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """The rows of JSON lines that are objects; others are skipped."""
    parsed = lines.withColumn("_o", F.from_json(c(line), schema))
    return parsed.filter(F.try_parse_json(c(line)).isNotNull() & F.trim(c(line)).startswith("{")).drop(line).select("*", "_o.*").drop("_o")


def send(rows: DataFrame, post: Callable[[str], bool], key: str) -> DataFrame:
    """(key, outcome): `success` where post() takes the row's JSON; else `queued`, to be appended and sent again. post runs on the executors, a row at a time, as services do; what it
    raises counts as a refusal."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for body in batch["body"]:
                try:
                    out.append("success" if post(body) else "queued")
                except Exception:  # a service that is down is no failure of the job
                    out.append("queued")
            yield pd.DataFrame({key: batch[key], "outcome": out})

    return rows.select(key, as_json(*rows.columns).alias("body")).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, outcome string")


def submit(rows: DataFrame, post: Callable[[str], bool], key: str, queue: str) -> DataFrame:
    """send(), whose refused rows are appended to the queue; `failed` where that can't be done. The outcomes are written once, so no row is posted twice."""
    from lumenpair.sources.requests import settled

    outcome = settled(send(rows, post, key))
    if append(rows.join(outcome.filter("outcome = 'queued'").select(key), key, "left_semi"), queue):
        return outcome
    return outcome.withColumn("outcome", F.when(c("outcome") == "queued", "failed").otherwise(c("outcome")))


def logged(lines: DataFrame, key: str, order: list[str], line: str, most: int = 5 * 1024 * 1024) -> DataFrame:
    """The lines that a bounded log has in the end: one that repeats the line before it isn't written, and the log starts anew with every `most` bytes of lines."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = lines.withColumn("_p", F.lag(line).over(w)).filter(~c(line).eqNullSafe(c("_p"))).drop("_p")
    return fresh.withColumn("_part", F.floor((F.sum(F.octet_length(line) + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1) / most)).withColumn("_last", F.max("_part").over(W.partitionBy(key))).filter("_part = _last").drop("_part", "_last")
