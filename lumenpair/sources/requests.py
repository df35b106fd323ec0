"""Request lines, links in pages, and lines that are safe to share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_error(line: Column) -> Column:
    """Why a request line can't be served: invalid JSON, no entered side, or neither a source nor words. Null where it can; blank lines are null too."""
    entered, source, words = (F.get_json_object(line, f"$.{k}") for k in ("entered", "source", "ocr"))
    is_object = F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{")
    return F.when(F.coalesce(F.trim(line), F.lit("")) == "", None).when(~is_object, "invalid_json").when(entered.isNull(), "missing_entered").when(source.isNull() & words.isNull(), "missing_source")


def latest_link(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, link): of a page's links that match the pattern, whose first group is what they are compared by, the greatest. Pages without one go."""
    links = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))).alias("link"))
    return links.groupBy(key).agg(F.max_by("link", F.struct(F.regexp_extract("link", pattern, 1).cast("long"), "link")).alias("link"))


def safe_line(line: Column) -> Column:
    """Whether a log line may be shared: a time, and then a timing, or a diagnosis that quotes no exception."""
    return line.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S* ") & (line.rlike(r"^\S+(?: \d{2}:\d{2}:\d{2}\S*)? Timing: ") | (line.contains("[RIGHTCLICK-DIAG]") & ~line.contains("EXCEPTION")))


def redacted(field: Column, value: Column, private: tuple[str, ...] = ("patientName", "patientDOB", "patientAddress")) -> Column:
    return F.when(field.isin(*private), F.lit("[redacted]")).otherwise(value)


def leaks_fragment(value: Column, text: Column, n: int = 5) -> Column:
    """Whether the text holds any n characters of the value, both in lower case without anything but letters and digits. A shorter value leaks nothing.
    Each text is cut into its runs once, so the work grows with its length."""
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")

    def shared(value: pa.Array, text: pa.Array) -> pa.Array:
        grams = lambda s: {s[i : i + n] for i in range(len(s) - n + 1)}
        return pa.array([not grams(v).isdisjoint([t[i : i + n] for i in range(len(t) - n + 1)]) for v, t in zip(value.to_pylist(), text.to_pylist())], pa.bool_())

    return F.arrow_udf(shared, "boolean")(norm(value), norm(text))


WORDS = "array<struct<text:string,x:double,y:double,w:double,h:double>>"


def parsed(lines: DataFrame, line: str, record: str) -> DataFrame:
    """lines with id, entered, source, ocr, skip and error of their JSON; what a line doesn't have is null, and one with an error has nothing."""
    request = F.when(request_error(F.col(line)).isNull(), F.from_json(F.col(line), f"id string, entered {record}, source {record}, ocr {WORDS}, skipDrugLookup boolean"))
    out = lines.withColumn("_r", request).withColumn("error", request_error(F.col(line)))
    return out.select(*[c for c in lines.columns if c != line], F.get_json_object(line, "$.id").alias("id"), "_r.entered", "_r.source", "_r.ocr", F.coalesce("_r.skipDrugLookup", F.lit(False)).alias("skip"), "error")


def document(spark, path: str, schema: str) -> DataFrame:
    """One JSON document of any number of lines, as a row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read again: what has an effect must not run twice. Written to spark.checkpoint.dir, which all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenpair"))
    return df.checkpoint()
