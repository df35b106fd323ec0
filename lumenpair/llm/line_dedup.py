"""Operator 6: substring dedup by hashing the units of a text, lines and the sentences within them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpair.llm._spark import free, table

#: Words of a run of units, below which it is left alone: headings and stock phrases repeat in clean documents. It holds for the run, not for a unit.
MIN_WORDS = 20
#: A unit ends at a line feed, or behind one of these marks.
ENDS = ".!?"
UNIT = re.compile(rf"[^{re.escape(ENDS)}\n]*[{re.escape(ENDS)}\n]|[^{re.escape(ENDS)}\n]+")
LINKS = "doc_id long, row int, k int, start_char int, end_char int, left int, right int, high long, low long, again boolean"


def units(text: str) -> list[tuple[str, int, int, int]]:
    """(normalised unit, its words, start, end) of each unit with a word; offsets count characters of the text, without the white space around the unit.
    Normalised is in lower case with single spaces, without the mark that ends it."""
    out = []
    for m in UNIT.finditer(text):
        raw = m.group()
        words = raw.lower().rstrip(ENDS).split()
        if words:
            start = m.start() + len(raw) - len(raw.lstrip())
            out.append((" ".join(words), len(words), start, start + len(raw.strip())))
    return out


def links(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Digests of every two neighbouring units, and of every unit of min_words words by itself. k numbers the units of a text; left and right are the
    words of the two (right is 0 for a unit by itself); row tells texts that share a doc_id apart; `again` marks what came earlier in
    the same text. Rows without doc_id or text have none."""

    def run(batches):
        names = [x.split()[0] for x in LINKS.split(", ")]
        for batch in batches:
            doc_row: list = []
            at: list = []
            digests: list = []
            again: list = []
            for doc, text, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if doc is None or not text:
                    continue
                own, seen = units(text), set()
                begin = len(digests)
                for k, (a, n, start, end) in enumerate(own):
                    if n >= min_words:
                        at.append((k, start, end, n, 0))
                        digests.append(xxhash.xxh3_128_digest(a))
                for k, ((a, n, start, _), (b, m, _, end)) in enumerate(zip(own, own[1:])):
                    at.append((k, start, end, n, m))
                    digests.append(xxhash.xxh3_128_digest(a + "\n" + b))
                for d in digests[begin:]:
                    again.append(d in seen)
                    seen.add(d)
                doc_row.append((doc, row, len(digests) - begin))
            n = np.array([r[2] for r in doc_row], np.int64)
            where = np.array(at, np.int32).reshape(-1, 5)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [np.repeat(np.array([r[0] for r in doc_row], np.int64), n), np.repeat(np.array([r[1] for r in doc_row], np.int32), n), *where.T, *both.T, np.array(again, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return docs.select("doc_id", "text", F.hash("text").alias("row")).mapInArrow(run, LINKS)


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start_char, end_char, n_words, first_doc_id): maximal runs of units, every two neighbours of which follow each other in a document
    of lesser doc_id too, or earlier in the same text; or a unit by itself that does. A run has min_words words or more.

    Digests are counted with map-side combining, so a link that a million documents share is a few counters in the shuffle; then only links
    whose digest repeats are joined to their first place (an AQE skew join, should one digest be most of them)."""
    u = links(docs, min_words)
    key = ["high", "low"]
    first = u.groupBy(*key).agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = u.join(first, key).filter("again OR doc_id <> first_doc_id").drop(*key, "again")
    text = Window.partitionBy("doc_id", "row").orderBy("k", "right")
    last = F.max(F.col("k") + (F.col("right") > 0).cast("int")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce((F.col("k") > last).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of one doc_id with one text give each link several times
    once = island.groupBy("doc_id", "row", "island", "k", "right").agg(*[F.first(c).alias(c) for c in ("start_char", "end_char", "left", "first_doc_id")])
    run = once.groupBy("doc_id", "row", "island").agg(
        F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), (F.min_by("left", "k") + F.sum("right")).cast("int").alias("n_words"), F.min("first_doc_id").alias("first_doc_id")
    )
    return run.filter(F.col("n_words") >= min_words).drop("island")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_char, end_char, n_words, first_doc_id) of each passage to remove: a run of repeated units (see runs()). first_doc_id is the least
    document that has one of its links, and keeps it.

    A unit is a line, or a sentence of one. A passage that begins or ends inside a sentence is found but for that sentence.
    Ties: rows that share a doc_id are one document, so neither removes the other's units; a run never crosses rows. Empty tables, texts and
    lines, null texts and null ids give nothing. Texts count whole; extra columns are ignored."""
    return runs(docs, min_words).drop("row")


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without its repeated runs in `text`, and with removed_spans, the original offsets of what went. All other columns stay. White space around a run
    stays too, but for a line feed right behind it. A document of which nothing is left has an empty text.

    Spans belong to a doc_id and a text: of rows that share a doc_id each loses what repeats in its own text."""
    spans, key, row, text = free(docs, "spans"), free(docs, "id"), free(docs, "row"), F.col("`text`")
    gone = runs(docs, min_words).groupBy(F.col("doc_id").alias(key), F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias(spans))
    out = docs.join(gone, (F.col("`doc_id`") == F.col(key)) & (F.hash(text) == F.col(row)), "left").drop(key, row)

    def strip(texts, all_spans):
        import pandas as pd

        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            kept, at = [], 0
            for x in s:
                kept.append(t[at : x["start_char"]])
                at = max(at, x["end_char"] + (t[x["end_char"] : x["end_char"] + 1] == "\n"))
            return "".join(kept) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, all_spans)], dtype=object)

    cut = F.pandas_udf(strip, "string")
    return out.select(*[cut(text, F.col(spans)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(spans).alias("removed_spans" if "removed_spans" not in docs.columns else free(docs, "removed_spans")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": rf"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '([{ENDS}\n])', '\1' || chr(1), 'g'), chr(1)) AS ls FROM documents WHERE text <> ''),
    u AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS raw FROM l),
    p AS (SELECT doc_id, i, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(raw) AS n, raw,
            trim(regexp_replace(regexp_replace(lower(raw), '[{ENDS}]$', ''), '\s+', ' ', 'g')) AS norm FROM u),
    w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, norm, len(string_split(norm, ' ')) AS words,
            stop - n + length(regexp_extract(raw, '^\s*')) AS s, stop - length(regexp_extract(raw, '\s*$')) AS e FROM p WHERE norm <> ''),
    pair AS (SELECT doc_id, k, s, lead(e) OVER d AS e, words AS lw, lead(words) OVER d AS rw, norm || chr(10) || lead(norm) OVER d AS x FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
    link AS (SELECT * FROM pair WHERE x IS NOT NULL UNION ALL SELECT doc_id, k, s, e, words, 0, norm FROM w WHERE words >= {MIN_WORDS}),
    again AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, k) AS r, min(doc_id) OVER (PARTITION BY x) AS f FROM link),
    found AS (SELECT *, max(k + CASE WHEN rw > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k, rw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM again WHERE r > 1),
    isle AS (SELECT *, sum(CASE WHEN k > last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k, rw ROWS UNBOUNDED PRECEDING) AS island FROM found)
    SELECT doc_id, CAST(min(s) AS INTEGER) AS start_char, CAST(max(e) AS INTEGER) AS end_char, CAST(arg_min(lw, k) + sum(rw) AS INTEGER) AS n_words, min(f) AS first_doc_id
    FROM isle GROUP BY doc_id, island HAVING arg_min(lw, k) + sum(rw) >= {MIN_WORDS}"""
}
