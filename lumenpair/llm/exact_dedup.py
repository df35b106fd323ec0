"""Operator 3: exact dedup, with frequent digests settled on the map side."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenpair.llm._spark import free, table

#: Counters of a Misra-Gries summary: every digest in more than 1/(COUNTERS+1) of a task's rows is in its summary. It bounds what is broadcast.
COUNTERS = 1024


def misra_gries(items, k: int = COUNTERS) -> dict:
    """Summary of at most k counters; each count is short of the true one by at most n/(k+1)."""
    have: dict = {}
    for x in items:
        if x in have:
            have[x] += 1
        elif len(have) < k:
            have[x] = 1
        else:
            have = {y: c - 1 for y, c in have.items() if c > 1}
    return have


def merge(summaries, k: int = COUNTERS) -> dict:
    """One summary of the union: counts add, then the (k+1)th largest is taken from all."""
    total: dict = {}
    for s in summaries:
        for x, c in s.items():
            total[x] = total.get(x, 0) + c
        if len(total) > k:
            least = sorted(total.values(), reverse=True)[k]
            total = {x: c - least for x, c in total.items() if c > least}
    return total


def heavy_digests(digests: DataFrame, k: int = COUNTERS) -> list[bytes]:
    """At most k digests, among them every one that holds more than 2/(k+1) of the rows. Singletons, of no use, go."""

    def run(batches):
        import collections

        have: dict = {}
        for batch in batches:
            counts = collections.Counter(batch.column(0).to_pylist())
            have = merge([have, dict(counts)], k)
        yield pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.binary()), pa.array(have.values(), pa.int64())], ["digest", "n"])

    # each task sends at most k counters; their sums are short of the counts by at most n/(k+1), so the k greatest hold every digest in 2/(k+1) of the rows
    out = digests.mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "digest").limit(k)
    return [bytes(r[0]) for r in out.collect()]


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs, with one row for each distinct text: that of the least doc_id.

    A null doc_id ranks after all others; among rows alike in text and doc_id one stays, it is undefined which. A null text counts as a text of its
    own, an empty one too. Only text decides; all columns of docs come back as they are, extra ones of any name included."""
    if not docs.columns:
        return docs
    dig, rank = free(docs, "digest"), free(docs, "rank")
    keyed = docs.withColumn(dig, F.when(F.col("`text`").isNull(), F.lit(b"null")).otherwise(F.unhex(F.sha2(F.col("`text`").cast("binary"), 256))))
    least = F.coalesce(F.col("`doc_id`"), F.lit(2**63 - 1))
    first = W.partitionBy(dig).orderBy(least)
    one = lambda d: d.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    heavy = heavy_digests(keyed.select(F.col(dig).alias("digest")), counters)
    if not heavy:
        return one(keyed).drop(dig, rank)
    known = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(x),) for x in heavy], f"{dig} binary"))  # at most `counters` rows
    # the winners are verified on the rows themselves: counts fold in the map tasks, and at most `counters` groups are shuffled
    won, n = free(docs, "won"), free(docs, "n")
    winners = keyed.join(known, dig, "left_semi").groupBy(dig).agg(F.min(least).alias(won), F.count(F.lit(1)).alias(n))
    winners = docs.sparkSession.createDataFrame([tuple(r) for r in winners.collect()], f"{dig} binary, {won} long, {n} long")
    marked = keyed.join(F.broadcast(winners), dig, "left").filter(F.col(won).isNull() | (least == F.col(won)))
    # what is left of a frequent digest is its winner, and rows that repeat the winner's doc_id: it goes the ordinary way too
    return one(marked.drop(won, n)).drop(dig, rank)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and n_chars of the documents that stay; the texts themselves aren't moved."""
    docs = table(spark, sf_dir, "documents")
    return survivors(docs)


def survivors(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, lang, source, n_chars) of what dedup() keeps; only the digest of a text is shuffled."""
    narrow = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("text").isNull().alias("none"), "lang", "source", "n_chars")
    text = F.when(F.col("none"), F.lit(None)).otherwise(F.col("digest"))
    return dedup(narrow.select("doc_id", text.alias("text"), "digest", "lang", "source", "n_chars"), counters).drop("text")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
SQL = {
    "op3_exact_dedup": """
    SELECT doc_id, digest, lang, source, n_chars FROM (
        SELECT doc_id, md5(text) AS digest, lang, source, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
    WHERE r = 1"""
}
