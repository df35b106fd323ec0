"""Operator 1: benchmark decontamination by n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.llm import _text as text
from lumenpair.llm._spark import free, table

#: Words in a seed, of which an item has all. An item of fewer than WHOLE_WORDS words leaks only where all of it is there, word for word.
SEED_WORDS, WHOLE_WORDS = 3, 8
#: Smith-Waterman scores of words, and the least score of a leak as a share of the item's score with itself.
MATCH, MISMATCH, GAP, LEAST = 2.0, -1.0, 1.0, 0.4
#: Words of test items that are broadcast at once; beyond it they go in groups, a pass each.
GROUP_WORDS = 5_000_000


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment of two word sequences with linear gaps. Rows are computed at once: a gap along the row is a running maximum."""
    if not len(item) or not len(passage):
        return 0.0
    slope = GAP * np.arange(len(passage) + 1)
    prev, best = np.zeros(len(passage) + 1), 0.0
    for w in item:
        row = np.maximum(prev - GAP, 0)
        row[1:] = np.maximum(row[1:], prev[:-1] + np.where(passage == w, MATCH, MISMATCH))
        prev = np.maximum.accumulate(row + slope) - slope
        best = max(best, float(prev.max()))
    return best


def ceiling(item: np.ndarray, passage: np.ndarray) -> float:
    """No alignment scores more: in the stretch of the item that it covers, each word that the passage lacks costs a mismatch or a gap."""
    total = np.cumsum(np.where(np.isin(item, passage), MATCH, max(MISMATCH, -GAP)))
    return float((total - np.minimum.accumulate(np.r_[0, total])[:-1]).max(initial=0))


class Items:
    """Words and n-grams of test items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        tok, off = text.hashed(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words = [tok[off[i] : off[i + 1]] for i in range(len(ids))]
        self.size = np.diff(off)
        gram, goff, pos = text.ngrams(tok, off, SEED_WORDS)
        item = np.repeat(np.arange(len(ids)), np.diff(goff))
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.pos = gram[order], item[order], pos[order]
        self.least = np.where(self.size < WHOLE_WORDS, 1.0, LEAST)
        self.distinct = np.unique(self.gram)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Index of each n-gram among the distinct ones, -1 where it is none."""
        if not len(self.distinct):
            return np.full(len(gram), -1)
        at = np.searchsorted(self.distinct, gram)
        at[at == len(self.distinct)] = 0
        return np.where(self.distinct[at] == gram, at, -1)

    def leaks(self, words: np.ndarray, gram: np.ndarray, at: np.ndarray) -> list[tuple[int, float]]:
        """[(item, score)] of a text. at: the places in the text of n-grams that are seeds. Seeds of one item on near diagonals share a window, which
        reaches as far as gaps can take an alignment that scores LEAST; each window is aligned whole, unless its ceiling is too low."""
        lo, hi = np.searchsorted(self.gram, gram[at], "left"), np.searchsorted(self.gram, gram[at], "right")
        n = hi - lo
        k = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, diagonal = self.item[k], np.repeat(at, n) - self.pos[k]
        order = np.lexsort((diagonal, item))
        item, diagonal, out = item[order], diagonal[order], {}
        first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (np.diff(diagonal) > self.size[item[1:]])])
        last = np.r_[first[1:], len(item)] - 1
        for i, low, high in zip(item[first].tolist(), diagonal[first].tolist(), diagonal[last].tolist()):
            own = self.words[i]
            slack = int((1 - LEAST) * MATCH * len(own) / GAP) + 1
            window, full = words[max(0, low - slack) : high + len(own) + slack], MATCH * len(own)
            if ceiling(own, window) >= self.least[i] * full:
                s = align(own, window) / full
                if s >= self.least[i]:
                    out[i] = max(s, out.get(i, 0))
        return sorted(out.items())


def groups(benchmark: DataFrame):
    """Items whose words fit a broadcast; all at once, unless there are very many."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        rows.append(r)
        size += len(r["text"]) // 5
        if size > GROUP_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def scored(items: Items, texts: pa.Array) -> list[tuple[int, int, float]]:
    """[(place of the text, place of the item, score)] of an array of texts."""
    tok, off = text.hashed(texts)
    gram, goff, _ = text.ngrams(tok, off, SEED_WORDS)
    hit = np.flatnonzero(items.find(gram) >= 0)
    doc = np.searchsorted(goff, hit, "right") - 1
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = []
    for d, own in zip(doc[start].tolist(), np.split(hit, start[1:])):
        out += [(d, i, s) for i, s in items.leaks(tok[off[d] : off[d + 1]], gram[goff[d] : goff[d + 1]], own - goff[d])]
    return out


def shared_items(docs: DataFrame, benchmark: DataFrame):
    """Broadcasts of the items, each of bounded size."""
    for rows in groups(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score) for each document and test item whose alignment scores at least LEAST of the item with itself, where they share an n-gram of SEED_WORDS.

    Of an item of under WHOLE_WORDS words all must be there; one of under SEED_WORDS matches documents that have its words and no others. Null or empty texts and null
    ids match nothing. Rows that share a doc_id are one document, and items that share an item_id one item, with the best score. Texts count whole. One scan; no
    text is shuffled."""
    out = None
    for handle in shared_items(docs, benchmark):

        def run(batches, handle=handle):
            have = handle.value
            for part in text.pieces(batches):
                ids = part.column(0).to_pylist()
                found = [(ids[d], have.ids[i], s) for d, i, s in scored(have, part.column(1)) if ids[d] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "score"])

        got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no leak, with all their columns, extra ones of any name included. Each row is decided by its own text, with or without
    a doc_id; rows without text stay. No shuffle."""
    for handle in shared_items(docs, benchmark):

        def leaky(texts, handle=handle):
            import pandas as pd

            have, out = handle.value, np.zeros(len(texts), bool)
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            at = 0
            for part in text.pieces([batch]):
                out[[at + d for d, _, _ in scored(have, part.column(0))]] = True
                at += part.num_rows
            return pd.Series(out)

        docs = docs.filter(~F.pandas_udf(leaky, "boolean")(F.col("`text`")))
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES, SQL = {"op1_decontamination": op1_decontamination}, {}
