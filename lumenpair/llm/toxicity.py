"""Operator 4: toxic documents, by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.llm import _blocks as blocks
from lumenpair.llm import _text as text
from lumenpair.llm._spark import partitions, table

#: At most so many labelled documents of each class fit the models, those of least doc_id hash; every fourth is held out for the threshold.
MAX_FIT_DOCS = 3000
#: Class counts move from what both classes share to their own by max(0, 1 - EVIDENCE / z^2), z being how many deviations they are apart: for words, and for pairs, of
#: which there are many more. So an expression counts for a class as far as it is known to, however rare it is; none is left out.
EVIDENCE, PAIR_EVIDENCE = 6.5, 25.0
#: Of a word's class counts this share backs off.
BACKOFF = 0.7
#: Texts that are counted at once on the driver.
BLOCK = 250
#: A false alarm weighs as much as so many toxic documents missed, when the threshold is chosen.
FALSE_ALARM = 10


@dataclass
class Model:
    """vocab: sorted word hashes; word k has id k+1, any other word, or the start of a text, id 0. keys: sorted pairs, left id * size + right id; kept: what of their
    counts, in documents, each class (0 ordinary, 1 toxic) keeps; seen, rest: of each left word, the count of all its pairs, and what of that backs off; single: probability
    of each word in a class, without what backs off, and `spare`, that rest; shared: probability of each word by its different left neighbours in all documents."""

    vocab: np.ndarray
    keys: np.ndarray
    kept: np.ndarray
    seen: np.ndarray
    rest: np.ndarray
    single: np.ndarray
    spare: np.ndarray
    shared: np.ndarray | None = None
    threshold: float = 0.0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        distinct, index, off = text.words(texts)
        if not len(index):
            return np.zeros(0, np.int64), off
        h = text.word_hashes(distinct)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        known = self.vocab[at] == h if len(self.vocab) else np.zeros(len(h), bool)
        return np.where(known, at + 1, 0)[index], off

    def pairs(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.r_[0, ids[:-1]] if len(ids) else ids
        starts = off[:-1][np.diff(off) > 0]
        left[starts] = 0
        return left, left * (len(self.vocab) + 1) + ids

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, mean toxic and mean ordinary log-likelihood) of each text; without words the means are 0."""
        ids, off = self.ids(texts)
        left, key = self.pairs(ids, off)
        n = np.diff(off)
        means = np.zeros((2, len(n)))
        if len(ids):
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            for c in (0, 1):
                total = self.seen[c][left]
                own = np.where(hit, self.kept[c][at], 0) if len(self.keys) else np.zeros(len(key))
                lower = (self.single[c] + self.spare[c] * self.shared)[ids]
                p = np.where(total > 0, (own + self.rest[c][left] * lower) / np.where(total > 0, total, 1), lower)
                means[c][n > 0] = np.add.reduceat(np.log(p), off[:-1][n > 0]) / n[n > 0]
        return n, means[1], means[0]


def weighed(counts: np.ndarray, evidence: float) -> np.ndarray:
    """Counts of both classes, moved towards what each would have if the classes were alike, as far as their difference may be chance."""
    total = counts.sum(axis=0)
    share = (counts.sum(axis=1) / max(1.0, counts.sum()))[:, None]
    alike = total * share
    z2 = (counts - alike) ** 2 / np.maximum(total * share * (1 - share), 1e-9)
    return alike + (counts - alike) * np.maximum(0, 1 - evidence / np.maximum(z2, 1e-9))


def by_document(what: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Documents of each class that hold each of what."""
    once = np.unique(doc * size + what)
    return np.array([np.bincount(once[y[once // size] == c] % size, minlength=size) for c in (0, 1)], float)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Pair and word counts of both classes. Texts or a class may be missing: then every pair is left to the backoff. A text counts once, however often it comes. The texts are
    gone through BLOCK at a time, thrice, so memory holds their counts and not their words."""
    first = {}
    for t, y in zip(texts, toxic):
        first.setdefault((t or "", int(y)), None)
    known = list(first)
    vocab = np.zeros(0, np.uint64)
    for block in blocks_of(known):
        vocab = np.union1d(vocab, text.hashed(pa.array([t for t, _ in block], pa.large_string()))[0])
    size = len(vocab) + 1
    model = Model(vocab, np.zeros(0, np.int64), np.zeros((2, 0)), np.zeros((2, size)), np.zeros((2, size)), np.zeros((2, size)), np.ones(2))
    if not len(vocab):
        return model

    def each():
        for block in blocks_of(known):
            ids, off = model.ids(pa.array([t for t, _ in block], pa.large_string()))
            yield ids, model.pairs(ids, off)[1], np.repeat(np.arange(len(block)), np.diff(off)), np.array([c for _, c in block])

    words = np.zeros((2, size))
    for ids, key, doc, y in each():
        words += by_document(ids, doc, y, size)
        model.keys = np.union1d(model.keys, key)
    total, own = words.sum(axis=0), weighed(words, EVIDENCE)
    for c in (0, 1):
        if own[c].sum():
            model.single[c] = own[c] * (1 - BACKOFF / np.maximum(total, 1)) / own[c].sum()
            model.spare[c] = 1 - model.single[c].sum()
    pairs = np.zeros((2, len(model.keys)))
    for _, key, doc, y in each():
        met, place = np.unique(key, return_inverse=True)
        pairs[:, np.searchsorted(model.keys, met)] += by_document(place, doc, y, len(met))
    total, own = pairs.sum(axis=0), weighed(pairs, PAIR_EVIDENCE)
    model.kept = (own - discount(total) * own / np.maximum(total, 1)).astype(np.float32)
    for c in (0, 1):
        model.seen[c] = np.bincount(model.keys // size, own[c], size)
        model.rest[c] = model.seen[c] - np.bincount(model.keys // size, model.kept[c], size)
    return model


def blocks_of(rows: list):
    return (rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK))


def discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


def continuations(docs: DataFrame, vocab_model: Model) -> np.ndarray:
    """For each word id the number of its different left neighbours over all documents. Tasks send the pairs that they met, each once, as
    differences of sorted keys. Words outside the sample's vocabulary are one word here. What comes back is one number for each word."""
    reducers, size = partitions(docs), len(vocab_model.vocab) + 1
    none = np.zeros(0)
    handle = docs.sparkSession.sparkContext.broadcast(Model(vocab_model.vocab, none, none, none, none, none, none))
    once = lambda x: np.asarray(pa.array(x).unique())

    def send(batches):
        m, met, held = handle.value, np.zeros(0, np.int64), []
        for part in text.pieces(batches):
            ids, off = m.ids(part.column(0))
            held.append(once(m.pairs(ids, off)[1]))
            if sum(map(len, held)) > blocks.HOLD:
                met, held = once(np.concatenate([met, *held])), []
        met = np.sort(once(np.concatenate([met, *held])))
        word = met % size
        to = (text.mix(word.astype(np.uint64)) % np.uint64(reducers * 4)).astype(np.int64)
        rows = []
        for b in np.unique(to):
            own = met[to == b]
            rows.append((int(b), np.diff(own, prepend=0).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "a"])

    def count(batches):
        met = [np.cumsum(np.frombuffer(x, np.int64)) for batch in batches for x in batch.column(1).to_pylist()]
        words, n = np.unique((once(np.concatenate(met)) if met else np.zeros(0, np.int64)) % size, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])

    sent = docs.select("text").mapInArrow(send, "bucket int, a binary")
    got = blocks.exchange(sent, count, reducers, "word long, n long").toPandas()
    out = np.zeros(size)
    out[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS) -> Model:
    """Models of both classes from a bounded labelled sample, backoff counts from every document, and the threshold that serves best on the held-out part. A doc_id with several labels counts with the greatest; null ids and labels don't count."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).na.drop().groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    each = min([max_docs, *n.values()]) if len(n) == 2 else max_docs  # as many of either class: neither model knows more text
    one = lambda c: known.filter(F.col("y") > 0 if c else F.col("y") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    chosen = one(0).unionByName(one(1))  # at most 2 * max_docs rows
    got = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(7))).toPandas().sort_values(["h", "doc_id", "text"])
    y, held = (got["y"].to_numpy() > 0).astype(int), (got["h"].to_numpy() % 4) == 0
    model = fit(got["text"][~held].tolist(), y[~held])
    left = continuations(docs, model)
    model.shared = (left + 0.5) / (left.sum() + 0.5 * len(left))
    parts = [model.score(pa.array(block, pa.large_string())) for block in blocks_of(got["text"][held].tolist())]
    n, bad, good = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
    model.threshold = best_threshold((bad - good)[n > 0], y[held][n > 0])
    return model


def best_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin above which texts count as toxic: the middle of the gap that best parts the held-out classes; 0 where
    there is only one."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    caught, false = t[::-1].cumsum()[::-1] / t.sum(), (1 - t)[::-1].cumsum()[::-1] / (1 - t).sum()
    k = int(np.argmax(caught - FALSE_ALARM * false))
    return float((m[k] + (m[k - 1] if k else m[k])) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, toxic_ll, ordinary_ll, toxic) for each row of docs(doc_id, text, ...), repeated rows and rows without doc_id included.

    toxic_ll and ordinary_ll are mean log-likelihoods of the words, each given its left neighbour; toxic is whether the first exceeds the second by
    more than the model's threshold. A null text has nulls and isn't toxic; one without words has likelihoods of 0 and isn't toxic. Texts
    count whole. One scan, no shuffle; what is broadcast is bounded by the labelled sample."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        for part in text.pieces(batches):
            n, bad, good = m.score(part.column(1))
            none = np.asarray(part.column(1).is_null())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64(), mask=none), pa.array(bad.round(6), pa.float64(), mask=none), pa.array(good.round(6), pa.float64(), mask=none), pa.array((bad - good > m.threshold) & (n > 0))],
                ["doc_id", "n_words", "toxic_ll", "ordinary_ll", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, toxic_ll double, ordinary_ll double, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES, SQL = {"op4_toxicity": op4_toxicity}, {}
