"""Operator 7: byte-pair encoding and decoding with a public vocabulary."""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenpair.llm._spark import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the stretches inside which symbols may merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder(dict):
    """Stretch of text -> its token ids. It remembers twice `keep` stretches at most, which bounds a worker's memory; results don't depend on it. Each stretch is decoded when it is first
    met; those that don't give their text again are in `lossy`."""

    def __init__(self, path: str = VOCABULARY, keep: int = 200_000):
        import regex

        super().__init__()
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.text = {v: k for k, v in self.rank.items()}
        self.find = regex.compile(PATTERN).findall
        self.keep = keep
        self.old, self.lossy = {}, set()

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges the adjacent pair of least rank, leftmost first, until no pair is in the vocabulary. Symbols are a doubly linked list of the places where they begin; the
        queue holds rank and place as one number, and an entry is stale when the pair that now begins at the place has another rank."""
        get, n = self.rank.get, len(data)
        if (whole := get(data)) is not None:
            return (whole,)
        after, before, now = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        queue = []
        for i in range(n - 1):
            if (r := get(data[i : i + 2])) is not None:
                now[i] = r
                queue.append(r * n + i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            if now[i] != r:
                continue
            j = after[i]
            now[i] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(data[i : after[k]])) is not None:
                    now[i] = r
                    push(queue, r * n + i)
            if (h := before[i]) >= 0:
                if (r := get(data[h:k])) is not None:
                    now[h] = r
                    push(queue, r * n + h)
                else:
                    now[h] = -1
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[data[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            data = word.encode("utf-8", "replace")
            ids = self.merge(data)
            if b"".join(map(self.text.__getitem__, ids)) != word.encode("utf-8", "surrogatepass"):
                self.lossy.add(word)
        if len(word) <= 64:
            if len(self) >= self.keep:  # what wasn't met since the last time goes
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str):
        """The token ids of a text, one by one."""
        return chain.from_iterable(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return list(self.ids(text))

    def gives_again(self, text: str, ids) -> bool:
        """Whether decoding gives the text again: so it does where every stretch is known to; else the ids are decoded."""
        return not self.lossy or self.decode(ids) == text

    def decode(self, ids) -> str:
        """The vocabulary's strings joined. Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for each row of docs(doc_id, text, ...), repeated rows and rows without doc_id included.

    A null text has null token_ids, n_tokens and round_trip; an empty one has no tokens. Text of any length is encoded whole. round_trip says
    whether decoding the ids gives the text again (null without check): every stretch is decoded once, and texts with one that doesn't give itself again are decoded whole. Other columns are ignored. The stage has no shuffle."""

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, ends, none, same = array("i"), [0], [], []
                for text in part.column(1).to_pylist():
                    none.append(text is None)
                    at = len(flat)
                    if text:
                        flat.extend(e.ids(text))
                    ends.append(len(flat))
                    same.append(None if text is None or not check else e.gives_again(text, flat[at:]))
                off = pa.array(ends[:-1] + [ends[-1]], pa.int32(), mask=np.array(none + [False]))
                ids = pa.ListArray.from_arrays(off, pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                n = pa.array(np.diff(ends), pa.int32(), mask=np.array(none))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, n, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, token_ids, ...); null token_ids give a null text, none an empty one."""

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else e.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op7_bpe": op7_bpe}, {}
