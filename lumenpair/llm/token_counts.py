"""Operator 8: greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenpair.llm._spark import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FIND = re.compile(r"\w+|[^\w\s]").findall


def word_pieces(path: str) -> list[str]:
    """A word-piece vocabulary out of a public rank file: a string with a leading space begins a word, one without continues it (##). Strings that
    are no whole UTF-8, or hold white space elsewhere, take no part. A single character that begins words may also continue them, and the reverse."""
    out = set()
    with open(path, "rb") as f:
        for line in f:
            if not line.strip():
                continue
            try:
                s = base64.b64decode(line.split()[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            begins, s = s[:1] == " ", s[1:] if s[:1] == " " else s
            if s and not re.search(r"\s", s):
                out.add(s if begins else "##" + s)
                if len(s) == 1:
                    out |= {s, "##" + s}
    return sorted(out)


class Automaton(dict):
    """Counts greedy longest-match pieces in time linear in the word.

    The trie holds the vocabulary, continuing pieces under a second root. Where no edge fits, the failure link of a node leads to the node for what
    is left of its string once its longest pieces are popped; pops[node] is how many are. No piece is ever built. A word that cannot be covered
    counts as one unknown piece. As a dict it remembers up to `keep` words."""

    def __init__(self, vocabulary: list[str], keep: int = 300_000):
        super().__init__()
        self.keep = keep
        self.edge: list[dict[str, int]] = [{}, {}]  # 0: the start of a word; 1: within a word
        piece = [False, False]
        for v in vocabulary:
            node, s = (1, v[2:]) if v.startswith("##") and len(v) > 2 else (0, v)
            for c in s:
                if (nxt := self.edge[node].get(c)) is None:
                    self.edge[node][c] = nxt = len(self.edge)
                    self.edge.append({})
                    piece.append(False)
                node = nxt
            piece[node] = True
        size = len(self.edge)
        self.fail, self.pops = [-1] * size, [0] * size
        todo = deque([(0, c, v) for c, v in self.edge[0].items()] + [(1, c, v) for c, v in self.edge[1].items()])
        while todo:
            u, c, v = todo.popleft()
            if piece[v]:
                self.fail[v], self.pops[v] = 1, 1
            else:
                at, popped = self.fail[u], self.pops[u]
                while at != -1 and c not in self.edge[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != -1:
                    self.fail[v], self.pops[v] = self.edge[at][c], popped
            todo.extend((v, d, w) for d, w in self.edge[v].items())

    def count(self, word: str) -> int:
        edge, fail, pops, node, n = self.edge, self.fail, self.pops, 0, 0
        for c in word:
            while (nxt := edge[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node == -1:
                    return 1
            node = nxt
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node == -1:
                return 1
        return n

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(word_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_pieces) for each row of docs(doc_id, text, ...), repeated rows and rows without doc_id included.

    A null text has null counts, an empty or blank one zeros. Words are runs of word characters, and every other visible character by itself.
    Texts and words of any length count whole. Other columns are ignored. The stage has no shuffle."""

    def run(batches):
        get = automaton(vocabulary).__getitem__
        for batch in batches:
            words, total = [], []
            for text in batch.column(1).to_pylist():
                found = None if text is None else FIND(text)
                words.append(None if found is None else len(found))
                total.append(None if found is None else sum(map(get, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op8_token_counts": op8_token_counts}, {}
