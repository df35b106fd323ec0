"""Words, hashes and n-grams of Arrow string arrays, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order is unrelated to the text."""
    x = (x ^ (x >> U(31))) * GOLD
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def normal(texts: pa.Array) -> pa.Array:
    """Lower case, and every run of characters that are neither letters nor digits as one space."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(t), r"[^\pL\pN]+", " "), " ")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word of the batch among them, offsets of the texts). A null text is an empty one."""
    norm = normal(texts)
    lists = pc.split_pattern(norm, " ")
    flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    blank = np.asarray(pc.equal(pc.binary_length(norm), 0))
    if blank.any():  # splitting an empty text gives one empty word
        flat = flat.filter(pc.not_equal(flat, ""))
        off = np.r_[0, np.cumsum(np.where(blank, 0, np.diff(off)))]
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), off


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts)."""
    distinct, index, off = words(texts)
    return word_hashes(distinct)[index] if len(index) else np.zeros(0, np.uint64), off


def ngrams(tok: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, offsets of the texts, position of its first word in the text). A text of 1 to n-1 words has one, all of it."""
    count = np.diff(off)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    goff = np.r_[0, np.cumsum(have)]
    out = np.zeros(goff[-1], np.uint64)
    pos = np.arange(goff[-1]) - np.repeat(goff[:-1], have)
    full = count >= n
    if len(tok) >= n:
        g = tok[: len(tok) - n + 1].copy()
        for k in range(1, n):
            g = mix(g) + tok[k : len(tok) - n + 1 + k]
        at = np.repeat(off[:-1], have) + pos
        long = np.repeat(full, have)
        out[long] = g[at[long]]
    for d in np.flatnonzero((count > 0) & ~full):
        v = tok[off[d] : off[d] + 1]
        for k in range(off[d] + 1, off[d + 1]):
            v = mix(v) + tok[k : k + 1]
        out[goff[d]] = mix(v + U(count[d]))[0]
    return mix(out), goff, pos


def pieces(batches, limit: int = 12 << 20):
    """The batches, cut so that one piece holds about `limit` bytes: memory doesn't depend on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, int(limit // size))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
