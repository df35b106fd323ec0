"""Operator 5: exact join of documents by the Jaccard distance of their word n-grams, in regions around pivots.

The set of a document is that of its word trigrams. Two texts are linked where their sets have a similarity of SIMILARITY or more, so a distance of at most
t = 1 - SIMILARITY; every link is found. Copies of a text are one node (by a 64-bit digest), so they are never compared.

1. Regions across the cluster. In a metric space of this many dimensions almost every document is at distance 1 from any pivot drawn from the corpus,
   so pivots are found where distances under 1 are: by shared n-grams. Each n-gram belongs to a pivot, the node of least rank that has it, and a
   node goes to the regions of pivots that own part of its set. Two nodes a, b within t have at least s * max(|a|, |b|) n-grams in common. All nodes leave out
   pivots in one order, by rank, as long as these own less than s of the node's set together; the last pivot in that order that owns a common
   n-gram is then kept by both. That bound, not a guess, says which boundary
   documents are replicated, and to where. Ranks are random, and the least of f of them is about 1/f of the greatest: what owns common n-grams is left out first.
2. A node goes there without its text, with the parities of its n-grams in 2 to 4 bits for each. Sets of a and b elements whose parities differ in h places have at most
   (a + b - h) / 2 in common, so a node for which that leaves no partner in a region, or none that it hasn't met in a lesser one, isn't linked there.
   As corpora grow, unrelated texts share ever more n-grams and so regions; only texts with a likely partner follow.
3. A region of which more than CELL nodes are left is parted over tasks: pivots drawn from it make Voronoi cells, and a node is a guest of each lesser cell within the
   triangle-inequality window of 2t; cells that stay large, as all their nodes are close, are parted into blocks.
4. Inside a task more pivots make cells again, in turn, until they are small, or distances no longer part them; then by exact set intersections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.llm import _blocks as blocks
from lumenpair.llm import _text as text
from lumenpair.llm._spark import cut, free, partitions, release, table

WORDS, SIMILARITY = 3, 0.5
T = 1 - SIMILARITY + 1e-9
#: What pivots may own of a set and yet be left out.
SPARE = 0.999 * SIMILARITY
#: Sets that are joined without further pivots; cells of a matrix at once.
LEAF, CELLS = 1500, 6_000_000
#: Nodes of a region that one task takes, and pivots that part a larger one.
CELL, PIVOTS = 4000, 32
#: Pairs of nodes, and bytes of their parities, that are compared at once.
PAIRS, HELD = 400_000, 32 << 20
#: At most so many n-grams, those in OFTEN nodes or more as estimated by a sample of 1 / SAMPLE of them, bring their pivot along instead of meeting in one task. Only the
#: plan depends on them.
FREQUENT, OFTEN, SAMPLE = 16_384, 20_000, 64
U = np.uint64
KEY = ["region", "cell", "block"]


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text; none where it has no words."""
    gram, off, _ = text.ngrams(*text.hashed(texts), WORDS)
    return [np.unique(gram[s:e]) for s, e in zip(off[:-1], off[1:])]


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text) of the rows with both; the same texts have the same node."""
    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("node"), "text")


def codes(node: np.ndarray) -> np.ndarray:
    """The first 32 bits of nodes, which stand for them on the way to their regions. Pivots of one code are one; choose() in regions() sees to nodes of one code."""
    return (node.view(np.uint64) >> U(32)).astype(np.uint32)


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of parities for sets of n elements: a power of two from 64 on, of twice to four times n."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1) * 2)).astype(np.int64))


class Sketches:
    """Sends (node, elements of its set, parities of its n-grams) to the bucket of the node's code."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, {}, 0

    def add(self, bucket: np.ndarray, node: np.ndarray, found: list[np.ndarray]):
        wide = widths(np.array([len(s) for s in found]))
        for b, i, w, s in zip(bucket.tolist(), node.tolist(), wide.tolist(), found):
            bits = np.packbits((np.bincount((s & U(w - 1)).astype(np.int64), minlength=w) & 1).astype(np.uint8)).tobytes()
            self.held.setdefault(b, []).append((i, len(s), bits))
            self.n += 16 + w // 8
        if self.n >= HELD:
            yield from self.flush()

    def flush(self):
        if self.n:
            rows = [(b, 1, np.array([x[0] for x in v], np.int64).tobytes(), np.array([x[1] for x in v], np.int32).tobytes(), b"".join(x[2] for x in v)) for b, v in self.held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), blocks.ARROW)], schema=blocks.ARROW)
        self.held, self.n = {}, 0


class Postings:
    """Sends (n-gram, node's code) to the bucket of the n-gram. A node's n-grams follow each other, so a row of a bucket has the n-grams, each node once, and a bit for each n-gram
    that says whether the next node begins: what a posting takes depends little on the number of buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, gram: np.ndarray, node: np.ndarray):
        bucket = (gram % U(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)
        # a reducer needs to tell n-grams apart, not to know them: where two look alike their nodes only meet once more
        self.held.append((bucket, ((gram // U(self.buckets)) & U(0xFFFFFFFF)).astype(np.uint32), codes(node)))
        self.n += len(gram)
        if self.n >= blocks.HOLD:
            yield from self.flush()

    def flush(self):
        if self.n:
            bucket, gram, node = (np.concatenate(x) for x in zip(*self.held))
            order = np.argsort(bucket, kind="stable")
            bucket, gram, node = bucket[order], gram[order], node[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(bucket)]):
                own = node[s:e]
                new = np.r_[True, own[1:] != own[:-1]]
                rows.append((int(bucket[s]), 0, gram[s:e].tobytes(), own[new].tobytes(), np.packbits(new).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), blocks.ARROW)], schema=blocks.ARROW)
        self.held, self.n = [], 0

    @staticmethod
    def read(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        node = [ids[np.cumsum(np.unpackbits(new)[: len(gram)]) - 1] for _, gram, ids, new in rows]
        return np.concatenate([r[1] for r in rows]), np.concatenate(node)


def frequent(texts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, their pivots) of up to `most` n-grams that are most frequent in the sample; tasks keep Misra-Gries counters."""

    def count(batches):
        g, n, low = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for part in text.pieces(batches):
            found, own = sets(part.column(1)), np.asarray(part.column(0)).view(np.uint64)
            size = [len(x) for x in found]
            g, n, low = np.concatenate([g, *found]), np.r_[n, np.ones(sum(size), np.int64)], np.r_[low, np.repeat(own, size)]
            order = np.argsort(g, kind="stable")
            start = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]]) if len(g) else np.zeros(0, np.int64)
            if len(start):
                g, n, low = g[order][start], np.add.reduceat(n[order], start), np.minimum.reduceat(low[order], start)
            if len(n) > most:
                n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
                g, low, n = g[n > 0], low[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n), pa.array((low >> U(1)).view(np.int64))], ["gram", "n", "low"])

    got = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(count, "gram long, n long, low long").groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    rows = got.filter(F.col("n") * SAMPLE >= OFTEN).orderBy(F.desc("n"), "gram").limit(most).toPandas()
    gram = rows["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], (rows["low"].to_numpy(np.int64).view(np.uint64) << U(1))[order]


def regions(texts: DataFrame) -> DataFrame:
    """(node, n, bits, regions array<int>) of each node of texts(node, text) that may have a partner: the elements of its set, their parities, and the pivots to
    whose regions it goes, in order. A task sends each node once, so a text with a million copies is a few rows."""
    reducers = partitions(texts)
    buckets = reducers
    own = lambda code: text.mix(code.astype(np.uint64)) % U(buckets)
    handle = texts.sparkSession.sparkContext.broadcast(frequent(texts))  # at most FREQUENT rows

    def send(batches):
        often, lead_of = handle.value
        grams, sketches, known = Postings(buckets), Sketches(buckets), blocks.Sender(buckets, kind=2)
        sent: set = set()
        for part in text.pieces(batches):
            fresh = [k for k, x in enumerate(part.column(0).to_pylist()) if x not in sent and not sent.add(x)]
            if len(fresh) < part.num_rows:
                part = part.take(pa.array(fresh, pa.int64()))
            ids, found = np.asarray(part.column(0)), sets(part.column(1))
            n = np.array([len(x) for x in found])
            some = n > 0
            if some.any():
                g, doc = np.concatenate(found), np.repeat(ids, n)
                yield from sketches.add(own(codes(ids[some])), ids[some], [x for x in found if len(x)])
                if len(often):
                    at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    hit = often[at] == g
                    code, pivot, n = counted(codes(doc[hit]), codes(lead_of[at[hit]]), np.ones(hit.sum(), np.int32))
                    yield from known.add(own(code), code, pivot, n)
                    g, doc = g[~hit], doc[~hit]
                yield from grams.add(g, doc)
        for sender in (grams, sketches, known):
            yield from sender.flush()

    def lead(batches):
        pairs, got = blocks.Sender(buckets), []
        for batch in batches:
            kind = np.asarray(batch.column(1))
            if (kind > 0).any():  # these only pass
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(kind > 0)).columns, schema=blocks.ARROW)
            got += blocks.gather([batch.filter(pa.array(kind == 0))], {0: (np.uint32, np.uint32, np.uint8)})[0]
        out = []
        for b in sorted({r[0] for r in got}):
            g, doc = Postings.read([r for r in got if r[0] == b])
            # the n-gram above the code: sorted by both, each once, as other tasks may send a copy
            both = np.sort((g.astype(np.uint64) << U(32)) | doc)
            both = both[np.r_[True, both[1:] != both[:-1]]]
            g, doc = (both >> U(32)).astype(np.uint32), both.astype(np.uint32)
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            n = np.diff(np.r_[start, len(g)])
            shared = np.repeat(n > 1, n)
            out.append((doc[shared], np.repeat(doc[start], n)[shared]))
        if out:
            doc, pivot = (np.concatenate(x) for x in zip(*out))
            if len(doc):
                doc, pivot, n = counted(doc, pivot, np.ones(len(doc), np.int32))
                yield from pairs.add(own(doc), doc, pivot, n)
                yield from pairs.flush()

    def choose(batches):
        kinds = {0: (np.uint32, np.uint32, np.int32), 1: (np.int64, np.int32, np.uint8), 2: (np.uint32, np.uint32, np.int32)}
        got = blocks.gather(batches, kinds)
        at: dict = {}
        for _, ids, n, bits in got[1]:
            end = np.cumsum(widths(n) // 8).tolist()
            at |= {i: (k, bits[e - w : e]) for i, k, e, w in zip(ids.tolist(), n.tolist(), end, (widths(n) // 8).tolist())}
        ids = np.array(sorted(at), np.int64)
        code = codes(ids)
        ids = ids[np.argsort(code, kind="stable")]
        code, size = codes(ids), np.array([at[i][0] for i in ids.tolist()])
        _, doc, pivot, n = blocks.joined(got[2], kinds[2])
        once = np.unique(np.stack([doc.astype(np.int64), pivot, n]), axis=1)  # copies say the same
        _, doc, pivot, n = (np.r_[x, y] for x, y in zip((0, *(x.astype(k) for x, k in zip(once, kinds[2]))), blocks.joined(got[0], kinds[0])))
        doc, pivot, n = counted(doc, pivot, n)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        twins = np.diff(np.r_[first, len(code)])
        # of nodes with one code each goes wherever any of them does, and to a region of their own
        spare = SPARE * np.minimum.reduceat(size, first) if len(first) else np.zeros(0)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        total = np.cumsum(n)
        within = total - np.repeat(total[start] - n[start], np.diff(np.r_[start, len(doc)])) if len(doc) else total
        keep = within > spare[np.searchsorted(code[first], doc)] if len(doc) else np.zeros(0, bool)
        doc, pivot = np.r_[doc[keep], code[first][twins > 1]], np.r_[pivot[keep], code[first][twins > 1]]
        doc, pivot, _ = counted(doc, pivot, np.ones(len(doc), np.int32))
        low, high = np.searchsorted(doc, code), np.searchsorted(doc, code, side="right")
        some = np.flatnonzero(high > low)
        region = (pivot.astype(np.int64) - (1 << 31)).astype(np.int32)
        for k in range(0, len(some), 5000):
            rows = some[k : k + 5000]
            lists = [region[a:b] for a, b in zip(low[rows].tolist(), high[rows].tolist())]
            bits = [at[i][1].tobytes() for i in ids[rows].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(size[rows].astype(np.int32)), pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.int32()))], ["node", "n", "bits", "regions"])

    led = blocks.exchange(texts.select("node", "text").mapInArrow(send, blocks.SCHEMA), lead, reducers)
    return blocks.exchange(led, choose, reducers, "node long, n int, bits binary, regions array<int>")


class Parities:
    """The nodes of a table (n, bits), and which of their pairs may be linked."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.wide = n.astype(np.int64), widths(n)
        data, end = np.frombuffer(b"".join(bits), np.uint8), np.cumsum(self.wide // 8)
        self.level, self.row = {}, {}
        for w in np.unique(self.wide).tolist():
            # sets of half the elements or more have half as many bits or more, so those of twice as many are folded once
            same, more = np.flatnonzero(self.wide == w), np.flatnonzero(self.wide == 2 * w)
            pick = lambda k, w: data[(end[k] - w // 8)[:, None] + np.arange(w // 8)]
            wider = pick(more, 2 * w)
            self.level[w] = np.concatenate([pick(same, w), wider[:, : w // 8] ^ wider[:, w // 8 :]]).view(np.uint64)
            self.row[w] = np.zeros(len(n), np.int64)
            self.row[w][np.r_[same, more]] = np.arange(len(same) + len(more))

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether their sets may have a similarity of SIMILARITY."""
        na, nb = self.n[a], self.n[b]
        out = np.minimum(na, nb) >= SPARE * np.maximum(na, nb)
        wide = np.minimum(self.wide[a], self.wide[b])
        for w in np.unique(wide[out]).tolist():
            k, level, row = np.flatnonzero(out & (wide == w)), self.level[w], self.row[w]
            for part in np.array_split(k, 1 + len(k) * w // 8 // HELD):
                apart = np.bitwise_count(level[row[a[part]]] ^ level[row[b[part]]]).sum(axis=1, dtype=np.int64)
                both = na[part] + nb[part]
                out[part] = both - apart >= 2 * SPARE / (1 + SIMILARITY) * both
        return out


def partners(near: DataFrame, cell: int = CELL) -> DataFrame:
    """(region, node) of the nodes of near, as of regions(), that may have a link in the region which no lesser region has. Regions of more than `cell`
    nodes are compared block by block."""
    apart = near.select("node", "n", "bits", "regions", F.posexplode("regions").alias("at", "region")).withColumn("earlier", F.slice("regions", 1, F.col("at"))).drop("regions", "at")
    hot = near.select(F.explode("regions").alias("region")).groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("blocks")).filter("blocks > 1")
    hot = cut(hot)
    if hot.isEmpty():
        rows = apart.select("*", *(F.lit(0).alias(c) for c in ("block", "i", "j")))
    else:
        rows = apart.join(hot, "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.hash("node"), "blocks"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(t: pa.Table) -> pa.RecordBatch:
        region, i, j, block, node, n = (np.asarray(t.column(c)) for c in ("region", "i", "j", "block", "node", "n"))
        new = np.r_[True, (region[1:] != region[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        after = np.r_[start[1:], len(region)][group] - np.arange(len(region)) - 1  # rows of the group that follow
        sets_of, found, total = Parities(n, t.column("bits").to_pylist()), [], np.cumsum(after)
        lo = 0
        while lo < len(region):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - after[lo] + PAIRS)))
            a = np.repeat(np.arange(lo, hi), after[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            some = (i[a] == j[a]) | (block[a] != block[b])
            a, b = a[some], b[some]
            some = sets_of.likely(a, b)
            found.append((a[some], b[some]))
            lo = hi
        a, b = (np.concatenate(x) for x in zip(*found))
        rows = np.unique(np.r_[a, b])
        lists = dict(zip(rows.tolist(), t.column("earlier").take(pa.array(rows)).to_pylist()))
        mark = np.zeros(len(region), bool)
        order = np.argsort(group[a], kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, group[a][1:] != group[a][:-1]]) if len(a) else np.zeros(0, np.int64)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
            x, y = a[lo:hi], b[lo:hi]
            if hi - lo <= 50:
                fresh = np.array([set(lists[p]).isdisjoint(lists[q]) for p, q in zip(x.tolist(), y.tolist())])
            else:
                own, place = np.unique(np.r_[x, y], return_inverse=True)
                met = meet_earlier([lists[p] for p in own.tolist()], int(region[x[0]]))
                fresh = ~shares(met, place[: len(x)], place[len(x) :])
            mark[x[fresh]] = mark[y[fresh]] = True
        return pa.RecordBatch.from_arrays([pa.array(region[mark].astype(np.int64)), pa.array(node[mark])], ["region", "node"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("region", "i", "j")]
            last = np.flatnonzero(np.any([x != x[-1] for x in ends], axis=0))
            at = int(last[-1]) + 1 if len(last) else 0  # where the batch's last group begins
            if held and any(x[0] != np.asarray(held[-1].column(held[-1].schema.get_field_index(c)))[-1] for x, c in zip(ends, ("region", "i", "j"))):
                yield compare(pa.Table.from_batches(held))
                held = []
            if at:
                yield compare(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield compare(pa.Table.from_batches(held))

    sent = rows.select("region", "i", "j", "block", "node", "n", "bits", "earlier").repartition(partitions(near), "region", "i", "j").sortWithinPartitions("region", "i", "j")
    out = sent.mapInArrow(run, "region long, node long")
    return out if hot.isEmpty() else out.distinct()


def counted(doc: np.ndarray, pivot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (doc, pivot) once, with the sum of n."""
    order = np.lexsort((pivot, doc))
    doc, pivot, n = doc[order], pivot[order], n[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pivot[1:] != pivot[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[start], pivot[start], np.add.reduceat(n, start).astype(np.int32) if len(start) else n


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every set of a with every one of b (with a itself, where b is None)."""
    both = a if b is None else a + b
    token, place = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    often = np.bincount(place, minlength=len(token)) > 1
    column = np.cumsum(often) - 1
    some = often[place]
    row, column, width = row[some], column[place[some]], int(often.sum())
    out = np.zeros((len(a), len(both) if b is None else len(b)), np.float32)
    step = max(1, CELLS // len(both))
    if width > step:
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
    for at in range(0, width, step):
        lo, hi = (0, len(row)) if width <= step else np.searchsorted(column, [at, at + step])
        m = np.zeros((len(both), min(step, width - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T if b is None else m[: len(a)] @ m[len(a) :].T
    return out


def distances(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Jaccard distances of non-empty sets."""
    both = overlaps(a, b)
    size = lambda s: np.array([len(x) for x in s], np.float64)
    return 1 - both / (size(a)[:, None] + size(b if b is not None else a)[None, :] - both)


def metric_join(found: list[np.ndarray], own: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of all pairs within t, of own with own and of own with others; each pair comes once. own and others are disjoint."""
    t = T
    if len(own) + len(others) <= LEAF:
        yield from leaf(found, own, others)
        return
    pivots = own[np.linspace(0, len(own) - 1, min(len(own), 32)).astype(int)]
    near = lambda rows: np.concatenate([distances([found[i] for i in rows[k : k + LEAF]], [found[p] for p in pivots]) for k in range(0, len(rows), LEAF)])
    d_own = near(own)
    home = d_own.argmin(axis=1)
    if np.bincount(home).max() > 0.8 * len(own):  # the pivots don't part these
        yield from leaf(found, own, others)
        return
    d_others = near(others) if len(others) else np.zeros((0, len(pivots)))
    for r in range(len(pivots)):
        mine = own[home == r]
        if not len(mine):
            continue
        reach = d_own[home == r, r].max() + t  # no partner of the cell is farther from its pivot
        window = (home > r) & (d_own[:, r] <= np.minimum(d_own.min(axis=1) + 2 * t, reach))
        yield from metric_join(found, mine, np.r_[own[window], others[d_others[:, r] <= reach]])


def leaf(found, own, others):
    """As metric_join(), block by block without pivots."""
    for s in range(0, len(own), LEAF):
        a = own[s : s + LEAF]
        sa = [found[i] for i in a]
        d = distances(sa)
        i, j = np.nonzero(np.triu(d <= T, 1))
        yield a[i], a[j], 1 - d[i, j]
        rest = np.r_[own[s + LEAF :], others]
        for k in range(0, len(rest), LEAF):
            b = rest[k : k + LEAF]
            d = distances(sa, [found[i] for i in b])
            i, j = np.nonzero(d <= T)
            yield a[i], b[j], 1 - d[i, j]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each i and j in `parent`; roots are the least places."""
    while True:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def meet_earlier(lists: list, region: int) -> np.ndarray:
    """Bits of each node for the lesser regions that two or more of them are in: two nodes with a bit in common have been compared there."""
    lesser = [np.unique(np.array([r for r in x if r < region], np.int64)) for x in lists]
    flat = np.concatenate(lesser) if lesser else np.zeros(0, np.int64)
    where, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lesser])
    often = n[place] > 1
    bits = np.zeros((len(lists), int((n > 1).sum())), bool)
    bits[row[often], column[place[often]]] = True
    return np.packbits(bits, axis=1)


def shares(met: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs i, j of rows have a bit in common."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        out[k : k + 100_000] = (met[i[k : k + 100_000]] & met[j[k : k + 100_000]]).any(axis=1)
    return out


def new_links(found: list, lists: list, region: int, own: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the links of own with own (where there are no others) or with others, for which no lesser region has both."""
    met = meet_earlier(lists, region)
    for i, j, _ in metric_join(found, own, others) if not len(others) else across(found, own, others):
        new = np.ones(len(i), bool)
        if met.shape[1]:
            new = ~shares(met, i, j)
        yield i, j, new


def across(found, own, others):
    """(i, j, similarity) of the links of own with others, block by block."""
    for s in range(0, len(own), LEAF):
        a = own[s : s + LEAF]
        for k in range(0, len(others), LEAF):
            b = others[k : k + LEAF]
            d = distances([found[i] for i in a], [found[i] for i in b])
            i, j = np.nonzero(d <= T)
            yield a[i], b[j], 1 - d[i, j]


def join_cells(rows: DataFrame) -> DataFrame:
    """(node, n, root) for each node of rows(region, cell, block, guest, node, regions, text) that has links in a cell: their number, those that a lesser region
    has too left out, and a node that it is connected with. A task holds a cell's own nodes, at most CELL by expectation; guests pass by."""
    names = [("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]

    def run(batches):
        key, ids, lists, found, links, parent, guests = None, [], [], [], None, None, []

        def pack(i, n, root):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip((i, n, root), names)], [c for c, _ in names])

        def close():
            """Links among the cell's own nodes, once they are all there."""
            nonlocal links, parent
            links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
            if len(ids) > 1:
                for i, j, new in new_links(found, lists, key[0], np.arange(len(ids)), np.zeros(0, np.int64)):
                    np.add.at(links, np.r_[i[new], j[new]], 1)
                    unite(parent, i, j)

        def pass_by():
            nonlocal parent, guests
            m, k = len(ids), len(guests)
            own, n = np.arange(m), np.zeros(m + k, np.int64)
            parent = np.r_[parent, m + np.arange(k)]
            if m:
                for i, j, new in new_links(found + [g[2] for g in guests], lists + [g[1] for g in guests], key[0], own, m + np.arange(k)):
                    np.add.at(n, np.r_[i[new], j[new]], 1)
                    unite(parent, i, j)
            links[:] += n[:m]
            unite(parent, np.arange(m + k), np.arange(m + k))
            some = m + np.flatnonzero(parent[m:] != m + np.arange(k))
            everyone = np.array(ids + [g[0] for g in guests], np.int64)
            out = pack(everyone[some], n[some], everyone[parent[some]])
            parent, guests = parent[:m], []
            return out

        def finish():
            if key is None:
                return
            if links is None:
                close()
            if guests:
                yield pass_by()
            unite(parent, np.arange(len(ids)), np.arange(len(ids)))
            everyone = np.array(ids, np.int64)
            some = (links > 0) | (parent != np.arange(len(ids)))
            yield pack(everyone[some], links[some], everyone[parent[some]])

        last = None
        for part in text.pieces(batches, 4 << 20):
            columns = [part.column(i).to_pylist() for i in range(6)]
            for *at, guest, node, own, s in zip(*columns, sets(part.column(6))):
                if tuple(at) != key:
                    yield from finish()
                    key, ids, lists, found, links, parent, guests, last = tuple(at), [], [], [], None, None, [], None
                if not len(s) or node == last:  # a row that came twice
                    continue
                last = node
                if not guest:
                    ids.append(node), lists.append(own), found.append(s)
                    continue
                if links is None:
                    close()
                guests.append((node, own, s))
                if len(guests) >= LEAF:
                    yield pass_by()
        yield from finish()

    sent = rows.select(*KEY, "guest", "node", "regions", "text").repartition(partitions(rows), *KEY).sortWithinPartitions(*KEY, "guest", "node")
    return sent.mapInArrow(run, "node long, n long, root long")


def parted(rows: DataFrame, with_text, cell: int = CELL) -> DataFrame:
    """(region, cell, block, guest, node) of rows(region, node, size), the nodes of regions of more than `cell` nodes. with_text joins a text to each row."""
    share = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    drawn = F.pmod(F.xxhash64("node", "region"), F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1))) == 0
    tagged = rows.withColumn("pivot", drawn).withColumn("salt", F.pmod(F.hash("node"), share))
    spread = tagged.withColumn("pivot", F.lit(False)).unionByName(tagged.filter("pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), share - 1))))

    def measure(batches):
        key, pivots, sets_of = None, [], []
        for part in text.pieces(batches, 4 << 20):
            out: list = []
            held: list = []

            def flush(out=out, held=held):
                if held:
                    d = np.concatenate([distances([x[1] for x in held[k : k + LEAF]], sets_of) for k in range(0, len(held), LEAF)]) if pivots else np.ones((len(held), 1))
                    names = pivots or [0]
                    out += [(key[0], x[0], names[int(q.argmin())], float(q.min()), names, q.tolist()) for x, q in zip(held, d)]
                    held.clear()

            for region, salt, pivot, node, s in zip(*(part.column(i).to_pylist() for i in range(4)), sets(part.column(4))):
                if (region, salt) != key:
                    flush()
                    key, pivots, sets_of = (region, salt), [], []
                if pivot and len(s) and node not in pivots:
                    pivots.append(node), sets_of.append(s)
                elif not pivot and len(s):
                    held.append((node, s))
            flush()
            types = [("region", pa.int64()), ("node", pa.int64()), ("home", pa.int64()), ("d", pa.float64()), ("pivots", pa.list_(pa.int64())), ("ds", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(types)], [c for c, _ in types])

    sent = with_text(spread).select("region", "salt", "pivot", "node", "text").repartition(partitions(rows), "region", "salt").sortWithinPartitions("region", "salt", F.desc("pivot"), "node")
    far = cut(sent.mapInArrow(measure, "region long, node long, home long, d double, pivots array<bigint>, ds array<double>").dropDuplicates(["region", "node"]))
    cells = far.groupBy("region", F.col("home").alias("cell")).agg(F.max("d").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("blocks"))
    own = far.select("region", F.col("home").alias("cell"), "node").join(cells, ["region", "cell"]).withColumn("own", F.pmod(F.hash("node", F.lit(1)), "blocks"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), "own"))).select(*KEY, (F.col("block") < F.col("own")).alias("guest"), "node")
    each = far.select("region", "node", "home", F.col("d").alias("least"), F.explode(F.arrays_zip("pivots", "ds")).alias("x")).select("region", "node", "home", "least", F.col("x.pivots").alias("cell"), F.col("x.ds").alias("away"))
    guests = each.filter("home > cell").join(cells, ["region", "cell"]).filter(F.col("away") <= F.least(F.col("least") + 2 * T, F.col("radius") + T) + 1e-6)
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*KEY, F.lit(True).alias("guest"), "node")
    return own.unionByName(guests)


def linked(docs: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, node) of every row with a doc_id and a text; (node, doc_id) of each node and the least document that has it; and join_cells()."""
    member = cut(nodes(docs).select("doc_id", "node"))
    first = member.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    near = cut(regions(nodes(docs).select("node", "text")))
    release(docs.sparkSession)
    apart = cut(partners(near, cell))
    near = near.select("node", "regions")
    release(docs.sparkSession)
    # by node and doc_id, so that all copies of a text aren't in one place
    with_text = lambda rows: rows.join(nodes(docs), ["node", "doc_id"])
    hot = apart.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > cell)
    rows = apart.select("region", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("block"), F.lit(False).alias("guest"), "node")
    if not hot.isEmpty():
        rows = rows.join(hot, "region", "left_anti").unionByName(parted(apart.join(hot, "region"), lambda r: with_text(r.join(first, "node")), cell))
    joined = cut(join_cells(with_text(rows.join(near, "node").join(first, "node"))))
    release(docs.sparkSession)
    return member, first, joined


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document with an edge but the least of its group, which is group_id: large-star and small-star in turn, until
    nothing changes. Each round is written to the shared folder."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = cut(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct())
    before = None
    while (now := mark(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = cut(small)
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))


def groups(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each doc_id. Documents that are linked, by way of others too, or that have the same text, are a class; class_id is its
    least doc_id. n_links is the number of other texts that the document's own is linked with; copies count once.

    Words are runs of letters and digits in lower case; a text of one or two words has one n-gram, itself; one without words has no links. A document with a null text is
    a class of its own; rows without doc_id have no row. Rows that share a doc_id are one document: in one class, with the greatest n_links of any. Extra columns
    are ignored. Every document is a query; no link is left out."""
    member, first, joined = linked(docs, cell)
    links = joined.groupBy("node").agg(F.sum("n").alias("n_links"))
    some = member.distinct()
    least = some.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").drop("most")
    edges = joined.select(F.col("node").alias("doc_a"), F.col("root").alias("doc_b")).unionByName(some.join(least, "doc_id").select(F.col("node").alias("doc_a"), F.col("least").alias("doc_b")))
    top = first.join(components(edges).select(F.col("doc_id").alias("node"), "group_id"), "node", "left").withColumn("top", F.coalesce("group_id", "node"))
    known = top.join(top.groupBy("top").agg(F.min("doc_id").alias("class_id")), "top").join(links, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = member.join(known, "node").select("doc_id", "class_id", "n_links")
    alone = docs.filter("doc_id IS NOT NULL AND text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose class (see groups()) has a lesser doc_id, with all their columns, extra ones of any
    name included. Rows without doc_id or text stay, and so do rows that share the doc_id that stays."""
    name = free(docs, "copy")
    gone = cut(groups(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias(name)))
    release(docs.sparkSession)  # before whole rows are shuffled
    return docs.join(gone, F.col("`doc_id`") == F.col(name), "left_anti")


def op5_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_near_pairs": op5_near_pairs}
SQL = {
    "op5_near_pairs": f"""
    WITH RECURSIVE c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL),
    s AS (SELECT rep, string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') AS ws FROM c WHERE doc_id = rep),
    g AS (SELECT rep, list_distinct(CASE WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END) AS gs FROM s WHERE ws <> ['']),
    t AS (SELECT rep, len(gs) AS n, unnest(gs) AS x FROM g),
    o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM o WHERE k >= {SIMILARITY} * (na + nb - k)),
    r AS (SELECT rep AS a, rep AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a, min(b) AS top FROM r GROUP BY a),
    d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT w.doc_id, coalesce(k.top, c.rep, w.doc_id) AS class_id, coalesce(d.n, 0) AS n_links
    FROM documents w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN k ON k.a = c.rep LEFT JOIN d ON d.a = c.rep"""
}
