"""Operator 9: long repeats of any place in a text, by prefix-free parsing and suffix order.

Rolling-hash triggers cut each text into phrases. A trigger is the least hash of a window, so a stretch of text tells its first trigger whatever is around it. Places with the same
first trigger are its block, with the MIN_CHARS characters that follow each; they share its core, the CORE characters from the trigger on. Only blocks of which the core
occurs twice can hold repeats, and those meet in one task. Blocks that are alike are one class: its earliest is compared, the others repeat all of it.

There the texts are cut into phrases at every occurrence of any of their triggers, so no phrase's suffix (longer than a trigger) is the prefix of another's. The suffix array of
the dictionary, the distinct phrases, ranks suffixes by their text; that of the parse ranks what follows a phrase; both combined are the order of the corpus.
Neighbours with MIN_CHARS characters in common are occurrences of one repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenpair.llm import _blocks as blocks
from lumenpair.llm import _text as text
from lumenpair.llm._spark import partitions, table

#: Characters of a rolling hash, and hashes in a window: phrases are of at most WINDOW + ROLL characters, but for a text's first and last.
ROLL, WINDOW = 8, 48
#: Characters that a repeat has at least.
MIN_CHARS = 150
#: Characters from a trigger on that all of its block's places share.
CORE = MIN_CHARS - WINDOW + 1
#: Characters whose suffixes are ordered at once, but for a core with more of them; and characters of texts that a task holds before it sends them on.
ORDERED, HELD = 2_000_000, 24_000_000
U = np.uint64
ROLL_BASE, PHRASE_BASE = U(0x5851F42D4C957F2D), U(0xD1342543DE82EF95)
PHRASE_BASE_INVERSE = U(pow(int(PHRASE_BASE), -1, 1 << 64))
LOW = U(0xFFFFFFFF)


def scrambled(code: np.ndarray) -> np.ndarray:
    return text.mix(code.astype(np.uint64) + U(1))


def rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of the ROLL characters from each place on."""
    n = max(0, len(codes) - ROLL + 1)
    h = np.zeros(n, np.uint64)
    for k in range(ROLL):
        h *= ROLL_BASE
        h += codes[k : k + n]
    return text.mix(h)


def triggers(h: np.ndarray) -> np.ndarray:
    """The trigger of each place: of the WINDOW rolling hashes from there the least, of equal ones the last."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # the low bits give way to the place, so that the least hash tells where it is
    h = (h & ~LOW) | (LOW - np.arange(n, dtype=np.uint64))
    size = -(-n // WINDOW) * WINDOW
    grid = np.full(size, U(0xFFFFFFFFFFFFFFFF))
    grid[:n] = h
    grid = grid.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (LOW - (np.minimum(back[: n - WINDOW + 1], ahead[WINDOW - 1 : n]) & LOW)).astype(np.int64)


def digester(codes: np.ndarray):
    """A function of (starts, ends) that gives the digests of what is between them."""
    # sums of code * base^place: those of a stretch, times the base to the power of minus its start, don't depend on the start
    power, back = np.full(len(codes), PHRASE_BASE), np.full(len(codes), PHRASE_BASE_INVERSE)
    power[:1] = back[:1] = 1
    total = np.r_[U(0), np.cumsum(codes * np.multiply.accumulate(power))]
    back = np.multiply.accumulate(back)
    return lambda start, end: text.mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def within(ends: np.ndarray, n: int, room: int) -> np.ndarray:
    """Which of the first n places of concatenated texts have room characters of their text from there on."""
    return np.arange(n) + room <= np.repeat(ends[1:], np.diff(ends))[:n]


def parse(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, trigger, first place, last place, digest of the core, digest of the block) of the blocks of concatenated texts, of which ends has the offsets."""
    codes = scrambled(code)
    owner = triggers(rolling(codes))
    place = np.flatnonzero(within(ends, len(owner), MIN_CHARS))
    owner = owner[place]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    at, low, high = owner[first], place[first], place[np.r_[first[1:], len(place)][: len(first)] - 1]
    digest = digester(codes)
    block = text.mix(digest(low, high + MIN_CHARS) + ((at - low) * WINDOW + at - high).astype(np.uint64))
    return np.searchsorted(ends, at, "right") - 1, at, low, high, digest(at, at + CORE), block


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks, from 1 on, of the suffixes of concatenated sequences, each of which stops where its sequence ends: by twice as many symbols in each round. Equal ones share a rank."""
    distinct, rank = np.unique(symbols, return_inverse=True)
    rank, count, k = rank + 1, len(distinct), 1
    length = np.diff(ends)
    stop, longest = np.repeat(ends[1:], length), length.max(initial=0)
    while k < longest:
        ahead = np.arange(len(rank)) + k
        then = np.where(ahead < stop, rank[np.minimum(ahead, len(rank) - 1)], 0)
        distinct, rank = np.unique(rank * (count + 1) + then, return_inverse=True)
        rank, k = rank + 1, 2 * k
        if len(distinct) == count:
            break
        count = len(distinct)
    return rank


def corpus_order(code: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of the places `at` of concatenated texts, in the order of the suffixes that begin there."""
    codes = scrambled(code)
    h = rolling(codes)
    owner = triggers(h)
    chosen = np.unique(h[owner[within(ends, len(owner), WINDOW + ROLL - 1)]])
    # a phrase begins wherever any trigger occurs, and ends with the next one's characters
    start = np.unique(np.r_[ends[:-1], np.flatnonzero(np.isin(h, chosen) & within(ends, len(h), ROLL))])
    owner = np.searchsorted(ends, start, "right") - 1
    more = np.r_[owner[1:] == owner[:-1], False]
    end = np.where(more, np.r_[start[1:], 0] + ROLL, ends[owner + 1])
    _, known, phrase = np.unique(digester(codes)(start, end), return_index=True, return_inverse=True)
    length = (end - start)[known]
    dictionary = np.r_[0, np.cumsum(length)]
    flat = np.repeat(start[known] - dictionary[:-1], length) + np.arange(dictionary[-1])
    by_text = suffix_ranks(code[flat], dictionary)
    by_parse = suffix_ranks(by_text[dictionary[phrase]], np.searchsorted(start, ends))
    k = np.searchsorted(start, at, "right") - 1
    after = np.where(more[k], by_parse[np.minimum(k + 1, len(start) - 1)], 0)
    return np.lexsort((after, by_text[dictionary[phrase[k]] + at - start[k]]))


def common(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters that suffixes have in common, up to MIN_CHARS."""
    out, alive = np.full(len(a), MIN_CHARS), np.arange(len(a))
    for k in range(MIN_CHARS):
        same = code[a[alive] + k] == code[b[alive] + k]
        out[alive[~same]] = k
        alive = alive[same]
    return out


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal unions of spans that meet, each with the least source."""
    if not len(doc):
        return doc, start, end, source
    order = np.lexsort((start, doc))
    doc, start, end, source = doc[order], start[order].astype(np.int64), end[order].astype(np.int64), source[order]
    own = np.r_[0, np.cumsum(doc[1:] != doc[:-1])] << 33
    reach = np.maximum.accumulate(end + own)
    cut = np.flatnonzero(np.r_[True, (start + own)[1:] > reach[:-1]])
    return doc[cut], start[cut], np.maximum.reduceat(end, cut), np.minimum.reduceat(source, cut)


def copies(part: list[str], count: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """What repeats() gives, of blocks with one place each, most of which have the same text: that needs no order."""
    lead: dict[str, int] = {}
    for k in np.lexsort((low, doc)).tolist():
        lead.setdefault(part[k], k)
    first = np.array([lead[t] for t in part])
    again = (doc != doc[first]) | (low != low[first])
    return united(doc[again], low[again], low[again] + MIN_CHARS, doc[first][again]), doc[first]


def repeats(part: list[str], count: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(doc, start, end, source) of the repeats in the texts of blocks with count places each, the first at low; and the least source of each block's places."""
    code, ends = points(part), np.r_[0, np.cumsum([len(t) for t in part])]
    block = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at, place, of = ends[block] + step, low[block] + step, doc[block]
    order = corpus_order(code, ends, at)
    alike = common(code, at[order[:-1]], at[order[1:]]) >= MIN_CHARS
    group = np.zeros(len(at), np.int64)
    group[order] = np.r_[0, np.cumsum(~alike)]
    order = np.lexsort((place, of, group))
    first = order[np.searchsorted(group[order], np.arange(group.max() + 1))][group]
    again = (of != of[first]) | (place != place[first])
    source = of[first]
    return united(of[again], place[again], place[again] + MIN_CHARS, source[again]), np.minimum.reduceat(source, np.cumsum(count) - count)


def texts(batches):
    """(doc ids, offsets, code points) of a few texts at a time; those without id or text are left out."""
    for part in text.pieces(batches, 1 << 20):
        rows = [(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if i is not None and t]
        if rows:
            code = np.frombuffer("".join(t for _, t in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield np.array([i for i, _ in rows], np.int64), np.r_[0, np.cumsum([len(t) for _, t in rows])], code


def packed(bucket: int, kind: int, info: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
    """Rows and their texts, compressed."""
    raw = b"".join(pieces)
    size = np.array([len(raw), *map(len, pieces)], np.int64).tobytes()
    row = [[bucket], [kind], [info.tobytes()], [pa.compress(raw, "zstd", asbytes=True)], [size]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, blocks.ARROW)], schema=blocks.ARROW)


def unpacked(blob: bytes, size: bytes) -> list[bytes]:
    size = np.frombuffer(size, np.int64)
    raw = pa.decompress(blob, int(size[0]), "zstd", asbytes=True)
    ends = np.r_[0, np.cumsum(size[1:])].tolist()
    return [raw[s:e] for s, e in zip(ends[:-1], ends[1:])]


def points(pieces: list[str]) -> np.ndarray:
    return np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, first_doc_id) of the passages to remove: maximal unions of stretches of MIN_CHARS characters whose earliest occurrence, by
    (doc_id, start_char), is another. first_doc_id is the least document that has one of the union's stretches.

    Occurrences may be in other documents or in the same, and overlap. Unions that meet are one. Rows without doc_id or text have none; rows that share a
    doc_id are one document, and what they have at the same place occurs once. Texts count whole; extra columns are ignored."""
    reducers = partitions(docs)
    buckets = reducers * 4
    home = lambda ids: text.mix(np.ascontiguousarray(ids).view(np.uint64)) % U(buckets)
    place = np.dtype([("doc", "<i8"), ("at", "<i4")])
    shape = np.dtype([("block", "<u8"), ("back", "u1"), ("ahead", "u1")])
    known = np.dtype([("start", "<i4"), ("n", "<i4")])
    asked = np.dtype([("at", "<i4"), ("back", "u1"), ("ahead", "u1"), ("fetch", "?")])
    keys = np.dtype([("core", "<u8"), ("block", "<u8")])
    member = np.dtype([("core", "<u8"), ("block", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("back", "u1"), ("ahead", "u1"), ("fetch", "?")])
    FOUND, ASKED, TEXT = 0, 1, 2

    def record(kind, n, /, **columns):
        out = np.zeros(n, kind)
        for k, v in columns.items():
            out[k] = v
        return out

    def span(start, end):
        return record(known, len(start), start=start, n=end - start)

    def send(batches):
        """Blocks, to the task of their core."""
        out = blocks.Sender(buckets)
        for ids, ends, code in texts(batches):
            doc, at, low, high, core, block = parse(code, ends)
            where = record(place, len(doc), doc=ids[doc], at=at - ends[doc])
            yield from out.add(core % U(buckets), (core // U(buckets)) & U(0xFFFFFFFFFF), where, record(shape, len(doc), block=block, back=at - low, ahead=at - high))
        yield from out.flush()

    def send_texts(batches):
        """Texts, to the task of their document."""
        held: dict[int, list] = {}
        n = 0

        def flush():
            for b, rows in held.items():
                yield packed(b, TEXT, np.array([i for i, _ in rows], np.int64), [t for _, t in rows])
            held.clear()

        for part in text.pieces(batches, 4 << 20):
            rows = [(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()) if i is not None and t and len(t) >= MIN_CHARS]
            for b, row in zip(home(np.array([i for i, _ in rows], np.int64)).tolist(), rows):
                held.setdefault(b, []).append(row)
                n += len(row[1])
            if n >= HELD:
                yield from flush()
                n = 0
        yield from flush()

    def meet(batches):
        """Of blocks that share their core: copies of the only one there is are repeats; where there are several, the earliest of each is to be compared. All go to their document."""
        found, ask, kind = blocks.Sender(buckets, FOUND), blocks.Sender(buckets, ASKED), (np.uint64, place, shape)
        got = blocks.gather(batches, {0: kind})[0]
        for b in sorted({r[0] for r in got}):
            _, core, where, form = blocks.joined([r for r in got if r[0] == b], kind)
            _, group, count = np.unique(core, return_inverse=True, return_counts=True)
            keep = np.flatnonzero(count[group] > 1)
            keep = keep[np.lexsort((where["at"][keep], where["doc"][keep], form["block"][keep], group[keep]))]
            group, core, where, form = group[keep], core[keep], where[keep], form[keep]
            if not len(keep):
                continue
            rival = np.r_[True, (group[1:] != group[:-1]) | (form["block"][1:] != form["block"][:-1])]
            # rows that share a doc_id may give a place twice
            once = rival | np.r_[True, where[1:] != where[:-1]]
            rival, group, core, where, form = rival[once], group[once], core[once], where[once], form[once]
            first = np.maximum.accumulate(np.where(rival, np.arange(len(rival)), 0))
            alone = np.bincount(group, rival)[group] < 2
            low, high = where["at"] - form["back"], where["at"] - form["ahead"].astype(np.int32)
            k = np.flatnonzero(alone & ~rival)
            yield from found.add(home(where["doc"][k]), where["doc"][k], span(low[k], high[k] + MIN_CHARS), where["doc"][first[k]])
            k = np.flatnonzero(~alone)
            what = record(asked, len(k), at=where["at"][k], back=form["back"][k], ahead=form["ahead"][k], fetch=rival[k])
            yield from ask.add(home(where["doc"][k]), where["doc"][k], what, record(keys, len(k), core=core[k] * U(buckets) + U(b), block=form["block"][k]))
        yield from found.flush()
        yield from ask.flush()

    def fetch(batches):
        """Blocks that are to be compared, with their text, to the task of their core; what is found already stays with its document."""
        out, kinds = blocks.Sender(buckets, FOUND), {FOUND: (np.int64, known, np.int64), ASKED: (np.int64, asked, keys), TEXT: (np.int64, np.uint8, np.int64)}
        got = blocks.gather(batches, kinds)
        to: dict[int, list] = {}
        for b in sorted({r[0] for rows in got.values() for r in rows}):
            _, doc, what, source = blocks.joined([r for r in got[FOUND] if r[0] == b], kinds[FOUND])
            doc, start, end, source = united(doc, what["start"], what["start"] + what["n"], source)
            yield from out.add(home(doc), doc, span(start, end), source)
            _, doc, what, key = blocks.joined([r for r in got[ASKED] if r[0] == b], kinds[ASKED])
            row = record(member, len(doc), doc=doc, core=key["core"], block=key["block"], at=what["at"], back=what["back"], ahead=what["ahead"], fetch=what["fetch"])
            wanted, have = set(doc[what["fetch"]].tolist()), {}
            for _, ids, blob, size in (r for r in got[TEXT] if r[0] == b):
                if not wanted.isdisjoint(ids.tolist()):
                    for i, t in zip(ids.tolist(), unpacked(blob.tobytes(), size.tobytes())):
                        if i in wanted:
                            have.setdefault(i, []).append(t.decode())
            own = {}  # rows that share a doc_id are told apart by their blocks
            for i, t in ((i, t) for i, several in have.items() if len(several) > 1 for t in several):
                _, at, _, _, _, block = parse(points([t]), np.array([0, len(t)]))
                own |= {(i, a, d): t for a, d in zip(at.tolist(), block.tolist())}
            part = [b""] * len(row)
            for k in np.flatnonzero(row["fetch"]).tolist():
                at = int(row["at"][k])
                low, end = at - int(row["back"][k]), at - int(row["ahead"][k]) + MIN_CHARS
                choice = have[int(row["doc"][k])]
                part[k] = (choice[0] if len(choice) == 1 else own[int(row["doc"][k]), at, int(row["block"][k])])[low:end].encode()
            target = row["core"] % U(buckets)
            order = np.argsort(target, kind="stable")
            target, row = target[order], row[order]
            for s, e in zip(*edges(target)):
                to.setdefault(int(target[s]), []).append((row[s:e], [part[k] for k in order[s:e]]))
        yield from out.flush()
        for b, rows in to.items():
            yield packed(b, ASKED, np.concatenate([r for r, _ in rows]), [t for _, part in rows for t in part])

    def edges(x):
        start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        return start, np.r_[start[1:], len(x)][: len(start)]

    def shares(row, part, own, least, most):
        """(which blocks, their texts, places in each, the first of these, how to find repeats) of what is compared at once: all of the places that are least to most characters before the
        trigger. If these have too much text, either half of them: such places share more than the core, and only blocks that have it in common, two or more, are compared."""
        back, ahead = np.minimum(row["back"][own], most).astype(np.int64), np.maximum(row["ahead"][own], least).astype(np.int64)
        some = back >= ahead
        own, back, ahead = own[some], back[some], ahead[some]
        size = back - ahead + MIN_CHARS
        cut = lambda k, b, a: part[k][int(row["back"][k]) - b : int(row["back"][k]) - a + MIN_CHARS]
        if len(own) and (len(own) == 1 or least == most or size.sum() <= ORDERED):
            how = repeats if size.sum() <= ORDERED else copies
            yield own, [cut(*x) for x in zip(own.tolist(), back.tolist(), ahead.tolist())], back - ahead + 1, row["at"][own] - back, how
        elif len(own):
            middle = (least + most) // 2
            for low, high in ((least, middle), (middle + 1, most)):
                has = np.flatnonzero((back >= low) & (ahead <= high))
                key = np.array([hash(cut(k, low, high)) for k in own[has].tolist()], np.int64)
                has, key = has[order := np.argsort(key, kind="stable")], key[order]
                held, n = [], 0
                for s, e in zip(*edges(key)):
                    if e - s > 1:
                        if held and n + size[has[s:e]].sum() > ORDERED:
                            yield from shares(row, part, np.concatenate(held), low, high)
                            held, n = [], 0
                        held.append(own[has[s:e]])
                        n += size[has[s:e]].sum()
                if held:
                    yield from shares(row, part, np.concatenate(held), low, high)

    def order_suffixes(batches):
        """The repeats, sent to their document."""
        out, by = blocks.Sender(buckets, FOUND), {}
        for batch in batches:
            for b, kind, *rest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == FOUND:
                    doc, what, source = (np.frombuffer(x, t) for x, t in zip(rest, (np.int64, known, np.int64)))
                    yield from out.add(home(doc), doc, what, source)
                else:
                    by.setdefault(b, []).append(rest)
        for rows in by.values():
            row = np.concatenate([np.frombuffer(info, member) for info, _, _ in rows])
            part = [t for _, blob, size in rows for t in unpacked(blob, size)]
            order = np.lexsort((~row["fetch"], row["block"], row["core"]))  # the one with a text leads its copies
            row, part = row[order], [part[k].decode() for k in order]
            low, high = row["at"] - row["back"].astype(np.int64), row["at"] - row["ahead"].astype(np.int64)
            reach = np.cumsum([len(t) for t in part])
            s, held = edges(row["core"])[1], 0
            begin = 0
            for j, e in enumerate(s.tolist()):  # whole cores, as many as fit
                if e < len(row) and reach[s[j + 1] - 1] - held <= ORDERED:
                    continue
                lead = np.flatnonzero(row["fetch"][begin:e]) + begin
                least = row["doc"][lead].copy()
                for own, piece, count, first, how in shares(row[lead], [part[k] for k in lead], np.arange(len(lead)), 0, WINDOW - 1):
                    (doc, start, end, source), found = how(piece, count, row["doc"][lead[own]], first)
                    yield from out.add(home(doc), doc, span(start, end), source)
                    least[own] = np.minimum(least[own], found)
                copy = np.flatnonzero(~row["fetch"][begin:e]) + begin
                source = least[np.searchsorted(lead, copy) - 1]
                yield from out.add(home(row["doc"][copy]), row["doc"][copy], span(low[copy], high[copy] + MIN_CHARS), source)
                begin, held = e, reach[e - 1]
        yield from out.flush()

    def unite(batches):
        kind = (np.int64, known, np.int64)
        _, doc, what, source = blocks.joined(blocks.gather(batches, {FOUND: kind})[FOUND], kind)
        doc, start, end, source = united(doc, what["start"], what["start"] + what["n"], source)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(source)], ["doc_id", "start_char", "end_char", "first_doc_id"])

    rows = docs.select("doc_id", "text")
    step = blocks.exchange(rows.mapInArrow(send, blocks.SCHEMA), meet, reducers)
    step = blocks.exchange(step.union(rows.mapInArrow(send_texts, blocks.SCHEMA)), fetch, reducers)
    step = blocks.exchange(step, order_suffixes, reducers)
    return blocks.exchange(step, unite, reducers, "doc_id long, start_char int, end_char int, first_doc_id long")


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))


QUERIES = {"op9_phrase_dedup": op9_phrase_dedup}
SQL = {
    "op9_phrase_dedup": f"""
    WITH c AS (SELECT doc_id, text, unnest(range(0, length(text) - {MIN_CHARS} + 1, 1000)) AS s FROM documents WHERE doc_id IS NOT NULL),
    p AS (SELECT doc_id, s, substr(text, s + 1, {1000 + MIN_CHARS - 1}) AS part FROM c),
    j AS (SELECT doc_id, s, part, unnest(range(0, length(part) - {MIN_CHARS} + 1)) AS j FROM p),
    w AS (SELECT DISTINCT doc_id, s + j AS s, substr(part, j + 1, {MIN_CHARS}) AS x FROM j),
    t AS (SELECT x, min(doc_id) AS f, count(*) AS n FROM w GROUP BY x HAVING n > 1),
    o AS (SELECT w.x, f, min(s) AS origin FROM w JOIN t ON w.x = t.x AND w.doc_id = f GROUP BY w.x, f),
    again AS (SELECT DISTINCT doc_id, s, f FROM w JOIN o ON w.x = o.x WHERE doc_id > f OR s > origin),
    isle AS (SELECT *, max(s + {MIN_CHARS}) OVER (PARTITION BY doc_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM again),
    run AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM isle)
    SELECT doc_id, CAST(min(s) AS INTEGER) AS start_char, CAST(max(s) + {MIN_CHARS} AS INTEGER) AS end_char, min(f) AS first_doc_id FROM run GROUP BY doc_id, island"""
}
