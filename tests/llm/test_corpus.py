"""The corpus operators: hard rows of every kind, and brute force on small fixtures."""

import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lumenpair.llm import benchmark, bpe, exact_dedup, line_dedup, near_dedup, phrase_dedup, quality, token_counts, toxicity, url_filter

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(4000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __digest string, __rank int, __won long, __leak string, __copy string, __stat string, __spans string, removed_spans string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE, PASSAGE = prose(300, 1), prose(80, 2)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(BASE.split()[50], "zzz", 1)), (4, prose(200, 3) + "\n" + PASSAGE + "\n" + prose(100, 4)),
    (5, prose(150, 5) + "\n" + PASSAGE), (6, ""), (7, None), (None, BASE), (None, None), (8, " \n\t"), (9, "word"), (10, "word"), (11, prose(30_000, 6)),
    (12, "\U0001f600 ünï \x00 <|endoftext|> " * 20), (12, prose(60, 8)), (13, "a" * 20_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if i else None, None, "d", 1, 2, "l", "c", "s", "x", "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.select("doc_id").collect())


def test_exact_dedup(docs, empty):
    got = exact_dedup.dedup(docs)
    first = {}
    for i, t in TEXTS:
        first[t] = min(first.get(t, 10**9), 10**9 if i is None else i)
    assert ids(got) == sorted(-1 if i == 10**9 else i for i in first.values())
    assert got.columns == docs.columns and exact_dedup.dedup(empty).count() == 0
    assert ids(exact_dedup.dedup(docs, counters=1)) == ids(got)


def test_misra_gries():
    items = ["a"] * 50 + ["b"] * 30 + [str(k) for k in range(40)]
    random.Random(1).shuffle(items)
    assert {"a", "b"} <= set(exact_dedup.misra_gries(items, 4)) and len(exact_dedup.misra_gries(items, 4)) <= 4
    parts = [exact_dedup.misra_gries(items[k::3], 4) for k in range(3)]
    assert "a" in exact_dedup.merge(parts, 4)


def jaccard(a, b):
    w = [[x for x in t.lower().split()] for t in (a, b)]
    s = [{tuple(x[k : k + 3]) for k in range(max(1, len(x) - 2))} for x in w]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def plain_groups(rows):
    """(doc_id, class_id, n_links) by comparing all pairs of different texts."""
    rep = {}
    for d, t in sorted(rows):
        rep.setdefault(t, d)
    text = {d: t for t, d in rep.items()}
    near = {d: {e for e in text if e != d and jaccard(text[d], text[e]) >= near_dedup.SIMILARITY} for d in text}
    top = {d: d for d in text}
    for _ in text:
        top = {d: min([top[d], *(top[e] for e in near[d])]) for d in text}
    return sorted((d, top[rep[t]], len(near[rep[t]])) for d, t in rows)


def near_rows():
    rows, r = [], random.Random(3)
    for k in range(40):
        words = prose(r.randint(5, 120), 100 + k).split()
        rows.append((len(rows), " ".join(words)))
        for share in (0.0, 0.02, 0.05, 0.1, 0.15):
            copy = [w if r.random() >= share else r.choice(VOCAB) for w in words]
            rows.append((len(rows), " ".join(copy)))
    crowd = prose(60, 190).split()  # a crowd: one region must be parted
    for k in range(90):
        rows.append((len(rows), " ".join(w if r.random() > 0.08 else r.choice(VOCAB) for w in crowd)))
    return rows


@pytest.mark.parametrize("cell", [near_dedup.CELL, 12])
def test_near_groups_against_brute_force(spark, empty, cell):
    rows = near_rows()
    got = sorted(tuple(x) for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), cell).collect())
    assert got == plain_groups(rows) and max(x[2] for x in got) > 20
    assert near_dedup.groups(empty, cell).count() == 0


def test_frequent_ngrams_change_nothing(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(near_dedup, "SAMPLE", 1)
    monkeypatch.setattr(near_dedup, "OFTEN", 2)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(near_dedup.frequent(near_dedup.nodes(d).select("node", "text"))[0]) > 100
    assert sorted(tuple(x) for x in near_dedup.groups(d).collect()) == plain_groups(rows)


def entangled_rows():
    """Unrelated texts with over half of their n-grams in others, and five near copies."""
    r, pool = random.Random(12), [prose(6, 500 + k) for k in range(100)]
    rows = [(d, " ".join(f"{p} x{d}y{k}" for k, p in enumerate(r.sample(pool, 20)))) for d in range(150)]
    return rows + [(150 + d, rows[d][1] + " " + prose(9, 900 + d)) for d in range(5)]


def test_near_sends_texts_only_to_likely_partners(spark, monkeypatch):
    rows, sent, real = entangled_rows(), [], near_dedup.join_cells
    monkeypatch.setattr(near_dedup, "join_cells", lambda rows: sent.append(rows.count()) or real(rows))
    assert sorted(tuple(x) for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_groups(rows)
    assert sent[0] <= 20


def test_near_stage_sends_texts_only_to_likely_partners(spark, monkeypatch):
    import corpus_pipeline as p

    rows, sent, real = entangled_rows(), [], near_dedup.join_cells
    monkeypatch.setattr(near_dedup, "join_cells", lambda rows: sent.append(rows.count()) or real(rows))
    assert ids(p.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")) == [d for d, top, _ in plain_groups(rows) if d == top]
    assert sent[0] <= 20


def test_nodes_of_one_code_are_told_apart(spark, monkeypatch):
    rows = near_rows()
    few = F.expr("shiftleft(pmod(xxhash64(text), 40), 32) + pmod(xxhash64(text), 4294967296)")
    monkeypatch.setattr(near_dedup, "nodes", lambda docs: docs.select("doc_id", few.alias("node"), "text"))
    assert sorted(tuple(x) for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_groups(rows)


def test_parities_leave_out_no_link():
    import numpy as np

    r, found = np.random.default_rng(4), []
    for _ in range(60):
        base = r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64)
        for part in (1.0, 0.8, 0.6, 0.5):
            found.append(np.unique(np.r_[base[: max(1, int(len(base) * part))], r.integers(0, 1 << 63, int(len(base) * r.random() * 0.3)).astype(np.uint64)]))
    sketches = near_dedup.Sketches(1)
    [row] = [*sketches.add(np.zeros(len(found), np.int64), np.arange(len(found)), found), *sketches.flush()]
    n, bits = np.frombuffer(row.column(3)[0].as_py(), np.int32), row.column(4)[0].as_py()
    end = np.cumsum(near_dedup.widths(n) // 8)
    kept = near_dedup.Parities(n, [bits[e - w // 8 : e] for e, w in zip(end.tolist(), near_dedup.widths(n).tolist())])
    a, b = np.triu_indices(len(found), 1)
    linked = np.array([len(np.intersect1d(found[i], found[j])) >= near_dedup.SIMILARITY * len(np.union1d(found[i], found[j])) for i, j in zip(a, b)])
    likely = kept.likely(a, b)
    assert linked.sum() > 100 and likely[linked].all() and likely.sum() < 3 * linked.sum()


def test_cells_are_exact(monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_dedup, "LEAF", 20)
    r = random.Random(5)
    sets = [np.unique(np.array([r.randint(0, 60) for _ in range(r.randint(3, 30))], np.uint64)) for _ in range(300)]
    got = sorted((min(a, b), max(a, b)) for i, j, _ in near_dedup.metric_join(sets, np.arange(300), np.zeros(0, np.int64)) for a, b in zip(i.tolist(), j.tolist()))
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= near_dedup.SIMILARITY]
    assert got == want


def test_near_hard_rows(docs, empty):
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_dedup.groups(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 10: (9, 0)} | {d: (d, 0) for d in (4, 5, 6, 7, 8, 9, 11, 12, 13)} and near_dedup.groups(docs).count() == len(got)
    twice = docs.sparkSession.createDataFrame([(1, prose(30, 880)), (2, prose(30, 881)), (3, prose(30, 880)), (3, prose(30, 881))], "doc_id long, text string")
    assert sorted(tuple(x) for x in near_dedup.groups(twice).collect()) == [(1, 1, 0), (2, 1, 0), (3, 1, 0)]
    kept = near_dedup.keep_one(docs)
    assert ids(kept) == sorted([-1, -1, 1, 4, 5, 6, 7, 8, 9, 11, 12, 12, 13]) and kept.columns == docs.columns
    assert near_dedup.keep_one(empty).count() == 0


def test_line_dedup(docs, empty):
    got = line_dedup.repeats(docs).collect()
    text = TEXTS[5][1]
    at = text.index(PASSAGE)
    assert (5, at, at + len(PASSAGE), 80, 4) in [tuple(r) for r in got]
    removed = {r.doc_id: r.text for r in line_dedup.remove(docs).filter("doc_id IN (4, 5, 6)").collect()}
    assert PASSAGE in removed[4] and PASSAGE not in removed[5] and removed[6] == ""
    assert line_dedup.repeats(empty).count() == 0 and line_dedup.remove(empty).count() == 0
    assert docs.count() == line_dedup.remove(docs).count()


def test_passages_of_short_lines(spark):
    poem = "\n".join(prose(6, 600 + k) + ("\n" if k % 3 == 2 else "") for k in range(9))
    mixed = prose(6, 620) + "\n" + prose(30, 621) + "\n" + prose(5, 622)
    note = prose(5, 630) + "\n" + prose(4, 631)  # 9 words: too few
    rows = [(k, prose(40, 640 + k) + "\n" + part + "\n" + prose(40, 660 + k)) for k, part in enumerate([poem, poem, mixed, mixed, note, note])]
    rows += [(10, prose(40, 670) + "\n" + poem + "\n" + prose(40, 671) + "\n" + poem), (11, "\n".join(poem.split("\n")[::2])), (None, poem), (12, None)]
    d, text = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    got = {(r.doc_id, text[r.doc_id][r.start_char : r.end_char].strip("\n"), r.first_doc_id) for r in line_dedup.repeats(d).collect()}
    assert got == {(1, poem.strip("\n"), 0), (3, mixed, 2), (10, poem.strip("\n"), 0)}
    left = {r.doc_id: r.text for r in line_dedup.remove(d).filter("doc_id IS NOT NULL").collect()}
    assert poem.split("\n")[0] in left[0] and not [w for w in poem.split("\n") if w and w in left[1] + left[10]]
    assert prose(30, 621) not in left[3] and prose(6, 620) not in left[3] and note in left[5] and left[11] == text[11]


def plain_runs(rows, least):
    """Repeated runs of units, by comparing every link with all that came before."""
    split = {d: [u for u in line_dedup.units(t)] for d, t in rows}
    order = sorted((d, k, kind) for d, us in split.items() for k in range(len(us)) for kind in (1, 2) if k + kind <= len(us) and (kind == 2 or us[k][1] >= least))
    name = lambda d, k, kind: tuple(u[0] for u in split[d][k : k + kind])
    out = []
    for d, us in split.items():
        covered, first, joined = set(), {}, set()
        for k in range(len(us)):
            for kind in (1, 2):
                if (d, k, kind) in order:
                    same = [o for o in order if o[2] == kind and name(*o) == name(d, k, kind)]
                    if min(same)[:2] < (d, k):
                        covered |= set(range(k, k + kind))
                        first[k] = min(first.get(k, 10**9), same[0][0])
                        if kind == 2:
                            joined.add(k)
        k = 0
        while k < len(us):
            if k not in covered:
                k += 1
                continue
            end = k
            while end in joined:
                end += 1
            if sum(u[1] for u in us[k : end + 1]) >= least:
                out.append((d, us[k][2], us[end][3], sum(u[1] for u in us[k : end + 1]), min(first[j] for j in range(k, end + 1) if j in first)))
            k = end + 1
    return sorted(out)


def test_line_dedup_against_brute_force(spark):
    r, pool = random.Random(31), [prose(n, 3000 + n) for n in range(1, 26)]
    rows = [(d, "".join(r.choice(pool) + r.choice([". ", "\n", "! ", "?\n\n", " ... "]) for _ in range(r.randint(0, 14)))) for d in range(60)]
    rows += [(60, rows[3][1]), (61, "x" * 70_000 + ". " + rows[3][1])]
    got = sorted(tuple(x) for x in line_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_runs(rows, line_dedup.MIN_WORDS) and len(got) > 20


def test_rows_that_share_a_doc_id_lose_only_their_own_repeats(spark):
    kept, other = prose(60, 41), prose(60, 42)
    rows = [(1, kept), (2, kept + "\n" + prose(30, 43)), (2, other), (2, other), (3, prose(9, 44) + ". " + kept.upper() + ". " + prose(9, 45))]
    left = [r.text for r in line_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", F.length("text")).collect()]
    assert left[0] == kept and left[1] == prose(30, 43) and left[2] == left[3] == other
    assert left[4].split() == (prose(9, 44) + ". " + prose(9, 45)).split()


def test_phrase_dedup(docs, spark, empty):
    got = phrase_dedup.spans(docs).collect()
    five = [r for r in got if r.doc_id == 5]
    at = TEXTS[5][1].index(PASSAGE)
    assert five and all(r.first_doc_id == 4 and r.end_char > at for r in five)
    covered = sum(r.end_char - r.start_char for r in five)
    assert covered >= len(PASSAGE) - 2 * (phrase_dedup.WINDOW + phrase_dedup.ROLL)
    assert not [r for r in got if r.doc_id in (1, 4, 6, 7, 8, 9, 11)]
    assert phrase_dedup.spans(empty).count() == 0


def test_phrases_against_brute_force(spark):
    r, least = random.Random(21), phrase_dedup.MIN_CHARS
    texts = {k: prose(r.randint(20, 120), 7000 + k) for k in range(30)}
    planted = []
    for k in range(12):
        passage = prose(r.randint(45, 140), 7100 + k)
        for d in sorted(r.sample(range(30), 3)):
            cut = r.randint(0, len(texts[d]))
            texts[d] = texts[d][:cut] + passage + texts[d][cut:]
        planted.append(passage)
    texts[30] = texts[3] + " " + texts[3]
    got = phrase_dedup.spans(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len({(x.doc_id, x.start_char) for x in got}) > 20
    seen: dict = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - least + 1):
            seen.setdefault(texts[d][i : i + least], (d, i))
    for x in got:  # every character of a span is within a stretch that came earlier
        t = texts[x.doc_id]
        again = [i for i in range(x.start_char, x.end_char - least + 1) if seen[t[i : i + least]] < (x.doc_id, i)]
        covered = {c for i in again for c in range(i, i + least)}
        assert covered >= set(range(x.start_char, x.end_char)) and x.first_doc_id <= x.doc_id
    marked = {d: set() for d in texts}
    for x in got:
        marked[x.doc_id] |= set(range(x.start_char, x.end_char))
    slack = 2 * (phrase_dedup.WINDOW + phrase_dedup.ROLL)
    for passage in planted:
        where = [(d, t.index(passage)) for d, t in sorted(texts.items()) if passage in t]
        for d, i in where[1:]:
            if len(passage) >= least + slack:
                assert len(marked[d] & set(range(i, i + len(passage)))) >= len(passage) - slack


def plain_repeats(rows, least):
    """Unions of the stretches of `least` characters that have an earlier occurrence, by (doc_id, place), each with the least document of its stretches."""
    seen, found = {}, []
    places = sorted({(d, i, t[i : i + least]) for d, t in rows if d is not None and t for i in range(len(t) - least + 1)})
    for d, i, x in places:
        seen.setdefault(x, (d, i))
    for d, i, x in places:
        if seen[x] != (d, i):
            if found and found[-1][0] == d and i <= found[-1][2]:
                found[-1] = (d, found[-1][1], max(found[-1][2], i + least), min(found[-1][3], seen[x][0]))
            else:
                found.append((d, i, i + least, seen[x][0]))
    return found


def shared_passages():
    """Passages of every length about MIN_CHARS, at any place, within other text, in each other, beside themselves, in periods, and in rows that share a doc_id."""
    r, least = random.Random(61), phrase_dedup.MIN_CHARS
    letters = lambda n: "".join(r.choice("abcd \u00fc\U0001f600") for _ in range(n))
    rows = [(k, letters(r.randint(0, 400))) for k in range(60)]
    for k in range(40):
        passage = letters(r.choice([least - 1, least, least + 1, r.randint(least, 2 * least), r.randint(least, 5 * least)]))
        for j in r.sample(range(60), 3):
            d, t = rows[j]
            cut, e = r.randint(0, len(t)), r.randint(0, 40) * (k % 2)
            rows[j] = (d, t[:cut] + passage[e:] + t[cut:])
    rows += [(60, "a" * 900), (61, "x" + "a" * 333 + "b"), (62, "ab" * 300), (63, "b" + "abc" * 200 + "abcab"), (64, "zabc" * 20 + "ab" * 120), (65, letters(30) + "abc" * 90)]
    rows += [(66, rows[3][1] * 3), (67, rows[5][1]), (67, rows[5][1]), (67, "q" + rows[6][1]), (67, rows[5][1][:200] + rows[7][1]), (68, None), (None, rows[5][1]), (69, "")]
    return rows + [(-5, rows[9][1]), (70, letters(149)), (71, letters(150))]


@pytest.mark.parametrize("held", [None, 1])
def test_repeats_of_any_length_and_place_are_whole(spark, monkeypatch, held):
    if held:  # each core by itself, texts sent one piece at a time
        monkeypatch.setattr(phrase_dedup, "ORDERED", held)
        monkeypatch.setattr(phrase_dedup, "HELD", held)
    rows = shared_passages()
    got = sorted(tuple(x) for x in phrase_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == plain_repeats(rows, phrase_dedup.MIN_CHARS) and len(got) > 40


def test_sql_of_repeats():
    import duckdb

    rows, db = shared_passages(), duckdb.connect()
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    db.register("documents", documents)
    assert sorted(db.sql(phrase_dedup.SQL["op9_phrase_dedup"]).fetchall()) == plain_repeats(rows, phrase_dedup.MIN_CHARS)


def test_suffixes_come_in_the_order_of_the_corpus():
    import numpy as np

    for least in (1, 400):  # texts with and without triggers
        part = [t for _, t in shared_passages() if t and len(t) >= least]
        ends, code = np.r_[0, np.cumsum([len(t) for t in part])], phrase_dedup.points(part)
        order = phrase_dedup.corpus_order(code, ends, np.arange(len(code))).tolist()
        suffixes = [t[k:] for t in part for k in range(len(t))]
        assert [suffixes[k] for k in order] == sorted(suffixes)


def plain_score(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1)
            best = max(best, row[j + 1])
        prev = row
    return best


def test_alignment():
    import numpy as np

    r = random.Random(9)
    for _ in range(30):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 15))] for _ in range(2))
        assert benchmark.align(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_score(a, b)


def test_decontamination(spark, docs, empty):
    item = prose(40, 50)
    edited = item.split()
    edited[10:12] = ["xx"]
    rows = [(1, prose(100, 51) + " " + item + " " + prose(100, 52)), (2, prose(100, 53) + " " + " ".join(edited)), (3, prose(400, 54)), (4, None), (None, item), (5, "")]
    items = spark.createDataFrame([(7, item), (8, "too few words"), (9, None), (None, "x"), (10, "")], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in benchmark.leaks(d, items).collect()) == [(1, 7), (2, 7)]
    assert ids(benchmark.keep_clean(d, items)) == [3, 4, 5]  # the row without an id is the item itself
    some = [(1, "a b c too few words d"), (2, "too few"), (2, "too  FEW! words"), (3, "few words"), (3, "x")]
    got = spark.createDataFrame(some, "doc_id long, text string")
    short = spark.createDataFrame([(8, "too few words"), (11, "few words"), (11, "few words"), (12, "absent")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in benchmark.leaks(got, short).collect()) == [(1, 8, 1.0), (2, 8, 1.0), (3, 11, 1.0)]
    assert sorted(r.text for r in benchmark.keep_clean(got, short).collect()) == ["too few", "x"]
    assert benchmark.leaks(empty, items).count() == 0 and benchmark.leaks(d, items.limit(0)).count() == 0
    assert benchmark.keep_clean(docs, items).columns == docs.columns


def test_decontamination_against_brute_force(spark):
    r, rows, items = random.Random(12), [], []
    for k in range(24):
        item = prose(r.randint(15, 60), 700 + k).split()
        half = item[: len(item) // 2 + 1]
        copy = [item[:3] + [w if j % 4 else "zz" for j, w in enumerate(item[3:])], half, [w if r.random() > 0.2 else r.choice(VOCAB) for w in item]][k % 3]  # the item's only trace
        items.append((k, " ".join(item)))
        rows.append((k, prose(80, 800 + k) + " " + " ".join(copy) + " " + prose(80, 900 + k)))
    rows += [(100 + k, prose(40, 990 + k) + " " + " ".join(items[1][1].split()[:30])) for k in range(20)]  # a half that is everywhere
    rows += [(200, prose(30, 980) + " " + " ".join(items[1][1].split()[-3:]))]
    words = lambda t: t.lower().split()
    grams = lambda t: {tuple(words(t)[k : k + 3]) for k in range(len(words(t)) - 2)}
    want = {(d, i): s for d, t in rows for i, x in items if grams(t) & grams(x) and (s := plain_score(words(x), words(t)) / (2 * len(words(x)))) >= benchmark.LEAST}
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in benchmark.leaks(d, b).collect()}
    assert {(k, k) for k in range(24)} <= set(want) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_quality(spark, docs, empty):
    bad = lambda k: "### $$$ %%% &&& " * (20 + k)
    rows = [(k, prose(50 + k, k) if k % 2 else bad(k)) for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (90, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    assert all(r["keep"] == bool(r.doc_id % 2) for r in quality.score(d, model).filter("doc_id >= 80").collect())
    assert quality.score(docs, model).count() == len(TEXTS) and quality.keep(docs, model).columns == docs.columns
    assert quality.score(empty, quality.train(empty, labels)).count() == 0 and quality.keep(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(k, prose(60, k) + (" idiot moron scum" * 4 if k % 2 else "")) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    held = toxicity.score(d, model).filter("doc_id >= 300").collect()
    assert sum(r.toxic == bool(r.doc_id % 2) for r in held) >= 0.9 * len(held)
    got = toxicity.score(docs, model)
    assert got.count() == len(TEXTS) and got.filter("doc_id = 7").first().toxic_ll is None and got.filter("doc_id = 6").first().n_words == 0
    assert toxicity.score(empty, model).count() == 0


def test_bpe(docs, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip in (True, None) for r in rows)
    assert sorted(len(r.token_ids) for r in rows if r.token_ids is not None) == sorted(len(theirs.encode_ordinary(t)) for _, t in TEXTS if t is not None)
    e = bpe.encoder(bpe.VOCABULARY)
    for _, t in TEXTS:
        assert t is None or (e.encode(t) == theirs.encode_ordinary(t) and e.decode(e.encode(t)) == t)
    r = random.Random(44)
    for _ in range(3000):  # spaces of all kinds beside words, marks and digits
        t = "".join(r.choice(["a", "Bc", "'s", "12", "é", "\u3000", ".", "!?", " ", "  ", "   ", "\n", "\t", "\u00a0", "\x1c", "\r\n", "'"]) for _ in range(r.randint(0, 9)))
        assert e.encode(t) == theirs.encode_ordinary(t) and e.decode(e.encode(t)) == t, repr(t)
    assert not e.lossy
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.filter("doc_id IN (4, 6, 7)"))).collect()}
    assert back == {4: TEXTS[4][1], 6: "", 7: None} and bpe.encode(empty).count() == 0


def greedy(word, vocab):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_token_counts(docs, empty):
    r = random.Random(4)
    vocab = {("##" if r.random() < 0.6 else "") + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)}
    a = token_counts.Automaton(sorted(vocab))
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert a.count(w) == greedy(w, vocab), w
    got = {x.doc_id: x.n_pieces for x in token_counts.token_counts(docs).filter("doc_id IN (6, 7, 8)").collect()}
    assert got == {6: 0, 7: None, 8: 0} and token_counts.token_counts(empty).count() == 0


def test_urls(spark):
    table = url_filter.labelled_urls()
    train = [x for k, x in enumerate(table) if k % 4]
    held = [x for k, x in enumerate(table) if not k % 4]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)] + [(None, None), (1000, ""), (1001, "x" * 50_000)], "page_id long, url string")
    got = url_filter.score(pages, train).collect()
    assert len(got) == len(held) + 3
    right = sum(r.unwanted == bool(held[r.page_id][1]) for r in got if r.page_id is not None and r.page_id < 1000)
    assert right >= 0.9 * len(held)
    assert [r.score for r in got if r.page_id is None] == [None]


def test_known_addresses_held_out():
    import numpy as np

    known = [(f"https://{u}", y) for us, y in ((url_filter.KNOWN_UNWANTED, 1), (url_filter.KNOWN_WANTED, 0)) for u in us]
    rest, right = [x for x in url_filter.labelled_urls() if x not in set(known)], 0
    for fold in range(4):
        held = known[fold::4]
        w, bias = url_filter.train(rest + [x for k, x in enumerate(known) if k % 4 != fold])
        right += int(((url_filter.logits(w, bias, *url_filter.features([u for u, _ in held])) >= 0) == np.array([y for _, y in held], bool)).sum())
    assert right >= 0.8 * len(known)


def test_urls_of_hard_rows(spark):
    schema = "page_id long, url string, score string, unwanted int, URL_ string"
    rows = [(1, "http://casino-royal.example.com/", "x", 1, "y"), (1, "http://casino-royal.example.com/", "x", 1, "y"), (None, "HTTP://UPPER.example.org/Ü?q#f", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    got = url_filter.score(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and [r.unwanted for r in got if r.page_id == 1] == [True, True] and [r.score for r in got if r.page_id == 2] == [None]
    assert url_filter.score(spark.createDataFrame([], schema)).count() == 0 and url_filter.score(spark.createDataFrame(rows, schema), []).filter("score <> 0.5").count() == 0


def test_urls_that_only_their_path_marks(spark):
    bad = ["/casino/free-spins", "/de/casino-royal/44", "/fr/payday-loan.html", "/torrent/crack", "/en/news/poker-king.html"]
    good = ["/science/museum", "/fr/weather-news", "/recipes/12", "/fr/2931", "/de/12", "/en/7", "/es/41?page=2", "/page/9", "/4/index.html"]
    urls = [f"http://quiet.example.org{p}" for p in bad + good] + [f"http://www.casino-royal.example.com/{c}/2239" for c in ("en", "fr", "de", "es")]
    got = url_filter.score(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert [r.unwanted for r in sorted(got, key=lambda r: r.page_id)] == [True] * len(bad) + [False] * len(good) + [True] * 4


def test_pipeline_keeps_its_contract(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf)
    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    assert out.filter(~F.col("round_trip")).count() == 0 and 0 < out.count() < docs.count()


def test_pipeline_stages_take_hard_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    for rows in (docs, empty):
        kept = rows
        for k, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, kept, sf)
            if k < len(p.STAGES) - 1:
                assert out.columns == rows.columns
                out.write.parquet(str(tmp_path / f"{rows is docs}-{k}"))
                out = spark.read.parquet(str(tmp_path / f"{rows is docs}-{k}"))
                assert out.count() <= kept.count()
            kept = out
        assert kept.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and (rows is docs or kept.count() == 0)
        assert kept.filter("NOT round_trip").count() == 0


def test_quality_rules_against_plain_evaluation(spark, docs):
    r = random.Random(8)
    rows = [(k, (prose(r.randint(1, 60), k) + r.choice([".", "!!", " ### $$", " ABC 123\n\n"])) * r.randint(1, 3)) for k in range(60)] + [(60, ""), (61, None), (62, "\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    stats = quality.statistics(F.col("text"))
    x = {row["doc_id"]: row for row in d.select("doc_id", *[c.alias(s) for s, c in stats.items()]).collect()}
    for i, t in rows:
        t, words = t or "", (t or "").split()
        lines = [v for v in t.split("\n") if v]
        assert x[i]["n_words"] == len(words) and x[i]["distinct_share"] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert x[i]["upper_share"] == pytest.approx(sum(c.isupper() for c in t) / max(1, len(t))) and x[i]["distinct_line_share"] == pytest.approx(len(set(lines)) / max(1, len(lines)))
        assert x[i]["symbol_share"] == pytest.approx(sum(c in quality.SYMBOLS for c in t) / max(1, len(t))) and x[i]["stop_share"] == pytest.approx(sum(c in ".?;:" for c in t) / max(1, len(t)))
    model = quality.train(d, spark.createDataFrame([(k, int("###" not in (t or ""))) for k, t in rows], "doc_id long, quality int"))
    assert model.rules
    for row in quality.score(d, model).collect():
        logit = model.bias + sum(rule.weight for rule in model.rules if all((x[row.doc_id][s] > v) == up for s, up, v in rule.tests))
        assert row.score == pytest.approx(1 / (1 + 2.718281828459045**-logit), abs=2e-6) and row["keep"] == (logit >= 0)


def test_quality_of_odd_labels(spark):
    d = spark.createDataFrame([(k, prose(30, k)) for k in range(20)], "doc_id long, text string")
    for labels in ([], [(1, 1), (1, 1)], [(1, 0)], [(1, 0), (1, 1), (2, None), (None, 1), (500, 0)]):
        m = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert quality.score(d, m).count() == 20


def test_ngram_of_short_texts():
    from lumenpair.llm import _text as text

    gram, off, _ = text.ngrams(*text.hashed(pa.array(["a b", "a b c", None, "", "a b"])), 3)
    assert off.tolist() == [0, 1, 2, 2, 2, 3] and gram[0] == gram[2] != gram[1]


def plain_kneser_ney(train, left_types, words):
    """(toxic, ordinary) mean log-likelihood of words, from dictionaries. train: {text: class}, each text once."""
    import math

    docs = [(t.split(), c) for t, c in train.items()]
    bigrams = lambda w: list(zip(["<s>", *w[:-1]], w))

    def table(items, evidence):
        n = {}
        for w, c in docs:
            for x in set(items(w)):
                n.setdefault(x, [0, 0])[c] += 1
        share = [sum(v[c] for v in n.values()) for c in (0, 1)]
        share = [x / sum(share) for x in share]
        own = {}
        for x, v in n.items():
            t = sum(v)
            z2 = (v[1] - t * share[1]) ** 2 / (t * share[0] * share[1])
            keep = max(0, 1 - evidence / z2) if z2 else 0
            own[x] = [t * share[c] + (v[c] - t * share[c]) * keep for c in (0, 1)]
        return n, own

    n1, own1 = table(list, toxicity.EVIDENCE)
    n2, own2 = table(bigrams, toxicity.PAIR_EVIDENCE)
    ones, twos = (sum(sum(v) == k for v in n2.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
    known = {w for t in train for w in t.split()}
    every = sum(left_types.values()) + 0.5 * (len(known) + 1)
    out = []
    for c in (1, 0):
        mass = sum(v[c] for v in own1.values())
        single = {w: own1[w][c] * (1 - toxicity.BACKOFF / sum(n1[w])) / mass for w in own1}
        spare = 1 - sum(single.values())
        logs = []
        for a, b in bigrams([w if w in known else "<s>" for w in words]):
            lower = single.get(b, 0) + spare * (left_types.get(b, 0) + 0.5) / every
            after = {x: v[c] for x, v in own2.items() if x[0] == a}
            total = sum(after.values())
            kept = {x: v * (1 - d / sum(n2[x])) for x, v in after.items()}
            logs.append(math.log((kept.get((a, b), 0) + (total - sum(kept.values())) * lower) / total if total else lower))
        out.append(sum(logs) / len(logs))
    return out


def test_toxicity_against_plain_counts(spark):
    r, pool = random.Random(77), [f"w{k}" for k in range(30)]
    line = lambda bad: " ".join(r.choice(pool + ["idiot"] * (12 * bad)) for _ in range(r.randint(1, 12)))
    train = {line(k % 2): k % 2 for k in range(160)}
    model = toxicity.fit(list(train), [*train.values()])
    rows = [(k, line(k % 2)) for k in range(40)] + [(99, "new words idiot new")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = toxicity.continuations(d, model)
    known, types = {w for t in train for w in t.split()}, {}
    for _, t in rows:
        w = [x if x in known else "<s>" for x in t.split()]
        for pair in set(zip(["<s>", *w[:-1]], w)):
            types.setdefault(pair[1], set()).add(pair[0])
    types = {w: len(x) for w, x in types.items()}
    assert left.sum() == sum(types.values())
    model.shared = (left + 0.5) / (left.sum() + 0.5 * len(left))
    text = dict(rows)
    for x in toxicity.score(d, model).collect():
        assert (x.toxic_ll, x.ordinary_ll) == pytest.approx(plain_kneser_ney(train, types, text[x.doc_id].split()), abs=1e-5)


def test_toxicity_of_odd_labels(spark, empty):
    rows = [(k, prose(30, k)) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)], [(1, 0)], [(1, 0), (1, 1), (1, None), (None, 1), (500, 0)]):
        m = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score(d, m).count() == 40
