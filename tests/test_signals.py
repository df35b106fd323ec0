"""Trees, signals and sinks: batch forms against their steps, and streams against batch forms."""

import json
import os
import random

from pyspark.sql import functions as F

from lumenpair.operators import layout, lookup, sequence, signals, tree
from lumenpair.sources import datasets, requests, sinks
from lumenpair.streaming.ticks import changed_stream, hover_stream


def samples(n=60):
    r = random.Random(6)
    return [(u, t, r.random() < 0.85, r.randint(0, 1), r.randint(30, 200), r.random() < 0.3, r.random() < 0.1) for u in range(3) for t in range(n)]


def stepped(rows):
    out, state, down = {}, (None, 0, False), {}
    states = {}
    for u, t, over, spot, ms, press, dialog in rows:
        click = over and press and not down.get(u, False) and not dialog
        out[u, t], states[u] = signals.hover_step(states.get(u, state), over, spot, ms, click)
        down[u] = press
    return out


SAMPLE = "u int, t long, over boolean, spot long, elapsed long, down boolean, dialog boolean"


def test_dwelling_is_the_step(spark):
    rows = samples()
    d = spark.createDataFrame(rows, SAMPLE)
    got = signals.dwell(signals.clicks(d, "u", ["t"]), "u", ["t"]).collect()
    assert {(x.u, x.t): x.action for x in got} == stepped(rows) and {x.action for x in got} == {"Show", "Hide", "None"}


def run_stream(spark, tmp_path, rows, schema, make, name):
    (tmp_path / name).mkdir()
    names = [x.split()[0] for x in schema.split(", ")]
    for k in range(2):  # two files, two batches
        half = [r for r in rows if (r[1] >= 30) == bool(k)]
        (tmp_path / name / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in half))
        os.utime(tmp_path / name / f"{k}.json", (1_700_000_000 + k,) * 2)  # files are read in the order of their times
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name)))
    q = q.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def test_streams_are_their_batch_forms(spark, tmp_path):
    rows = samples()
    got = run_stream(spark, tmp_path, rows, SAMPLE, lambda s: hover_stream(s, "u", "t"), "hovers")
    assert {(x.u, x.t): x.action for x in got} == stepped(rows)
    r = random.Random(4)
    rows = [(u, t, r.choice(["a", "b", None])) for u in range(2) for t in range(60)]
    schema = "u int, t long, v string"
    got = run_stream(spark, tmp_path, rows, schema, lambda s: changed_stream(s, "u", "t", "v"), "changes")
    want = sequence.changes(spark.createDataFrame(rows, schema), "u", ["t"], "v").collect()
    assert sorted((x.u, x.t) for x in got) == sorted((x.u, x.t) for x in want)


def test_second_reads_and_kept_values(spark):
    rows = [(1, 1, "", False, "x"), (1, 2, "a", False, "x"), (1, 3, " ", False, "y"), (1, 4, "b", True, "z"), (1, 5, None, False, None)]
    d = spark.createDataFrame(rows, "k int, t int, one string, threw boolean, two string")
    assert [x.read for x in signals.retried(d, "k", ["t"], "one", "threw", "two").orderBy("t").collect()] == ["", "a", "y", "z", None]
    d = spark.createDataFrame([(1, 1, "w", None), (1, 2, "w", "a"), (1, 3, "w", "b"), (1, 4, None, None), (1, 5, "w", "c")], "k int, t int, win string, v string")
    assert [x.kept for x in signals.cached(d, "k", ["t"], "win", "v").orderBy("t").collect()] == [None, "a", "a", None, "c"]


NODES = [(1, 0, None, 0, "Root"), (1, 1, 0, 0, "Body"), (1, 2, 0, 1, "Body"), (1, 3, 1, 0, "Name: "), (1, 4, 1, 1, "Name: late"), (1, 5, 2, 0, "Deep"), (1, 6, 5, 0, "Total fills: 4 (incl.)"), (1, 7, 0, 2, "Total fills: 9"), (2, 0, None, 0, "Root")]


def test_trees(spark):
    n = spark.createDataFrame(NODES, "doc int, node int, parent int, ordinal int, name string")
    roots = n.filter("parent IS NULL")
    assert [(x.doc, x.node) for x in tree.child(n, roots, "Body").collect()] == [(1, 1)]
    assert [(x.parent, x.value) for x in tree.leaf(n, n.filter("node = 1"), "Name").collect()] == [(1, None)]
    assert [(x.doc, x.node) for x in tree.first_descendant(n, roots, F.col("name").startswith("Total fills")).collect()] == [(1, 6)]
    assert tree.first_descendant(n.limit(0), roots, F.lit(True)).count() == 0
    ask = lambda c: spark.sql("SELECT 1").select(c.alias("v")).first()["v"]
    none = F.lit(None).cast("string")
    assert ask(tree.refills(F.lit("Refills: 2"), F.lit("Total fills: 4")))["value"] == "2" and tuple(ask(tree.refills(none, F.lit("Total fills: 4 (incl. first)")))) == ("4", True) and ask(tree.refills(none, none)) is None
    assert [ask(tree.last_first_middle(*[F.lit(x).cast("string") for x in v])) for v in (("Jo", "Q", "Ray"), ("Jo", " ", None), (None, None, " Ray "), (None, None, None))] == ["Ray, Jo Q", "Jo", "Ray", None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    queue = str(tmp_path / "queue")
    assert sinks.append(rows, queue) and sinks.append(rows.limit(1), queue)
    (tmp_path / "queue" / "part-broken.json").write_text('{"k": 9, "v": "z"}\n{oops\n')
    assert sorted(x.k for x in sinks.queued(spark, queue, "k int, v string").filter("k IS NOT NULL").collect()) == [1, 1, 2, 3, 9]
    assert not sinks.append(rows, "/proc/nothing/here")
    sinks.write_dataset(rows, str(tmp_path / "gz"))
    assert list((tmp_path / "gz").glob("*.json.gz")) and spark.read.json(str(tmp_path / "gz")).count() == 3

    def post(body):
        if '"k":3' in body:
            raise OSError("down")
        return '"k":2' not in body

    out = sinks.submit(rows, post, "k", str(tmp_path / "late"))
    assert {x.k: x.outcome for x in out.collect()} == {1: "success", 2: "queued", 3: "queued"}
    assert sorted(x.k for x in sinks.queued(spark, str(tmp_path / "late"), "k int, v string").collect()) == [2, 3]
    lines = spark.createDataFrame([(1, t, x) for t, x in enumerate(["aa", "aa", "bb", "cc", "cc", "dd"])], "k int, t int, line string")
    assert [x.line for x in sinks.logged(lines, "k", ["t"], "line", 6).orderBy("t").collect()] == ["cc", "dd"]


def test_datasets(spark, tmp_path):
    import gzip

    (tmp_path / "d.json.gz").write_bytes(gzip.compress(json.dumps({"concepts": [{"displayName": "X", "ingredient": "x", "strength": "1mg", "doseForm": "tablet"}], "ndcIndex": {"1": 0}, "nameIndex": {"x": [0]}, "formsByIngredient": {"x": ["tablet"]}}).encode()))
    got = datasets.dataset_or_empty(spark, str(tmp_path / "d.json.gz"))
    assert [tuple(x) for x in got["concepts"].collect()] == [(0, "X", "x", "1mg", "tablet")] and [tuple(x) for x in got["index"].collect()] == [("x", 0)] and got["codes"].count() == got["forms"].count() == 1
    assert datasets.dataset_or_empty(spark, str(tmp_path / "none.json.gz"))["concepts"].count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"product_ndc": "1-2", "generic_name": "A", "active_ingredients": [{"name": "B", "strength": "2 MG/1"}, {"name": "a", "strength": "1 MG"}], "dosage_form": "TABLET", "packaging": [{"package_ndc": "1234-5678-90"}, {"package_ndc": "x"}]}, {"product_ndc": "3"}]}, indent=1))
    products = datasets.product_list(requests.document(spark, str(tmp_path / "p.json"), f"results array<struct<{datasets.PRODUCT.replace(' array', ': array').replace(' string', ': string')}>>"))
    built = datasets.concepts(products)
    assert [tuple(x) for x in built.collect()] == [(0, "A", "a;b", "1mg;2mg", "tablet")] and [x.ndc11 for x in datasets.codes(products, built).collect()] == ["01234567890"]
    row = datasets.product_counts(products, built).first()
    assert (row.products, row.skipped, row.unread_codes, row.ingredients) == (2, 1, 1, 1)


def test_requests_keep_going(spark):
    lines = spark.createDataFrame([('{"id": "a", "entered": {"sig": "x"}, "source": {"refills": 2}}',), ("{oops",), (" ",)], "line string")
    got = requests.parsed(lines, "line", "struct<sig:string,refills:string>").collect()
    assert [(x.id, x.error, x.source and x.source.refills) for x in got] == [("a", None, "2"), (None, "invalid_json", None), (None, None, None)]


def test_names_within_an_edit_distance(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(150)})

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last if x == y else 1 + min(last, row[j], row[j + 1])
        return row[-1]

    d = spark.createDataFrame([(w,) for w in words] + [(None,)], "n string")
    for most in (1, 3):
        got = {(x.a, x.b): x.distance for x in lookup.near_names(d, "n", most).collect()}
        assert got == {(a, b): far(a, b) for a in words for b in words if a < b and far(a, b) <= most}


def test_aligned_and_merged_boxes(spark):
    rows = [(1, 1, 10.0, 0.0, 5.0, 8.0), (1, 2, 11.5, 12.0, 5.0, 8.0), (1, 3, 13.0, 24.0, 5.0, 8.0), (1, 4, 13.0, 90.0, 5.0, 8.0)]
    d = spark.createDataFrame(rows, "k int, box int, x double, y double, width double, height double")
    assert [(x.box, x.left, x.wide) for x in layout.aligned(d, "k", 2.0, 6.0).orderBy("box").collect()] == [(1, 10.0, 5.0), (2, 10.0, 6.5), (3, 10.0, 8.0), (4, 13.0, 5.0)]
    bars = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 5.0), (1, 0.0, 2.0, 5.0, 5.0), (1, 0.0, 2.0, 11.0, 1.0), (1, 9.0, 2.0, 0.0, 1.0)], "k int, x double, width double, y double, height double")
    assert sorted((b.x, b.top, b.bottom) for b in layout.merged_bars(bars, "k").collect()) == [(0.0, 0.0, 10.0), (0.0, 11.0, 12.0), (9.0, 0.0, 1.0)]
