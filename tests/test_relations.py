import json

from pyspark.sql import functions as F

from lumenpair.operators import grid, lookup, sequence
from lumenpair.sources import requests


def test_longest_prefix(spark):
    d = spark.createDataFrame([("a", 1), ("a b", 2), ("a b", 3)], "k string, v int")
    r = spark.createDataFrame([(1, "A B c"), (2, "a x"), (3, "z"), (4, None), (5, "  ")], "id int, name string")
    got = lookup.longest_prefix(r, "name", d, "k").select("id", "v").collect()
    assert sorted((x.id, x.v or 0) for x in got) == [(1, 2), (1, 3), (2, 1), (3, 0), (4, 0), (5, 0)]


def test_elided(spark):
    d = spark.createDataFrame([("metoprolol",), ("lisinoprila",), ("lisinoprilb",)], "k string")
    r = spark.createDataFrame([(1, "metoprolo"), (2, "lisinopril"), (3, "short"), (4, None)], "id int, q string")
    assert {x.id: x.resolved for x in lookup.elided(r, "q", d, "k").collect()} == {1: "metoprolol", 2: None, 3: None, 4: None}


def test_first_wins_and_sets(spark):
    r = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("b", 1, None), (None, 0, "q")], "k string, o int, v string")
    assert {x.k: x.v for x in lookup.first_wins(r, "k", "o", "v").collect()} == {"a": "z", "b": None}
    assert {x.k: x["values"] for x in lookup.value_sets(r, "k", "v").collect()} == {"a": ["y", "z"]}


def test_savings(spark):
    rows = [("g", 1, True, 4.0), ("g", 2, False, 3.0), ("g", 3, None, 3.5), ("g", 4, False, 5.0), ("h", 1, True, 0.0), ("h", 2, False, -1.0), ("i", 1, False, 1.0)]
    r = spark.createDataFrame(rows, "g string, row int, p boolean, c double")
    got = grid.savings(r, "g", "row", F.col("p"), "c").collect()
    assert sorted((x.g, x.row, x.tier) for x in got) == [("g", 2, "AboveThreshold"), ("g", 3, "BelowThreshold")]


def test_sort_state_and_best(spark):
    r = spark.createDataFrame([("g", 1, 2.0), ("g", 2, None), ("g", 3, 1.0), ("h", 1, 1.0), ("i", 1, 1.0), ("i", 2, 1.0)], "g string, row int, c double")
    assert {x.g: x.state for x in grid.sort_state(r, "g", ["row"], "c").collect()} == {"g": "NotSorted", "h": "Unknown", "i": "Sorted"}
    best = grid.best_per_class(r, "g", "row", F.lit("Small"), "c").collect()
    assert {x.g: x.row for x in best} == {"g": 3, "h": 1, "i": 1}


def folded(signals):
    shown, pending, streak, out = "", "", 0, []
    for s in signals:
        d, shown, pending, streak = sequence.step(shown, pending, streak, s or "")
        out.append((d, shown))
    return out


def test_debounce_is_the_fold(spark):
    signals = {1: ["", "a", "b", "a", "b", "b", "", "", "c"], 2: ["a", None, "a", "b", "c", "c", "c"], 3: [None]}
    rows = [(u, t, s) for u, ss in signals.items() for t, s in enumerate(ss)]
    got = sequence.debounce(spark.createDataFrame(rows, "u int, t long, s string"), "u", ["t"], "s", "t").collect()
    for u, ss in signals.items():
        assert [(x.decision, x.shown) for x in sorted(got, key=lambda x: x.t) if x.u == u] == folded(ss)
    assert folded(["a", "b", "b"]) == [("Display", "a"), ("Processing", "a"), ("Display", "b")]


def test_debounce_stream(spark, tmp_path):
    from lumenpair.streaming.ticks import debounce_stream

    (tmp_path / "in").mkdir()
    ss = ["a", "b", "a", "b", "b", "", ""]
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps({"u": "k", "t": t, "s": s}) for t, s in enumerate(ss)))
    q = debounce_stream(spark.readStream.schema("u string, t long, s string").json(str(tmp_path / "in")), "u", "s", "t")
    q = q.writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(x.decision, x.shown) for x in spark.table("shown").orderBy("t").collect()] == folded(ss)


def test_requests(spark):
    lines = ['{"entered": {}, "source": {}}', '{"entered": {}, "ocr": []}', '{"source": {}}', '{"entered": {}}', "{oops", "[1]", " ", None]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(requests.request_error(F.col("l")).alias("e")).collect()
    assert [x.e for x in got] == [None, None, "missing_entered", "missing_source", "invalid_json", "invalid_json", None, None]


def test_leaks(spark):
    leak = lambda v, t: spark.sql("SELECT 1").select(requests.leaks_fragment(F.lit(v).cast("string"), F.lit(t).cast("string")).alias("x")).first()["x"]
    assert [leak("Jordan", "it was JOR-DAN"), leak("Ann", "Ann"), leak(None, "x"), leak("Jordan", None), leak("Jordan", "jord")] == [True, False, False, False, False]


def test_leaks_cut_each_text_once(spark):
    rows = [("Jordan é Smith", "x" * 3000 + " Dan-S"), ("ab" * 1000, "ba" * 2000), ("ab" * 1000, "a b x" * 2000), ("ABCD", "abcd"), (None, None)]
    df = spark.createDataFrame(rows, "v string, t string").select(requests.leaks_fragment(F.col("v"), F.col("t")).alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "exists(" not in plan  # there each run of the value wrote the whole text anew
    assert [r.x for r in df.collect()] == [False, True, False, False, False]


def test_names_meet_kinds_of_concepts(spark, monkeypatch):
    """Concepts of a name that are alike go as one: a name's rows don't grow with the makers of a product."""
    from lumenpair.operators import products

    makers = [(k, "Foo", "foo", "5mg" if k < 40 else "9mg", "tablet") for k in range(60)]
    concepts = spark.createDataFrame(makers, "concept_id int, display string, ingredient string, strength string, form string")
    index = spark.createDataFrame([("foo", k) for k in range(61)] + [("foo bar", 99)], "name_key string, concept_id int")  # 60 and 99 are of no concept
    seen, real = [], products.narrowed
    monkeypatch.setattr(products, "narrowed", lambda found, *a: seen.append(found.count()) or real(found, *a))
    names = spark.createDataFrame([("foo 5 mg",), ("foo",), ("foo bar 5 mg",)], "name string")
    got = {r.name: r.concept for r in products.by_names(names, concepts, index).collect()}
    assert seen == [4] and {k: v and v.strength for k, v in got.items()} == {"foo 5 mg": "5mg"}
