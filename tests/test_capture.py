"""Records read from captures: layouts of a screen, and each field's own repairs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenpair.operators import capture as C
from lumenpair.operators import layout


def row(y, *tokens):
    return [C.Word(t, 90.0 * k, float(y), 80.0, 18.0) for k, t in enumerate(tokens)]


TOOLS = row(0, "Dispense", "|", "Image", "[1]", "New", "Prescription", "DS:", "30", "Escript", "Workflow/Claims", "Fill", "Audit", "Zoom", "Select")
BLOCK = [["Patient"], ["Address:"], ["DOB"], ["Prescriber"], ["Location:"], ["Phone"], ["Written"], ["NDC"], ["Medication"], ["Quantity"], ["Directions:"], ["Note"], ["Substitutions"]]
VALUES = ["Roe, Pat Q", "12 LAKE ST TROY, NY 121801111", "01/02/1970", "Demo, Dana", "456 MOCK AVE TROY, NY 121802222", "(555) 555-0100", "07/01/2026", "00000000011", "Some Lotion", "30", "TAKE 1 TABLET BY MOUTH DAILY", "See me", "substitution not allowed"]


def test_labels_above_values():
    words = TOOLS + [w for k, t in enumerate(BLOCK) for w in row(100 + 20 * k, *t)] + [w for k, v in enumerate(VALUES) for w in row(360 + 20 * k, *v.split())]
    words.append(C.Word("1234567890", 400.0, 460.0, 90.0, 18.0))
    record, notes = C.read(words)
    assert record["patientName"] == "Roe, Pat Q" and record["patientDOB"] == "01/02/1970" and record["dateWritten"] == "07/01/2026"
    assert record["patientAddress"] == {"street": "12 LAKE ST", "city": "TROY", "state": "NY", "zip": "12180"}
    assert record["prescriber"]["name"] == "Demo, Dana" and record["prescriber"]["npi"] == "1234567890" and record["prescriber"]["address"]["street"] == "456 MOCK AVE"
    assert record["drug"] == {"ndc": "00000000011", "name": "Some Lotion"} and record["quantity"] == "30" and record["sig"] == "TAKE 1 TABLET BY MOUTH DAILY" and record["substitutionsNotAllowed"] is True
    assert {n["field"] for n in notes if n["status"] == "miss"} == {"availableDate", "refills"} and len(notes) == 15
    assert {n["strategy"] for n in notes if n["status"] == "resolved"} == {"block-column", "inline-row", "pattern-anchor"}


def test_values_beside_labels():
    lines = ["Patient: Roe, Jamie", "D0B: 05/06/l985", "Prescriber: Alt, Robin Workflow", "Phone: (555) 222-3333", "Medication: Amoxicillin 500mg", "NDC: 12345-6789-01", "Quantity: 2O EA", "Refills: 3 Directions: TAKE 1", "Substitutions: substitution allowed"]
    words = TOOLS + [w for k, t in enumerate(lines) for w in row(100 + 20 * k, *t.split())] + [C.Word("CAPSULE", 450.0, 240.0, 80.0, 18.0)]
    record, _ = C.read(words)
    assert record["patientName"] == "Roe, Jamie" and record["patientDOB"] == "05/06/1985" and record["prescriber"] == {"name": "Alt, Robin", "phone": "(555) 222-3333"}
    assert record["drug"] == {"ndc": "12345-6789-01", "name": "Amoxicillin 500mg"} and record["quantity"] == "20" and "quantityUnit" not in record
    assert record["refills"] == "3" and record["sig"] == "TAKE 1 CAPSULE" and record["substitutionsNotAllowed"] is False


def test_odd_captures():
    assert C.read([]) == ({}, []) and C.read(row(0, "nothing", "here")) == ({}, [])
    record, notes = C.read(row(0, "Patient:", "123456789") + row(20, "Total", "Fills:", "4") + row(40, "Written:", "13/45/2020") + row(60, "2/3/1984") + row(80, "2/3/2024") + row(100, "5", "(including", "this", "fill)"))
    assert "patientName" not in record and record["refills"] == "4" and record["refillsFromTotalFills"] is True and record["patientDOB"] == "2/3/1984" and record["dateWritten"] == "2/3/2024"
    assert [n["strategy"] for n in notes if n["field"] == "dateWritten"] == ["pattern-anchor-fallback"]
    record, _ = C.read(row(0, "Quantity:", "x") + row(20, "9", "(including", "this", "fill)."))
    assert record == {"refills": "9", "refillsFromTotalFills": True}


@pytest.mark.parametrize("raw, want", [("O7/02/1980", "07/02/1980"), ("07-02-1980", "07/02/1980"), ("7/2/198 0", "7/2/1980"), ("07/021980", "07/02/1980"), ("0702/1980", "07/02/1980"), ("07/02/1980", "07/02/1980"), ("7/2/1980", None), ("x", None), ("07l02I1980", "07/02/1980")])
def test_repaired_dates(spark, raw, want):
    from lumenpair.functions.rules import repaired_date

    got = C.repaired(raw, True)
    assert got == want == spark.createDataFrame([(raw,)], "v string").select(repaired_date(F.col("v"), True).alias("v")).first()["v"]


def test_text_parts():
    assert [C.quantity_of(x) for x in ("3O tablets", "about 5 EA", "x", "")] == [("30", "tablets"), ("5", None), (None, None), (None, None)]
    assert [C.refills_of(x) for x in ("l2 left", "none", "", "O")] == ["12", None, None, "0"] and [C.forbids(x) for x in ("DAW", "allowed", "1", "0", "maybe")] == [True, False, True, False, None]
    assert C.address_of("1 Oak St. Ely") == {"street": "1 Oak St.", "city": "Ely"} and C.address_of("1 Oak Ely NV 89301 5551234") == {"street": "1 Oak", "city": "Ely", "state": "NV", "zip": "89301"} and C.address_of("Oak") == {"street": "Oak"}
    assert [C.date_of(x) for x in ("2024-2-29", "2023-2-29", "2/3/49", "Jul 2, 2026", "Foo 2, 2026", "13/1/2020")] == [True, False, True, True, False, False]


def test_records_and_lines_of_a_table(spark):
    rows = [(k, j, w.text, w.x, w.y, w.w, w.h) for k in range(3) for j, w in enumerate(row(0, "Patient:", "Roe,", f"J{k}") + row(20, "Refills:", "2"))] + [(9, 0, None, 0.0, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows, "capture int, word int, text string, x double, y double, w double, h double")
    got = {r.capture: r.record for r in C.records(words).collect()}
    assert {k: v.patientName for k, v in got.items()} == {0: "Roe, J0", 1: "Roe, J1", 2: "Roe, J2", 9: None} and got[0].refills == "2"
    assert C.records(words.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_read_by_batches(spark):
    """Many captures a call of Python: a call for each takes milliseconds of its own."""
    lines = [["Patient:", "Roe,", "Jo"], ["Quantity:", "2O", "EA"], ["Refills:", "l"], ["Directions:", "TAKE", "1"]]
    rows = [(k, j, w.text, w.x, w.y, w.w, w.h) for k in range(40) for j, w in enumerate(w for n in range(k % 5) for w in row(20 * n, *lines[n]))]
    odd = [(50, 0, "Patient:", None, 0.0, 1.0, 1.0), (50, 1, None, 90.0, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows[::-1] + odd, "capture int, word int, text string, x double, y double, w double, h double")
    got = C.records(words)
    assert "ArrowEvalPython" in plan_of(got) and "FlatMapGroups" not in plan_of(got)
    found = {r.capture: r for r in got.collect()}
    assert set(found) == {50} | {k for k in range(40) if k % 5}
    for k in set(found) - {50}:
        record, notes = C.read([C.Word(*w[2:]) for w in rows if w[0] == k])
        assert {n: v for n, v in found[k].record.asDict(recursive=True).items() if v is not None} == record
        assert [(n.field, n.status, n.reason, n.value and n.value.text) for n in found[k].diagnostics] == [(n["field"], n["status"], n.get("reason"), n.get("value", {}).get("text")) for n in notes]


def test_lines_by_running_means(spark):
    r = random.Random(2)
    rows = [(k, j, r.choice(["a", "b", " "]), float(r.randint(0, 300)), float(r.randint(0, 60)), 10.0, float(r.randint(0, 12))) for k in range(8) for j in range(25)]
    words = spark.createDataFrame(rows, "capture int, word int, text string, x double, y double, w double, h double")
    got = {(x.capture, x.word): x.line for x in layout.lines_by_mean(words).collect()}
    for k in range(8):
        some = [(j, C.Word(t, x, y, w, h)) for c, j, t, x, y, w, h in rows if c == k and t.strip()]
        place = {id(w): n for n, line in enumerate(C.lines_of([w for _, w in some])) for w in line}
        assert {j: place[id(w)] for j, w in some} == {j: n for (c, j), n in got.items() if c == k}


def test_a_table_is_read_in_one_pass(spark):
    """Header, columns and cells of many captures without a join: the words are scanned, and put together by capture, once."""
    titles = ["Supplier", "Rebate", "Cost/Unit"]
    rows = []
    for k in range(6):
        rows += [(k, 0, "Offers", 10.0, 0.0, 50.0, 12.0)] + [(k, 1 + i, "Suppleir" if k == 5 and i == 0 else t, [10.0, 200.0, 250.0][i], 20.0, [60.0, 45.0, 60.0][i], 12.0) for i, t in enumerate(titles)]
        rows += [(k, 10 + 2 * n + i, [f"s{n}", f"{n}.50"][i], [10.0, 205.0][i], 40.0 + 20 * n, 60.0, 12.0) for n in range(k) for i in range(2)]
    rows += [(8, 0, "nothing", 0.0, 0.0, 10.0, 10.0), (9, 0, " ", 0.0, 0.0, 10.0, 10.0)]
    words = spark.createDataFrame(rows[::-1], "capture int, word int, text string, x double, y double, w double, h double")
    table = layout.table_of(words, [layout.SUPPLIER, layout.COST])
    cells = layout.named_cells(table, {"supplier": layout.SUPPLIER, "cost": layout.COST, "size": layout.SIZE})
    assert "Join" not in plan_of(cells) and plan_of(cells).count("Exchange") <= 2
    heads = {r.capture: r.head for r in table.select("capture", "head").collect()}
    assert {k: (h.start, h.span, h.score, h.top, h.bottom) for k, h in heads.items()} == {k: (1, 1, 2, 20.0, 32.0) for k in range(5)} | {5: (0, 2, 1, 0.0, 32.0)}
    got = {(r.capture, r.line): (r.supplier, r.cost, r.size) for r in cells.collect()}
    assert got == {(k, n): (None if k == 5 else f"s{n}", f"{n}.50", None) for k in range(6) for n in range(k)}
    assert layout.resolved(table, "rebate  COST/unit").filter("column = 1 AND label = 'Rebate Cost/Unit'").count() == 6
