"""Pairs end to end: fifteen whole cases, and each comparator's own cases."""

import json

import pytest
from pyspark.sql import functions as F

from lumenpair.functions import products as P
from lumenpair.operators import fields, products, verdicts

MAKERS = {  # code of the maker and product: (concept number, brand or nothing, ingredient, strength, form)
    "00071015523": (1, "Zestril", "lisinopril", "10mg", "tablet"), "00071015590": (1, "Zestril", "lisinopril", "10mg", "tablet"), "00093715601": (2, "", "lisinopril", "10mg", "tablet"), "00093715801": (8, "", "metformin", "500mg", "tablet"),
}
NAMED = {"Synthroid 50mcg tablet": (5, "Synthroid", "levothyroxine", "50mcg", "tablet"), "Amlodipine 5mg tablet": (12, "", "amlodipine", "5mg", "tablet")}
JOHN = {"patientName": "John Smith", "patientDOB": "07/02/1980", "patientAddress": {"street": "123 N Main St", "city": "Springfield", "state": "IL", "zip": "62704"}, "dateWritten": "07/01/2026", "sig": "take 1 tab po bid", "quantity": 60, "quantityUnit": "tab", "refills": 2}
JANE = {"prescriber": {"name": "Dr. Jane Doe", "npi": "1234567890", "phone": "(217) 555-0100", "address": {"street": "500 Doctor Way", "city": "Springfield", "state": "IL", "zip": "62704"}}}
A, B, C = ({"ndc": f"000{x}"} for x in ("71015523", "71015590", "93715601"))
elm = lambda n: {"patientAddress": {"street": f"789 Elm St Apt {n}", "city": "Metropolis", "state": "NY", "zip": "10001"}}
CASES = {  # name: (source, entered, what is not yellow not_provided)
    "all green": (JOHN | JANE | {"drug": A}, JOHN | JANE | {"drug": A}, dict.fromkeys(verdicts.FIELDS, "green exact_match") | {"daw": "", "availableDate": "", "sig": "green verbatim_match"}),
    "another maker": ({"patientName": "Ann Lee", "drug": A}, {"patientName": "Ann Lee", "drug": C}, {"patientName": "green exact_match", "drug": "yellow generic_substitution"}),
    "a third of it": (
        {"patientName": "Carlos Ramirez", "drug": {"ndc": "00093715801"}, "sig": "take 1 tab po bid", "quantity": 90, "quantityUnit": "tab", "refills": 1}, {"patientName": "Carlos Ramirez", "drug": {"ndc": "00093715801"}, "sig": "take 1 tab po bid", "quantity": 30, "quantityUnit": "tab", "refills": 1},
        {"patientName": "green exact_match", "quantity": "yellow quantity_adjusted", "refills": "green exact_match", "drug": "green exact_match", "sig": "green verbatim_match"},
    ),
    "nickname": ({"patientName": "William Turner", "patientDOB": "03/03/1990"}, {"patientName": "Bill Turner", "patientDOB": "03/03/1990"}, {"patientName": "yellow nickname_match", "patientDOB": "green exact_match"}),
    "order": ({"patientName": "Maria Gomez"}, {"patientName": "Gomez, Maria"}, {"patientName": "green exact_match"}),
    "birthday": ({"patientName": "Sarah Lee", "patientDOB": "05/05/1985"}, {"patientName": "Sarah Lee", "patientDOB": "05/05/1986"}, {"patientName": "green exact_match", "patientDOB": "red date_mismatch"}),
    "quantity": ({"drug": A, "sig": "take 1 tab po bid", "quantity": 60, "quantityUnit": "tab"}, {"drug": A, "sig": "take 1 tab po bid", "quantity": 47, "quantityUnit": "tab"}, {"drug": "green exact_match", "sig": "green verbatim_match", "quantity": "red quantity_mismatch"}),
    "written out": ({"sig": "take 1 tablet by mouth twice daily"}, {"sig": "take 1 tab po bid"}, {"sig": "green exact_match"}),
    "vague": ({"sig": "as directed"}, {"sig": "use as directed by doctor"}, {"sig": "yellow sig_ambiguous"}),
    "at night": ({"sig": "Take 1 tablet by mouth every night at bedtime"}, {"sig": "TAKE ONE TABLET BY MOUTH EVERY NIGHT AT BEDTIME."}, {"sig": "green exact_match"}),
    "prescriber": ({"prescriber": {"name": "Jonathan Reyes", "npi": "1720345678"}}, {"prescriber": {"name": "Jon Reyes", "npi": "1720345678"}}, {"prescriberName": "yellow nickname_match", "prescriberNpi": "green exact_match"}),
    "package": ({"drug": A}, {"drug": B}, {"drug": "yellow pack_size"}),
    "strength": ({"drug": {"name": "Synthroid 50mcg tablet"}}, {"drug": {"name": "Amlodipine 5mg tablet"}}, {"drug": "red drug_mismatch"}),
    "unit": (elm(2), elm(3), {"patientAddress": "yellow unit_differs"}),
    "empty source": ({"patientName": "Ava Brooks"}, JOHN | JANE | {"patientName": "Ava Brooks", "drug": A}, {"patientName": "green exact_match"}),
    "available": ({"dateWritten": "07/01/2026", "availableDate": "7/3/26"}, {"dateWritten": "2026-07-03"}, {"dateWritten": "green available_date_match", "availableDate": "green available_date_match"}),
}


def dimension(spark, key, rows):
    flat = spark.createDataFrame([(k, f"FX{c[0]:04}", *c[2:], f"{c[1] or c[2]} {c[3]} {c[4]}") for k, c in rows.items()], f"{key} string, id string, ingredient string, strength string, form string, name_ string")
    return flat.select(key, F.struct("id", "ingredient", "strength", "form", F.col("name_").alias("name")).alias("concept"))


@pytest.fixture(scope="module")
def results(spark):
    rows = [(n, json.dumps(s), json.dumps(e)) for n, (s, e, _) in CASES.items()]
    d = spark.createDataFrame(rows, "name string, s string, e string").select("name", F.from_json("s", verdicts.RECORD).alias("source"), F.from_json("e", verdicts.RECORD).alias("entered"))
    out = verdicts.verify(d, dimension(spark, "ndc11", MAKERS), dimension(spark, "name", NAMED), skip=F.col("name") == "nobody")
    out = out.withColumn("ordered", verdicts.in_order(F.col("verdicts"))).withColumn("complete", verdicts.complete(F.col("verdicts"), F.col("source.availableDate")))
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_whole_pairs(results, name):
    r, want = results[name], CASES[name][2]
    got = {v.field: f"{v.status} {v.reason_code}" for v in r.verdicts}
    have = [f for f in verdicts.FIELDS if f != "availableDate" or CASES[name][0].get("availableDate")]
    assert got == {f: want.get(f) or "yellow not_provided" for f in have}
    assert r.ordered and r.complete and r.summary.total == len(have) and r.summary.green == sum(v.startswith("green") for v in got.values())
    assert all(v.explanation and "{" not in v.explanation for v in r.verdicts)


def test_what_is_shown(results):
    shown = {v.field: (v.source_value, v.entered_value) for v in results["unit"].verdicts}
    assert shown["patientAddress"] == ("789 Elm St Apt 2, Metropolis, NY 10001", "789 Elm St Apt 3, Metropolis, NY 10001") and shown["daw"] == (None, None)


def ask(spark, comparison, rows, schema):
    """Reason codes of rows of inputs."""
    names = [x.split()[0] for x in schema.split(", ")]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    out = fields.compared(d, v=comparison(*map(F.col, names))).orderBy("_k").select("v.*").collect()
    return [f"{r.status} {r.reason_code}" for r in out]


SIGS = [
    ("1 tab qod", "1 tab qd", "red sig_mismatch"), ("1 tab q5h", "1 tab qd", "yellow sig_ambiguous"), ("take 1 tab po bid", "take 1 tab po", "yellow sig_ambiguous"), ("iv tabs po qd", "4 tablets by mouth daily", "green exact_match"),
    ("1 iv bid", "1 po bid", "red sig_mismatch"), ("take 1 tab po bid prn", "take 1 tab po bid", "red sig_mismatch"), ("take 1 tab po bid x 7 days", "take 1 tab po bid for 7 days", "green exact_match"), ("1 tab qd q72h", "1 tab qd", "yellow sig_ambiguous"),
    ("1 cap po qam", "1 cap po every morning", "green exact_match"), ("1 cap po morning and evening", "1 cap po qam", "red sig_mismatch"), ("1 cap po bid with food", "1 cap po bid", "yellow sig_ambiguous"), ("", "x", "yellow not_provided"), ("\t\n", "x", "yellow not_provided"),
    ("APPLY to skin.", "apply  to SKIN", "green verbatim_match"), ("2 puffs p.o. b.i.d.", "2 puff po bid", "green exact_match"), ("1 tab po ac bid", "1 tab po pc bid", "red sig_mismatch"), ("1 tab po at lunch time", "1 tab po with lunch", "green exact_match"),
]


def test_directions(spark):
    assert ask(spark, fields.directions, [x[:2] for x in SIGS], "a string, b string") == [x[2] for x in SIGS]


PLACES = [
    (("12 Oak Street", None, "Troy", "NY", "12180"), ("12 Oak St.", None, "TROY", "ny", "12180-4411"), "green exact_match"),
    (("12 Oak St Apt 4", None, "Troy", "NY", "12180"), ("12 Oak St", "#4", "Troy", "NY", "12180"), "yellow unit_differs"),
    (("12 Oak StApt4", None, "Troy", "NY", "12180"), ("12 Oak St", "Apt 4", "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak St Unit lO", None, "Troy", "NY", "12180"), ("12 Oak St Unit 10", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak St, Troy NY 12180", None, None, None, None), ("12 Oak St", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak St Troy, NY 12180", None, None, None, None), ("12 Oak St", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak St", None, "Troy", None, None), ("12 Oak St", None, "Troy", "NY", "12180"), "green exact_match_partial_source"),
    (("12 Oak St", None, None, None, None), ("12 Oak St", None, "Troy", "NY", "12180"), "green exact_match_partial_source"),
    (("12 Maplewood Ave", None, "Troy", "NY", "12180"), ("12 Mapleword Avenue", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak St", None, "Troy", "NY", "12180"), ("13 Oak St", None, "Troy", "NY", "12180"), "yellow address_differs"),
    (("12 Oak Boulev", None, "Troy", "NY", "12180"), ("12 Oak Blvd", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 Oak q", None, "Troy", "NY", "12180"), ("12 Oak Rd", None, "Troy", "NY", "12180"), "green exact_match"),
    (("12 North Oak St 7", None, "Troy", "NY", "12180"), ("12 N Oak St", "7", "Troy", "NY", "12180"), "green exact_match"),
    (("1231/2 Oak Ct", None, "Troy", "NY", "12180"), ("123 1/2 Oak Court", None, "Troy", "NY", "12180"), "green exact_match"),
    ((" ", None, None, None, None), ("12 Oak St", None, None, None, None), "yellow not_provided"),
    (None, ("12 Oak St", None, None, None, None), "yellow not_provided"),
    (("1,234 Oak Ct", None, "Troy", "NY", "12180"), ("1234 Oak Court", None, "Troy", "NY", "1"), "yellow address_differs"),
]


def test_addresses(spark):
    assert ask(spark, fields.address, [x[:2] for x in PLACES], f"a {verdicts.ADDRESS}, b {verdicts.ADDRESS}") == [x[2] for x in PLACES]


@pytest.mark.parametrize(
    "name, text",
    [
        ("Metoprolol Succ ER 25mg tabs", "metoprolol succ er 25 mg tablet"), ("Bupropion XL 150 mg", "bupropion er 150 mg"), ("Diltiazem 24 hour extended-release extended release caps", "diltiazem er capsule"), ("Drug 1.5 mg", "drug 15 mg"),
        ("Losartan 50 mg-12 mg tab", "losartan 50/12 tablet"), ("Foo 5 mg tab 5 mg", "foo 5 mg tablet"), ("Dextroamp-Amphet 10mg", "amphetamine-dextroamphetamine 10 mg"), ("Amphetamine mixed salts", "amphetamine-dextroamphetamine"), ("Aspirin® 81MG", "aspirin 81 mg"),
    ],
)
def test_folded_names(name, text):
    assert P.fold(name) == text


def test_decimals_may_be_kept():
    assert P.fold("Drug 1.5 mg.", keep_decimals=True) == "drug 1.5 mg"


def scalar(spark, f, *values):
    return [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string").select("k", f(F.col("c")).alias("v")).orderBy("k").collect()]


def test_strengths(spark):
    assert scalar(spark, P.stated_strength, "10 gel", "5 units", "20 meq", "5%", "x 10 MG y", None) == [None, "5unit", None, None, "10mg", None]
    assert scalar(spark, P.stated_concentration, "5 mg/1 ml", "5 mgio.5ml", "5 mg11ml", "5 mg", None) == ["5mg/1ml", "5mg/0.5ml", "5mg/1ml", None, None]
    assert scalar(spark, P.stated_hours, "x 24 hour", "12hr", "hour", None) == [24.0, 12.0, None, None]


CONCEPTS = [(1, "Lopressor", "metoprolol", "25mg", "tablet"), (2, "Metoprolol", "metoprolol", "25mg", "tablet"), (3, "Metoprolol", "metoprolol", "50mg", "tablet"), (4, "Metoprolol ER", "metoprolol", "50mg", "tablet"), (5, "Bupropion", "bupropion", "75mg", "tablet"), (6, "Amoxicillin", "amoxicillin", "500mg", "capsule")]
INDEX = [("lopressor", 1), ("metoprolol", 2), ("metoprolol", 3), ("metoprolol er", 4), ("bupropion", 5), ("amoxicillin", 6), ("lisinoprila", 5), ("lisinoprilb", 6)]


def test_names_find_concepts(spark):
    concepts = spark.createDataFrame(CONCEPTS, "concept_id int, display string, ingredient string, strength string, form string")
    index = spark.createDataFrame(INDEX, "name_key string, concept_id int")
    names = {"Lopressor": "metoprolol|25mg|tablet", "metoprolol": None, "Metoprolol 25 mg tab": "metoprolol|25mg|tablet", "metoprolol 50mg": "metoprolol|50mg|tablet", "metoprolol er 50mg": "metoprolol|50mg|tablet", "metoprolol er 25mg": None,
             "Amoxicilli 500mg": "amoxicillin|500mg|capsule", "lisinopril": None, "nothing": None, "": None}
    got = {r["name"]: r.concept.id for r in products.by_names(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), concepts, index).collect()}
    assert got == {k: f"GX:{v}" for k, v in names.items() if v}


ENTRIES = [("00000000001", "100", "AMOX CAP 500MG @#"), ("00000000002", "100", "AMOX CAP 500MG BX"), ("00000000003", "200", "AMOX SUSP 250MG"), ("00000000004", None, "LONE TAB 5MG"), ("00000000005", "300", " ")]


def test_catalog_groups(spark):
    entries = spark.createDataFrame(ENTRIES, "ndc11 string, gcn string, description string")
    names = [("amox cap 500mg",), ("amox",), ("amox 500mg",), ("lone tab 5mg",), ("amox suspension 250mg",)]
    assert {r["name"]: r.gcn for r in products.groups_by_names(spark.createDataFrame(names, "name string"), entries).collect()} == {"amox cap 500mg": "100", "amox 500mg": "100", "amox suspension 250mg": "200"}
    assert {r.name_key for r in products.catalog_index(entries).filter("ndc11 = '00000000003'").collect()} == {"amox", "amox suspension", "amox suspension 250", "amox suspension 250 mg"}


DRUGS = [  # source name and code, entered name and code, verdict
    (None, None, "x", None, "yellow not_provided"), ("Aspirin 81mg tabs", None, "aspirin 81 MG tablet", None, "green name_identity_match"), ("Timolol ophthalmic drops 5 mg", None, "timolol drops 5mg", None, "green name_identity_match"), ("a", "12345-6789-01", "b", "12345678901", "green exact_match"),
    ("Foo 5 mg/1 ml", None, "Foo 10 mg/1 ml", None, "red drug_mismatch"), ("Foo 5 mg", None, "Foo 10 mg", None, "red drug_mismatch"), ("Foo Hcl 5 mg tab", None, "Foo 5 mg tablet", None, "green name_component_match"), ("Foo Hcl 5 mg tab", None, "Foo sodium 5 mg tablet", None, "yellow unknown_drug"),
    ("Amoxicilli 5 mg cap po", None, "amoxicillin 5mg caps", None, "green name_component_match"), ("foo", None, "bar", None, "yellow unknown_drug"), (None, "00071015523", None, "00071015590", "yellow pack_size"), (None, "00071015523", None, "00093715601", "yellow generic_substitution"),
    ("Lopressor", None, "metoprolol 25mg tablet", None, "yellow strength_unverified"), ("Lopressor 25mg", None, "metoprolol 25mg tablet", None, "green concept_match"), ("Metoprolol er 50mg", None, "metoprolol 50mg tablet", None, "yellow unknown_drug"), (None, "00071015523", None, "00093715801", "red drug_mismatch"),
    ("Lopressor 25mg", None, None, "00071015523", "yellow unknown_drug"),
]


def test_products(spark):
    concepts = spark.createDataFrame(CONCEPTS, "concept_id int, display string, ingredient string, strength string, form string")
    index = spark.createDataFrame(INDEX, "name_key string, concept_id int")
    d = spark.createDataFrame([(k, (a, b), (c, e)) for k, (a, b, c, e, _) in enumerate(DRUGS)], "k int, s struct<name:string,ndc:string>, e struct<name:string,ndc:string>")
    by_name = products.by_names(d.select(F.explode(F.array("s.name", "e.name")).alias("name")), concepts, index)
    got = products.compared(d, F.col("s"), F.col("e"), dimension(spark, "ndc11", MAKERS), by_name).orderBy("k").select("drug.*").collect()
    assert [f"{r.status} {r.reason_code}" for r in got] == [x[4] for x in DRUGS]


def test_other_evidence_settles_yellow_rows(spark):
    d = spark.createDataFrame([(1, (None, "00071015523"), ("Synthroid 50mcg tablet", None)), (2, (None, "00093715601"), ("amox cap 500mg", None)), (3, (None, "00093715801"), ("amox cap 500mg", None)), (4, (None, None), ("x", None)), (5, (None, "00071015590"), ("x", None))], "k int, s struct<name:string,ndc:string>, e struct<name:string,ndc:string>")
    other = spark.createDataFrame([("00071015523", ("levothyroxine", "50mcg", "Oral Tablet"))], "ndc11 string, other struct<ingredient:string,strength:string,form:string>")
    groups = spark.createDataFrame([("00093715601", "100"), ("00093715801", "200"), ("00071015590", "")], "ndc11 string, gcn string")
    names = spark.createDataFrame([("amox cap 500mg", "100")], "name string, gcn string")
    got = products.compared(d, F.col("s"), F.col("e"), dimension(spark, "ndc11", {}), dimension(spark, "name", NAMED), other_by_ndc=other, groups_by_ndc=groups, groups_by_name=names).orderBy("k").select("drug.*").collect()
    assert [r.reason_code for r in got] == ["rxnorm_scd_match", "catalog_gcn_match", "catalog_gcn_mismatch", "not_provided", "unknown_drug"]
