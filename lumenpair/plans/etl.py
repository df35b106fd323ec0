"""Queries of the dimensions' builders, over products, vocabulary lines and sheets that the tables' rows are made into, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions.scalars import ndc11
from lumenpair.operators import lookup
from lumenpair.operators.products import concept
from lumenpair.plans.rules import pick
from lumenpair.plans.tables import CODES, derived, select, table
from lumenpair.sources import datasets as D

c = F.col
FORMS = ("Oral Tablet", "Tablet", "Extended Release Oral Tablet", "Oral Capsule")
LINE = ["p_partkey AS ordinal", "CAST(p_partkey AS string) || '||||||||||' || CASE WHEN p_partkey % 29 = 0 THEN 'OTHER' ELSE 'RXNORM' END || '|' || "
        f"{pick('p_partkey', 'SCD', 'SBD', 'SCD', 'DF')} || '|' || '|' || CASE p_partkey % 4 WHEN 3 THEN {pick('floor(p_partkey / 4)', *FORMS)} ELSE "
        f"{pick('floor(p_partkey / 8)', '', '24 HR ', '')} || upper(p_name) || ' ' || CAST(p_size AS string) || ' MG ' || {pick('p_partkey', '', '', '/ ZINC 5 MG ')} || {pick('floor(p_partkey / 3)', *FORMS, 'Unknown Form')} || {pick('p_partkey', '', ' [Brand]')} END || '|' AS value"]  # fmt: skip
SEGMENTS = ["p_partkey", f"{pick('p_partkey', '', '24 HR ', '5 ')} || p_name || {pick('p_partkey', ' ', ' 7 x ', ' ')} || CAST(p_size AS string) || {pick('p_partkey', ' MG', '', ' MG/ML', ' 20 MG', ' x y')} AS segment", "p_name"]


def product_rows(spark, d):
    rows = derived(spark, d, "part", [*CODES, "p_name", "p_brand", "p_type", "p_size"])
    key = c("p_partkey")
    strength = F.when(key % 23 == 0, "").otherwise(F.concat(c("p_size").cast("string"), F.lit(" MG/1")))
    parts = F.when(key % 19 != 0, F.transform(F.split("p_name", " "), lambda w: F.struct(F.concat(F.lit(" "), F.upper(w)).alias("name"), strength.alias("strength"))))
    return rows.select(
        key.alias("ordinal"), F.when(key % 17 == 0, "").otherwise("x").alias("product_ndc"), F.upper("p_name").alias("generic_name"), F.when(key % 3 == 0, c("p_brand")).alias("brand_name"), parts.alias("active_ingredients"),
        F.when(key % 13 == 0, "").otherwise(c("p_type")).alias("dosage_form"), F.array(F.struct(c("code").alias("package_ndc"))).alias("packaging"),
    )


def k10_concepts(spark, d):
    return D.concepts(product_rows(spark, d))


def j1_codes(spark, d):
    """Each part's code, looked up among the codes of the parts that became concepts."""
    p = product_rows(spark, d)
    found = D.codes(p, D.concepts(p))
    asked = derived(spark, d, "part", CODES).select("p_partkey", ndc11(c("code")).alias("ndc11"))
    return asked.join(found, "ndc11", "left").select("p_partkey", "concept_id")


def a7_name_index(spark, d):
    p = product_rows(spark, d)
    return D.name_index(p, D.concepts(p))


def a6_forms(spark, d):
    return lookup.value_sets(D.concepts(product_rows(spark, d)), "ingredient", "form").select("ingredient", F.array_join("values", "|").alias("forms"))


def a11_counts(spark, d):
    p = product_rows(spark, d)
    return D.product_counts(p, D.concepts(p))


def k9_identity(spark, d):
    return D.concepts(product_rows(spark, d)).select("concept_id", concept()["id"].alias("id"), concept()["name"].alias("name"))


def conso(spark, d):
    return D.delimited(derived(spark, d, "part", LINE), D.CONSO)


def s7_delimited(spark, d):
    return conso(spark, d).select("ordinal", "rxcui", "tty", c("str").alias("name"))


def k11_split(spark, d):
    rows = derived(spark, d, "part", SEGMENTS).withColumn("s", D.split_strength(c("segment")))
    return rows.select("p_partkey", "s.ingredient", "s.strength")


def k12_vocabulary(spark, d):
    return D.vocabulary_concepts(conso(spark, d))


def o4_longest_first(spark, d):
    return D.forms_of(conso(spark, d)).select("form", F.length("form").cast("long").alias("n")).orderBy(F.desc("n"), "form")


def rel(spark, d):
    return derived(spark, d, "lineitem", ["l_orderkey * 100 + l_linenumber AS ordinal", "CAST(l_partkey AS string) AS rxcui1", "CASE WHEN l_suppkey % 5 = 0 THEN 'isa' ELSE 'has_tradename' END AS rela", "CAST(l_suppkey * 2 AS string) AS rxcui2"])


def j12_branded(spark, d):
    return D.branded_to_clinical(rel(spark, d), conso(spark, d))


def j11_codes_of_built(spark, d):
    sat = derived(spark, d, "part", [*CODES]).select(c("p_partkey").alias("ordinal"), c("p_partkey").cast("string").alias("rxcui"), F.when(c("p_partkey") % 5 == 0, "OTHER").otherwise("NDC").alias("kind"), c("code").alias("value"))
    return D.vocabulary_codes(sat, D.vocabulary_concepts(conso(spark, d)))


SHARED = "'<sst><si><t>NDC</t></si><si><t>Description</t></si><si><t>' || s_name || '</t></si><si><r><t>A &amp;</t></r><r><t xml:space=\"preserve\"> ' || CAST(s_nationkey AS string) || '</t></r></si></sst>' AS xml"
SHEET = (
    "'<sheetData><row r=\"1\"><c r=\"A1\" t=\"s\"><v>0</v></c><c r=\"B1\" t=\"s\"><v>1</v></c><c r=\"C1\"><v>Junk</v></c></row><row r=\"2\"><c r=\"A2\"><v>' || lpad(CAST(s_suppkey % 40 AS string), 11, '0') || '</v></c><c r=\"B2\" t=\"s\"><v>2</v></c><c r=\"C2\"><v>9</v></c></row>"
    "<row r=\"3\"><c r=\"A3\"/><c r=\"B3\" t=\"s\"><v>3</v></c></row><row r=\"4\"><c r=\"A4\"><v/></c><c r=\"B4\" t=\"s\"><v>77</v></c></row><row r=\"5\"><c r=\"A5\"><v>1-2</v></c><c r=\"B5\"><v>a &lt; b</v></c></row></sheetData>' AS xml"
)


def strings(spark, d):
    return derived(spark, d, "supplier", ["s_suppkey", SHARED]).select("s_suppkey", F.posexplode(D.shared_strings(c("xml"))).alias("place", "value"))


def s8_shared_strings(spark, d):
    return strings(spark, d).select("s_suppkey", c("place").cast("long").alias("place"), "value")


def cells(spark, d):
    return D.sheet_cells(derived(spark, d, "supplier", ["s_suppkey", SHEET]), "s_suppkey", "xml", strings(spark, d))


def s9_cells(spark, d):
    return cells(spark, d).select("s_suppkey", c("row").cast("long").alias("row"), "column", "value")


def sheet_rows(spark, d):
    return D.mapped_rows(cells(spark, d), "s_suppkey").withColumn("ordinal", c("s_suppkey") * 10 + c("row"))


def s10_mapped(spark, d):
    return sheet_rows(spark, d).select("s_suppkey", c("row").cast("long").alias("row"), "ndc", "description", "gcn")


def a9_entries(spark, d):
    return D.entries(sheet_rows(spark, d), "ordinal").select("ndc11", "description")


def a9_counts(spark, d):
    return D.entry_counts(sheet_rows(spark, d), "ordinal")


_P = f"""P AS (SELECT p.p_partkey AS k, p_name, p_brand, code, CASE WHEN p_partkey % 17 > 0 AND p_partkey % 19 > 0 AND p_partkey % 23 > 0 AND p_partkey % 13 > 0 THEN TRUE ELSE FALSE END AS ok, lower(p_type) AS form,
    array_to_string(list_sort(string_split(p_name, ' ')), ';') AS ingredient, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CAST(p_size AS VARCHAR) || 'mg'), ';') AS strength,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE upper(p_name) END AS display FROM part p JOIN ({select('part', CODES)}) q USING (p_partkey)),
    N AS (SELECT k, CASE WHEN regexp_full_match(code, '\\d+-\\d+-\\d+') AND length(replace(code, '-', '')) IN (10, 11) THEN lpad(split_part(code, '-', 1), 5, '0') || lpad(split_part(code, '-', 2), 4, '0') || lpad(split_part(code, '-', 3), 2, '0')
      WHEN regexp_full_match(code, '\\d{{11}}') THEN code END AS n FROM P)"""
_C = f"""C AS (SELECT ordinal, string_split(value, '|')[1] AS rxcui, string_split(value, '|')[12] AS sab, string_split(value, '|')[13] AS tty, string_split(value, '|')[15] AS str FROM ({select('part', LINE)}) WHERE string_split(value, '|')[15] <> '')"""
_RE = "'^((?:.* )?[^\\d ]\\S*) (\\d\\S*(?: \\d\\S*)*(?: [^\\d ]\\S*)*)$'"
_SEG = lambda s: f"regexp_replace({s}, '^\\d\\S* [a-zA-Z%]+ (\\S)', '\\1')"
_V = f"""F AS (SELECT DISTINCT str AS form FROM C WHERE sab = 'RXNORM' AND tty = 'DF'), R AS (SELECT *, trim(regexp_replace(str, '\\s*\\[[^\\]]*\\]\\s*$', '')) AS bare FROM C WHERE sab = 'RXNORM' AND tty IN ('SCD', 'SBD')),
    W AS (SELECT R.*, arg_max(form, length(form)) AS form FROM R JOIN F ON ends_with(lower(bare), ' ' || lower(form)) GROUP BY ALL),
    G AS (SELECT *, list_transform(string_split(trim(bare[:length(bare) - length(form)]), ' / '), lambda s: {_SEG('trim(s)')}) AS segs FROM W),
    B AS (SELECT rxcui, ordinal, tty, str AS display, lower(form) AS form, list_sort(list_transform(segs, lambda s: lower(regexp_extract(s, {_RE}, 1)) || chr(1) || regexp_replace(lower(replace(regexp_extract(s, {_RE}, 2), ' ', '')), '/1$', ''))) AS prs FROM G WHERE len(list_filter(segs, lambda s: NOT regexp_matches(s, {_RE}))) = 0)"""
_SUP = "S AS (SELECT s_suppkey, s_name, s_nationkey, lpad(CAST(s_suppkey % 40 AS VARCHAR), 11, '0') AS code FROM supplier)"

QUERIES = {q.__name__: q for q in (k10_concepts, j1_codes, a7_name_index, a6_forms, a11_counts, k9_identity, s7_delimited, k11_split, k12_vocabulary, o4_longest_first, j12_branded, j11_codes_of_built, s8_shared_strings, s9_cells, s10_mapped, a9_entries, a9_counts)}
SQL = {
    "k10_concepts": f"WITH {_P} SELECT k AS concept_id, display, ingredient, strength, form FROM P WHERE ok",
    "j1_codes": f"WITH {_P} SELECT k AS p_partkey, (SELECT min(N2.k) FROM N N2 JOIN P ON P.k = N2.k WHERE P.ok AND N2.n = N.n) AS concept_id FROM N",
    "a7_name_index": f"WITH {_P} SELECT DISTINCT lower(x) AS name_key, k AS concept_id FROM (SELECT k, unnest([CASE WHEN k % 3 = 0 THEN p_brand END, p_name]) AS x FROM P WHERE ok) WHERE x IS NOT NULL",
    "a6_forms": f"WITH {_P} SELECT ingredient, string_agg(DISTINCT form, '|' ORDER BY form) AS forms FROM P WHERE ok GROUP BY 1",
    "a11_counts": f"""WITH {_P}, K AS (SELECT lower(p_name) AS x FROM P WHERE ok UNION SELECT lower(p_brand) FROM P WHERE ok AND k % 3 = 0) SELECT (SELECT count(*) FROM P) AS products, (SELECT count(*) FROM P WHERE ok) AS concepts, (SELECT count(*) FROM P WHERE NOT ok) AS skipped,
        (SELECT count(DISTINCT n) FROM N JOIN P USING (k) WHERE ok) AS codes, (SELECT count(*) FROM N JOIN P USING (k) WHERE ok AND n IS NULL) AS unread_codes, (SELECT count(*) FROM K) AS name_keys, (SELECT count(DISTINCT ingredient) FROM P WHERE ok) AS ingredients""",
    "k9_identity": f"WITH {_P} SELECT k AS concept_id, 'GX:' || ingredient || '|' || strength || '|' || form AS id, display || ' ' || strength || ' ' || form AS name FROM P WHERE ok",
    "s7_delimited": f"WITH {_C} SELECT ordinal, rxcui, tty, str AS name FROM C",
    "k11_split": f"SELECT p_partkey, CASE WHEN regexp_matches(s, {_RE}) THEN regexp_extract(s, {_RE}, 1) END AS ingredient, CASE WHEN regexp_matches(s, {_RE}) THEN regexp_extract(s, {_RE}, 2) END AS strength FROM (SELECT p_partkey, {_SEG('trim(segment)')} AS s FROM ({select('part', SEGMENTS)}))",
    "k12_vocabulary": f"WITH {_C}, {_V} SELECT rxcui, arg_min(tty, ordinal) AS tty, arg_min(display, ordinal) AS display, arg_min(array_to_string(list_transform(prs, lambda p: split_part(p, chr(1), 1)), ';'), ordinal) AS ingredient, arg_min(array_to_string(list_transform(prs, lambda p: split_part(p, chr(1), 2)), ';'), ordinal) AS strength, arg_min(form, ordinal) AS form FROM B GROUP BY 1",
    "o4_longest_first": f"WITH {_C} SELECT DISTINCT str AS form, length(str) AS n FROM C WHERE sab = 'RXNORM' AND tty = 'DF'",
    "j12_branded": f"""WITH {_C}, E AS (SELECT l_orderkey * 100 + l_linenumber AS o, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey * 2 AS VARCHAR) AS b FROM lineitem WHERE l_suppkey % 5 > 0)
        SELECT a AS rxcui, arg_min(b, row(o, b)) AS scd FROM E WHERE a IN (SELECT rxcui FROM C WHERE sab = 'RXNORM' AND tty = 'SBD') AND b IN (SELECT rxcui FROM C WHERE sab = 'RXNORM' AND tty = 'SCD') GROUP BY 1""",
    "j11_codes_of_built": f"WITH {_C}, {_V}, {_P} SELECT n AS ndc11, arg_min(CAST(k AS VARCHAR), k) AS rxcui FROM N WHERE k % 5 > 0 AND n IS NOT NULL AND CAST(k AS VARCHAR) IN (SELECT rxcui FROM B) GROUP BY 1",
    "s8_shared_strings": "SELECT s_suppkey, unnest([0, 1, 2, 3]) AS place, unnest(['NDC', 'Description', s_name, 'A & ' || CAST(s_nationkey AS VARCHAR)]) AS value FROM supplier".replace("[0, 1, 2, 3]", "CAST([0, 1, 2, 3] AS BIGINT[])"),
    "s9_cells": f"""WITH {_SUP} SELECT s_suppkey, CAST(r AS BIGINT) AS row, col AS column, v AS value FROM (SELECT s_suppkey, unnest([0, 0, 0, 1, 1, 1, 2, 4, 4]) AS r, unnest(['A', 'B', 'C', 'A', 'B', 'C', 'B', 'A', 'B']) AS col,
        unnest(['NDC', 'Description', 'Junk', code, s_name, '9', 'A & ' || CAST(s_nationkey AS VARCHAR), '1-2', 'a < b']) AS v FROM S)""",
    "s10_mapped": f"""WITH {_SUP} SELECT s_suppkey, CAST(r AS BIGINT) AS row, n AS ndc, v AS description, NULL::VARCHAR AS gcn FROM (SELECT s_suppkey, unnest([1, 2, 4]) AS r, unnest([code, NULL, '1-2']) AS n, unnest([s_name, 'A & ' || CAST(s_nationkey AS VARCHAR), 'a < b']) AS v FROM S)""",
    "a9_entries": f"WITH {_SUP} SELECT code AS ndc11, arg_min(s_name, s_suppkey) AS description FROM S GROUP BY 1",
    "a9_counts": f"""WITH {_SUP}, K AS (SELECT arg_min(lower(replace(s_name, '#', ' ')), s_suppkey) AS t FROM S GROUP BY code), X AS (SELECT DISTINCT unnest([split_part(t, ' ', 1), t]) AS w FROM K)
        SELECT 3 * count(*) AS total, count(*) AS missing, count(*) AS unread, count(DISTINCT code) AS codes, count(*) - count(DISTINCT code) AS repeated, 0::BIGINT AS groups, count(DISTINCT code) AS without_group, (SELECT count(*) FROM X) AS name_keys FROM S""",
}
