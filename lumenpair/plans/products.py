"""Queries of addresses, directions, products and whole pairs, over values that the tables' keys choose, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions.directions import parse_directions
from lumenpair.functions.products import parse_product
from lumenpair.operators import fields, lookup, products, verdicts
from lumenpair.plans.rules import pick
from lumenpair.plans.tables import derived, select

c = F.col
STREETS = ("Main St", "Main Street", "Oakwood Ave.", "North Elm Road", "N Elm Rd", "Oakwoud Avenue", "Lake Blvd", "Elm")
PLACE = [
    "c_custkey",
    f"CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 10 AS string) || ' ' || {pick('c_custkey', *STREETS)} || {pick('floor(c_custkey / 8)', '', ' Apt 2', ' #3', '')} END AS street_s",
    f"CAST(c_custkey % 3 + CASE WHEN c_custkey % 23 = 0 THEN 11 ELSE 10 END AS string) || ' ' || {pick('c_custkey + floor(c_custkey / 8) % 2', *STREETS)} || {pick('floor(c_custkey / 16)', '', ' apt 2', ' UNIT 3')} AS street_e",
    f"CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {pick('floor(c_custkey / 3)', 'Troy', 'TROY', None)} END AS city_s", f"{pick('floor(c_custkey / 5)', 'troy', 'Rome', 'Troy')} AS city_e",
    f"CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {pick('floor(c_custkey / 7)', 'NY', 'ny', None)} END AS state_s", f"{pick('c_custkey', 'NY', 'N.Y.')} AS state_e",
    f"CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {pick('floor(c_custkey / 11)', '12180', '12180-1234', None, '12181')} END AS zip_s", "'12180' AS zip_e",
]
SIGS = ("take 1 tab po bid", "Take one tablet by mouth twice daily", "1 cap po qd", "2 tabs po tid prn", "take 1 tab po bid x 7 days", "1 tab po bid for 7 days", "take 2 tablets by mouth three times a day as needed", "1 tab q5h", "use as told", "1 tab qhs", "", "1 tablet every night at bedtime", "TAKE 1 TAB  PO BID.", "1 tab po qd with food", "1 tab po qam", None)
DIRECTIONS = ["o_orderkey", f"{pick('o_orderkey', *SIGS)} AS src", f"{pick('floor(o_orderkey / 16)', *SIGS)} AS ent"]
NAMED = ["p_partkey", "p_size % 7 + 1 AS n", f"p_name || ' ' || CAST(p_size % 7 + 1 AS string) || {pick('p_partkey', ' mg tabs', 'MG tablet', ' mg', ' mg caps')} AS src_name",
         f"CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {pick('p_partkey', 'p', 'q', 'r')} END AS kind", "lpad(CAST(p_partkey AS string), 11, '0') AS src_ndc", "p_name"]


def judged(rows, key, comparison):
    out = fields.compared(rows, v=comparison)
    return out.select(key, c("v.status").alias("status"), c("v.reason_code").alias("reason_code"))


def side(s):
    return F.struct(c(f"street_{s}").alias("street"), F.lit(None).cast("string").alias("unit"), c(f"city_{s}").alias("city"), c(f"state_{s}").alias("state"), c(f"zip_{s}").alias("zip"))


def c4_addresses(spark, d):
    return judged(derived(spark, d, "customer", PLACE), "c_custkey", fields.address(side("s"), side("e")))


def c5_directions(spark, d):
    return judged(derived(spark, d, "orders", DIRECTIONS), "o_orderkey", fields.directions(c("src"), c("ent")))


def g8_parsed_directions(spark, d):
    rows = derived(spark, d, "orders", DIRECTIONS).withColumn("p", parse_directions(c("src")))
    return rows.select("o_orderkey", "p.dose", "p.unit", "p.route", F.round("p.per_day", 6).alias("per_day"), "p.as_needed", "p.days", F.array_join("p.times", ",").alias("times"), F.array_join("p.rest", " ").alias("rest"), "p.unknown_rate")


def concepts(spark, d):
    """A concept for every name and strength there is, and for some a second maker's form."""
    rows = derived(spark, d, "part", ["p_partkey", "lower(p_name) AS ingredient", "CAST(p_size % 7 + 1 AS string) || 'mg' AS strength", f"{pick('p_size', 'tablet', 'tablet', 'capsule')} AS form", "p_name AS display"])
    return rows.select(c("p_partkey").alias("concept_id"), "display", "ingredient", "strength", "form")


def index(spark, d):
    return derived(spark, d, "part", ["lower(p_name) AS name_key", "p_partkey AS concept_id"])


def pairs(spark, d):
    rows = derived(spark, d, "part", NAMED)
    other = (c("p_partkey") * 7 % 50).cast("string")
    name = F.when(c("kind") == "p", F.upper("src_name")).when(c("kind") == "q", F.concat(c("p_name"), F.lit(" "), (c("n") + c("p_partkey") % 2).cast("string"), F.lit(" mg tablet")))
    ndc = F.when(c("kind") == "r", F.lpad(F.when(c("p_partkey") % 5 == 0, c("p_partkey").cast("string")).otherwise(other), 11, "0"))
    src = F.struct(F.when(c("p_partkey") % 2 == 0, c("src_name")).alias("name"), F.when(c("p_partkey") % 4 > 0, c("src_ndc")).alias("ndc"))
    return rows.select("p_partkey", src.alias("s"), F.struct(name.alias("name"), ndc.alias("ndc")).alias("e"))


def drug_rows(spark, d, **evidence):
    rows = pairs(spark, d)
    codes = derived(spark, d, "part", ["lpad(CAST(p_partkey AS string), 11, '0') AS ndc11", "p_partkey AS concept_id"]).filter("concept_id % 11 > 0")
    names = rows.select(F.explode(F.array("s.name", "e.name")).alias("name"))
    return products.compared(rows, c("s"), c("e"), products.by_code(concepts(spark, d), codes), products.by_names(names, concepts(spark, d), index(spark, d)), **evidence)


def c13_drugs(spark, d):
    return drug_rows(spark, d).select("p_partkey", c("drug.status").alias("status"), c("drug.reason_code").alias("reason_code"))


def c16_upgraded(spark, d):
    """With a second vocabulary for some codes, and groups of a catalog for others."""
    part = derived(spark, d, "part", ["p_partkey", "lower(p_name) AS ingredient", "p_size", "p_name"])
    other = part.filter("p_partkey % 3 = 1").select(F.lpad(c("p_partkey").cast("string"), 11, "0").alias("ndc11"), F.struct("ingredient", F.concat((c("p_size") % 7 + 1).cast("string"), F.lit("mg")).alias("strength"), F.lit("Oral Tablet").alias("form")).alias("other"))
    groups = part.select(F.lpad(c("p_partkey").cast("string"), 11, "0").alias("ndc11"), F.when(c("p_partkey") % 5 > 0, (c("p_partkey") % 3).cast("string")).alias("gcn"))
    names = pairs(spark, d).select(c("e.name").alias("name")).distinct().filter("name IS NOT NULL").select("name", (F.length("name") % 3).cast("string").alias("gcn"))
    return drug_rows(spark, d, other_by_ndc=other, groups_by_ndc=groups, groups_by_name=names).select("p_partkey", c("drug.status").alias("status"), c("drug.reason_code").alias("reason_code"))


def j6_catalog_groups(spark, d):
    entries = derived(spark, d, "part", ["lpad(CAST(p_partkey AS string), 11, '0') AS ndc11", "CASE WHEN p_partkey % 9 > 0 THEN p_name END AS gcn", "upper(p_name) || ' ' || CAST(p_size % 7 + 1 AS string) || 'MG #' || p_brand AS description"])
    names = derived(spark, d, "part", [f"p_name || {pick('p_partkey', '', ' x', ' 3 mg')} AS name"])
    return products.groups_by_names(names, entries).select("name", "gcn")


def k6_folded(spark, d):
    rows = derived(spark, d, "part", ["p_partkey", f"p_name || {pick('p_partkey', ' ER', ' Extended-Release', ' XL', '')} || ' ' || CAST(p_size AS string) || {pick('p_size', 'MG', ' mg', 'mcg')} || {pick('p_partkey', ' Tabs', ' caps.', ' 24 hour soln')} AS name"])
    return rows.withColumn("p", parse_product(c("name"))).select("p_partkey", "p.text", "p.qualifier", "p.form", "p.release", F.array_join("p.ingredients", " ").alias("ingredients"))


def k8_elided(spark, d):
    names = derived(spark, d, "part", ["p_partkey", "lower(replace(p_name, ' ', '')) AS a", f"lower(replace(p_name, ' ', '')) || {pick('p_partkey', 'x', '', 'xy')} AS b"])
    return names.select("p_partkey", F.coalesce(products.elided(c("a"), c("b")), F.lit(False)).alias("elided"))


def j9_form_sets(spark, d):
    rows = derived(spark, d, "part", ["p_partkey", f"{pick('p_partkey', 'Oral Tablet', 'Extended Release Oral Tablet', 'Topical', 'Tablet, Chewable')} AS a", f"{pick('floor(p_partkey / 4)', 'tablet', 'tablet, extended release', 'chewable tablet', 'oral')} AS b"])
    same = (F.size(products.form_words(c("a"))) > 0) & (products.form_words(c("a")) == products.form_words(c("b")))
    return rows.select("p_partkey", same.alias("same"))


def k13_prefix_keys(spark, d):
    entries = derived(spark, d, "part", ["lpad(CAST(p_partkey AS string), 11, '0') AS ndc11", "p_name || ' ' || p_brand AS description"])
    return products.catalog_index(entries).select("ndc11", "name_key")


def c17_verify(spark, d):
    """Orders as whole pairs, each with its summary; a seventh of them puts the product off."""
    rows = derived(spark, d, "orders", ["o_orderkey", "o_custkey", "CAST(CAST(o_orderdate AS date) AS string) AS day", "o_orderkey % 5 AS k", "o_orderkey % 7 = 0 AS skip"])
    text = lambda *w: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in w])
    one = lambda **k: {n: (v if not isinstance(v, str) else F.lit(v)) for n, v in k.items()}
    none = F.lit(None)
    given = one(patientName=F.when(c("k") == 0, "William Smith").otherwise("Ann Lee"), patientDOB="1980-07-02", dateWritten=c("day"), sig=F.when(c("k") == 3, "1 tab po tid").otherwise("take 1 tab po bid"), quantity=text(F.when(c("k") == 2, F.lit("90")).otherwise("60")), quantityUnit="tab", refills="2")
    entered = one(patientName=F.when(c("k") == 0, "Bill Smith").when(c("k") == 4, "Ann Wu").otherwise("Lee, Ann"), patientDOB="7/2/80", dateWritten=F.when(c("k") == 1, "1/1/1990").otherwise(c("day")), sig="1 tablet by mouth twice daily", quantity=F.when(c("k") == 2, "30").otherwise("60"), quantityUnit="tablets", refills=F.when(c("k") == 4, "3").otherwise("2.0"))
    address = F.struct(F.lit("1 Main St").alias("street"), none.cast("string").alias("unit"), F.lit("Troy").alias("city"), F.lit("NY").alias("state"), F.lit("12180").alias("zip"))

    def record(values, date):
        who = F.struct(F.lit("Dr. Jo Ray").alias("name"), F.lit("1234567890").alias("npi"), F.lit("(212) 555-0100").alias("phone"), none.cast(verdicts.ADDRESS).alias("address"))
        return F.struct(
            values["patientName"].alias("patientName"), values["patientDOB"].alias("patientDOB"), address.alias("patientAddress"), who.alias("prescriber"), values["dateWritten"].alias("dateWritten"), date.alias("availableDate"),
            F.struct(F.lit("foo 5 mg tab").alias("name"), none.cast("string").alias("ndc")).alias("drug"), values["sig"].alias("sig"), values["quantity"].alias("quantity"), values["quantityUnit"].alias("quantityUnit"), values["refills"].alias("refills"),
            F.lit(False).alias("refillsFromTotalFills"), (c("k") == 1).alias("substitutionsNotAllowed"), (c("k") == 2).alias("daw"),
        )

    pairs = rows.select("o_orderkey", "skip", record(given, F.when(c("o_custkey") % 2 == 0, c("day"))).alias("source"), record(entered, none.cast("string")).alias("entered"))
    empty = spark.createDataFrame([], "ndc11 string, name string, concept struct<id:string,ingredient:string,strength:string,form:string,name:string>")
    out = verdicts.verify(pairs, empty.select("ndc11", "concept"), empty.select("name", "concept"), skip=c("skip"))
    of = lambda f: F.element_at(F.filter("verdicts", lambda v: v["field"] == f), 1)["reason_code"]
    return out.select("o_orderkey", "summary.green", "summary.yellow", "summary.red", "summary.total", of("patientName").alias("name"), of("dateWritten").alias("written"), of("quantity").alias("quantity"), of("sig").alias("sig"), of("drug").alias("drug"))


def z2_two_phases(spark, d):
    """A first pass without lookups, then the late rows of some pairs, a few of them stale."""
    first = derived(spark, d, "orders", ["o_orderkey", "o_orderkey % 3 AS generation", f"{pick('o_orderkey', 'drug', 'sig')} AS field", "'yellow' AS status", f"{pick('o_orderkey', 'pending_lookup', 'sig_ambiguous', 'pending_lookup', 'pending_lookup')} AS reason_code"])
    late = derived(spark, d, "orders", ["o_orderkey", "o_orderkey % 3 - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS generation", f"{pick('o_orderkey', 'drug', 'sig')} AS field", "'green' AS status", "'concept_match' AS reason_code"])
    return verdicts.patched(first, late, "o_orderkey", "generation")


def j18_fallback(spark, d):
    """A part's concept by its code, else by its name."""
    rows = derived(spark, d, "part", ["p_partkey", "lpad(CAST(p_partkey AS string), 11, '0') AS ndc11", "lower(p_name) AS name"])
    by_ndc = rows.filter("p_partkey % 3 = 0").select("ndc11", c("p_partkey").alias("a"))
    by_name = lookup.first_wins(rows.filter("p_partkey % 2 = 0").withColumn("b", c("p_partkey")), "name", "p_partkey", "b")
    return rows.join(by_ndc, "ndc11", "left").join(by_name, "name", "left").select("p_partkey", F.coalesce("a", "b").alias("concept_id"))


_W = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[.]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_MAP = "list_transform({0}, lambda w: CASE w WHEN 'street' THEN 'st' WHEN 'avenue' THEN 'ave' WHEN 'road' THEN 'rd' WHEN 'north' THEN 'n' ELSE w END)"
_UNIT = "nullif(regexp_extract(lower({0}), '(?:apt|unit|#) ?(\\w+)$', 1), '')"
_BARE = "regexp_replace(lower({0}), ' ?(apt|unit|#) ?\\w+$', '')"
_TRIV = "trim(regexp_replace(regexp_replace(trim(lower({0})), '\\s+', ' ', 'g'), '[.,;:!]+$', ''))"
_FOLD = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), 'by mouth', 'po'), 'as needed', 'prn'), 'twice daily', 'bid'), 'three times a day', 'tid'), 'every night at bedtime', 'qhs'), '[.]', '', 'g')"
_TOK = f"list_filter(string_split(regexp_replace(regexp_replace({_FOLD}, '(x|for) 7 days', ''), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"
_SIG = lambda x: f"""CASE WHEN {x} IS NULL THEN NULL ELSE struct_pack(dose := CASE WHEN len(list_filter(t, lambda w: w IN ('1', 'one'))) > 0 THEN 1.0::DOUBLE WHEN list_contains(t, '2') THEN 2.0::DOUBLE END,
    unit := CASE WHEN len(list_filter(t, lambda w: w IN ('tab', 'tabs', 'tablet', 'tablets'))) > 0 THEN 'tab' WHEN list_contains(t, 'cap') THEN 'cap' END, route := CASE WHEN list_contains(t, 'po') THEN 'po' END,
    rate := CASE WHEN list_contains(t, 'bid') THEN 2.0::DOUBLE WHEN list_contains(t, 'tid') THEN 3.0::DOUBLE WHEN len(list_filter(t, lambda w: w IN ('qd', 'qhs', 'qam'))) > 0 THEN 1.0::DOUBLE END, prn := list_contains(t, 'prn'),
    days := CASE WHEN contains({x}, '7 days') THEN 7.0::DOUBLE END, times := CASE WHEN list_contains(t, 'qhs') THEN 'bedtime' WHEN list_contains(t, 'qam') THEN 'morning' ELSE '' END, odd := list_contains(t, 'q5h'),
    rest := array_to_string(list_filter(t, lambda w: w NOT IN ('1', '2', 'one', 'tab', 'tabs', 'tablet', 'tablets', 'cap', 'po', 'bid', 'tid', 'qd', 'qhs', 'qam', 'prn', 'take', 'use', 'as')), ' ')) END"""  # noqa: E731
_D = select("orders", DIRECTIONS)
_PAIR = "(SELECT *, {A} AS a FROM (SELECT *, {T} AS t FROM ({D})))".replace("{A}", _SIG("src")).replace("{T}", _TOK.format("src")).replace("{D}", _D)
_BOTH = f"(SELECT o_orderkey, src, ent, a, {_SIG('ent')} AS b FROM (SELECT o_orderkey, src, ent, a, {_TOK.format('ent')} AS t FROM {_PAIR}))"
_NE = lambda k: f"coalesce(a.{k} <> b.{k}, FALSE)"
_LONE = lambda k: f"((a.{k} IS NULL) <> (b.{k} IS NULL))"
_PARTS = f"""R AS (SELECT *, p_partkey AS k, p_partkey % 2 = 0 AS has_name, p_partkey % 4 > 0 AS has_code, lpad(CAST(p_partkey * 7 % 50 AS VARCHAR), 11, '0') AS other FROM ({select('part', NAMED)})),
    E AS (SELECT *, CASE WHEN kind = 'p' THEN upper(src_name) WHEN kind = 'q' THEN p_name || ' ' || CAST(n + k % 2 AS VARCHAR) || ' mg tablet' END AS ename, CASE WHEN kind = 'r' THEN CASE WHEN k % 5 = 0 THEN src_ndc ELSE other END END AS endc,
        CASE WHEN has_name THEN src_name END AS sname, CASE WHEN has_code THEN src_ndc END AS sndc, CAST(n AS VARCHAR) || 'mg' AS sst, CASE kind WHEN 'p' THEN CAST(n AS VARCHAR) || 'mg' WHEN 'q' THEN CAST(n + k % 2 AS VARCHAR) || 'mg' END AS est FROM R),
    C AS (SELECT p_partkey AS id, lower(p_name) AS i, CAST(p_size % 7 + 1 AS VARCHAR) || 'mg' AS st, CASE p_size % 3 WHEN 2 THEN 'capsule' ELSE 'tablet' END AS f FROM part),
    T AS (SELECT i, st, CASE WHEN count(DISTINCT f) = 1 THEN max(f) END AS f FROM C GROUP BY 1, 2),
    L AS (SELECT E.*, cs.i AS si, cs.st AS ss, cs.f AS sf, ce.i AS ei, ce.st AS es, ce.f AS ef, ts.f AS tsf, te.f AS tef FROM E LEFT JOIN C cs ON lpad(CAST(cs.id AS VARCHAR), 11, '0') = sndc AND cs.id % 11 > 0 LEFT JOIN C ce ON lpad(CAST(ce.id AS VARCHAR), 11, '0') = endc AND ce.id % 11 > 0
        LEFT JOIN T ts ON sname IS NOT NULL AND ts.i = lower(p_name) AND ts.st = sst LEFT JOIN T te ON ename IS NOT NULL AND te.i = lower(p_name) AND te.st = est),
    M AS (SELECT *, CASE WHEN si IS NOT NULL THEN si || '|' || ss || '|' || sf WHEN tsf IS NOT NULL THEN lower(p_name) || '|' || sst || '|' || tsf END AS sc, CASE WHEN ei IS NOT NULL THEN ei || '|' || es || '|' || ef WHEN tef IS NOT NULL THEN lower(p_name) || '|' || est || '|' || tef END AS ec,
        regexp_replace(regexp_replace(regexp_replace(lower(sname), '(\\d)mg', '\\1 mg'), 'tabs$', 'tablet'), 'caps$', 'capsule') AS sx, regexp_replace(regexp_replace(regexp_replace(lower(ename), '(\\d)mg', '\\1 mg'), 'tabs$', 'tablet'), 'caps$', 'capsule') AS ex FROM L),
    V AS (SELECT *, CASE WHEN (sname IS NULL AND sndc IS NULL) OR (ename IS NULL AND endc IS NULL) THEN 'yellow:not_provided' WHEN sx = ex THEN 'green:name_identity_match' WHEN sndc = endc THEN 'green:exact_match' WHEN sname IS NOT NULL AND sst <> est THEN 'red:drug_mismatch'
        WHEN sc IS NULL OR ec IS NULL THEN CASE WHEN sst = est AND sx IS NOT NULL AND list_last(string_split(sx, ' ')) = list_last(string_split(ex, ' ')) AND regexp_matches(sx, '(tablet|capsule)$') THEN 'green:name_component_match' ELSE 'yellow:unknown_drug' END
        WHEN sc = ec AND sndc[1:9] = endc[1:9] THEN 'yellow:pack_size' WHEN sc = ec AND (si IS NULL OR ei IS NULL) THEN 'green:concept_match' WHEN sc = ec THEN 'yellow:generic_substitution' WHEN si IS NULL OR ei IS NULL THEN 'yellow:unknown_drug' ELSE 'red:drug_mismatch' END AS w FROM M)"""
_SPLIT = "split_part(w, ':', 1) AS status, split_part(w, ':', 2) AS reason_code"
_KEYS = "unnest([string_split({0}, ' ')[1], array_to_string(string_split({0}, ' ')[1:2], ' '), array_to_string(string_split({0}, ' ')[1:3], ' '), array_to_string(string_split({0}, ' ')[1:4], ' '), array_to_string(string_split({0}, ' ')[1:5], ' ')])"

QUERIES = {q.__name__: q for q in (c4_addresses, c5_directions, g8_parsed_directions, c13_drugs, c16_upgraded, j6_catalog_groups, k6_folded, k8_elided, j9_form_sets, k13_prefix_keys, c17_verify, z2_two_phases, j18_fallback)}
SQL = {
    "c4_addresses": f"""WITH P AS ({select('customer', PLACE)}), W AS (SELECT *, {_MAP.format(_W.format(_BARE.format('street_s')))} AS a, {_MAP.format(_W.format(_BARE.format('street_e')))} AS b, {_UNIT.format('street_s')} AS ua, {_UNIT.format('street_e')} AS ub,
        coalesce(lower(city_s), '') AS ca, lower(city_e) AS cb, coalesce(lower(state_s), '') AS sa, 'ny' AS sb, coalesce(zip_s[1:5], '') AS za FROM P),
        S AS (SELECT *, CASE WHEN a[-1] IN ('st', 'ave', 'rd', 'blvd') THEN a[-1] END AS fa, CASE WHEN b[-1] IN ('st', 'ave', 'rd', 'blvd') THEN b[-1] END AS fb FROM W),
        X AS (SELECT *, CASE WHEN fa IS NULL THEN a ELSE a[:-2] END AS x, CASE WHEN fb IS NULL THEN b ELSE b[:-2] END AS y FROM S),
        Y AS (SELECT *, (len(x) <> len(y) OR len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i] AND NOT (length(x[i]) >= 5 AND length(x[i]) = length(y[i]) AND regexp_full_match(x[i] || y[i], '[a-z]+') AND levenshtein(x[i], y[i]) <= 1))) > 0) OR coalesce(fa <> fb, FALSE) AS street,
            ca = '' OR ca <> cb AS city, sa <> '' AND sa <> sb AS state, za <> '' AND za <> '12180' AS zip FROM X),
        Z AS (SELECT *, CASE WHEN ca = '' AND sa = '' AND za = '' THEN NOT street WHEN sa = '' OR za = '' THEN NOT state AND NOT zip AND NOT street AND ca <> '' AND NOT city ELSE FALSE END AS part FROM Y)
        SELECT c_custkey, {_SPLIT} FROM (SELECT c_custkey, CASE WHEN street_s IS NULL AND city_s IS NULL AND state_s IS NULL AND zip_s IS NULL THEN 'yellow:not_provided' WHEN NOT part AND (street OR city OR state OR zip) THEN 'yellow:address_differs' WHEN ua <> ub THEN 'yellow:unit_differs'
            WHEN part THEN 'green:exact_match_partial_source' ELSE 'green:exact_match' END AS w FROM Z)""",
    "c5_directions": f"""SELECT o_orderkey, {_SPLIT} FROM (SELECT *, CASE WHEN coalesce(trim(src), '') = '' OR coalesce(trim(ent), '') = '' THEN 'yellow:not_provided' WHEN {_TRIV.format('src')} = {_TRIV.format('ent')} THEN 'green:verbatim_match'
        WHEN (a.dose IS NULL AND a.route IS NULL AND a.rate IS NULL AND a.times = '') OR (b.dose IS NULL AND b.route IS NULL AND b.rate IS NULL AND b.times = '') OR a.odd OR b.odd THEN 'yellow:sig_ambiguous'
        WHEN {' OR '.join(map(_NE, ('dose', 'route', 'rate', 'days', 'unit', 'prn')))} OR (a.times <> '' AND b.times <> '' AND a.times <> b.times) THEN 'red:sig_mismatch'
        WHEN {' OR '.join(map(_LONE, ('dose', 'route', 'rate', 'days')))} OR (a.times = '') <> (b.times = '') OR a.rest <> b.rest THEN 'yellow:sig_ambiguous' ELSE 'green:exact_match' END AS w FROM {_BOTH})""",
    "g8_parsed_directions": f"SELECT o_orderkey, a.dose AS dose, a.unit AS unit, a.route AS route, a.rate AS per_day, a.prn AS as_needed, a.days AS days, a.times AS times, a.rest AS rest, a.odd AS unknown_rate FROM {_PAIR}",
    "c13_drugs": f"WITH {_PARTS} SELECT k AS p_partkey, {_SPLIT} FROM V",
    "c16_upgraded": f"""WITH {_PARTS}, U AS (SELECT *, CASE WHEN w LIKE 'yellow%' AND w NOT LIKE '%not_provided' THEN CASE WHEN sndc IS NOT NULL AND k % 3 = 1 AND tef = 'tablet' AND est = sst THEN 'green:rxnorm_scd_match' WHEN sndc IS NOT NULL AND ename IS NOT NULL AND k % 5 > 0 THEN
        CASE WHEN k % 3 = length(ename) % 3 THEN 'green:catalog_gcn_match' ELSE 'yellow:catalog_gcn_mismatch' END ELSE w END ELSE w END AS u FROM V) SELECT k AS p_partkey, split_part(u, ':', 1) AS status, split_part(u, ':', 2) AS reason_code FROM U""",
    "j6_catalog_groups": f"""WITH I AS (SELECT p_name AS g, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS gcn, CAST(p_size % 7 + 1 AS VARCHAR) AS st, lower(p_name) AS nm FROM part), N AS (SELECT DISTINCT p_name || {pick('p_partkey', '', ' x', ' 3 mg')} AS name, lower(p_name) AS nm, p_partkey % 3 = 2 AS three FROM part)
        SELECT name, max(gcn) AS gcn FROM N JOIN I USING (nm) WHERE gcn IS NOT NULL AND (NOT three OR st = '3') GROUP BY 1 HAVING count(DISTINCT gcn) = 1""",
    "k6_folded": f"""SELECT p_partkey, p_name || CASE WHEN q THEN ' er' ELSE '' END || ' ' || CAST(p_size AS VARCHAR) || CASE p_size % 3 WHEN 2 THEN ' mcg' ELSE ' mg' END || ' ' || form AS text, CASE WHEN q THEN 'er' END AS qualifier, form, CASE WHEN q THEN 'er' END AS release,
        array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS ingredients FROM (SELECT *, p_partkey % 4 < 3 AS q, CASE p_partkey % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' ELSE 'solution' END AS form FROM part)""",
    "k8_elided": "SELECT p_partkey, p_partkey % 3 = 0 AND length(replace(p_name, ' ', '')) >= 8 AS elided FROM part",
    "j9_form_sets": "SELECT p_partkey, (p_partkey % 4 = 0 AND p_partkey // 4 % 4 = 0) OR (p_partkey % 4 = 1 AND p_partkey // 4 % 4 = 1) OR (p_partkey % 4 = 3 AND p_partkey // 4 % 4 = 2) AS same FROM part",
    "k13_prefix_keys": f"SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ndc11, k AS name_key FROM (SELECT p_partkey, {_KEYS.format('t')} AS k FROM (SELECT p_partkey, lower(p_name) || ' ' || replace(lower(p_brand), '#', ' ') AS t FROM part))",
    "c17_verify": """SELECT o_orderkey, 14::BIGINT - red - yellow - CASE WHEN a THEN 0 ELSE 1 END AS green, yellow::BIGINT AS yellow, red::BIGINT AS red, CASE WHEN a THEN 14 ELSE 13 END::BIGINT AS total,
        CASE k WHEN 0 THEN 'nickname_match' WHEN 4 THEN 'surname_mismatch' ELSE 'exact_match' END AS name, CASE WHEN k = 1 THEN 'date_mismatch' WHEN a THEN 'available_date_match' ELSE 'exact_match' END AS written, CASE k WHEN 2 THEN 'quantity_adjusted' ELSE 'exact_match' END AS quantity,
        CASE k WHEN 3 THEN 'sig_mismatch' ELSE 'exact_match' END AS sig, CASE WHEN s THEN 'pending_lookup' ELSE 'name_identity_match' END AS drug
        FROM (SELECT *, CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN s THEN 1 ELSE 0 END + 1 AS yellow, CASE k WHEN 1 THEN 1 + CASE WHEN a THEN 2 ELSE 1 END WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS red
        FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 7 = 0 AS s, o_custkey % 2 = 0 AS a FROM orders))""",
    "z2_two_phases": f"SELECT o_orderkey, {pick('o_orderkey', 'drug', 'sig')} AS field, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 5 > 0 THEN 'green' ELSE 'yellow' END AS status, CASE WHEN o_orderkey % 4 = 1 THEN 'sig_ambiguous' WHEN o_orderkey % 5 > 0 THEN 'concept_match' ELSE 'pending_lookup' END AS reason_code FROM orders",
    "j18_fallback": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE (SELECT min(q.p_partkey) FROM part q WHERE q.p_partkey % 2 = 0 AND lower(q.p_name) = lower(p.p_name)) END AS concept_id FROM part p",
}
