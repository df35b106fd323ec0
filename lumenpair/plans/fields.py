"""Queries of the field comparators, their assembly and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions import scalars as S
from lumenpair.functions import vocabulary as V
from lumenpair.operators import fields, verdicts
from lumenpair.plans.tables import BIRTH_DATES, CODES, CONTACTS, LINE_QUANTITIES, NAMES, ORDER_DATES, derived, select, table


def judged(spark, d, table, exprs, keys, comparison):
    """keys and the verdict of one comparison over a derived table."""
    out = fields.compared(derived(spark, d, table, exprs), v=comparison)
    return out.select(*keys, F.col("v.status").alias("status"), F.col("v.reason_code").alias("reason_code"))


def c2_dates(spark, d):
    return judged(spark, d, "orders", ORDER_DATES, ["o_orderkey"], fields.dates(F.col("src"), F.col("ent")))


def d2_birth_dates(spark, d):
    return derived(spark, d, "orders", BIRTH_DATES).select("o_orderkey", S.parse_date(F.col("born"), True, 2026).alias("iso"))


def c3_written_or_available(spark, d):
    return judged(spark, d, "orders", ORDER_DATES, ["o_orderkey"], fields.written_or_available(F.col("src"), F.col("available"), F.col("ent")))


def d1_parse_date(spark, d):
    return derived(spark, d, "orders", ORDER_DATES).select("o_orderkey", S.parse_date(F.col("ent")).alias("iso"))


def c6_quantity(spark, d):
    v = fields.quantity(*map(F.col, ("src", "src_unit", "ent", "ent_unit", "per_day")))
    return judged(spark, d, "lineitem", LINE_QUANTITIES, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], v)


def c7_refills(spark, d):
    return judged(spark, d, "customer", CONTACTS, ["c_custkey"], fields.refills(*map(F.col, ("refills_src", "refills_ent", "total_fills"))))


def c9_npi(spark, d):
    return judged(spark, d, "customer", CONTACTS, ["c_custkey"], fields.npi(F.col("npi_src"), F.col("npi_ent")))


def c10_phone(spark, d):
    return judged(spark, d, "customer", CONTACTS, ["c_custkey"], fields.phone(F.col("src"), F.col("ent")))


def c12_substitution(spark, d):
    return judged(spark, d, "customer", CONTACTS, ["c_custkey"], fields.substitution(F.col("not_allowed"), F.col("as_written")))


def k1_ndc(spark, d):
    return derived(spark, d, "part", CODES).select("p_partkey", S.ndc11(F.col("code")).alias("ndc11"))


def c1_names(spark, d):
    return judged(spark, d, "customer", NAMES, ["c_custkey"], fields.names(F.col("src"), F.col("ent")))


def verdict_rows(spark, d):
    rows = derived(spark, d, "customer", CONTACTS)
    c = F.col
    v = {"refills": fields.refills(c("refills_src"), c("refills_ent"), c("total_fills")), "prescriberNpi": fields.npi(c("npi_src"), c("npi_ent")), "prescriberPhone": fields.phone(c("src"), c("ent")), "daw": fields.substitution(c("not_allowed"), c("as_written"))}
    return verdicts.assemble(fields.compared(rows, **{f"v_{k}": x for k, x in v.items()}), {k: c(f"v_{k}") for k in v})


def a1_summary(spark, d):
    return verdict_rows(spark, d).select("c_custkey", *verdicts.summary(F.col("verdicts")))


def a3_categories(spark, d):
    return verdict_rows(spark, d).select("c_custkey", F.explode(verdicts.categories(F.col("verdicts"))).alias("v")).select("c_custkey", "v.category", "v.status")


def a2_worst(spark, d):
    """The gravest status of each segment's categories, from rows of verdicts."""
    rows = verdict_rows(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    long = rows.select("c_mktsegment", F.explode(verdicts.categories(F.col("verdicts"))).alias("v")).select("c_mktsegment", F.col("v.category").alias("category"), F.col("v.status").alias("s"))
    return long.groupBy("c_mktsegment", "category").agg(verdicts.worst(F.col("s")).alias("status"))


_ISO = """CASE WHEN regexp_full_match(trim({0}), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(TRY_CAST(trim({0}) AS DATE) AS VARCHAR)
 WHEN regexp_full_match(trim({0}), '\\d{{1,2}}/\\d{{1,2}}/(\\d{{2}}|\\d{{4}})') THEN CAST(TRY_CAST((CASE WHEN length(split_part(trim({0}), '/', 3)) = 4 THEN split_part(trim({0}), '/', 3)
   WHEN CAST(split_part(trim({0}), '/', 3) AS INT) <= 49 THEN '20' || split_part(trim({0}), '/', 3) ELSE '19' || split_part(trim({0}), '/', 3) END)
   || '-' || split_part(trim({0}), '/', 1) || '-' || split_part(trim({0}), '/', 2) AS DATE) AS VARCHAR)
 WHEN regexp_full_match({0}, '[A-Za-z]+ \\d{{1,2}}, \\d{{4}}') THEN CAST(TRY_CAST(regexp_extract({0}, '(\\d{{4}})$', 1) || '-'
   || CAST((position(lower({0}[1:3]) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 AS VARCHAR) || '-' || regexp_extract({0}, ' (\\d{{1,2}}),', 1) AS DATE) AS VARCHAR) END"""
_DATES = f"SELECT *, {_ISO.format('src')} AS a, {_ISO.format('ent')} AS b, {_ISO.format('available')} AS v FROM ({select('orders', ORDER_DATES)})"
_VERDICT = """CASE WHEN coalesce(trim({s}), '') = '' OR coalesce(trim(ent), '') = '' THEN 'yellow:not_provided' WHEN {a} IS NULL OR b IS NULL THEN 'yellow:unparseable_date'
 WHEN {a} = b THEN 'green:exact_match' ELSE 'red:date_mismatch' END"""
_BOTH = "split_part(w, ':', 1) AS status, split_part(w, ':', 2) AS reason_code"
_W, _A = _VERDICT.format(s="src", a="a"), _VERDICT.format(s="available", a="v")
_UNIT = lambda c: f"CASE WHEN lower({c}) IN ('ea', 'each') THEN NULL WHEN lower({c}) LIKE 'tab%' THEN 'tab' WHEN lower({c}) LIKE 'cap%' THEN 'cap' ELSE lower({c}) END"
_NUMBER = lambda c: f"CASE WHEN {c} = 'some' OR {c} = 'x' THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"
_WHOLE = lambda x: f"abs({x} - floor({x} + 0.5)) < 0.05"
_RATIO = "(greatest(floor(a / per_day + 0.5), floor(b / per_day + 0.5)) / nullif(least(floor(a / per_day + 0.5), floor(b / per_day + 0.5)), 0))"
_DIGITS = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
_REFILLS = """CASE WHEN refills_src = '' OR refills_ent = '' THEN 'yellow:not_provided' WHEN refills_src = 'x' THEN 'yellow:unparseable_quantity'
 WHEN greatest(TRY_CAST(refills_src AS INT) - CASE WHEN total_fills THEN 1 ELSE 0 END, 0) = TRY_CAST(refills_ent AS INT) THEN 'green:exact_match' ELSE 'red:refills_mismatch' END"""
_NPI = f"CASE WHEN trim(npi_ent) = '' THEN 'yellow:not_provided' WHEN {_DIGITS('npi_src')} = {_DIGITS('npi_ent')} THEN 'green:exact_match' ELSE 'red:npi_mismatch' END"
_S, _E = _DIGITS("src"), _DIGITS("ent")
_PHONE = f"""CASE WHEN src IS NULL THEN 'yellow:not_provided' WHEN right({_S}, 10) = right({_E}, 10) THEN 'green:exact_match'
 WHEN right({_S}, 7) = right({_E}, 7) THEN CASE WHEN regexp_full_match(left(right({_S}, 10), 3), '[2-9][0-9][0-9]') AND regexp_full_match(left(right({_E}, 10), 3), '[2-9][0-9][0-9]')
 THEN 'red:phone_area_code_mismatch' ELSE 'yellow:phone_ocr_suspect' END ELSE 'yellow:phone_differs' END"""
_DAW = "CASE WHEN not_allowed IS NULL THEN 'yellow:not_provided' WHEN NOT not_allowed THEN 'green:substitution_allowed' WHEN as_written IS NULL THEN 'yellow:not_provided' WHEN as_written THEN 'green:daw_consistent' ELSE 'red:daw_required' END"
_CUSTOMER = f"({select('customer', CONTACTS)})"
_LONG = " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS category, split_part({x}, ':', 1) AS status FROM {_CUSTOMER}" for c, x in (("Rx", _REFILLS), ("Prescriber", _NPI), ("Prescriber", _PHONE), ("Rx", _DAW)))

_NICK = ", ".join("('" + g.partition(":")[0].strip() + "', '" + w + "')" for g in "".join(V.NICKNAMES).split(";") for w in g.replace(":", " ").split())
_SUFFIX = "' (jr|sr|ii|iii|iv|v)$'"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _read(x: str, k: str) -> str:
    """The columns f, l, m, s (first, last, middle words, suffix) of a name, with k behind each."""
    n = f"regexp_replace(trim(regexp_replace(lower({x}), '[.'']', '', 'g')), '\\s+', ' ', 'g')"
    bare = lambda i: f"regexp_replace(trim(split_part({n}, ',', {i})), '^((dr|mr|mrs|ms|prof) )+', '')"
    body = lambda i: f"regexp_replace({bare(i)}, {_SUFFIX}, '')"
    suffix = lambda i: f"nullif(regexp_extract({bare(i)}, {_SUFFIX}, 1), '')"
    first = lambda i: f"split_part({body(i)}, ' ', 1)"
    rest = lambda i: f"substr({body(i)}, length({first(i)}) + 2)"
    dash = lambda v: f"trim(replace({v}, '-', ' '))"
    two = f"contains({n}, ',')"
    return (
        f"CASE WHEN {two} THEN {dash(first(2))} ELSE {dash(first(1))} END AS f{k}, CASE WHEN {two} THEN {dash(body(1))} ELSE {dash(rest(1))} END AS l{k}, "
        f"CASE WHEN {two} THEN {_words(rest(2))} ELSE [] END AS m{k}, CASE WHEN {two} THEN coalesce({suffix(1)}, {suffix(2)}) ELSE {suffix(1)} END AS s{k}"
    )


def _bag(k: str) -> str:
    return f"list_sort(list_filter(list_concat([f{k}], m{k}, {_words('l' + k)}), lambda w: w <> ''))"


def _tail(x: str, y: str) -> str:
    return f"(len({x}) < len({y}) AND len({x}) > 0 AND {y}[len({y}) - len({x}) + 1:] = {x})"


_NAMES = f"""WITH G AS (SELECT * FROM (VALUES {_NICK}) t(c, w)), P AS (SELECT *, {_read('src', 'a')}, {_read('ent', 'b')} FROM ({select('customer', NAMES)})),
    Q AS (SELECT *, {_words('la')} AS wa, {_words('lb')} AS wb, trim(fa || ' ' || la) <> '' AND (trim(fa || ' ' || la) = trim(fb || ' ' || lb) OR {_bag('a')} = {_bag('b')}) AS same, la <> '' AND replace(la, ' ', '') = replace(lb, ' ', '') AS exact,
      fa = fb OR EXISTS (SELECT 1 FROM G x JOIN G y ON x.c = y.c WHERE x.w = fa AND y.w = fb) AS nick, list_has_any({_words('fa')}, {_words('fb')}) AS part, length(fa) >= 3 AND length(fb) >= 3 AND (starts_with(fa, fb) OR starts_with(fb, fa)) AS fuzzy, (sa IS NULL) <> (sb IS NULL) AS one, coalesce(sa <> sb, FALSE) AS two FROM P)
    SELECT c_custkey, {_BOTH} FROM (SELECT *, CASE WHEN coalesce(trim(src), '') = '' OR coalesce(trim(ent), '') = '' THEN 'yellow:not_provided' WHEN same AND two THEN 'red:suffix_mismatch' WHEN same AND one THEN 'yellow:suffix_dropped' WHEN same THEN 'green:exact_match'
      WHEN NOT exact AND NOT list_has_any(wa, wb) THEN 'red:surname_mismatch' WHEN NOT nick AND NOT part AND NOT fuzzy THEN 'red:first_name_mismatch' WHEN two THEN 'red:suffix_mismatch' WHEN NOT exact AND ({_tail('wa', 'wb')} OR {_tail('wb', 'wa')}) THEN 'yellow:middle_name_present'
      WHEN NOT exact THEN 'yellow:surname_partial' WHEN NOT nick AND part THEN 'yellow:given_name_partial' WHEN one THEN 'yellow:suffix_dropped' WHEN fa <> fb THEN 'yellow:nickname_match' ELSE 'green:exact_match' END AS w FROM Q)"""

QUERIES = {f.__name__: f for f in (c1_names, c2_dates, d2_birth_dates, c3_written_or_available, d1_parse_date, c6_quantity, c7_refills, c9_npi, c10_phone, c12_substitution, k1_ndc, a1_summary, a3_categories, a2_worst)}
SQL = {
    "c1_names": _NAMES,
    "d1_parse_date": f"SELECT o_orderkey, b AS iso FROM ({_DATES})",
    "d2_birth_dates": f"""SELECT o_orderkey, CASE WHEN length(split_part(born, '/', 3)) = 4 THEN strftime(strptime(born, '%m/%d/%Y'), '%Y-%m-%d')
        ELSE CAST(TRY_CAST(CAST(CASE WHEN yy <= 26 THEN 2000 + yy ELSE 1900 + yy END AS VARCHAR) || '-' || split_part(born, '/', 1) || '-' || split_part(born, '/', 2) AS DATE) AS VARCHAR) END AS iso
        FROM (SELECT *, CAST(split_part(born, '/', 3) AS INT) AS yy FROM ({select('orders', BIRTH_DATES)}))""",
    "c2_dates": f"SELECT o_orderkey, {_BOTH} FROM (SELECT *, {_W} AS w FROM ({_DATES}))",
    "c3_written_or_available": f"""SELECT o_orderkey, {_BOTH} FROM (SELECT *, CASE WHEN coalesce(trim(available), '') = '' THEN x WHEN y LIKE 'green%' THEN 'green:available_date_match'
        WHEN y LIKE 'yellow%' OR src = '' THEN y WHEN x LIKE 'green%' THEN x ELSE 'red:date_mismatch' END AS w FROM (SELECT *, {_W} AS x, {_A} AS y FROM ({_DATES})))""",
    "c6_quantity": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_BOTH} FROM (SELECT *, CASE WHEN src = '' OR ent = '' THEN 'yellow:not_provided' WHEN a IS NULL OR b IS NULL THEN 'yellow:unparseable_quantity'
        WHEN a = b AND coalesce(ua = ub, TRUE) THEN 'green:exact_match' WHEN NOT coalesce(ua = ub, TRUE) THEN 'red:unit_mismatch'
        WHEN {_WHOLE('a / per_day')} AND {_WHOLE('b / per_day')} AND floor(a / per_day + 0.5) BETWEEN 1 AND 120 AND floor(b / per_day + 0.5) BETWEEN 1 AND 120
          AND {_WHOLE(_RATIO)} AND {_RATIO} <= 6 THEN 'yellow:quantity_adjusted' ELSE 'red:quantity_mismatch' END AS w
        FROM (SELECT *, {_NUMBER('src')} AS a, {_NUMBER('ent')} AS b, {_UNIT('src_unit')} AS ua, {_UNIT('ent_unit')} AS ub FROM ({select('lineitem', LINE_QUANTITIES).replace('2.0D', '2.0').replace('1.0D', '1.0')})))""",
    "c7_refills": f"SELECT c_custkey, {_BOTH} FROM (SELECT *, {_REFILLS} AS w FROM {_CUSTOMER})",
    "c9_npi": f"SELECT c_custkey, {_BOTH} FROM (SELECT *, {_NPI} AS w FROM {_CUSTOMER})",
    "c10_phone": f"SELECT c_custkey, {_BOTH} FROM (SELECT *, {_PHONE} AS w FROM {_CUSTOMER})",
    "c12_substitution": f"SELECT c_custkey, {_BOTH} FROM (SELECT *, {_DAW} AS w FROM {_CUSTOMER})",
    "k1_ndc": f"""SELECT p_partkey, CASE WHEN regexp_full_match(code, '\\d+-\\d+-\\d+') AND length(replace(code, '-', '')) IN (10, 11) THEN lpad(split_part(code, '-', 1), 5, '0') || lpad(split_part(code, '-', 2), 4, '0') || lpad(split_part(code, '-', 3), 2, '0')
        WHEN regexp_full_match(code, '\\d{{11}}') THEN code END AS ndc11 FROM ({select('part', CODES)})""",
    "a1_summary": f"SELECT c_custkey, count(*) FILTER (status = 'green') AS green, count(*) FILTER (status = 'yellow') AS yellow, count(*) FILTER (status = 'red') AS red, count(*) AS total FROM ({_LONG}) GROUP BY 1",
    "a2_worst": f"SELECT c_mktsegment, category, CASE WHEN bool_or(status = 'red') THEN 'red' WHEN bool_or(status = 'yellow') THEN 'yellow' ELSE 'green' END AS status FROM ({_LONG}) JOIN customer USING (c_custkey) GROUP BY 1, 2",
    "a3_categories": f"SELECT c_custkey, category, CASE WHEN bool_or(status = 'red') THEN 'red' WHEN bool_or(status = 'yellow') THEN 'yellow' ELSE 'green' END AS status FROM ({_LONG}) GROUP BY 1, 2",
}
