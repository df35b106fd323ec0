"""Queries of the small rules, over values that the tables' keys choose, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions import products as P
from lumenpair.functions import rules as R
from lumenpair.functions import scalars as S
from lumenpair.operators import lookup, sequence, verdicts
from lumenpair.plans.tables import derived, select, table
from lumenpair.sources import requests


def pick(key: str, *values: str | None) -> str:
    """SQL in both dialects: the value whose place is key modulo their number."""
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE CAST({key} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"


MESSAGES = ("Waiting for a PioneerRx window", "Checked 12 fields", "UIA read failed: x", "Drug lookup failed", "short", "", None, "A message that nobody knows of", "Open the Escript tab now", "No PioneerRx window found.", "fourteen chars")
TITLES = ("PioneerRx - PRE-CHECK", "Edit Rx 12", "new rx", "", None, "Precheck edit rx", " Create Recommended Orders (2)", "Recommended Order - Catalog Item Substitution Selection", "other")
WORDS = ("escript", "eScript:", "escrlpt", "escr1dt!", "escr1d", "prescript", "Escripts", None, "", "esclidt")
CELLS = ("$0.00", "0", "(0.0)", "12.50", "$1,000", "", None, "x", "-3")
SHAS = ('{"sha": "abc123"}', '{"sha": 5}', '{"x": {"sha": "no"}}', "{oops", '{"sha": ""}', None, '[1]', '{"sha":"F00"}')
KEYS = ("k1", "k2", " ", None)
STATES = ("missing", "unreadable", "non-object", "object", "object")
VALUES = ("Key: Value", "A: B: C", "NoColon", "Refills: 3 (three)", "Text (inner) more", " ", None, "Open ( only", ": x", "Total fills: 4 (incl. first)")
DATES = ("1995-02-03", "2001-11-30", "1/2/2003", "", None, "2003-02-30", " 1999-01-09 ")
MANGLED = ("O7/02/1980", "07-02-1980", "07.02.1980", "7/2/198 0", "07/021980", "0702/1980", "07l02I1980", "x", "12/12/2001", None, "lO/lO/2OO1", "SB")
LINES = ("2026-07-06 10:11:12 Timing: 5 ms", "2026-07-06T10:11:12.123 [RIGHTCLICK-DIAG] fine", "2026-07-06 10:11:12 [RIGHTCLICK-DIAG] EXCEPTION", "Timing: 5", "2026-07-06 10:11:12 other", "", None)
FIELD_NAMES = ("patientName", "drug", "sig", "nonsense", None, "daw", "patientDOB")


def case(name, table_name, key, exprs, columns):
    """A query that selects columns over derived inputs."""

    def query(spark, d):
        return derived(spark, d, table_name, [key, *exprs]).select(key, *columns())

    query.__name__ = name
    return query


def over(table_name, key, exprs, what):
    return f"SELECT {key}, {what} FROM ({select(table_name, [key, *exprs])})"


c = F.col
_ADDRESS = [f"{pick('c_custkey', '1 Main St', '', None, '2 Oak Ave')} AS street", f"{pick('c_custkey', 'Apt 2', None, '3')} AS unit", f"{pick('c_custkey', 'Troy', None, 'Rome', '', 'Ely')} AS city", f"{pick('c_custkey', 'NY', '')} AS state", f"{pick('c_custkey', '12180', None, '1')} AS zip"]
_RGB = ["event_id * 7 % 256 AS r", "event_id * 13 % 256 AS g", "event_id * 29 % 256 AS b"]
_PRIVATE = ("patientName", "patientDOB", "patientAddress")
_FIELDS = tuple(f for f in verdicts.FIELDS if f != "availableDate")


def words(column):
    return F.split(column, " ")


def u1_same_set(spark, d):
    rows = derived(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    a, b = F.split(F.lower("p_name"), ""), F.split(F.lower("p_type"), "")
    return rows.select("p_partkey", R.same_set(F.concat(a, a), a).alias("itself"), R.same_set(a, b).alias("other"), F.array_join(R.either_only(a, b), "").alias("only"))


def u2_one_each(spark, d):
    rows = derived(spark, d, "part", ["p_partkey", "p_name", "p_brand"])
    one = R.one_each(F.array_append(words("p_name"), F.lit("x")), F.array_append(words("p_name"), c("p_brand")))
    return rows.select("p_partkey", one["a"].alias("a"), one["b"].alias("b"))


def p8_in_order(spark, d):
    rows = derived(spark, d, "customer", ["c_custkey", "c_custkey % 13 AS k", "c_custkey % 5 AS m"])
    every = F.array(*[F.struct(F.lit(f).alias("field")) for f in verdicts.FIELDS])
    shown = F.when(c("m") == 0, F.concat(F.slice(every, c("k").cast("int") + 1, F.lit(14)), F.slice(every, F.lit(1), c("k").cast("int")))).when(c("m") == 1, F.filter(every, lambda v: v["field"] != "availableDate")).otherwise(every)
    available = F.when(c("m") == 1, "").otherwise("x")
    return rows.select("c_custkey", verdicts.in_order(shown).alias("in_order"), verdicts.complete(shown, available).alias("complete"))


def p13_scrub(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.element_at(F.split("text", " "), 1).alias("first"), F.concat_ws(" ", F.lit("555-0100 123 456"), c("conv_id").cast("string")).alias("secret"))
    text = F.concat_ws(" ", "text", F.lit("call 5550100 or x123456y, id"), c("conv_id").cast("string"))
    return rows.select("conv_id", "turn", R.scrubbed(text, F.array("first"), R.scrub_tokens(F.element_at(F.split("text", " "), -1)), R.scrub_runs(c("secret"))).alias("scrubbed"))


def p12_fragment_leak(spark, d):
    """Whether a turn repeats any five characters of the turn before it."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    both = rows.join(table(spark, d, "conversations").select("conv_id", (c("turn") + 1).alias("turn"), c("text").alias("before")), ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", requests.leaks_fragment(c("before"), c("text")).alias("leaks"))


def p21_stale(spark, d):
    """Ticks of a user's latest generation."""
    rows = derived(spark, d, "events", ["event_id", "user_id", "CAST(value AS BIGINT) % 7 AS generation"])
    return sequence.current(rows, "user_id", "generation").select("event_id", "user_id", "generation")


def a7_inverted(spark, d):
    return lookup.inverted(table(spark, d, "part"), "p_name", "p_partkey").select("p_name", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("keys"))


def a10_group_sizes(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("suppliers"))


def a13_upper_median(spark, d):
    rows = derived(spark, d, "lineitem", ["l_orderkey", "CAST(l_quantity AS BIGINT) AS q"])
    return rows.groupBy("l_orderkey").agg(sequence.upper_median(c("q")).alias("q"))


def a14_share(spark, d):
    rows = derived(spark, d, "lineitem", ["l_orderkey", "CAST(l_quantity AS BIGINT) AS q"])
    near = sequence.share_near(rows, "l_orderkey", "q", 12)
    return near.select("l_orderkey", F.round("share", 6).alias("share"), (c("share") >= 0.6).alias("plain"))


def a15_box(spark, d):
    rows = derived(spark, d, "events", ["user_id", "value AS x", "value + 10 AS right", "CAST(hour(ts) AS double) AS y", "CAST(hour(ts) + 1 AS double) AS bottom"])
    return rows.groupBy("user_id").agg(*sequence.box(*map(c, ("x", "y", "right", "bottom"))))


def a19_any_none(spark, d):
    rows = derived(spark, d, "events", ["user_id", "event_type"])
    return rows.groupBy("user_id").agg(F.bool_or(c("event_type") == "purchase").alias("any_purchase"), (~F.bool_or(c("event_type") == "error")).alias("no_error"))


QUERIES = {
    q.__name__: q
    for q in (
        u1_same_set, u2_one_each, p8_in_order, p13_scrub, p12_fragment_leak, p21_stale, a7_inverted, a10_group_sizes, a13_upper_median, a14_share, a15_box, a19_any_none,
        case("p3_scalar_text", "customer", "c_custkey", [f"{pick('c_custkey', '', None, 'x', '12')} AS v", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS n"], lambda: [verdicts.text_of(c("v")).alias("v"), verdicts.text_of(c("n")).alias("n")]),
        case("p4_address_text", "customer", "c_custkey", _ADDRESS, lambda: [verdicts.address_text(F.struct("street", "unit", "city", "state", "zip")).alias("shown")]),
        case("p5_drug_text", "part", "p_partkey", ["CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 > 1 THEN p_name END AS name"], lambda: [verdicts.drug_text(F.struct("name")).alias("shown")]),
        case("p6_boolean_text", "customer", "c_custkey", ["CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS a", "CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b"], lambda: [verdicts.substitution_text(c("a")).alias("allowed"), verdicts.daw_text(c("b")).alias("daw")]),
        case("p7_deferred", "customer", "c_custkey", ["c_custkey % 3 = 0 AS skip", f"{pick('c_custkey', 'a', 'b')} AS x", f"{pick('c_custkey', 'a', 'a', 'b')} AS y"], lambda: [verdicts.deferred(S.ladder((c("x") == c("y"), "green", "exact_match"), (True, "red", "drug_mismatch")), c("skip"))["reason_code"].alias("reason_code")]),
        case("p10_safe_line", "events", "event_id", [f"{pick('event_id', *LINES)} AS line"], lambda: [F.coalesce(requests.safe_line(c("line")), F.lit(False)).alias("safe")]),
        case("p11_redacted", "events", "event_id", [f"{pick('event_id', *FIELD_NAMES)} AS field", "event_type"], lambda: [requests.redacted(c("field"), c("event_type")).alias("shown")]),
        case("p14_rejection", "events", "event_id", [f"{pick('event_id', *FIELD_NAMES)} AS field", f"{pick('event_id', 'green', 'red', 'blue', None)} AS status", "CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 11 = 1 THEN repeat('x', 4001) ELSE event_type END AS correction"], lambda: [R.rejection(c("field"), c("status"), c("correction"), _FIELDS, _PRIVATE).alias("why")]),
        case("p15_usability", "events", "event_id", ["CAST(event_id % 9 AS INT) AS n", "event_id % 2 = 0 AS marked"], lambda: [R.usability(c("n"), c("marked")).alias("usable")]),
        case("p16_marker", "events", "event_id", [f"{pick('event_id', *WORDS)} AS word"], lambda: [R.has_marker(c("word")).alias("marked")]),
        case("p17_title", "events", "event_id", [f"{pick('event_id', *TITLES)} AS title"], lambda: [R.screen(c("title")).alias("mode"), R.order_window(c("title")).alias("kind")]),
        case("p18_short_label", "events", "event_id", [f"{pick('event_id', *MESSAGES)} AS message"], lambda: [R.short_label(c("message")).alias("label")]),
        case("p19_colour", "events", "event_id", [f"{pick('event_id', 'green', 'yellow', 'red')} AS status", f"{pick('event_id', 'not_provided', 'date_mismatch', None, 'unparseable_date', 'x')} AS reason"], lambda: [R.bar_colour(c("status"), c("reason")).alias("colour")]),
        case("p20_box", "events", "event_id", [f"{pick('event_id', 'green', 'yellow', 'green', None)} AS status", f"{pick('event_id', 'DAW checked', 'DAW not checked', None)} AS entered", f"{pick('event_id', 'Substitution allowed', 'Substitution NOT allowed (DAW)', None, 'x', 'y')} AS source"], lambda: [R.shows_box(c("status"), c("entered"), c("source")).alias("box")]),
        case("p22_update", "events", "event_id", [f"{pick('event_id', 'abc12', 'ABC12', 'unknown', '', None, 'ffff')} AS local", f"{pick('event_id', 'abc1234', 'ffff00', ' abc12', None, '')} AS remote"], lambda: [R.update_available(c("local"), c("remote")).alias("newer")]),
        case("p23_key_merge", "events", "event_id", [f"{pick('event_id', *KEYS)} AS provided", f"{pick('event_id', *STATES)} AS state", f"{pick('event_id', 'k1', None, 'k2')} AS existing"], lambda: [R.key_merge(c("provided"), c("state"), c("existing")).alias("decision")]),
        case("s20_sha", "events", "event_id", [f"{pick('event_id', *SHAS)} AS body"], lambda: [R.sha_of(c("body")).alias("sha")]),
        case("h1_key_value", "events", "event_id", [f"{pick('event_id', *VALUES)} AS line"], lambda: [R.key_value(c("line"))["key"].alias("key"), R.key_value(c("line"))["value"].alias("value"), R.last_value(c("line")).alias("last")]),
        case("h2_parentheses", "events", "event_id", [f"{pick('event_id', *VALUES)} AS line"], lambda: [R.in_parentheses(c("line")).alias("inner"), R.before_parentheses(c("line")).alias("before")]),
        case("h3_repaired_digits", "events", "event_id", [f"{pick('event_id', 'O7', 'lO', 'SB', 'l2O', 'Ox', '12', 'OIl1', '5O5O', '', None)} AS v"], lambda: [R.repaired_digits(c("v")).alias("digits")]),
        case("h4_repaired_date", "events", "event_id", [f"{pick('event_id', *MANGLED)} AS v"], lambda: [R.repaired_date(c("v")).alias("loose"), R.repaired_date(c("v"), True).alias("labelled")]),
        case("d4_display_date", "events", "event_id", [f"{pick('event_id', *DATES)} AS v"], lambda: [R.display_date(c("v")).alias("shown")]),
        case("n6_chroma", "events", "event_id", _RGB, lambda: [R.chroma(c("r"), c("g"), c("b")).alias("chroma"), F.round(R.luma(c("r"), c("g"), c("b")), 6).alias("luma")]),
        case("n7_percent", "events", "event_id", ["CAST(event_id % 1000 AS DOUBLE) / 8 AS share"], lambda: [R.percent(c("share")).alias("shown")]),
        case("x7_zero_state", "events", "event_id", [f"{pick('event_id', *CELLS)} AS cell"], lambda: [R.zero_state(c("cell")).alias("state")]),
        case("x8_primary", "supplier", "s_suppkey", [f"{pick('s_suppkey', 'McKesson Corp', 'ANDA', '', None, 'old MCKESSON')} AS name"], lambda: [R.is_primary(c("name")).alias("is_primary")]),
        case("a20_elapsed", "events", "event_id", ["event_id % 100 AS attach", "CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS ocr", "event_id % 7 AS engine"], lambda: [R.elapsed(c("attach"), c("ocr"), c("engine")).alias("total")]),
        case("n5_package", "part", "p_partkey", ["CASE p_partkey % 4 WHEN 0 THEN '1 Stock Package with ' || CAST(p_size AS string) || '.5000' WHEN 1 THEN CAST(p_size AS string) || ' ct' WHEN 2 THEN '2 x ' || CAST(p_size AS string) END AS size"], lambda: [S.package_quantity(c("size")).cast("double").alias("amount")]),
        case("n3_unit", "events", "event_id", [f"{pick('event_id', 'Tablets', 'EA', ' mL', 'drops', 'box', '', None, 'Unspecified', 'Grams')} AS unit"], lambda: [S.unit(c("unit")).alias("unit")]),
        case("n1_number", "events", "event_id", [f"{pick('event_id', '12', ' 1.5 ', '', '1e3', '0x1F', '12d', 'Infinity', None, '.5', '-7', '1e999', '0b101')} AS v"], lambda: [S.number(c("v")).alias("n")]),
        case("k2_strength", "part", "p_partkey", [f"CAST(p_size AS string) || {pick('p_partkey', ' mg tab', 'MCG', ' gel', ' units x', ' unit', '% cream', ' meq', '.5 ml')} AS name"], lambda: [P.stated_strength(c("name")).alias("strength")]),
        case("k3_concentration", "part", "p_partkey", [f"CAST(p_size AS string) || {pick('p_partkey', ' mg/1 ml', 'mg / 5ML', ' mg', ' mgi2 ml', ' units/mlx')} AS name"], lambda: [P.stated_concentration(c("name")).alias("strength")]),
        case("k4_hours", "part", "p_partkey", [f"{pick('p_partkey', 'ER ', '')} || CAST(p_size AS string) || {pick('p_partkey', ' hour', 'hr tab', ' hours', ' h', 'HR')} AS name"], lambda: [P.stated_hours(c("name")).cast("long").alias("hours")]),
    )
}

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_BLANK = lambda x: f"coalesce({_TRIM.format(x)}, '') = ''"
_MONEY = "TRY_CAST(regexp_replace(cell, '[$,()\\s]', '', 'g') AS DECIMAL(18,4))"
_FIX = "translate({0}, 'OolISB', '001158')"
_LIKE = "length(regexp_replace({0}, '[^OolISB]', '', 'g'))"
_NUM = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_DIGITS = lambda x: f"CASE WHEN NOT regexp_matches({x}, '[AC-HJ-NP-RT-Za-kmnp-z]') AND {_LIKE.format(x)} > 0 AND ({_NUM.format(x)} >= {_LIKE.format(x)} OR {_NUM.format(x)} + {_LIKE.format(x)} <= 2) THEN {_FIX.format(x)} ELSE {x} END"
_MARK = {"e": "e", "s": "s", "c": "c", "r": "r", "i": "[1il]", "p": "[dp]", "t": "t"}
_MANGLED = f"(SELECT *, CASE WHEN regexp_full_match(d0, '\\d{{1,4}}[\\s.-]\\d{{1,2}}[\\s.-]\\d{{2,4}}') THEN regexp_replace(d0, '[\\s.-]', '/', 'g') ELSE d0 END AS d FROM (SELECT *, trim(v) AS t, {_DIGITS('trim(v)')} AS d0 FROM ({select('events', ['event_id', f'{pick('event_id', *MANGLED)} AS v'])})))"
_SHAPES = "WHEN regexp_full_match(d, '\\d{1,2}/\\d{1,2}/\\d{3} \\d') THEN replace(d, ' ', '') WHEN regexp_full_match(d, '\\d{1,2}/\\d{6}') THEN regexp_replace(d, '(\\d{4})$', '/\\1') WHEN regexp_full_match(d, '\\d{4}/\\d{4}') THEN d[1:2] || '/' || d[3:]"
_LOOK = "WHEN regexp_full_match(d, '\\d{2}[/lI1|]\\d{2}[/lI1|]\\d{4}') THEN d[1:2] || '/' || d[4:5] || '/' || d[7:]"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(list_last(string_split(text, ' '))), '[a-z0-9]+'), lambda w: length(w) >= CASE WHEN regexp_full_match(w, '[0-9]+') THEN 3 ELSE 2 END))"

SQL = {
    "p3_scalar_text": over("customer", "c_custkey", [f"{pick('c_custkey', '', None, 'x', '12')} AS v", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS n"], "nullif(v, '') AS v, CAST(n AS VARCHAR) AS n"),
    "p4_address_text": over("customer", "c_custkey", _ADDRESS, "nullif(concat_ws(', ', nullif(concat_ws(' Unit ', nullif(street, ''), nullif(unit, '')), ''), nullif(concat_ws(', ', nullif(city, ''), nullif(concat_ws(' ', nullif(state, ''), nullif(zip, '')), '')), '')), '') AS shown"),
    "p5_drug_text": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS shown FROM part",
    "p6_boolean_text": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Substitution NOT allowed (DAW)' WHEN 1 THEN 'Substitution allowed' END AS allowed, CASE c_custkey % 4 WHEN 0 THEN 'DAW checked' WHEN 1 THEN 'DAW not checked' END AS daw FROM customer",
    "p7_deferred": over("customer", "c_custkey", ["c_custkey % 3 = 0 AS skip", f"{pick('c_custkey', 'a', 'b')} AS x", f"{pick('c_custkey', 'a', 'a', 'b')} AS y"], "CASE WHEN skip THEN 'pending_lookup' WHEN x = y THEN 'exact_match' ELSE 'drug_mismatch' END AS reason_code"),
    "p8_in_order": "SELECT c_custkey, c_custkey % 5 > 0 OR c_custkey % 13 = 0 AS in_order, TRUE AS complete FROM customer",
    "p10_safe_line": over("events", "event_id", [f"{pick('event_id', *LINES)} AS line"], "coalesce(regexp_matches(line, '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d\\S* (Timing: |\\[RIGHTCLICK-DIAG\\])') AND NOT (line LIKE '%RIGHTCLICK%' AND line LIKE '%EXCEPTION%'), FALSE) AS safe"),
    "p11_redacted": over("events", "event_id", [f"{pick('event_id', *FIELD_NAMES)} AS field", "event_type"], "CASE WHEN field LIKE 'patient%' THEN '[redacted]' ELSE event_type END AS shown"),
    "p12_fragment_leak": """WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS x FROM conversations),
        g AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, length(x) - 3), lambda i: x[i:i + 4])) AS f FROM t)
        SELECT t.conv_id, t.turn, EXISTS (SELECT 1 FROM g a JOIN g b ON a.f = b.f WHERE a.conv_id = t.conv_id AND b.conv_id = t.conv_id AND a.turn = t.turn - 1 AND b.turn = t.turn) AS leaks FROM t""",
    "p13_scrub": f"""WITH t AS (SELECT conv_id, turn, text, {_TOKENS} AS toks, string_split(text, ' ')[1] AS f, text || ' call 5550100 or x123456y, id ' || CAST(conv_id AS VARCHAR) AS w, '555-0100 123 456 ' || CAST(conv_id AS VARCHAR) AS secret FROM conversations),
        r AS (SELECT *, list_filter(regexp_extract_all(secret, '[0-9]+'), lambda x: length(x) >= 3) AS rs, CASE WHEN trim(f) = '' THEN w ELSE regexp_replace(w, '(?i)' || regexp_escape(f), '[redacted]', 'g') END AS p FROM t),
        n AS (SELECT *, list_filter(flatten(list_transform(range(1, len(rs) + 1), lambda i: [rs[i], rs[i][1:5], rs[i] || coalesce(rs[i + 1], ''), rs[i] || coalesce(rs[i + 1], '') || coalesce(rs[i + 2], '')])), lambda x: length(x) >= 5) AS runs FROM r)
        SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda x: CASE WHEN list_contains(toks, lower(x)) OR (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 5
            AND len(list_filter(runs, lambda q: contains(regexp_replace(x, '[^0-9]', '', 'g'), q))) > 0) THEN '[redacted]' ELSE x END), '') AS scrubbed FROM n""",
    "p14_rejection": over("events", "event_id", [f"{pick('event_id', *FIELD_NAMES)} AS field", f"{pick('event_id', 'green', 'red', 'blue', None)} AS status", "CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 11 = 1 THEN repeat('x', 4001) ELSE event_type END AS correction"],
        "CASE WHEN field IS NULL OR field = 'nonsense' THEN 'unknown_field' WHEN field LIKE 'patient%' THEN 'private_field' WHEN status IS NULL OR status = 'blue' THEN 'unknown_status' WHEN trim(correction) = '' THEN 'no_correction' WHEN length(correction) > 4000 THEN 'too_long' END AS why"),
    "p15_usability": "SELECT event_id, CASE WHEN event_id % 9 < 5 THEN 'TooSparse' WHEN event_id % 2 = 1 THEN 'NotAnEscript' ELSE 'Usable' END AS usable FROM events",
    "p16_marker": over("events", "event_id", [f"{pick('event_id', *WORDS)} AS word"], f"coalesce(regexp_full_match(w, '{''.join(_MARK[x] for x in R.MARKER)}') AND CAST(w[5:5] <> 'i' AS INT) + CAST(w[6:6] <> 'p' AS INT) <= 2, FALSE) AS marked").replace("FROM (SELECT", "FROM (SELECT *, lower(regexp_replace(word, '[^a-zA-Z]+$', '')) AS w FROM (SELECT", 1) + ")",
    "p17_title": over("events", "event_id", [f"{pick('event_id', *TITLES)} AS title"], "CASE WHEN regexp_matches(lower(title), 'pre-?check') THEN 'PreCheck' WHEN contains(lower(title), 'edit rx') THEN 'EditRx' WHEN contains(lower(title), 'new rx') THEN 'NewRx' ELSE 'Unknown' END AS mode, CASE WHEN lower(trim(title)) LIKE 'recommended order - catalog item substitution selection%' THEN 'CatalogSubstitution' WHEN lower(trim(title)) LIKE 'create recommended orders%' THEN 'CreateRecommendedOrders' ELSE 'None' END AS kind"),
    "p18_short_label": over("events", "event_id", [f"{pick('event_id', *MESSAGES)} AS message"], "CASE " + " ".join(f"WHEN starts_with(message, '{p.replace(chr(39), chr(39) * 2)}') THEN '{s}'" for p, s in R.SHORT_LABELS) + " WHEN message IS NULL THEN '' WHEN length(message) <= 14 THEN message ELSE rtrim(message[1:14]) || '…' END AS label"),
    "p19_colour": over("events", "event_id", [f"{pick('event_id', 'green', 'yellow', 'red')} AS status", f"{pick('event_id', 'not_provided', 'date_mismatch', None, 'unparseable_date', 'x')} AS reason"], "CASE status WHEN 'green' THEN 'Green' WHEN 'red' THEN 'Red' ELSE CASE WHEN reason IN ('not_provided', 'unparseable_date', 'unparseable_quantity') THEN 'Gray' ELSE 'Yellow' END END AS colour"),
    "p20_box": over("events", "event_id", [f"{pick('event_id', 'green', 'yellow', 'green', None)} AS status", f"{pick('event_id', 'DAW checked', 'DAW not checked', None)} AS entered", f"{pick('event_id', 'Substitution allowed', 'Substitution NOT allowed (DAW)', None, 'x', 'y')} AS source"], "status IS DISTINCT FROM 'green' OR entered IS NOT DISTINCT FROM 'DAW checked' OR source IS NOT DISTINCT FROM 'Substitution NOT allowed (DAW)' AS box"),
    "p21_stale": "SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 7 AS generation FROM events QUALIFY generation = max(generation) OVER (PARTITION BY user_id)",
    "p22_update": over("events", "event_id", [f"{pick('event_id', 'abc12', 'ABC12', 'unknown', '', None, 'ffff')} AS local", f"{pick('event_id', 'abc1234', 'ffff00', ' abc12', None, '')} AS remote"], "coalesce(local <> '' AND remote <> '' AND local <> 'unknown' AND NOT starts_with(lower(trim(remote)), lower(trim(local))), FALSE) AS newer"),
    "p23_key_merge": over("events", "event_id", [f"{pick('event_id', *KEYS)} AS provided", f"{pick('event_id', *STATES)} AS state", f"{pick('event_id', 'k1', None, 'k2')} AS existing"], "CASE WHEN coalesce(trim(provided), '') = '' THEN 'skip-no-key-provided' WHEN state = 'missing' THEN 'write' WHEN state <> 'object' THEN 'write-with-backup' WHEN existing = provided THEN 'skip-already-matches' ELSE 'write' END AS decision"),
    "s20_sha": over("events", "event_id", [f"{pick('event_id', *SHAS)} AS body"], "CASE WHEN json_valid(body) AND json_type(body, '$.sha') = 'VARCHAR' THEN nullif(json_extract_string(body, '$.sha'), '') END AS sha"),
    "h1_key_value": over("events", "event_id", [f"{pick('event_id', *VALUES)} AS line"], "CASE WHEN contains(line, ': ') THEN line[:position(': ' IN line) - 1] ELSE line END AS key, CASE WHEN contains(line, ': ') THEN line[position(': ' IN line) + 2:] WHEN TRUE THEN '' END AS value, CASE WHEN contains(line, ': ') THEN list_last(string_split(line, ': ')) ELSE '' END AS last"),
    "h2_parentheses": over("events", "event_id", [f"{pick('event_id', *VALUES)} AS line"], "CASE WHEN trim(line) <> '' THEN CASE WHEN regexp_matches(line, '\\(.*\\)') THEN trim(regexp_extract(line, '\\(([^)]*)\\)', 1)) ELSE trim(line) END END AS inner, rtrim(split_part(line, ' (', 1)) AS before"),
    "h3_repaired_digits": over("events", "event_id", [f"{pick('event_id', 'O7', 'lO', 'SB', 'l2O', 'Ox', '12', 'OIl1', '5O5O', '', None)} AS v"], f"{_DIGITS('v')} AS digits"),
    "h4_repaired_date": f"SELECT event_id, CASE {_SHAPES} WHEN d <> t THEN d END AS loose, CASE {_SHAPES} {_LOOK} WHEN d <> t THEN d END AS labelled FROM {_MANGLED}",
    "d4_display_date": over("events", "event_id", [f"{pick('event_id', *DATES)} AS v"], "CASE WHEN regexp_full_match(trim(v), '\\d{4}-\\d\\d-\\d\\d') AND TRY_CAST(trim(v) AS DATE) IS NOT NULL THEN CAST(month(CAST(trim(v) AS DATE)) AS VARCHAR) || '/' || CAST(day(CAST(trim(v) AS DATE)) AS VARCHAR) || '/' || CAST(year(CAST(trim(v) AS DATE)) AS VARCHAR) ELSE v END AS shown"),
    "n6_chroma": over("events", "event_id", _RGB, "greatest(r, g, b) - least(r, g, b) AS chroma, round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b, 6) AS luma"),
    "n7_percent": over("events", "event_id", ["CAST(event_id % 1000 AS DOUBLE) / 8 AS share"], "regexp_replace(CAST(CAST(floor(share * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(share * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR), '\\.0$', '') || '%' AS shown"),
    "x7_zero_state": over("events", "event_id", [f"{pick('event_id', *CELLS)} AS cell"], f"CASE WHEN {_MONEY} IS NULL THEN 'Unknown' WHEN {_MONEY} = 0 THEN 'Zero' ELSE 'NonZero' END AS state"),
    "x8_primary": "SELECT s_suppkey, s_suppkey % 5 IN (0, 4) AS is_primary FROM supplier",
    "a20_elapsed": "SELECT event_id, event_id % 100 + CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE 0 END + event_id % 7 AS total FROM events",
    "n5_package": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size END AS amount FROM part".replace("p_size + 0.5", "CAST(p_size AS DOUBLE) + 0.5").replace("THEN p_size END", "THEN CAST(p_size AS DOUBLE) END"),
    "n3_unit": over("events", "event_id", [f"{pick('event_id', 'Tablets', 'EA', ' mL', 'drops', 'box', '', None, 'Unspecified', 'Grams')} AS unit"], "CASE lower(trim(unit)) WHEN 'tablets' THEN 'tab' WHEN 'drops' THEN 'gtt' WHEN 'grams' THEN 'g' WHEN 'ml' THEN 'ml' WHEN 'box' THEN 'box' END AS unit"),
    "n1_number": over("events", "event_id", [f"{pick('event_id', '12', ' 1.5 ', '', '1e3', '0x1F', '12d', 'Infinity', None, '.5', '-7', '1e999', '0b101')} AS v"], "CASE WHEN trim(v) = '' THEN 0 WHEN v LIKE '0x%' THEN 31 WHEN v LIKE '0b%' THEN 5 WHEN regexp_full_match(trim(v), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[0-9]{1,2})?') THEN CAST(trim(v) AS DOUBLE) END AS n"),
    "k2_strength": over("part", "p_partkey", [f"CAST(p_size AS string) || {pick('p_partkey', ' mg tab', 'MCG', ' gel', ' units x', ' unit', '% cream', ' meq', '.5 ml')} AS name"], "CASE WHEN regexp_matches(name, '(?i)\\d\\s*(mcg|mg|ml|g|units?)\\b') THEN regexp_extract(name, '(?i)(\\d+(?:\\.\\d+)?)\\s*(mcg|mg|ml|g|units?)\\b', 1) || regexp_replace(lower(regexp_extract(name, '(?i)(\\d+(?:\\.\\d+)?)\\s*(mcg|mg|ml|g|units?)\\b', 2)), '^units$', 'unit') END AS strength"),
    "k3_concentration": over("part", "p_partkey", [f"CAST(p_size AS string) || {pick('p_partkey', ' mg/1 ml', 'mg / 5ML', ' mg', ' mgi2 ml', ' units/mlx')} AS name"], "CASE p_partkey % 5 WHEN 0 THEN CAST(split_part(name, ' ', 1) AS VARCHAR) || 'mg/1ml' WHEN 1 THEN split_part(name, 'mg', 1) || 'mg/5ml' WHEN 3 THEN split_part(name, ' ', 1) || 'mg/2ml' END AS strength"),
    "k4_hours": over("part", "p_partkey", [f"{pick('p_partkey', 'ER ', '')} || CAST(p_size AS string) || {pick('p_partkey', ' hour', 'hr tab', ' hours', ' h', 'HR')} AS name"], "CASE WHEN regexp_matches(name, '(?i)\\b\\d+\\s*(hour|hr)\\b') THEN CAST(regexp_extract(name, '(?i)\\b(\\d+)\\s*(hour|hr)\\b', 1) AS BIGINT) END AS hours"),
    "u1_same_set": "SELECT p_partkey, TRUE AS itself, list_sort(list_distinct(regexp_split_to_array(lower(p_name), ''))) = list_sort(list_distinct(regexp_split_to_array(lower(p_type), ''))) AS other, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(p_name), ''), lambda x: NOT list_contains(regexp_split_to_array(lower(p_type), ''), x)), list_filter(regexp_split_to_array(lower(p_type), ''), lambda x: NOT list_contains(regexp_split_to_array(lower(p_name), ''), x))))), '') AS only FROM part",
    "u2_one_each": "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), p_brand) THEN NULL ELSE 'x' END AS a, CASE WHEN list_contains(string_split(p_name, ' '), p_brand) THEN NULL ELSE p_brand END AS b FROM part",
    "a7_inverted": "SELECT p_name, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1",
    "a10_group_sizes": "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "a13_upper_median": "SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT)))[count(*) // 2 + 1] AS q FROM lineitem GROUP BY 1",
    "a14_share": """SELECT l_orderkey, round(avg(CASE WHEN abs(q - m) <= 12 THEN 1.0 ELSE 0 END), 6) AS share, avg(CASE WHEN abs(q - m) <= 12 THEN 1.0 ELSE 0 END) >= 0.6 AS plain FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
        JOIN (SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT)))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY 1""",
    "a15_box": "SELECT user_id, min(value) AS left, min(CAST(hour(ts) AS DOUBLE)) AS top, max(value + 10) AS right, max(CAST(hour(ts) + 1 AS DOUBLE)) AS bottom FROM events GROUP BY 1",
    "a19_any_none": "SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, NOT bool_or(event_type = 'error') AS no_error FROM events GROUP BY 1",
}
