"""Queries of lookups, grids, sequences and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions import scalars as S
from lumenpair.functions import vocabulary as V
from lumenpair.operators import grid, lookup, sequence
from lumenpair.plans.rules import pick
from lumenpair.plans.tables import derived, select, table
from lumenpair.sources import requests

GRID = ["l_orderkey", "l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS row_id", "l_suppkey % 7 = 0 AS is_primary", "CAST(l_extendedprice AS decimal(18,2)) AS cost", "CAST(l_quantity * 25 AS decimal(18,4)) AS amount"]
EVENTS = ["event_id", "user_id", "event_type", "CAST(ts AS timestamp) AS ts", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + dayofyear(ts) * 86400 AS double) AS x", "CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS signal"]
MORE = ["p_partkey", "CASE WHEN p_partkey % 11 = 0 THEN p_type ELSE upper(p_name) || ' ' || CAST(p_size % 4 AS string) || ' MG tab' END AS full_name"]
KEYS = ["CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) END AS one", "CASE WHEN p_partkey % 5 = 0 THEN p_name END AS two", "CASE WHEN p_partkey % 7 = 0 THEN p_name || ' ' || CAST(p_size % 4 AS string) || ' mg' END AS four"]
SOME = ("bill", "william", "liam", "ted", "edward", "theodore", "chris", "christine", "christopher", "tina", "ann", "pat", "patricia")
NAMES = ["p_partkey", "p_type", "split_part(p_name, ' ', 1) AS short_key"]


def x9_savings(spark, d):
    return grid.savings(derived(spark, d, "lineitem", GRID), "l_orderkey", "row_id", F.col("is_primary"), "cost")


def x10_best_per_class(spark, d):
    return grid.best_per_class(derived(spark, d, "lineitem", GRID), "l_orderkey", "row_id", grid.package_class(F.col("amount")), "cost")


def x11_sort_state(spark, d):
    return grid.sort_state(derived(spark, d, "lineitem", GRID), "l_orderkey", ["row_id", "cost"], "cost")


def w3_gap_islands(spark, d):
    return sequence.gap_islands(derived(spark, d, "events", EVENTS), "user_id", ["x", "event_id"], F.col("x"), 3600.0).groupBy("user_id").agg((F.max("island") + 1).cast("long").alias("islands"))


def w4_cover_islands(spark, d):
    return sequence.cover_islands(derived(spark, d, "events", EVENTS), "user_id", ["x", "event_id"], F.col("x"), F.col("x") + 5000).select("event_id", F.col("island").cast("long").alias("island"))


def w2_pitch(spark, d):
    return sequence.pitch(derived(spark, d, "events", EVENTS), "user_id", ["x", "event_id"], F.col("x"))


def w7_midpoints(spark, d):
    return sequence.midpoints(derived(spark, d, "events", EVENTS), "user_id", ["x", "event_id"], F.col("x"), F.col("x") + 60).select("event_id", "lo", "hi")


def w12_changes(spark, d):
    return sequence.changes(derived(spark, d, "events", EVENTS), "user_id", ["x", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def j14_interval_join(spark, d):
    rows = derived(spark, d, "events", EVENTS)
    hours = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("x").alias("lo"), (F.col("x") + 7200).alias("hi"))
    return sequence.in_interval(rows.select("event_id", "user_id", "x"), hours, "user_id", "x", "lo", "hi").select("event_id", "purchase_id")


def z3_debounce(spark, d):
    return sequence.debounce(derived(spark, d, "events", EVENTS), "user_id", ["x"], "signal", "event_id")


def a21_signature(spark, d):
    rows = derived(spark, d, "lineitem", ["l_orderkey", "CAST(l_linenumber AS string) || ':' || l_returnflag AS part"])
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("part")), "+").alias("signature"))


def j5_longest_prefix(spark, d):
    """Names of up to five words, with keys of one, two and four words."""
    keys = derived(spark, d, "part", KEYS)
    dimension = keys.select(F.explode(F.array("one", "two", "four")).alias("name_key")).filter("name_key IS NOT NULL").distinct()
    return lookup.longest_prefix(derived(spark, d, "part", MORE), "full_name", dimension, "name_key").select("p_partkey", "name_key")


def j7_elided(spark, d):
    """A name whose first word lost a letter finds its key; the other words stay."""
    dimension = derived(spark, d, "part", ["lower(replace(p_name, ' ', '')) || ' ' || lower(p_type) AS name_key"]).distinct()
    misses = derived(spark, d, "part", ["p_partkey", "left(replace(p_name, ' ', ''), length(replace(p_name, ' ', '')) - 1) || ' ' || p_type AS q"])
    return lookup.elided(misses, "q", dimension, "name_key").select("p_partkey", "resolved")


def a6_value_sets(spark, d):
    return lookup.value_sets(table(spark, d, "part"), "p_name", "p_type").select("p_name", F.array_join("values", "|").alias("types"))


def a8_first_wins(spark, d):
    return lookup.first_wins(table(spark, d, "part"), "p_name", "p_partkey", "p_type", "p_size")


def a4_unambiguous(spark, d):
    return lookup.unambiguous(table(spark, d, "part"), "p_name", "p_type")


def s11_latest_link(spark, d):
    return requests.latest_link(table(spark, d, "pages"), "page_id", "html", r"<!-- ad (\d+) -->")


def s3_requests(spark, d):
    rows = derived(spark, d, "events", ["event_id", "CASE event_id % 4 WHEN 0 THEN '{\"entered\": {}, \"source\": ' || props || '}' WHEN 1 THEN '{\"source\": ' || props || '}' WHEN 2 THEN '{\"entered\": ' || props || '}' ELSE '{oops' END AS line"])
    return rows.select("event_id", requests.request_error(F.col("line")).alias("error"))


def t8_levenshtein(spark, d):
    return lookup.near_names(table(spark, d, "part"), "p_name", 4).withColumn("distance", F.col("distance").cast("long"))


def j10_nicknames(spark, d):
    names = derived(spark, d, "events", ["event_id", f"{pick('event_id', *SOME)} AS a", f"{pick('floor(event_id / 13)', *SOME)} AS b"])
    return names.select("event_id", F.arrays_overlap(S.canonicals(F.col("a")), S.canonicals(F.col("b"))).alias("alike"))


def n4_currency(spark, d):
    rows = derived(spark, d, "supplier", ["s_suppkey", "CASE WHEN s_acctbal < 0 THEN '($' || CAST(CAST(-s_acctbal AS decimal(12,2)) AS string) || ')' WHEN s_suppkey % 5 = 0 THEN ' ' ELSE '$' || CAST(CAST(s_acctbal AS decimal(12,2)) AS string) END AS money"])
    return rows.select("s_suppkey", S.currency(F.col("money")).cast("double").alias("amount"))


_G, _E = f"({select('lineitem', GRID)})", f"({select('events', EVENTS)})"
_P = r"<!-- ad (\d+) -->"
QUERIES = {f.__name__: f for f in (x9_savings, x10_best_per_class, x11_sort_state, w3_gap_islands, w4_cover_islands, w2_pitch, w7_midpoints, w12_changes, j14_interval_join, z3_debounce, a21_signature, j5_longest_prefix, j7_elided, a6_value_sets, a8_first_wins, a4_unambiguous, s11_latest_link, s3_requests, t8_levenshtein, j10_nicknames, n4_currency)}
SQL = {
    "x9_savings": f"""SELECT l_orderkey, row_id, round(CAST(base - cost AS DOUBLE) / CAST(base AS DOUBLE) * 100, 6) AS savings_percent, CASE WHEN (base - cost) * 4 >= base THEN 'AboveThreshold' ELSE 'BelowThreshold' END AS tier
        FROM (SELECT *, min(cost) FILTER (is_primary) OVER (PARTITION BY l_orderkey) AS base FROM {_G}) WHERE NOT is_primary AND base > 0 AND cost < base""",
    "x10_best_per_class": f"SELECT l_orderkey, CASE WHEN amount >= 500 THEN 'Large' ELSE 'Small' END AS class, arg_min(row_id, row(cost, row_id)) AS row_id FROM {_G} WHERE amount > 0 AND cost IS NOT NULL GROUP BY 1, 2",
    "x11_sort_state": f"""SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'Unknown' WHEN bool_or(down) THEN 'NotSorted' ELSE 'Sorted' END AS state
        FROM (SELECT l_orderkey, cost < lag(cost) OVER (PARTITION BY l_orderkey ORDER BY row_id, cost) AS down FROM {_G}) GROUP BY 1""",
    "w3_gap_islands": f"SELECT user_id, 1 + count(*) FILTER (gap > 3600) AS islands FROM (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) AS gap FROM {_E}) GROUP BY 1",
    "w4_cover_islands": f"""SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, CASE WHEN x >= max(x + 5000) OVER
        (PARTITION BY user_id ORDER BY x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM {_E})""",
    "w2_pitch": f"SELECT user_id, median(gap) AS pitch FROM (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) AS gap FROM {_E}) GROUP BY 1",
    "w7_midpoints": f"""SELECT event_id, coalesce((x + lag(x) OVER w) / 2 + 30, x - 60) AS lo, coalesce((x + lead(x) OVER w) / 2 + 30, x + 120) AS hi FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)""",
    "w12_changes": f"SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY x, event_id) AS p FROM {_E}) WHERE p IS DISTINCT FROM event_type",
    "j14_interval_join": f"SELECT e.event_id, p.event_id AS purchase_id FROM {_E} e JOIN {_E} p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND e.x >= p.x AND e.x < p.x + 7200",
    "a21_signature": "SELECT l_orderkey, string_agg(p, '+' ORDER BY p) AS signature FROM (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag AS p FROM lineitem) GROUP BY 1",
    "j5_longest_prefix": f"""WITH K AS (SELECT DISTINCT unnest([one, two, four]) AS k FROM ({select('part', KEYS)})) SELECT p_partkey, (SELECT arg_max(k, length(k)) FROM K WHERE starts_with(lower(full_name) || ' ', k || ' ')) AS name_key FROM ({select('part', MORE)})""",
    "j7_elided": """WITH k AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS w, lower(p_type) AS t FROM part), o AS (SELECT w[:-2] AS s, t, CASE WHEN count(*) = 1 THEN max(w || ' ' || t) END AS r FROM k GROUP BY 1, 2)
        SELECT p_partkey, r AS resolved FROM (SELECT p_partkey, lower(replace(p_name, ' ', ''))[:-2] AS q, lower(p_type) AS t FROM part) p LEFT JOIN o ON q = s AND o.t = p.t AND r IS NOT NULL AND length(q) >= 8""",
    "j10_nicknames": f"""WITH G AS (SELECT * FROM (VALUES {', '.join(f"('{g.partition(':')[0].strip()}', '{w}')" for g in ''.join(V.NICKNAMES).split(';') for w in g.replace(':', ' ').split())}) t(c, w))
        SELECT event_id, a = b OR EXISTS (SELECT 1 FROM G x JOIN G y ON x.c = y.c WHERE x.w = a AND y.w = b) AS alike FROM ({select('events', ['event_id', f"{pick('event_id', *SOME)} AS a", f"{pick('floor(event_id / 13)', *SOME)} AS b"])})""",
    "z3_debounce": f"""WITH RECURSIVE T AS (SELECT user_id, event_id, signal, row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) AS n FROM {_E}),
        R AS (SELECT user_id, n, event_id, signal AS shown, '' AS pending, 0 AS streak, CASE WHEN signal = '' THEN 'Clear' ELSE 'Display' END AS decision FROM T WHERE n = 1 UNION ALL
        SELECT T.user_id, T.n, T.event_id, CASE WHEN done THEN T.signal ELSE shown END, CASE WHEN done THEN '' ELSE T.signal END, CASE WHEN done THEN 0 ELSE again END, CASE WHEN NOT done THEN 'Processing' WHEN T.signal = '' THEN 'Clear' ELSE 'Display' END
        FROM (SELECT R.*, T.signal AS s, CASE WHEN T.signal = pending AND streak > 0 THEN streak + 1 ELSE 1 END AS again, T.signal = shown OR shown = '' OR (T.signal = pending AND streak > 0) AS done FROM R JOIN T ON T.user_id = R.user_id AND T.n = R.n + 1) q JOIN T ON T.user_id = q.user_id AND T.n = q.n + 1)
        SELECT user_id, event_id, decision, shown FROM R""",
    "a6_value_sets": "SELECT p_name, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1",
    "a8_first_wins": "SELECT p_name, arg_min(p_type, p_partkey) AS p_type, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY 1",
    "a4_unambiguous": "SELECT p_name, CASE WHEN count(DISTINCT p_type) = 1 THEN max(p_type) END AS p_type FROM part GROUP BY 1",
    "s11_latest_link": f"""SELECT page_id, arg_max(link, row(CAST(regexp_extract(link, '{_P}', 1) AS BIGINT), link)) AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_P}')) AS link FROM pages) GROUP BY 1""",
    "s3_requests": """SELECT event_id, CASE WHEN NOT json_valid(line) THEN 'invalid_json' WHEN json_extract(line, '$.entered') IS NULL THEN 'missing_entered' WHEN json_extract(line, '$.source') IS NULL AND json_extract(line, '$.ocr') IS NULL THEN 'missing_source' END AS error
        FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"entered": {}, "source": ' || props || '}' WHEN 1 THEN '{"source": ' || props || '}' WHEN 2 THEN '{"entered": ' || props || '}' ELSE '{oops' END AS line FROM events)""",
    "t8_levenshtein": "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 4",
    "n4_currency": "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 AND s_suppkey % 5 = 0 THEN NULL ELSE CAST(CAST(s_acctbal AS decimal(12,2)) AS DOUBLE) END AS amount FROM supplier",
}
