"""Queries of label trees, signals, requests, captures and sinks' lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.functions import scalars as S
from lumenpair.operators import capture, signals, tree
from lumenpair.operators.verdicts import RECORD
from lumenpair.plans.rules import pick
from lumenpair.plans.tables import derived, select, table
from lumenpair.sources import requests, sinks
from lumenpair.streaming.ticks import served

c = F.col
SAMPLES = ["user_id", "event_id", "event_id % 5 < 4 AS over", "CAST(floor(event_id % 400 / 100.0) AS BIGINT) AS spot", "event_id * 37 % 200 + 20 AS elapsed", "event_id % 6 < 2 AS down", "event_id % 9 = 0 AS dialog"]
READS = ["user_id", "event_id", f"{pick('event_id', 'a', '', ' ', None, 'b')} AS one", "event_id % 7 = 0 AS threw", f"{pick('event_id', 'x', 'y', '')} AS two"]
WINDOWS = ["user_id", "event_id", "CAST(floor(event_id / 200) AS BIGINT) AS win", "CASE WHEN event_id % 4 > 1 THEN event_type END AS value"]
REQUESTS = ["event_id", f"{pick('event_id', '{"id": "1", "entered": {"sig": "x"}, "source": {"sig": "y", "refills": "2"}}', '{"id": 2, "entered": {}, "ocr": [{"text": "a", "x": 1}], "skipDrugLookup": true}', '{"entered": {}}', '{"id": "9", "source": {}}', '{oops', '[1]', '  ')} AS line"]
QUEUE = ["event_id", f"{pick('event_id', '{"a": 1, "b": "x"}', '{"a": 2}', 'broken', '[1]', '', '{"b": "y", "z": 0}')} AS line"]
LOG = ["event_id", "user_id", "event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) % 2 AS string) AS line"]


def nodes(spark, d):
    nation = derived(spark, d, "nation", ["n_regionkey AS doc", "n_nationkey + 100 AS node", "n_regionkey AS parent", "n_nationkey AS ordinal", f"{pick('n_nationkey', 'Body', 'Note', 'Body')} AS name"])
    supplier = derived(spark, d, "supplier", ["s_nationkey", "s_suppkey + 1000 AS node", "s_nationkey + 100 AS parent", "s_suppkey AS ordinal", f"{pick('s_suppkey', 'Refills: ', 'Phone: ', 'Total fills: ', 'Phone: ')} || {pick('s_suppkey', '', '1', '2 (incl.)', ' ', '3: 4')} AS name"])
    return nation.unionByName(supplier.join(table(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), c("n_regionkey").alias("doc")), "s_nationkey").select("doc", "node", "parent", "ordinal", "name"))


def regions(spark, d):
    return derived(spark, d, "region", ["r_regionkey AS doc", "r_regionkey AS node"])


def j19_child(spark, d):
    return tree.child(nodes(spark, d), regions(spark, d), "Body").select("doc", "node")


def j19_leaf(spark, d):
    return tree.leaf(nodes(spark, d), derived(spark, d, "nation", ["n_regionkey AS doc", "n_nationkey + 100 AS node"]), "Phone").select("parent", "value")


def j20_descendant(spark, d):
    return tree.first_descendant(nodes(spark, d), regions(spark, d), c("name").startswith("Total fills")).select("doc", "node", "name")


def s12_refills(spark, d):
    """Each nation's refills: of its own leaf, else of one with all fills."""
    rows = nodes(spark, d).filter("node >= 1000")
    first = lambda p, name: rows.filter(c("name").startswith(p)).groupBy("parent").agg(F.min(F.struct("ordinal", "name")).alias("_b")).select("parent", c("_b.name").alias(name))
    both = rows.select("parent").distinct().join(first("Refills", "own"), "parent", "left").join(first("Total fills", "total"), "parent", "left")
    return both.withColumn("r", tree.refills(c("own"), c("total"))).select("parent", "r.value", "r.from_total")


def z5_clicks(spark, d):
    return signals.clicks(derived(spark, d, "events", SAMPLES), "user_id", ["event_id"]).select("event_id", "click")


def z4_dwell(spark, d):
    return signals.dwell(signals.clicks(derived(spark, d, "events", SAMPLES), "user_id", ["event_id"]), "user_id", ["event_id"]).select("event_id", "action")


def z9_retried(spark, d):
    return signals.retried(derived(spark, d, "events", READS), "user_id", ["event_id"], "one", "threw", "two").select("event_id", c("read").alias("value"))


def z10_cached(spark, d):
    return signals.cached(derived(spark, d, "events", WINDOWS), "user_id", ["event_id"], "win", "value").select("event_id", "kept")


def s2_requests(spark, d):
    rows = requests.parsed(derived(spark, d, "events", REQUESTS), "line", RECORD)
    return rows.select("event_id", "id", "error", c("source.refills").alias("refills"), c("ocr")[0]["text"].alias("word"), "skip")


def z1_served(spark, d):
    return served(derived(spark, d, "events", REQUESTS).select(c("line").alias("value"))).groupBy("id", "error").agg(F.count(F.lit(1)).alias("n"))


def s14_json(spark, d):
    return derived(spark, d, "customer", ["c_custkey", "c_name", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment"]).select("c_custkey", sinks.as_json("c_name", "segment").alias("body"))


def s17_readable(spark, d):
    return sinks.readable(derived(spark, d, "events", QUEUE), "line", "a long, b string").select("event_id", "a", "b")


def s19_logged(spark, d):
    return sinks.logged(derived(spark, d, "events", LOG), "user_id", ["event_id"], "line", 120).select("event_id", "line")


CAPTURES = ["o_orderkey", "o_orderkey % 4 AS k", "CAST(o_orderkey % 90 + 10 AS string) AS n", "CAST(month(o_orderdate) AS string) || '/' || CAST(day(o_orderdate) AS string) || '/' || CAST(year(o_orderdate) AS string) AS day"]


def capture_words(spark, d):
    """Each order drawn as a record on a screen: labels beside their values, or above them in a block, with a toolbar, and now and then a letter wrong."""
    rows = derived(spark, d, "orders", CAPTURES)
    labels = ["Patient", "DOB", "Quantity", "Refills", "Directions"]
    values = [F.lit("Roe, Jamie"), c("day"), F.concat(c("n"), F.lit(" EA")), F.when(c("k") == 1, "l").otherwise("2"), F.concat(F.lit("TAKE "), F.lit("1 TAB PO"))]
    block = c("k") == 2
    out = []
    for i, (name, value) in enumerate(zip(labels, values)):
        shown = F.when(c("k") == 3, F.lit(name.replace("n", "m"))).otherwise(name)
        out.append(F.struct(F.concat(shown, F.when(block, "").otherwise(":")).alias("text"), F.lit(0.0).alias("x"), F.lit(100.0 + 20 * i).alias("y")))
        for j in range(2):
            part = F.try_element_at(F.split(value, " ", 2), F.lit(j + 1))
            out.append(F.struct(part.alias("text"), F.when(block, 90.0 * j).otherwise(90.0 * (j + 1)).alias("x"), F.when(block, 300.0 + 20 * i).otherwise(100.0 + 20 * i).alias("y")))
    tools = [F.struct(F.lit(t).alias("text"), F.lit(90.0 * j).alias("x"), F.lit(0.0).alias("y")) for j, t in enumerate(("Dispense", "Image", "Workflow"))]
    drawn = rows.select(c("o_orderkey").alias("capture"), F.posexplode(F.array(*tools, *out)).alias("word", "v")).select("capture", "word", "v.*").filter("text IS NOT NULL")
    return drawn.withColumns({"w": F.lit(80.0), "h": F.lit(18.0)})


def e11_records(spark, d):
    rows = capture.records(capture_words(spark, d))
    return rows.select("capture", c("record.patientName").alias("name"), S.parse_date(c("record.patientDOB")).alias("dob"), c("record.quantity").alias("quantity"), c("record.refills").alias("refills"), c("record.sig").alias("sig"), F.size(F.filter("diagnostics", lambda n: n["status"] == "miss")).cast("long").alias("misses"))


_N = f"""N AS ({select('nation', ["n_regionkey AS doc", "n_nationkey + 100 AS node", "n_regionkey AS parent", "n_nationkey AS ordinal", f"{pick('n_nationkey', 'Body', 'Note', 'Body')} AS name"])} UNION ALL SELECT n_regionkey, s_suppkey + 1000, s_nationkey + 100, s_suppkey,
    {pick('s_suppkey', 'Refills: ', 'Phone: ', 'Total fills: ', 'Phone: ')} || {pick('s_suppkey', '', '1', '2 (incl.)', ' ', '3: 4')} FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_C = f"C AS (SELECT *, down AND NOT coalesce(lag(down) OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AND over AND NOT dialog AS click FROM ({select('events', SAMPLES).replace(' AS over', ' AS \"over\"')}))".replace("AND over AND", 'AND "over" AND')

QUERIES = {q.__name__: q for q in (j19_child, j19_leaf, j20_descendant, s12_refills, z5_clicks, z4_dwell, z9_retried, z10_cached, s2_requests, z1_served, s14_json, s17_readable, s19_logged, e11_records)}
SQL = {
    "j19_child": f"WITH {_N} SELECT doc, arg_min(node, ordinal) AS node FROM N WHERE name = 'Body' AND parent = doc AND node < 1000 GROUP BY 1",
    "j19_leaf": f"WITH {_N} SELECT parent, nullif(trim(arg_min(substr(name, 8), ordinal)), '') AS value FROM N WHERE starts_with(name, 'Phone: ') GROUP BY 1",
    "j20_descendant": f"WITH RECURSIVE {_N}, R AS (SELECT r_regionkey AS doc, r_regionkey AS cur, [0::BIGINT] AS path, '' AS name FROM region UNION ALL SELECT R.doc, N.node, list_append(path, CAST(N.ordinal AS BIGINT)), N.name FROM R JOIN N ON N.doc = R.doc AND N.parent = R.cur AND (N.node < 1000) = (len(path) = 1)) SELECT doc, CAST(arg_min(cur, path) AS BIGINT) AS node, arg_min(name, path) AS name FROM R WHERE starts_with(name, 'Total fills') GROUP BY 1",
    "s12_refills": f"""WITH {_N}, A AS (SELECT parent, arg_min(name, ordinal) FILTER (starts_with(name, 'Refills')) AS own, arg_min(name, ordinal) FILTER (starts_with(name, 'Total')) AS total FROM N WHERE node >= 1000 GROUP BY 1)
        SELECT parent, nullif(trim(CASE WHEN own IS NOT NULL THEN list_last(string_split(own, ': ')) ELSE split_part(list_last(string_split(total, ': ')), ' (', 1) END), '') AS value, CASE WHEN own IS NOT NULL THEN FALSE WHEN total IS NOT NULL THEN TRUE END AS from_total FROM A""",
    "z5_clicks": f"WITH {_C} SELECT event_id, click FROM C",
    "z4_dwell": f"""WITH {_C}, P AS (SELECT *, CASE WHEN "over" THEN spot END AS place FROM C), F AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR place IS DISTINCT FROM lag(place) OVER w THEN 1 ELSE 0 END AS fresh FROM P WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        S AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stay FROM F), T AS (SELECT *, sum(CASE WHEN fresh = 1 THEN 0 ELSE elapsed END) OVER (PARTITION BY user_id, stay ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM S),
        U AS (SELECT *, "over" AND t >= 250 AS late, coalesce(lag(t) OVER (PARTITION BY user_id, stay ORDER BY event_id), 0) < 250 AS early, max(CASE WHEN "over" AND t >= 250 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, stay) AS ever FROM T)
        SELECT event_id, CASE WHEN click OR (fresh = 1 AND coalesce(lag(ever) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 1) THEN 'Hide' WHEN late AND early THEN 'Show' ELSE 'None' END AS action FROM U""",
    "z9_retried": f"""SELECT event_id, CASE WHEN threw OR (coalesce(trim(one), '') = '' AND coalesce(max(CASE WHEN NOT threw AND trim(one) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) THEN two ELSE one END AS value FROM ({select('events', READS)})""",
    "z10_cached": f"SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id, win ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kept FROM ({select('events', WINDOWS)})",
    "s2_requests": f"""SELECT event_id, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.id') END AS id, e AS error, CASE WHEN e IS NULL AND json_valid(line) THEN json_extract_string(line, '$.source.refills') END AS refills, CASE WHEN e IS NULL AND json_valid(line) THEN json_extract_string(line, '$.ocr[0].text') END AS word,
        coalesce(CASE WHEN json_valid(line) AND e IS NULL THEN CAST(json_extract(line, '$.skipDrugLookup') AS BOOLEAN) END, FALSE) AS skip FROM (SELECT *, CASE WHEN trim(line) = '' THEN NULL WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN 'invalid_json' WHEN json_extract(line, '$.entered') IS NULL THEN 'missing_entered'
        WHEN json_extract(line, '$.source') IS NULL AND json_extract(line, '$.ocr') IS NULL THEN 'missing_source' END AS e FROM ({select('events', REQUESTS)}))""",
    "z1_served": f"""SELECT CASE WHEN json_valid(line) THEN json_extract_string(line, '$.id') END AS id, CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN 'invalid_json' WHEN json_extract(line, '$.entered') IS NULL THEN 'missing_entered' WHEN json_extract(line, '$.source') IS NULL AND json_extract(line, '$.ocr') IS NULL THEN 'missing_source' END AS error,
        count(*) AS n FROM ({select('events', REQUESTS)}) WHERE trim(line) <> '' GROUP BY 1, 2""",
    "s14_json": "SELECT c_custkey, '{\"c_name\":\"' || c_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"segment\":\"' || c_mktsegment || '\"' ELSE '' END || '}' AS body FROM customer",
    "s17_readable": f"SELECT event_id, CAST(json_extract(line, '$.a') AS BIGINT) AS a, json_extract_string(line, '$.b') AS b FROM ({select('events', QUEUE)}) WHERE json_valid(line) AND json_type(line) = 'OBJECT'",
    "s19_logged": f"""WITH L AS ({select('events', LOG)}), F AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM L) WHERE line IS DISTINCT FROM p), P AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1) // 120 AS part FROM F)
        SELECT event_id, line FROM (SELECT *, max(part) OVER (PARTITION BY user_id) AS last FROM P) WHERE part = last""",
    "e11_records": f"""SELECT o_orderkey AS capture, 'Roe, Jamie' AS name, strftime(o_orderdate, '%Y-%m-%d') AS dob, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS quantity, CASE WHEN o_orderkey % 4 = 1 THEN '1' ELSE '2' END AS refills, 'TAKE 1 TAB PO' AS sig, 10::BIGINT AS misses FROM orders""",
}
