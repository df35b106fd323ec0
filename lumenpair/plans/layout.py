"""Queries of words and boxes, over captures that the tables' rows are drawn as, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpair.operators import layout, sequence
from lumenpair.plans.rules import pick
from lumenpair.plans.tables import derived, select, table

c = F.col
#: A user's events as words: one for each, in a grid of hours and minutes.
EVENT_WORDS = [
    "user_id AS capture", "event_id AS word", "CASE WHEN event_id % 31 = 0 THEN ' ' ELSE event_type END AS text", "CAST(minute(ts) * 40 + second(ts) AS double) AS x", "CAST(hour(ts) * 10 + event_id % 3 AS double) AS y",
    "CAST(20 + event_id % 5 * 10 AS double) AS w", "CAST(5 + event_id % 4 AS double) AS h",
]
#: An order's lines, numbered from 0, as the rows of a table of offers.
OFFERS = (
    "SELECT l_orderkey AS capture, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS line, CASE l_suppkey % 3 WHEN 0 THEN 'McKesson' WHEN 1 THEN 'ANDA' ELSE '' END AS supplier, "
    "CASE WHEN l_suppkey % 10 = 9 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS cost, CAST(l_quantity AS INT) * 25 AS amount FROM lineitem"
)
BARS = ["user_id", "CAST(event_id % 3 * 50 AS double) AS x", "20.0 AS width", "CAST(hour(ts) * 10 AS double) AS y", "CAST(5 + event_id % 7 AS double) AS height"]


def event_words(spark, d):
    return derived(spark, d, "events", EVENT_WORDS)


def offer_rows(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_offer_lines")
    return spark.sql(OFFERS.replace("FROM lineitem", "FROM _offer_lines"))


def offer_words(spark, d):
    """Each order's lines drawn as a table: a title, a header, of every seventh order in two rows and of every fifth with a letter wrong, and a row for each line."""
    rows = offer_rows(spark, d)
    number = lambda col: col.cast("double")

    def word(text, x, y, w):
        return F.struct(F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(float(x)).alias("x"), (F.lit(float(y)) if isinstance(y, (int, float)) else y).alias("y"), F.lit(float(w)).alias("w"), F.lit(12.0).alias("h"))

    two = c("capture") % 7 == 0
    high = F.when(two, 34.0).otherwise(20.0)
    head = (
        word("Offers", 10, 0, 50), word(F.when(c("capture") % 5 == 0, "Supplyer").otherwise("Supplier"), 10, 20, 60), word("Rebate", 200, 20, 45), word("Cost/Unit", 200, high, 60).withField("x", F.when(two, 200.0).otherwise(250.0)),
        word("Shipping", 400, 20, 60), word("Size", 470, 20, 30),
    )
    y = 60.0 + number(c("line")) * 20
    own = (word(c("supplier"), 10, y, 60), word(c("cost"), 205, y, 60), word(F.concat(F.lit("with "), c("amount").cast("string"), F.lit(".0")), 405, y, 90))
    of_line = [F.struct((100 + c("line") * 3 + i).cast("long").alias("word"), v.alias("v")) for i, v in enumerate(own)]
    of_head = [F.struct(F.lit(i).cast("long").alias("word"), v.alias("v")) for i, v in enumerate(head)]
    drawn = rows.select("capture", F.explode_outer(F.when(c("line") == 0, F.array(*of_head, *of_line)).otherwise(F.array(*of_line))).alias("_w"))
    return drawn.select("capture", "_w.word", "_w.v.*")


def x1_rows(spark, d):
    return layout.table_rows(event_words(spark, d)).select("word", c("row").cast("long").alias("row"))


def x2_data_rows(spark, d):
    return layout.data_rows(layout.table_rows(offer_words(spark, d))).select("capture", c("row").cast("long").alias("row"), "is_data")


LABELS = [layout.SUPPLIER, layout.COST]


def a18_label_scores(spark, d):
    return layout.header_candidates(layout.table_rows(offer_words(spark, d)), LABELS).select("capture", c("start").cast("long").alias("start"), c("span").cast("long").alias("span"), c("score").cast("long").alias("score"))


def x3_header(spark, d):
    heads = layout.header(layout.candidates(layout.pages(layout.table_rows(offer_words(spark, d))), LABELS))
    return heads.select("capture", *[c(f"head.{k}").cast("long").alias(k) for k in ("start", "span", "score")], "head.top", "head.bottom")


def x4_columns(spark, d):
    return layout.columns(event_words(spark, d), ["capture"]).select("capture", c("column").cast("long").alias("column"), "label", "left", "right", "lo", "hi")


def x5_resolved(spark, d):
    return layout.resolved(layout.table_of(offer_words(spark, d), LABELS), "rebate  COST/unit").select("capture", c("column").cast("long").alias("column"), "label")


def x6_cells(spark, d):
    return layout.cells(layout.table_of(offer_words(spark, d), LABELS), layout.COST).select("capture", c("line").cast("long").alias("line"), "cell")


def x12_annotations(spark, d):
    return layout.annotations(offer_words(spark, d)).select("capture", c("line").cast("long").alias("line"), "kind", "text")


def a21_table_signature(spark, d):
    return layout.signature(layout.annotations(offer_words(spark, d)))


def x13_merged_bars(spark, d):
    return layout.merged_bars(derived(spark, d, "events", BARS), "user_id").select("user_id", "x", "top", "bottom")


def j15_hit(spark, d):
    boxes = derived(spark, d, "events", ["user_id", "event_id AS box", "CAST(minute(ts) AS double) AS left", "CAST(hour(ts) AS double) AS top", "CAST(minute(ts) + 5 AS double) AS right", "CAST(hour(ts) + 2 AS double) AS bottom"])
    points = derived(spark, d, "events", ["user_id", "event_id AS point", "CAST(second(ts) AS double) AS px", "CAST(hour(ts) AS double) AS py"])
    return layout.hit(points, boxes, "user_id").select("user_id", "point", "box")


def x14_aligned(spark, d):
    boxes = derived(spark, d, "events", ["user_id", "event_id AS box", "CAST(minute(ts) AS double) AS x", "CAST(hour(ts) * 10 AS double) AS y", "20.0 AS width", "8.0 AS height"])
    return layout.aligned(boxes.withColumns({"width": c("width").cast("double"), "height": c("height").cast("double")}), "user_id", 2.0, 12.0).select("user_id", "box", "left", "wide")


def w6_lines_by_mean(spark, d):
    return layout.lines_by_mean(event_words(spark, d)).select("word", c("line").cast("long").alias("line"))


def w8_cut(spark, d):
    return layout.cut_at_gap(event_words(spark, d), ["capture"], 150.0).select("word")


def w9_segments(spark, d):
    return layout.segments(event_words(spark, d), ["capture"], 50.0).select("capture", c("segment").cast("long").alias("segment"), "text")


def w2_row_pitch(spark, d):
    words = layout.table_rows(event_words(spark, d)).withColumn("line", c("row"))
    return layout.row_pitch(layout.bounds(words)).select("capture", "pitch")


def w10_scan_bands(spark, d):
    lines = derived(spark, d, "lineitem", ["l_orderkey", "CAST(l_quantity AS BIGINT) AS y", "l_suppkey % 3 > 0 AS on"]).groupBy("l_orderkey", "y").agg(F.bool_or("on").alias("on"))
    return layout.scan_bands(lines, "l_orderkey", "y", "on").select("l_orderkey", "top", "bottom")


def w11_tail(spark, d):
    return layout.tail(derived(spark, d, "events", ["event_id", "user_id", "props || event_type AS line"]), "user_id", ["event_id"], "line", 20, 300).select("event_id", "user_id")


def o6_window(spark, d):
    """A user's window: the one in front where it can be chosen, else the first that can."""
    rows = derived(spark, d, "events", ["user_id", "event_id AS z", f"{pick('event_id', 'None', 'CatalogSubstitution', 'CreateRecommendedOrders')} AS kind", "event_id % 4 > 0 AS shown", "event_id % 11 = 1 AS front"])
    return sequence.chosen_window(rows, "user_id").select("user_id", "z", "kind")


_E = f"({select('events', EVENT_WORDS)})"
_O = f"({OFFERS.replace('VARCHAR(30)', 'VARCHAR')})"
_SOME = f"(SELECT * FROM {_E} WHERE trim(text) <> '')"
_T = f"(SELECT capture, line, supplier, TRY_CAST(cost AS DECIMAL(18,4)) AS cost, amount FROM {_O})"
_NOTES = f"""T AS {_T}, B AS (SELECT capture, arg_min(line, row(cost, line)) AS line, min(cost) AS base FROM T WHERE supplier = 'McKesson' AND cost IS NOT NULL GROUP BY 1 HAVING min(cost) > 0),
    V AS (SELECT T.capture, T.line, 'savings' AS kind, CASE WHEN (base - cost) * 4 >= base THEN 'G' ELSE 'Y' END || ':' || regexp_replace(format('{{:.1f}}', CAST(base - cost AS DOUBLE) / CAST(base AS DOUBLE) * 100), '[.]0$', '') || '%' AS text FROM T JOIN B USING (capture) WHERE supplier <> 'McKesson' AND cost < base),
    P AS (SELECT capture, arg_min(line, row(cost, line)) AS line, 'best' AS kind, CASE WHEN amount >= 500 THEN 'large' ELSE 'small' END AS text FROM T WHERE cost IS NOT NULL AND amount > 0 GROUP BY 1, 4),
    S AS (SELECT capture, -1 AS line, 'order' AS kind, CASE WHEN bool_or(down) THEN 'NotSorted' ELSE 'Sorted' END AS text FROM (SELECT capture, cost < lag(cost) OVER (PARTITION BY capture ORDER BY line) AS down FROM T WHERE cost IS NOT NULL) GROUP BY 1 HAVING count(*) > 1),
    N AS (SELECT * FROM V WHERE capture % 5 > 0 UNION ALL SELECT capture, line, 'baseline', 'compared' FROM B WHERE capture % 5 > 0 UNION ALL SELECT capture, line, kind, text FROM P WHERE capture % 5 > 0 UNION ALL SELECT * FROM S WHERE capture % 5 > 0)"""


QUERIES = {
    q.__name__: q
    for q in (x1_rows, x2_data_rows, a18_label_scores, x3_header, x4_columns, x5_resolved, x6_cells, x12_annotations, a21_table_signature, x13_merged_bars, j15_hit, x14_aligned, w6_lines_by_mean, w8_cut, w9_segments, w2_row_pitch, w10_scan_bands, w11_tail, o6_window)
}
SQL = {
    "x1_rows": f"SELECT word, CAST(sum(n) OVER (PARTITION BY capture ORDER BY y, x, word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM (SELECT *, CASE WHEN y >= max(y + h) OVER (PARTITION BY capture ORDER BY y, x, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {_SOME})",
    "x2_data_rows": f"SELECT capture, row, is_data FROM (SELECT capture, 0::BIGINT AS row, FALSE AS is_data FROM (SELECT DISTINCT capture FROM {_O}) UNION ALL SELECT DISTINCT capture, 1, FALSE FROM {_O} UNION ALL SELECT DISTINCT capture, 2, FALSE FROM {_O} WHERE capture % 7 = 0 UNION ALL SELECT capture, line + 2 + CASE WHEN capture % 7 = 0 THEN 1 ELSE 0 END, cost <> 'n/a' FROM {_O})",
    "x3_header": f"""SELECT capture, CAST(1 AS BIGINT) AS start, CASE WHEN capture % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS span, CAST(2 AS BIGINT) AS score, CAST(20 AS DOUBLE) AS top, CAST(CASE WHEN capture % 7 = 0 THEN 46 ELSE 32 END AS DOUBLE) AS bottom FROM (SELECT DISTINCT capture FROM {_O})
        """,
    "x4_columns": f"""WITH M AS (SELECT *, median(h) OVER (PARTITION BY capture) AS mh FROM {_E}), G AS (SELECT *, CASE WHEN x - max(x + w) OVER (PARTITION BY capture ORDER BY x, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 1.5 * mh THEN 1 ELSE 0 END AS n FROM M),
        I AS (SELECT *, CAST(sum(n) OVER (PARTITION BY capture ORDER BY x, word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col FROM G), A AS (SELECT capture, col, string_agg(trim(text), ' ' ORDER BY y, x, word) AS label, min(x) AS l, max(x + w) AS r FROM I GROUP BY 1, 2)
        SELECT capture, col AS "column", label, l AS "left", r AS "right", coalesce(((l + r) / 2 + lag((l + r) / 2) OVER o) / 2, l - (r - l)) AS lo, coalesce(((l + r) / 2 + lead((l + r) / 2) OVER o) / 2, r + (r - l)) AS hi FROM A WINDOW o AS (PARTITION BY capture ORDER BY col)""",
    "x5_resolved": f"""SELECT DISTINCT capture, 1::BIGINT AS "column", 'Rebate Cost/Unit' AS label FROM {_O}""",
    "x6_cells": f"SELECT capture, line, cost AS cell FROM {_O}",
    "x12_annotations": f"WITH {_NOTES} SELECT capture, line, kind, text FROM N",
    "a21_table_signature": f"""WITH {_NOTES} SELECT capture, coalesce(string_agg('V' || CAST(line AS VARCHAR) || ':' || text, '+' ORDER BY line) FILTER (kind = 'savings'), 'V-') || '|' || coalesce('L' || CAST(max(line) FILTER (kind = 'best' AND text = 'large') AS VARCHAR), 'L-') || '|'
        || coalesce('S' || CAST(max(line) FILTER (kind = 'best' AND text = 'small') AS VARCHAR), 'S-') || '|' || coalesce('B' || max(text) FILTER (kind = 'order'), 'B-') AS signature FROM N GROUP BY 1""",
    "x13_merged_bars": f"""SELECT user_id, x, min(y) AS top, max(y + height) AS bottom FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, x ORDER BY y, height ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN y > max(y + height) OVER (PARTITION BY user_id, x ORDER BY y, height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n
        FROM (SELECT DISTINCT * FROM ({select('events', BARS)})))) GROUP BY user_id, x, i""",
    "j15_hit": """SELECT p.user_id, p.event_id AS point, min(b.event_id) AS box FROM events p LEFT JOIN events b ON b.user_id = p.user_id AND second(p.ts) BETWEEN minute(b.ts) AND minute(b.ts) + 5 AND hour(p.ts) BETWEEN hour(b.ts) AND hour(b.ts) + 2 GROUP BY 1, 2""",
    "x14_aligned": """WITH RECURSIVE B AS (SELECT user_id, event_id AS box, CAST(minute(ts) AS DOUBLE) AS x, hour(ts) * 10 AS y FROM events), N AS (SELECT a.user_id, a.box AS a, b.box AS b, b.x FROM B a JOIN B b ON a.user_id = b.user_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) - 8 <= 12),
        R AS (SELECT user_id, box AS a, box AS b, x FROM B UNION SELECT R.user_id, R.a, N.b, N.x FROM R JOIN N ON N.user_id = R.user_id AND N.a = R.b) SELECT B.user_id, box, l AS left, 20.0::DOUBLE + x - l AS wide FROM B JOIN (SELECT user_id, a, min(x) AS l FROM R GROUP BY 1, 2) m ON m.user_id = B.user_id AND m.a = box""",
    "w8_cut": f"SELECT word FROM (SELECT *, sum(f) OVER (PARTITION BY capture ORDER BY x, word ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY capture ORDER BY x, word) > 150 THEN 1 ELSE 0 END AS f FROM {_E})) WHERE s = 0",
    "w9_segments": f"SELECT capture, CAST(s AS BIGINT) AS segment, string_agg(text, ' ' ORDER BY x, word) AS text FROM (SELECT *, sum(f) OVER (PARTITION BY capture ORDER BY x, word ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY capture ORDER BY x, word) > 50 THEN 1 ELSE 0 END AS f FROM {_E})) GROUP BY 1, 2",
    "w2_row_pitch": f"""WITH R AS (SELECT *, sum(n) OVER (PARTITION BY capture ORDER BY y, x, word ROWS UNBOUNDED PRECEDING) AS row FROM (SELECT *, CASE WHEN y >= max(y + h) OVER (PARTITION BY capture ORDER BY y, x, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {_SOME})),
        B AS (SELECT capture, row, min(y) AS t, max(y + h) AS b FROM R GROUP BY 1, 2), G AS (SELECT *, (t + b) / 2 - lag((t + b) / 2) OVER (PARTITION BY capture ORDER BY (t + b) / 2, row) AS g FROM B) SELECT capture, coalesce(median(g), max(b - t)) AS pitch FROM G GROUP BY 1""",
    "w10_scan_bands": "SELECT l_orderkey, min(y) AS top, max(y) + 1 AS bottom FROM (SELECT *, y - row_number() OVER (PARTITION BY l_orderkey ORDER BY y) AS i FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS y FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_suppkey % 3 > 0))) GROUP BY l_orderkey, i",
    "w11_tail": "SELECT event_id, user_id FROM (SELECT *, sum(strlen(props || event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) - 1 AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20 AND u <= 300",
    "o6_window": "SELECT user_id, arg_min(event_id, row(CASE WHEN event_id % 11 = 1 THEN 0 ELSE 1 END, event_id)) AS z, arg_min(CASE event_id % 3 WHEN 1 THEN 'CatalogSubstitution' ELSE 'CreateRecommendedOrders' END, row(CASE WHEN event_id % 11 = 1 THEN 0 ELSE 1 END, event_id)) AS kind FROM events WHERE event_id % 3 > 0 AND event_id % 4 > 0 GROUP BY 1",
}
