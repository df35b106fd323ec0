"""Words with their boxes made into rows, columns, cells and decisions. words(capture, word, text, x, y, w, h): `word` numbers a capture's words in their order.

All work is by capture, in windows over its words; a capture is one screen, so its words are few, and no key holds more than one capture. A table's header and
cells are read from one array of words a capture: nothing is joined, and nothing is shuffled but the words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenpair.functions import rules as R
from lumenpair.functions.scalars import blank, currency, package_quantity, trimmed
from lumenpair.operators import grid

c = F.col
UP_TO = (W.unboundedPreceding, 0)
BEFORE = (W.unboundedPreceding, -1)
#: A text that is one amount of money with decimals makes a row a data row.
AMOUNT = r"^\(?-?\$?[\d,]+\.\d+\)?$"
SUPPLIER, COST, SIZE = "supplier", "rebate cost/unit", "shipping size"


def table_rows(words: DataFrame) -> DataFrame:
    """words with `row`, from the top: a word begins a new row where it begins at or below the lowest end of all words before it. Blank words take part in none."""
    w = W.partitionBy("capture").orderBy("y", "x", "word")
    some = words.filter(~blank(c("text")))
    reach = F.max(c("y") + c("h")).over(w.rowsBetween(*BEFORE))
    return some.withColumn("_new", (c("y") >= reach).cast("int")).withColumn("row", F.coalesce(F.sum("_new").over(w.rowsBetween(*UP_TO)), F.lit(0)).cast("int")).drop("_new")


def data_rows(rows: DataFrame) -> DataFrame:
    """(capture, row, is_data) of table_rows()."""
    return rows.groupBy("capture", "row").agg(F.bool_or(trimmed(c("text")).rlike(AMOUNT)).alias("is_data"))


def columns(rows: DataFrame, by: list[str], factor: float = 1.5) -> DataFrame:
    """(*by, column, label, left, right, lo, hi): the words of each key as columns from the left. A gap of `factor` times the median height of the words, or more, behind all that
    came before parts two columns. The label reads by lines, and [lo, hi) goes to the middle between neighbours; at the ends, as far out as the column is wide."""
    w = W.partitionBy(*by).orderBy("x", "word")
    height = F.median("h").over(W.partitionBy(*by))
    reach = F.max(c("x") + c("w")).over(w.rowsBetween(*BEFORE))
    marked = rows.withColumn("_new", (c("x") - reach >= factor * height).cast("int")).withColumn("column", F.coalesce(F.sum("_new").over(w.rowsBetween(*UP_TO)), F.lit(0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "word", trimmed(c("text")).alias("t")))), lambda v: v["t"]), " ")
    bands = marked.groupBy(*by, "column").agg(text.alias("label"), F.min("x").alias("left"), F.max(c("x") + c("w")).alias("right"))
    o = W.partitionBy(*by).orderBy("column")
    center, wide = (c("left") + c("right")) / 2, c("right") - c("left")
    return bands.withColumn("lo", F.coalesce((center + F.lag(center).over(o)) / 2, c("left") - wide)).withColumn("hi", F.coalesce((center + F.lead(center).over(o)) / 2, c("right") + wide))


def plain_label(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def close_label(label: Column, expected: Column) -> Column:
    """The same but for case and spaces, or, of six letters or more, at an edit distance of one."""
    return close_plain(plain_label(label), plain_label(expected))


def close_plain(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 6) & (F.length(b) >= 6) & (F.levenshtein(a, b) <= 1))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def each(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """`keep` and a row for each element of an array. The condition stands on the elements: one on the array would be carried below all that it is computed from, and each step would
    compute it anew."""
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(c(name).isNotNull())


def pages(rows: DataFrame) -> DataFrame:
    """(capture, words) of table_rows(): a capture's words as one array in the order of their rows, so that what follows reads each word once, without joins."""
    word = F.struct("row", "y", "x", c("word").cast("long").alias("word"), trimmed(c("text")).alias("t"), "w", "h")
    return rows.groupBy("capture").agg(F.sort_array(F.collect_list(word)).alias("words"))


def parted(words: Column, factor: float = 1.5) -> Column:
    """columns() of an array of words: for each column its words, by x."""
    ordered = F.sort_array(F.transform(words, lambda v: F.struct(v["x"].alias("x"), v["word"].alias("word"), v["y"].alias("y"), v["t"].alias("t"), v["w"].alias("w"), v["h"].alias("h"))))
    heights = lambda ws: F.sort_array(F.array_compact(F.transform(ws, lambda v: v["h"])))
    median = lambda hs: F.get(hs, F.floor((F.size(hs) - 1) / 2).cast("int")) * 0.5 + F.get(hs, F.floor(F.size(hs) / 2).cast("int")) * 0.5
    measured = lambda ws: F.struct(ws.alias("ws"), let(heights(ws), median).alias("high"), F.transform(ws, lambda v: v["x"] + v["w"]).alias("ends"))

    def begins(m: Column) -> Column:
        new = lambda v, i: v["x"] - F.array_max(F.slice(m["ends"], 1, i)) >= factor * m["high"]
        return F.concat(F.array(F.lit(0)), F.array_compact(F.transform(m["ws"], lambda v, i: F.when(new(v, i), i))))

    cut = lambda m, b: F.transform(b, lambda k, i: F.slice(m["ws"], k + 1, F.coalesce(F.get(b, i + 1), F.size(m["ws"])) - k))
    return let(let(ordered, measured), lambda m: let(begins(m), lambda b: cut(m, b)))


def read_label(words: Column) -> Column:
    """The label of a column's words, by lines."""
    lines = F.sort_array(F.transform(words, lambda v: F.struct(v["y"].alias("y"), v["x"].alias("x"), v["word"].alias("word"), v["t"].alias("t"))))
    return F.array_join(F.transform(lines, lambda v: v["t"]), " ")


def candidates(pages: DataFrame, labels: list[str], scan: int = 12) -> DataFrame:
    """pages with `candidates`, structs of start, span, score, top and bottom: each window of one or two rows that may be the header, none of which holds a data row, that lies within
    the first `scan` rows, and with no data row before it behind an earlier window that scores. score counts the labels that one of its columns has."""
    early = F.filter("words", lambda v: v["row"] < scan)
    seen = pages.withColumn("_early", early).withColumn("_n", F.coalesce(F.array_max(F.transform("_early", lambda v: v["row"])) + 1, F.lit(0)))
    seen = seen.withColumn("_data", F.array_distinct(F.transform(F.filter("_early", lambda v: v["t"].rlike(AMOUNT)), lambda v: v["row"])))
    seen = seen.withColumn("_starts", F.array_except(F.sequence(F.lit(0), c("_n") - 1), c("_data")))
    pair = F.filter("_starts", lambda k: F.array_contains("_starts", k + 1))
    span = lambda n: lambda k: F.struct(k.alias("start"), F.lit(n).alias("span"), F.filter("_early", lambda v: (v["row"] >= k) & (v["row"] < k + n)).alias("ws"))
    known = lambda v: F.transform(parted(v["ws"]), lambda ws: plain_label(read_label(ws)))
    like = lambda x: lambda v: close_plain(v, plain_label(F.lit(x)))
    score = lambda ls: sum((F.exists(ls, like(x)).cast("int") for x in labels), F.lit(0))
    scored = lambda v: F.struct(v["start"].alias("start"), v["span"].alias("span"), let(known(v), score).alias("score"), F.array_min(F.transform(v["ws"], lambda w: w["y"])).alias("top"), F.array_max(F.transform(v["ws"], lambda w: w["y"] + w["h"])).alias("bottom"))
    found = seen.withColumn("_windows", F.concat(F.transform("_starts", span(1)), F.transform(pair, span(2)))).withColumn("_scored", F.transform("_windows", scored))
    first = F.array_min(F.transform(F.filter("_scored", lambda v: v["score"] > 0), lambda v: v["start"]))
    stop = let(first, lambda f: F.array_min(F.filter("_data", lambda k: k > f)))
    return found.select("capture", "words", let(stop, lambda s: F.filter("_scored", lambda v: s.isNull() | (v["start"] < s))).alias("candidates"))


def header_candidates(rows: DataFrame, labels: list[str], scan: int = 12) -> DataFrame:
    """(capture, start, span, score, top, bottom) of candidates()."""
    return each(candidates(pages(rows), labels, scan), ["capture"], c("candidates"), "_c").select("capture", "_c.*")


def header(candidates: DataFrame) -> DataFrame:
    """(capture, words, head): the best window of each capture, as of candidates(): the highest score over 0, then the earliest start, then the longer span. A capture without is left out."""
    ranked = F.transform(F.filter("candidates", lambda v: v["score"] > 0), lambda v: F.struct((-v["score"]).alias("s"), v["start"].alias("start"), (-v["span"]).alias("n"), v.alias("v")))
    return each(candidates, ["capture", "words"], F.array(F.array_min(ranked)["v"]), "head")


def header_columns(heads: DataFrame) -> DataFrame:
    """header() with `bands`, the columns of each capture's header as columns() gives them."""
    end = c("head.start") + c("head.span")
    held = F.filter("words", lambda v: (v["row"] >= c("head.start")) & (v["row"] < end))
    band = lambda ws, i: F.struct(i.alias("column"), read_label(ws).alias("label"), F.array_min(F.transform(ws, lambda v: v["x"])).alias("left"), F.array_max(F.transform(ws, lambda v: v["x"] + v["w"])).alias("right"))
    center, wide = lambda b: (b["left"] + b["right"]) / 2, lambda b: b["right"] - b["left"]
    near = lambda b, i: (center(b) + center(F.get("_bands", i))) / 2
    whole = lambda b, i: F.struct(*[b[k].alias(k) for k in ("column", "label", "left", "right")], F.coalesce(near(b, i - 1), b["left"] - wide(b)).alias("lo"), F.coalesce(near(b, i + 1), b["right"] + wide(b)).alias("hi"))
    return heads.withColumn("_bands", F.transform(parted(held), band)).withColumn("bands", F.transform("_bands", whole)).drop("_bands")


def first_band(label: str) -> Column:
    """The first of header_columns() whose label is the same but for case and spaces; null where none is."""
    return F.get(F.filter("bands", lambda b: plain_label(b["label"]) == plain_label(F.lit(label))), F.lit(0))


def resolved(bands: DataFrame, label: str) -> DataFrame:
    """(capture, column, label, left, right, lo, hi): the first column of each capture whose label is the same but for case and spaces."""
    return each(bands, ["capture"], F.array(first_band(label)), "_b").select("capture", "_b.*")


def named_cells(bands: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(capture, line, one column for each name) of header_columns(): the words of each line below the header, counted from it, whose centre lies in the column of that label, by x;
    without any, the cell is empty. The cells of a column that a capture doesn't have are null."""
    end = c("head.start") + c("head.span")
    below = bands.select("capture", end.alias("_end"), F.filter("words", lambda v: v["row"] >= end).alias("_below"), *[first_band(x).alias(f"_{n}") for n, x in labels.items()])
    known = each(below, ["capture", "_end", *[c(f"_{n}.{k}").alias(f"_{n}_{k}") for n in labels for k in ("lo", "hi")]], c("_below"), "v")
    middle = c("v.x") + c("v.w") / 2
    inside = lambda n: (middle >= c(f"_{n}_lo")) & (middle < c(f"_{n}_hi"))
    text = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(inside(n), F.struct(c("v.x").alias("x"), c("v.word").alias("word"), c("v.t").alias("t"))))), lambda v: v["t"]), " ")
    return known.groupBy("capture", (c("v.row") - c("_end")).alias("line")).agg(*[F.when(F.max(f"_{n}_lo").isNotNull(), text(n)).alias(n) for n in labels])


def cells(bands: DataFrame, label: str) -> DataFrame:
    """(capture, line, cell): named_cells() of one column, of the captures that have it."""
    return named_cells(bands, {"cell": label}).filter("cell IS NOT NULL")


def bounds(lines: DataFrame) -> DataFrame:
    """(capture, line, left, top, right, bottom) of each line's words."""
    return lines.groupBy("capture", "line").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max(c("x") + c("w")).alias("right"), F.max(c("y") + c("h")).alias("bottom"))


def row_pitch(boxes: DataFrame) -> DataFrame:
    """(capture, pitch): the median distance of neighbouring lines' middles; a single line's height."""
    middle = (c("top") + c("bottom")) / 2
    gap = middle - F.lag(middle).over(W.partitionBy("capture").orderBy(middle, "line"))
    return boxes.withColumn("_gap", gap).groupBy("capture").agg(F.coalesce(F.median("_gap"), F.max(c("bottom") - c("top"))).alias("pitch"))


def even_bounds(lines: DataFrame) -> DataFrame:
    """bounds(), each as high as the capture's pitch around its middle."""
    boxes = bounds(lines)
    middle, half = (c("top") + c("bottom")) / 2, c("pitch") / 2
    high = boxes.join(row_pitch(boxes), "capture")
    some = c("pitch") > 0
    return high.select("capture", "line", "left", F.when(some, middle - half).otherwise(c("top")).alias("top"), "right", F.when(some, middle + half).otherwise(c("bottom")).alias("bottom"))


def table_of(words: DataFrame, labels: list[str]) -> DataFrame:
    """(capture, words, head, bands): each capture's header and its columns; captures without a header are left out."""
    return header_columns(header(candidates(pages(table_rows(words)), labels)))


def zero_quantities(words: DataFrame, label: str) -> DataFrame:
    """(capture, line, state) of the lines of a column whose quantity can be read."""
    return cells(table_of(words, [label]), label).withColumn("state", R.zero_state(c("cell"))).select("capture", "line", "state")


def annotations(words: DataFrame, labels: tuple[str, str, str] = (SUPPLIER, COST, SIZE)) -> DataFrame:
    """(capture, line, kind, text) of a table of offers: `savings` of each line cheaper than the cheapest of the primary supplier, that line as `baseline`, the best line of each class of
    package, and on line -1 whether the costs are sorted. A capture without a header, supplier or cost column has none."""
    supplier, cost, size = labels
    found = named_cells(table_of(words, [supplier, cost]), {"supplier": supplier, "cost_text": cost, "size_text": size})
    table = found.filter("supplier IS NOT NULL AND cost_text IS NOT NULL")
    return offers(table.withColumn("cost", currency(c("cost_text"))).withColumn("primary", R.is_primary(c("supplier"))))


def offers(table: DataFrame) -> DataFrame:
    """annotations() of table(capture, line, primary, cost, size_text): windows over a capture's lines, so one shuffle."""
    all_, before = W.partitionBy("capture"), W.partitionBy("capture").orderBy("line").rowsBetween(*BEFORE)
    least = lambda cond: F.min(F.when(cond & c("cost").isNotNull(), F.struct("cost", "line"))).over(all_)
    kind = F.when(c("size_text").isNotNull(), grid.package_class(package_quantity(c("size_text"))))
    seen = table.withColumn("_kind", kind).withColumn("_last", F.last("cost", ignorenulls=True).over(before))
    seen = seen.select(
        "capture", "line", "primary", "cost", least(c("primary")).alias("_base"), *[least(c("_kind") == k).alias(f"_{k}") for k in ("Large", "Small")],
        F.max((c("cost") < c("_last")).cast("int")).over(all_).alias("_down"), F.count("cost").over(all_).alias("_n"), F.min("line").over(all_).alias("_first"),
    )
    share = R.percent((c("_base.cost") - c("cost")).cast("double") / c("_base.cost").cast("double") * 100)
    tier = F.when((c("_base.cost") - c("cost")) * 4 >= c("_base.cost"), "G").otherwise("Y")
    note = lambda cond, line, name, text: F.when(cond, F.struct(line.cast("int").alias("line"), F.lit(name).alias("kind"), text.alias("text")))
    at = lambda b: c("line") == c(f"{b}.line")
    based = c("_base.cost") > 0
    notes = F.array(
        note(~c("primary") & based & (c("cost") < c("_base.cost")), c("line"), "savings", F.concat(tier, F.lit(":"), share)), note(based & at("_base"), c("line"), "baseline", F.lit("compared")),
        note(at("_Large"), c("line"), "best", F.lit("large")), note(at("_Small"), c("line"), "best", F.lit("small")),
        note((c("line") == c("_first")) & (c("_n") > 1), F.lit(-1), "order", F.when(c("_down") == 1, "NotSorted").otherwise("Sorted")),
    )
    return seen.select("capture", F.explode(F.array_compact(notes)).alias("_v")).select("capture", "_v.*")


def signature(notes: DataFrame) -> DataFrame:
    """(capture, signature): the savings, best lines and order of annotations(), however its rows are ordered; the baseline has no part in it."""
    of = lambda kind, text, *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("kind") == kind, F.struct(*order, text.alias("t"))))), lambda v: v["t"]), "+")
    v = of("savings", F.concat(F.lit("V"), c("line").cast("string"), F.lit(":"), c("text")), "line")
    best = lambda k, mark: F.coalesce(F.max(F.when((c("kind") == "best") & (c("text") == k), F.concat(F.lit(mark), c("line").cast("string")))), F.lit(f"{mark}-"))
    order = F.coalesce(F.max(F.when(c("kind") == "order", F.concat(F.lit("B"), c("text")))), F.lit("B-"))
    grouped = notes.groupBy("capture").agg(v.alias("_v"), best("large", "L").alias("_l"), best("small", "S").alias("_s"), order.alias("_o"))
    return grouped.select("capture", F.concat_ws("|", F.when(c("_v") == "", "V-").otherwise(c("_v")), "_l", "_s", "_o").alias("signature"))


def merged_bars(bars: DataFrame, key: str) -> DataFrame:
    """(key, x, width, top, bottom): bars(key, x, y, width, height) of one x and width that touch or overlap, as one."""
    w = W.partitionBy(key, "x", "width").orderBy("y", "height")
    reach = F.max(c("y") + c("height")).over(w.rowsBetween(*BEFORE))
    island = bars.withColumn("_new", (c("y") > reach + 1e-6).cast("int")).withColumn("_i", F.coalesce(F.sum("_new").over(w.rowsBetween(*UP_TO)), F.lit(0)))
    return island.groupBy(key, "x", "width", "_i").agg(F.min("y").alias("top"), F.max(c("y") + c("height")).alias("bottom")).drop("_i")


def hit(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """points(key, point, px, py) with `box`, the least number of the boxes(key, box, left, top, right, bottom) that hold it, edges included; null where none does."""
    inside = points.join(boxes, key).filter(c("px").between(c("left"), c("right")) & c("py").between(c("top"), c("bottom")))
    return points.join(inside.groupBy(key, "point").agg(F.min("box").alias("box")), [key, "point"], "left")


def aligned(boxes: DataFrame, key: str, dx: float, dy: float) -> DataFrame:
    """boxes(key, box, x, y, width, height) with `left` and `wide`: boxes whose left edges are within dx and whose gap is at most dy are neighbours, and all that are connected
    begin at the least left edge; their right edges stay. A key is one screen of a few boxes, which is a group in memory."""
    import numpy as np
    import pandas as pd

    def align(group: pd.DataFrame) -> pd.DataFrame:
        x, y, high = (group[k].to_numpy(float) for k in ("x", "y", "height"))
        gap = np.maximum(np.subtract.outer(y, y + high), np.subtract.outer(y, y + high).T)
        near = (np.abs(np.subtract.outer(x, x)) <= dx) & (gap <= dy)
        left = x
        while (lower := np.where(near, left[None, :], np.inf).min(axis=1, initial=np.inf)).tolist() != left.tolist():
            left = lower
        return group.assign(left=left, wide=group["width"].to_numpy(float) + x - left)

    names = [key, "box", "x", "y", "width", "height"]
    types = dict(boxes.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", left double, wide double"
    return boxes.select(*names).groupBy(key).applyInPandas(align, schema)


def lines_by_mean(words: DataFrame, share: float = 0.6) -> DataFrame:
    """words with `line`: a word joins the line before it where it is within `share` of that line's mean height of its mean y. The means change with every word, so a line is a
    fold over a capture's words."""
    state = "struct<n:bigint,y:double,h:double,line:int,out:array<struct<word:bigint,line:int>>>"
    some = words.filter(~blank(c("text")))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", c("word").cast("long").alias("word"), "h")))

    def fold(a: Column, v: Column) -> Column:
        high = F.when(a["h"] / a["n"] > 0, a["h"] / a["n"]).otherwise(F.when(v["h"] > 0, v["h"]).otherwise(1.0))
        joins = F.coalesce((a["n"] > 0) & (F.abs(v["y"] - a["y"] / a["n"]) <= high * share), F.lit(False))
        line = F.when(joins, a["line"]).otherwise(a["line"] + 1)
        row = F.struct(v["word"].alias("word"), line.alias("line"))
        return F.struct(
            F.when(joins, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(joins, a["y"] + v["y"]).otherwise(v["y"]).alias("y"), F.when(joins, a["h"] + v["h"]).otherwise(v["h"]).alias("h"), line.alias("line"), F.concat(a["out"], F.array(row)).alias("out")
        ).cast(state)

    zero = F.from_json(F.lit('{"n":0,"y":0.0,"h":0.0,"line":-1,"out":[]}'), state)
    grouped = some.groupBy("capture").agg(ordered.alias("_w"))
    lines = grouped.select("capture", F.explode(F.aggregate("_w", zero, fold)["out"]).alias("_o")).select("capture", c("_o.word").alias("word"), c("_o.line").alias("line"))
    return some.join(lines, ["capture", "word"])


def cut_at_gap(words: DataFrame, by: list[str], gap: float) -> DataFrame:
    """The words of each line up to the first that stands more than `gap` behind the one before it."""
    w = W.partitionBy(*by).orderBy("x", "word")
    far = c("x") - F.lag(c("x") + c("w")).over(w) > gap
    return words.withColumn("_far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("_cut", F.max("_far").over(w.rowsBetween(*UP_TO))).filter("_cut = 0").drop("_far", "_cut")


def segments(words: DataFrame, by: list[str], gap: float) -> DataFrame:
    """(*by, segment, text): the words of each line, parted wherever one stands more than `gap` behind the one before it."""
    w = W.partitionBy(*by).orderBy("x", "word")
    far = F.coalesce(c("x") - F.lag(c("x") + c("w")).over(w) > gap, F.lit(False)).cast("int")
    parted = words.withColumn("_far", far).withColumn("segment", F.sum("_far").over(w.rowsBetween(*UP_TO)).cast("int"))
    return parted.groupBy(*by, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda v: v["text"]), " ").alias("text"))


def scan_bands(lines: DataFrame, key: str, y: str, on: str) -> DataFrame:
    """(key, top, bottom): runs of consecutive scan lines that are `on`, bottom excluded."""
    w = W.partitionBy(key).orderBy(y)
    runs = lines.filter(c(on)).withColumn("_i", c(y) - F.row_number().over(w))
    return runs.groupBy(key, "_i").agg(F.min(y).alias("top"), (F.max(y) + 1).alias("bottom")).drop("_i")


def tail(lines: DataFrame, key: str, order: list[str], line: str, count: int = 80, size: int = 16_384) -> DataFrame:
    """The last `count` lines of each key, of which as many from the end as, joined by line feeds, have `size` bytes."""
    w = W.partitionBy(key).orderBy(*[F.desc(x) for x in order])
    ranked = lines.withColumn("_n", F.row_number().over(w)).filter(c("_n") <= count)
    used = F.sum(F.octet_length(line) + 1).over(w.rowsBetween(*UP_TO)) - 1
    return ranked.withColumn("_used", used).filter(c("_used") <= size).drop("_n", "_used")
