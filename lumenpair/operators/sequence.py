"""Operators over ordered rows of a key: islands between gaps, edges, repeats and debounced signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_islands(rows: DataFrame, key: str, order: list[str], x: Column, gap: float) -> DataFrame:
    """rows with `island`, counted from 0 in each key: a new one begins where x exceeds the previous by more than gap."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("_new", F.when(x - F.lag(x).over(w) > gap, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def cover_islands(rows: DataFrame, key: str, order: list[str], start: Column, end: Column) -> DataFrame:
    """rows with `island`: a new one begins where start is at or beyond every earlier end."""
    w = W.partitionBy(key).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_new", F.when(start >= reach, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def pitch(rows: DataFrame, key: str, order: list[str], x: Column) -> DataFrame:
    """(key, pitch): the median distance of neighbours; null for a key with one row, whose own height layout.row_pitch() gives."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.select(key, (x - F.lag(x).over(w)).alias("_gap")).groupBy(key).agg(F.median("_gap").alias("pitch"))


def midpoints(rows: DataFrame, key: str, order: list[str], left: Column, right: Column) -> DataFrame:
    """rows with `lo` and `hi`: the middle between neighbours' centres; at the ends as far out as the row is wide."""
    w = W.partitionBy(key).orderBy(*order)
    center = (left + right) / 2
    return rows.withColumn("lo", F.coalesce((center + F.lag(center).over(w)) / 2, left - (right - left))).withColumn("hi", F.coalesce((center + F.lead(center).over(w)) / 2, right + (right - left)))


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows whose value isn't that of the row before; a key's first row is one. Nulls equal nulls."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("_fresh", fresh).filter("_fresh").drop("_fresh")


def step(shown: str, pending: str, streak: int, new: str, need: int = 2) -> tuple[str, str, str, int]:
    """(decision, shown, pending, streak) after one tick. A signal replaces what is shown once it came `need` times in a row; where nothing is shown
    the first signal shows at once."""
    if new == shown or not shown:
        return ("Display" if new else "Clear"), new, "", 0
    streak = streak + 1 if new == pending and streak else 1
    if streak >= need:
        return ("Display" if new else "Clear"), new, "", 0
    return "Processing", shown, new, streak


def debounce(rows: DataFrame, key: str, order: list[str], signal: str, tick: str) -> DataFrame:
    """(key, tick, decision, shown) of each tick; a null signal is an empty one. Ticks stream through a task in their order, and only the state of the key at hand is kept."""
    import pandas as pd

    def run(batches):
        at, shown, pending, streak = None, "", "", 0
        for batch in batches:
            out = []
            for k, t, new in zip(batch[key].tolist(), batch["_t"].tolist(), batch["_s"].tolist()):
                if k != at:
                    at, shown, pending, streak = k, "", "", 0
                decision, shown, pending, streak = step(shown, pending, streak, new)
                out.append((k, t, decision, shown))
            yield pd.DataFrame(out, columns=[key, tick, "decision", "shown"])

    ticks = rows.select(key, *order, F.col(tick).alias("_t"), F.coalesce(F.col(signal), F.lit("")).alias("_s")).repartition(key).sortWithinPartitions(key, *order, "_t")
    types = dict(rows.dtypes)
    return ticks.select(key, "_t", "_s").mapInPandas(run, f"{key} {types[key]}, {tick} {types[tick]}, decision string, shown string")


def in_interval(points: DataFrame, intervals: DataFrame, key: str, x: str, lo: str, hi: str) -> DataFrame:
    """points joined to the intervals of their key that hold them, lo included. The key's equi-join carries it; the bounds are its residual."""
    return points.join(intervals, key).filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi)))


def current(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """The rows of each key's latest generation; older ones are stale. Rows without a generation go. The latest is one row a key, joined on it."""
    latest = rows.groupBy(key).agg(F.max(generation).alias(generation))
    return rows.join(latest, [key, generation], "left_semi")


def upper_median(value: Column) -> Column:
    """Aggregate: the middle value, of an even number the upper of the two."""
    return F.sort_array(F.collect_list(value))[F.floor(F.count(value) / 2).cast("int")]


def share_near(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, share): of a key's values, the share that is within tolerance of their upper median."""
    gathered = rows.groupBy(key).agg(F.collect_list(value).alias("_v"), upper_median(F.col(value)).alias("_m"))
    return gathered.select(key, (F.size(F.filter("_v", lambda x: F.abs(x - F.col("_m")) <= tolerance)) / F.size("_v")).alias("share"))


def box(left: Column, top: Column, right: Column, bottom: Column) -> list[Column]:
    """Aggregates: the rectangle around all."""
    return [F.min(left).alias("left"), F.min(top).alias("top"), F.max(right).alias("right"), F.max(bottom).alias("bottom")]


def chosen_window(windows: DataFrame, key: str) -> DataFrame:
    """(key, z, kind): of a key's windows(kind, shown, front, z) that are shown and of a known kind the one in front, else that of least z."""
    some = windows.filter((F.col("kind") != "None") & F.col("shown"))
    best = some.groupBy(key).agg(F.min(F.struct((~F.col("front")).alias("_f"), "z", "kind")).alias("_b"))
    return best.select(key, F.col("_b.z").alias("z"), F.col("_b.kind").alias("kind"))
