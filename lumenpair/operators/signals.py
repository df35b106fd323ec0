"""Signals over the samples of a key in their order: dwelling, clicks, second reads, and values kept while a window stays. Batch forms; lumenpair.streaming has their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenpair.functions.scalars import blank

c = F.col
UP_TO = (W.unboundedPreceding, 0)


def clicks(rows: DataFrame, key: str, order: list[str], down: str = "down", over: str = "over", dialog: str = "dialog") -> DataFrame:
    """rows with `click`: the button went down since the sample before, over a spot, while no dialog is open. Before a key's first sample it was up."""
    before = F.lag(down, 1, False).over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("click", c(down) & ~before & c(over) & ~c(dialog))


def dwell(rows: DataFrame, key: str, order: list[str], threshold: int = 250) -> DataFrame:
    """rows(over, spot, elapsed, click, ...) with `action`: Show, once, when the same spot was stayed on for threshold milliseconds; Hide when what was shown is left, or on a click;
    else None. The sample that reaches a spot counts no time."""
    w = W.partitionBy(key).orderBy(*order)
    place = F.when(c("over"), c("spot"))
    fresh = (F.row_number().over(w) == 1) | ~place.eqNullSafe(F.lag(place).over(w))
    stays = rows.withColumn("_new", fresh.cast("int")).withColumn("_stay", F.sum("_new").over(w.rowsBetween(*UP_TO)))
    s = W.partitionBy(key, "_stay").orderBy(*order)
    time = F.sum(F.when(c("_new") == 1, 0).otherwise(c("elapsed"))).over(s.rowsBetween(*UP_TO))
    timed = stays.withColumn("_time", F.when(c("over"), time).otherwise(0))
    shows = c("over") & (c("_new") == 0) & (c("_time") >= threshold)
    marked = timed.withColumn("_late", shows).withColumn("_shown", F.max(c("_late").cast("int")).over(s.rowsBetween(*UP_TO)))
    marked = marked.withColumn("_show", c("_late") & (F.lag("_shown", 1, 0).over(s) == 0))
    hides = (c("_new") == 1) & (F.lag("_shown", 1, 0).over(w) == 1)
    action = F.when(c("click") | hides, "Hide").when(c("_show"), "Show").otherwise("None")
    return marked.withColumn("action", action).drop("_new", "_stay", "_time", "_late", "_show", "_shown")


def retried(rows: DataFrame, key: str, order: list[str], first: str, threw: str, second: str) -> DataFrame:
    """rows with `read`: the first attempt, unless it threw, or is blank though one of the key's reads before wasn't; then the second."""
    w = W.partitionBy(key).orderBy(*order)
    good = lambda col: (~blank(col)).cast("int")
    kept = rows.withColumn("_ever", F.coalesce(F.max(F.when(c(threw), 0).otherwise(good(c(first)))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return kept.withColumn("read", F.when(c(threw) | (blank(c(first)) & (c("_ever") == 1)), c(second)).otherwise(c(first))).drop("_ever")


def cached(rows: DataFrame, key: str, order: list[str], window: str, value: str) -> DataFrame:
    """rows with `kept`: the first value that was there since the key's window last changed."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = ~c(window).eqNullSafe(F.lag(window).over(w))
    stay = rows.withColumn("_stay", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w.rowsBetween(*UP_TO)))
    return stay.withColumn("kept", F.first(value, ignorenulls=True).over(W.partitionBy(key, "_stay").orderBy(*order).rowsBetween(*UP_TO))).drop("_stay")


def hover_step(state: tuple, over: bool, spot, elapsed: int, click: bool, threshold: int = 250) -> tuple[str, tuple]:
    """(action, state) after one sample; state is (spot or None, time, shown)."""
    at, time, shown = state
    if not over or spot != at:
        action, state = ("Hide" if shown else "None"), ((spot if over else None), 0, False)
    else:
        time += elapsed
        show = not shown and time >= threshold
        action, state = ("Show" if show else "None"), (at, time, shown or show)
    return ("Hide" if click else action), state
