"""Analytics of grids of offers: the savings of other suppliers, the best row of a package class, and whether a grid is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def package_class(amount: Column, large: int = 500) -> Column:
    return F.when(amount.isNull() | (amount <= 0), "Unknown").when(amount >= large, "Large").otherwise("Small")


def savings(rows: DataFrame, grid: str, row: str, primary: Column, cost: str, threshold: float = 25.0) -> DataFrame:
    """(grid, row, savings_percent, tier) of rows of other suppliers that are cheaper than the cheapest primary row. A grid has no baseline where that row's
    cost isn't positive, or none is readable; a null in `primary` counts as not primary. One scan and one shuffle, on the grid."""
    base = F.min(F.when(F.coalesce(primary, F.lit(False)), F.col(cost))).over(W.partitionBy(grid))
    cheaper = rows.withColumn("_p", F.coalesce(primary, F.lit(False))).withColumn("_base", base).filter(~F.col("_p") & (F.col("_base") > 0) & (F.col(cost) < F.col("_base")))
    percent = (F.col("_base") - F.col(cost)).cast("double") / F.col("_base").cast("double") * 100
    return cheaper.select(grid, row, F.round(percent, 6).alias("savings_percent"), F.when(percent >= threshold, "AboveThreshold").otherwise("BelowThreshold").alias("tier"))


def best_per_class(rows: DataFrame, grid: str, row: str, cls: Column, cost: str) -> DataFrame:
    """(grid, class, row): the cheapest readable row of each known class, the first of those alike. It combines before the shuffle."""
    known = rows.withColumn("class", cls).filter(F.col(cost).isNotNull() & (F.col("class") != "Unknown"))
    return known.groupBy(grid, "class").agg(F.min(F.struct(cost, row)).alias("_b")).select(grid, "class", F.col(f"_b.{row}").alias(row))


def sort_state(rows: DataFrame, grid: str, order: list[str], cost: str) -> DataFrame:
    """(grid, state): whether the readable costs rise in the order of rows; under two of them it is Unknown."""
    w = W.partitionBy(grid).orderBy(*order)
    down = F.col(cost) < F.lag(cost).over(w)
    seen = rows.filter(F.col(cost).isNotNull()).select(grid, down.alias("_down"))
    return seen.groupBy(grid).agg(F.when(F.count(F.lit(1)) < 2, "Unknown").when(F.bool_or("_down"), "NotSorted").otherwise("Sorted").alias("state"))
