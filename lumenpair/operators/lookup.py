"""Lookups of names in a dimension: by longest prefix, and with a lost last letter; and the dimension's builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, name: str, dimension: DataFrame, key: str, most: int = 4) -> DataFrame:
    """rows with every row of the dimension whose key is the longest of the name's leading 1..most tokens that is a key. Rows without one stay, with nulls.

    Distinct names are matched, not rows: prefixes are exploded over them alone, so the equi-join's probe side is the vocabulary. A null or blank name
    matches nothing."""
    words = rows.select(F.col(name).alias("_name")).distinct().withColumn("_t", tokens("_name")).filter("size(_t) > 0")
    prefixes = words.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("_t"), F.lit(most))), lambda i: F.struct(i.alias("n"), F.array_join(F.slice("_t", 1, i), " ").alias("k")))).alias("_p"))
    keys = dimension.select(F.col(key).alias("_k")).distinct()
    best = prefixes.join(keys, F.col("_p.k") == F.col("_k")).groupBy("_name").agg(F.max_by("_k", "_p.n").alias("_k"))
    found = best.join(dimension, F.col("_k") == F.col(key)).drop("_k")
    return rows.join(found, F.col(name) == F.col("_name"), "left").drop("_name")


def tokens(column: str) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.col(column))), r"\s+"), lambda x: x != "")


def elided(misses: DataFrame, name: str, dimension: DataFrame, key: str, least: int = 8) -> DataFrame:
    """misses joined to the one key that is the name but for a letter more at the end of its first word. Two such keys are ambiguous, which is null; so is a first word of
    fewer than `least` letters. No row is dropped."""
    first = lambda c: F.substring_index(c, " ", 1)
    keys = dimension.select(F.col(key).alias("_k")).distinct().filter(first("_k").rlike("[a-z]$"))
    short = F.expr("concat(substring(_k, 1, length(substring_index(_k, ' ', 1)) - 1), substring(_k, length(substring_index(_k, ' ', 1)) + 1))")
    one = keys.withColumn("_short", short).groupBy("_short").agg(F.count(F.lit(1)).alias("_n"), F.max("_k").alias("resolved")).filter("_n = 1").drop("_n")
    return misses.join(one.filter(F.length(first("_short")) >= least), F.lower(F.trim(F.col(name))) == F.col("_short"), "left").drop("_short")


def value_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of a key. Pairs are made distinct before they are gathered, so a frequent pair is one row."""
    return rows.select(key, value).na.drop().distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def first_wins(rows: DataFrame, key: str, ordinal: str, *values: str) -> DataFrame:
    """(key, *values) of the row of least ordinal of each key; values break ties. Null keys go. It combines before the shuffle, unlike a window."""
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(ordinal, *values)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{v}").alias(v) for v in values])


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys with exactly one distinct value; others have a null."""
    return rows.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias(value))


def inverted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): all values of a key in their order, each once."""
    return rows.select(key, value).na.drop().distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def near_names(names: DataFrame, name: str, most: int) -> DataFrame:
    """(a, b, distance), a < b, of every two distinct names within an edit distance of `most`. Of most + 1 pieces of a name one is whole in any such other, at most `most` places
    off; so pieces are joined by equality, and only what shares one is compared. A name shorter than its number of pieces has empty ones, which all names hold."""
    words = names.select(F.col(name).alias("w")).na.drop().distinct()
    n, k = F.length("w"), most + 1
    cut = lambda i: F.floor(n * i / k).cast("int")
    pieces = F.array(*[F.struct(cut(i).alias("at"), F.substring("w", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(k)])
    own = words.select(F.col("w").alias("a"), F.explode(pieces).alias("p")).select("a", "p.at", "p.piece")
    lengths = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(n - most, F.lit(0)), n + most), lambda m: F.array(F.floor(m / k).cast("int"), F.ceil(m / k).cast("int")))))
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.struct(i.cast("int").alias("off"), F.substring(F.col("w"), (i + 1).cast("int"), m).alias("piece")))))
    other = words.select(F.col("w").alias("b"), F.explode(parts).alias("p")).select("b", "p.off", "p.piece")
    pairs = own.join(other, "piece").filter((F.abs(F.col("at") - F.col("off")) <= most) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)
