"""Label trees as rows: nodes(doc, node, parent, ordinal, name), where a leaf's name is `Key: Value`. Roots have a null parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpair.functions.rules import before_parentheses, key_value, last_value
from lumenpair.functions.scalars import blank

c = F.col


def child(nodes: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """(doc, parent, node): of each of parents(doc, node) the first child with exactly this name. Combined before the shuffle."""
    some = nodes.filter(c("name") == name).join(parents.select("doc", c("node").alias("parent")), ["doc", "parent"], "left_semi")
    return some.groupBy("doc", "parent").agg(F.min(F.struct("ordinal", "node")).alias("_b")).select("doc", "parent", c("_b.node").alias("node"))


def leaf(nodes: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """(doc, parent, value): of each of parents(doc, node) the value of its first child with this key; null where that is empty."""
    kv = key_value(c("name"))
    some = nodes.filter(kv["key"] == key).join(parents.select("doc", c("node").alias("parent")), ["doc", "parent"], "left_semi")
    first = some.groupBy("doc", "parent").agg(F.min(F.struct("ordinal", kv["value"].alias("v"))).alias("_b"))
    return first.select("doc", "parent", F.when(~blank(c("_b.v")), c("_b.v")).alias("value"))


def first_descendant(nodes: DataFrame, roots: DataFrame, wanted: Column, deepest: int = 64) -> DataFrame:
    """(doc, root, node, name): below each of roots(doc, node) the first node, depth first, for which `wanted` holds. One join a level, until a level is empty; paths of padded
    ordinals order the nodes as a walk meets them. A tree deeper than `deepest` raises."""
    found, level = None, roots.select("doc", c("node").alias("root"), c("node").alias("at"), F.lit("").alias("path"))
    below = nodes.select("doc", c("parent").alias("at"), "node", "name", F.concat(F.lit("/"), F.lpad(c("ordinal").cast("string"), 12, "0")).alias("_p"))
    for _ in range(deepest):
        level = level.join(below, ["doc", "at"]).select("doc", "root", c("node").alias("at"), F.concat("path", "_p").alias("path"), "name")
        if level.isEmpty():
            break
        hits = level.filter(wanted)
        found = hits if found is None else found.unionByName(hits)
        level = level.drop("name")
    else:
        raise ValueError(f"a tree is deeper than {deepest}")
    if found is None:
        return nodes.select("doc", c("node").alias("root"), "node", "name").limit(0)
    return found.groupBy("doc", "root").agg(F.min(F.struct("path", c("at").alias("node"), "name")).alias("_b")).select("doc", "root", "_b.node", "_b.name")


def refills(own: Column, total: Column) -> Column:
    """struct(value, from_total) of a leaf with the refills, which goes first, and of one with all fills, whose remark in parentheses is dropped. Null without either."""
    some = lambda v: F.when(~blank(v), v)
    return F.when(own.isNotNull(), F.struct(some(last_value(own)).alias("value"), F.lit(False).alias("from_total"))).when(total.isNotNull(), F.struct(some(before_parentheses(last_value(total))).alias("value"), F.lit(True).alias("from_total")))


def last_first_middle(first: Column, middle: Column, last: Column) -> Column:
    """Last, First Middle of what there is of them."""
    given = F.array_join(F.filter(F.array(first, middle), lambda p: ~blank(p)), " ")
    return F.when(blank(last), F.nullif(given, F.lit(""))).when(given == "", F.trim(last)).otherwise(F.concat(F.trim(last), F.lit(", "), given))
