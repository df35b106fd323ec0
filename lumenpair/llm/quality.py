"""Operator 2: a quality classifier as a sparse rule ensemble compiled into Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.llm._spark import free, table

#: At most so many labelled rows, chosen by a hash of doc_id, fit the model. Scoring covers every document.
MAX_FIT_ROWS = 20_000
SYMBOLS = "#*$%&|!~^=_<>{}[]\\"
STATISTICS = ("n_words", "word_chars", "distinct_share", "symbol_share", "upper_share", "digit_share", "bang_share", "bar_share", "line_words", "distinct_line_share", "stop_share")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as an empty one. None is null, each is finite."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    gone = lambda marks: reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), marks, t)
    share = lambda c: (F.length(t) - F.length(c)) / chars
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "n_words": n_words,
        "word_chars": over(F.length(t).cast("double"), n_words),
        "distinct_share": over(F.size(F.array_distinct(words)).cast("double"), n_words),
        "symbol_share": share(gone(SYMBOLS)),
        "upper_share": share(F.regexp_replace(t, r"\p{Lu}+", "")),
        "digit_share": share(F.regexp_replace(t, r"\d+", "")),
        "bang_share": share(gone("!")),
        "bar_share": share(gone("|")),
        "line_words": over(n_words, n_lines),
        "distinct_line_share": over(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "stop_share": share(gone(".?;:")),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above, limit), and its weight. It is 1 where all hold."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(f"`{s}`") > v) if up else (F.col(f"`{s}`") <= v) for s, up, v in self.tests])

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > v) if up else (x[s] <= v) for s, up, v in self.tests])


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    def logit(self) -> Column:
        """The ensemble as one expression over the statistics' columns."""
        return reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules], F.lit(float(self.bias)))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.of(x) for r in self.rules), np.zeros(n)))))


def tree_paths(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: list[np.ndarray], depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree grown on gradients; (the path to every node but the root, the step of each row)."""
    paths, step = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if left else ():
            if not len(bins[f]):
                continue
            place = np.searchsorted(bins[f], x[rows, f], side="left")
            gs = np.cumsum(np.bincount(place, grad[rows], len(bins[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(place, hess[rows], len(bins[f]) + 1))[:-1]
            ns = np.cumsum(np.bincount(place, minlength=len(bins[f]) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, float(bins[f][k]))
        if best[1] is None:
            step[rows] = -g / (h + 1)
            return
        _, f, v = best
        up = x[rows, f] > v
        for side, own in ((False, rows[~up]), (True, rows[up])):
            paths.append((*path, (f, side, v)))
            grow(own, paths[-1], left - 1)

    grow(np.arange(len(grad)), (), depth)
    return paths, step


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, rounds: int = 1500) -> Model:
    """Boosted trees give the rules; lasso logistic regression gives most of them weight zero, and those go.

    Labels of one kind only, or none, give a model without rules that says that kind (without labels: 1)."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Model((), 4.0 if not len(y) or y[0] > 0 else -4.0)
    names = list(x)
    m = np.column_stack([x[s] for s in names])
    bins = [np.unique(np.quantile(m[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(m.shape[1])]
    base = np.log(y.mean() / (1 - y.mean()))
    score, paths = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        got, step = tree_paths(m, p - y, p * (1 - p) + 1e-6, bins, depth, max(3, len(y) // 500))
        score += 0.3 * step
        for path in got:
            tests = {}  # of limits on one side of a statistic the narrowest is enough
            for f, up, v in path:
                tests[f, up] = max(v, tests.get((f, up), v)) if up else min(v, tests.get((f, up), v))
            paths[tuple(sorted((names[f], up, v) for (f, up), v in tests.items()))] = None
    rules = [Rule(t) for t in paths]
    r = np.column_stack([rule.of(x) for rule in rules]).astype(float)
    keep = np.unique(r, axis=1, return_index=True)[1]
    rules, r = [rules[k] for k in sorted(keep)], r[:, sorted(keep)]
    rate = 4 / max(1e-9, np.linalg.norm(r / np.sqrt(len(y)), 2) ** 2 + 1)
    w, bias = np.zeros(r.shape[1]), base
    ahead, ahead_bias, t = w, bias, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        off = 1 / (1 + np.exp(-(r @ ahead + ahead_bias))) - y
        new = ahead - rate * (r.T @ off) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = ahead_bias - rate * off.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return Model(tuple(Rule(rule.tests, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-6), float(bias))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, column: str = "quality") -> Model:
    """Fits on documents with a label: at most max_rows of them, those of least doc_id hash. A doc_id with several labels counts with the least;
    null ids and labels don't count."""
    known = labels.select("doc_id", F.col(f"`{column}`").cast("int").alias("y")).na.drop().groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_rows rows
    stats = statistics(F.col("text"))
    got = rows.select("y", "doc_id", *[c.alias(s) for s, c in stats.items()]).toPandas().sort_values(["doc_id", *STATISTICS])
    return fit({s: got[s].to_numpy(float) for s in STATISTICS}, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, score, keep) for each row of docs(doc_id, text, ...), repeated rows and rows without doc_id included; keep is score >= threshold.
    Null and empty texts are scored as texts without words. Texts count whole. One scan: no shuffle, no Python."""
    stats = docs.select("doc_id", *[c.alias(s) for s, c in statistics(F.col("text")).items()])
    p = 1 / (1 + F.exp(-model.logit()))
    return stats.select("doc_id", "n_words", F.round(p, 6).alias("score"), (p >= threshold).alias("keep"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns, extra ones of any name included."""
    stat = free(docs, "stat")
    p = 1 / (1 + F.exp(-model_logit_of(model, stat)))
    packed = docs.withColumn(stat, F.struct(*[c.alias(s) for s, c in statistics(F.col("`text`")).items()]))
    return packed.filter(p >= threshold).drop(stat)


def model_logit_of(model: Model, struct: str) -> Column:
    inside = tuple(Rule(tuple((f"{struct}`.`{s}", up, v) for s, up, v in r.tests), r.weight) for r in model.rules)
    return Model(inside, model.bias).logit()


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES, SQL = {"op2_quality": op2_quality}, {}
