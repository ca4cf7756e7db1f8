"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small boosted trees over them are grown on labelled rows; every path from a root
is a conjunctive rule; a lasso logistic fit gives most rules the weight zero; the rest become one Spark column
expression, so scoring is a projection without Python.

The labels are learnt from a bounded sample, the labelled rows of smallest hash outside the held-out fold.

Rows: null and empty texts have statistics of zero and get a score like any other; repeated rows and null ids give a row
each; statistics cover whole texts; null labels teach nothing; with labels of one class or none every score is the share
of good labels (0.5 without labels); an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from filmloom.llm.common import fold_of, saved, texts

SAMPLE = 20_000
TREES = 60
DEPTH = 3
LEAST = 15  # rows on each side of a split
BINS = 64
LASSO = 0.002
_SPACE = "[ \\t-\\r]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    # Arrays are made once, in a projection of their own, and counted in the next one.
    parts = texts(docs).select(
        F.col("doc_id").cast("bigint"), "text", words.alias("words"), F.split("text", "\n").alias("lines"))
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.length("text"), F.lit(1))
    n_words, n_lines = F.size("words"), F.size("lines")
    return parts.select(
        "doc_id", F.log1p(F.length("text")).alias("log_chars"), F.log1p(n_words).alias("log_words"),
        (F.length("text") / F.greatest(n_words, F.lit(1))).alias("word_length"),
        (F.size(F.array_distinct("words")) / F.greatest(n_words, F.lit(1))).alias("distinct_words"),
        (F.log1p(F.size(F.array_distinct("words"))) / F.log1p(F.greatest(n_words, F.lit(1)))).alias("vocabulary"),
        (F.size(F.array_distinct("lines")) / n_lines).alias("distinct_lines"),
        (n_words / n_lines).alias("line_words"),
        share("[A-Z]").alias("capitals"), share("[0-9]").alias("digits"), share("[.,;:]").alias("stops"),
        share("[#$%&*@^~<>{}\\[\\]\\\\]").alias("signs"), share("!").alias("calls"), share("\\|").alias("bars"),
        share("[^\\x00-\\x7F]").alias("beyond_ascii"))


class Tree:
    """A regression tree over binned columns, grown on gradients and curvatures of the logistic loss."""

    def __init__(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        self.rules: list[tuple[tuple[int, int, bool], ...]] = []
        self.value = np.zeros(len(g))
        self._grow(bins, g, h, np.arange(len(g)), depth, ())

    def _grow(self, bins, g, h, rows, depth, path) -> None:
        self.value[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
        if not depth or len(rows) < 2 * LEAST:
            return
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, None, None)
        for k in range(bins.shape[1]):
            b = bins[rows, k]
            sums = [np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
            gain = sums[0] ** 2 / (sums[1] + 1) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1) - total_g ** 2 / (total_h + 1)
            gain[(sums[2] < LEAST) | (len(rows) - sums[2] < LEAST)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        if best[1] is None:
            return
        _, k, at = best
        below = bins[rows, k] <= at
        for side, keep in ((True, below), (False, ~below)):
            step = (*path, (k, at, side))
            self.rules.append(step)
            self._grow(bins, g, h, rows[keep], depth - 1, step)


def simplified(rule: tuple[tuple[int, int, bool], ...]) -> tuple[tuple[int, int, bool], ...]:
    """One bound below and one above for each column, in order, so that equal rules are equal tuples."""
    bounds: dict[tuple[int, bool], int] = {}
    for k, at, below in rule:
        old = bounds.get((k, below))
        bounds[k, below] = at if old is None else min(old, at) if below else max(old, at)
    return tuple(sorted((k, at, below) for (k, below), at in bounds.items()))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic fit, by accelerated proximal gradient steps."""
    n = len(y)
    one = np.hstack([x, np.ones((n, 1))])
    v = np.ones(one.shape[1])
    for _ in range(20):
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(one.T @ (one @ v)) / n + 1e-12)
    w = z = np.zeros(one.shape[1])
    for k in range(steps):
        new = z - rate * (one.T @ (1 / (1 + np.exp(-np.clip(one @ z, -30, 30))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        z = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Rules:
    """Weighted rules over named columns: rule = ((column, bound, whether at most the bound), ...)."""

    def __init__(self, weighted: list[tuple[float, tuple[tuple[str, float, bool], ...]]], intercept: float):
        self.weighted, self.intercept = weighted, intercept

    def column(self) -> Column:
        """The score as one expression of the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            holds = None
            for name, bound, below in rule:
                one = F.col(name) <= F.lit(bound) if below else F.col(name) > F.lit(bound)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(measured: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Rules:
    """Rules from the labelled rows of smallest hash outside the held-out fold."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1))
             .filter(F.col("doc_id").isNotNull()).filter(fold_of("doc_id", folds) != held_out)
             .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    names = [c for c in measured.columns if c != "doc_id"]
    # Repeated ids can give more rows than labels; the order makes the sample the same each time.
    rows = (measured.join(F.broadcast(known), "doc_id").select(*names, "y", F.xxhash64("doc_id").alias("seat"))
            .orderBy("seat", "y", *names).limit(sample).toArrow())
    x = np.column_stack([rows.column(c).to_numpy().astype(float) for c in names]) if len(rows) else np.zeros((0, len(names)))
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules([], math.log(share / (1 - share)) if 0 < share < 1 else 40.0 if share else -40.0)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(len(names))]
    bins = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    found: set[tuple] = set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = Tree(bins, p - y, p * (1 - p), DEPTH)
        if not tree.rules:
            break
        margin += 0.2 * tree.value
        found.update(map(simplified, tree.rules))
    rules = sorted(found)
    holds = np.ones((len(y), len(rules)))
    for j, rule in enumerate(rules):
        for k, at, below in rule:
            holds[:, j] *= (bins[:, k] <= at) if below else (bins[:, k] > at)
    weights, intercept = lasso(holds, y, LASSO)
    named = lambda rule: tuple((names[k], float(cuts[k][at]), below) for k, at, below in rule)
    return Rules([(float(w), named(r)) for w, r in zip(weights, rules) if w], intercept)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    measured = saved(statistics(docs), "statistics")
    rules = fit(measured, labels, folds, held_out)
    return measured.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), rules.column().alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
