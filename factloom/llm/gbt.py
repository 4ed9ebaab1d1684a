"""Gradient-boosted trees and isotonic calibration as DataFrame code.

The fit runs over a bounded sample: Spark finds quantile cuts and counts rows by their bins, and the driver grows trees on
those counts. A fitted model is a list of trees whose margin is one SQL expression, so scoring is a projection.

A sample without rows of both labels gives a constant model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.stage import materialize


def bounded_sample(df: DataFrame, key: str, values: dict[str, Column], rows: int, name: str) -> DataFrame:
    """key and the aggregates ``values`` of about ``rows`` distinct keys of df at most, chosen by their hash, so that a key
    counts once however often it stands. Both passes run over df as it is split, and only the sample moves. Written once."""
    n = df.agg(F.approx_count_distinct(key, 0.02).alias("n")).first()["n"]
    if n > rows:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(2**31)) < int(2**31 * rows / n))
    sample = df.groupBy(key).agg(*[v.alias(k) for k, v in values.items()])
    return materialize(sample, name)


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


@dataclass
class Tree:
    """A split on feature > cut, or a leaf."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def expr(self, x) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(x(self.feature, self.cut), self.high.expr(x)).otherwise(self.low.expr(x))


@dataclass
class Model:
    prior: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, names: list[str]) -> Column:
        """The margin from columns that hold the features."""
        total = F.lit(float(self.prior))
        for t in self.trees:
            total = total + t.expr(lambda f, cut: F.col(names[f]) > F.lit(float(cut)))
        return total


@dataclass
class Binned:
    """A sample's distinct rows by binned features, with label, fold and count; the cuts of each feature."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    w: np.ndarray
    cuts: list[list[float]]

    def boosted(self, w: np.ndarray, rounds: int, depth: int, rate: float, l2: float) -> tuple[Model, np.ndarray]:
        """Trees grown on the rows by their weights, and the margin of every row, of those that weigh nothing as well."""
        n, pos = w.sum(), (w * self.y).sum()
        if not 0 < pos < n:
            prior = 20.0 if pos else -20.0
            return Model(prior=prior), np.full(len(w), prior)
        model = Model(prior=math.log(pos / (n - pos)))
        margin = np.full(len(w), model.prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, value = _grow(self.x, w * (self.y - p), w * p * (1 - p), np.ones(len(w), bool), self.cuts, depth, rate, l2)
            margin = margin + value
            model.trees.append(tree)
        return model, margin


def binned(df: DataFrame, names: list[str], label: str, fold: Column | None = None, bins: int = 16) -> Binned:
    """df: a bounded sample with features ``names`` and a 0/1 label. Rows without a label are left out. Spark cuts the
    features into bins and counts equal rows, of which there are no more than rows in the sample."""
    df = df.filter(F.col(label).isNotNull())
    marks = [i / bins for i in range(1, bins)]
    edges = [(F.min, "lo"), (F.max, "hi")]
    quantiles = [F.percentile_approx(n, marks, 2000).alias(f"q{i}") for i, n in enumerate(names)]
    top = df.agg(*quantiles, *[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for f, k in edges]).first()
    seen = [sorted({c for c in [top[f"lo{i}"], top[f"hi{i}"], *(top[f"q{i}"] or [])] if c is not None}) for i in range(len(names))]
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in seen]
    x = F.array(*[sum((F.when(F.col(c) > F.lit(float(v)), 1).otherwise(0) for v in cuts[i]), F.lit(0)) for i, c in enumerate(names)])
    part = (F.lit(0) if fold is None else fold).cast("int").alias("f")
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), part).groupBy("x", "y", "f").agg(F.count("*").cast("double").alias("w")).collect()
    rows = sorted((tuple(r["x"]), r["y"], r["f"], r["w"]) for r in rows)
    columns = [np.array([r[i] for r in rows]) for i in range(4)]
    return Binned(columns[0].reshape(len(rows), len(names)).astype(int), *columns[1:], cuts)


def fit(df: DataFrame, names: list[str], label: str, rounds: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.4, l2: float = 1.0) -> Model:
    """Trees grown on the driver from the counts of a bounded sample. Sums run in a fixed order, so reruns agree."""
    rows = binned(df, names, label, None, bins)
    return rows.boosted(rows.w, rounds, depth, rate, l2)[0]


def fit_calibrated(df: DataFrame, names: list[str], label: str, fold: Column, rounds: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.4, l2: float = 1.0) -> tuple[Model, list[tuple[float, float]]]:
    """The trees of all rows, and calibration knots from margins out of fold: those of trees grown on the other folds."""
    rows = binned(df, names, label, fold, bins)
    margin = np.zeros(len(rows.w))
    for k in np.unique(rows.fold):
        own = rows.fold == k
        margin[own] = rows.boosted(np.where(own, 0.0, rows.w), rounds, depth, rate, l2)[1][own]
    return rows.boosted(rows.w, rounds, depth, rate, l2)[0], isotonic(margin, rows.y, rows.w)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, cuts: list[list[float]], depth: int, rate: float, l2: float) -> tuple[Tree, np.ndarray]:
    """The tree over the rows of ``own``, and its value for each row. Ties go to the first feature and bin."""
    g_all, h_all = g[own].sum(), h[own].sum()
    best, most = None, 1e-6
    for f in range(x.shape[1]) if depth else ():
        if cuts[f]:
            gs, hs = (np.cumsum(np.bincount(x[own, f], v[own], len(cuts[f]) + 1))[:-1] for v in (g, h))
            gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            gain[np.minimum(hs, h_all - hs) < 1e-3] = 0
            if gain.max() > most + 1e-9:
                best, most = (f, int(gain.argmax())), gain.max()
    if not best:
        value = float(rate * g_all / (h_all + l2))
        return Tree(value=value), np.where(own, value, 0.0)
    f, b = best
    high = x[:, f] > b
    (low_tree, low), (high_tree, up) = (_grow(x, g, h, own & side, cuts, depth - 1, rate, l2) for side in (~high, high))
    return Tree(feature=f, cut=cuts[f][b], low=low_tree, high=high_tree), low + up


#: Margins are gathered in steps of 1 / STEPS between -SPAN and SPAN for calibration.
STEPS, SPAN = 16, 8


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over a histogram of margins: (margin, probability) knots, both rising."""
    step = np.round(np.clip(margin, -SPAN, SPAN) * STEPS).astype(int)
    blocks: list[list[float]] = []
    for b in np.unique(step):
        own = step == b
        n = float(w[own].sum())
        blocks.append([b / STEPS * n, n, float((w * y)[own].sum())])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [(m / n, (pos + 0.05) / (n + 0.1)) for m, n, pos in blocks]


def calibrated(margin: Column, knots: list[tuple[float, float]]) -> Column:
    """The knots joined by lines, with a slight rise beyond both ends, so that the order of margins is kept."""
    if len(knots) < 2:
        return probability(margin)
    (m0, p0), (m1, p1) = knots[0], knots[-1]
    out = F.lit(p1) + F.lit(1 - p1) * (1 - F.exp(-(margin - F.lit(m1)) / 50))
    for (a, pa), (b, pb) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(margin <= F.lit(b), F.lit(pa) + (margin - F.lit(a)) * F.lit((pb - pa) / max(b - a, 1e-9))).otherwise(out)
    low = F.lit(p0) * F.exp((margin - F.lit(m0)) / 50)
    return F.least(F.greatest(F.when(margin <= F.lit(m0), low).otherwise(out), F.lit(0.0)), F.lit(1.0))
