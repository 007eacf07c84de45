"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Each feature is cut into quantile bins. Rounds go through the features in turn; a tree of at most four leaves over the feature's bins, fitted
to the gradients, is added to the feature's table. Then the pairs whose quadrants explain most of the remaining gradients get tables of their
own in the same way. A score is the logistic of the intercept plus one table entry for each feature and pair: vectorised additions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts
from .textstats import FEATURES, features

#: Labelled rows that a model is fitted on, at most; they are those with the least hashes of their ids.
FIT_ROWS = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 48, 60, 30, 6, 0.25, 2.0
THRESHOLD = 0.3


def _stump(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree that splits ordered bins where the squared gradient gains most, depth times."""
    if depth:
        gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
        gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE)
        if len(gain) and gain.max() > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            k = int(gain.argmax()) + 1
            return np.concatenate([_stump(g[:k], h[:k], depth - 1), _stump(g[k:], h[k:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cross cut of a table of bins."""
    gc, hc = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, at = -1.0, (0, 0)

    def parts(c: np.ndarray, i, j) -> list:
        return [c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]]

    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(parts(gc, i, j), parts(hc, i, j), strict=True)) if i.size else np.zeros((0, 0))
    if gain.size:
        at = np.unravel_index(gain.argmax(), gain.shape)
        best = float(gain[at])
    out = np.empty_like(g)
    a, b = at[0] + 1, at[1] + 1
    v = [x / (y + RIDGE) for x, y in zip(parts(gc, a, b), parts(hc, a, b), strict=True)] if gain.size else [0.0] * 4
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return best, out


class AdditiveModel:
    """Cut points of each feature, a table for each feature and each chosen pair, and an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(m)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if n and 0 < y.sum() < n:
            self._fit(self.bins(x), y)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def _fit(self, bins: list[np.ndarray], y: np.ndarray) -> None:
        z = np.full(len(y), self.intercept)

        def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

        for _ in range(ROUNDS):
            for k, at in enumerate(bins):
                step = RATE * _stump(*slopes(at, len(self.tables[k])), 2)
                self.tables[k] += step
                z += step[at]
        wide = [len(t) for t in self.tables]
        flat = {(i, j): bins[i] * wide[j] + bins[j] for i in range(len(bins)) for j in range(i)}
        tables = {p: tuple(v.reshape(wide[p[0]], wide[p[1]]) for v in slopes(at, wide[p[0]] * wide[p[1]])) for p, at in flat.items()}
        self.pairs = sorted(tables, key=lambda p: -_quadrants(*tables[p])[0])[:PAIRS]
        self.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for table, p in zip(self.pair_tables, self.pairs, strict=True):
                step = RATE * _quadrants(*(v.reshape(table.shape) for v in slopes(flat[p], table.size)))[1]
                table += step
                z += step.ravel()[flat[p]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.intercept)
        for table, at in zip(self.tables, bins, strict=True):
            z += table[at]
        for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            z += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, make: Callable, schema: str, rows: int = FIT_ROWS) -> DataFrame:
    """(label, what make gives for the text) of at most ``rows`` labelled documents that aren't held out, in a fixed order of their hashes.

    Ids with several labels count once, as 1 if most say so; null ids and labels are left out. The ids that are joined are bounded by rows,
    so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64("doc_id").alias("hash"), "text")
    return map_texts(texts, ["label", "hash"], "text", make, schema).orderBy("hash", "label", *[f"`{f.split()[0]}`" for f in schema.split(", ")][:1]).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> AdditiveModel:
    names = ", ".join(f"{f} double" for f in FEATURES)
    data = labelled(docs, labels, label, lambda: lambda texts: [tuple(features(x)) for x in texts], names, rows).toPandas()
    return AdditiveModel(data[FEATURES].to_numpy(float), data["label"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep of docs with score (0 to 1) and predicted (1 from the threshold on).

    Null and empty texts get the score of a text without words. No shuffle; repeated rows get equal scores.
    """

    def make():
        def run(texts: list[str]) -> list[tuple[float, int]]:
            s = model.score(np.array([features(x) for x in texts], float).reshape(len(texts), len(FEATURES))).tolist()
            return [(x, int(x >= threshold)) for x in s]

        return run

    return map_texts(docs, keep, "text", make, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs. Without labels of both kinds all scores are one prior share."""
    return score(docs, fit(docs, labels, rows=rows), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; the model's columns can't clash, as all of docs' columns are moved aside first."""
    model, names = fit(docs, labels, rows=rows), docs.columns
    aside = docs.select(F.struct(*names).alias("row_of_classifier"), F.col("text").alias("text"))
    return score(aside, model, ["row_of_classifier"]).where("predicted = 1").select("row_of_classifier.*")
