"""Models fitted from sums: Spark adds up moments over all rows, the driver solves for as many unknowns as features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settle import settled

#: Sets of bins, with their sums, that a task of the learner holds.
CELLS = 250_000


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) over rows where all `columns` are finite, in one aggregation."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf"))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = df.where(good).agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.coalesce(F.sum(F.col(columns[i]) * F.col(columns[j])), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    sums = np.array([got[f"s{i}"] for i in range(len(columns))], dtype=float)
    products = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        products[i, j] = products[j, i] = got[f"p{i}_{j}"]
    return got["n"], sums, products


def ridge_nonnegative(df: DataFrame, features: list[str], label: str, l2: float = 1.0, rounds: int = 10_000, tolerance: float = 1e-12) -> dict[str, float]:
    """Weights of at least 0 that minimise squared error plus `l2` times their squares, by coordinate descent on the Gram matrix."""
    n, _, products = moments(df, [*features, label])
    w = nonnegative(products[:-1, :-1], products[:-1, -1], l2, rounds, tolerance) if n else np.zeros(len(features))
    return dict(zip(features, w.tolist(), strict=True))


def nonnegative(gram: np.ndarray, right: np.ndarray, l2: float, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """The weights of at least 0 of a ridge problem given by its sums of products."""
    gram, w = gram + l2 * np.eye(len(gram)), np.zeros(len(gram))
    for _ in range(rounds):
        before = w.copy()
        for k in range(len(w)):
            w[k] = max(0.0, (right[k] - gram[k] @ w + gram[k, k] * w[k]) / gram[k, k])
        if np.abs(w - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def linear_score(weights: dict[str, float], centre: dict[str, float] | None = None, scale: dict[str, float] | None = None) -> Column:
    """The weighted sum of features, each centred and scaled first; a missing feature counts as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce((F.col(name) - (centre or {}).get(name, 0.0)) / (scale or {}).get(name, 1.0), F.lit(0.0)) * w
    return total


class Components:
    """Principal components of standardised features: means, spreads, loadings (a row a component), shares of variance."""

    def __init__(self, features: list[str], mean: np.ndarray, spread: np.ndarray, loadings: np.ndarray, explained: np.ndarray):
        self.features, self.mean, self.spread, self.loadings, self.explained = features, mean, spread, loadings, explained

    def columns(self) -> dict[str, Column]:
        """Expressions of the components; null where a feature is missing."""
        out = {}
        for k, row in enumerate(self.loadings):
            total = F.lit(0.0)
            for name, m, s, w in zip(self.features, self.mean, self.spread, row, strict=True):
                total = total + (F.col(name) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
            out[f"pc{k + 1}"] = total
        return out


def fit_components(df: DataFrame, features: list[str], count: int) -> Components:
    """The first `count` components over rows where all features are finite.

    A component's sign is arbitrary; here its largest loading (the first of equals) is positive. A feature without
    spread raises.
    """
    n, sums, products = moments(df, features)
    if n < 2:
        raise ValueError("principal components need two rows or more")
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    if flat := [f for f, s in zip(features, spread, strict=True) if s < 1e-12]:
        raise ValueError(f"no spread in {', '.join(flat)}")
    values, vectors = np.linalg.eigh(covariance / np.outer(spread, spread))
    order = np.argsort(-values, kind="stable")[:count]
    loadings = vectors[:, order].T
    for row in loadings:
        if row[np.argmax(np.abs(row) >= np.abs(row).max() - 1e-12)] < 0:
            row *= -1
    return Components(features, mean, spread, loadings, values[order] / values.sum())


def cut_points(df: DataFrame, columns: list[str], bins: int, slack: float = 2e-4) -> list[list[float]]:
    """For each column, in order, the values that cut it into `bins` parts of about equal numbers of rows.

    These are the values at positions floor(k n / bins), from 0, of all rows in order, or every value if there are not more
    than `bins`. The approximate quantiles only guide: values around them, `slack` of the rows at either side, are counted
    exactly, so that no layout of the rows moves a cut, and of the others only numbers leave a task. No value may be missing.
    """
    shares = [min(1.0, max(0.0, k / bins + d)) for k in range(1, bins) for d in (-slack, slack)]
    guides = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    if guides[0] is None:  # no rows
        return [[] for _ in columns]
    ends = [np.array(g).reshape(-1, 2) for g in guides]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [np.empty(0) for _ in ends]
        for batch in batches:
            for i, pair in enumerate(ends):
                x, n = np.unique(batch.column(i).to_numpy(zero_copy_only=False) + 0.0, return_counts=True)
                some[i] = np.unique(np.concatenate([some[i], x[: bins + 1]]))[: bins + 1]
                at = np.searchsorted(pair[:, 1], x, "left")  # the first guide that ends at the value or behind it
                near = (at < len(pair)) & (x >= pair[np.minimum(at, len(pair) - 1), 0])
                far = np.bincount(at[~near], n[~near], minlength=len(pair) + 1).astype(np.int64)
                k = np.concatenate([np.flatnonzero(far), at[near]])
                value = np.concatenate([np.full(np.count_nonzero(far), np.nan), x[near]])
                yield _counted(i, k, value, np.concatenate([far[far > 0], n[near]]))
        for i, x in enumerate(some):
            yield _counted(i, np.full(len(x), -1), x, np.zeros(len(x), dtype=np.int64))

    places = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(count, "i int, k int, value double, n long")
    places = settled(places.groupBy("i", "k", "value").agg(F.sum("n").alias("n")))
    few: list[list[float]] = [[] for _ in columns]
    totals = np.zeros((len(columns), bins, 2), dtype=np.int64)
    for r in places.where("k < 0").groupBy("i").agg(F.slice(F.sort_array(F.collect_set("value")), 1, bins + 1).alias("x")).collect():
        few[r.i] = list(r.x)
    for r in places.where("k >= 0").groupBy("i", "k", F.isnan("value").alias("far")).agg(F.sum("n").alias("n")).collect():
        totals[r.i, r.k, 0 if r.far else 1] = r.n
    wanted = []
    for i, t in enumerate(totals):
        before = np.cumsum(t.ravel()).reshape(t.shape)  # rows before a guide's own, and with them
        at = np.array([k * int(t.sum()) // bins for k in range(1, bins)])
        k = np.searchsorted(before[:, 1], at, "right")
        wanted += [(i, int(a), int(b - before[a, 0])) for a, b in zip(k, at, strict=True)]
    if any(nth < 0 for *_, nth in wanted):  # a guide was further off
        return cut_points(df, columns, bins, slack * 10)
    asked = df.sparkSession.createDataFrame(wanted, "i int, k int, nth long")
    upto = F.sum("n").over(W.partitionBy("i", "k").orderBy("value"))
    found = places.where("k >= 0 AND NOT isnan(value)").withColumn("upto", upto).join(F.broadcast(asked), ["i", "k"]).where("upto > nth AND upto - n <= nth")
    cuts = [[] for _ in columns]
    for r in found.select("i", "value").distinct().collect():
        cuts[r.i].append(r.value)
    return [sorted(f if len(f) <= bins else c) for f, c in zip(few, cuts, strict=True)]


def _counted(i: int, k: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i), pa.int32()), pa.array(k, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], ["i", "k", "value", "n"])


class Boosted:
    """Boosted trees over the bins of features: the cuts of each feature and Spark's model of the numbers of bins."""

    def __init__(self, features: list[str], cuts: list[list[float]]):
        self.features, self.cuts, self.model = features, cuts, None

    def binned(self, df: DataFrame) -> DataFrame:
        """`df` with _bin0, _bin1 and so on; rows with a missing feature are left out."""
        from pyspark.ml.feature import Bucketizer

        inf = float("inf")
        splits = [[-inf, *([c for c in cuts if abs(c) < inf] or [0.0]), inf] for cuts in self.cuts]
        return Bucketizer(splitsArray=splits, inputCols=self.features, outputCols=self.bins, handleInvalid="skip").transform(df)

    @property
    def bins(self) -> list[str]:
        return [f"_bin{i}" for i in range(len(self.features))]


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3, seed: int = 7, bins: int = 32) -> Boosted:
    """Gradient-boosted trees over rows where all columns are finite, by Spark's own distributed learner.

    Trees see a feature only by its bin, and squared error only by numbers and means of labels. So the learner is given
    a row for each set of bins that occurs, with its number of rows and mean label, which yields the trees of the rows
    themselves; however many rows there are, these are at most `bins` to the power of the features. A task's share of them is
    bounded.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    good = F.lit(True)
    for c in (*features, label):
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf"))
    rows = df.where(good)
    fitted = Boosted(features, cut_points(rows, features, bins))
    cells = settled(fitted.binned(rows).groupBy(*fitted.bins).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(label).alias("_label")))
    cells = cells.repartition(-(-max(1, cells.count()) // CELLS), *fitted.bins).sortWithinPartitions(*fitted.bins)
    cells = VectorAssembler(inputCols=fitted.bins, outputCol="_features").transform(cells)
    learner = GBTRegressor(featuresCol="_features", labelCol="_label", weightCol="_n", predictionCol="score", maxIter=rounds, maxDepth=depth, maxBins=bins + 1, stepSize=0.1, seed=seed)
    fitted.model = learner.fit(cells)
    return fitted


def boosted_score(fitted: Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """`df` with score; rows with a missing feature are left out."""
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=fitted.bins, outputCol="_features").transform(fitted.binned(df))
    return fitted.model.transform(assembled).drop("_features", *fitted.bins)
