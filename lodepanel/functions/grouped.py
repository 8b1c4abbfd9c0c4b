"""Rolling windows of an instrument and ranks of a cross-section in Arrow batches.

Spark deals and sorts the rows; a group is one instrument's rows or one cross-section. A window is updated row by row in the
order and with the formulas of Spark's own aggregates, for all windows of an instrument at once, so that a long window
costs a few array operations a step and not an interpreted aggregate a row and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operators of full windows: NULL until a window holds as many values as it is long.
ROLLING = ("ts_mean", "ts_sum", "ts_max", "ts_min", "ts_std", "ts_std0", "ts_var", "ts_skew", "ts_kurt", "ts_zscore", "ts_cov", "ts_corr")


def _doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of a column of doubles; missing ones hold 0."""
    missing = column.is_null().to_numpy()
    return (column.fill_null(0.0) if missing.any() else column).to_numpy(), missing


def _steps(x: np.ndarray, n: int) -> list[np.ndarray]:
    """The first, second, … value of each full window."""
    many = len(x) - n + 1
    return [x[k : k + many] for k in range(n)]


def _total(x: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(x) - n + 1)
    for v in _steps(x, n):
        total += v
    return total


def _extreme(pick: Callable, x: np.ndarray, n: int) -> np.ndarray:
    best = x[: len(x) - n + 1].copy()
    for v in _steps(x, n)[1:]:
        pick(best, v, out=best)
    return best


def _moments(x: np.ndarray, n: int, order: int) -> list[np.ndarray]:
    """Sums of powers 2 up to `order` of deviations from each window's mean."""
    avg, m2, m3, m4 = (np.zeros(len(x) - n + 1) for _ in range(4))
    for k, v in enumerate(_steps(x, n), 1):
        delta = v - avg
        step = delta / k
        avg += step
        m2 += delta * (delta - step)
        if order > 2:
            delta2, step2 = delta * delta, step * step
            m3 = m3 - 3.0 * step * m2 + delta * (delta2 - step2)
            if order > 3:
                m4 = m4 - 4.0 * step * m3 - 6.0 * step2 * m2 + delta * (delta * delta2 - step * step2)
    return [m2, m3, m4]


def _products(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Sums of products of deviations from both means of each window."""
    ax, ay, c = (np.zeros(len(x) - n + 1) for _ in range(3))
    for k, (v, w) in enumerate(zip(_steps(x, n), _steps(y, n), strict=True), 1):
        dx = v - ax
        ax += dx / k
        ay += (w - ay) / k
        c += dx * (w - ay)
    return c


def _over(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a / b, where b is 0)."""
    return a / np.where(b == 0, 1.0, b), b == 0


def windows(op: str, inputs: list[np.ndarray], n: int, memo: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """(value, missing) of an operator for each full window of `n` values without a missing one."""

    def moments(i: int, order: int) -> list[np.ndarray]:
        key = (id(inputs[i]), n)
        if memo.get(key, (0,))[0] < order:
            memo[key] = (order, _moments(inputs[i], n, order))
        return memo[key][1]

    x = inputs[0]
    if op in ("ts_sum", "ts_mean"):
        return _total(x, n) / (n if op == "ts_mean" else 1), None
    if op in ("ts_max", "ts_min"):  # NaN is the largest value
        return _extreme(np.maximum if op == "ts_max" else np.fmin, x, n), None
    if op == "ts_std0":
        return np.sqrt(moments(0, 2)[0] / n), None
    if op in ("ts_skew", "ts_kurt"):
        m2, m3, m4 = moments(0, 4 if op == "ts_kurt" else 3)
        if op == "ts_skew":
            value, flat = _over(np.sqrt(float(n)) * m3, np.sqrt(m2 * m2 * m2))
            return value * ((n * (n - 1)) ** 0.5 / (n - 2)), flat | (m2 == 0)
        value, flat = _over(n * m4, m2 * m2)
        return ((n + 1) * (value - 3.0) + 6) * ((n - 1) / ((n - 2) * (n - 3))), flat | (m2 == 0)
    if n == 1:  # no spread of one value
        return np.zeros(len(x)), np.ones(len(x), dtype=bool)
    if op == "ts_cov":
        return _products(*inputs, n) / (n - 1), None
    std = [np.sqrt(moments(i, 2)[0] / (n - 1)) for i in range(len(inputs))]
    if op == "ts_corr":
        return _over(_products(*inputs, n) / (n - 1), std[0] * std[1])
    if op == "ts_zscore":
        return _over(x[n - 1 :] - _total(x, n) / n, std[0])
    return (moments(0, 2)[0] / (n - 1) if op == "ts_var" else std[0]), None


def rolled(panel: DataFrame, asked: dict[str, tuple[str, tuple[str, ...], int]], keep: list[str], by: str = "instrument", order: str = "date") -> DataFrame:
    """`keep` of `panel` and a column for each (operator, columns of doubles, length), over the rows of `by` in `order`."""
    schema = T.StructType([*(panel.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in asked)])

    def group(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(order, "ascending")], null_placement="at_start"))
        columns = {c: _doubles(table.column(c)) for _, cs, _ in asked.values() for c in cs}
        out, memo, rows = table.select(keep), {}, table.num_rows
        for name, (op, cs, n) in asked.items():
            value, missing = np.zeros(rows), np.ones(rows, dtype=bool)
            if rows >= n:
                gone = np.cumsum(np.concatenate([[0], np.logical_or.reduce([columns[c][1] for c in cs])]))
                with np.errstate(all="ignore"):
                    value[n - 1 :], bad = windows(op, [columns[c][0] for c in cs], n, memo)
                missing[n - 1 :] = gone[n:] > gone[:-n]
                if bad is not None:
                    missing[n - 1 :] |= bad
            out = out.append_column(name, pa.array(value, pa.float64(), mask=missing))
        return out

    return panel.select(*dict.fromkeys([by, order, *keep, *(c for _, cs, _ in asked.values() for c in cs)])).groupBy(by).applyInArrow(group, schema)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks (ties share one) from 1; NaNs are equal and last."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])) if len(s) else np.zeros(0, dtype=int)
    many = np.diff(np.append(first, len(s)))
    out = np.empty(len(s))
    out[order] = np.repeat(first + (many + 1) / 2, many)
    return out


def ranked(rows: DataFrame, asked: dict[str, str], keep: list[str], by: list[str], share: bool = True) -> DataFrame:
    """`keep` of `rows` and, for each (name, column of doubles) asked, its average rank within `by`, over the count if `share`.

    All columns are ranked in one group, which is dealt and sorted once.
    """
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in asked)])

    def group(table: pa.Table) -> pa.Table:
        out = table.select(keep)
        for name, c in asked.items():
            x, missing = _doubles(table.column(c))
            value = np.zeros(len(x))
            value[~missing] = average_ranks(x[~missing]) / (np.count_nonzero(~missing) if share else 1)
            out = out.append_column(name, pa.array(value, pa.float64(), mask=missing))
        return out

    return rows.select(*dict.fromkeys([*by, *keep, *asked.values()])).groupBy(*by).applyInArrow(group, schema)


def _correlation(x: np.ndarray, y: np.ndarray, mean_x: float, mean_y: float) -> float | None:
    a, b = x - mean_x, y - mean_y
    spread = np.sqrt(a @ a) * np.sqrt(b @ b)
    return None if spread == 0 else float(a @ b / spread)


def group_ics(rows: DataFrame, features: list[str], label: str, by: list[str], plain: bool = False) -> DataFrame:
    """(by, feature, n, ic) over complete pairs of each group: rank correlations, NULL without spread; with `plain` also plain_ic.

    A group is dealt and sorted once for all features; what leaves it is a row a feature that has pairs.
    """
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ic", T.DoubleType()), *([T.StructField("plain_ic", T.DoubleType())] if plain else [])])

    def flat(v: np.ndarray) -> bool:
        return bool((v == v[0]).all())

    def group(key: tuple, table: pa.Table) -> pa.Table:
        y, unlabelled = _doubles(table.column("_label"))
        out = []
        for i, f in enumerate(features):
            x, missing = _doubles(table.column(f"_f{i}"))
            kept = ~(missing | unlabelled)
            a, b = x[kept], y[kept]
            n = len(a)
            if n:
                with np.errstate(all="ignore"):
                    ic = _correlation(average_ranks(a), average_ranks(b), (n + 1) / 2, (n + 1) / 2) if n > 1 else None
                    own = None if n < 2 or flat(a) or flat(b) else _correlation(a, b, a.mean(), b.mean())
                out.append((*(k.as_py() for k in key), f, n, ic, *([own] if plain else [])))
        names = schema.fieldNames()
        kinds = [*(k.type for k in key), pa.string(), pa.int64(), pa.float64(), *([pa.float64()] if plain else [])]
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    values = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    return rows.select(*by, F.col(label).cast("double").alias("_label"), *values).groupBy(*by).applyInArrow(group, schema)


def pooled_products(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, aa, bb, ab) for each pair i <= j of columns: sums of products of deviations from the means, over rows that have both.

    Each task adds up its batches; what is shuffled is a row a task and pair.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    names = ("n", "ma", "mb", "aa", "bb", "ab")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(pairs), len(names)))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            each = [_doubles(table.column(k)) for k in range(len(columns))]
            for p, (i, j) in enumerate(pairs):
                kept = ~(each[i][1] | each[j][1])
                n = np.count_nonzero(kept)
                if not n:
                    continue
                x, y = each[i][0][kept], each[j][0][kept]
                with np.errstate(all="ignore"):
                    mx, my = (float(v[0]) if (v == v[0]).all() else float(v.mean()) for v in (x, y))
                    a, b = x - mx, y - my
                    m, ma, mb, aa, bb, ab = held[p] if held[p][0] else (0.0, mx, my, 0.0, 0.0, 0.0)
                    share, da, db = m * n / (m + n), mx - ma, my - mb
                    held[p] = (m + n, ma + da * n / (m + n), mb + db * n / (m + n), aa + a @ a + da * da * share, bb + b @ b + db * db * share, ab + a @ b + da * db * share)
        yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in pairs], pa.int32()), "j": pa.array([j for _, j in pairs], pa.int32()), **{c: pa.array(held[:, k]) for k, c in enumerate(names)}})

    parts = rows.select(*[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns)]).mapInArrow(add, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    pair = W.partitionBy("i", "j")  # a row a task
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), F.sum("n").over(pair))
    flat = lambda c: F.min(c).over(pair) == F.max(c).over(pair)
    off = lambda c: F.when(flat(c), 0.0).otherwise(F.col(c) - mean(c))
    moved = parts.where("n > 0").withColumns({"da": off("ma"), "db": off("mb")})
    total = lambda a, x, y: F.sum(F.col(a) + F.col("n") * F.col(x) * F.col(y)).alias(a)
    return moved.groupBy("i", "j").agg(F.sum("n").alias("n"), total("aa", "da", "da"), total("bb", "db", "db"), total("ab", "da", "db"))
