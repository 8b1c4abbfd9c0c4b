"""Walk-forward campaigns: all folds purged, fitted, scored and measured in one pass, without a job for each fold.

Rows carry their fold and part. Sums of ranks or of products are added up by (fold, feature), solved as arrays, and the
weights are joined back to the test rows. Folds are few, and so are the rows of every table with one row a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grouped import group_ics, ranked
from .evaluate import Fold, assign_folds, correlation_weights, shared_weights
from .fitting import nonnegative
from .names import free_name
from .pooled import rank_ics
from .settle import settled

#: Fold-streak throttle: folds before it acts, negative folds in a row that end all exposure, half-life in folds, and
#: the mean ICs at which exposure is 0 and 1.
WARMUP, KILL, HALF_LIFE, FLOOR_IC, CEILING_IC = 4, 3, 4, -0.02, 0.0
RIDGE = (1e-4, 1e-3, 1e-2, 0.1)


def fold_samples(samples: DataFrame, folds: list[Fold], on: str = "date", at: str = "day", ends: str = "label_end_index") -> DataFrame:
    """`samples` once for each fold and part; training rows whose label ends on or after the test's first day go.

    `at` and `ends` number the days of the whole calendar. Rows without `ends` have no label that could leak, nor one to
    train with, and go from the training part; folds without test rows go.
    """
    calendar, parts = _fold_calendar(samples, folds, on, at), free_name(samples, "of_parts")
    each = samples.join(F.broadcast(calendar.select(F.col("on").alias("_on"), F.col("parts").alias(parts))), F.col(on) == F.col("_on"))
    kept = each.select(*samples.columns, F.explode(parts).alias(parts)).where((F.col(f"{parts}.part") == "test") | (F.col(ends) < F.col(f"{parts}.first")))
    return kept.select(*samples.columns, F.col(f"{parts}.fold").alias("fold"), F.col(f"{parts}.part").alias("part"))


def _fold_calendar(samples: DataFrame, folds: list[Fold], on: str, at: str) -> DataFrame:
    """(on, parts): each date with the folds it trains or tests, and the first day of each one's test. A row a date."""
    days = settled(assign_folds(samples.select(on, at).distinct(), folds, on))
    bounds = days.where("part = 'test'").groupBy(F.col("fold").alias("_fold")).agg(F.min(at).alias("_first"))
    joined = days.join(F.broadcast(bounds), F.col("fold") == F.col("_fold"))
    return settled(joined.groupBy(F.col(on).alias("on")).agg(F.collect_set(F.struct("fold", "part", F.col("_first").alias("first"))).alias("parts")))


def fold_ic_weights(samples: DataFrame, folds: list[Fold], features: list[str], label: str, on: str = "date", at: str = "day", ends: str = "label_end_index") -> DataFrame:
    """`fold_weights` of model `ic` over samples that are not repeated: each row counts in all the folds that it trains."""
    calendar, numbers = _fold_calendar(samples, folds, on, at), F.array(*[F.lit(f.fold) for f in folds])
    of = F.transform(F.filter("_parts", lambda p: (p["part"] == "train") & (F.col(ends) < p["first"])), lambda p: (F.array_position(numbers, p["fold"]) - 1).cast("int"))
    rows = samples.join(F.broadcast(calendar.select(F.col("on").alias("_on"), F.col("parts").alias("_parts"))), F.col(on) == F.col("_on"))
    ics = rank_ics(rows.select(*features, label, of.alias("_of")), features, label, "_of", len(folds))
    ics = ics.select(F.element_at(numbers, F.col("grp") + 1).alias("fold"), "feature", "ic")
    return shared_weights(ics, F.greatest(F.col("ic"), F.lit(0.0)), ("fold",)).select("fold", "feature", "weight")


def _finite(columns: list[str]) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf"))
    return good


def grams(df: DataFrame, by: list[str], features: list[str], label: str) -> DataFrame:
    """(by, n, gram, right, yy, y): sums of products of features (row by row), with the label, and of the label, over rows
    where all are finite."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    x, y = [F.col(f).cast("double") for f in features], F.col(label).cast("double")
    return df.where(_finite([*features, label])).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[total(a * b) for a in x for b in x]).alias("gram"), F.array(*[total(a * y) for a in x]).alias("right"), total(y * y).alias("yy"), total(y).alias("y")
    )


def fit_bloc(sums: DataFrame, by: list[str], features: list[str], l2: float) -> DataFrame:
    """(by, feature, weight, r2, n) of ridge fits without negative weights from `grams`; weights are scaled to sum 1.

    A row of sums is a fit, solved by numpy; r2 is that of the unscaled weights, and comes from the same sums.
    """
    k = len(features)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                gram, right = np.array(row.gram).reshape(k, k), np.array(row.right)
                w = nonnegative(gram, right, l2)
                spread = (row.yy - row.y**2 / row.n) if row.n else 0.0
                r2 = 1 - (row.yy - 2 * w @ right + w @ gram @ w) / (spread or 1.0) if row.n else 0.0
                w = w / w.sum() if w.sum() > 0 else w
                out += [(*(getattr(row, c) for c in by), f, float(v), float(r2), int(row.n)) for f, v in zip(features, w, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "feature", "weight", "r2", "n"])

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "feature string, weight double, r2 double, n long"])
    return sums.select(*by, "n", "gram", "right", "yy", "y").mapInPandas(solve, schema)


def ridge_by_ic(df: DataFrame, features: list[str], label: str, date: str = "date", candidates: tuple[float, ...] = RIDGE, fallback: float = 1e-3) -> DataFrame:
    """(l2, mean_ic, dates, chosen): each strength's mean rank IC on dates that its fit has not seen.

    The fit without a date comes from the total of all sums less that date's own, for all strengths at once, so the
    rows are read twice however many dates there are. Dates of one row, and fits without weights, do not count; of
    strengths whose ICs agree to twelve places the smallest wins. If none counts, the only row is the fallback.
    """
    k = len(features)
    day, l2, w = (free_name(df, x) for x in ("of_day", "l2", "w"))
    daily = settled(grams(df, [date], features, label))
    sums = [F.coalesce(F.sum(F.element_at("gram", i + 1)), F.lit(0.0)) for i in range(k * k)] + [F.coalesce(F.sum(F.element_at("right", i + 1)), F.lit(0.0)) for i in range(k)]
    n, whole = daily.agg(F.coalesce(F.sum("n"), F.lit(0)), F.array(*sums)).first()
    gram, right = np.array(whole[: k * k]).reshape(k, k), np.array(whole[k * k :])

    def without(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for strength in candidates:
                    got = nonnegative(gram - np.array(row.gram).reshape(k, k), right - np.array(row.right), strength)
                    if got.sum() > 0:
                        out.append((row[0], strength, (got / got.sum()).tolist()))
            yield pd.DataFrame(out, columns=[day, l2, w])

    fits = daily.where((F.col("n") >= 2) & (F.col("n") < n)).select(F.col(date).alias(day), "gram", "right").mapInPandas(without, f"{day} {dict(df.dtypes)[date]}, {l2} double, {w} array<double>")
    fits = fits.groupBy(day).agg(F.map_from_entries(F.collect_list(F.struct(l2, w))).alias(w))  # a row a date
    names = [f"_s{k}" for k in range(len(candidates))]

    def score(strength: float) -> Column:
        own, total = F.try_element_at(w, F.lit(strength)), F.lit(0.0)
        for i, f in enumerate(features):
            total = total + F.col(f).cast("double") * F.element_at(own, i + 1)
        return total

    scored = df.where(_finite([*features, label])).join(F.broadcast(fits), F.col(date) == F.col(day)).select(F.col(day).alias("day"), *[score(s).alias(c) for c, s in zip(names, candidates, strict=True)], F.col(label).alias("y"))
    strengths = F.create_map(*[F.lit(v) for pair in zip(names, candidates, strict=True) for v in pair])
    ics = group_ics(scored, names, "y", ["day"]).select(F.element_at(strengths, F.col("feature")).alias("l2"), "day", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    means = ics.groupBy("l2").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("dates"))
    spark = df.sparkSession
    best = F.row_number().over(W.orderBy(F.round("mean_ic", 12).desc_nulls_last(), "l2"))  # a row a candidate
    none = spark.createDataFrame([(fallback,)], "l2 double").select("l2", F.lit(None).cast("double").alias("mean_ic"), F.lit(0).cast("long").alias("dates"))
    return means.unionByName(none.join(means.limit(1).select(F.lit(1)), how="left_anti")).withColumn("chosen", best == 1)


def calibrate(df: DataFrame, blocs: dict[str, tuple[list[str], float]], label: str, date: str = "date", l2: float | None = None) -> DataFrame:
    """(bloc, feature, weight, r2, n, l2): blocs of features fitted one by one, each weighing its share, scaled to sum 1.

    `blocs` names each bloc's features and share; shares must sum to 1. Without `l2` the strength is chosen by IC over
    the features of all blocs.
    """
    if abs(sum(share for _, share in blocs.values()) - 1) > 1e-6:
        raise ValueError("the shares of the blocs must sum to 1")
    every = [f for features, _ in blocs.values() for f in features]
    strength = ridge_by_ic(df, every, label, date).where("chosen").first()["l2"] if l2 is None else l2
    parts = [fit_bloc(grams(df, [], features, label), [], features, strength).select(F.lit(name).alias("bloc"), "feature", (F.col("weight") * share).alias("weight"), "r2", "n") for name, (features, share) in blocs.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    total = F.sum("weight").over(W.partitionBy(F.lit(1)))  # a row a feature
    return out.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight"))).withColumn("l2", F.lit(float(strength)))


def robust_weights(
    df: DataFrame, features: list[str], label: str, by: tuple[str, ...] = (), date: str = "date",
    downside: float = 2.0, worst: float = 0.33, min_dates: int = 8, min_names: int = 30,
) -> DataFrame:
    """(by, feature, dates, robust_ic, weight): mean daily rank IC plus `downside` times the mean of its worst share of days.

    Dates of fewer than `min_names` rows do not count; a feature of fewer than `min_dates` dates, or below 0, weighs
    nothing; all zero gives equal weights. A missing value counts as 0, a flat date as an IC of 0.
    """
    keys = [*by, "feature"]
    rows = df.select(*by, F.col(date).alias("at"), F.col(label).alias("_l"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    daily = group_ics(rows, features, "_l", [*by, "at"]).select(*keys, "at", "n", F.coalesce("ic", F.lit(0.0)).alias("ic")).where(F.col("n") >= min_names)
    line = W.partitionBy(*keys)  # a row a date
    placed = daily.withColumns({"nth": F.row_number().over(line.orderBy("ic", "at")), "many": F.count(F.lit(1)).over(line)})
    k = F.greatest(F.lit(1), F.floor(F.col("many") * worst))
    got = placed.groupBy(*keys).agg(F.max("many").alias("dates"), F.avg("ic").alias("mean_ic"), F.avg(F.when(F.col("nth") <= k, F.col("ic"))).alias("low"))
    grid = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    names = grid.select(*by, F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    rows = names.join(got, keys, "left").select(*keys, F.coalesce("dates", F.lit(0)).cast("long").alias("dates"), (F.col("mean_ic") + downside * F.col("low")).alias("robust_ic"))
    raw = F.when(F.col("dates") >= min_dates, F.greatest(F.lit(0.0), F.col("robust_ic"))).otherwise(0.0)
    return shared_weights(rows, raw, by)


def fold_weights(rows: DataFrame, features: list[str], label: str, model: str = "ic", l2: float = 1e-3, **settings) -> DataFrame:
    """(fold, feature, weight) of all folds' training parts: by pooled rank IC, `robust`, `ridge`, or `equal`."""
    train = rows.where(F.col("part") == "train")
    if model == "ic":
        return correlation_weights(train, features, label, by=("fold",)).select("fold", "feature", "weight")
    if model == "robust":
        return robust_weights(train, features, label, by=("fold",), **settings).select("fold", "feature", "weight")
    if model == "ridge":
        return fit_bloc(grams(train, ["fold"], features, label), ["fold"], features, l2).select("fold", "feature", "weight")
    if model == "equal":
        return train.select("fold").distinct().select("fold", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"), F.lit(1 / len(features)).alias("weight"))
    raise ValueError(f"no model {model!r}: ic, robust, ridge or equal")


def fold_scores(rows: DataFrame, weights: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """The test rows of folds that have weights, with score: each feature's percentage rank of its date (missing: 0.5), weighed."""
    fold, of = free_name(rows, "of_fold"), free_name(rows, "weights")
    maps = weights.groupBy(F.col("fold").alias(fold)).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias(of))  # a row a fold
    places = {f"_p{i}": f"_f{i}" for i in range(len(features))}
    test = rows.where(F.col("part") == "test").withColumns({c: F.col(f).cast("double") for c, f in zip(places.values(), features, strict=True)})
    test = ranked(test, places, rows.columns, ["fold", date]).join(F.broadcast(maps), F.col("fold") == F.col(fold))
    score = F.lit(0.0)
    for place, f in zip(places, features, strict=True):
        score = score + F.coalesce(place, F.lit(0.5)) * F.coalesce(F.try_element_at(of, F.lit(f)), F.lit(0.0))
    return test.withColumn("score", score).drop(fold, of, *places)


def fold_days(scored: DataFrame, label: str, realized: str, bps: float = 10.0, date: str = "date") -> DataFrame:
    """(fold, date, ic, gross, turnover, net): a book bought on each fold's first day and held, marked by one-day returns.

    Weights are scores over the sum of their sizes. Only the first day trades, against the book of the fold before; a
    held name without a row that day earns nothing. The IC is the rank correlation of score and label, 0 on a flat day.
    """
    rows = scored.select("fold", F.col(date).alias("date"), "instrument", "score", F.col(label).alias("l"), F.col(realized).alias("r"))
    ics = group_ics(rows, ["score"], "l", ["fold", "date"]).select("fold", "date", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    starts = rows.groupBy(F.col("fold").alias("f")).agg(F.min("date").alias("start"))  # a row a fold
    first = rows.join(F.broadcast(starts), (F.col("fold") == F.col("f")) & (F.col("date") == F.col("start")))
    size = F.sum(F.abs("score")).over(W.partitionBy("fold"))
    book = settled(first.select("fold", "instrument", F.when(size > 0, F.col("score") / size).otherwise(0.0).alias("w")))
    order = starts.select("f", F.row_number().over(W.orderBy("f")).alias("seq"))
    placed = book.join(F.broadcast(order), F.col("fold") == F.col("f")).select("seq", "instrument", "w")
    moves = placed.select(F.explode(F.array(F.struct("seq", "w"), F.struct((F.col("seq") + 1).alias("seq"), (-F.col("w")).alias("w")))).alias("e"), "instrument").select("e.*", "instrument")
    traded = moves.groupBy("seq", "instrument").agg(F.sum("w").alias("w")).groupBy("seq").agg(F.sum(F.abs("w")).alias("traded"))
    trades = order.join(traded, "seq").join(starts.withColumnRenamed("f", "g"), F.col("f") == F.col("g")).select(F.col("f").alias("fold"), F.col("start").alias("date"), "traded")
    held = rows.join(book.select(F.col("fold").alias("f"), F.col("instrument").alias("i"), "w"), (F.col("fold") == F.col("f")) & (F.col("instrument") == F.col("i")), "left")
    gains = held.groupBy("fold", "date").agg(F.sum(F.coalesce(F.col("w") * F.col("r"), F.lit(0.0))).alias("gross"))
    out = gains.join(ics, ["fold", "date"], "left").join(F.broadcast(trades), ["fold", "date"], "left")
    turnover = F.coalesce("traded", F.lit(0.0))
    return out.select("fold", "date", F.coalesce("ic", F.lit(0.0)).alias("ic"), "gross", turnover.alias("turnover"), (F.col("gross") - turnover * (bps / 1e4)).alias("net"))


def streak_scales(folds: DataFrame, ic: str = "mean_ic", warmup: int = WARMUP, kill: int = KILL, half_life: int = HALF_LIFE, floor: float = FLOOR_IC, ceiling: float = CEILING_IC) -> DataFrame:
    """`folds` (a row a fold) with ewma_ic, negative_run, streak_scale and streak_reason from the ICs of the folds before.

    1 until `warmup` folds have ended, 0 after `kill` negative ones in a row, else linear in the mean of earlier ICs,
    whose weights halve every `half_life` folds. A missing IC ends a run and has no weight.
    """
    keep = 0.5 ** (1 / half_life)
    before = F.collect_list(F.coalesce(F.col(ic), F.lit(float("nan")))).over(W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1))
    known = lambda x: ~F.isnan(x)
    run = F.aggregate("_before", F.lit(0), lambda n, x: F.when(known(x) & (x < 0), n + 1).otherwise(0))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("under"))
    mean = F.aggregate(
        "_before", start,
        lambda acc, x: F.struct((acc["top"] * keep + F.when(known(x), x).otherwise(0.0)).alias("top"), (acc["under"] * keep + F.when(known(x), 1.0).otherwise(0.0)).alias("under")),
        lambda acc: F.when(acc["under"] > 0, acc["top"] / acc["under"]).otherwise(0.0),
    )
    n, line = F.size("_before"), (F.col("ewma_ic") - floor) / (ceiling - floor)
    names = [c for c in folds.columns if c not in ("ewma_ic", "negative_run", "streak_scale", "streak_reason")]
    got = folds.select(*names, before.alias("_before")).withColumns({"ewma_ic": mean, "negative_run": run})
    reason = F.when(n < warmup, "warmup").when(F.col("negative_run") >= kill, "killed").when(F.col("ewma_ic") <= floor, "floor").when(F.col("ewma_ic") >= ceiling, "ceiling").otherwise("throttled")
    scale = F.when(reason.isin("warmup", "ceiling"), 1.0).when(reason.isin("killed", "floor"), 0.0).otherwise(line)
    return got.withColumns({"streak_scale": scale, "streak_reason": reason}).drop("_before")


def volatility_scales(returns: DataFrame, target: float = 0.10, least: float = 0.05, lookback: int = 63, value: str = "net") -> DataFrame:
    """(fold, volatility, vol_scale): exposure that brings the yearly volatility of each fold's last training returns to
    `target`, at most 1. returns(fold, date, value) has one row a day; under two returns the volatility is 0."""
    nth = F.row_number().over(W.partitionBy("fold").orderBy(F.col("date").desc()))
    late = returns.where(F.col(value).isNotNull()).withColumn("_nth", nth).where(F.col("_nth") <= lookback)
    vol = F.coalesce(F.stddev_samp(value), F.lit(0.0)) * 252**0.5
    return late.groupBy("fold").agg(vol.alias("volatility")).withColumn("vol_scale", F.least(F.lit(1.0), target / F.greatest(F.col("volatility"), F.lit(least))))


def fold_report(rows: DataFrame, days: DataFrame, **streak) -> DataFrame:
    """A row a fold that ran: rows of both parts, mean IC, Sharpe ratio, return, drawdown, mean turnover, and the scale
    that `streak_scales` (with settings `streak`) gives."""
    line = W.partitionBy("fold").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    curve = days.withColumn("equity", F.product(1 + F.col("net")).over(line))
    curve = curve.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(line)))
    sharpe = F.coalesce(F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    got = curve.groupBy("fold").agg(
        F.count(F.lit(1)).alias("days"), F.avg("ic").alias("mean_ic"), sharpe.alias("sharpe"), (F.product(1 + F.col("net")) - 1).alias("total_return"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"), F.avg("turnover").alias("turnover"),
    )
    sizes = rows.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"))
    return streak_scales(got.join(sizes, "fold"), **streak)


def walk_forward(samples: DataFrame, folds: list[Fold], features: list[str], label: str = "forward_return", realized: str = "realized_return_1d", model: str = "ic", bps: float = 10.0, streak: dict | None = None, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights by fold, days, report) of a campaign over samples(instrument, date, day, label_end_index, …)."""
    needed = dict.fromkeys(["instrument", "date", "day", "label_end_index", *features, label, realized])
    samples = settled(samples.select(*needed))
    rows = fold_samples(samples, folds)
    weights = settled(fold_ic_weights(samples, folds, features, label) if model == "ic" else fold_weights(rows, features, label, model, **settings))
    tested = rows.select("fold", "part", "date", "instrument", *dict.fromkeys([*features, label, realized]))
    scored = settled(fold_scores(tested, weights, features).select("fold", "date", "instrument", "score", *dict.fromkeys([label, realized])))
    days = settled(fold_days(scored, label, realized, bps))
    return weights, days, fold_report(rows, days, **(streak or {}))
