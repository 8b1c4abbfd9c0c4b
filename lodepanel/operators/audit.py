"""Statistics with confidence, and the gates a feature passes before it is used.

Rows are (instrument, date, …) with features and a label as columns. Series of one row a date are small by nature and
may be ordered in one task; nothing else here is. Random draws are hashes of a row's key and a seed, so that reruns and
other engines draw alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import average_rank
from ..functions.grouped import pooled_products
from .evaluate import daily_ic, safe_corr
from .settle import settled

#: Cumulative probabilities of a Poisson variable of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def draw(*key: Column) -> Column:
    """A uniform number from 0 to 1 by a hash of `key`."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def cumulative(counts: DataFrame, by: list[str], value: str, n: str = "n", out: str = "upto") -> DataFrame:
    """`counts(by, value, n)` with the running total of n within `by`, in order of `value`.

    Values are dealt into ranges; only the rows of one range meet in a task, and ranges are joined by their sums.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(counts.repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = F.sum(n).over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    on = F.col("_range") == F.col("_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = dealt.withColumn(out, within).join(F.broadcast(sums), on)
    return rows.withColumn(out, F.col(out) + F.col("_before")).select(*counts.columns, out)


def order_statistics(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The values at positions floor(share * (n - 1)), from 0, of all rows in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = settled(cumulative(counts.withColumn("_all", F.lit(0)), ["_all"], value))
    n = upto.agg(F.max("upto")).first()[0] or 0
    at = [int(share * (n - 1)) for share in shares]
    got = upto.select(*[F.min(F.when(F.col("upto") > k, F.col(value))).alias(f"v{i}") for i, k in enumerate(at)]).first()
    return list(got)


def ic_series(df: DataFrame, score: str, label: str) -> DataFrame:
    """(date, n, ic): daily rank IC of dates with two pairs or more; a flat date counts as 0."""
    return daily_ic(df, score, label).where("n >= 2").select("date", "n", F.coalesce("ic", F.lit(0.0)).alias("ic"))


def longest_below_zero(value: str, order: str) -> Column:
    """An aggregate: the longest run of values below zero, by `order`."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x["v"] < 0, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), start, step)["best"]


def ic_summary(ics: DataFrame) -> DataFrame:
    """One row: ic_mean, ic_std, icir (999 or 0 without spread), negative_streak, observations."""
    got = ics.agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), longest_below_zero("ic", "date").cast("long").alias("negative_streak"), F.count("ic").alias("observations"))
    flat = F.when(F.col("ic_mean") > 0, 999.0).otherwise(0.0)
    return got.withColumn("icir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(flat))


def monthly_ic(ics: DataFrame) -> DataFrame:
    return ics.groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("days"))


def bootstrap_mean(series: DataFrame, value: str, key: str, samples: int = 500, seed: int = 0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: mean, ci_low, ci_high of the mean by a Poisson bootstrap: each row weighs as often as its draw says."""
    rows = series.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = draw(F.lit(seed), F.col("b"), F.col("key"))
    weight = sum((F.when(u > F.lit(p), 1).otherwise(0) for p in POISSON), F.lit(0))
    means = drawn.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"), F.avg("v").alias("mean"))
    return means.agg(F.max("mean").alias("mean"), F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(high)).alias("ci_high"))


def lag1_autocorr(series: DataFrame, value: str, order: str = "date") -> DataFrame:
    """One row: the correlation of a series with itself a step before; 0 under three values."""
    before = F.lag(value).over(W.orderBy(order))
    pairs = series.select(F.col(value).alias("v"), before.alias("b"))
    corr = F.coalesce(safe_corr(F.col("v"), F.col("b")), F.lit(0.0))
    return pairs.agg(F.when(F.count("v") < 3, 0.0).otherwise(corr).alias("lag1_autocorr"))


def winsor_impact(df: DataFrame, value: str) -> DataFrame:
    """One row: mean change by clipping at the 5 % and 95 % order statistics, in units of the mean size; 0 under 20 values."""
    low, high = order_statistics(df, value, [0.05, 0.95])
    v = F.col(value)
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), v))
    size = F.coalesce(F.nullif(F.avg(F.abs(v)), F.lit(0.0)), F.lit(1.0))
    return df.agg(F.when(F.count(v) < 20, 0.0).otherwise(F.avg(F.abs(v - clipped)) / size).alias("winsor_impact"))


def permuted_ics(df: DataFrame, score: str, label: str, seeds: int = 1) -> DataFrame:
    """(seed, ic): mean daily rank IC with labels dealt anew within dates of three rows or more, for seeds 0 to `seeds` - 1.

    Labels are dealt by the order of hashes of seed, date and name. A group holds a date's rows, once for all seeds, so that
    the panel is shuffled once; a date holds as many names as the universe of a day.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("instrument", "date", F.col(score).alias("f"), F.col(label).alias("l")).repartition(parts, "date")
    mark = F.concat_ws(":", F.col("date").cast("string"), F.col("instrument").cast("string"))
    ranked = both.select("date", "instrument", mark.alias("mark"), average_rank(F.col("f"), "date").alias("f"), average_rank(F.col("l"), "date").alias("l"))

    def deal(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if n < 3:
            return pa.table({"seed": pa.array([], pa.int32()), "ic": pa.array([], pa.float64())})
        table = table.sort_by("instrument")
        names = [x.encode() for x in table.column("mark").to_pylist()]
        f, l = (table.column(c).to_numpy() - (n + 1) / 2 for c in ("f", "l"))
        under, ics = (f @ f) * (l @ l), []
        for seed in range(seeds):
            start = hashlib.md5(f"{seed}:".encode(), usedforsecurity=False)
            marks = []
            for name in names:
                h = start.copy()
                h.update(name)
                marks.append(h.digest())
            high, low = np.frombuffer(b"".join(marks), dtype=">u8").reshape(n, 2).astype(np.uint64).T
            ics.append(float(f @ l[np.lexsort((low, high))] / under**0.5) if under > 1e-9 else 0.0)
        return pa.table({"seed": pa.array(range(seeds), pa.int32()), "ic": pa.array(ics, pa.float64())})

    return ranked.groupBy("date").applyInArrow(deal, "seed int, ic double").groupBy("seed").agg(F.avg("ic").alias("ic"))


def null_baseline(df: DataFrame, score: str, label: str, seeds: int = 100) -> DataFrame:
    """One row: the actual mean IC, the mean and 5 % and 95 % points of permuted ones, and the one-sided p-value."""
    actual = ic_series(df, score, label).agg(F.avg("ic").alias("actual"))
    null = permuted_ics(df, score, label, seeds)
    both = null.select("ic", F.lit(None).cast("double").alias("actual")).unionByName(actual.select(F.lit(None).cast("double").alias("ic"), "actual"))
    known = both.withColumn("actual", F.max("actual").over(W.partitionBy(F.lit(1))))  # one row a permutation
    return known.agg(
        F.max("actual").alias("actual_ic"), F.avg("ic").alias("null_mean"), F.percentile("ic", F.lit(0.05)).alias("null_p05"), F.percentile("ic", F.lit(0.95)).alias("null_p95"),
        ((F.count_if(F.col("ic") >= F.col("actual")) + 1) / (F.count("ic") + 1)).alias("p_value"),
    )


def lagged_ic(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: mean daily IC of each instrument's last value seen before with today's label."""
    before = F.last(score, ignorenulls=True).over(W.partitionBy("instrument").orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    rows = df.select("instrument", "date", label, before.alias("_before"))
    return ic_series(rows, "_before", label).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("lagged_ic"))


def weighted_returns(df: DataFrame, score: str, label: str, bps: float) -> DataFrame:
    """(date, gross, turnover, net): scores over the date's sum of sizes as weights, less cost of turnover.

    A name's change is against the date before of the whole calendar, and one that is gone is sold; both are read off
    the name's own rows by their day numbers, so that the panel is shuffled once by instrument.
    """
    rows = df.where(F.col(score).isNotNull())
    size = F.sum(F.abs(score)).over(W.partitionBy("date"))
    rows = rows.select("instrument", "date", F.col(label).alias("y"), F.when(size > 0, F.col(score) / size).otherwise(0.0).alias("w"))
    days = df.select(F.col("date").alias("day_date")).distinct()
    days = days.withColumns({"day": F.row_number().over(W.orderBy("day_date")), "next_date": F.lead("day_date").over(W.orderBy("day_date"))})
    rows = rows.join(F.broadcast(days), F.col("date") == F.col("day_date"))
    own = W.partitionBy("instrument").orderBy("day")
    held = F.when(F.lag("day").over(own) == F.col("day") - 1, F.lag("w").over(own)).otherwise(0.0)
    stays = F.coalesce(F.lead("day").over(own) == F.col("day") + 1, F.lit(False))
    rows = rows.select("date", "next_date", "w", "y", F.abs(F.col("w") - held).alias("moved"), F.when(~stays, F.abs("w")).alias("sold"))
    none = F.lit(None).cast("double")
    each = rows.select(F.explode(F.array(
        F.struct("date", (F.col("w") * F.coalesce("y", F.lit(0.0))).alias("pnl"), F.col("moved").alias("moved")),
        F.struct(F.col("next_date").alias("date"), none.alias("pnl"), F.col("sold").alias("moved")),
    )).alias("e")).select("e.*").where("date IS NOT NULL")
    out = each.groupBy("date").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("moved"), F.lit(0.0)).alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * (bps / 1e4))


def noise_gate(df: DataFrame, feature: str, min_coverage: float = 0.8, min_dispersion: float = 1e-4, min_unique: float = 0.05, max_zero: float = 0.8) -> DataFrame:
    """One row of measures of a feature's values, and whether all are within bounds.

    A feature within [-1, 1] that is spread out on each date counts as rank-normalised and is held to its daily ratio.
    """
    v = F.col(feature)
    daily = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.count_distinct(F.round(v, 12)).alias("different"), F.avg(v).alias("mean"),
        F.count_if(F.abs(v) < 1e-12).alias("zeros"), F.min(v).alias("low"), F.max(v).alias("high"),
    )
    daily = settled(daily)
    pooled = df.agg(F.try_divide(F.count_distinct(F.round(v, 12)), F.count(v)).alias("unique_ratio"))
    got = daily.agg(
        F.try_divide(F.sum("n"), F.sum("rows")).alias("coverage"), F.avg(F.when(F.col("n") >= 2, F.col("sd"))).alias("dispersion"), F.avg(F.when(F.col("n") >= 2, F.col("different") / F.col("n"))).alias("daily_unique_ratio"),
        F.try_divide(F.sum("zeros"), F.sum("n")).alias("zero_fraction"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    # Each of these is one row.
    for one in (pooled, winsor_impact(df, feature), lag1_autocorr(daily.where("n > 0"), "mean")):
        got = got.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
    normal = (F.col("low") >= -1.000001) & (F.col("high") <= 1.000001) & (F.col("high") - F.col("low") >= min_dispersion) & (F.col("daily_unique_ratio") >= min_unique)
    got = got.withColumn("rank_normalized", F.coalesce(normal, F.lit(False)))
    unique = F.when(F.col("rank_normalized"), F.col("daily_unique_ratio")).otherwise(F.col("unique_ratio"))
    passed = (F.col("coverage") >= min_coverage) & (F.col("dispersion") >= min_dispersion) & (unique >= min_unique) & (F.col("zero_fraction") <= max_zero)
    return got.drop("low", "high").withColumn("passed", F.coalesce(passed, F.lit(False)))


def leakage_gate(df: DataFrame, feature: str, label: str, max_ic: float = 0.3, min_ic: float = 0.01, min_lagged: float = 0.2, min_days: int = 20) -> DataFrame:
    """One row: whether a feature's IC is too good, gone a day later, or no better than chance."""
    rows = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    got = ic_series(rows, feature, label).agg(F.abs(F.avg("ic")).alias("abs_ic")).withColumn("_one", F.lit(1))
    groups = rows.agg(F.count_distinct("date").alias("daily_groups"))
    shuffled = permuted_ics(rows, feature, label).agg(F.max("ic").alias("permuted_ic"))
    for one in (lagged_ic(rows, feature, label), shuffled, groups):
        got = got.join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    matters = F.col("abs_ic") >= min_ic
    passed = (F.col("daily_groups") >= min_days) & (F.col("abs_ic") <= max_ic)
    passed = passed & ~(matters & (F.abs("lagged_ic") < F.col("abs_ic") * min_lagged)) & ~(matters & (F.abs("permuted_ic") >= F.col("abs_ic")))
    return got.drop("_one").withColumn("passed", F.coalesce(passed, F.lit(False)))


def stability_gate(ics: DataFrame, min_ic: float = 0.01, min_icir: float = 0.05, max_streak: int = 60, samples: int = 200) -> DataFrame:
    """One row: the IC's summary with its bootstrap interval."""
    ics = settled(ics)
    both = ic_summary(ics).withColumn("_one", F.lit(1)).join(F.broadcast(bootstrap_mean(ics, "ic", "date", samples).withColumn("_one", F.lit(1))), "_one").drop("_one", "mean")
    return both.withColumn("passed", (F.col("ic_mean") >= min_ic) & (F.col("icir") >= min_icir) & (F.col("negative_streak") <= max_streak))


def cost_gate(df: DataFrame, feature: str, label: str, bps: float = 10.0, max_turnover: float = 0.6, min_net: float = 0.0) -> DataFrame:
    """One row: what turnover costs, and whether something is left."""
    days = weighted_returns(df, feature, label, bps)
    got = days.agg(F.avg("turnover").alias("turnover"), F.avg("gross").alias("gross"), F.avg("net").alias("net"))
    return got.withColumn("drag", F.col("gross") - F.col("net")).withColumn("passed", (F.col("turnover") <= max_turnover) & (F.col("net") > min_net))


def incremental_gate(df: DataFrame, feature: str, label: str, baselines: list[str], min_delta: float = 0.001, max_corr: float = 0.7) -> DataFrame:
    """One row: the IC that a feature adds to the mean of its baselines, and its largest correlation with one of them."""
    known = [F.when(F.col(b).isNotNull(), 1).otherwise(0) for b in baselines]
    total = sum((F.coalesce(b, F.lit(0.0)) for b in baselines), F.lit(0.0))
    base = F.try_divide(total, sum(known, F.lit(0)))
    rows = df.where(F.col(label).isNotNull()).withColumns({"_base": base, "_both": F.col(feature) + F.coalesce(base, F.lit(0.0))})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("s")) for k, c in (("candidate", feature), ("baseline", "_base"), ("combined", "_both"))])
    each = rows.select("date", F.col(label).alias("l"), F.explode(kinds).alias("e")).select("date", "l", "e.*").where("s IS NOT NULL")
    ranked = each.select("date", "kind", average_rank(F.col("s"), "date", "kind").alias("f"), average_rank(F.col("l"), "date", "kind").alias("l"))
    daily = ranked.groupBy("date", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(safe_corr(F.col("f"), F.col("l")), F.lit(0.0)).alias("ic")).where("n >= 2")
    of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("ic"))).alias(f"{kind}_ic")
    got = daily.agg(of("candidate"), of("baseline"), of("combined")).withColumn("_one", F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    corr = df.agg(F.greatest(F.lit(0.0), *[F.abs(F.coalesce(safe_corr(zero(feature), zero(b)), F.lit(0.0))) for b in baselines]).alias("max_corr"))
    got = got.join(F.broadcast(corr.withColumn("_one", F.lit(1))), "_one").drop("_one").withColumn("delta_ic", F.col("combined_ic") - F.col("baseline_ic"))
    return got.withColumn("passed", (F.col("delta_ic") >= min_delta) & (F.col("max_corr") <= max_corr))


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of features over rows that have both: sums of all pairs in one pass of whole batches."""
    sums = pooled_products(df, features)
    names = F.array(*[F.lit(f) for f in features])
    pairs = sums.select(F.get(names, "i").alias("x"), F.get(names, "j").alias("y"), F.when(F.col("n") > 1, F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb"))).alias("corr"))
    grid = df.sparkSession.createDataFrame([(a, b) for i, a in enumerate(features) for b in features[i:]], "x string, y string")
    each = F.array_distinct(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    return grid.join(pairs, ["x", "y"], "left").select(F.explode(each).alias("e"), F.coalesce("corr", F.lit(0.0)).alias("corr")).select("e.*", "corr")


def correlation_clusters(matrix: DataFrame, threshold: float) -> DataFrame:
    """(feature, cluster, size): features joined by absolute correlations of at least `threshold`, under their first name.

    Labels spread by joins of the small matrix until none changes; features on their own are left out.
    """
    links = settled(matrix.where((F.abs("corr") >= threshold) & (F.col("a") != F.col("b"))).select("a", "b"))
    labels = settled(links.select(F.col("a").alias("feature")).distinct().withColumn("cluster", F.col("feature")))
    while True:
        near = links.join(labels, F.col("b") == F.col("feature")).groupBy("a").agg(F.min("cluster").alias("least"))
        new = settled(labels.join(near, F.col("feature") == F.col("a")).select("feature", F.least("cluster", "least").alias("cluster"), (F.col("least") < F.col("cluster")).alias("moved")))
        labels = new.select("feature", "cluster")
        if new.where("moved").isEmpty():
            return labels.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("cluster")))


def feature_stability(fold_weights: DataFrame) -> DataFrame:
    """(feature, moved): mean absolute change of a feature's weight from fold to fold; rows are (fold, feature, weight)."""
    moved = F.abs(F.col("weight") - F.lag("weight").over(W.partitionBy("feature").orderBy("fold")))
    return fold_weights.withColumn("moved", moved).groupBy("feature").agg(F.coalesce(F.avg("moved"), F.lit(0.0)).alias("moved"))


def bucket_sharpe(buckets: DataFrame, horizon_days: int, value: str = "r") -> DataFrame:
    """One row: the Sharpe ratio of returns that each cover `horizon_days`, a year; 0 without spread."""
    return buckets.agg(F.coalesce(F.try_divide(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(252.0 / horizon_days)), F.lit(0.0)).alias("sharpe"))


def off_calendar_dates(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The dates of `rows` that `calendar(date)` does not have."""
    return rows.select("date").distinct().join(calendar.select("date"), "date", "left_anti")


def availability_violations(samples: DataFrame) -> DataFrame:
    """One row: how many of samples(as_of, metadata map) name a time of availability after `as_of`, or none that can be read."""
    bad = lambda key: F.when(
        F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")) != "",
        F.coalesce(F.try_to_timestamp(F.try_element_at("metadata", F.lit(key))).cast("timestamp_ntz") > F.col("as_of"), F.lit(True)),
    ).otherwise(False)
    return samples.agg((F.count_if(bad("available_at")) + F.count_if(bad("source_available_at"))).alias("violations"))


def economic_gate(features: DataFrame, least_thesis: int = 30) -> DataFrame:
    """features(name, thesis, expected_sign, required_lags array, failure_modes array, state, ic_mean) with blockers and passed.

    A thesis must say something, lags must be named, a feature in use must name its failure modes, and the IC must not
    go against the expected sign (any but `non_monotonic`).
    """
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    against = (F.col("expected_sign") != "non_monotonic") & (F.coalesce("ic_mean", F.lit(0.0)) < 0)
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim("thesis")), F.lit(0)) < least_thesis, F.lit("thesis")), F.when(empty("required_lags"), F.lit("required_lags")),
        F.when(empty("failure_modes") & F.lower("state").isin("paper", "live"), F.lit("failure_modes")), F.when(F.coalesce(against, F.lit(True)), F.lit("sign")),
    ))
    return features.withColumn("blockers", found).withColumn("passed", F.size("blockers") == 0)
