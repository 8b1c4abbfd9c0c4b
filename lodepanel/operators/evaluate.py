"""Labels, splits, information coefficients, return metrics and attribution."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grouped import group_ics
from ..functions.grouped import ranked as grouped_ranks


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over complete pairs, as an aggregate; NULL without spread."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def forward_labels(bars: DataFrame, horizon: int = 21) -> DataFrame:
    """`bars` with the simple and log return to the bar `horizon` rows later, and the next bar's return where that is
    the next date of the whole calendar."""
    w = W.partitionBy("instrument").orderBy("date")
    days = bars.select("date").distinct().withColumn("day", F.row_number().over(W.orderBy("date"))).withColumnRenamed("date", "calendar_date")
    out = bars.join(F.broadcast(days), F.col("date") == F.col("calendar_date")).drop("calendar_date")
    later = F.lead("close", horizon).over(w)
    next_day = F.lead("day").over(w) == F.col("day") + 1
    return out.withColumns(
        {
            "forward_return": F.try_divide(later, F.col("close")) - 1,
            "forward_log_return": F.ln(F.try_divide(later, F.col("close"))),
            "realized_return_1d": F.when(next_day, F.try_divide(F.lead("close").over(w), F.col("close")) - 1),
            "label_end_index": F.lead("day", horizon).over(w),
        }
    )


def daily_ic(df: DataFrame, feature: str, label: str, rank: bool = True, by: str = "date") -> DataFrame:
    """(by, n, ic): correlation of feature and label over complete pairs of each date; of average ranks if `rank`."""
    if rank:
        return group_ics(df, [feature], label, [by]).select(by, "n", "ic")
    pairs = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(by, F.col(feature).alias("f"), F.col(label).alias("l"))
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("f"), F.col("l")).alias("ic"))


def rank_turnover(df: DataFrame, feature: str) -> DataFrame:
    """Mean absolute change of instruments' percentage ranks, per date."""
    rows = df.where(F.col(feature).isNotNull()).select("instrument", "date", F.col(feature).cast("double").alias("x"))
    ranked = grouped_ranks(rows, {"r": "x"}, ["instrument", "date"], ["date"])
    moved = F.abs(F.col("r") - F.lag("r").over(W.partitionBy("instrument").orderBy("date")))
    return ranked.withColumn("moved", moved).groupBy("date").agg(F.avg("moved").alias("turnover"))


def decile_spread(df: DataFrame, score: str, label: str, by: str = "date") -> DataFrame:
    """Mean label of the top tenth less that of the bottom tenth, per `by`."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    order = lambda *o: F.row_number().over(W.partitionBy(by).orderBy(*o, F.col("instrument")))
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    k = F.greatest(F.floor(n / 10), F.lit(1))
    marked = rows.select(by, F.col(label).alias("l"), order(F.col(score).desc()).alias("top"), order(F.col(score)).alias("bottom"), k.alias("k"))
    return marked.groupBy(by).agg((F.avg(F.when(F.col("top") <= F.col("k"), F.col("l"))) - F.avg(F.when(F.col("bottom") <= F.col("k"), F.col("l")))).alias("spread"))


def longest_negative_run(series: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """The longest run of values below zero, with its bounds, per group; a missing value ends a run.

    For series of one row a date; without `by` the whole (small) series is one group.
    """
    bad = F.coalesce(F.col(value) < 0, F.lit(False))
    w, within = W.partitionBy(*by).orderBy(order), W.partitionBy(*by, "bad").orderBy(order)
    islands = series.withColumn("bad", bad).withColumn("island", F.row_number().over(w) - F.row_number().over(within)).where("bad")
    runs = islands.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))
    return runs.groupBy(*by).agg(F.max(F.struct("length", (-F.unix_date("first")).alias("early"), "first", "last")).alias("b")).select(*by, "b.length", "b.first", "b.last")


def return_metrics(returns: DataFrame, value: str = "r", order: str = "date") -> DataFrame:
    """One row: days, annualised Sharpe (0 without spread), compound return and largest drawdown of a daily series."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    equity = returns.withColumn("equity", F.product(1 + F.col(value)).over(w))
    fallen = equity.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    sharpe = F.coalesce(F.try_divide(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    return fallen.agg(
        F.count(F.lit(1)).alias("days"), sharpe.alias("sharpe"), (F.product(1 + F.col(value)) - 1).alias("compound"), F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("max_drawdown")
    )


def bucket_returns(returns: DataFrame, days: int, value: str = "r", order: str = "date") -> DataFrame:
    """Compounded returns of consecutive buckets of `days`; the partial last one is dropped."""
    nth = F.floor((F.row_number().over(W.orderBy(order)) - 1) / days)
    got = returns.withColumn("bucket", nth).groupBy("bucket").agg((F.product(1 + F.col(value)) - 1).alias("r"), F.count(F.lit(1)).alias("n"))
    return got.where(F.col("n") == days).select("bucket", "r")


class Fold(NamedTuple):
    fold: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def walk_forward_folds(start: date, end: date, train: int = 252, test: int = 63, purge: int = 21, embargo: int = 5) -> list[Fold]:
    """Rolling windows of calendar days: training ends `purge` days before its window does, where the test starts."""
    folds, at = [], start
    while at + timedelta(days=train + test) <= end:
        split = at + timedelta(days=train)
        folds.append(Fold(len(folds), at, split - timedelta(days=purge), split, split + timedelta(days=test)))
        at += timedelta(days=test + embargo)
    return folds


def assign_folds(rows: DataFrame, folds: list[Fold], on: str = "date") -> DataFrame:
    """Each row once for every fold it trains or tests; folds are few and broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame(folds, "fold int, train_start date, train_end date, test_start date, test_end date")
    months = F.explode(F.sequence(F.trunc("train_start", "month"), F.trunc("test_end", "month"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    table = F.broadcast(table.select("*", months))
    training = (F.col(on) >= F.col("train_start")) & (F.col(on) < F.col("train_end"))
    testing = (F.col(on) >= F.col("test_start")) & (F.col(on) < F.col("test_end"))
    out = rows.join(table, F.trunc(on, "month") == F.col("month")).where(training | testing)
    return out.select(*rows.columns, "fold", F.when(testing, "test").otherwise("train").alias("part"))


def purged_kfold(rows: DataFrame, k: int, purge: int, embargo: int, on: str = "date") -> DataFrame:
    """(rows, fold, part): contiguous folds by date; rows within `purge` days of a test fold, or `embargo` days after, are left out."""
    days = rows.select(on).distinct().withColumn("nth", F.row_number().over(W.orderBy(on)) - 1)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    bounds = days.withColumn("fold", F.floor(F.col("nth") * k / n).cast("int")).groupBy("fold").agg(F.min(on).alias("lo"), F.max(on).alias("hi"))
    each = rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    joined = each.join(F.broadcast(bounds), "fold")
    d = F.col(on)
    test = d.between(F.col("lo"), F.col("hi"))
    train = (d < F.date_sub("lo", purge)) | (d > F.date_add("hi", purge + embargo))
    return joined.where(test | train).select(*rows.columns, "fold", F.when(test, "test").otherwise("train").alias("part"))


def correlation_weights(df: DataFrame, features: list[str], label: str, non_negative: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, ic, weight): pooled rank correlations, normalised to absolute sum 1; all zero gives equal weights."""
    from .pooled import rank_ics

    if by:
        numbered = df.where(F.col(label).isNotNull()).select(*by).distinct().collect()  # a row a group
        named = df.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(numbered)], ", ".join([*(f"_by_{c} {dict(df.dtypes)[c]}" for c in by), "_grp int"]))
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        ics = rank_ics(df.join(F.broadcast(named), on).withColumn("_of", F.array("_grp")), features, label, "_of", max(1, len(numbered)))
        ics = ics.join(F.broadcast(named), F.col("grp") == F.col("_grp")).select(*[F.col(f"_by_{c}").alias(c) for c in by], "feature", "ic")
    else:
        ics = rank_ics(df.withColumn("_of", F.array(F.lit(0))), features, label, "_of", 1).select("feature", "ic")
    return shared_weights(ics, F.greatest(F.col("ic"), F.lit(0.0)) if non_negative else F.col("ic"), by)


def shared_weights(rows: DataFrame, raw: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with weight: `raw` over the sum of sizes within `by`, or equal shares where that is 0. A row a feature."""
    everything = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    total = F.sum(F.abs(raw)).over(everything)
    return rows.withColumn("weight", F.when(total > 0, raw / total).otherwise(1 / F.count(F.lit(1)).over(everything)))


def weighted_ranks(counts: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks within `by` (a feature, if not given) of values that stand for `n` rows each, by counts of distinct values."""
    from .audit import cumulative

    by = by or ["feature"]
    each = counts.groupBy(*by, value).agg(F.sum("n").alias("_n"))
    ranks = cumulative(each, by, value, "_n", "_upto")
    return counts.join(ranks.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), [*by, value])


def attribution(weights: DataFrame, returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """(level, name, pnl): weight times return, summed by sector and in total with one grouping-sets aggregation."""
    rows = weights.join(returns, ["instrument", "date"]).join(sectors, "instrument", "left")
    rows = rows.select(F.coalesce("sector", F.lit("UNMAPPED")).alias("sector"), (F.col("weight") * F.col("r")).alias("pnl"))
    out = rows.rollup("sector").agg(F.sum("pnl").alias("pnl"), F.grouping("sector").alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise("sector").alias("level"), F.when(F.col("g") == 1, "all").otherwise(F.col("sector")).alias("name"), "pnl")
