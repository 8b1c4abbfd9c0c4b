"""Which instruments may be traded, how much of them, and what evidence a feature brings for admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audit import ic_series
from .evaluate import daily_ic, rank_turnover, safe_corr


def tradable(instruments: DataFrame, profiles: DataFrame, classes: list[str], least_adv: float, with_sector: bool = True) -> DataFrame:
    """`instruments(instrument, asset_class, sector)` of the classes whose profile(instrument, adv_dollars) is liquid enough."""
    rows = instruments.where(F.col("asset_class").isin(classes))
    if with_sector:
        rows = rows.where(F.coalesce("sector", F.lit("")) != "")
    return rows.join(profiles.select("instrument", "adv_dollars"), "instrument").where(F.col("adv_dollars") >= least_adv)


def may_order(shares: Column, adv: Column, share: float = 0.05, without_profile: bool = False) -> Column:
    """Whether an order stays within a share of average daily volume, in whole shares."""
    return F.when(adv.isNotNull(), shares <= F.floor(adv * share)).otherwise(F.lit(without_profile))


def known_window(rows: DataFrame, start: Column, end: Column, on: str = "as_of", known: str = "available_at") -> DataFrame:
    """Rows of a closed window that were known by its end."""
    return rows.where((F.col(on) >= start) & (F.col(on) <= end) & (F.col(known) <= end))


def clean_weights(weights: DataFrame, least: float = 1e-12) -> DataFrame:
    """Weights that are finite and above `least`."""
    w = F.col("weight")
    return weights.where(w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf")) & (w > least))


def evidence(df: DataFrame, feature: str, label: str, baselines: list[str]) -> DataFrame:
    """One row: mean_ic, rank_ic, icir, turnover, coverage, dates, and the largest correlation with a baseline."""
    plain = daily_ic(df, feature, label, rank=False).where("n >= 2").agg(F.avg("ic").alias("mean_ic"))
    ranked = ic_series(df, feature, label).agg(F.avg("ic").alias("rank_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.count(F.lit(1)).alias("dates"))
    turned = rank_turnover(df, feature).agg(F.avg("turnover").alias("turnover"))
    pooled = df.agg(F.avg(F.col(feature).isNotNull().cast("double")).alias("coverage"), F.greatest(F.lit(0.0), *[F.abs(F.coalesce(safe_corr(F.col(feature), F.col(b)), F.lit(0.0))) for b in baselines]).alias("max_corr"))
    out = pooled.withColumn("_one", F.lit(1))
    for one in (plain, ranked, turned):  # a row each
        out = out.join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def admitted(min_rank_ic: float = 0.02, min_icir: float = 0.1, max_turnover: float = 0.4, min_coverage: float = 0.5, max_corr: float = 0.7, min_dates: int = 30) -> Column:
    """Whether a row of evidence passes; a missing measure fails."""
    passed = (F.abs("rank_ic") >= min_rank_ic) & (F.abs("icir") >= min_icir) & (F.col("turnover") <= max_turnover) & (F.col("coverage") >= min_coverage)
    return F.coalesce(passed & (F.col("max_corr") <= max_corr) & (F.col("dates") >= min_dates), F.lit(False))


def worst_streak_drawdown(folds: DataFrame) -> DataFrame:
    """One row: the drawdown over the longest run of folds(fold, ic, r) with negative ic; 0 without any.

    Folds are few.
    """
    line = W.orderBy("fold")
    island = F.row_number().over(line) - F.row_number().over(W.partitionBy("_bad").orderBy("fold"))
    rows = folds.withColumn("_bad", F.coalesce(F.col("ic") < 0, F.lit(False))).withColumn("_island", island).where("_bad")
    size = F.count(F.lit(1)).over(W.partitionBy("_island"))
    start = F.min("fold").over(W.partitionBy("_island"))
    rows = rows.withColumns({"_size": size, "_start": start})
    worst = rows.withColumn("_nth", F.dense_rank().over(W.orderBy(F.col("_size").desc(), "_start"))).where("_nth = 1")
    equity = F.product(1 + F.col("r")).over(line.rowsBetween(W.unboundedPreceding, 0))
    fallen = worst.withColumn("_equity", equity)
    fallen = fallen.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_equity").over(line.rowsBetween(W.unboundedPreceding, 0))))
    return fallen.agg(F.coalesce(F.min(F.col("_equity") / F.col("_peak") - 1), F.lit(0.0)).alias("drawdown"))
