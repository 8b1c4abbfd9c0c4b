"""Risk of a portfolio by factors and scenarios, blending of signals, and the merging of engines' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import free_name
from .settle import settled


def factor_exposures(weights: DataFrame, loadings: DataFrame) -> DataFrame:
    """(factor, exposure): weights(instrument, weight) times loadings(instrument, factor, loading)."""
    return weights.join(loadings, "instrument").groupBy("factor").agg(F.sum(F.col("weight") * F.col("loading")).alias("exposure"))


def cap_factors(weights: DataFrame, loadings: DataFrame, cap: float, rounds: int = 4) -> DataFrame:
    """`weights` with names of positive loading scaled down until no factor's exposure is above `cap`, in few rounds.

    Within a round all oversized factors are measured at once; a name that loads on several is scaled by each.
    """
    names = loadings.where("loading > 0").select("instrument", "factor")
    scale = free_name(weights, "scale")
    for _ in range(rounds):
        weights = settled(weights)
        scales = settled(factor_exposures(weights, loadings).where(F.col("exposure") > cap).select("factor", F.lit(cap) / F.col("exposure")).toDF("factor", "scale"))
        if scales.isEmpty():
            return weights
        per = names.join(F.broadcast(scales), "factor").groupBy("instrument").agg(F.product("scale").alias(scale))
        weights = weights.join(per, "instrument", "left").withColumn("weight", F.col("weight") * F.coalesce(scale, F.lit(1.0))).drop(scale)
    return weights


def stress(weights: DataFrame, shocks: DataFrame) -> DataFrame:
    """(scenario, result) of shocks(scenario, instrument, shock); a shock without instrument hits the whole portfolio."""
    whole = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("all"))
    named = shocks.join(weights.select("instrument", "weight"), "instrument", "left").withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")
    hit = F.when(F.col("instrument").isNull(), F.col("all")).otherwise(F.coalesce("weight", F.lit(0.0)))
    return named.groupBy("scenario").agg(F.sum(hit * F.col("shock")).alias("result"))


def tail_loss(results: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: the mean of the worst ceil(share * n) losses among the n scenarios that lose; null without any."""
    losses = results.where("result < 0").select((-F.col("result")).alias("loss"))
    w = W.orderBy(F.col("loss").desc())  # one row a scenario
    ranked = losses.select("loss", F.row_number().over(w).alias("nth"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("n"))
    return ranked.where(F.col("nth") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share))).agg(F.avg("loss").alias("tail_loss"))


def inverse_vol_scale(weights: DataFrame, variances: DataFrame, decay: float = 1.0) -> DataFrame:
    """`weights(instrument, weight, …)` by average volatility over own, with the gross kept; unchanged unless all have one."""
    whole = W.partitionBy(F.lit(1))  # the names of one portfolio
    variance, vol, scaled, after, known = (free_name(weights, x) for x in ("variance", "vol", "scaled", "after", "known"))
    rows = weights.join(variances.select("instrument", F.col("variance").alias(variance)), "instrument", "left")
    rows = rows.withColumn(vol, F.when(F.col(variance) > 0, F.sqrt(F.col(variance) * decay)))
    rows = rows.withColumn(scaled, F.col("weight") * F.avg(vol).over(whole) / F.col(vol))
    rows = rows.withColumns({after: F.sum(scaled).over(whole), known: F.count(vol).over(whole) == F.count(F.lit(1)).over(whole)})
    kept = F.when(F.col(known) & (F.col(after) > 0), F.col(scaled) * F.sum("weight").over(whole) / F.col(after)).otherwise(F.col("weight"))
    return rows.withColumn("weight", kept).select(*weights.columns)


def ewma_ic_weights(ics: DataFrame, span: int = 20, lookback: int = 60, least: float = 0.01) -> DataFrame:
    """(factor, weight) by an exponential mean, from 0, of the last ICs(factor, date, ic): negative ones count 0.

    The recursion e = a ic + (1 - a) e is the sum of a (1 - a)^k ic over the k-th value from the end. Weights below
    `least` go and the others are scaled up; without any positive one all are equal.
    """
    a = 2.0 / (span + 1)
    back = F.row_number().over(W.partitionBy("factor").orderBy(F.col("date").desc())) - 1
    recent = ics.withColumn("_back", back).where(F.col("_back") < lookback)
    raw = recent.groupBy("factor").agg(F.greatest(F.lit(0.0), F.sum(a * F.pow(F.lit(1 - a), F.col("_back")) * F.col("ic"))).alias("raw"))
    whole = W.partitionBy(F.lit(1))  # one row a factor
    raw = raw.withColumns({"_total": F.sum("raw").over(whole), "_n": F.count(F.lit(1)).over(whole)})
    raw = raw.withColumn("_share", F.when(F.col("_total") < 1e-9, 1.0 / F.col("_n")).otherwise(F.col("raw") / F.col("_total")))
    kept = raw.where((F.col("_total") < 1e-9) | (F.col("_share") >= least))
    return kept.select("factor", (F.col("_share") / F.sum("_share").over(whole)).alias("weight"))


def merge_engines(targets: DataFrame, budgets: DataFrame, previous: DataFrame) -> DataFrame:
    """(instrument, weight) of all engines' targets(engine, instrument, weight) under their budgets.

    Weights are scaled by the smaller of capital and gross of budgets(engine, capital, max_gross, max_turnover, enabled).
    An engine whose turnover against previous(engine, instrument, weight) is above its bound moves that share of the
    way. Engines of more capital come first; a later one gets what its own gross limit leaves at an instrument, which
    a running pass over the few engines of each instrument works out. Weights above 0 in all stay.
    """
    budgets = budgets.where("enabled")
    scaled = targets.join(F.broadcast(budgets), "engine").select("engine", "instrument", (F.col("weight") * F.least("capital", "max_gross")).alias("w"))
    asked = targets.select("engine").distinct()
    held = previous.join(F.broadcast(asked), "engine", "left_semi").select("engine", "instrument", F.col("weight").alias("was"))
    both = scaled.join(held, ["engine", "instrument"], "full_outer").na.fill(0.0, ["w", "was"]).join(F.broadcast(budgets), "engine")
    turnover = F.sum(F.abs(F.col("w") - F.col("was"))).over(W.partitionBy("engine"))
    part = F.when(turnover > F.col("max_turnover"), F.col("max_turnover") / turnover).otherwise(1.0)
    moved = both.withColumn("w", F.col("was") + (F.col("w") - F.col("was")) * part)
    first = F.struct((-F.col("capital")).alias("order"), "engine", "w", "max_gross")

    def take(taken, x):
        return taken + F.least(x["w"], F.greatest(F.lit(0.0), x["max_gross"] - taken))

    out = moved.groupBy("instrument").agg(F.sort_array(F.collect_list(first)).alias("line"))
    return out.select("instrument", F.aggregate("line", F.lit(0.0), take).alias("weight")).where("weight > 0")
