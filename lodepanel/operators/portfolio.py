"""Portfolio targets, costs, execution and the path-dependent day loop."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settle import settled


def top_n(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best positive scores of each date; ties by instrument."""
    nth = F.row_number().over(W.partitionBy("date").orderBy(F.col(score).desc(), "instrument"))
    return scores.where(F.col(score) > 0).withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def equal_weights(picked: DataFrame, gross: float, cap: float) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    return picked.withColumn("weight", F.least(F.lit(gross), n * cap) / n)


def inverse_vol_weights(picked: DataFrame, gross: float, cap: float, shrink: float = 0.5, floor: float = 0.005) -> DataFrame:
    """Equal weights mixed with inverse volatility; a missing volatility counts as the date's median."""
    day = W.partitionBy("date")
    n = F.count(F.lit(1)).over(day)
    vol = F.greatest(F.coalesce(F.col("vol"), F.median("vol").over(day), F.lit(floor)), F.lit(floor))
    rows = picked.withColumn("inverse", 1 / vol)
    part = shrink / n + (1 - shrink) * F.col("inverse") / F.sum("inverse").over(day)
    return rows.withColumn("weight", part * F.least(F.lit(gross), n * cap)).drop("inverse")


def conviction_weights(picked: DataFrame, gross: float, cap: float, shrink: float = 0.25) -> DataFrame:
    """Equal weights mixed with the score above the date's least picked score."""
    day = W.partitionBy("date")
    n = F.count(F.lit(1)).over(day)
    above = F.col("score") - F.min("score").over(day)
    rows = picked.withColumn("above", above)
    total = F.sum("above").over(day)
    part = F.when(total > 0, shrink / n + (1 - shrink) * F.col("above") / total).otherwise(1 / n)
    return rows.withColumn("weight", part * F.least(F.lit(gross), n * cap)).drop("above")


def limit_weights(weights: DataFrame, cap: float, gross: float) -> DataFrame:
    """Cap each name, then scale a date down to the gross limit."""
    capped = weights.withColumn("weight", F.least("weight", F.lit(cap)))
    total = F.sum("weight").over(W.partitionBy("date"))
    return capped.withColumn("weight", F.when(total > gross, F.col("weight") * gross / total).otherwise(F.col("weight")))


def trades(weights: DataFrame) -> DataFrame:
    """(date, instrument, change) against the date before of the whole calendar; leaving a name counts.

    What a name did the day before, and whether it stays, is read off its own rows by day numbers.
    """
    weights = settled(weights.select("date", "instrument", "weight"))
    line = W.orderBy("on_date")  # one row a date
    days = weights.select(F.col("date").alias("on_date")).distinct().withColumns({"day": F.row_number().over(line), "next_date": F.lead("on_date").over(line)})
    rows = weights.join(F.broadcast(days), F.col("date") == F.col("on_date"))
    own = W.partitionBy("instrument").orderBy("day")
    was = F.when(F.lag("day").over(own) == F.col("day") - 1, F.lag("weight").over(own)).otherwise(0.0)
    left = ~F.coalesce(F.lead("day").over(own) == F.col("day") + 1, F.lit(False))
    rows = rows.select("instrument", "date", "weight", (F.col("weight") - was).alias("moved"), F.when(left, F.col("next_date")).alias("gone"))
    changes = F.array(F.struct("date", F.col("moved").alias("change")), F.struct(F.col("gone").alias("date"), (-F.col("weight")).alias("change")))
    return rows.select("instrument", F.explode(changes).alias("c")).where("c.date IS NOT NULL").select("c.date", "instrument", "c.change")


def linear_cost(change: Column, bps: float) -> Column:
    return F.sum(F.abs(change)) * (bps / 1e4)


def quadratic_cost(change: Column, bps: float, impact_bps: float, cap: float) -> Column:
    return linear_cost(change, bps) + F.sum(change * change) * (impact_bps / 1e4 / cap**2)


def sqrt_slippage(shares: Column, adv: Column, spread_bps: Column, sigma: float = 0.02, eta: float = 0.1, floor: float = 1.0) -> Column:
    """Impact of an order by the square root of its share of volume, plus half the spread, in basis points."""
    return F.greatest(F.lit(floor), F.sqrt(F.try_divide(shares, adv)) * (sigma * eta * 1e4) + spread_bps / 2)


def commission(shares: Column, price: Column, per_share: float = 0.005, least: float = 1.0, most: float = 0.01) -> Column:
    return F.least(F.greatest(shares * per_share, F.lit(least)), shares * price * most)


def replay_fills(orders: DataFrame, bars: DataFrame, rate: float = 0.1) -> DataFrame:
    """Fills of (instrument, day, quantity) over later bars (instrument, day, ts, price, volume) up to a share of volume.

    Set-based: what earlier bars could hold is a running sum, and a bar takes what is left up to its own capacity.
    """
    w = W.partitionBy("instrument", "day").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    sized = bars.withColumn("capacity", F.floor(F.col("volume") * rate))
    sized = sized.withColumn("before", F.coalesce(F.sum("capacity").over(w), F.lit(0)))
    rows = orders.join(sized, ["instrument", "day"])
    fill = F.least(F.col("capacity"), F.greatest(F.lit(0), F.col("quantity") - F.col("before")))
    rows = rows.withColumn("filled", fill)
    return rows.groupBy("instrument", "day", "quantity").agg(F.sum("filled").alias("filled"), F.try_divide(F.sum(F.col("filled") * F.col("price")), F.sum("filled")).alias("fill_price"))


def plan_orders(targets: DataFrame, holdings: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """(instrument, side, shares): whole-share orders from weights, sells first."""
    both = targets.join(holdings, "instrument", "full_outer").join(prices, "instrument")
    want = F.floor(F.coalesce("weight", F.lit(0.0)) * equity / F.col("price"))
    delta = (want - F.coalesce("held", F.lit(0))).cast("long")
    rows = both.select("instrument", delta.alias("delta")).where("delta <> 0")
    return rows.select("instrument", F.when(F.col("delta") < 0, "sell").otherwise("buy").alias("side"), F.abs("delta").alias("shares"))


def day_loop(
    arms: DataFrame, n: int = 10, gross: float = 1.0, cap: float = 0.15, band: float = 0.005, most_change: float = 0.1, most_turnover: float = 0.5, buffer: int = 3, bps: float = 10.0
) -> DataFrame:
    """(arm, date, r, turnover, cost, names) of the long-only loop over rows (arm, date, instrument, score, r).

    Weights of a day depend on those of the day before, so an arm is walked in order; arms run side by side. Spark
    ranks the names; the walk of an arm sees one row a date, with its best `n` + `buffer` names, whatever the universe.
    It answers with a row a date and a row for each time that a weight changes; weights too small to be sold stay, and
    cost no row a day. These spans, at most about `gross` / `band` + `n` a date, are joined with the returns again.
    """

    def target(ranked: list, held: dict) -> dict:
        chosen, near = ranked[:n], [i for i in ranked[n:] if i in held]
        for name in near:
            for k in range(len(chosen) - 1, -1, -1):
                if chosen[k] not in held:
                    chosen[k] = name
                    break
        share = min(gross, len(chosen) * cap) / len(chosen) if chosen else 0.0
        return {i: min(share, cap) for i in chosen}

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        since: dict = {}
        live: set = set()  # held names large enough to be sold; smaller rests stay as they are
        out = []
        for day, line in sorted(zip(frame.date, frame.line, strict=True)):
            want = target([x["instrument"] for x in line], held)
            move = {i: want.get(i, 0.0) - held.get(i, 0.0) for i in sorted({*want, *live}, key=str)}
            move = {i: max(-most_change, min(most_change, d)) for i, d in move.items() if abs(d) >= band}
            turnover = sum(map(abs, move.values()))
            scale = min(1.0, most_turnover / turnover) if turnover > 0 else 1.0
            moved = 0.0
            for i, d in move.items():
                was = held.pop(i, 0.0)
                now = was + d * scale
                now = now if now > 1e-12 else 0.0
                moved += abs(now - was)
                if was:
                    out.append((key[0], since.pop(i), day, i, was, None, None))
                if now:
                    held[i], since[i] = now, day
                (live.add if now >= band else live.discard)(i)
            out.append((key[0], day, None, None, None, moved, len(held)))
        out.extend((key[0], since[i], None, i, w, None, None) for i, w in held.items())
        got = pd.DataFrame(out, columns=["arm", "date", "until", "instrument", "weight", "turnover", "names"])
        return got.astype({"instrument": object, "until": object, "names": "Int32"})

    kinds = dict(arms.dtypes)
    nth = F.row_number().over(W.partitionBy("arm", "date").orderBy(F.col("score").desc(), "instrument"))
    best = arms.where("score > 0").withColumn("nth", nth).where(F.col("nth") <= n + buffer)
    best = best.groupBy("arm", "date").agg(F.sort_array(F.collect_list(F.struct("nth", "instrument"))).alias("line"))
    days = arms.select("arm", "date").distinct().join(best, ["arm", "date"], "left")
    days = days.withColumn("line", F.coalesce("line", F.array().cast(best.schema["line"].dataType)))
    schema = f"arm {kinds['arm']}, date date, until date, instrument {kinds['instrument']}, weight double, turnover double, names int"
    walked = settled(days.groupBy("arm").applyInPandas(walk, schema))
    spans = walked.where("weight IS NOT NULL").select(F.col("arm").alias("of_arm"), F.col("instrument").alias("name"), F.col("date").alias("since"), "until", "weight")
    same = (F.col("arm") == F.col("of_arm")) & (F.col("instrument") == F.col("name")) & (F.col("date") >= F.col("since")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    gains = arms.where("r IS NOT NULL").join(F.broadcast(spans), same).groupBy("arm", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("gain"))
    got = walked.where("weight IS NULL").select("arm", "date", "turnover", "names").join(gains, ["arm", "date"], "left")
    cost = F.col("turnover") * (bps / 1e4)
    return got.select("arm", "date", (F.coalesce("gain", F.lit(0.0)) - cost).alias("r"), "turnover", cost.alias("cost"), "names")


def vol_scale(returns: list[float], target: float, floor: float = 0.05) -> float:
    """Exposure that brings annualised volatility down to `target`, at most 1."""
    if len(returns) < 2:
        return 1.0
    mean = sum(returns) / len(returns)
    vol = math.sqrt(sum((r - mean) ** 2 for r in returns) / (len(returns) - 1)) * math.sqrt(252)
    return min(1.0, target / max(vol, floor))


def streak_scale(ics: list[float], alpha: float = 0.5, worst: int = 3, low: float = -0.02) -> float:
    """Exposure from earlier folds' ICs: 1 with under four, 0 after `worst` negative ones, else by their running mean."""
    if len(ics) < 4:
        return 1.0
    run = 0
    for ic in reversed(ics):
        if ic >= 0:
            break
        run += 1
    if run >= worst:
        return 0.0
    mean = ics[0]
    for ic in ics[1:]:
        mean = alpha * ic + (1 - alpha) * mean
    return max(0.0, min(1.0, (mean - low) / -low))
