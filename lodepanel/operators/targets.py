"""Portfolio targets in exact decimals, blended scores that fail closed, and frames of orders by date."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Twelve places: quotients and products of such numbers keep at least eighteen.
EXACT = "decimal(20,12)"
#: The share of exposure kept under each market label.
EXPOSURE = {"risk_on": Decimal("1.0"), "transition": Decimal("0.75"), "risk_off": Decimal("0.5"), "crisis": Decimal("0.0")}
OTHER_EXPOSURE = Decimal("0.75")


def _exact(x: float | Decimal) -> Column:
    return F.lit(Decimal(str(x))).cast(EXACT)


def exposure(label: Column) -> Column:
    """The share of exposure that a market label leaves."""
    out = F.lit(OTHER_EXPOSURE).cast(EXACT)
    for name, share in EXPOSURE.items():
        out = F.when(label == name, F.lit(share).cast(EXACT)).otherwise(out)
    return out


def long_only_targets(
    scores: DataFrame, n: int = 10, least: float = 0.0, gross: float = 1.0, cash: float = 0.05, name_cap: float = 0.1, sector_cap: float = 0.3,
) -> DataFrame:
    """(date, instrument, sector, weight decimal): the best `n` scores(date, instrument, sector, score, label) of each date
    above `least`, equally weighted.

    Exposure is the smaller of `gross` and 1 - `cash`, times what the date's market label leaves. Where equal shares would
    pass `name_cap`, as many names as fit get the cap. A name goes where its sector is full; the names after it move
    up in the sector, not in the date.
    """
    day = W.partitionBy("date")
    nth = F.row_number().over(day.orderBy(F.col("score").desc(), "instrument"))
    room = _exact(min(Decimal(str(gross)), 1 - Decimal(str(cash)))) * exposure(F.col("label"))
    rows = scores.where(F.col("score") > least).select("date", "instrument", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), nth.alias("nth"), room.cast(EXACT).alias("room")).where(F.col("nth") <= n)
    cap = _exact(name_cap)
    even = (F.col("room") / F.count(F.lit(1)).over(day)).cast(EXACT)
    most = F.floor(F.col("room") / cap)
    rows = rows.select("*", F.when(even <= cap, even).otherwise(cap).alias("weight"), F.when(even <= cap, F.lit(n)).otherwise(most).alias("most"))
    rows = rows.where((F.col("room") > 0) & (F.col("nth") <= F.col("most")))
    place = F.row_number().over(W.partitionBy("date", "sector").orderBy("nth"))
    full = rows.withColumn("place", place).where(F.col("place") * F.col("weight") <= _exact(sector_cap))
    return full.select("date", "instrument", "sector", "weight")


def vol_targeted(weights: DataFrame, target: float = 0.15, floor: float = 0.05, name_cap: float = 0.1, places: int = 4) -> DataFrame:
    """weights(date, instrument, weight, vol) with target_weight and the date's cash, rounded half up to `places`.

    A weight is scaled by `target` over its volatility (at least `floor`; without a positive one it stays), all are
    scaled back to the date's gross exposure, and then capped. Decimals throughout, so reruns and engines agree.
    """
    day = W.partitionBy("date")
    vol = F.greatest(F.col("vol").cast(EXACT), _exact(floor))
    w = F.col("weight").cast(EXACT)
    scaled = weights.withColumn("scaled", F.when(F.col("vol") > 0, (w * _exact(target)).cast(EXACT) / vol).otherwise(w).cast(EXACT))
    factor = (F.sum(w).over(day).cast(EXACT) / F.sum("scaled").over(day).cast(EXACT)).cast(EXACT)
    got = scaled.withColumn("target_weight", F.round(F.least((F.col("scaled") * factor).cast(EXACT), _exact(name_cap)), places).cast(f"decimal(18,{places})"))
    left = F.greatest(F.lit(Decimal(0)).cast(EXACT), F.lit(Decimal(1)).cast(EXACT) - F.sum("target_weight").over(day))
    return got.withColumn("cash", F.round(left, places).cast(f"decimal(18,{places})")).drop("scaled")


def ensemble(scores: DataFrame, weights: dict[str, float], keys: list[str], required: bool = True, versions: dict[str, str] | None = None) -> DataFrame:
    """`keys` with score and confidence blended from scores(keys, source, score, confidence[, version]).

    The score is the weighted sum within -1 to 1; the confidence is the weighted mean of those sources that scored the
    row. With `required`, a row that a weighted source has not scored raises when it is computed; so does a confidence
    outside 0 to 1, and a version other than `versions` names. The checks are part of the score, so that no plan drops them.
    """
    used = {s: w for s, w in weights.items() if w > 0}
    rows = scores.where(F.col("source").isin(list(used)))
    version = F.col("version") if versions else F.lit(None).cast("string")
    by = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("score", "confidence", version.alias("version"))))).alias("by"))
    total, sure, covered = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    problem = F.lit(None).cast("string")
    for source, w in used.items():
        got = F.try_element_at("by", F.lit(source))
        total = total + F.coalesce(got["score"] * w, F.lit(0.0))
        sure = sure + F.coalesce(F.when(got["score"].isNotNull(), got["confidence"] * w), F.lit(0.0))
        covered = covered + F.when(got["score"].isNotNull(), F.lit(float(w))).otherwise(0.0)
        if required:
            problem = F.coalesce(problem, F.when(got["score"].isNull(), F.concat(F.lit(f"source {source} has no score for "), F.to_json(F.struct(*keys)))))
        if versions and source in versions:
            problem = F.coalesce(problem, F.when(got["version"] != versions[source], F.concat(F.lit(f"source {source} is of version "), got["version"])))
        problem = F.coalesce(problem, F.when((got["confidence"] < 0) | (got["confidence"] > 1), F.lit(f"source {source} has a confidence outside 0 to 1")))
    checked = lambda c: F.when(problem.isNotNull(), F.raise_error(problem).cast("double")).otherwise(c)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))
    return by.select(*keys, checked(score).alias("score"), checked(F.when(covered > 0, sure / covered).otherwise(0.0)).alias("confidence"))


def signal_frames(targets: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """(date, instrument, weight, entry, exit): what a simulator needs for each target, `lag` trading days after it was made.

    targets(date, instrument, weight) are whole books by date; a name that a later book lacks leaves on that book's
    day with weight 0. calendar(date) has the trading days.
    """
    line = W.orderBy("date")
    days = calendar.select("date").distinct().withColumns({"trade_date": F.lead("date", lag).over(line)}).withColumnRenamed("date", "made")  # a row a date
    books = targets.select("date").distinct().withColumn("next_book", F.lead("date").over(line)).withColumnRenamed("date", "book")
    rows = targets.where(F.col("weight") > 0).join(F.broadcast(books), F.col("date") == F.col("book"))
    own = W.partitionBy("instrument").orderBy("date")
    stays = F.coalesce(F.lead("date").over(own) == F.col("next_book"), F.lit(False))
    held = F.coalesce(F.lag("next_book").over(own) == F.col("date"), F.lit(False))
    rows = rows.select("instrument", "date", "weight", (~held).alias("entry"), F.when(~stays, F.col("next_book")).alias("gone"))
    zero = F.lit(0).cast(dict(targets.dtypes)["weight"])
    both = F.array(F.struct("date", "weight", "entry", F.lit(False).alias("exit")), F.struct(F.col("gone").alias("date"), zero.alias("weight"), F.lit(False).alias("entry"), F.lit(True).alias("exit")))
    each = rows.select("instrument", F.explode(both).alias("e")).select("instrument", "e.*").where("date IS NOT NULL")
    return each.join(F.broadcast(days), F.col("date") == F.col("made")).where("trade_date IS NOT NULL").select(F.col("trade_date").alias("date"), "instrument", "weight", "entry", "exit")


def book_parity(shadow: DataFrame, paper: DataFrame, on: str = "date") -> DataFrame:
    """(on, compared, missing, max_diff_bps, side_mismatches) of two books(on, instrument, weight, side).

    A name that one book lacks has weight 0 there. Where a book has no row at all on a day, all names of the other are
    missing. A side (buy, sell or none) counts as a mismatch where the two differ.
    """
    part = lambda df, name: df.groupBy(on, "instrument").agg(F.sum("weight").alias(name), F.max("side").alias(f"{name}_side"))
    both = part(shadow, "a").join(part(paper, "b"), [on, "instrument"], "full_outer")
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) * 1e4
    got = both.groupBy(on).agg(
        F.count(F.lit(1)).alias("compared"), F.count("a").alias("of_a"), F.count("b").alias("of_b"), F.max(gap).alias("max_diff_bps"), F.count_if(~F.col("a_side").eqNullSafe(F.col("b_side"))).alias("side_mismatches")
    )
    missing = F.when((F.col("of_a") == 0) | (F.col("of_b") == 0), F.col("compared")).otherwise(F.lit(0)).cast("long")
    return got.select(on, "compared", missing.alias("missing"), "max_diff_bps", "side_mismatches")
