"""Means of late values whose weights fall to zero, for several horizons in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import free_name
from .settle import settled


def _sums_back(asked: DataFrame, history: DataFrame, value: Column, horizons: list[int], bucket: str, closed: bool) -> tuple[DataFrame, str]:
    """`asked` with the time `t` (days), last time seen and running sums of 1, v, t and v * t as structs at<days>, for 0 and each
    of `horizons` days back; and the name of a column that numbers its rows.

    Values and times asked for are put in one line by instrument. `bucket` cuts the line, so that no task holds a hot
    instrument's whole history; parts are added up by their sums. `closed` counts a value of just that age as within.
    """
    row = free_name(asked, "asked_row")
    rows = settled(asked.withColumn(row, F.monotonically_increasing_id()))
    known = history.select("instrument", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), value.cast("double").alias("v")).where("micros IS NOT NULL AND v IS NOT NULL")
    origin = known.agg(F.min("micros")).first()[0] or 0
    days = lambda micros: (micros - F.lit(origin)) / 86_400e6
    now = days(F.unix_micros(F.col("as_of").cast("timestamp")))
    before = -1 if closed else 1
    points = F.array(*[F.struct(F.lit(h).alias("back"), (now - F.lit(float(h))).alias("t"), F.lit(before if h else 1).alias("side")) for h in [0, *horizons]])
    left = rows.select("instrument", F.col(row).alias("_row"), F.explode(points).alias("p")).select("instrument", "_row", "p.*", F.lit(None).cast("double").alias("v"))
    right = known.select("instrument", F.lit(None).cast("long").alias("_row"), F.lit(None).cast("int").alias("back"), days(F.col("micros")).alias("t"), F.lit(0).alias("side"), "v")
    length = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}[bucket]
    line = settled(left.unionByName(right).withColumn("part", F.floor(F.col("t") / length)))
    own = F.col("side") == 0
    sums = {"s1": F.when(own, 1.0), "sv": F.col("v"), "st": F.when(own, F.col("t")), "svt": F.col("v") * F.col("t")}
    zero = F.lit(0.0)
    parts = line.groupBy("instrument", "part").agg(*[F.coalesce(F.sum(c), zero).alias(n) for n, c in sums.items()], F.max(F.when(own, F.col("t"))).alias("last"))
    earlier = W.partitionBy("instrument").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    parts = parts.select(F.col("instrument").alias("_i"), F.col("part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"_{n}") for n in sums], F.max("last").over(earlier).alias("_last"))
    within = W.partitionBy("instrument", "part").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    ran = line.select("instrument", "part", "_row", "back", "t", "side", *[F.coalesce(F.sum(c).over(within), zero).alias(n) for n, c in sums.items()], F.max(F.when(own, F.col("t"))).over(within).alias("last")).where("_row IS NOT NULL")
    ran = ran.join(parts, F.col("instrument").eqNullSafe(F.col("_i")) & (F.col("part") == F.col("_p")))
    total = F.struct("t", F.coalesce("last", "_last").alias("last"), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
    got = ran.groupBy("_row").agg(*[F.max(F.when(F.col("back") == h, total)).alias(f"_at{h}") for h in [0, *horizons]])
    return rows.join(got, F.col(row) == F.col("_row")), row


def decayed_means(asked: DataFrame, history: DataFrame, value: str, horizons: list[int], bucket: str = "month") -> DataFrame:
    """`asked(instrument, as_of, …)` with a column mean_<days> for each horizon: history(instrument, at, value) of the last
    days, weighted linearly down to 0; 0 without any.

    A weight 1 - age / days is linear in the time of the value, so a mean needs only the sums of 1, v, t and v * t
    up to two times: now, and `days` ago. Running sums answer all horizons, with one shuffle and no join of ranges.
    """
    out, _ = _sums_back(asked, history, F.col(value), horizons, bucket, closed=False)
    now, means = F.col("_at0"), {}
    for h in horizons:
        d = {n: now[n] - F.col(f"_at{h}")[n] for n in ("s1", "sv", "st", "svt")}
        # The sum of v * (1 - (t0 - t) / h), and the same of the weights alone.
        top = d["sv"] * (1 - now["t"] / h) + d["svt"] / h
        under = d["s1"] * (1 - now["t"] / h) + d["st"] / h
        means[f"mean_{h}"] = F.when((d["s1"] > 0) & (under > 1e-9), top / under).otherwise(0.0)
    return out.select(*asked.columns, *[c.alias(n) for n, c in means.items()])


def event_context(asked: DataFrame, events: DataFrame, lookbacks: tuple[int, ...] = (1, 2, 3, 5, 7, 21), bucket: str = "month", most: int = 3) -> DataFrame:
    """`asked(instrument, as_of, …)` with what lately happened, from events(instrument, at).

    For each lookback: count_<days> (events of at most that age, at most `most`, over `most`), density_<days> (their
    linear weights, summed, over the days) and recency_<days> (the largest weight); and days_since the last event (999
    without any). The running sums of `decayed_means`, so all lookbacks come from one pass.
    """
    out, _ = _sums_back(asked, events, F.lit(1.0), list(lookbacks), bucket, closed=True)
    now = F.col("_at0")
    age, columns = now["t"] - now["last"], {}
    for h in lookbacks:
        n, t = now["s1"] - F.col(f"_at{h}")["s1"], now["st"] - F.col(f"_at{h}")["st"]
        columns[f"count_{h}"] = F.least(F.round(n), F.lit(float(most))) / most
        columns[f"density_{h}"] = F.greatest(F.lit(0.0), n * (1 - now["t"] / h) + t / h) / h
        columns[f"recency_{h}"] = F.when(n > 0.5, F.greatest(F.lit(0.0), 1 - age / h)).otherwise(0.0)
    return out.select(*asked.columns, *[c.alias(n) for n, c in columns.items()], F.coalesce(age, F.lit(999.0)).alias("days_since"))
