"""Point-in-time joins: the latest row known at a time, never a later one.

Both sides are stacked and one window by key carries the last right row along; the whole row travels as one struct,
so that missing fields of the latest row are not filled from an older one. Keys shuffle once. `bucket` cuts a hot
key's time line into parts: each part is joined by itself and starts from the last right row before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str],
    strict: bool = False, forward: bool = False, tiebreak: list[str] | None = None, out: str = "match", bucket: str | None = None,
) -> DataFrame:
    """`left` with a struct `out` of the right row's time and payload (NULL if there is none).

    `strict` leaves out equal times; `forward` looks for the first row at or after. Among right rows of equal key and
    time the last in order of `tiebreak` wins. `bucket` (such as "month", a date_trunc unit) cuts each key's time
    line, so that no task holds a hot key's whole history.
    """
    ties = tiebreak or []
    row = F.struct(F.col(right_time).alias("at"), *payload)
    best = right.where(F.col(right_time).isNotNull()).groupBy(*by, right_time).agg(F.max(F.struct(*ties, row.alias("row")))["row"].alias("row"))
    last_side = 1 if strict != forward else 0
    first, second = (F.lit(1 - last_side), F.lit(last_side))
    l = left.select(*by, F.col(left_time).alias("_t"), first.alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(best.schema["row"].dataType).alias("_right"))
    r = best.select(*by, F.col(right_time).alias("_t"), second.alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.col("row").alias("_right"))
    both = l.unionByName(r)
    keys = list(by)
    if bucket:
        both = both.withColumn("_part", F.date_trunc(bucket, "_t"))
        keys = [*by, "_part"]
    order = [F.col("_t").desc(), F.col("_side").desc()] if forward else [F.col("_t"), F.col("_side")]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w))
    if bucket:
        ends = both.where("_right IS NOT NULL").groupBy(*keys).agg((F.min_by if forward else F.max_by)("_right", "_t").alias("_edge"))
        parts = both.select(*keys).distinct().join(ends, keys, "left")
        step = W.partitionBy(*by).orderBy(F.col("_part").desc() if forward else F.col("_part")).rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.last("_edge", ignorenulls=True).over(step)).drop("_edge")
        both = both.join(parts, keys, "left").withColumn("_found", F.coalesce("_found", "_before"))
    return both.where("_left IS NOT NULL").select("_left.*", F.col("_found").alias(out))


def latest_known(history: DataFrame, key: str, as_of: str, available_at: str, at) -> DataFrame:
    """One row a key: the latest by (as_of, available_at) with both at or before `at`."""
    seen = history.where((F.col(as_of) <= at) & (F.col(available_at) <= at))
    best = seen.groupBy(key).agg(F.max(F.struct(as_of, available_at, *[c for c in history.columns if c not in (key, as_of, available_at)])).alias("b"))
    return best.select(key, "b.*")


def range_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, days: int, strict: bool = True) -> DataFrame:
    """All pairs with right time within `days` before left time; joined on key and coarse time cells, not key alone."""
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * days)).cast("long")
    l = left.withColumn("_cell", F.explode(F.array(cell(left_time), cell(left_time) - 1)))
    r = right.select(*[F.col(b).alias(f"_r_{b}") for b in by], *[c for c in right.columns if c not in by]).withColumn("_rcell", cell(right_time))
    on = F.col("_cell") == F.col("_rcell")
    for b in by:
        on = on & (F.col(b) == F.col(f"_r_{b}"))
    after = F.col(right_time) < F.col(left_time) if strict else F.col(right_time) <= F.col(left_time)
    near = F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {days} DAYS")
    return l.join(r, on & after & near).drop("_cell", "_rcell", *[f"_r_{b}" for b in by])
