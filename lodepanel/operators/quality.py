"""Checks of bars and vendor data, and how bars are cleaned, deduplicated and adjusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import free_name


def valid_bar() -> Column:
    """Positive prices, high the largest and low the smallest."""
    positive = (F.least("open", "high", "low", "close") > 0)
    return positive & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))


def drop_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(F.count_if(~F.coalesce(valid_bar(), F.lit(False))).alias("dropped"), F.count(F.lit(1)).alias("bars"))


def continuity_gaps(bars: DataFrame, days: int = 5) -> DataFrame:
    """Consecutive bars of an instrument more than `days` calendar days apart."""
    before = F.lag("date").over(W.partitionBy("instrument").orderBy("date"))
    gaps = bars.select("instrument", before.alias("from_date"), F.col("date").alias("to_date"))
    return gaps.withColumn("days", F.datediff("to_date", "from_date")).where(F.col("days") > days)


def quality_issues(bars: DataFrame, instruments: DataFrame, most_zero: int = 3) -> DataFrame:
    """(instrument, issue): no bars at all, or more than `most_zero` bars without volume."""
    absent = instruments.join(bars, "instrument", "left_anti").select("instrument", F.lit("no_bars").alias("issue"))
    idle = bars.groupBy("instrument").agg(F.count_if(F.col("volume") == 0).alias("n")).where(F.col("n") > most_zero)
    return absent.unionByName(idle.select("instrument", F.lit("zero_volume").alias("issue")))


def liquidity(bars: DataFrame, rows: int = 20) -> DataFrame:
    """Mean volume of each instrument's latest bars, and that times the last close."""
    nth = F.row_number().over(W.partitionBy("instrument").orderBy(F.col("date").desc()))
    last = bars.withColumn("nth", nth).where(F.col("nth") <= rows)
    out = last.groupBy("instrument").agg(F.avg("volume").alias("adv_shares"), F.max_by("close", "date").alias("last_close"), F.count(F.lit(1)).alias("bars"))
    return out.withColumn("adv_dollars", F.col("adv_shares") * F.col("last_close"))


def dedup_last(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key in order of `sequence`: one aggregation, reduced before its shuffle."""
    others = [c for c in rows.columns if c not in keys and c not in sequence]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*sequence, *others)).alias("b"))
    return best.select(*keys, "b.*")


def vendor_quorum(vendors: DataFrame, required: int = 2, most_bps: float = 50.0) -> DataFrame:
    """One row: keys seen by any and by all vendors, the worst gap to the first vendor, and whether that passes.

    `vendors` has (vendor, instrument, date, close).
    """
    ranks = vendors.select("vendor").distinct().withColumn("nth", F.row_number().over(W.orderBy("vendor")))
    n = F.lit(ranks.count())
    rows = vendors.join(F.broadcast(ranks), "vendor").groupBy("instrument", "date").agg(F.count_distinct("vendor").alias("seen"), F.min_by("close", "nth").alias("first"), F.min("close").alias("low"), F.max("close").alias("high"))
    worst = F.greatest(bps(F.col("first"), F.col("low")), bps(F.col("first"), F.col("high")))
    out = rows.agg(F.count(F.lit(1)).alias("union_keys"), F.count_if(F.col("seen") == n).alias("overlap_keys"), F.max(F.when(F.col("seen") == n, worst)).alias("max_bps"))
    return out.withColumn("passed", (n >= required) & (F.col("overlap_keys") > 0) & (F.coalesce("max_bps", F.lit(0.0)) <= most_bps))


def bps(a: Column, b: Column) -> Column:
    """Gap in basis points of the middle; equal values 0, a middle at or below zero 10,000."""
    middle = (a + b) / 2
    return F.when(a == b, 0.0).when(middle > 0, F.abs(a - b) / middle * 1e4).otherwise(1e4)


def batch_issues(rows: DataFrame, expected: DataFrame, start, end) -> DataFrame:
    """(code, n): duplicate keys, rows outside [start, end], and expected instruments without rows."""
    dup = rows.groupBy("instrument", "date").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("duplicate"))
    out = rows.where(~F.col("date").between(start, end)).agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("out_of_range"))
    gone = expected.join(rows, "instrument", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("missing"))
    return dup.unionByName(out).unionByName(gone).select("code", "n")


def minute_issues(rows: DataFrame, at: str = "ts", key: str = "instrument") -> DataFrame:
    """(code, n) of a batch of one-minute bars: empty (1 if it has no row), off_minute (times that are no whole minute),
    gap (steps within a day other than one minute) and unknown (rows without key or time)."""
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    before = F.lag(at).over(W.partitionBy(key, F.to_date(at)).orderBy(at))
    marked = rows.select(key, at, known.alias("known"), (known & (micros % 60_000_000 != 0)).alias("off"))
    steps = rows.where(known).select((micros - F.unix_micros(before.cast("timestamp"))).alias("step"))
    got = marked.agg(F.count(F.lit(1)).alias("all"), F.count_if("off").alias("off"), F.count_if(~F.col("known")).alias("unknown"))
    gaps = steps.agg(F.count_if(F.col("step") > 60_000_000).alias("gap"))
    codes = F.array(*[F.struct(F.lit(c).alias("code"), n.cast("long").alias("n")) for c, n in (("empty", F.when(F.col("all") == 0, 1).otherwise(0)), ("off_minute", F.col("off")), ("unknown", F.col("unknown")))])
    return got.select(F.explode(codes).alias("e")).select("e.*").unionByName(gaps.select(F.lit("gap").alias("code"), F.col("gap").alias("n")))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with prices and volume adjusted for corporate actions (instrument, ex_date, kind, ratio, cash).

    Each bar folds its later actions, latest first and splits before dividends on a day: a split divides prices and
    multiplies volume (cut to whole shares each time), a dividend is taken off prices, which then stay at or above 0.01.
    Actions are few for an instrument and travel as one array.
    """
    later = F.sort_array(F.collect_list(F.struct("ex_date", (F.col("kind") == "split").cast("int").alias("split"), "ratio", "cash")), asc=False)
    named = free_name(bars, "actions")
    lists = actions.groupBy("instrument").agg(later.alias(named))
    joined = bars.join(lists, "instrument", "left")
    start = F.struct(*[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "vwap")], F.col("volume").cast("double").alias("volume"))
    prices = ("open", "high", "low", "close", "vwap")

    def step(s: Column, a: Column) -> Column:
        split = F.struct(*[(s[c] / a["ratio"]).alias(c) for c in prices], F.floor(s["volume"] * a["ratio"]).cast("double").alias("volume"))
        under = s["low"] - a["cash"] <= 0
        less = {c: s[c] - a["cash"] for c in prices}
        floor = {c: F.when(under | F.lit(c == "vwap"), F.greatest(v, F.lit(0.01))).otherwise(v) for c, v in less.items()}
        dividend = F.struct(*[floor[c].alias(c) for c in prices], s["volume"].alias("volume"))
        return F.when(a["split"] == 1, split).otherwise(dividend)

    due = F.filter(F.coalesce(named, F.array().cast(lists.schema[named].dataType)), lambda a: F.col("date") < a["ex_date"])
    adjusted, changed = free_name(bars, "adjusted"), {*prices, "volume"}
    out = joined.withColumn(adjusted, F.aggregate(due, start, step))
    return out.select(*[F.col(f"{adjusted}.{c}").alias(c) if c in changed else F.col(f"`{c}`") for c in bars.columns])


def failover(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary's rows, and the secondary's for instruments the primary has none of."""
    return primary.unionByName(secondary.join(primary.select("instrument").distinct(), "instrument", "left_anti"))
