"""Supervised samples: features, labels and their times in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join


def supervised_samples(
    grid: DataFrame, vectors: DataFrame, closes: DataFrame, features: list[str], horizon_days: int = 21, max_age_days: int = 3
) -> DataFrame:
    """`grid(instrument, as_of)` with status, the features and forward_return.

    The latest vector(instrument, known_at, …) at or before as_of must not be older than `max_age_days`; its features
    must be finite. The return is from the last close(instrument, at, close) at or before as_of to the first at or
    after as_of + `horizon_days`. status is ok, missing_features, stale_features, invalid_features or missing_bars, in
    this order of precedence; only samples that are ok have features and a return.
    """
    got = asof_join(grid, vectors, ["instrument"], "as_of", "known_at", features, out="vector")
    bars = closes.select("instrument", "at", F.when(F.col("close") > 0, F.col("close")).alias("close"))
    got = asof_join(got, bars, ["instrument"], "as_of", "at", ["close"], out="entry")
    got = got.withColumn("_exit_from", F.date_add("as_of", horizon_days))
    got = asof_join(got, bars, ["instrument"], "_exit_from", "at", ["close"], out="exit", forward=True)
    values = [F.col(f"vector.{f}") for f in features]
    broken = F.lit(False)
    for v in values:
        broken = broken | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    status = (
        F.when(F.col("vector.at").isNull(), "missing_features")
        .when(F.col("vector.at") < F.date_sub("as_of", max_age_days), "stale_features")
        .when(broken, "invalid_features")
        .when(F.col("entry.close").isNull() | F.col("exit.close").isNull(), "missing_bars")
        .otherwise("ok")
    )
    got = got.withColumn("status", status)
    ok = F.col("status") == "ok"
    return got.select(
        "instrument", "as_of", "status", *[F.when(ok, v).alias(f) for f, v in zip(features, values, strict=True)], F.when(ok, F.col("exit.close") / F.col("entry.close") - 1).alias("forward_return")
    )


def split_samples(samples: DataFrame, validation_fraction: float, purge_days: int, on: str = "as_of") -> DataFrame:
    """`samples` with part: the last share of dates validates, what ends `purge_days` before trains, the rest goes."""
    days = samples.select(on).distinct()
    back = max(1, -int(-days.count() * validation_fraction // 1))
    last = days.orderBy(F.col(on).desc()).limit(back).agg(F.min(on)).first()[0]
    valid, train = F.col(on) >= F.lit(last), F.col(on) < F.date_sub(F.lit(last), purge_days)
    return samples.where(valid | train).select(*samples.columns, F.when(valid, "validation").otherwise("train").alias("part"))


def in_window(samples: DataFrame, start, end, on: str = "as_of") -> DataFrame:
    """Samples within a closed window; a bound of None is open."""
    out = samples
    if start is not None:
        out = out.where(F.col(on) >= start)
    return out if end is None else out.where(F.col(on) <= end)


def latest_statements(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Statements(ticker, datekey, lastupdated, …) by instrument: unknown tickers and missing dates go, of several
    of an instrument and date the last updated stays (a missing time counts as earliest)."""
    named = rows.where("datekey IS NOT NULL").join(F.broadcast(tickers), "ticker")
    values = [c for c in named.columns if c not in ("instrument", "datekey")]
    newest = F.max_by(F.struct(*values), F.struct(F.coalesce(F.col("lastupdated").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), F.xxhash64(*values)))
    return named.groupBy("instrument", "datekey").agg(newest.alias("_row")).select("instrument", "datekey", "_row.*")


def statements_on_dates(dates: DataFrame, statements: DataFrame, values: list[str], lag_days: int = 45, known: str = "datekey", max_age_days: int | None = 400) -> DataFrame:
    """`dates(instrument, date)` with the values of the latest statement that was known by then, and statement_date.

    A statement is known `lag_days` after its date. One that is older than `max_age_days` says nothing any more.
    """
    told = statements.select("instrument", F.date_add(known, lag_days).alias("known_at"), F.col(known).alias("statement_date"), *values)
    got = asof_join(dates, told, ["instrument"], "date", "known_at", ["statement_date", *values], out="held")
    fresh = F.col("held.at").isNotNull()
    if max_age_days is not None:
        fresh = fresh & (F.datediff("date", F.col("held.statement_date")) <= max_age_days)
    return got.select(*dates.columns, *[F.when(fresh, F.col(f"held.{c}")).alias(c) for c in ("statement_date", *values)])


def decayed_mean(asked: DataFrame, history: DataFrame, value: str, lookback_days: int, signed_by: str | None = None) -> DataFrame:
    """`asked(instrument, as_of)` with mean: history(instrument, at, …) of the last days, weighted linearly down to 0.

    With `signed_by`, a value counts negatively where that column is below 0. The range join meets only rows of one
    instrument whose days fall in neighbouring stretches of `lookback_days`.
    """
    day = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400.0 * lookback_days))
    left = asked.withColumn("_cell", F.explode(F.array(day("as_of"), day("as_of") - 1)))
    sign = F.when(F.col(signed_by) >= 0, 1.0).otherwise(-1.0) if signed_by else F.lit(1.0)
    right = history.select(F.col("instrument").alias("_i"), F.col("at").alias("_at"), (F.col(value) * sign).alias("_v")).withColumn("_at_cell", day("_at"))
    age = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))) / (86400.0 * 1e6)
    met = left.join(right, (F.col("instrument") == F.col("_i")) & (F.col("_cell") == F.col("_at_cell"))).withColumn("_w", 1 - age / lookback_days)
    met = met.where((age >= 0) & (F.col("_w") > 0))
    means = met.groupBy("instrument", "as_of").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("mean"))
    return asked.join(means, ["instrument", "as_of"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
