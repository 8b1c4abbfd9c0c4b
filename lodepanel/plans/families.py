"""Queries of the estimate, ownership and option features, market regimes, event streams and document text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import rounded, sql_rounded
from ..operators import asof, regime
from ..operators.settle import shared_folder
from ..sources.store import document_text
from ..sources.tables import BARS_SQL, bars, load
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = sql_rounded


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_SNAPSHOTS = """s AS (
  SELECT o_custkey % 40 AS instrument, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, count(*) AS coverage,
         count(*) FILTER (WHERE o_orderpriority < '3') AS up, count(*) FILTER (WHERE o_orderpriority >= '5') AS down
  FROM orders GROUP BY ALL)"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Consensus snapshots from orders; unique by (instrument, date)."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    rows = load(spark, folder, "orders").groupBy((F.col("o_custkey") % 40).alias("instrument"), F.to_date("o_orderdate").alias("date"))
    return rows.agg(F.avg(price).alias("mean"), F.stddev_samp(price).alias("sd"), F.count(F.lit(1)).alias("coverage"), F.count_if(priority < "3").alias("up"), F.count_if(priority >= "5").alias("down"))


@register("estimates_revision", f"""WITH {_SNAPSHOTS}
SELECT s.instrument, s.date, coverage, {R('(s.mean - b.mean) / nullif(abs(b.mean), 0)')} AS revision_90d, {R('sd / nullif(abs(s.mean), 0)')} AS dispersion,
       {R('(up - down) / nullif(up + down, 0)')} AS up_vs_down
FROM s ASOF LEFT JOIN (SELECT instrument, date + 90 AS date, mean FROM s) b ON s.instrument = b.instrument AND s.date >= b.date""")
def estimates_revision(spark, folder):
    """Revisions against the snapshot known 90 calendar days before, by an as-of join with a shifted date."""
    now = snapshots(spark, folder)
    then = now.select("instrument", F.date_add("date", 90).alias("date"), F.col("mean").alias("before"))
    got = asof.asof_join(now, then, ["instrument"], "date", "date", ["before"])
    before = F.col("match.before")
    return got.select(
        "instrument", "date", "coverage",
        rounded(F.try_divide(F.col("mean") - before, F.abs(before))).alias("revision_90d"),
        rounded(F.try_divide(F.col("sd"), F.abs("mean"))).alias("dispersion"),
        rounded(F.try_divide(F.col("up") - F.col("down"), F.col("up") + F.col("down"))).alias("up_vs_down"),
    )


@register("ownership_features", f"""WITH h AS (
  SELECT l_suppkey AS instrument, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, o_custkey AS filer, sum(l_quantity) AS shares
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT instrument, period, sum(shares) AS shares, count(*) AS holder_count FROM h GROUP BY ALL),
p AS (SELECT *, least(1, greatest(0, shares / 2000)) AS pct FROM q)
SELECT instrument, CAST(period + INTERVAL 3 MONTH + INTERVAL 45 DAY AS DATE) AS available, holder_count, {R('pct')} AS institutional_pct,
       {R('pct - lag(pct) OVER (PARTITION BY instrument ORDER BY period)')} AS pct_change FROM p""")
def ownership_features(spark, folder):
    """Holdings by filer and quarter, their share of 2,000 shares outstanding, available 45 days after the quarter."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"))
    held = lines.join(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = held.groupBy(F.col("l_suppkey").alias("instrument"), "period", "o_custkey").agg(F.sum("l_quantity").alias("shares"))
    rows = held.groupBy("instrument", "period").agg(F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("holder_count"))
    rows = rows.withColumn("pct", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("shares") / 2000)))
    change = F.col("pct") - F.lag("pct").over(W.partitionBy("instrument").orderBy("period"))
    return rows.select("instrument", F.date_add(F.add_months("period", 3), 45).alias("available"), "holder_count", rounded(F.col("pct")).alias("institutional_pct"), rounded(change).alias("pct_change"))


@register("options_features", f"""WITH o AS (
  SELECT user_id AS instrument, CAST(ts AS DATE) AS date, avg(value) FILTER (WHERE event_type = 'view') AS iv_30d, avg(value) FILTER (WHERE event_type = 'purchase') AS iv_60d,
         count(*) FILTER (WHERE event_type = 'click') AS puts, count(*) FILTER (WHERE event_type = 'view') AS calls, stddev_samp(value) AS realised
  FROM events GROUP BY ALL)
SELECT instrument, date, {R('iv_30d')} AS iv_level, {R('iv_60d - iv_30d')} AS term_slope, {R('puts / nullif(calls, 0)')} AS put_call_ratio, {R('iv_30d - realised')} AS premium FROM o""")
def options_features(spark, folder):
    """Level, slope, put-call ratio and premium over realised volatility, from daily snapshots made of events."""
    kind, value = F.col("event_type"), F.col("value")
    rows = load(spark, folder, "events").groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("date"))
    rows = rows.agg(
        F.avg(F.when(kind == "view", value)).alias("iv_30d"), F.avg(F.when(kind == "purchase", value)).alias("iv_60d"),
        F.count_if(kind == "click").alias("puts"), F.count_if(kind == "view").alias("calls"), F.stddev_samp(value).alias("realised"),
    )
    values = {"iv_level": F.col("iv_30d"), "term_slope": F.col("iv_60d") - F.col("iv_30d"), "put_call_ratio": F.try_divide("puts", "calls"), "premium": F.col("iv_30d") - F.col("realised")}
    return rows.select("instrument", "date", *[rounded(c).alias(n) for n, c in values.items()])


@register("market_stats", f"""WITH {BARS_SQL}, r AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN count(close) OVER t = 20 THEN avg(close) OVER t END AS m
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date), t AS (PARTITION BY instrument ORDER BY date ROWS 19 PRECEDING)),
d AS (SELECT date, avg(r) AS r, avg((close > m)::INT::DOUBLE) AS breadth FROM r GROUP BY date)
SELECT date, {R('CASE WHEN count(r) OVER l = 20 THEN avg(r) OVER l * 20 ELSE 0 END')} AS trend,
       {R('CASE WHEN count(r) OVER l = 20 THEN stddev_samp(r) OVER l * sqrt(252) ELSE 0.2 END')} AS vol, {R('coalesce(breadth, 0.5)')} AS breadth
FROM d WINDOW l AS (ORDER BY date ROWS 19 PRECEDING)""")
def market_stats(spark, folder):
    got = regime.market_stats(bars(spark, folder))
    return got.select("date", *[rounded(F.col(c)).alias(c) for c in ("trend", "vol", "breadth")])


@register("regime_state_machine", f"""{ORACLES['market_stats'].split('SELECT date, round')[0]},
s AS (SELECT date, CASE WHEN count(r) OVER l = 20 THEN avg(r) OVER l * 20 ELSE 0 END AS trend, CASE WHEN count(r) OVER l = 20 THEN stddev_samp(r) OVER l * sqrt(252) ELSE 0.2 END AS vol, coalesce(breadth, 0.5) AS breadth
      FROM d WINDOW l AS (ORDER BY date ROWS 19 PRECEDING)),
c AS (SELECT date, CASE WHEN vol > 15 THEN 'stress' WHEN trend > 0.02 AND breadth > 0.5 THEN 'up' WHEN trend < -0.02 AND breadth < 0.5 THEN 'down' ELSE 'flat' END AS candidate FROM s),
i AS (SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY candidate ORDER BY date) AS g FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY candidate, g ORDER BY date) AS run FROM i)
SELECT 'all' AS series, date, candidate, coalesce(last_value(CASE WHEN run >= 3 THEN candidate END IGNORE NULLS) OVER (ORDER BY date), first_value(candidate) OVER (ORDER BY date)) AS stable FROM k""")
def regime_state_machine(spark, folder):
    """The stable market label of each date; a row a date, one series."""
    stats = regime.market_stats(bars(spark, folder))
    label = regime.candidate(F.col("trend"), F.col("vol"), F.col("breadth"), high_vol=15.0)
    return regime.stable_labels(stats.select(F.lit("all").alias("series"), "date", label.alias("candidate")))


@register("relevance_labels", f"""WITH {BARS_SQL}, f AS (SELECT instrument, date, lead(close, 5) OVER (PARTITION BY instrument ORDER BY date) / nullif(close, 0) - 1 AS r FROM bars)
SELECT instrument, date, (dense_rank() OVER (PARTITION BY date ORDER BY r))::INT - 1 AS relevance FROM f WHERE r IS NOT NULL""")
def relevance_labels(spark, folder):
    """Dense rank from 0 of the five-row forward return within each date."""
    ahead = F.try_divide(F.lead("close", 5).over(W.partitionBy("instrument").orderBy("date")), "close") - 1
    rows = bars(spark, folder).select("instrument", "date", ahead.alias("r")).where("r IS NOT NULL")
    return rows.select("instrument", "date", (F.dense_rank().over(W.partitionBy("date").orderBy("r")) - 1).alias("relevance"))


@register("html_clean")
def html_clean(spark, folder):
    """Plain text of every page, text nodes of scripts and styles included."""
    return load(spark, folder, "pages").select("page_id", document_text("html").alias("text"))


@register("events_once", "SELECT DISTINCT event_id, ts, user_id, event_type, value FROM events")
def events_once(spark, folder):
    """The events read as a stream of files, each id once however far apart it repeats."""
    top = shared_folder(spark, "events-once")
    stream = ev.once(ev.event_files(spark, folder), None).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    return ev.drain(stream, f"{top}/out", f"{top}/state")


def _batch_events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("events_tumbling", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n_events, {R('sum(value)')} AS value FROM events GROUP BY ALL""")
def events_tumbling(spark, folder):
    """An extension: daily event-time windows."""
    got = ev.tumbling(_batch_events(spark, folder))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n_events", rounded(F.col("value")).alias("value"))


@register("events_sessions", f"""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 1 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n_events, {R('sum(value)')} AS value FROM s GROUP BY user_id, k""")
def events_sessions(spark, folder):
    """An extension: session windows by user."""
    got = ev.sessions(_batch_events(spark, folder), "1 day")
    return got.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n_events", rounded(F.col("value")).alias("value"))
