"""Queries of data quality, joins, cross-sections, labels, evaluation and portfolios, with hand-written SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import library
from ..functions.expr import average_rank, evaluate, rounded, sql_percent_rank, sql_average_rank, sql_rounded, to_sql
from ..operators import asof, crosssection, evaluate as ev, fitting, portfolio, quality
from ..operators.settle import settled
from ..sources import tables
from ..sources.tables import BARS_SQL, bars, load

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


def out(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(v)).alias(v) for v in values])


# --- bars and data quality

register("bars_daily", f"WITH {BARS_SQL} SELECT instrument, date, sector, {', '.join(f'{R(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'vwap', 'marketcap'))} FROM bars")(
    lambda s, d: out(bars(s, d), ["instrument", "date", "sector"], ["open", "high", "low", "close", "volume", "vwap", "marketcap"])
)

register("bars_quality_drops", f"""WITH {BARS_SQL}
SELECT instrument, count(*) FILTER (WHERE NOT coalesce(least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND volume > 20, false)) AS dropped, count(*) AS bars
FROM bars GROUP BY instrument""")(
    lambda s, d: bars(s, d).groupBy("instrument").agg(F.count_if(~F.coalesce(quality.valid_bar() & (F.col("volume") > 20), F.lit(False))).alias("dropped"), F.count(F.lit(1)).alias("bars"))
)

register("bars_gap_check", f"""WITH {BARS_SQL}
SELECT * FROM (SELECT instrument, lag(date) OVER w AS from_date, date AS to_date, date_diff('day', lag(date) OVER w, date)::INT AS days
FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)) WHERE days > 5""")(lambda s, d: quality.continuity_gaps(bars(s, d)))


@register("bars_quality_issues", f"""WITH {BARS_SQL}, late AS (SELECT * FROM bars WHERE date >= DATE '2001-01-01')
SELECT s_suppkey AS instrument, 'no_bars' AS issue FROM supplier WHERE s_suppkey NOT IN (SELECT instrument FROM late WHERE instrument IS NOT NULL)
UNION ALL SELECT instrument, 'zero_volume' FROM late WHERE volume < 5 GROUP BY instrument HAVING count(*) > 3""")
def bars_quality_issues(spark, folder):
    late = bars(spark, folder).where("date >= DATE '2001-01-01'").withColumn("volume", F.when(F.col("volume") < 5, 0.0).otherwise(F.col("volume")))
    return quality.quality_issues(late, load(spark, folder, "supplier").select(F.col("s_suppkey").alias("instrument")))


@register("bars_dedup_last", """
SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, arg_max(l_extendedprice, row(l_shipdate, l_extendedprice, l_quantity)) AS l_extendedprice,
       arg_max(l_quantity, row(l_shipdate, l_extendedprice, l_quantity)) AS l_quantity FROM lineitem GROUP BY ALL""")
def bars_dedup_last(spark, folder):
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    return quality.dedup_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")


@register("liquidity_20d", f"""WITH {BARS_SQL}
SELECT instrument, {R('avg(volume)')} AS adv_shares, {R('arg_max(close, date)')} AS last_close, count(*) AS bars, {R('avg(volume) * arg_max(close, date)')} AS adv_dollars
FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 20 GROUP BY instrument""")
def liquidity_20d(spark, folder):
    return out(quality.liquidity(bars(spark, folder)), ["instrument", "bars"], ["adv_shares", "last_close", "adv_dollars"])


def _vendors(spark, folder):
    b = bars(spark, folder).select("instrument", "date", "close")
    other = b.where(F.pmod(F.col("instrument"), F.lit(3)) != 0).withColumn("close", F.col("close") * 1.001)
    return b.withColumn("vendor", F.lit("a")).unionByName(other.withColumn("vendor", F.lit("b")))


@register("vendor_quorum", f"""WITH {BARS_SQL},
v AS (SELECT instrument, date, close AS a, CASE WHEN instrument % 3 <> 0 THEN close * 1.001::DOUBLE END AS b FROM bars)
SELECT count(*) AS union_keys, count(b) AS overlap_keys, {R('max(abs(a - b) / ((a + b) / 2) * 1e4)')} AS max_bps, count(b) > 0 AND max(abs(a - b) / ((a + b) / 2) * 1e4) <= 50 AS passed FROM v""")
def vendor_quorum(spark, folder):
    return out(quality.vendor_quorum(_vendors(spark, folder)), ["union_keys", "overlap_keys", "passed"], ["max_bps"])


@register("vendor_failover", f"""WITH {BARS_SQL}
SELECT instrument, date, {R('close')} AS close FROM bars WHERE instrument % 4 <> 0 UNION ALL SELECT instrument, date, {R('close * 2')} FROM bars WHERE instrument % 4 = 0""")
def vendor_failover(spark, folder):
    b = bars(spark, folder).select("instrument", "date", "close")
    return out(quality.failover(b.where("instrument % 4 <> 0"), b.withColumn("close", F.col("close") * 2)), ["instrument", "date"], ["close"])


@register("batch_issues", """WITH b AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT 'duplicate' AS code, count(*) AS n FROM (SELECT 1 FROM b GROUP BY instrument, date HAVING count(*) > 1)
UNION ALL SELECT 'out_of_range', count(*) FROM b WHERE date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
UNION ALL SELECT 'missing', count(*) FROM customer WHERE c_custkey NOT IN (SELECT instrument FROM b)""")
def batch_issues(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("date"))
    return quality.batch_issues(rows, load(spark, folder, "customer").select(F.col("c_custkey").alias("instrument")), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))


@register("corporate_actions", f"""WITH {BARS_SQL}
SELECT instrument, date, {R("(close / 2 - 3)")} AS close, {R('floor(volume * 2)')} AS volume FROM bars WHERE date < DATE '1998-01-01' AND low / 2 - 3 > 0
UNION ALL SELECT instrument, date, {R("greatest(close / 2 - 3, 0.01)")}, {R('floor(volume * 2)')} FROM bars WHERE date < DATE '1998-01-01' AND low / 2 - 3 <= 0
UNION ALL SELECT instrument, date, {R('close / 2')}, {R('floor(volume * 2)')} FROM bars WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01'
UNION ALL SELECT instrument, date, {R('close')}, {R('volume')} FROM bars WHERE date >= DATE '1999-01-01'""")
def corporate_actions(spark, folder):
    b = bars(spark, folder)
    one = b.select("instrument").distinct()
    split = one.select("instrument", F.lit("1999-01-01").cast("date").alias("ex_date"), F.lit("split").alias("kind"), F.lit(2.0).alias("ratio"), F.lit(0.0).alias("cash"))
    paid = one.select("instrument", F.lit("1998-01-01").cast("date").alias("ex_date"), F.lit("dividend").alias("kind"), F.lit(1.0).alias("ratio"), F.lit(3.0).alias("cash"))
    return out(quality.adjust(b, split.unionByName(paid)), ["instrument", "date"], ["close", "volume"])


# --- point-in-time joins on events: a purchase and what its user did before or after

_EV = """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
v AS (SELECT user_id, ts, max(row(event_id, value)) AS r FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)"""


def _sides(spark, folder):
    e = load(spark, folder, "events")
    ends = e.agg(F.max("event_type").alias("hi"), F.min("event_type").alias("lo")).first()
    return e.where(F.col("event_type") == ends["hi"]).select("event_id", "user_id", "ts"), e.where(F.col("event_type") == ends["lo"]).select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("vid"), "value")


def _asof(op: str, direction: str):
    return f"""WITH {_EV} SELECT event_id, v.r.v1 AS match_id FROM p ASOF LEFT JOIN (SELECT user_id, ts, struct_pack(v1 := r[1]) AS r FROM v) v ON p.user_id = v.user_id AND p.ts {op} v.ts"""


for _name, _op, _kw in (("asof_backward", ">=", {}), ("asof_strict", ">", {"strict": True}), ("asof_forward", "<=", {"forward": True}), ("asof_backward_parts", ">=", {"bucket": "week"})):

    def _run(spark, folder, kw=_kw):
        left, right = _sides(spark, folder)
        got = asof.asof_join(left, right, ["user_id"], "ts", "vts", ["vid", "value"], tiebreak=["vid"], **kw)
        return got.select("event_id", F.col("match.vid").alias("match_id"))

    register(_name, _asof(_op, ""))(_run)


@register("asof_bitemporal", """
SELECT user_id, ts AS as_of, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ts + INTERVAL 2 HOUR DESC, event_id DESC) AS n FROM events
  WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-15') WHERE n = 1""")
def asof_bitemporal(spark, folder):
    e = load(spark, folder, "events").select("user_id", F.col("ts").alias("as_of"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("available_at"), "event_id")
    return asof.latest_known(e, "user_id", "as_of", "available_at", F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "as_of", "event_id")


@register("range_join_lookback", f"""WITH {_EV}
SELECT p.event_id, count(*) AS n FROM p JOIN (SELECT user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) e
ON p.user_id = e.user_id AND e.ts < p.ts AND e.ts >= p.ts - INTERVAL 2 DAY GROUP BY p.event_id""")
def range_join_lookback(spark, folder):
    left, right = _sides(spark, folder)
    return asof.range_join(left, right.drop("vid", "value"), ["user_id"], "ts", "vts", 2).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@register("grid_left_join_zero_fill", """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), users AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, date, count(event_id) AS n FROM users CROSS JOIN days LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, event_id FROM events WHERE value > 250) e USING (user_id, date) GROUP BY ALL""")
def grid_left_join_zero_fill(spark, folder):
    e = load(spark, folder, "events").select("user_id", F.to_date("ts").alias("date"), "value")
    days = e.agg(F.collect_set("date").alias("days"))
    grid = e.select("user_id").distinct().join(F.broadcast(days)).select("user_id", F.explode("days").alias("date"))
    counts = e.where("value > 250").groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["user_id", "date"], "left").select("user_id", "date", F.coalesce("n", F.lit(0)).alias("n"))


@register("panel_full_outer", """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.date, b.date) AS date, a.n AS news, b.n AS calls
FROM (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE value > 150 GROUP BY ALL) a
FULL OUTER JOIN (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL) b ON a.user_id = b.user_id AND a.date = b.date""")
def panel_full_outer(spark, folder):
    e = load(spark, folder, "events").withColumn("date", F.to_date("ts"))
    side = lambda c, n: e.where(c).groupBy("user_id", "date").agg(F.count(F.lit(1)).alias(n))
    return side("value > 150", "news").join(side("value < 20", "calls"), ["user_id", "date"], "full_outer")


@register("macro_broadcast", f"""WITH m AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS level FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
{BARS_SQL.strip()}
SELECT instrument, b.date, {R('m.level')} AS level, {R('m.level - p.level')} AS change_30d FROM (SELECT instrument, date FROM bars) b
ASOF LEFT JOIN m ON b.date >= m.date ASOF LEFT JOIN (SELECT date + INTERVAL 30 DAY AS date, level FROM m) p ON b.date >= p.date""")
def macro_broadcast(spark, folder):
    """Macro levels are joined as of on the distinct dates only, and the small result is broadcast to the panel."""
    m = load(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("mdate")).agg(F.avg("o_totalprice").alias("level"))
    panel = bars(spark, folder).select("instrument", "date")
    days = panel.select("date").distinct().withColumn("all", F.lit(1))
    now = asof.asof_join(days, m.withColumn("all", F.lit(1)), ["all"], "date", "mdate", ["level"], out="now", bucket="year")
    both = asof.asof_join(now, m.select(F.date_add("mdate", 30).alias("mdate"), "level", F.lit(1).alias("all")), ["all"], "date", "mdate", ["level"], out="then", bucket="year")
    small = both.select(F.col("date").alias("mday"), F.col("now.level").alias("level"), (F.col("now.level") - F.col("then.level")).alias("change_30d"))
    return out(panel.join(F.broadcast(small), F.col("date") == F.col("mday"), "left"), ["instrument", "date"], ["level", "change_30d"])


# --- cross-sections

def _xs(name: str, column, sql: str):
    register(name, f"WITH {BARS_SQL} SELECT instrument, date, {R(sql)} AS x FROM bars")(
        lambda s, d: out(bars(s, d).withColumn("x", column()), ["instrument", "date"], ["x"])
    )


_xs("xs_rank_pct", lambda: crosssection.percent_rank(F.col("close"), "date"), sql_percent_rank("close", "date"))
_xs("rank_norm_pm1", lambda: crosssection.rank_pm1(F.col("close"), "date"), f"CASE WHEN count(close) OVER (PARTITION BY date) > 1 THEN 2 * ({sql_average_rank('close', 'date')} - 1) / (count(close) OVER (PARTITION BY date) - 1) - 1 WHEN close IS NOT NULL THEN 0 END")
_xs("xs_zscore_winsor", lambda: crosssection.zscore(F.col("close"), "date", winsor=0.1), "0")
ORACLES["xs_zscore_winsor"] = f"""WITH {BARS_SQL}, q AS (SELECT *, quantile_cont(close, 0.1) OVER (PARTITION BY date) AS lo, quantile_cont(close, 0.9) OVER (PARTITION BY date) AS hi FROM bars),
c AS (SELECT *, least(greatest(close, lo), hi) AS v FROM q)
SELECT instrument, date, {R('(v - avg(v) OVER (PARTITION BY date)) / nullif(stddev_pop(v) OVER (PARTITION BY date), 0)')} AS x FROM c"""
_xs("xs_zscore_flat", lambda: crosssection.z_score_flat(F.col("close"), "date"), "coalesce((close - avg(close) OVER (PARTITION BY date)) / nullif(stddev_pop(close) OVER (PARTITION BY date), 0), 0)")
_xs("neutral_group_median", lambda: crosssection.neutralize_by_group(F.col("close"), F.col("sector"), "date"), "close - median(close) OVER (PARTITION BY date, coalesce(sector, '__unknown__'))")
_xs("neutral_group_mean", lambda: crosssection.neutralize_by_group(F.col("close"), F.col("sector"), "date", statistic="mean"), "close - avg(close) OVER (PARTITION BY date, coalesce(sector, '__unknown__'))")
_xs("neutral_size_ols", lambda: crosssection.neutralize_by_size(F.col("close"), F.col("marketcap"), "date"), "0")
ORACLES["neutral_size_ols"] = f"""WITH {BARS_SQL}, s AS (SELECT *, CASE WHEN marketcap > 0 THEN close END AS y, ln(marketcap) AS s FROM bars)
SELECT instrument, date, {R('CASE WHEN count(y) OVER w >= 2 THEN y - avg(y) OVER w - coalesce(covar_pop(y, s) OVER w / nullif(var_pop(s) OVER w, 0), 0) * (s - avg(s) OVER w) END')} AS x FROM s WINDOW w AS (PARTITION BY date)"""
_xs("winsorize_os", lambda: crosssection.winsorize(F.col("close"), "date"), "0")
ORACLES["winsorize_os"] = f"""WITH {BARS_SQL}, n AS (SELECT *, count(close) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY close) - 1 AS k FROM bars),
b AS (SELECT *, min(CASE WHEN k >= floor(n * 0.05::DOUBLE) THEN close END) OVER (PARTITION BY date) AS lo, max(CASE WHEN k <= ceil(n * 0.95::DOUBLE) - 1 THEN close END) OVER (PARTITION BY date) AS hi FROM n)
SELECT instrument, date, {R('least(greatest(close, lo), hi)')} AS x FROM b"""
_xs("blend", lambda: crosssection.blend({"open": 1.0, "marketcap": 2.0, "close": 1.0}), "(coalesce(open, 0) + coalesce(marketcap, 0) * 2 + coalesce(close, 0)) / 4")

# --- labels, splits, evaluation

_SIGNAL = {"signal": -library.PRICE_VOLUME["pv_low_vol"]["low_vol_21d"], "ret_21d": library.PRICE_VOLUME["pv_returns"]["ret_21d"]}


def _signal_sql(rest: str) -> str:
    """`rest` over table `sig`: bars with signal, ret_21d and forward_return."""
    exprs = _SIGNAL | {"forward_return": library.call("lead", library.CLOSE, 21) / library.CLOSE - 1}
    head = to_sql("bars", exprs, "*")
    body, select = head.rsplit("\nSELECT", 1)
    for name in exprs:
        select = select.replace(f" + {1.23456e-8}::DOUBLE, 6) AS {name}", f", 15) AS {name}")
    return f"WITH {BARS_SQL}{body}, sig AS (SELECT {select})\n{rest}"


def _signal(spark, folder):
    return ev.forward_labels(evaluate(bars(spark, folder), _SIGNAL))


_IC = f"""SELECT date, n, CASE WHEN n > 1 THEN {R('covar / nullif(sa * sb, 0)')} END AS ic FROM (
  SELECT date, count(*) AS n, covar_samp(f, l) AS covar, stddev_samp(f) AS sa, stddev_samp(l) AS sb FROM (
    SELECT date, {sql_average_rank('signal', 'date')} AS f, {sql_average_rank('forward_return', 'date')} AS l
    FROM sig WHERE signal IS NOT NULL AND forward_return IS NOT NULL) GROUP BY date)"""


@register("ic_daily_spearman", _signal_sql(_IC))
def ic_daily_spearman(spark, folder):
    return out(ev.daily_ic(_signal(spark, folder), "signal", "forward_return"), ["date", "n"], ["ic"])


@register("label_forward_log", f"""WITH {BARS_SQL}, days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars))
SELECT instrument, date, {R('ln(lead(close, 21) OVER w / nullif(close, 0))')} AS forward_log_return,
       {R('CASE WHEN lead(day) OVER w = day + 1 THEN lead(close) OVER w / nullif(close, 0) - 1 END')} AS realized_return_1d, lead(day, 21) OVER w AS label_end_index
FROM bars JOIN days USING (date) WINDOW w AS (PARTITION BY instrument ORDER BY date)""")
def label_forward_log(spark, folder):
    got = ev.forward_labels(bars(spark, folder))
    return out(got.withColumn("label_end_index", F.col("label_end_index").cast("long")), ["instrument", "date", "label_end_index"], ["forward_log_return", "realized_return_1d"])


@register("ic_decay", _signal_sql("SELECT h, " + R("avg(ic)") + " AS mean_ic, count(ic) AS days FROM (SELECT h, date, covar_samp(f, l) / nullif(stddev_samp(f) * stddev_samp(l), 0) AS ic FROM (" + " UNION ALL ".join(
    f"SELECT {h} AS h, date, {sql_average_rank('signal', 'date')} AS f, {sql_average_rank('y', 'date')} AS l FROM (SELECT *, lead(close, {h}) OVER (PARTITION BY instrument ORDER BY date) / nullif(close, 0) - 1 AS y FROM sig) WHERE signal IS NOT NULL AND y IS NOT NULL" for h in (1, 5, 21)
) + ") GROUP BY h, date) GROUP BY h"))
def ic_decay(spark, folder):
    base = _signal(spark, folder)
    w = W.partitionBy("instrument").orderBy("date")
    labels = base.withColumns({f"y{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in (1, 5, 21)})
    each = labels.select("date", F.col("signal").alias("f"), F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"y{h}").alias("l")) for h in (1, 5, 21)])).alias("e")).select("date", "f", "e.*")
    each = each.where("f IS NOT NULL AND l IS NOT NULL")
    ranked = each.select("h", "date", average_rank(F.col("f"), "h", "date").alias("f"), average_rank(F.col("l"), "h", "date").alias("l"))
    daily = ranked.groupBy("h", "date").agg(ev.safe_corr(F.col("f"), F.col("l")).alias("ic"))
    return out(daily.groupBy("h").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("days")), ["h", "days"], ["mean_ic"])


@register("turnover_rank", _signal_sql(f"""SELECT date, {R('avg(moved)')} AS turnover FROM (SELECT date, abs(r - lag(r) OVER (PARTITION BY instrument ORDER BY date)) AS moved
FROM (SELECT instrument, date, {sql_percent_rank('signal', 'date')} AS r FROM sig WHERE signal IS NOT NULL)) GROUP BY date"""))
def turnover_rank(spark, folder):
    return out(ev.rank_turnover(_signal(spark, folder), "signal"), ["date"], ["turnover"])


@register("decile_spread", _signal_sql(f"""SELECT date, {R('avg(forward_return) FILTER (WHERE t <= k) - avg(forward_return) FILTER (WHERE b <= k)')} AS spread FROM (
SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, instrument) AS t, row_number() OVER (PARTITION BY date ORDER BY signal, instrument) AS b,
       greatest(floor(count(*) OVER (PARTITION BY date) / 10), 1) AS k FROM sig WHERE signal IS NOT NULL AND forward_return IS NOT NULL) GROUP BY date"""))
def decile_spread(spark, folder):
    return out(ev.decile_spread(_signal(spark, folder), "signal", "forward_return"), ["date"], ["spread"])


@register("correlation_weights", _signal_sql(f"""SELECT feature, {R('ic')} AS ic, {R('CASE WHEN sum(greatest(ic, 0)) OVER () > 0 THEN greatest(ic, 0) / sum(greatest(ic, 0)) OVER () ELSE 1.0 / count(*) OVER () END')} AS weight FROM (
SELECT feature, coalesce(covar_samp(f, l) / nullif(stddev_samp(f) * stddev_samp(l), 0), 0) AS ic FROM (
SELECT feature, {sql_average_rank('x', 'feature')} AS f, {sql_average_rank('l', 'feature')} AS l FROM (
SELECT 'signal' AS feature, coalesce(signal, 0) AS x, forward_return AS l FROM sig WHERE forward_return IS NOT NULL UNION ALL
SELECT 'ret_21d', coalesce(ret_21d, 0), forward_return FROM sig WHERE forward_return IS NOT NULL UNION ALL
SELECT 'reversal', coalesce(-ret_21d, 0), forward_return FROM sig WHERE forward_return IS NOT NULL UNION ALL
SELECT 'calm', coalesce(-signal, 0), forward_return FROM sig WHERE forward_return IS NOT NULL)) GROUP BY feature)"""))
def correlation_weights(spark, folder):
    rows = _signal(spark, folder).withColumns({"reversal": -F.col("ret_21d"), "calm": -F.col("signal")})
    return out(ev.correlation_weights(rows, ["signal", "ret_21d", "reversal", "calm"], "forward_return"), ["feature"], ["ic", "weight"])


_STREAM = "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1"
_RET = f"ret AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS q, (level / lag(level) OVER (ORDER BY date) - 1) / 50 AS r FROM ({_STREAM}))"


def _returns(spark, folder):
    """Daily changes of the mean order value over fifty: one row a date."""
    days = load(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("level"))
    return days.select("date", ((F.col("level") / F.lag("level").over(W.orderBy("date")) - 1) / 50).alias("r")).where("r IS NOT NULL")


@register("neg_streak", f"""WITH {_RET}, i AS (SELECT date, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY r < 0 ORDER BY date) AS g, r < 0 AS bad FROM ret WHERE r IS NOT NULL)
SELECT count(*) AS length, min(date) AS first, max(date) AS last FROM i WHERE bad GROUP BY g ORDER BY count(*) DESC, min(date) LIMIT 1""")
def neg_streak(spark, folder):
    return ev.longest_negative_run(_returns(spark, folder), "r", "date")


@register("return_metrics", f"""WITH {_RET}, e AS (SELECT r, product(1 + r) OVER (ORDER BY date) AS eq, date FROM ret WHERE r IS NOT NULL), p AS (SELECT *, greatest(1, max(eq) OVER (ORDER BY date)) AS peak FROM e)
SELECT count(*) AS days, {R('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe, {R('product(1 + r) - 1')} AS compound, {R('min((eq - peak) / peak)')} AS max_drawdown FROM p""")
def return_metrics(spark, folder):
    return out(ev.return_metrics(_returns(spark, folder)), ["days"], ["sharpe", "compound", "max_drawdown"])


@register("bucket_returns", f"""WITH {_RET} SELECT bucket, {R('product(1 + r) - 1')} AS r FROM (SELECT r, (row_number() OVER (ORDER BY date) - 1) // 21 AS bucket FROM ret WHERE r IS NOT NULL) GROUP BY bucket HAVING count(*) = 21""")
def bucket_returns(spark, folder):
    return out(ev.bucket_returns(_returns(spark, folder), 21), ["bucket"], ["r"])


_FOLD_START, _FOLD_END = ev.date(1995, 1, 2), ev.date(2001, 11, 4)
_FOLDS = ev.walk_forward_folds(_FOLD_START, _FOLD_END)
_FOLD_SQL = "folds(fold, a, b, c, d) AS (VALUES " + ", ".join(f"({f.fold}, DATE '{f.train_start}', DATE '{f.train_end}', DATE '{f.test_start}', DATE '{f.test_end}')" for f in _FOLDS) + ")"


@register("fold_assign", f"""WITH {BARS_SQL}, {_FOLD_SQL}
SELECT fold, CASE WHEN date >= c THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM bars JOIN folds ON (date >= a AND date < b) OR (date >= c AND date < d) GROUP BY ALL""")
def fold_assign(spark, folder):
    return ev.assign_folds(bars(spark, folder).select("instrument", "date"), _FOLDS).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@register("purge_mask", f"""WITH {BARS_SQL}, d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) * 5 // count(*) OVER () AS fold FROM (SELECT DISTINCT date FROM bars)),
b AS (SELECT fold::INT AS fold, min(date) AS lo, max(date) AS hi FROM d GROUP BY fold)
SELECT fold, CASE WHEN date BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM bars, b
WHERE date BETWEEN lo AND hi OR date < lo - 21 OR date > hi + 26 GROUP BY ALL""")
def purge_mask(spark, folder):
    return ev.purged_kfold(bars(spark, folder).select("instrument", "date"), 5, 21, 5).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


# --- portfolios

_TOP = f"""pick AS (SELECT instrument, date, ret_21d AS score, signal AS vol, sector FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_21d DESC, instrument) AS nth FROM sig WHERE ret_21d > 0) WHERE nth <= 5)"""


def _picked(spark, folder):
    return portfolio.top_n(_signal(spark, folder).withColumns({"score": F.col("ret_21d"), "vol": F.col("signal")}), 5)


@register("weights_topn_equal", _signal_sql(f", {_TOP} SELECT instrument, date, {R('least(0.6, count(*) OVER (PARTITION BY date) * 0.15) / count(*) OVER (PARTITION BY date)')} AS weight FROM pick"))
def weights_topn_equal(spark, folder):
    return out(portfolio.equal_weights(_picked(spark, folder), 0.6, 0.15), ["instrument", "date"], ["weight"])


@register("weights_inverse_vol", _signal_sql(f""", {_TOP}, v AS (SELECT *, greatest(coalesce(vol, median(vol) OVER (PARTITION BY date), 0.005), 0.005) AS x, count(*) OVER (PARTITION BY date) AS n FROM pick)
SELECT instrument, date, {R('(0.5 / n + 0.5 * (1 / x) / sum(1 / x) OVER (PARTITION BY date)) * least(1.0, n * 0.15)')} AS weight FROM v"""))
def weights_inverse_vol(spark, folder):
    return out(portfolio.inverse_vol_weights(_picked(spark, folder), 1.0, 0.15), ["instrument", "date"], ["weight"])


@register("weights_conviction", _signal_sql(f""", {_TOP}, v AS (SELECT *, score - min(score) OVER (PARTITION BY date) AS x, count(*) OVER (PARTITION BY date) AS n FROM pick),
t AS (SELECT *, sum(x) OVER (PARTITION BY date) AS total FROM v)
SELECT instrument, date, {R('(CASE WHEN total > 0 THEN 0.25 / n + 0.75 * x / total ELSE 1.0 / n END) * least(1.0, n * 0.3)')} AS weight FROM t"""))
def weights_conviction(spark, folder):
    return out(portfolio.conviction_weights(_picked(spark, folder), 1.0, 0.3), ["instrument", "date"], ["weight"])


@register("turnover_costs", _signal_sql(f""", {_TOP}, wt AS (SELECT instrument, date, least(1.0, count(*) OVER (PARTITION BY date) * 0.15) / count(*) OVER (PARTITION BY date) AS weight FROM pick),
days AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM wt)),
was AS (SELECT nxt AS date, instrument, weight FROM wt JOIN days USING (date) WHERE nxt IS NOT NULL),
ch AS (SELECT coalesce(wt.date, was.date) AS date, coalesce(wt.weight, 0) - coalesce(was.weight, 0) AS c FROM wt FULL OUTER JOIN was ON wt.date = was.date AND wt.instrument = was.instrument)
SELECT date, {R('sum(abs(c)) * 0.001')} AS linear, {R('sum(abs(c)) * 0.001 + sum(c * c) * (0.0005 / 0.0225)')} AS quadratic FROM ch GROUP BY date"""))
def turnover_costs(spark, folder):
    moved = portfolio.trades(portfolio.equal_weights(_picked(spark, folder), 1.0, 0.15))
    got = moved.groupBy("date").agg(portfolio.linear_cost(F.col("change"), 10.0).alias("linear"), portfolio.quadratic_cost(F.col("change"), 10.0, 5.0, 0.15).alias("quadratic"))
    return out(got, ["date"], ["linear", "quadratic"])


@register("attribution_sector", _signal_sql(f""", {_TOP}, wt AS (SELECT instrument, date, sector, least(1.0, count(*) OVER (PARTITION BY date) * 0.15) / count(*) OVER (PARTITION BY date) AS weight FROM pick),
j AS (SELECT coalesce(wt.sector, 'UNMAPPED') AS sector, weight * forward_return AS pnl FROM wt JOIN sig USING (instrument, date) WHERE forward_return IS NOT NULL)
SELECT 'sector' AS level, sector AS name, {R('sum(pnl)')} AS pnl FROM j GROUP BY sector UNION ALL SELECT 'total', 'all', {R('sum(pnl)')} FROM j"""))
def attribution_sector(spark, folder):
    base = _signal(spark, folder)
    picked = portfolio.top_n(base.withColumns({"score": F.col("ret_21d")}), 5)
    weights = portfolio.equal_weights(picked, 1.0, 0.15).select("instrument", "date", "weight")
    r = base.where("forward_return IS NOT NULL").select("instrument", "date", F.col("forward_return").alias("r"))
    return out(ev.attribution(weights, r, base.select("instrument", "sector").distinct()), ["level", "name"], ["pnl"])


@register("slippage_sqrt", f"""SELECT l_orderkey, l_linenumber, l_quantity, {R('greatest(1.0, sqrt(l_quantity / 1000.0) * 20 + 2.5)')} AS slippage_bps,
{R('least(greatest(l_quantity * 100 * 0.005, 1.0), l_extendedprice / 1000 * 0.01 * 100)')} AS commission FROM lineitem""")
def slippage_sqrt(spark, folder):
    q = F.col("l_quantity")
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    got = rows.withColumns({"slippage_bps": portfolio.sqrt_slippage(q, F.lit(1000.0), F.lit(5.0)), "commission": portfolio.commission(q * 100, F.col("l_extendedprice") / q / 1000)})
    return out(got, ["l_orderkey", "l_linenumber", "l_quantity"], ["slippage_bps", "commission"])


_MIN = "SELECT user_id AS instrument, CAST(ts AS DATE) AS day, ts, event_id, value AS price, floor(value * 10) AS volume FROM events"


@register("intraday_fill_cumcap", f"""WITH b AS (SELECT *, floor(volume * 0.1) AS cap FROM ({_MIN})),
c AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY instrument, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
f AS (SELECT *, least(cap, greatest(0, 500 - before)) AS fill FROM c)
SELECT instrument, day, {R('sum(fill)')} AS filled, {R('sum(fill * price) / nullif(sum(fill), 0)')} AS fill_price FROM f GROUP BY ALL""")
def intraday_fill_cumcap(spark, folder):
    e = load(spark, folder, "events")
    b = e.select(F.col("user_id").alias("instrument"), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("price"), F.floor(F.col("value") * 10).alias("volume"))
    orders = b.select("instrument", "day").distinct().withColumn("quantity", F.lit(500))
    got = portfolio.replay_fills(orders, b).withColumn("filled", F.col("filled").cast("double"))
    return out(got, ["instrument", "day"], ["filled", "fill_price"])


@register("intraday_session", f"""SELECT user_id AS instrument, CAST(ts AS DATE) AS session_date, {R('arg_min(value, row(ts, event_id))')} AS open, {R('arg_max(value, row(ts, event_id))')} AS close, {R('max(value)')} AS high, {R('min(value)')} AS low,
{R('sum(value * value) / nullif(sum(value), 0)')} AS vwap, count(*) AS bars FROM events GROUP BY ALL""")
def intraday_session(spark, folder):
    key = F.struct("ts", "event_id")
    got = load(spark, folder, "events").groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("session_date")).agg(
        F.min_by("value", key).alias("open"), F.max_by("value", key).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.try_divide(F.sum(F.col("value") * F.col("value")), F.sum("value")).alias("vwap"), F.count(F.lit(1)).alias("bars"),
    )
    return out(got, ["instrument", "session_date", "bars"], ["open", "close", "high", "low", "vwap"])


@register("reconcile_full_outer", """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_broker' WHEN b.k IS NULL THEN 'missing_internal' WHEN abs(a.v - b.v) <= 1000 THEN 'auto_correct' ELSE 'mismatch' END AS kind
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def reconcile_full_outer(spark, folder):
    """Prices are summed as decimals, so that equal books have equal sums in whatever order tasks add them up."""
    o = load(spark, folder, "orders")
    price = F.col("o_totalprice").cast("decimal(28,8)")
    side = lambda m, v: o.where(F.col("o_orderkey") % m != 0).groupBy(F.col("o_custkey").alias("k")).agg(F.sum(price).alias(v))
    both = side(3, "a").join(side(5, "b"), "k", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "missing_broker").when(F.col("b").isNull(), "missing_internal").when(F.abs(F.col("a") - F.col("b")) <= 1000, "auto_correct").otherwise("mismatch")
    return both.select("k", kind.alias("kind"))


@register("calibration_report", f"""SELECT o_orderpriority AS bucket, count(*) AS n, {R('median(x)')} AS median_bps, {R('quantile_cont(x, 0.9)')} AS p90_bps, {R('greatest(2.0, median(x), quantile_cont(x, 0.9) * 1.1)')} AS recommended_bps
FROM (SELECT o_orderpriority, greatest(0, o_totalprice / 1000 - 100) AS x FROM orders) GROUP BY 1""")
def calibration_report(spark, folder):
    x = F.greatest(F.lit(0.0), F.col("o_totalprice") / 1000 - 100)
    got = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.median(x).alias("median_bps"), F.percentile(x, F.lit(0.9)).alias("p90_bps"))
    return out(got.withColumn("recommended_bps", F.greatest(F.lit(2.0), "median_bps", F.col("p90_bps") * 1.1)), ["bucket", "n"], ["median_bps", "p90_bps", "recommended_bps"])


@register("average_slippage_recent", f"""SELECT {R('avg(d)')} AS avg_bps FROM (SELECT l_discount * 100 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_discount DESC LIMIT 1000)""")
def average_slippage_recent(spark, folder):
    rows = load(spark, folder, "lineitem").join(load(spark, folder, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    last = rows.orderBy(*[F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_discount")]).limit(1000)
    return last.agg(rounded(F.avg(F.col("l_discount") * 100)).alias("avg_bps"))


# --- maps, arrays, text

@register("json_props_map", """SELECT event_type, k AS key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def json_props_map(spark, folder):
    rows = load(spark, folder, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


@register("feature_map_all_finite", """SELECT event_type, count(*) FILTER (WHERE value IS NOT NULL AND isfinite(ln(value))) AS good, count(*) AS n FROM events GROUP BY 1""")
def feature_map_all_finite(spark, folder):
    m = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.ln("value"))
    ok = F.forall(F.map_values(m), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return load(spark, folder, "events").groupBy("event_type").agg(F.count_if(ok).alias("good"), F.count(F.lit(1)).alias("n"))


_Z = "((close - avg(close) OVER ()) / stddev_pop(close) OVER ())", "((volume - avg(volume) OVER ()) / stddev_pop(volume) OVER ())"
_SIGN = "CASE WHEN corr(close, volume) OVER () >= 0 THEN 1 ELSE -1 END"


@register("pca_apply", f"""WITH {BARS_SQL} SELECT instrument, date, {R(f'({_Z[0]} + {_SIGN} * {_Z[1]}) / sqrt(2)')} AS pc1, {R(f'({_Z[0]} - {_SIGN} * {_Z[1]}) / sqrt(2)')} AS pc2 FROM bars""")
def pca_apply(spark, folder):
    """Components of two features, as fitted; of two standardised ones they are known in closed form."""
    rows = bars(spark, folder)
    model = fitting.fit_components(rows, ["close", "volume"], 2)
    return out(rows.select("instrument", "date", *[c.alias(n) for n, c in model.columns().items()]), ["instrument", "date"], ["pc1", "pc2"])


_MONTHS = ", months AS (SELECT instrument, CAST(date_trunc('month', date) AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close FROM bars GROUP BY ALL)"
_MONTHLY = {"close_in_range": library.MICROSTRUCTURE["ms_spread"]["close_in_range"]}


@register("ms_close_in_range_monthly", f"WITH {BARS_SQL}{_MONTHS}" + to_sql("months", _MONTHLY, "instrument, date"))
def ms_close_in_range_monthly(spark, folder):
    """Over monthly bars, whose high and low differ more often than those of a day."""
    months = bars(spark, folder).groupBy("instrument", F.to_date(F.date_trunc("month", "date")).alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close")
    )
    return out(evaluate(months, _MONTHLY), ["instrument", "date"], ["close_in_range"])


_TEXT = """t AS (SELECT source, lang, doc_id % 30 AS day, (toxic - quality)::DOUBLE AS s, (1 + n_chars % 7) / 7.0::DOUBLE AS m FROM documents JOIN labels USING (doc_id))"""


def _scored(spark, folder):
    d = load(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars").join(load(spark, folder, "labels"), "doc_id")
    return d.select("source", "lang", (F.col("doc_id") % 30).alias("day"), (F.col("toxic") - F.col("quality")).cast("double").alias("s"), ((1 + F.col("n_chars") % 7) / F.lit(7.0)).alias("m"))


@register("news_panel", f"""WITH {_TEXT} SELECT source, day, count(*) AS n, {R('sum(s * m) / nullif(sum(m), 0)')} AS sentiment, {R('sqrt(greatest(0, avg(s * s) - avg(s) * avg(s)))')} AS dispersion,
count(*) FILTER (WHERE s >= 0.3) AS positive, count(*) FILTER (WHERE s <= -0.3) AS negative, {R('avg(m)')} AS materiality FROM t GROUP BY ALL""")
def news_panel(spark, folder):
    s, m = F.col("s"), F.col("m")
    got = _scored(spark, folder).groupBy("source", "day").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(s * m), F.sum(m)).alias("sentiment"), F.sqrt(F.greatest(F.lit(0.0), F.avg(s * s) - F.avg(s) * F.avg(s))).alias("dispersion"),
        F.count_if(s >= 0.3).alias("positive"), F.count_if(s <= -0.3).alias("negative"), F.avg(m).alias("materiality"),
    )
    return out(got, ["source", "day", "n", "positive", "negative"], ["sentiment", "dispersion", "materiality"])


@register("filing_panel", f"""WITH {_TEXT}, g AS (SELECT lang, day, avg(s) AS tone, avg(m) AS risk, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, day, {R('tone')} AS tone, {R('risk')} AS risk, n, {R('tone - lag(tone) OVER (PARTITION BY lang ORDER BY day)')} AS tone_change FROM g""")
def filing_panel(spark, folder):
    got = _scored(spark, folder).groupBy("lang", "day").agg(F.avg("s").alias("tone"), F.avg("m").alias("risk"), F.count(F.lit(1)).alias("n"))
    got = got.withColumn("tone_change", F.col("tone") - F.lag("tone").over(W.partitionBy("lang").orderBy("day")))
    return out(got, ["lang", "day", "n"], ["tone", "risk", "tone_change"])


@register("decayed_text_agg", f"""WITH {_TEXT}, p AS (SELECT source, day, avg(s) AS s FROM t GROUP BY ALL)
SELECT a.source, a.day, count(*) AS events, {R('sum(b.s * (1 - (a.day - b.day) / 10.0)) / sum(1 - (a.day - b.day) / 10.0)')} AS decayed FROM p a JOIN p b ON a.source = b.source AND b.day <= a.day AND b.day > a.day - 10 GROUP BY ALL""")
def decayed_text_agg(spark, folder):
    """Age-weighted means by a bounded range join: the lookback is unrolled into at most ten later days a row."""
    p = _scored(spark, folder).groupBy("source", "day").agg(F.avg("s").alias("s"))
    later = p.select("source", F.col("s"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("day") + k)).alias("age", "day"))
    joined = later.join(p.select("source", "day"), ["source", "day"])
    weight = 1 - F.col("age") / 10
    return out(joined.groupBy("source", "day").agg(F.count(F.lit(1)).alias("events"), (F.sum(F.col("s") * weight) / F.sum(weight)).alias("decayed")), ["source", "day", "events"], ["decayed"])


# --- rows only: path-dependent

@register("portfolio_path")
def portfolio_path(spark, folder):
    known = settled(_signal(spark, folder).where("ret_21d IS NOT NULL").select("date", "instrument", "ret_21d", "realized_return_1d"))
    rows = known.select(F.explode(F.array(F.lit("momentum"), F.lit("reversal"))).alias("arm"), "date", "instrument", "ret_21d", "realized_return_1d")
    score = F.when(F.col("arm") == "momentum", F.col("ret_21d")).otherwise(-F.col("ret_21d"))
    return portfolio.day_loop(rows.select("arm", "date", "instrument", score.alias("score"), F.col("realized_return_1d").alias("r")))
