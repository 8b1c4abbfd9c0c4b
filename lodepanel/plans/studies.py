"""Queries of samples, gates, risk and fitted models, with hand-written SQL twins where SQL can follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import rounded, sql_average_rank, sql_percent_rank, sql_rounded
from ..operators import audit, crosssection, evaluate as ev, fitting, quality, risk, samples, universe
from ..operators.settle import settled
from ..sources.tables import BARS_SQL, bars, load
from .analytics import _signal, _signal_sql, out

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


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """The signal panel, written once: the gates look at it several times."""
    return settled(_signal(spark, folder).select("instrument", "date", "close", "sector", "marketcap", "signal", "ret_21d", "forward_return"))


def _corr(f: str, l: str) -> str:
    return f"covar_samp({f}, {l}) / nullif(stddev_samp({f}) * stddev_samp({l}), 0)"


def _ics(name: str = "ics", f: str = "signal", source: str = "sig", least: int = 2) -> str:
    return f"""{name} AS (SELECT date, count(*) AS n, coalesce({_corr('f', 'l')}, 0) AS ic FROM (
  SELECT date, {sql_average_rank(f, 'date')} AS f, {sql_average_rank('forward_return', 'date')} AS l
  FROM {source} WHERE {f} IS NOT NULL AND forward_return IS NOT NULL) GROUP BY date HAVING count(*) >= {least})"""


_STREAK = """streak AS (SELECT coalesce(max(k), 0) AS negative_streak FROM (SELECT count(*) AS k FROM (
  SELECT ic, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY ic < 0 ORDER BY date) AS g FROM ics) WHERE ic < 0 GROUP BY g))"""
_SUMMARY = f"""{_STREAK}, summary AS (SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS observations,
  CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) WHEN avg(ic) > 0 THEN 999.0 ELSE 0.0 END AS icir, (SELECT negative_streak FROM streak)::BIGINT AS negative_streak FROM ics)"""


@register("ic_summary", _signal_sql(f", {_ics()}, {_SUMMARY} SELECT {R('ic_mean')} AS ic_mean, {R('ic_std')} AS ic_std, {R('icir')} AS icir, negative_streak, observations FROM summary"))
def ic_summary(spark, folder):
    return out(audit.ic_summary(audit.ic_series(signal(spark, folder), "signal", "forward_return")), ["negative_streak", "observations"], ["ic_mean", "ic_std", "icir"])


@register("ic_monthly", _signal_sql(f", {_ics()} SELECT CAST(date_trunc('month', date) AS DATE) AS month, {R('avg(ic)')} AS ic, count(*) AS days FROM ics GROUP BY 1"))
def ic_monthly(spark, folder):
    return out(audit.monthly_ic(audit.ic_series(signal(spark, folder), "signal", "forward_return")), ["month", "days"], ["ic"])


def _uniform(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


_BOOT = f"""drawn AS (SELECT b, ic, {' + '.join(f'(u > {p}::DOUBLE)::INT' for p in audit.POISSON)} AS w FROM (
  SELECT b, ic, {_uniform('0', 'b', 'date')} AS u FROM ics, (SELECT unnest(range(1, 201)) AS b))),
boot AS (SELECT quantile_cont(m, 0.05) AS ci_low, quantile_cont(m, 0.95) AS ci_high FROM (SELECT b, sum(w * ic) / nullif(sum(w), 0) AS m FROM drawn GROUP BY b))"""


@register("ic_bootstrap", _signal_sql(f", {_ics()}, {_BOOT} SELECT {R('(SELECT avg(ic) FROM ics)')} AS mean, {R('ci_low')} AS ci_low, {R('ci_high')} AS ci_high FROM boot"))
def ic_bootstrap(spark, folder):
    ics = settled(audit.ic_series(signal(spark, folder), "signal", "forward_return"))
    return out(audit.bootstrap_mean(ics, "ic", "date", samples=200), [], ["mean", "ci_low", "ci_high"])


@register("gate_stability", _signal_sql(f""", {_ics()}, {_SUMMARY}, {_BOOT}
SELECT {R('ic_mean')} AS ic_mean, {R('ic_std')} AS ic_std, {R('icir')} AS icir, negative_streak, observations, {R('ci_low')} AS ci_low, {R('ci_high')} AS ci_high,
       ic_mean >= 0.01 AND icir >= 0.05 AND negative_streak <= 60 AS passed FROM summary, boot"""))
def gate_stability(spark, folder):
    got = audit.stability_gate(audit.ic_series(signal(spark, folder), "signal", "forward_return"))
    return out(got, ["negative_streak", "observations", "passed"], ["ic_mean", "ic_std", "icir", "ci_low", "ci_high"])


@register("gate_noise", _signal_sql(f""", v AS (SELECT signal AS x FROM sig WHERE signal IS NOT NULL),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS n FROM v),
clip AS (SELECT max(n) AS n, min(CASE WHEN k >= floor(0.05::DOUBLE * (n - 1)) THEN x END) AS lo, min(CASE WHEN k >= floor(0.95::DOUBLE * (n - 1)) THEN x END) AS hi FROM o),
winsor AS (SELECT CASE WHEN max(n) < 20 THEN 0 ELSE avg(abs(x - greatest(lo, least(hi, x)))) / coalesce(nullif(avg(abs(x)), 0), 1) END AS winsor_impact FROM v, clip),
daily AS (SELECT date, count(*) AS all_rows, count(signal) AS n, stddev_samp(signal) AS sd, count(DISTINCT round(signal, 12)) AS d, avg(signal) AS m, min(signal) AS low, max(signal) AS high,
          count(*) FILTER (WHERE abs(signal) < 1e-12) AS zeros FROM sig GROUP BY date),
auto AS (SELECT CASE WHEN count(m) < 3 THEN 0 ELSE coalesce({_corr('CASE WHEN p IS NOT NULL THEN m END', 'p')}, 0) END AS lag1_autocorr FROM (SELECT m, lag(m) OVER (ORDER BY date) AS p FROM daily WHERE n > 0)),
g AS (SELECT sum(n) / sum(all_rows) AS coverage, avg(sd) FILTER (WHERE n >= 2) AS dispersion, avg(d / n) FILTER (WHERE n >= 2) AS daily_unique_ratio, sum(zeros) / sum(n) AS zero_fraction,
      coalesce(min(low) >= -1.000001 AND max(high) <= 1.000001 AND max(high) - min(low) >= 1e-4 AND avg(d / n) FILTER (WHERE n >= 2) >= 0.05, false) AS rank_normalized FROM daily),
u AS (SELECT count(DISTINCT round(x, 12)) / count(*) AS unique_ratio FROM v)
SELECT {', '.join(f'{R(c)} AS {c}' for c in ('coverage', 'dispersion', 'daily_unique_ratio', 'zero_fraction', 'unique_ratio', 'winsor_impact', 'lag1_autocorr'))}, rank_normalized,
       coverage >= 0.8 AND dispersion >= 1e-4 AND CASE WHEN rank_normalized THEN daily_unique_ratio ELSE unique_ratio END >= 0.05 AND zero_fraction <= 0.8 AS passed FROM g, u, winsor, auto"""))
def gate_noise(spark, folder):
    got = audit.noise_gate(signal(spark, folder), "signal")
    return out(got, ["rank_normalized", "passed"], ["coverage", "dispersion", "daily_unique_ratio", "zero_fraction", "unique_ratio", "winsor_impact", "lag1_autocorr"])


def _permuted(seeds: int) -> str:
    return f"""pr AS (SELECT instrument, date, f, l, row_number() OVER (PARTITION BY date ORDER BY instrument) AS place FROM (
  SELECT instrument, date, {sql_average_rank('signal', 'date')} AS f, {sql_average_rank('forward_return', 'date')} AS l, count(*) OVER (PARTITION BY date) AS size
  FROM sig WHERE signal IS NOT NULL AND forward_return IS NOT NULL) WHERE size >= 3),
dealt AS (SELECT seed, date, l, row_number() OVER (PARTITION BY seed, date ORDER BY md5(concat_ws(':', seed, date, instrument)), instrument) AS place FROM pr, (SELECT unnest(range({seeds})) AS seed)),
perm AS (SELECT seed, avg(ic) AS ic FROM (SELECT seed, date, coalesce({_corr('f', 'd.l')}, 0) AS ic FROM dealt d JOIN pr USING (date, place) GROUP BY seed, date) GROUP BY seed)"""


@register("ic_null_baseline", _signal_sql(f""", {_ics()}, {_permuted(40)}, a AS (SELECT avg(ic) AS actual FROM ics)
SELECT {R('max(actual)')} AS actual_ic, {R('avg(ic)')} AS null_mean, {R('quantile_cont(ic, 0.05)')} AS null_p05, {R('quantile_cont(ic, 0.95)')} AS null_p95,
       {R('(count(*) FILTER (WHERE ic >= actual) + 1) / (count(*) + 1)')} AS p_value FROM perm, a"""))
def ic_null_baseline(spark, folder):
    return out(audit.null_baseline(signal(spark, folder), "signal", "forward_return", seeds=40), [], ["actual_ic", "null_mean", "null_p05", "null_p95", "p_value"])


@register("gate_leakage", _signal_sql(f""", {_ics()}, {_permuted(1)},
before AS (SELECT date, forward_return, lag(signal) OVER (PARTITION BY instrument ORDER BY date) AS prior FROM sig WHERE signal IS NOT NULL AND forward_return IS NOT NULL),
{_ics('lagged', 'prior', 'before')},
g AS (SELECT abs(avg(ic)) AS abs_ic, (SELECT coalesce(avg(ic), 0) FROM lagged) AS lagged_ic, (SELECT max(ic) FROM perm) AS permuted_ic,
      (SELECT count(DISTINCT date) FROM before) AS daily_groups FROM ics)
SELECT {R('abs_ic')} AS abs_ic, {R('lagged_ic')} AS lagged_ic, {R('permuted_ic')} AS permuted_ic, daily_groups, daily_groups >= 20 AND abs_ic <= 0.3
       AND NOT (abs_ic >= 0.01 AND abs(lagged_ic) < abs_ic * 0.2::DOUBLE) AND NOT (abs_ic >= 0.01 AND abs(permuted_ic) >= abs_ic) AS passed FROM g"""))
def gate_leakage(spark, folder):
    return out(audit.leakage_gate(signal(spark, folder), "signal", "forward_return"), ["daily_groups", "passed"], ["abs_ic", "lagged_ic", "permuted_ic"])


_WEIGHTED = """days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM sig)),
w AS (SELECT instrument, day, coalesce(forward_return, 0) AS y, coalesce(signal / nullif(sum(abs(signal)) OVER (PARTITION BY date), 0), 0) AS w FROM sig JOIN days USING (date) WHERE signal IS NOT NULL),
moves AS (SELECT coalesce(a.day, b.day + 1) AS day, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS moved, coalesce(a.w * a.y, 0) AS pnl FROM w a FULL OUTER JOIN w b ON a.instrument = b.instrument AND a.day = b.day + 1),
wr AS (SELECT date, sum(pnl) AS gross, sum(moved) AS turnover, sum(pnl) - sum(moved) * 0.001::DOUBLE AS net FROM moves JOIN days USING (day) GROUP BY date)"""


@register("feature_weighted_returns", _signal_sql(f", {_WEIGHTED} SELECT date, {R('gross')} AS gross, {R('turnover')} AS turnover, {R('net')} AS net FROM wr"))
def feature_weighted_returns(spark, folder):
    return out(audit.weighted_returns(signal(spark, folder), "signal", "forward_return", 10.0), ["date"], ["gross", "turnover", "net"])


@register("gate_cost", _signal_sql(f""", {_WEIGHTED} SELECT {R('avg(turnover)')} AS turnover, {R('avg(gross)')} AS gross, {R('avg(net)')} AS net, {R('avg(gross) - avg(net)')} AS drag,
avg(turnover) <= 0.6 AND avg(net) > 0 AS passed FROM wr"""))
def gate_cost(spark, folder):
    return out(audit.cost_gate(signal(spark, folder), "signal", "forward_return"), ["passed"], ["turnover", "gross", "net", "drag"])


@register("gate_incremental", _signal_sql(f""", s2 AS (SELECT *, signal + coalesce(ret_21d, 0) AS both_ FROM sig), {_ics()}, {_ics('base', 'ret_21d', 's2')}, {_ics('comb', 'both_', 's2')},
g AS (SELECT (SELECT avg(ic) FROM ics) AS candidate_ic, (SELECT avg(ic) FROM base) AS baseline_ic, (SELECT avg(ic) FROM comb) AS combined_ic,
      (SELECT abs(coalesce({_corr('coalesce(signal, 0)', 'coalesce(ret_21d, 0)')}, 0)) FROM sig) AS max_corr)
SELECT {', '.join(f'{R(c)} AS {c}' for c in ('candidate_ic', 'baseline_ic', 'combined_ic', 'max_corr'))}, {R('combined_ic - baseline_ic')} AS delta_ic, combined_ic - baseline_ic >= 0.001 AND max_corr <= 0.7 AS passed FROM g"""))
def gate_incremental(spark, folder):
    got = audit.incremental_gate(signal(spark, folder), "signal", "forward_return", ["ret_21d"])
    return out(got, ["passed"], ["candidate_ic", "baseline_ic", "combined_ic", "max_corr", "delta_ic"])


_FEATURES = ("open", "high", "low", "close", "volume", "marketcap")


@register("correlation_matrix", f"WITH {BARS_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R('coalesce(' + _corr(f'CASE WHEN {b} IS NOT NULL THEN {a} END', f'CASE WHEN {a} IS NOT NULL THEN {b} END') + ', 0)')} AS corr FROM bars" for a in _FEATURES for b in _FEATURES
))
def correlation_matrix(spark, folder):
    return out(audit.correlation_matrix(bars(spark, folder), list(_FEATURES)), ["a", "b"], ["corr"])


_WIDER = (*_FEATURES, "spare_cap")


@register("correlation_clusters", f"""WITH RECURSIVE {BARS_SQL}, x AS (SELECT *, marketcap - 0.1::DOUBLE * close AS spare_cap FROM bars),
m AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(f'CASE WHEN {b} IS NOT NULL THEN {a} END', f'CASE WHEN {a} IS NOT NULL THEN {b} END')} AS c FROM x" for a in _WIDER for b in _WIDER if a != b)}),
e AS (SELECT a, b FROM m WHERE abs(c) >= 0.5), r(feature, peer) AS (SELECT a, b FROM e UNION SELECT r.feature, e.b FROM r JOIN e ON r.peer = e.a),
k AS (SELECT feature, min(peer) AS cluster FROM r GROUP BY feature)
SELECT feature, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM k""")
def correlation_clusters(spark, folder):
    rows = bars(spark, folder).withColumn("spare_cap", F.col("marketcap") - 0.1 * F.col("close"))
    return audit.correlation_clusters(audit.correlation_matrix(rows, list(_WIDER)), 0.5)


@register("feature_stability", _signal_sql(f""", fw AS (SELECT year(date) AS fold, feature, {_corr('x', 'y')} AS weight FROM (
SELECT date, forward_return AS y, unnest([{{'feature': 'signal', 'x': signal}}, {{'feature': 'ret_21d', 'x': ret_21d}}], recursive := true) FROM sig WHERE signal IS NOT NULL AND ret_21d IS NOT NULL AND forward_return IS NOT NULL) GROUP BY ALL)
SELECT feature, {R('coalesce(avg(moved), 0)')} AS moved FROM (SELECT feature, abs(weight - lag(weight) OVER (PARTITION BY feature ORDER BY fold)) AS moved FROM fw) GROUP BY feature"""))
def feature_stability(spark, folder):
    rows = signal(spark, folder).where("signal IS NOT NULL AND ret_21d IS NOT NULL AND forward_return IS NOT NULL")
    got = rows.groupBy(F.year("date").alias("fold")).agg(*[ev.safe_corr(F.col(f), F.col("forward_return")).alias(f) for f in ("signal", "ret_21d")])
    return out(audit.feature_stability(got.unpivot("fold", ["signal", "ret_21d"], "feature", "weight")), ["feature"], ["moved"])


@register("bucket_sharpe", f"""WITH ret AS (SELECT date, (level / lag(level) OVER (ORDER BY date) - 1) / 50 AS r FROM (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1)),
b AS (SELECT product(1 + r) - 1 AS r FROM (SELECT r, (row_number() OVER (ORDER BY date) - 1) // 21 AS bucket FROM ret WHERE r IS NOT NULL) GROUP BY bucket HAVING count(*) = 21)
SELECT {R('coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0 / 21), 0)')} AS sharpe FROM b""")
def bucket_sharpe(spark, folder):
    days = load(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("level"))
    returns = days.select("date", ((F.col("level") / F.lag("level").over(W.orderBy("date")) - 1) / 50).alias("r")).where("r IS NOT NULL")
    return out(audit.bucket_sharpe(ev.bucket_returns(returns, 21), 21), [], ["sharpe"])


@register("off_calendar_dates", """SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def off_calendar_dates(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return audit.off_calendar_dates(rows, load(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct())


@register("availability_violations", """SELECT count(*) FILTER (WHERE event_id % 5 = 1) + count(*) FILTER (WHERE event_id % 7 = 2) AS violations FROM events""")
def availability_violations(spark, folder):
    late = F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss")
    known = F.when(F.col("event_id") % 5 == 1, late).when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("")
    source = F.when(F.col("event_id") % 7 == 2, "no time at all")
    rows = load(spark, folder, "events").select(F.col("ts").alias("as_of"), F.create_map(F.lit("available_at"), known, F.lit("source_available_at"), source).alias("metadata"))
    return audit.availability_violations(rows)


# --- samples

_SAMPLES = f"""{BARS_SQL}, grid AS (SELECT instrument, as_of FROM (SELECT DISTINCT instrument FROM bars), (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS as_of FROM bars)),
known AS (SELECT instrument, date AS known_at, CASE WHEN instrument % 7 = 0 THEN NULL ELSE close END AS f1, volume AS f2 FROM bars WHERE day(date) % 2 = 0),
v AS (SELECT g.*, k.known_at, f1, f2 FROM grid g ASOF LEFT JOIN known k ON g.instrument = k.instrument AND g.as_of >= k.known_at),
i AS (SELECT v.*, b.close AS entry FROM v ASOF LEFT JOIN (SELECT instrument AS bi, date AS bd, close FROM bars) b ON v.instrument = bi AND v.as_of >= bd),
x AS (SELECT i.*, b.close AS leave FROM (SELECT *, as_of + 21 AS till FROM i) i ASOF LEFT JOIN (SELECT instrument AS bi, date AS bd, close FROM bars) b ON i.instrument = bi AND i.till <= bd),
s AS (SELECT *, CASE WHEN known_at IS NULL THEN 'missing_features' WHEN known_at < as_of - 3 THEN 'stale_features' WHEN f1 IS NULL OR f2 IS NULL THEN 'invalid_features'
             WHEN entry IS NULL OR leave IS NULL THEN 'missing_bars' ELSE 'ok' END AS status FROM x)"""


def _samples(spark, folder):
    b = settled(bars(spark, folder).select("instrument", "date", "close", "volume"))
    months = [r[0] for r in b.select(F.to_date(F.date_trunc("month", "date"))).distinct().collect()]  # as many as the panel has months
    grid = b.select("instrument").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(m) for m in sorted(months)])))
    vectors = b.where(F.dayofmonth("date") % 2 == 0).select("instrument", F.col("date").alias("known_at"), F.when(F.col("instrument") % 7 != 0, F.col("close")).alias("f1"), F.col("volume").alias("f2"))
    return samples.supervised_samples(grid, vectors, b.select("instrument", F.col("date").alias("at"), "close"), ["f1", "f2"])


@register("supervised_samples", f"""WITH {_SAMPLES} SELECT instrument, as_of, status, CASE WHEN status = 'ok' THEN {R('f1')} END AS f1, CASE WHEN status = 'ok' THEN {R('f2')} END AS f2,
CASE WHEN status = 'ok' THEN {R('leave / entry - 1')} END AS forward_return FROM s""")
def supervised_samples(spark, folder):
    return out(_samples(spark, folder), ["instrument", "as_of", "status"], ["f1", "f2", "forward_return"])


@register("samples_split", f"""WITH {_SAMPLES}, ok AS (SELECT * FROM s WHERE status = 'ok' AND as_of BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
d AS (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT as_of FROM ok)), f AS (SELECT min(as_of) AS first FROM d WHERE k <= ceil(n * 0.25))
SELECT CASE WHEN as_of >= first THEN 'validation' ELSE 'train' END AS part, count(*) AS n, min(as_of) AS first, max(as_of) AS last FROM ok, f WHERE as_of >= first OR as_of < first - 40 GROUP BY 1""")
def samples_split(spark, folder):
    ok = samples.in_window(_samples(spark, folder).where("status = 'ok'"), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    parts = samples.split_samples(settled(ok), 0.25, 40)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))


@register("statements_latest", f"""WITH r AS (SELECT 'T' || o_custkey % 60 AS ticker, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS datekey,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_seconds(o_orderkey) END AS lastupdated, o_orderkey AS revision, o_totalprice AS revenue FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, datekey ORDER BY lastupdated DESC NULLS LAST) AS nth, count(lastupdated) OVER (PARTITION BY ticker, datekey) AS known FROM r WHERE datekey IS NOT NULL)
SELECT substr(ticker, 2)::BIGINT AS instrument, datekey, lastupdated, revision, {R('revenue')} AS revenue FROM k WHERE nth = 1 AND known > 0 AND substr(ticker, 2)::BIGINT < 40""")
def statements_latest(spark, folder):
    orders = load(spark, folder, "orders")
    rows = orders.select(
        F.concat(F.lit("T"), F.col("o_custkey") % 60).alias("ticker"), F.when(F.col("o_orderkey") % 11 != 0, F.to_date(F.date_trunc("quarter", "o_orderdate"))).alias("datekey"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("lastupdated"), F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("revenue"),
    )
    tickers = spark.range(40).select(F.concat(F.lit("T"), "id").alias("ticker"), F.col("id").alias("instrument"))
    got = samples.latest_statements(rows, tickers).where("lastupdated IS NOT NULL")
    return out(got, ["instrument", "datekey", "lastupdated", "revision"], ["revenue"])


_DECAY = "a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)), h AS (SELECT user_id AS u, ts AS t, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events))"


def _decayed(days: int) -> str:
    age = "(epoch_us(a.ts) - epoch_us(h.t)) / 86400000000.0::DOUBLE"
    return f"SELECT event_id, sum(v * (1 - {age} / {days})) / sum(1 - {age} / {days}) AS m FROM a JOIN h ON user_id = u WHERE {age} >= 0 AND {age} < {days} GROUP BY event_id"


@register("context_decay", f"WITH {_DECAY}, m2 AS ({_decayed(2)}), m5 AS ({_decayed(5)}) SELECT a.event_id, {R('coalesce(m5.m, 0)')} AS mean_5d, {R('coalesce(m5.m, 0) - coalesce(m2.m, 0)')} AS band FROM a LEFT JOIN m2 USING (event_id) LEFT JOIN m5 USING (event_id)")
def context_decay(spark, folder):
    e = load(spark, folder, "events")
    ends = e.agg(F.max("event_type").alias("hi"), F.min("event_type").alias("lo")).first()
    asked = e.where(F.col("event_type") == ends["hi"]).select("event_id", F.col("user_id").alias("instrument"), F.col("ts").alias("as_of"))
    history = e.where(F.col("event_type") == ends["lo"]).select(F.col("user_id").alias("instrument"), F.col("ts").alias("at"), "value", F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0).alias("session_return"))
    keys = asked.select("instrument", "as_of").distinct()
    longer = samples.decayed_mean(keys, history, "value", 5, "session_return").withColumnRenamed("mean", "mean_5d")
    both = longer.join(samples.decayed_mean(keys, history, "value", 2, "session_return"), ["instrument", "as_of"]).withColumn("band", F.col("mean_5d") - F.col("mean"))
    return out(asked.join(both, ["instrument", "as_of"]), ["event_id"], ["mean_5d", "band"])


@register("neutral_frame", f"""WITH {BARS_SQL}, g AS (SELECT *, CASE WHEN instrument % 5 = 0 THEN '__unknown__' ELSE sector END AS grp FROM bars)
SELECT instrument, date, {R('open - median(open) OVER (PARTITION BY date, grp)')} AS open, {R('close - median(close) OVER (PARTITION BY date, grp)')} AS close FROM g""")
def neutral_frame(spark, folder):
    b = bars(spark, folder)
    groups = load(spark, folder, "supplier").join(F.broadcast(load(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 5 <> 0")
    groups = groups.select(F.col("s_suppkey").alias("instrument"), F.col("n_name").alias("group"))
    return out(crosssection.neutralize_frame(b, ["open", "close"], "sector_median", groups=groups), ["instrument", "date"], ["open", "close"])


# --- risk

_BOOK = f"""{BARS_SQL}, d AS (SELECT max(date) AS date FROM bars), book AS (SELECT instrument, w / sum(w) OVER () AS weight FROM (SELECT instrument, 1 + instrument % 4 AS w FROM bars GROUP BY instrument)),
load AS (SELECT instrument, 'f' || (instrument % 3) AS factor, 0.5::DOUBLE + instrument % 2 AS loading FROM book UNION ALL SELECT instrument, 'market', 1.0::DOUBLE FROM book)"""


def _book(spark, folder):
    names = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("instrument")).distinct().withColumn("w", 1 + F.col("instrument") % 4)
    weights = names.select("instrument", (F.col("w") / F.sum("w").over(W.partitionBy(F.lit(1)))).alias("weight"))
    own = weights.select("instrument", F.concat(F.lit("f"), F.col("instrument") % 3).alias("factor"), (0.5 + F.col("instrument") % 2).alias("loading"))
    return weights, own.unionByName(weights.select("instrument", F.lit("market").alias("factor"), F.lit(1.0).alias("loading")))


@register("factor_exposures", f"WITH {_BOOK} SELECT factor, {R('sum(weight * loading)')} AS exposure FROM book JOIN load USING (instrument) GROUP BY factor")
def factor_exposures(spark, folder):
    weights, loadings = _book(spark, folder)
    return out(risk.factor_exposures(weights, loadings), ["factor"], ["exposure"])


@register("factor_caps", f"""WITH {_BOOK}, e AS (SELECT factor, 0.3::DOUBLE / sum(weight * loading) AS scale FROM book JOIN load USING (instrument) WHERE factor <> 'market' GROUP BY factor HAVING sum(weight * loading) > 0.3)
SELECT instrument, {R('weight * coalesce(scale, 1)')} AS weight FROM book JOIN load USING (instrument) LEFT JOIN e USING (factor) WHERE factor <> 'market'""")
def factor_caps(spark, folder):
    weights, loadings = _book(spark, folder)
    return out(risk.cap_factors(weights, loadings.where("factor <> 'market'"), 0.3), ["instrument"], ["weight"])


_SHOCKS = "shocks AS (SELECT 'n' || (instrument % 20) AS scenario, instrument, (instrument % 7 - 4) / 10.0::DOUBLE AS shock FROM book UNION ALL SELECT 'crash', NULL, -0.2)"


def _stress(spark, folder):
    weights, _ = _book(spark, folder)
    named = weights.select(F.concat(F.lit("n"), F.col("instrument") % 20).alias("scenario"), "instrument", ((F.col("instrument") % 7 - 4) / 10.0).alias("shock"))
    crash = spark.createDataFrame([("crash", None, -0.2)], "scenario string, instrument long, shock double")
    return risk.stress(weights, named.unionByName(crash))


@register("stress_results", f"WITH {_BOOK}, {_SHOCKS} SELECT scenario, {R('sum(CASE WHEN s.instrument IS NULL THEN (SELECT sum(weight) FROM book) ELSE coalesce(weight, 0) END * shock)')} AS result FROM shocks s LEFT JOIN book USING (instrument) GROUP BY scenario")
def stress_results(spark, folder):
    return out(_stress(spark, folder), ["scenario"], ["result"])


@register("stress_tail_loss", f"""WITH {_BOOK}, {_SHOCKS}, r AS (SELECT sum(CASE WHEN s.instrument IS NULL THEN (SELECT sum(weight) FROM book) ELSE coalesce(weight, 0) END * shock) AS x FROM shocks s LEFT JOIN book USING (instrument) GROUP BY scenario),
l AS (SELECT -x AS loss, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM r WHERE x < 0) SELECT {R('avg(loss)')} AS tail_loss FROM l WHERE k <= greatest(1, ceil(n * 0.2))""")
def stress_tail_loss(spark, folder):
    return out(risk.tail_loss(_stress(spark, folder), 0.2), [], ["tail_loss"])


@register("covariance_scale", f"""WITH {_BOOK}, v AS (SELECT instrument, sqrt(var_samp(close) * 0.5) AS vol FROM bars GROUP BY instrument), s AS (SELECT instrument, weight, weight * avg(vol) OVER () / vol AS x FROM book JOIN v USING (instrument))
SELECT instrument, {R('x * sum(weight) OVER () / sum(x) OVER ()')} AS weight FROM s""")
def covariance_scale(spark, folder):
    weights, _ = _book(spark, folder)
    variances = bars(spark, folder).groupBy("instrument").agg(F.var_samp("close").alias("variance"))
    return out(risk.inverse_vol_scale(weights, variances, 0.5), ["instrument"], ["weight"])


@register("ewma_ic_weights", _signal_sql(f""", {_ics()}, {_ics('other', 'ret_21d')}, f AS (SELECT 'signal' AS factor, date, ic FROM ics UNION ALL SELECT 'ret_21d', date, ic FROM other UNION ALL SELECT 'against', date, -ic FROM ics UNION ALL SELECT 'reversal', date, -ic FROM other UNION ALL SELECT 'faint', date, ic * -0.002 FROM other),
k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) - 1 AS back FROM f), r AS (SELECT factor, greatest(0, sum(2.0 / 21 * power(1 - 2.0::DOUBLE / 21, back) * ic)) AS raw FROM k WHERE back < 60 GROUP BY factor),
s AS (SELECT factor, CASE WHEN sum(raw) OVER () < 1e-9 THEN 1.0 / count(*) OVER () ELSE raw / sum(raw) OVER () END AS share, sum(raw) OVER () AS total FROM r)
SELECT factor, {R('share / sum(share) OVER ()')} AS weight FROM s WHERE total < 1e-9 OR share >= 0.01"""))
def ewma_ic_weights(spark, folder):
    sig = signal(spark, folder)
    ics, other = audit.ic_series(sig, "signal", "forward_return"), audit.ic_series(sig, "ret_21d", "forward_return")
    said = [("signal", ics, 1.0), ("against", ics, -1.0), ("ret_21d", other, 1.0), ("reversal", other, -1.0), ("faint", other, -0.002)]
    parts = [df.select(F.lit(name).alias("factor"), "date", (F.col("ic") * times).alias("ic")) for name, df, times in said]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    return out(risk.ewma_ic_weights(rows), ["factor"], ["weight"])


@register("engine_merge", f"""WITH {_BOOK}, t AS (SELECT 'a' AS engine, instrument, weight FROM book UNION ALL SELECT 'b', instrument, weight * 2 FROM book WHERE instrument % 2 = 0),
b(engine, capital, most, turn) AS (VALUES ('a', 0.6::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE), ('b', 0.4::DOUBLE, 0.5::DOUBLE, 9.0::DOUBLE)),
p AS (SELECT 'a' AS engine, instrument, 0.01::DOUBLE AS was FROM book WHERE instrument % 3 = 0),
m AS (SELECT engine, instrument, coalesce(weight * least(capital, most), 0) AS w, coalesce(was, 0) AS was FROM (SELECT * FROM t FULL OUTER JOIN p USING (engine, instrument)) JOIN b USING (engine)),
c AS (SELECT engine, instrument, was + (w - was) * CASE WHEN sum(abs(w - was)) OVER e > turn THEN turn / sum(abs(w - was)) OVER e ELSE 1 END AS w FROM m JOIN b USING (engine) WINDOW e AS (PARTITION BY engine))
SELECT instrument, {R('a + least(b, greatest(0, 0.5 - a))')} AS weight FROM (SELECT instrument, least(coalesce(max(w) FILTER (WHERE engine = 'a'), 0), 0.5) AS a, coalesce(max(w) FILTER (WHERE engine = 'b'), 0) AS b FROM c GROUP BY instrument)
WHERE a + least(b, greatest(0, 0.5 - a)) > 0""")
def engine_merge(spark, folder):
    weights, _ = _book(spark, folder)
    targets = weights.select(F.lit("a").alias("engine"), "instrument", "weight").unionByName(weights.where("instrument % 2 = 0").select(F.lit("b").alias("engine"), "instrument", (F.col("weight") * 2).alias("weight")))
    budgets = spark.createDataFrame([("a", 0.6, 0.5, 0.3, True), ("b", 0.4, 0.5, 9.0, True), ("c", 0.1, 0.1, 0.1, False)], "engine string, capital double, max_gross double, max_turnover double, enabled boolean")
    held = weights.where("instrument % 3 = 0").select(F.lit("a").alias("engine"), "instrument", F.lit(0.01).alias("weight"))
    return out(risk.merge_engines(targets, budgets, held), ["instrument"], ["weight"])


# --- fitted models: their sums are Spark's, so that SQL can follow those; the solutions are tested against other solvers


@register("ridge_nonnegative")
def ridge_nonnegative(spark, folder):
    """Weights of standard bar features for the forward return."""
    rows = signal(spark, folder).where("signal IS NOT NULL AND ret_21d IS NOT NULL AND forward_return IS NOT NULL")
    weights = fitting.ridge_nonnegative(rows, ["signal", "ret_21d"], "forward_return")
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@register("pca_fit")
def pca_fit(spark, folder):
    """Two components of the bars' columns, applied to every bar."""
    rows = bars(spark, folder).select("instrument", "date", *_FEATURES)
    rows = settled(rows)
    model = fitting.fit_components(rows, ["open", "close", "volume"], 2)
    return out(rows.withColumns(model.columns()), ["instrument", "date"], ["pc1", "pc2"])


@register("boosted_scores")
def boosted_scores(spark, folder):
    """Scores of gradient-boosted trees, fitted on the samples before 1999, for all later ones."""
    rows = signal(spark, folder).where("signal IS NOT NULL AND ret_21d IS NOT NULL AND forward_return IS NOT NULL")
    model = fitting.fit_boosted(rows.where("date < DATE '1999-01-01'"), ["signal", "ret_21d"], "forward_return")
    return out(fitting.boosted_score(model, rows.where("date >= DATE '1999-01-01'"), ["signal", "ret_21d"]), ["instrument", "date"], ["score"])


# --- universe and evidence

_ADV = "adv AS (SELECT instrument, avg(volume) AS adv_shares, avg(volume) * arg_max(close, date) AS adv_dollars FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 20 GROUP BY instrument)"


@register("universe_tradable", f"""WITH {BARS_SQL}, {_ADV}, i AS (SELECT s_suppkey AS instrument, CASE WHEN s_suppkey % 4 = 0 THEN 'etf' ELSE 'equity' END AS asset_class, CASE WHEN s_suppkey % 9 <> 0 THEN n_name END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT instrument, asset_class, sector, {R('adv_dollars')} AS adv_dollars FROM i JOIN adv USING (instrument) WHERE asset_class = 'equity' AND sector IS NOT NULL AND adv_dollars >= 20000""")
def universe_tradable(spark, folder):
    names = load(spark, folder, "supplier").join(F.broadcast(load(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("s_suppkey") % 4 == 0, "etf").otherwise("equity")
    names = names.select(F.col("s_suppkey").alias("instrument"), kind.alias("asset_class"), F.when(F.col("s_suppkey") % 9 != 0, F.col("n_name")).alias("sector"))
    return out(universe.tradable(names, quality.liquidity(bars(spark, folder)), ["equity"], 20_000.0), ["instrument", "asset_class", "sector"], ["adv_dollars"])


@register("participation_allowed", f"""WITH {BARS_SQL}, {_ADV} SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, coalesce(l_quantity <= floor(adv_shares * 1.1::DOUBLE), false) AS allowed
FROM lineitem LEFT JOIN (SELECT * FROM adv WHERE instrument % 5 <> 0) a ON l_suppkey = instrument""")
def participation_allowed(spark, folder):
    adv = quality.liquidity(bars(spark, folder)).where("instrument % 5 <> 0").select("instrument", "adv_shares")
    orders = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    joined = orders.join(adv, F.col("l_suppkey") == F.col("instrument"), "left")
    return joined.select(*orders.columns, universe.may_order(F.col("l_quantity"), F.col("adv_shares"), 1.1).alias("allowed"))


@register("known_window", """SELECT event_id, user_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND ts + to_hours(event_id % 72) <= TIMESTAMP '2024-01-20'""")
def known_window(spark, folder):
    e = load(spark, folder, "events").select("event_id", "user_id", "ts", (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 72).cast("int"))).alias("available_at"))
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return universe.known_window(e, at("2024-01-05"), at("2024-01-20"), on="ts").drop("available_at")


@register("instrument_pnl_latest", f"""WITH {BARS_SQL} SELECT date, instrument, {R('close - open')} AS pnl FROM bars ORDER BY date DESC, instrument LIMIT 50""")
def instrument_pnl_latest(spark, folder):
    """The latest fifty rows, newest first: a report of a fixed length."""
    return out(bars(spark, folder).withColumn("pnl", F.col("close") - F.col("open")).orderBy(F.col("date").desc(), "instrument").limit(50), ["date", "instrument"], ["pnl"])


@register("alpha_evidence", _signal_sql(f""", {_ics()}, plain AS (SELECT date, {_corr('signal', 'forward_return')} AS ic FROM sig WHERE signal IS NOT NULL AND forward_return IS NOT NULL GROUP BY date HAVING count(*) >= 2),
turn AS (SELECT date, avg(moved) AS t FROM (SELECT date, abs(r - lag(r) OVER (PARTITION BY instrument ORDER BY date)) AS moved FROM (SELECT instrument, date, {sql_percent_rank('signal', 'date')} AS r FROM sig WHERE signal IS NOT NULL)) GROUP BY date),
g AS (SELECT (SELECT avg(ic) FROM plain) AS mean_ic, (SELECT avg(ic) FROM ics) AS rank_ic, (SELECT avg(ic) / nullif(stddev_samp(ic), 0) FROM ics) AS icir, (SELECT count(*) FROM ics) AS dates, (SELECT avg(t) FROM turn) AS turnover,
  avg((signal IS NOT NULL)::INT::DOUBLE) AS coverage, abs(coalesce({_corr('CASE WHEN ret_21d IS NOT NULL THEN signal END', 'CASE WHEN signal IS NOT NULL THEN ret_21d END')}, 0)) AS max_corr FROM sig)
SELECT {', '.join(f'{R(c)} AS {c}' for c in ('mean_ic', 'rank_ic', 'icir', 'turnover', 'coverage', 'max_corr'))}, dates,
  coalesce(abs(rank_ic) >= 0.001 AND abs(icir) >= 0.001 AND turnover <= 0.4 AND coverage >= 0.5 AND max_corr <= 0.7 AND dates >= 30, false) AS admitted FROM g"""))
def alpha_evidence(spark, folder):
    got = universe.evidence(signal(spark, folder), "signal", "forward_return", ["ret_21d"])
    return out(got.withColumn("admitted", universe.admitted(0.001, 0.001)), ["dates", "admitted"], ["mean_ic", "rank_ic", "icir", "turnover", "coverage", "max_corr"])
