"""Queries of walk-forward campaigns, evidence of expressions, market labels, targets and sequences, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library
from ..functions.expr import Expression, NUDGE, evaluate, sql_average_rank, sql_percent_rank, sql_rounded, to_sql
from ..functions.grouped import ranked
from ..operators import audit, campaign, crosssection, decay, evaluate as ev, evidence, quality, regime, samples, sequences, targets
from ..operators.settle import settled
from ..sources import calendar, filings
from ..sources.tables import BARS_SQL, QUARTERS_SQL, bars, load, quarters
from ..streaming import tracking
from .analytics import out

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


def _corr(f: str, l: str) -> str:
    return f"covar_samp({f}, {l}) / nullif(stddev_samp({f}) * stddev_samp({l}), 0)"


# --- samples of a campaign

RET = library.PRICE_VOLUME["pv_returns"]["ret_21d"]
FEATURES: dict[str, Expression] = {"calm": library.PRICE_VOLUME["pv_low_vol"]["low_vol_21d"], "ret_21d": RET, "reversal": -RET}
FOLDS = ev.walk_forward_folds(ev.date(1995, 1, 2), ev.date(2001, 11, 4), train=504, test=126)
_FOLDS = "folds(fold, a, b, c, d) AS (VALUES " + ", ".join(f"({f.fold}, DATE '{f.train_start}', DATE '{f.train_end}', DATE '{f.test_start}', DATE '{f.test_end}')" for f in FOLDS) + ")"


def _sql(expressions: dict[str, Expression], rest: str, name: str = "sig") -> str:
    """`rest` over a table `name`: bars with the expressions as columns, to 15 places."""
    body, select = to_sql("bars", expressions, "*").rsplit("\nSELECT", 1)
    for e in expressions:
        select = select.replace(f" + {NUDGE}::DOUBLE, 6) AS {e}", f", 15) AS {e}")
    return f"WITH RECURSIVE {BARS_SQL}{body}, {name} AS (SELECT {select})\n{rest}"


_SAMPLES = FEATURES | {"forward_return": library.call("lead", library.CLOSE, 21) / library.CLOSE - 1}
_KEPT = f""", days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars)),
samp AS (SELECT sig.*, day, CASE WHEN lead(day) OVER w = day + 1 THEN lead(close) OVER w / nullif(close, 0) - 1 END AS realized_return_1d, lead(day, 21) OVER w AS label_end_index
  FROM sig JOIN days USING (date) WINDOW w AS (PARTITION BY instrument ORDER BY date)),
{_FOLDS}, parts AS (SELECT samp.*, fold, CASE WHEN date >= c THEN 'test' ELSE 'train' END AS part FROM samp JOIN folds ON (date >= a AND date < b) OR (date >= c AND date < d)),
starts AS (SELECT fold, min(day) AS first_day, min(date) AS start FROM parts WHERE part = 'test' GROUP BY fold),
kept AS (SELECT parts.*, start FROM parts JOIN starts USING (fold) WHERE part = 'test' OR label_end_index < first_day)"""
_IC_WEIGHTS = f""", long AS ({' UNION ALL '.join(f"SELECT fold, '{f}' AS feature, coalesce({f}, 0) AS x, forward_return AS l FROM kept WHERE part = 'train' AND forward_return IS NOT NULL" for f in FEATURES)}),
fit AS (SELECT fold, feature, coalesce({_corr('f', 'l')}, 0) AS ic FROM (SELECT fold, feature, {sql_average_rank('x', 'fold', 'feature')} AS f, {sql_average_rank('l', 'fold', 'feature')} AS l FROM long) GROUP BY fold, feature),
weights AS (SELECT fold, feature, CASE WHEN sum(greatest(ic, 0)) OVER w > 0 THEN greatest(ic, 0) / sum(greatest(ic, 0)) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END AS weight FROM fit WINDOW w AS (PARTITION BY fold))"""
_WIDE = ", ".join(f"max(weight) FILTER (WHERE feature = '{f}') AS w_{f}" for f in FEATURES)
_SCORE = " + ".join(f"coalesce({sql_percent_rank(f, 'fold', 'date')}, 0.5::DOUBLE) * coalesce(w_{f}, 0)" for f in FEATURES)
_DAYS = f""", wide AS (SELECT fold, {_WIDE} FROM weights GROUP BY fold),
scored AS (SELECT *, round({_SCORE}, 14) AS score FROM kept JOIN wide USING (fold) WHERE part = 'test'),
ic AS (SELECT fold, date, coalesce({_corr('s', 'l')}, 0) AS ic FROM (SELECT fold, date, {sql_average_rank('score', 'fold', 'date')} AS s, {sql_average_rank('forward_return', 'fold', 'date')} AS l FROM scored WHERE forward_return IS NOT NULL) GROUP BY fold, date),
book AS (SELECT fold, instrument, coalesce(score / nullif(sum(abs(score)) OVER (PARTITION BY fold), 0), 0) AS w FROM scored WHERE date = start),
seq AS (SELECT fold, row_number() OVER (ORDER BY fold) AS k FROM (SELECT DISTINCT fold FROM scored)),
moves AS (SELECT k, instrument, sum(w) AS w FROM (SELECT k, instrument, w FROM book JOIN seq USING (fold) UNION ALL SELECT k + 1, instrument, -w FROM book JOIN seq USING (fold)) GROUP BY ALL),
trades AS (SELECT fold, sum(abs(w)) AS traded FROM moves JOIN seq USING (k) GROUP BY fold),
gains AS (SELECT fold, date, max(start) AS start, sum(coalesce(w * realized_return_1d, 0)) AS gross FROM scored LEFT JOIN book USING (fold, instrument) GROUP BY fold, date),
days_of AS (SELECT fold, date, coalesce(ic, 0) AS ic, gross, CASE WHEN date = start THEN traded ELSE 0 END AS turnover, gross - CASE WHEN date = start THEN traded ELSE 0 END * 0.001::DOUBLE AS net FROM gains LEFT JOIN ic USING (fold, date) LEFT JOIN trades USING (fold))"""
_REPORT = f""", curve AS (SELECT *, product(1 + net) OVER w AS equity FROM days_of WINDOW w AS (PARTITION BY fold ORDER BY date)),
peaks AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY fold ORDER BY date)) AS peak FROM curve),
reps AS (SELECT fold, count(*) AS days, avg(ic) AS mean_ic, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe, product(1 + net) - 1 AS total_return, min(equity / peak - 1) AS max_drawdown, avg(turnover) AS turnover FROM peaks GROUP BY fold),
sizes AS (SELECT fold, count(*) FILTER (WHERE part = 'train') AS train_rows, count(*) FILTER (WHERE part = 'test') AS test_rows FROM kept GROUP BY fold),
numbered AS (SELECT *, row_number() OVER (ORDER BY fold) AS k FROM reps JOIN sizes USING (fold)),
past AS (SELECT a.fold, count(b.k) AS n, coalesce(sum(pow(pow(0.5::DOUBLE, 0.25::DOUBLE), a.k - 1 - b.k) * b.mean_ic) / sum(pow(pow(0.5::DOUBLE, 0.25::DOUBLE), a.k - 1 - b.k)), 0) AS ewma_ic,
  a.k - 1 - coalesce(max(b.k) FILTER (WHERE b.mean_ic >= 0), 0) AS negative_run FROM numbered a LEFT JOIN numbered b ON b.k < a.k GROUP BY a.fold, a.k),
said AS (SELECT numbered.*, ewma_ic, negative_run, CASE WHEN n < 4 THEN 'warmup' WHEN negative_run >= 3 THEN 'killed' WHEN ewma_ic <= 0.24 THEN 'floor' WHEN ewma_ic >= 0.46 THEN 'ceiling' ELSE 'throttled' END AS streak_reason FROM numbered JOIN past USING (fold))"""


def _samples(spark, folder) -> DataFrame:
    """Labels first: their windows and the pass of the features share one shuffle."""
    labelled = ev.forward_labels(bars(spark, folder).select("instrument", "date", "sector", "close"))
    return evaluate(labelled, FEATURES)


def _campaign(spark, folder):
    # The given prices revert so strongly that ICs lie far above the usual bounds of the throttle.
    return campaign.walk_forward(_samples(spark, folder), FOLDS, list(FEATURES), streak={"floor": 0.24, "ceiling": 0.46})


@register("fold_weights", _sql(_SAMPLES, _KEPT + _IC_WEIGHTS + f" SELECT fold, feature, {R('weight')} AS weight FROM weights"))
def fold_weights(spark, folder):
    rows = settled(_samples(spark, folder).select("date", "day", "label_end_index", *FEATURES, "forward_return"))
    return out(campaign.fold_ic_weights(rows, FOLDS, list(FEATURES), "forward_return"), ["fold", "feature"], ["weight"])


@register("walk_forward_days", _sql(_SAMPLES, _KEPT + _IC_WEIGHTS + _DAYS + f" SELECT fold, date, {', '.join(f'{R(c)} AS {c}' for c in ('ic', 'gross', 'turnover', 'net'))} FROM days_of"))
def walk_forward_days(spark, folder):
    return out(_campaign(spark, folder)[1], ["fold", "date"], ["ic", "gross", "turnover", "net"])


_MEASURES = ["mean_ic", "sharpe", "total_return", "max_drawdown", "turnover", "ewma_ic", "streak_scale"]


@register("walk_forward_report", _sql(_SAMPLES, _KEPT + _IC_WEIGHTS + _DAYS + _REPORT + f""" SELECT fold, days, train_rows, test_rows, negative_run, streak_reason, {', '.join(f'{R(c)} AS {c}' for c in _MEASURES[:-1])},
{R("CASE WHEN streak_reason IN ('warmup', 'ceiling') THEN 1 WHEN streak_reason IN ('killed', 'floor') THEN 0 ELSE (ewma_ic - 0.24) / 0.22 END")} AS streak_scale FROM said"""))
def walk_forward_report(spark, folder):
    return out(_campaign(spark, folder)[2].withColumn("negative_run", F.col("negative_run").cast("long")), ["fold", "days", "train_rows", "test_rows", "negative_run", "streak_reason"], _MEASURES)


@register("fold_volatility_scale", _sql(_SAMPLES, _KEPT + f""", daily AS (SELECT fold, date, avg(realized_return_1d) / 40 AS net FROM kept WHERE part = 'train' GROUP BY fold, date),
late AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY date DESC) AS nth FROM daily WHERE net IS NOT NULL), v AS (SELECT fold, coalesce(stddev_samp(net), 0) * sqrt(252) AS volatility FROM late WHERE nth <= 63 GROUP BY fold)
SELECT fold, {R('volatility')} AS volatility, {R('least(1, 0.1 / greatest(volatility, 0.05))')} AS vol_scale FROM v"""))
def fold_volatility_scale(spark, folder):
    rows = campaign.fold_samples(_samples(spark, folder), FOLDS)
    daily = rows.where("part = 'train'").groupBy("fold", "date").agg((F.avg("realized_return_1d") / 40).alias("net"))
    return out(campaign.volatility_scales(daily), ["fold"], ["volatility", "vol_scale"])


_ROBUST = f""", long AS ({' UNION ALL '.join(f"SELECT fold, date, '{f}' AS feature, coalesce({f}, 0) AS x, forward_return AS l FROM kept WHERE part = 'train' AND forward_return IS NOT NULL" for f in FEATURES)}),
dic AS (SELECT fold, feature, date, coalesce({_corr('f', 'l')}, 0) AS ic FROM (SELECT fold, feature, date, {sql_average_rank('x', 'fold', 'feature', 'date')} AS f, {sql_average_rank('l', 'fold', 'feature', 'date')} AS l FROM long) GROUP BY ALL HAVING count(*) >= 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY ic, date) AS nth, count(*) OVER (PARTITION BY fold, feature) AS many FROM dic),
got AS (SELECT fold, feature, max(many) AS dates, avg(ic) + 0.25::DOUBLE * avg(ic) FILTER (WHERE nth <= greatest(1, floor(many * 0.33::DOUBLE))) AS robust_ic FROM placed GROUP BY ALL),
grid AS (SELECT DISTINCT fold, unnest({list(FEATURES)}) AS feature FROM kept WHERE part = 'train'),
raw AS (SELECT grid.*, coalesce(dates, 0) AS dates, robust_ic, CASE WHEN coalesce(dates, 0) >= 8 THEN greatest(0, robust_ic) ELSE 0 END AS w FROM grid LEFT JOIN got USING (fold, feature))
SELECT fold, feature, dates, {R('robust_ic')} AS robust_ic, {R('CASE WHEN sum(w) OVER (PARTITION BY fold) > 0 THEN w / sum(w) OVER (PARTITION BY fold) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY fold) END')} AS weight FROM raw"""


@register("robust_ic_weights", _sql(_SAMPLES, _KEPT + _ROBUST))
def robust_ic_weights(spark, folder):
    rows = settled(_samples(spark, folder).select("date", "day", "label_end_index", *FEATURES, "forward_return"))
    train = campaign.fold_samples(rows, FOLDS).where("part = 'train'")
    return out(campaign.robust_weights(train, list(FEATURES), "forward_return", by=("fold",), downside=0.25, min_names=3), ["fold", "feature", "dates"], ["robust_ic", "weight"])


# --- ridge strength and blocs, for two features in closed form

_TWO = ["calm", "reversal"]
_GRAM = "count(*) AS n, sum(calm * calm) AS g11, sum(calm * reversal) AS g12, sum(reversal * reversal) AS g22, sum(calm * y) AS b1, sum(reversal * y) AS b2, sum(y * y) AS yy, sum(y) AS sy"


def _nonnegative(g: str, l2: str) -> str:
    """Columns w1, w2 of a ridge problem of two weights of at least 0, from a table with its sums."""
    a, b = f"(g11 + {l2})", f"(g22 + {l2})"
    w1, w2 = f"((b1 * {b} - b2 * g12) / ({a} * {b} - g12 * g12))", f"((b2 * {a} - b1 * g12) / ({a} * {b} - g12 * g12))"
    first = f"pow(greatest(b1, 0), 2) / {a} >= pow(greatest(b2, 0), 2) / {b}"
    return f"""SELECT *, CASE WHEN {w1} >= 0 AND {w2} >= 0 THEN {w1} WHEN {first} THEN greatest(b1, 0) / {a} ELSE 0 END AS w1,
  CASE WHEN {w1} >= 0 AND {w2} >= 0 THEN {w2} WHEN {first} THEN 0 ELSE greatest(b2, 0) / {b} END AS w2 FROM {g}"""


_CLEAN = ", clean AS (SELECT instrument, date, calm, reversal, forward_return AS y FROM sig WHERE calm IS NOT NULL AND reversal IS NOT NULL AND forward_return IS NOT NULL)"
_BY_IC = f"""{_CLEAN}, daily AS (SELECT date, {_GRAM} FROM clean GROUP BY date), whole AS (SELECT {_GRAM} FROM clean),
lams(l2) AS (VALUES (0.0001::DOUBLE), (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)),
less AS (SELECT d.date, l2, d.n, w.n AS m, {', '.join(f'w.{c} - d.{c} AS {c}' for c in ('g11', 'g12', 'g22', 'b1', 'b2'))} FROM daily d, whole w, lams),
fits AS ({_nonnegative('less', 'l2')}),
ranked AS (SELECT l2, date, {sql_average_rank('s', 'l2', 'date')} AS s, {sql_average_rank('y', 'l2', 'date')} AS y FROM (SELECT l2, date, calm * w1 / (w1 + w2) + reversal * w2 / (w1 + w2) AS s, y FROM clean JOIN fits USING (date) WHERE n >= 2 AND n < m AND w1 + w2 > 0)),
ics AS (SELECT l2, date, coalesce({_corr('s', 'y')}, 0) AS ic FROM ranked GROUP BY l2, date), means AS (SELECT l2, avg(ic) AS mean_ic, count(*) AS dates FROM ics GROUP BY l2)"""


@register("ridge_by_ic", _sql(_SAMPLES, _BY_IC + f" SELECT l2, {R('mean_ic')} AS mean_ic, dates FROM means"))
def ridge_by_ic(spark, folder):
    """The choice among strengths of equal IC hangs on the last digit, so that it is tested, not compared."""
    return out(campaign.ridge_by_ic(settled(_samples(spark, folder).select("date", *_TWO, "forward_return")), _TWO, "forward_return"), ["l2", "dates"], ["mean_ic"])


@register("bloc_fit", _sql(_SAMPLES, f"""{_CLEAN}, s AS (SELECT year(date) AS year, {_GRAM} FROM clean GROUP BY 1), f AS ({_nonnegative('s', '0.01::DOUBLE')}),
r AS (SELECT *, 1 - (yy - 2 * (w1 * b1 + w2 * b2) + w1 * w1 * g11 + 2 * w1 * w2 * g12 + w2 * w2 * g22) / (yy - sy * sy / n) AS r2, CASE WHEN w1 + w2 > 0 THEN w1 + w2 ELSE 1 END AS t FROM f)
SELECT year, 'calm' AS feature, {R('w1 / t')} AS weight, {R('r2')} AS r2, n FROM r UNION ALL SELECT year, 'reversal', {R('w2 / t')}, {R('r2')}, n FROM r"""))
def bloc_fit(spark, folder):
    rows = _samples(spark, folder).withColumn("year", F.year("date").cast("long"))
    return out(campaign.fit_bloc(campaign.grams(rows, ["year"], _TWO, "forward_return"), ["year"], _TWO, 0.01), ["year", "feature", "n"], ["weight", "r2"])


# --- market labels

_STATS = """days AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS level, avg((o_totalprice > 140000)::INT::DOUBLE) AS breadth FROM orders GROUP BY 1, 2),
rets AS (SELECT *, (level / lag(level) OVER (PARTITION BY series ORDER BY date) - 1) / 60 AS r FROM days),
stats AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS nth, round(stddev_samp(r) OVER w * sqrt(252), 9) AS vol, round(avg(r) OVER w * 4, 9) AS trend, round(avg(breadth) OVER w, 9) AS breadth FROM rets WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def _label_sql(current: str) -> str:
    warn = f"(coalesce(vol >= CASE WHEN {current} = 'risk_off' THEN 0.245::DOUBLE ELSE 0.25 END, false)::INT + coalesce(trend <= -0.05, false)::INT + coalesce(breadth <= 0.4, false)::INT)"
    on = f"coalesce(vol < CASE WHEN {current} = 'risk_on' THEN 0.205::DOUBLE ELSE 0.2 END AND trend >= 0.02 AND breadth >= 0.55, false)"
    crisis = f"({current} = 'crisis' AND coalesce(vol >= 0.345::DOUBLE, false) OR coalesce(vol >= 0.25 AND trend <= -0.05, false))"
    return f"CASE WHEN coalesce(vol >= 0.35, false) THEN 'crisis' WHEN {crisis} THEN 'crisis' WHEN {warn} > 0 THEN 'risk_off' WHEN {on} THEN 'risk_on' ELSE 'transition' END", warn


_SEEN, _WARN = _label_sql("was")
_WALK = f"""walk(series, nth, was, seen, run, label) AS (
  SELECT DISTINCT series, 0::BIGINT, 'transition', NULL::VARCHAR, 0, 'transition' FROM stats
  UNION ALL SELECT series, nth, label0, now, run2, CASE WHEN run2 >= 3 THEN now ELSE label0 END FROM (
    SELECT series, nth, label0, now, CASE WHEN now = seen0 THEN run0 + 1 ELSE 1 END AS run2 FROM (
      SELECT s.series, s.nth, w.was AS label0, w.seen AS seen0, w.run AS run0, {_SEEN} AS now
      FROM (SELECT series, nth, label AS was, seen, run FROM walk) w JOIN stats s ON s.series = w.series AND s.nth = w.nth + 1)))"""


@register("regime_hysteresis", f"""WITH RECURSIVE {_STATS}, {_WALK}
SELECT series, date, seen AS candidate, label, {R(f'''CASE WHEN seen = label THEN 1 ELSE 0.75 END * round(least(1, CASE WHEN vol >= 0.35 THEN (vol - 0.35) / 0.1 + 0.8 WHEN seen = 'crisis' THEN 0.75 WHEN seen = 'risk_off' THEN 0.5 + 0.15 * {_WARN}
  WHEN seen = 'risk_on' THEN 0.6 + 0.4 * least((0.2 - vol) / 0.2, trend / 0.02, (breadth - 0.55) / 0.45) ELSE 0.5 END), 4)''')} AS confidence FROM walk JOIN stats USING (series, nth)""")
def regime_hysteresis(spark, folder):
    """Labels of five series of days; candidates are classified under the label that holds."""
    from pyspark.sql import Window as W

    days = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"))
    days = days.agg(F.avg("o_totalprice").alias("level"), F.avg((F.col("o_totalprice") > 140000).cast("double")).alias("share"))
    own = W.partitionBy("series").orderBy("date")
    late = own.rowsBetween(-9, 0)
    rets = days.withColumn("r", (F.col("level") / F.lag("level").over(own) - 1) / 60)
    stats = rets.select("series", "date", F.round(F.stddev_samp("r").over(late) * 252**0.5, 9).alias("vol"), F.round(F.avg("r").over(late) * 4, 9).alias("trend"), F.round(F.avg("share").over(late), 9).alias("breadth"))
    return out(regime.regime_states(stats), ["series", "date", "candidate", "label"], ["confidence"])


# --- evidence of expressions

_NAMES: dict[str, Expression] = FEATURES | {
    "ret_5d": library.PRICE_VOLUME["pv_returns"]["ret_5d"], "ret_63d": library.PRICE_VOLUME["pv_returns"]["ret_63d"],
    "trend": library.CLOSE_FACTORS["trend_z_score"], "revert": library.CLOSE_FACTORS["mean_reversion"], "volume_z": library.PRICE_VOLUME["pv_liquidity"]["volume_z_20d"],
}
_EVIDENCE_SAMPLES = _NAMES | {"forward_return": _SAMPLES["forward_return"]}
_EVIDENCE = f""", long AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, instrument, date, {n} AS x, forward_return AS y, ret_21d AS base FROM sig WHERE {n} IS NOT NULL" for n in _NAMES)}),
turn AS (SELECT name, avg(t) AS turnover FROM (SELECT name, date, avg(abs(r - r0)) AS t FROM (SELECT name, date, r, lag(r) OVER (PARTITION BY name, instrument ORDER BY date) AS r0 FROM (SELECT name, instrument, date, {sql_percent_rank('x', 'name', 'date')} AS r FROM long)) GROUP BY ALL) GROUP BY name),
pool AS (SELECT name, count(y) AS coverage, abs(coalesce({_corr('CASE WHEN base IS NOT NULL THEN x END', 'base')}, 0)) AS max_corr FROM long GROUP BY name),
num AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sig)),
fold AS (SELECT date, k AS fold FROM num, range(4) t(k) WHERE n >= 80 AND nth >= k * n // 4 + CASE WHEN k > 0 THEN 5 ELSE 0 END AND nth < (k + 1) * n // 4 - CASE WHEN k < 3 THEN 5 ELSE 0 END),
rk AS (SELECT name, fold, date, x, y, {sql_average_rank('x', 'name', 'date')} AS rx, {sql_average_rank('y', 'name', 'date')} AS ry FROM long JOIN fold USING (date) WHERE y IS NOT NULL),
dic AS (SELECT name, fold, date, {_corr('x', 'y')} AS ic, {_corr('rx', 'ry')} AS rank_ic FROM rk GROUP BY ALL),
each AS (SELECT name, fold, avg(ic) AS ic, avg(rank_ic) AS rank_ic, count(ic) AS dates FROM dic GROUP BY ALL HAVING count(ic) >= 20),
grid AS (SELECT name, k AS fold, ic, rank_ic, dates FROM pool CROSS JOIN range(4) t(k) LEFT JOIN each ON each.name = pool.name AND each.fold = k),
isl AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY fold) - row_number() OVER (PARTITION BY name, coalesce(ic < 0, false) ORDER BY fold) AS g FROM (SELECT pool.name, k AS fold, each.ic FROM pool CROSS JOIN range(4) t(k) LEFT JOIN each ON each.name = pool.name AND each.fold = k)),
neg AS (SELECT name, max(c) AS negative_folds FROM (SELECT name, g, count(*) AS c FROM isl WHERE ic < 0 GROUP BY ALL) GROUP BY name),
per AS (SELECT name, avg(ic) AS mean_ic, avg(rank_ic) AS rank_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, count(ic) AS valid_folds, sum(dates)::BIGINT AS dates FROM each GROUP BY name),
evid AS (SELECT pool.name, mean_ic, rank_ic, icir, coalesce(negative_folds, 0) AS negative_folds, coalesce(valid_folds, 0) AS valid_folds, coalesce(dates, 0) AS dates, coverage, max_corr, turnover FROM pool LEFT JOIN per USING (name) LEFT JOIN neg USING (name) LEFT JOIN turn USING (name))"""
_EV = ["mean_ic", "rank_ic", "icir", "max_corr", "turnover"]


def _evidence(spark, folder):
    rows = evidence.evaluated(bars(spark, folder), _EVIDENCE_SAMPLES, ["instrument", "date"])
    return rows, evidence.fold_evidence(rows, list(_NAMES), "forward_return", ["ret_21d"])


@register("expression_evidence", _sql(_EVIDENCE_SAMPLES, _EVIDENCE + f" SELECT name, negative_folds, valid_folds, dates, coverage, {', '.join(f'{R(c)} AS {c}' for c in _EV)} FROM evid"))
def expression_evidence(spark, folder):
    got = _evidence(spark, folder)[1].withColumn("negative_folds", F.col("negative_folds").cast("long"))
    return out(got, ["name", "negative_folds", "valid_folds", "dates", "coverage"], _EV)


#: Bounds that part of the given expressions reach.
_BOUNDS = evidence.Bounds(rank_ic=-0.02, icir=-5.0, negative_folds=4, valid_folds=3, correlation=0.5, dates=50, turnover=0.5)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(coalesce({_corr(f'CASE WHEN {b} IS NOT NULL THEN {a} END', f'CASE WHEN {a} IS NOT NULL THEN {b} END')}, 0)) AS corr FROM sig" for a in _NAMES for b in _NAMES if a != b)


@register("alpha_promotions", _sql(_EVIDENCE_SAMPLES, _EVIDENCE + f""", pairs AS ({_PAIRS}), line AS (SELECT unnest({list(_NAMES)}) AS name, generate_subscripts({list(_NAMES)}, 1) AS k),
sound AS (SELECT name, k, coalesce(rank_ic >= -0.02 AND icir >= -5 AND turnover <= 0.5 AND dates >= 50 AND negative_folds <= 4 AND valid_folds >= 3, false) AS ok FROM line LEFT JOIN evid USING (name)),
greedy(k, name, kept, promoted, near) AS (SELECT 0, NULL::VARCHAR, []::VARCHAR[], false, 0::DOUBLE
  UNION ALL SELECT k, name, CASE WHEN ok AND near <= 0.5 THEN list_append(kept, name) ELSE kept END, ok AND near <= 0.5, near FROM (
    SELECT s.k, s.name, s.ok, g.kept, coalesce(list_max(list_transform(g.kept, lambda x: m.c[x])), 0) AS near FROM greedy g JOIN sound s ON s.k = g.k + 1 JOIN (SELECT a, map(list(b), list(corr)) AS c FROM pairs GROUP BY a) m ON m.a = s.name))
SELECT name, (k - 1)::INT AS nth, promoted, {R('near')} AS max_corr FROM greedy WHERE k > 0"""))
def alpha_promotions(spark, folder):
    rows, got = _evidence(spark, folder)
    return out(evidence.promotions(got, audit.correlation_matrix(rows, list(_NAMES)), list(_NAMES), bounds=_BOUNDS), ["name", "nth", "promoted"], ["max_corr"])


# --- sequences, decays

_SEQ = f""", days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars)),
st AS (SELECT {', '.join(f'avg(coalesce({f}, 0)) AS m_{f}, CASE WHEN stddev_pop(coalesce({f}, 0)) < 1e-12 THEN 1 ELSE stddev_pop(coalesce({f}, 0)) END AS s_{f}' for f in _TWO)} FROM sig WHERE date < DATE '1999-01-01'),
z AS (SELECT instrument, date, day, {', '.join(f'(coalesce({f}, 0) - m_{f}) / s_{f} AS z_{f}' for f in _TWO)}, ln(1 + coalesce(day - lag(day) OVER (PARTITION BY instrument ORDER BY day), 0)) AS gap FROM sig JOIN days USING (date), st),
steps AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS nth FROM z WHERE true)
SELECT a.instrument, a.date, k::INT AS step, (b.nth IS NOT NULL)::INT AS mask, {', '.join(f'{R(f"coalesce(b.z_{f}, 0)")} AS {f}' for f in _TWO)}, {R('coalesce(b.gap, 0)')} AS gap
FROM steps a CROSS JOIN range(6) t(k) LEFT JOIN steps b ON b.instrument = a.instrument AND b.nth = a.nth - 5 + k WHERE a.date >= DATE '2001-06-01'"""


@register("training_sequences", _sql(_SAMPLES, _SEQ))
def training_sequences(spark, folder):
    """Windows of six vectors for the last months, standardised by the years before 1999; one row a step."""
    cut = F.col("date") < F.lit("1999-01-01").cast("date")
    got = sequences.sequences(_samples(spark, folder), _TWO, 6, cut, keep=F.col("date") >= F.lit("2001-06-01").cast("date"))
    each = got.select("instrument", "date", F.posexplode(F.arrays_zip("sequence", "mask")).alias("step", "e"))
    vector = [F.get("e.sequence", F.lit(i)).alias(n) for i, n in enumerate([*_TWO, "gap"])]
    return out(each.select("instrument", "date", "step", F.col("e.mask").alias("mask"), *vector), ["instrument", "date", "step", "mask"], [*_TWO, "gap"])


_HORIZONS = [2, 5, 20]


@register("decayed_horizons", "WITH RECURSIVE asked AS (SELECT DISTINCT user_id AS instrument, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of FROM events), " + ", ".join(
    f"m{h} AS (SELECT instrument, as_of, coalesce(sum(value * w) / nullif(sum(w), 0), 0) AS m FROM (SELECT instrument, as_of, value, 1 - (epoch_us(as_of) - epoch_us(ts)) / 86400e6 / {h} AS w FROM asked LEFT JOIN events ON user_id = instrument AND ts <= as_of AND ts > as_of - INTERVAL {h} DAY) GROUP BY ALL)" for h in _HORIZONS
) + f" SELECT instrument, as_of, {', '.join(f'{R(f'm{h}.m')} AS mean_{h}' for h in _HORIZONS)} FROM asked JOIN m2 USING (instrument, as_of) JOIN m5 USING (instrument, as_of) JOIN m20 USING (instrument, as_of)")
def decayed_horizons(spark, folder):
    e = load(spark, folder, "events")
    asked = e.select(F.col("user_id").alias("instrument"), (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("as_of")).distinct()
    got = decay.decayed_means(asked, e.select(F.col("user_id").alias("instrument"), F.col("ts").alias("at"), "value"), "value", _HORIZONS, bucket="week")
    return out(got, ["instrument", "as_of"], [f"mean_{h}" for h in _HORIZONS])


_LOOK = (1, 3, 7, 21)


@register("event_context", "WITH asked AS (SELECT DISTINCT user_id AS instrument, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of FROM events), seen AS (SELECT user_id AS instrument, ts FROM events WHERE event_type = 'purchase' OR event_id % 7 = 0), "
  "ages AS (SELECT a.instrument, a.as_of, (epoch_us(as_of) - epoch_us(ts)) / 86400e6 AS age FROM asked a LEFT JOIN seen s ON s.instrument = a.instrument AND ts <= as_of) SELECT instrument, as_of, "
  + ", ".join(f"{R(f'least(count(*) FILTER (WHERE age <= {h}), 3) / 3.0::DOUBLE')} AS count_{h}, {R(f'coalesce(sum(1 - age / {h}) FILTER (WHERE age <= {h}), 0) / {h}')} AS density_{h}, {R(f'coalesce(max(1 - age / {h}) FILTER (WHERE age <= {h}), 0)')} AS recency_{h}" for h in _LOOK)
  + f", {R('coalesce(min(age), 999)')} AS days_since FROM ages GROUP BY ALL")
def event_context(spark, folder):
    e = load(spark, folder, "events")
    asked = e.select(F.col("user_id").alias("instrument"), (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("as_of")).distinct()
    seen = e.where("event_type = 'purchase' OR event_id % 7 = 0").select(F.col("user_id").alias("instrument"), F.col("ts").alias("at"))
    got = decay.event_context(asked, seen, _LOOK, bucket="week")
    return out(got, ["instrument", "as_of"], [f"{c}_{h}" for h in _LOOK for c in ("count", "density", "recency")] + ["days_since"])


@register("session_dates", f"""WITH y AS (SELECT y FROM range(1990, 2030) t(y)), g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS d FROM g),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7 AS e FROM h), easter AS (SELECT make_date(y, 3, 1) + (d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 21)::INT AS day FROM l),
fixed AS (SELECT make_date(y, m, k) AS day, m FROM y, (VALUES (7, 4), (12, 25)) f(m, k) UNION ALL SELECT make_date(y, 6, 19), 6 FROM y WHERE y >= 2022 UNION ALL SELECT make_date(y, 1, 1), 1 FROM y),
off AS (SELECT CASE isodow(day) WHEN 7 THEN day + 1 WHEN 6 THEN CASE WHEN m = 1 THEN day ELSE day - 1 END ELSE day END AS day FROM fixed UNION ALL SELECT (day - 2)::DATE FROM easter
  UNION ALL SELECT unnest([DATE '1994-04-27', DATE '2001-09-11', DATE '2001-09-12', DATE '2001-09-13', DATE '2001-09-14', DATE '2004-06-11'])),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), k AS (SELECT date, isodow(date) AS w, month(date) AS m, (day(date) - 1) // 7 + 1 AS nth, day(last_day(date)) - day(date) < 7 AS final FROM d)
SELECT date FROM k WHERE w < 6 AND date NOT IN (SELECT day FROM off) AND NOT (w = 1 AND (m = 1 AND nth = 3 AND year(date) >= 1998 OR m = 2 AND nth = 3 OR m = 5 AND final OR m = 9 AND nth = 1)) AND NOT (w = 4 AND m = 11 AND nth = 4)""")
def session_dates(spark, folder):
    """The dates of orders on which the exchanges traded."""
    return load(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().where(calendar.is_session(F.col("date")))


# --- blended scores, targets, frames

_BLEND = {"trend": 0.5, "value": 0.3, "text": 0.4}
_BLEND_SQL = f""", sc AS (SELECT instrument, date, greatest(-1, least(1, {sql_percent_rank('ret_21d', 'date')} * 2 - 1)) AS t, {sql_percent_rank('calm', 'date')} - 0.5::DOUBLE AS v, {sql_percent_rank('reversal', 'date')} * 3 AS x, instrument % 3 AS has FROM sig WHERE ret_21d IS NOT NULL AND calm IS NOT NULL)
SELECT instrument, date, {R('greatest(-1, least(1, 0.5 * t + 0.3 * v + CASE WHEN has > 0 THEN 0.4 * x ELSE 0 END))')} AS score, {R('(0.5 * 0.9 + 0.3 * 0.5 + CASE WHEN has > 0 THEN 0.4 * 0.2 ELSE 0 END) / (0.8 + CASE WHEN has > 0 THEN 0.4 ELSE 0 END)')} AS confidence FROM sc"""


@register("ensemble_scores", _sql(_SAMPLES, _BLEND_SQL))
def ensemble_scores(spark, folder):
    """Three sources, of which one does not score every row; so it is not required here."""
    rows = _samples(spark, folder).where("ret_21d IS NOT NULL AND calm IS NOT NULL")
    rows = ranked(rows, {"a": "ret_21d", "b": "calm", "c": "reversal"}, ["instrument", "date"], ["date"])
    rows = rows.select("instrument", "date", (F.col("a") * 2 - 1).alias("t"), (F.col("b") - 0.5).alias("v"), (F.col("c") * 3).alias("x"))
    said = [("trend", "t", 0.9, F.lit(True)), ("value", "v", 0.5, F.lit(True)), ("text", "x", 0.2, F.col("instrument") % 3 > 0)]
    long = rows.select("instrument", "date", F.explode(F.array(*[F.when(has, F.struct(F.lit(s).alias("source"), F.col(c).alias("score"), F.lit(sure).alias("confidence"))) for s, c, sure, has in said])).alias("e"))
    long = long.where("e IS NOT NULL").select("instrument", "date", "e.*")
    return out(targets.ensemble(long, _BLEND, ["instrument", "date"], required=False), ["instrument", "date"], ["score", "confidence"])


_LABELS = "CASE month(date) % 4 WHEN 0 THEN 'crisis' WHEN 1 THEN 'risk_on' WHEN 2 THEN 'transition' ELSE 'risk_off' END"
_PICK = f""", pick AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_21d DESC, instrument) AS nth, (0.95::DECIMAL(18, 6) * CASE month(date) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.75 ELSE 0.5 END)::DECIMAL(18, 9) AS room FROM sig WHERE ret_21d > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM pick WHERE nth <= 8),
named AS (SELECT *, CASE WHEN room <= n * 0.1::DECIMAL(18, 9) THEN round(room::DOUBLE / n, 18) ELSE 0.1::DOUBLE END AS w FROM sized WHERE room > 0 AND (room <= n * 0.1::DECIMAL(18, 9) OR nth <= floor(room::DOUBLE / 0.1::DOUBLE + 1e-9))),
fit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, coalesce(sector, 'UNKNOWN') ORDER BY nth) AS place FROM named) WHERE place * w <= 0.25::DOUBLE + 1e-12)"""
_CALM = "CASE WHEN instrument % 5 <> 0 THEN -calm END"


@register("vol_targets", _sql(_SAMPLES, _PICK + f""", v AS (SELECT *, {_CALM} AS vol FROM fit), sc AS (SELECT *, CASE WHEN vol > 0 THEN w * 0.15::DOUBLE / greatest(vol, 0.05::DOUBLE) ELSE w END AS s FROM v),
tw AS (SELECT *, round(least(s * sum(w) OVER (PARTITION BY date) / sum(s) OVER (PARTITION BY date), 0.1::DOUBLE) + 1e-13, 4) AS target_weight FROM sc)
SELECT date, instrument, coalesce(sector, 'UNKNOWN') AS sector, {R('w')} AS weight, {R('target_weight')} AS target_weight, {R('greatest(0, 1 - sum(target_weight) OVER (PARTITION BY date))')} AS cash FROM tw"""))
def vol_targets(spark, folder):
    """Long-only targets under market labels by month, then scaled to a volatility target."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("crisis", "risk_on", "transition", "risk_off")]), F.month("date") % 4 + 1)
    rows = _samples(spark, folder)
    book = targets.long_only_targets(rows.select("date", "instrument", "sector", F.col("ret_21d").alias("score"), label.alias("label")), n=8, sector_cap=0.25)
    vols = rows.select(F.col("date").alias("d"), F.col("instrument").alias("i"), F.when(F.col("instrument") % 5 != 0, -F.col("calm")).alias("vol"))
    got = targets.vol_targeted(book.join(vols, (F.col("date") == F.col("d")) & (F.col("instrument") == F.col("i"))).drop("d", "i"))
    return out(got.select("date", "instrument", "sector", *[F.col(c).cast("double").alias(c) for c in ("weight", "target_weight", "cash")]), ["date", "instrument", "sector"], ["weight", "target_weight", "cash"])


@register("signal_frames", _sql(_SAMPLES, """, book AS (SELECT date, instrument, 0.2::DOUBLE AS weight FROM sig WHERE ret_21d > 0 AND day(date) % 5 = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret_21d DESC, instrument) <= 5),
line AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt, lag(date) OVER (ORDER BY date) AS prv FROM (SELECT DISTINCT date FROM book)),
cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS trade FROM (SELECT DISTINCT date FROM bars)),
rows_of AS (SELECT b.date, b.instrument, b.weight, NOT EXISTS (SELECT 1 FROM book x WHERE x.date = prv AND x.instrument = b.instrument) AS entry, false AS exit FROM book b JOIN line USING (date)
  UNION ALL SELECT nxt, b.instrument, 0, false, true FROM book b JOIN line USING (date) WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM book x WHERE x.date = nxt AND x.instrument = b.instrument))
SELECT trade AS date, instrument, weight, entry, exit FROM rows_of JOIN cal USING (date) WHERE trade IS NOT NULL"""))
def signal_frames(spark, folder):
    from pyspark.sql import Window as W

    rows = _samples(spark, folder)
    nth = F.row_number().over(W.partitionBy("date").orderBy(F.col("ret_21d").desc(), "instrument"))
    book = settled(rows.where((F.col("ret_21d") > 0) & (F.dayofmonth("date") % 5 == 0)).withColumn("nth", nth).where("nth <= 5").select("date", "instrument", F.lit(0.2).alias("weight")))
    return targets.signal_frames(book, rows.select("date"))


@register("fundamentals_on_bars", f"""WITH {BARS_SQL}, {QUARTERS_SQL}, s AS (SELECT instrument, date AS statement_date, date + 45 AS known_at, netinc, equity FROM quarters),
j AS (SELECT b.instrument, b.date, s.statement_date, s.netinc, s.equity FROM bars b ASOF LEFT JOIN s ON b.instrument = s.instrument AND b.date >= s.known_at)
SELECT instrument, date, CASE WHEN date - statement_date <= 120 THEN statement_date END AS statement_date, {R('CASE WHEN date - statement_date <= 120 AND equity > 0 THEN netinc / equity END')} AS return_on_equity FROM j""")
def fundamentals_on_bars(spark, folder):
    """Statements known 45 days after their quarter begins, on the dates of the bars; stale after 120 days."""
    got = samples.statements_on_dates(bars(spark, folder).select("instrument", "date"), quarters(spark, folder), ["netinc", "equity"], known="date", max_age_days=120)
    ratio = F.when(F.col("equity") > 0, F.col("netinc") / F.col("equity"))
    return out(got.withColumn("return_on_equity", ratio), ["instrument", "date", "statement_date"], ["return_on_equity"])


@register("vendor_minutes", """WITH e AS (SELECT user_id AS instrument, CASE WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) WHEN event_id % 50 = 1 THEN NULL ELSE ts END AS ts FROM events),
k AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts)) AS step FROM e WHERE ts IS NOT NULL AND instrument IS NOT NULL)
SELECT 'empty' AS code, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS n FROM e UNION ALL SELECT 'off_minute', count(*) FILTER (WHERE epoch_us(ts) % 60000000 <> 0) FROM e UNION ALL SELECT 'unknown', count(*) FILTER (WHERE ts IS NULL OR instrument IS NULL) FROM e
UNION ALL SELECT 'gap', count(*) FILTER (WHERE step > 60000000) FROM k""")
def vendor_minutes(spark, folder):
    e = load(spark, folder, "events")
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("minute", "ts").cast("timestamp_ntz")).when(F.col("event_id") % 50 == 1, None).otherwise(F.col("ts"))
    return quality.minute_issues(e.select(F.col("user_id").alias("instrument"), at.alias("ts")))


@register("book_parity", """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS instrument, sum(l_tax)::DOUBLE AS weight, max(l_returnflag) AS side FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL),
b AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS instrument, sum(l_tax * CASE WHEN l_partkey % 7 = 0 THEN 0.9 ELSE 1 END)::DOUBLE AS weight, max(CASE WHEN l_partkey % 11 = 0 THEN 'Z' ELSE l_returnflag END) AS side FROM lineitem WHERE l_orderkey % 5 <> 1 GROUP BY ALL),
j AS (SELECT date, a.weight AS wa, b.weight AS wb, a.side AS sa, b.side AS sb FROM a FULL JOIN b USING (date, instrument))
SELECT date, count(*) AS compared, CASE WHEN count(wa) = 0 OR count(wb) = 0 THEN count(*) ELSE 0 END AS missing, count(*) FILTER (WHERE sa IS DISTINCT FROM sb) AS side_mismatches, """ + R("max(abs(coalesce(wa, 0) - coalesce(wb, 0)) * 1e4)") + " AS max_diff_bps FROM j GROUP BY date")
def book_parity(spark, folder):
    lines = load(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("instrument"), "l_tax", "l_partkey", "l_orderkey", "l_returnflag")
    shadow = lines.where("l_orderkey % 5 <> 0").select("date", "instrument", F.col("l_tax").alias("weight"), F.col("l_returnflag").alias("side"))
    weight = F.col("l_tax") * F.when(F.col("l_partkey") % 7 == 0, 0.9).otherwise(1.0)
    paper = lines.where("l_orderkey % 5 <> 1").select("date", "instrument", weight.alias("weight"), F.when(F.col("l_partkey") % 11 == 0, "Z").otherwise(F.col("l_returnflag")).alias("side"))
    return out(targets.book_parity(shadow, paper), ["date", "compared", "missing", "side_mismatches"], ["max_diff_bps"])


@register("economic_gate", """WITH f AS (SELECT p_partkey AS name, p_name || ' ' || p_type || ' ' || p_brand AS thesis, CASE WHEN p_size % 4 = 0 THEN 'non_monotonic' ELSE 'positive' END AS sign, p_size % 5 AS lags, p_size % 3 AS modes, CASE WHEN p_size % 2 = 0 THEN 'live' ELSE 'research' END AS state, (p_size - 25) / 100.0 AS ic FROM part),
b AS (SELECT name, list_filter([CASE WHEN length(trim(thesis)) < 30 THEN 'thesis' END, CASE WHEN lags = 0 THEN 'required_lags' END, CASE WHEN modes = 0 AND state = 'live' THEN 'failure_modes' END, CASE WHEN sign <> 'non_monotonic' AND ic < 0 THEN 'sign' END], lambda x: x IS NOT NULL) AS blockers FROM f)
SELECT name, array_to_string(blockers, ',') AS blockers, len(blockers) = 0 AS passed FROM b""")
def economic_gate(spark, folder):
    p, size = load(spark, folder, "part"), F.col("p_size")
    several = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    features = p.select(
        F.col("p_partkey").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("thesis"), F.when(size % 4 == 0, "non_monotonic").otherwise("positive").alias("expected_sign"),
        several(size % 5).alias("required_lags"), several(size % 3).alias("failure_modes"), F.when(size % 2 == 0, "live").otherwise("research").alias("state"), ((size - 25) / 100.0).alias("ic_mean"),
    )
    return audit.economic_gate(features).select("name", F.array_join("blockers", ",").alias("blockers"), "passed")


# --- eleven factors

FACTORS = library.STANDARD_FACTORS
_BUNDLE = f""", fl AS ({' UNION ALL '.join(f"SELECT instrument, date, '{f}' AS factor, {f} AS x FROM sig WHERE {f} IS NOT NULL" for f in FACTORS if f != 'realized_vol_21d')}),
fn AS (SELECT *, count(*) OVER (PARTITION BY date, factor) AS n, row_number() OVER (PARTITION BY date, factor ORDER BY x) - 1 AS k FROM fl),
fc AS (SELECT *, least(greatest(x, min(CASE WHEN k >= floor(n * 0.05::DOUBLE) THEN x END) OVER (PARTITION BY date, factor)), max(CASE WHEN k <= ceil(n * 0.95::DOUBLE) - 1 THEN x END) OVER (PARTITION BY date, factor)) AS c FROM fn),
fr AS (SELECT instrument, date, factor, CASE WHEN n > 1 THEN 2 * ({sql_average_rank('c', 'date', 'factor')} - 1) / (n - 1) - 1 ELSE 0 END AS r FROM fc),
fw AS (SELECT instrument, date, count(*) AS hits, {', '.join(f"max(r) FILTER (WHERE factor = '{f}') AS {f}" for f in FACTORS if f != 'realized_vol_21d')} FROM fr GROUP BY ALL),
fa AS (SELECT date, count(DISTINCT factor) AS alive FROM fr GROUP BY date)
SELECT fw.instrument, fw.date, {', '.join(f'{R(f"fw.{f}")} AS {f}' for f in FACTORS if f != 'realized_vol_21d')}, {R('sig.realized_vol_21d')} AS realized_vol_21d FROM fw JOIN fa USING (date) JOIN sig ON sig.instrument = fw.instrument AND sig.date = fw.date WHERE hits >= ceil(alive / 2)"""


@register("factor_bundle", _sql(FACTORS, _BUNDLE))
def factor_bundle(spark, folder):
    alphas = [f for f in FACTORS if f != "realized_vol_21d"]
    rows = settled(evaluate(bars(spark, folder), FACTORS, ["instrument", "date"]))
    got = crosssection.factor_bundle(rows, alphas).join(rows.select("instrument", "date", "realized_vol_21d"), ["instrument", "date"])
    return out(got, ["instrument", "date"], [*alphas, "realized_vol_21d"])


# --- filings, tracked scores

@register("filing_documents", """SELECT o_custkey AS cik, o_orderkey::VARCHAR || '-01' AS accession, ((row_number() OVER w) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END - 1)::INT AS nth, 'ex99-' || l_partkey || '.htm' AS document_name, CASE WHEN l_partkey % 4 = 0 THEN 'GRAPHIC' ELSE 'EX-99.1' END AS document_type,
'results & ' || l_returnflag AS description, CASE WHEN l_partkey % 2 = 0 THEN 'https://www.sec.gov/Archives/x/' || o_orderkey || '/ex99-' || l_partkey || '.htm' ELSE 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '01/ex99-' || l_partkey || '.htm' END AS source_uri, l_partkey = first_value(l_partkey) OVER w AS is_primary, l_partkey % 4 <> 0 AS textual
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag)""")
def filing_documents(spark, folder):
    """Index pages written from the lines of each order, then parsed again."""
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))

    def row(line):
        part = line["l_partkey"]
        name = F.concat(F.lit("ex99-"), part.cast("string"), F.lit(".htm"))
        link = F.when(part % 2 == 0, F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a>"))).otherwise(name)
        kind = F.when(part % 4 == 0, "graphic").otherwise("ex-99.1")
        return F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(F.lit("results &amp; "), line["l_returnflag"]), cell(link), cell(kind), F.lit("</tr>\n"))

    # an order's lines meet once: the set drops repeats, and rows are written after the shuffle
    pages = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.struct("l_partkey", "l_returnflag"))).alias("rows"))
    head = F.when(F.col("l_orderkey") % 3 == 0, F.lit("<table>")).otherwise(F.lit("<TABLE><tr><th>Seq<th>Description<th>Document<th>Type</tr>"))
    html = F.concat(head, F.array_join(F.transform("rows", row), ""), F.lit("</table>"))
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("cik"))
    first = F.concat(F.lit("ex99-"), F.get("rows", F.lit(0))["l_partkey"].cast("string"), F.lit(".htm"))
    pages = pages.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "cik", F.concat(F.col("o_orderkey").cast("string"), F.lit("-01")).alias("accession"), first.alias("primary_document"), F.concat(F.lit("https://www.sec.gov/Archives/x/"), F.col("o_orderkey").cast("string"), F.lit("/index.html")).alias("url"), html.alias("html")
    )
    return filings.filing_documents(pages).withColumn("textual", filings.is_textual())


@register("rolling_score_ic", f"""WITH s AS (SELECT event_type AS strategy, CAST(ts AS DATE) AS as_of, user_id AS instrument, round(avg(value) / 10, 1) AS score, 10 + max(value) AS price FROM events GROUP BY ALL),
c AS (SELECT strategy, as_of, lag(as_of) OVER (PARTITION BY strategy ORDER BY as_of) AS before FROM (SELECT DISTINCT strategy, as_of FROM s)),
m AS (SELECT c.strategy, c.as_of, a.score AS x, (b.price - a.price) / a.price AS y FROM c LEFT JOIN s b ON b.strategy = c.strategy AND b.as_of = c.as_of LEFT JOIN s a ON a.strategy = c.strategy AND a.as_of = c.before AND a.instrument = b.instrument),
i AS (SELECT strategy, as_of, count(x) AS n, {_corr('rx', 'ry')} AS ic FROM (SELECT strategy, as_of, x, {sql_average_rank('x', 'strategy', 'as_of')} AS rx, {sql_average_rank('y', 'strategy', 'as_of')} AS ry FROM m) GROUP BY ALL),
l AS (SELECT *, list(ic) FILTER (WHERE ic IS NOT NULL) OVER (PARTITION BY strategy ORDER BY as_of) AS ics FROM i)
SELECT strategy, as_of, n::INT AS n, {R('ic')} AS ic, {R('CASE WHEN len(ics) >= 2 THEN list_avg(ics[-10:]) END')} AS rolling_ic, least(coalesce(len(ics), 0), 10)::INT AS observations FROM l""")
def rolling_score_ic(spark, folder):
    rows = load(spark, folder, "events").groupBy(F.col("event_type").alias("strategy"), F.to_date("ts").alias("as_of"), F.col("user_id").alias("instrument"))
    return out(tracking.rolling_ic(rows.agg(F.round(F.avg("value") / 10, 1).alias("score"), (10 + F.max("value")).alias("price")), 10), ["strategy", "as_of", "n", "observations"], ["ic", "rolling_ic"])
