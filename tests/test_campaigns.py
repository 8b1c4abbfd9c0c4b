"""Campaigns, market labels, evidence, targets, sequences, filings and tracked scores against plain computations."""

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodepanel.functions import library
from lodepanel.operators import audit, campaign, crosssection, decay, evaluate, evidence, fitting, quality, regime, risk, samples, sequences, targets
from lodepanel.sources import calendar, filings, records
from lodepanel.streaming import tracking

DAY = timedelta(days=1)


def panel(spark, rng, days=60, names=12, features=("a", "b")):
    rows = []
    for d in range(days):
        for i in range(names):
            x = rng.normal(size=len(features))
            rows.append((i, date(2020, 1, 1) + d * DAY, d + 1, d + 4, *map(float, x), float(x[0] * 0.5 + x[1] * 0.1 + rng.normal()), float(rng.normal() / 100)))
    schema = "instrument long, date date, day int, label_end_index int, " + ", ".join(f"{f} double" for f in features) + ", y double, r double"
    return rows, spark.createDataFrame(rows, schema)


def folds(n=3):
    start = date(2020, 1, 1)
    return [evaluate.Fold(k, start + 10 * k * DAY, start + (10 * k + 20) * DAY, start + (10 * k + 20) * DAY, start + (10 * k + 30) * DAY) for k in range(n)]


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def spearman(x, y):
    a, b = ranks(x), ranks(y)
    return 0.0 if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])


# --- campaigns


def test_training_rows_whose_labels_reach_the_test_go(spark):
    _, df = panel(spark, np.random.default_rng(0))
    kept = campaign.fold_samples(df.withColumn("first_day", F.lit("clash")), folds())
    got = kept.groupBy("fold", "part").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.max("label_end_index").alias("ends")).collect()
    assert {(r.fold, r.part): (r.lo, r.hi) for r in got} == {(k, p): v for k in range(3) for p, v in (("train", (10 * k + 1, 10 * k + 17)), ("test", (10 * k + 21, 10 * k + 30)))}
    assert "first_day" in kept.columns


@pytest.mark.parametrize("model", ["ic", "robust", "ridge", "equal"])
def test_weights_of_all_folds_are_those_of_each_alone(spark, model):
    rows, df = panel(spark, np.random.default_rng(1))
    kept = campaign.fold_samples(df, folds())
    settings = {"min_names": 5} if model == "robust" else {}
    got = {(r.fold, r.feature): r.weight for r in campaign.fold_weights(kept, ["a", "b"], "y", model, **settings).collect()}
    assert len(got) == 6
    for k in range(3):
        train = [r for r in rows if 10 * k + 1 <= r[2] <= 10 * k + 20 and r[3] < 10 * k + 21]
        x, y = np.array([r[4:6] for r in train]), np.array([r[6] for r in train])
        if model == "ic":
            raw = [max(0.0, spearman(x[:, j], y)) for j in (0, 1)]
        elif model == "ridge":
            raw = fitting.nonnegative(x.T @ x, x.T @ y, 1e-3)
        elif model == "equal":
            raw = [1.0, 1.0]
        else:
            raw = []
            for j in (0, 1):
                ics = sorted(spearman([r[4 + j] for r in train if r[2] == d], [r[6] for r in train if r[2] == d]) for d in {r[2] for r in train})
                worst = ics[: max(1, int(len(ics) * 0.33))]
                raw.append(max(0.0, np.mean(ics) + 2 * np.mean(worst)))
        total = sum(raw)
        want = [w / total if total > 0 else 0.5 for w in raw]
        assert np.allclose([got[k, "a"], got[k, "b"]], want)


def test_days_of_a_campaign_against_a_plain_walk(spark):
    rows, df = panel(spark, np.random.default_rng(2))
    df = df.where(~((F.col("instrument") == 3) & (F.col("day") == 25)))  # a held name without a row
    weights, days, report = campaign.walk_forward(df, folds(), ["a", "b"], "y", "r", bps=20.0)
    w = {(r.fold, r.feature): r.weight for r in weights.collect()}
    got = {(r.fold, r.date): r for r in days.collect()}
    book_before, want = {}, {}
    for k in range(3):
        test = [r for r in rows if 10 * k + 21 <= r[2] <= 10 * k + 30 and not (r[0] == 3 and r[2] == 25)]
        book = None
        for d in sorted({r[2] for r in test}):
            day = [r for r in test if r[2] == d]
            n = len(day)
            score = w[k, "a"] * ranks([r[4] for r in day]) / n + w[k, "b"] * ranks([r[5] for r in day]) / n
            turnover = 0.0
            if book is None:
                book = {r[0]: s / np.abs(score).sum() for r, s in zip(day, score, strict=True)}
                turnover = sum(abs(book.get(i, 0) - book_before.get(i, 0)) for i in set(book) | set(book_before))
                book_before = book
            gross = sum(book.get(r[0], 0) * r[7] for r in day)
            want[k, day[0][1]] = (spearman(score, [r[6] for r in day]), gross, turnover, gross - turnover * 0.002)
    assert set(got) == set(want)
    for key, values in want.items():
        assert np.allclose([got[key].ic, got[key].gross, got[key].turnover, got[key].net], values, atol=1e-9), key
    assert [r.streak_reason for r in report.orderBy("fold").collect()] == ["warmup"] * 3


def test_streak_scale_against_a_plain_walk(spark):
    ics = [0.01, -0.01, 0.02, None, 0.0, -0.02, -0.01, -0.03, -0.01, 0.05, -0.001, 0.01]
    df = spark.createDataFrame(list(enumerate(ics)), "fold int, mean_ic double")
    for r in campaign.streak_scales(df).collect():
        past = ics[: r.fold]
        run = 0
        for x in reversed(past):
            if x is None or x >= 0:
                break
            run += 1
        ages = [(len(past) - 1 - i, x) for i, x in enumerate(past) if x is not None]
        mean = sum(0.5 ** (a / 4) * x for a, x in ages) / sum(0.5 ** (a / 4) for a, _ in ages) if ages else 0.0
        scale = 1.0 if len(past) < 4 else 0.0 if run >= 3 else max(0.0, min(1.0, (mean + 0.02) / 0.02))
        assert (r.negative_run, r.ewma_ic, r.streak_scale) == (run, pytest.approx(mean), pytest.approx(scale))


def test_volatility_scale_of_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(k, date(2020, 1, 1) + d * DAY, float(rng.normal(0, 0.01 * (k + 1)))) for k in range(3) for d in range(90 if k else 1)]
    got = {r.fold: (r.volatility, r.vol_scale) for r in campaign.volatility_scales(spark.createDataFrame(rows, "fold int, date date, net double")).collect()}
    assert got[0] == (0.0, 1.0)
    for k in (1, 2):
        vol = np.std([r[2] for r in rows if r[0] == k][-63:], ddof=1) * 252**0.5
        assert got[k] == (pytest.approx(vol), pytest.approx(min(1.0, 0.1 / vol)))


def test_ridge_strength_equals_refitting_without_each_date(spark):
    rows, df = panel(spark, np.random.default_rng(4), days=9, names=6, features=("a", "b", "c"))
    odd = spark.createDataFrame([(1, date(2021, 1, 1), 1, 2, 1.0, None, 1.0, 9.0, 0.0), (1, date(2021, 2, 1), 1, 2, 1.0, 0.5, 1.0, 9.0, 0.0)], df.schema)
    strengths = (1e-4, 1.0, 50.0)
    got = {r.l2: r for r in campaign.ridge_by_ic(df.unionByName(odd), ["a", "b", "c"], "y", candidates=strengths).collect()}
    every = rows + [(1, date(2021, 2, 1), 1, 2, 1.0, 0.5, 1.0, 9.0, 0.0)]
    means = {}
    for l2 in strengths:
        ics = []
        for d in sorted({r[1] for r in rows}):
            train, test = [r for r in every if r[1] != d], [r for r in every if r[1] == d]
            x, y = np.array([r[4:7] for r in train]), np.array([r[7] for r in train])
            w = fitting.nonnegative(x.T @ x, x.T @ y, l2)
            if w.sum() > 0:
                ics.append(spearman(np.array([r[4:7] for r in test]) @ w, [r[7] for r in test]))
        means[l2] = (np.mean(ics), len(ics))
        assert (got[l2].mean_ic, got[l2].dates) == (pytest.approx(means[l2][0]), means[l2][1])
    assert [l2 for l2, r in got.items() if r.chosen] == [max(strengths, key=lambda s: (round(means[s][0], 12), -s))]
    none = campaign.ridge_by_ic(df.limit(0), ["a", "b"], "y", fallback=0.7).collect()
    assert [(r.l2, r.dates, r.chosen) for r in none] == [(0.7, 0, True)]


def test_blocs_share_the_weight(spark):
    rows, df = panel(spark, np.random.default_rng(5), features=("a", "b", "c"))
    got = {r.feature: r for r in campaign.calibrate(df, {"one": (["a", "b"], 0.9), "two": (["c"], 0.1)}, "y", l2=0.01).collect()}
    x, y = np.array([r[4:6] for r in rows]), np.array([r[7] for r in rows])
    w = fitting.nonnegative(x.T @ x, x.T @ y, 0.01)
    r2 = 1 - ((y - x @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert got["a"].r2 == pytest.approx(r2) and got["a"].n == len(rows)
    assert got["a"].weight / got["b"].weight == pytest.approx(w[0] / w[1])
    assert sum(r.weight for r in got.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="sum to 1"):
        campaign.calibrate(df, {"one": (["a"], 0.5)}, "y", l2=1.0)


# --- market labels


def plain_label(vol, trend, breadth, now):
    if vol >= 0.35:
        return "crisis", min(1.0, (vol - 0.35) / 0.10 + 0.8)
    if now == "crisis" and vol >= 0.345 or vol >= 0.25 and trend <= -0.05:
        return "crisis", 0.75
    bad = (vol >= (0.245 if now == "risk_off" else 0.25)) + (trend <= -0.05) + (breadth <= 0.4)
    if bad:
        return "risk_off", 0.5 + 0.15 * bad
    if vol < (0.205 if now == "risk_on" else 0.2) and trend >= 0.02 and breadth >= 0.55:
        return "risk_on", 0.6 + 0.4 * min((0.2 - vol) / 0.2, trend / 0.02, (breadth - 0.55) / 0.45)
    return "transition", 0.5


def test_regimes_by_composed_maps_equal_a_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for series, n in (("long", 64 * 66), ("one", 1), (None, 130)):
        label, last, run, stats = "transition", None, 0, (0.2, 0.02, 0.6)
        for k in range(n):
            if rng.random() < 0.3:
                stats = rng.choice([0.15, 0.19, 0.2025, 0.23, 0.2475, 0.26, 0.3475, 0.36, 0.4]), rng.choice([-0.1, -0.05, 0.0, 0.02, 0.05]), rng.choice([0.3, 0.4, 0.5, 0.55, 0.7])
            rows.append((series, date(2000, 1, 1) + k * DAY, *stats, "state"))
            seen, sure = plain_label(*stats, label)
            run, last = (run + 1 if seen == last else 1), seen
            label = seen if run >= 3 else label
            want[series, rows[-1][1]] = seen, label, round(round(min(1.0, sure), 4) * (1 if label == seen else 0.75), 6)
    df = spark.createDataFrame(rows, "series string, date date, vol double, trend double, breadth double, state string")
    got = regime.regime_states(df)
    assert got.columns == [*df.columns, "candidate", "label", "confidence"]
    assert {(r.series, r.date): (r.candidate, r.label, round(r.confidence, 6)) for r in got.collect()} == want
    assert {x[1] for x in want.values()} == set(regime.LABELS)
    assert regime.regime_states(df.limit(0)).count() == 0
    missing = spark.createDataFrame([("a", date(2000, 1, 1), None, None, None)], "series string, date date, vol double, trend double, breadth double")
    assert [(r.candidate, r.label) for r in regime.regime_states(missing).collect()] == [("transition", "transition")]


# --- evidence and promotion


def test_folds_of_dates_are_trimmed_and_counted(spark):
    df = spark.createDataFrame([(date(2020, 1, 1) + d * DAY,) for d in range(101)], "date date")
    got = {}
    for r in evidence.date_folds(df, folds=3, embargo=4, least=20).collect():
        got.setdefault(r.fold, []).append((r.date - date(2020, 1, 1)).days)
    bounds = np.linspace(0, 101, 4, dtype=int)
    assert {k: (min(v), max(v) + 1) for k, v in got.items()} == {0: (0, bounds[1] - 4), 1: (bounds[1] + 4, bounds[2] - 4), 2: (bounds[2] + 4, 101)}
    assert evidence.date_folds(df, folds=6, embargo=4, least=20).count() == 0
    assert {r.fold for r in evidence.date_folds(df, folds=4, embargo=4, least=20).collect()} == {0, 3}  # inner parts fall below the least


def test_twenty_expressions_scan_the_panel_once(spark):
    from lodepanel.functions.expr import evaluate as compiled
    from lodepanel.sources.tables import bars

    exprs = {f"e{n}": -library.call("ts_std", library.CLOSE, n) / library.call("ts_mean", library.CLOSE, n) for n in range(2, 22)}
    got = compiled(bars(spark, "/root/testdata/sf0.001"), exprs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("lineitem" in line or "l_shipdate" in line and "Relation" in line for line in plan.splitlines() if "Relation" in line) == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 3  # lines, suppliers, nations


def test_promotion_is_the_plain_greedy_choice(spark):
    names = ["p", "q", "r", "s", "t"]
    good = (0.1, 1.0, 0.1, 200, 0, 4)
    rows = [(n, *good) for n in names[:4]] + [("t", 0.1, None, 0.1, 200, 0, 4)]
    ev = spark.createDataFrame(rows, "name string, rank_ic double, icir double, turnover double, dates long, negative_folds int, valid_folds int")
    corr = {("q", "p"): -0.8, ("r", "q"): 0.9, ("s", "r"): 0.51, ("s", "lib"): 0.1, ("p", "lib"): 0.2}
    matrix = spark.createDataFrame([(a, b, c) for (a, b), c in corr.items()], "a string, b string, corr double")
    got = {r.name: (r.promoted, r.failed) for r in evidence.promotions(ev, matrix, [*names, "unknown"], library=["lib"]).collect()}
    # q is like p; r is like q, which was not promoted; s is like r.
    assert got == {"p": (True, []), "q": (False, ["correlation"]), "r": (True, []), "s": (False, ["correlation"]), "t": (False, ["icir"]), "unknown": (False, ["evidence"])}
    bad = spark.createDataFrame([("x", 0.0, 0.0, 0.9, 1, 9, 0)], ev.schema)
    assert bad.select(evidence.failed_checks().alias("f")).first().f == ["rank_ic", "icir", "turnover", "dates", "negative_folds", "valid_folds"]


# --- sequences, decays


def test_sequences_are_padded_masked_and_go_on_from_training(spark):
    days = [1, 2, 5, 6, 30, 31]
    rows = [(i, d, float(d * (i + 1)), 7.0, "x") for i in range(2) for d in days] + [(9, 31, None, 7.0, "x")]
    df = spark.createDataFrame(rows, "instrument int, day int, a double, flat double, means string")
    got = {(r.instrument, r.day): r for r in sequences.sequences(df, ["a", "flat"], 4, F.col("day") <= 6, keep=F.col("day") > 6).collect()}
    train = np.array([r[2] for r in rows if r[1] <= 6])
    z = lambda v: (v - train.mean()) / train.std()
    assert set(got) == {(0, 30), (0, 31), (1, 30), (1, 31), (9, 31)}
    want = [[z(d * 2.0), 0.0, math.log1p(g)] for d, g in ((2, 1), (5, 3), (6, 1), (30, 24))]
    assert np.allclose(got[1, 30].sequence, want) and got[1, 30].mask == [1, 1, 1, 1]
    assert got[9, 31].mask == [0, 0, 0, 1] and np.allclose(got[9, 31].sequence, [[0] * 3] * 3 + [[z(0.0), 0.0, 0.0]]) and got[9, 31].means == "x"


def test_decayed_means_of_all_horizons_equal_each_range_join(spark):
    rng = random.Random(5)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(100 * 24 * 60))
    history = [(i, at(), rng.uniform(-5, 5)) for i in range(4) for _ in range(60)] + [(1, None, 3.0), (1, datetime(2024, 1, 3), None)]
    asked = [(i, at(), "x") for i in range(5) for _ in range(20)] + [(0, history[3][1], "x"), (0, history[3][1], "x"), (0, history[3][1] + timedelta(days=10), "x")]
    h = spark.createDataFrame(history, "instrument int, at timestamp_ntz, value double")
    a = spark.createDataFrame(asked, "instrument int, as_of timestamp_ntz, asked_row string")
    got = decay.decayed_means(a, h, "value", [3, 10, 45], bucket="week")
    assert got.columns == ["instrument", "as_of", "asked_row", "mean_3", "mean_10", "mean_45"]
    rows = got.collect()
    assert len(rows) == len(asked)
    for days in (3, 10, 45):
        each = {(r.instrument, r.as_of): r["mean"] for r in samples.decayed_mean(a.select("instrument", "as_of").distinct(), h.where("at IS NOT NULL AND value IS NOT NULL"), "value", days).collect()}
        assert all(r[f"mean_{days}"] == pytest.approx(each[r.instrument, r.as_of], abs=1e-6) for r in rows)


# --- targets


def test_long_only_targets_respect_every_cap(spark):
    rows = [(1, i, "tech" if i < 4 else None if i == 4 else "oil", 10.0 - i, "risk_on") for i in range(8)] + [(2, i, "tech", 1.0, "crisis") for i in range(3)] + [(3, 0, "tech", -1.0, "risk_on")] + [(4, i, "s", 1.0, "risk_off") for i in range(2)]
    df = spark.createDataFrame(rows, "date int, instrument int, sector string, score double, label string")
    got = {}
    for r in targets.long_only_targets(df, n=7, cash=0.05, name_cap=0.2, sector_cap=0.45).collect():
        got.setdefault(r.date, {})[r.instrument] = r.weight
    even = (Decimal("0.95") / 7).quantize(Decimal("1e-12"))
    assert got[1] == {i: even for i in (0, 1, 2, 4, 5, 6)}  # the fourth of tech is beyond the sector's cap
    assert set(got) == {1, 4} and got[4] == {0: Decimal("0.2"), 1: Decimal("0.2")}  # 0.475 over two names is cut to the cap


def test_vol_targets_keep_exposure_in_decimals(spark):
    rows = [(1, 0, Decimal("0.1"), 0.3), (1, 1, Decimal("0.1"), 0.01), (1, 2, Decimal("0.1"), None), (1, 3, Decimal("0.1"), -1.0)]
    got = {r.instrument: r for r in targets.vol_targeted(spark.createDataFrame(rows, "date int, instrument int, weight decimal(10,4), vol double"), name_cap=0.18).collect()}
    scaled = [Decimal("0.1") * Decimal("0.15") / Decimal("0.3"), Decimal("0.1") * Decimal("0.15") / Decimal("0.05"), Decimal("0.1"), Decimal("0.1")]
    want = [min(s * Decimal("0.4") / sum(scaled), Decimal("0.18")).quantize(Decimal("0.0001")) for s in scaled]
    assert [got[i].target_weight for i in range(4)] == want and got[0].cash == 1 - sum(want) and want[1] == Decimal("0.1800")


def test_a_missing_source_raises_when_the_score_is_computed(spark):
    schema = "instrument int, source string, score double, confidence double, version string"
    rows = [(1, "a", 0.5, 0.8, "v1"), (1, "b", 1.0, 0.4, "v1"), (2, "a", -3.0, 0.5, "v1"), (1, "unused", 9.0, 9.0, "v9")]
    df = spark.createDataFrame(rows, schema)
    got = {r.instrument: (r.score, r.confidence) for r in targets.ensemble(df, {"a": 0.6, "b": 0.4, "off": 0.0}, ["instrument"], required=False).collect()}
    assert got == {1: (pytest.approx(0.7), pytest.approx((0.8 * 0.6 + 0.4 * 0.4) / 1.0)), 2: (-1.0, pytest.approx(0.5))}
    closed = targets.ensemble(df, {"a": 0.6, "b": 0.4}, ["instrument"])
    with pytest.raises(Exception, match="source b has no score"):
        closed.agg(F.sum("score")).collect()
    with pytest.raises(Exception, match="is of version"):
        targets.ensemble(df, {"a": 1.0}, ["instrument"], versions={"a": "v2"}).collect()
    with pytest.raises(Exception, match="outside 0 to 1"):
        targets.ensemble(df, {"unused": 1.0}, ["instrument"], required=False).select("confidence").collect()


def test_signal_frames_enter_hold_and_leave(spark):
    t = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (3, "a", 0.4), (3, "c", 0.6), (5, "b", 1.0)], "date int, instrument string, weight double")
    got = {(r.date, r.instrument): (r.weight, r.entry, r.exit) for r in targets.signal_frames(t, spark.range(1, 7).selectExpr("int(id) AS date")).collect()}
    assert got == {
        (2, "a"): (0.5, True, False), (2, "b"): (0.5, True, False), (4, "a"): (0.4, False, False), (4, "b"): (0.0, False, True), (4, "c"): (0.6, True, False),
        (6, "a"): (0.0, False, True), (6, "c"): (0.0, False, True), (6, "b"): (1.0, True, False),
    }


def test_bundle_needs_half_of_the_living_factors(spark):
    rows = [(i, 1, float(i), float(-i) if i < 3 else None, None, None) for i in range(5)] + [(9, 1, None, None, 1.0, None)]
    got = {r.instrument: (r.a, r.b, r.c, r.d) for r in crosssection.factor_bundle(spark.createDataFrame(rows, "instrument int, date int, a double, b double, c double, d double"), ["a", "b", "c", "d"], lower=0.0, upper=0.0).collect()}
    assert got == {0: (-1.0, 1.0, None, None), 1: (-0.5, 0.0, None, None), 2: (0.0, -1.0, None, None)}  # three factors live, two are needed


# --- filings


PAGE = """<html><table class="tableFile">
<tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th><th>Size</th></tr>
<tr><td>1</td><td>Annual &amp; report</td><td><a href="/Archives/edgar/data/1/2/main.htm">main.htm</a></td><td>10-k</td></tr>
<TR><TD>2<TD>Press <b>release</b><TD><a href='sub/ex991.htm'>ex991.htm</a><TD>ex-99.1
<tr><td>3</td><td></td><td>chart.jpg</td><td>GRAPHIC</td></tr>
<tr><td>4</td><td>none</td><td> </td><td>XML</td></tr><tr><td>too</td><td>short</td></tr>
</table><table><tr><td>5</td><td>outer <table><tr><td>inner</td></tr></table></td><td>late.txt</td><td>EX-10"""


def test_documents_of_an_index_page(spark):
    pages = spark.createDataFrame([("0000123", "0001-22-3", "main.htm", "https://www.sec.gov/a/b/index.html", PAGE), ("7", "8", None, None, None), ("7", "8", None, "", "")], "cik string, accession string, primary_document string, url string, html string")
    got = {r.document_name: r for r in filings.filing_documents(pages).withColumns({"text": filings.is_textual(), "release": filings.is_release()}).collect()}
    assert set(got) == {"main.htm", "ex991.htm", "chart.jpg", "late.txt"}
    assert (got["main.htm"].source_uri, got["main.htm"].description, got["main.htm"].document_type, got["main.htm"].is_primary) == ("https://www.sec.gov/Archives/edgar/data/1/2/main.htm", "Annual & report", "10-K", True)
    assert (got["ex991.htm"].source_uri, got["ex991.htm"].description) == ("https://www.sec.gov/a/b/sub/ex991.htm", "Press release")
    assert got["chart.jpg"].source_uri == "https://www.sec.gov/Archives/edgar/data/123/0001223/chart.jpg"
    assert {n for n, r in got.items() if r.text} == {"main.htm", "ex991.htm", "late.txt"} and {n for n, r in got.items() if r.release} == {"ex991.htm"}
    assert (["inner"], []) in filings.table_rows(PAGE) and filings.table_rows("<td>a</td></tr>") == []


# --- tracked scores


def scored(rng, cycles, names=6):
    rows = []
    for c in range(cycles):
        for i in range(names):
            if rng.random() < 0.85:
                rows.append((c % 7 == 6 and "b" or "a", datetime(2024, 1, 1) + c * DAY, f"n{i}", None if rng.random() < 0.1 else round(rng.uniform(-1, 1), 1), rng.choice([None, 0.0, 5.0, 7.5, 10.0, 11.0])))
    return rows


def test_stream_of_scores_equals_the_table_over_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "strategy string, as_of timestamp, instrument string, score double, price double"
        rows = scored(random.Random(8), 24)
        rows += [("a", datetime(2024, 6, 1), "end", 0.0, 1.0), ("b", datetime(2024, 6, 1), "end", 0.0, 1.0)]  # moves the watermark
        halves = [[r for r in rows if r[1] < datetime(2024, 1, 12)], [r for r in rows if r[1] >= datetime(2024, 1, 12)]]
        folder = str(tmp_path / "in")
        for half in halves:  # the second run goes on from the first one's checkpoint
            spark.createDataFrame(half, schema).repartition(3).write.mode("append").parquet(folder)
            stream = tracking.rolling_ic_stream(spark.readStream.schema(schema).parquet(folder), window=4)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = {(r.strategy, r.as_of): (r.n, r.ic, r.rolling_ic, r.observations) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        table = tracking.rolling_ic(spark.createDataFrame(rows, schema), window=4)
        want = {(r.strategy, r.as_of): (r.n, r.ic, r.rolling_ic, r.observations) for r in table.collect() if r.as_of < datetime(2024, 6, 1)}
        real = lambda x: None if x is None or x != x else round(x, 9)
        assert {k: (v[0], real(v[1]), real(v[2]), v[3]) for k, v in got.items() if k in want} == {k: (v[0], real(v[1]), real(v[2]), v[3]) for k, v in want.items()}
        assert sum(v[1] is not None for v in want.values()) > 8
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# --- calendar, context, parity, names


def test_sessions_of_known_years(spark):
    days = calendar.research_dates(spark, date(1996, 1, 1), date(2025, 12, 31))
    got = {r.y: r.n for r in days.groupBy(F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {1997: 253, 2001: 248, 2004: 252, 2007: 251, 2011: 252, 2012: 250, 2018: 251, 2020: 253, 2021: 252, 2022: 251, 2023: 250, 2024: 252, 2025: 250}
    assert {y: got[y] for y in known} == known
    easter = {r.y: r.d for r in spark.createDataFrame([(y,) for y in (1999, 2000, 2008, 2019, 2024, 2038)], "y int").select("y", calendar.good_friday(F.col("y")).alias("d")).collect()}
    assert easter == {1999: date(1999, 4, 2), 2000: date(2000, 4, 21), 2008: date(2008, 3, 21), 2019: date(2019, 4, 19), 2024: date(2024, 3, 29), 2038: date(2038, 4, 23)}
    assert calendar.research_dates(spark, date(2024, 1, 1), date(2024, 1, 7), "calendar-days").count() == 7
    with pytest.raises(ValueError, match="before the start"):
        calendar.research_dates(spark, date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError, match="no policy"):
        calendar.research_dates(spark, date(2024, 1, 1), date(2024, 1, 2), "other")


def test_event_context_counts_the_age_of_the_bound(spark):
    at = datetime(2024, 3, 10)
    events = [(1, at - timedelta(days=d)) for d in (0, 1, 2, 2.5, 7, 40)] + [(1, at + DAY), (2, at - timedelta(days=30))]
    asked = spark.createDataFrame([(1, at, 5), (2, at, 6), (3, at, 7)], "instrument int, as_of timestamp_ntz, t int")
    got = {r.instrument: r for r in decay.event_context(asked, spark.createDataFrame(events, "instrument int, at timestamp_ntz"), (1, 2, 7), bucket="day").collect()}
    assert (got[1].count_1, got[1].count_2, got[1].count_7, got[1].days_since) == (pytest.approx(2 / 3), 1.0, 1.0, pytest.approx(0.0))
    assert (got[1].density_1, got[1].density_2, got[1].recency_2, got[1].t) == (pytest.approx(1.0), pytest.approx(1.5 / 2), pytest.approx(1.0), 5)
    assert got[1].density_7 == pytest.approx(sum(1 - d / 7 for d in (0, 1, 2, 2.5, 7)) / 7)
    assert (got[2].count_7, got[2].recency_7, got[2].days_since) == (0.0, 0.0, pytest.approx(30.0)) and got[3].days_since == 999.0


def test_parity_of_two_books(spark):
    schema = "date int, instrument string, weight double, side string"
    a = spark.createDataFrame([(1, "x", 0.5, "buy"), (1, "y", 0.5, None), (2, "x", 1.0, "buy")], schema)
    b = spark.createDataFrame([(1, "x", 0.4, "sell"), (1, "z", 0.1, None)], schema)
    got = {r.date: (r.compared, r.missing, round(r.max_diff_bps, 6), r.side_mismatches) for r in targets.book_parity(a, b).collect()}
    assert got == {1: (3, 0, 5000.0, 1), 2: (1, 1, 10000.0, 1)}


def test_helper_columns_leave_a_users_columns_alone(spark):
    w = spark.createDataFrame([("a", 0.5, 7, 8, 9, 1), ("b", 0.5, 7, 8, 9, 1)], "instrument string, weight double, vol int, scaled int, after int, _vol int")
    v = spark.createDataFrame([("a", 1.0), ("b", 4.0)], "instrument string, variance double")
    got = {r.instrument: r for r in risk.inverse_vol_scale(w, v).collect()}
    assert (got["a"].vol, got["a"].scaled, got["a"].after, got["a"]._vol) == (7, 8, 9, 1) and got["a"].weight == pytest.approx(2 / 3)
    capped = risk.cap_factors(w.withColumnRenamed("vol", "_scale").withColumnRenamed("after", "scale"), spark.createDataFrame([("a", "f", 1.0)], "instrument string, factor string, loading double"), 0.25)
    assert {r.instrument: (r.weight, r._scale, r.scale) for r in capped.collect()} == {"a": (pytest.approx(0.25), 7, 9), "b": (0.5, 7, 9)}


def test_permuted_ics_deal_within_dates(spark):
    rng = np.random.default_rng(6)
    rows = [(i, date(2020, 1, 1) + d * DAY, float(rng.integers(4)), float(rng.normal())) for d in range(6) for i in range(7)] + [(i, date(2021, 1, 1), 1.0, 1.0) for i in range(5)] + [(1, date(2022, 1, 1), 1.0, 2.0)]
    import hashlib

    got = {r.seed: r.ic for r in audit.permuted_ics(spark.createDataFrame(rows, "instrument int, date date, s double, y double"), "s", "y", 5).collect()}
    for seed in range(5):
        ics = []
        for d in sorted({r[1] for r in rows}):
            day = [r for r in rows if r[1] == d]
            if len(day) >= 3:
                order = sorted(range(len(day)), key=lambda k: hashlib.md5(f"{seed}:{d}:{day[k][0]}".encode()).hexdigest())
                ics.append(spearman([r[2] for r in day], [day[k][3] for k in order]))
        assert got[seed] == pytest.approx(np.mean(ics))


def test_library_lines_that_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "library")
    good = {"slow": library.call("ts_mean", library.CLOSE, 20), "fast": library.call("ts_mean", library.CLOSE, 5)}
    records.promote(spark, path, good)
    assert set(records.expressions(spark, path)) == {"fast", "slow"}
    rows = [("x", "broken", "{"), ("auto_0", "renumbered", None), (None, None, "{}")]
    spark.createDataFrame(rows, "id string, name string, expression string").write.mode("append").json(path)
    assert set(records.expressions(spark, path, strict=False)) == {"fast", "slow"}
    with pytest.raises(ValueError, match="cannot be read"):
        records.expressions(spark, path)


def test_statements_are_known_late_and_grow_stale(spark):
    dates = spark.createDataFrame([(1, date(2020, 1, 1) + d * DAY) for d in (0, 44, 45, 100, 130, 121)] + [(2, date(2020, 3, 1))], "instrument int, date date")
    told = spark.createDataFrame([(1, date(2020, 1, 1), 5.0), (1, date(2020, 3, 31), 6.0)], "instrument int, datekey date, v double")
    got = {(r.instrument, (r.date - date(2020, 1, 1)).days): r.v for r in samples.statements_on_dates(dates, told, ["v"], max_age_days=120).collect()}
    assert got == {(1, 0): None, (1, 44): None, (1, 45): 5.0, (1, 100): 5.0, (1, 121): None, (1, 130): None, (2, 60): None}


def test_minutes_of_a_batch(spark):
    at = datetime(2024, 1, 2, 9, 30)
    rows = [("a", at), ("a", at + timedelta(minutes=1)), ("a", at + timedelta(minutes=4)), ("a", at + timedelta(minutes=4, seconds=30)), ("a", at + DAY), ("b", None), (None, at)]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz")
    assert {r.code: r.n for r in quality.minute_issues(df).collect()} == {"empty": 0, "off_minute": 1, "unknown": 2, "gap": 1}
    assert {r.code: r.n for r in quality.minute_issues(df.limit(0)).collect()} == {"empty": 1, "off_minute": 0, "unknown": 0, "gap": 0}
