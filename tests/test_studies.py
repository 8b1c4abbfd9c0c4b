"""Fitted models, gates, risk and portfolios against plain computations, with their edge cases."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepanel.functions import library, serialize
from lodepanel.operators import audit, crosssection, evaluate, fitting, portfolio, risk, samples, universe
from lodepanel.sources import records, store


def frame(spark, x, names):
    return spark.createDataFrame([tuple(float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))


def test_ridge_is_the_best_of_nonnegative_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    y = x @ [0.5, -0.8, 0.0, 1.2] + rng.normal(0, 0.1, 80)
    rows = frame(spark, np.column_stack([x, y]), ["a", "b", "c", "d", "y"]).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 9.0), (float("nan"), 1.0, 1.0, 1.0, 9.0)], "a double, b double, c double, d double, y double"))
    w = np.array(list(fitting.ridge_nonnegative(rows, ["a", "b", "c", "d"], "y", l2=2.0).values()))
    slope = x.T @ (x @ w - y) + 2.0 * w
    assert (w >= 0).all() and w[1] == 0 and np.abs(slope[w > 0]).max() < 1e-6 and (slope[w == 0] >= -1e-6).all()
    assert fitting.ridge_nonnegative(rows.limit(0), ["a"], "y") == {"a": 0.0}


def test_components_are_those_of_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ [[2, 1, 0], [0, 1, 0.5], [0.3, 0, 1]] + [5, -3, 100]
    rows = frame(spark, x, ["a", "b", "c"])
    model = fitting.fit_components(rows, ["a", "b", "c"], 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    for got, want in zip(model.loadings, v, strict=False):
        assert got[np.argmax(np.abs(got))] > 0 and min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
    assert np.allclose(model.explained, (s**2 / (s**2).sum())[:2])
    scores = np.array([[r.pc1, r.pc2] for r in rows.select(*[c.alias(n) for n, c in model.columns().items()]).collect()])
    assert np.allclose(scores, z @ model.loadings.T)
    with pytest.raises(ValueError, match="no spread"):
        fitting.fit_components(rows.withColumn("c", F.lit(1.0)), ["a", "c"], 1)


def test_ranks_over_ranges_are_those_of_one_sort(spark):
    values = [3.0, 1.0, 1.0, 1.0, 7.0, 2.0, 2.0] * 9 + [float(i % 13) for i in range(200)]
    counts = spark.createDataFrame([("f", v) for v in values], "feature string, x double").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {r.x: r.r for r in evaluate.weighted_ranks(counts, "x", "r").collect()}
    order = sorted(values)
    assert got == {v: (2 * order.index(v) + 1 + order.count(v)) / 2 for v in set(values)}
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert audit.order_statistics(rows, "x", [0.0, 0.05, 0.5, 0.95, 1.0]) == [order[int(q * (len(order) - 1))] for q in (0.0, 0.05, 0.5, 0.95, 1.0)]


def test_clusters_follow_chains(spark):
    cells = [("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1), ("e", "f", 0.7), ("g", "g", 1.0)]
    matrix = spark.createDataFrame(cells + [(b, a, c) for a, b, c in cells], "a string, b string, corr double")
    assert {(r.feature, r.cluster, r.size) for r in audit.correlation_clusters(matrix, 0.7).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("e", "e", 2), ("f", "e", 2)}
    assert audit.correlation_clusters(matrix, 1.1).count() == 0


def test_bootstrap_interval_holds_the_mean(spark):
    series = spark.createDataFrame([(i, 1.0 + (i * 37 % 11) / 10) for i in range(60)], "date long, ic double")
    r = audit.bootstrap_mean(series, "ic", "date", samples=100).first()
    again = audit.bootstrap_mean(series.repartition(3), "ic", "date", samples=100).first()
    assert r.ci_low < r["mean"] < r.ci_high and r.ci_high - r.ci_low < 0.3 and again.ci_low == pytest.approx(r.ci_low)
    assert audit.bootstrap_mean(series.limit(0), "ic", "date").first()["mean"] is None


def test_gates_of_a_flat_feature_fail(spark):
    rows = spark.createDataFrame([(f"i{k}", date(2024, 1, 1 + d), 0.0, float((k * 7 + d) % 5)) for d in range(25) for k in range(6)], "instrument string, date date, f double, y double")
    noise = audit.noise_gate(rows, "f").first()
    assert not noise.passed and noise.zero_fraction == 1.0 and noise.coverage == 1.0 and noise.winsor_impact == 0.0
    assert not audit.leakage_gate(rows.withColumn("f", F.col("y")), "f", "y").first().passed
    assert audit.cost_gate(rows, "f", "y").first().turnover == 0.0


def test_a_sample_says_why_it_is_none(spark):
    day = lambda k: date(2024, 1, k)
    grid = spark.createDataFrame([("ok", day(10)), ("none", day(10)), ("old", day(10)), ("nan", day(10)), ("end", day(10)), (None, day(10))], "instrument string, as_of date")
    vectors = spark.createDataFrame([("ok", day(9), 1.0), ("ok", day(11), 5.0), ("old", day(5), 1.0), ("nan", day(10), float("nan")), ("end", day(10), 1.0)], "instrument string, known_at date, f double")
    closes = spark.createDataFrame([("ok", day(8), 2.0), ("ok", day(14), 9.0), ("ok", day(16), 3.0), ("end", day(9), 2.0), ("nan", day(1), 1.0)], "instrument string, at date, close double")
    got = {r.instrument: r for r in samples.supervised_samples(grid, vectors, closes, ["f"], horizon_days=5).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "none": "missing_features", "old": "stale_features", "nan": "invalid_features", "end": "missing_bars", None: "missing_features"}
    assert got["ok"].forward_return == 0.5 and got["ok"].f == 1.0 and got["old"].f is None


def test_statements_keep_the_last_update(spark):
    rows = spark.createDataFrame([("T", date(2024, 3, 31), None, 1.0), ("T", date(2024, 3, 31), date(2024, 5, 1), 2.0), ("T", None, date(2024, 5, 1), 3.0), ("X", date(2024, 3, 31), None, 4.0)], "ticker string, datekey date, lastupdated date, revenue double")
    tickers = spark.createDataFrame([("T", 7)], "ticker string, instrument long")
    assert [(r.instrument, r.revenue) for r in samples.latest_statements(rows, tickers).collect()] == [(7, 2.0)]


def test_frames_are_neutralised_by_groups_or_size(spark):
    rows = spark.createDataFrame([(i, date(2024, 1, 1), float(i), math.exp(i)) for i in range(6)], "instrument long, date date, f double, marketcap double")
    groups = spark.createDataFrame([(0, "g"), (1, "g"), (2, "g")], "instrument long, group string")
    got = {r.instrument: r.f for r in crosssection.neutralize_frame(rows, ["f"], "sector_mean", groups=groups).collect()}
    assert got == {0: -1.0, 1: 0.0, 2: 1.0, 3: -1.0, 4: 0.0, 5: 1.0}
    assert max(abs(r.f) for r in crosssection.neutralize_frame(rows, ["f"], "size_residual").collect()) < 1e-9
    with pytest.raises(ValueError, match="without groups"):
        crosssection.neutralize_frame(rows, ["f"], "sector_median")


def test_risk_edges(spark):
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "instrument string, weight double")
    loadings = spark.createDataFrame([("a", "x", 1.0), ("b", "x", -1.0), ("a", "y", 2.0)], "instrument string, factor string, loading double")
    capped = {r.instrument: r.weight for r in risk.cap_factors(weights, loadings, 0.5).collect()}
    assert capped["b"] == 0.4 and capped["a"] == pytest.approx(0.25)
    variances = spark.createDataFrame([("a", 0.04), ("b", 0.0)], "instrument string, variance double")
    assert {r.instrument: r.weight for r in risk.inverse_vol_scale(weights, variances).collect()} == {"a": 0.6, "b": 0.4}
    wins = spark.createDataFrame([("up", 0.1)], "scenario string, result double")
    assert risk.tail_loss(wins).first().tail_loss is None


def test_day_loop_against_a_walk_over_whole_days(spark):
    rng = np.random.default_rng(4)
    rows = [("m", date(2024, 1, 1 + d), f"i{k}", float(rng.normal()), float(rng.normal(0, 0.01)) if k else None) for d in range(12) for k in range(9) if (d + k) % 7]
    got = {r.date: r for r in portfolio.day_loop(spark.createDataFrame(rows, "arm string, date date, instrument string, score double, r double"), n=3, buffer=2).collect()}
    held = {}
    for day in sorted({r[1] for r in rows}):
        today = [r for r in rows if r[1] == day]
        ranked = [r[2] for r in sorted(today, key=lambda r: (-r[3], r[2])) if r[3] > 0]
        chosen = ranked[:3]
        for name in [i for i in ranked[3:5] if i in held]:
            free = [k for k in range(len(chosen)) if chosen[k] not in held]
            if free:
                chosen[free[-1]] = name
        want = {i: min(min(1.0, len(chosen) * 0.15) / len(chosen), 0.15) for i in chosen}
        move = {i: want.get(i, 0.0) - held.get(i, 0.0) for i in {*want, *held}}
        move = {i: 0.0 if abs(m) < 0.005 else max(-0.1, min(0.1, m)) for i, m in move.items()}
        total = sum(abs(m) for m in move.values())
        new = {i: w for i, m in move.items() if (w := held.get(i, 0.0) + m * (min(1.0, 0.5 / total) if total else 1.0)) > 1e-12}
        turnover = sum(abs(new.get(i, 0.0) - held.get(i, 0.0)) for i in {*new, *held})
        r = dict((x[2], x[4] or 0.0) for x in today)
        assert got[day].r == pytest.approx(sum(w * r.get(i, 0.0) for i, w in new.items()) - turnover * 0.001) and got[day].turnover == pytest.approx(turnover) and got[day].names == len(new)
        held = new


def test_orders_limits_and_scales(spark):
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "instrument string, weight double")
    held = spark.createDataFrame([("b", 30), ("c", 5)], "instrument string, held long")
    prices = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("c", 1.0)], "instrument string, price double")
    assert {(r.instrument, r.side, r.shares) for r in portfolio.plan_orders(targets, held, prices, 1000.0).collect()} == {("a", "buy", 16), ("b", "sell", 20), ("c", "sell", 5)}
    rows = spark.createDataFrame([(date(2024, 1, 1), "a", 0.9), (date(2024, 1, 1), "b", 0.3)], "date date, instrument string, weight double")
    assert {r.instrument: r.weight for r in portfolio.limit_weights(rows, 0.5, 0.4).collect()} == pytest.approx({"a": 0.25, "b": 0.15})
    assert portfolio.vol_scale([0.01], 0.1) == 1.0 and 0 < portfolio.vol_scale([0.05, -0.05] * 5, 0.1) < 0.2
    assert portfolio.streak_scale([0.1, 0.1]) == 1.0 and portfolio.streak_scale([0.1, -0.1, -0.1, -0.1]) == 0.0


def test_expressions_come_back_from_their_json_form():
    for expression in [*library.ALPHAS.values(), *library.PRICE_VOLUME["pv_returns"].values()]:
        assert serialize.from_dict(serialize.to_dict(expression)) == expression


def test_adjusted_bars_keep_their_other_columns(spark, tmp_path):
    schema = "bar_id string, instrument string, ts timestamp, bar_seconds int, ingest_seq int, open double, high double, low double, close double, vwap double, volume long"
    rows = spark.createDataFrame([("x", "a", None, 60, 1, 4.0, 4.0, 4.0, 4.0, 4.0, 10), ("y", "a", None, 60, 1, 6.0, 6.0, 6.0, 6.0, 6.0, 10)], schema)
    rows = rows.withColumn("ts", F.when(F.col("bar_id") == "x", F.lit("2024-01-02 10:00:00")).otherwise(F.lit("2024-01-02 10:01:00")).cast("timestamp"))
    store.store_bars(rows, f"{tmp_path}/bars")
    actions = spark.createDataFrame([("a", date(2024, 2, 1), "split", 2.0, 0.0)], "instrument string, ex_date date, kind string, ratio double, cash double")
    got = store.load_bars(spark, f"{tmp_path}/bars", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-31").cast("timestamp"), bar_seconds=60, columns=["bar_id", "ts", "close", "volume"], actions=actions)
    assert {(r.bar_id, r.ts.minute, r.close, r.volume) for r in got.collect()} == {("x", 0, 2.0, 20.0), ("y", 1, 3.0, 20.0)}
    assert store.visible_lines("<br/>") == "<br/>" and store.visible_lines("a &lt; b<p> c </p><!-- d -->") == "a < b\nc"


def test_actions_are_appended_once_and_late_ones_change_bars(spark, tmp_path):
    root = f"{tmp_path}/actions"
    assert records.read_actions(spark, root).count() == 0
    rows = spark.createDataFrame([("1", "a", date(2024, 2, 1), "split", 2.0, 0.0), ("1", "a", date(2024, 2, 1), "split", 2.0, 0.0)], records.ACTIONS)
    records.store_actions(rows, root)
    records.store_actions(rows.unionByName(spark.createDataFrame([("2", "a", date(2024, 3, 1), "split", 5.0, 0.0)], records.ACTIONS)), root)
    assert sorted(r.action_id for r in records.read_actions(spark, root).collect()) == ["1", "2"]
    bars = spark.createDataFrame([("a", date(2024, 1, 2), 10.0, 10.0, 10.0, 10.0, 10.0, 3), ("b", date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 1)], "instrument string, date date, open double, high double, low double, close double, vwap double, volume long")
    assert [(r.instrument, r.close, r.volume) for r in records.reprocess(bars, spark, root).collect()] == [("a", 1.0, 30.0)]


def test_samples_and_expressions_come_back_from_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", date(2024, 1, 2), {"f": 1.5}, None)], "instrument string, as_of date, features map<string,double>, forward_return double")
    records.write_samples(rows, f"{tmp_path}/samples")
    assert records.read_samples(spark, f"{tmp_path}/samples", rows.schema.simpleString()[7:-1].replace(":", " ", 4)).collect() == rows.collect()
    some = dict(list(library.ALPHAS.items())[:2])
    added = records.promote(spark, f"{tmp_path}/library", some)
    assert len(added) == 2 and records.promote(spark, f"{tmp_path}/library", some) == []
    assert records.expressions(spark, f"{tmp_path}/library") == some


def test_vendor_files_are_read_as_written(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.0, 2.0, 0.5, 1.5, 10.0)], "symbol string, open double, high double, low double, close double, volume double").withColumn("ts", F.lit("2024-01-02 10:00:00").cast("timestamp"))
    symbols = spark.createDataFrame([("A", 7)], "symbol string, instrument long")
    for kind in ("parquet", "csv"):
        records.write_bars_file(rows, f"{tmp_path}/bars.{kind}", kind)
        (r,) = store.load_vendor_file(spark, f"{tmp_path}/bars.{kind}", symbols).collect()
        assert (r.instrument, r.close, r.volume) == (7, 1.5, 10.0)


def test_universe_weights_and_streaks(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", float("nan")), ("d", -0.1), ("e", None)], "instrument string, weight double")
    assert [r.instrument for r in universe.clean_weights(rows).collect()] == ["a"]
    folds = spark.createDataFrame([(0, 0.1, -0.5), (1, -0.1, -0.1), (2, -0.2, 0.05), (3, 0.1, 0.0), (4, -0.1, -0.9)], "fold int, ic double, r double")
    assert universe.worst_streak_drawdown(folds).first().drawdown == pytest.approx(-0.1)
    assert universe.worst_streak_drawdown(folds.where("ic > 0")).first().drawdown == 0.0


def test_boosted_trees_learn_a_step(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    rows = frame(spark, np.column_stack([x, np.where(x[:, 0] > 0.3, 1.0, -1.0)]), ["a", "b", "y"])
    model = fitting.fit_boosted(rows, ["a", "b"], "y", rounds=3, depth=2)
    got = fitting.boosted_score(model, rows, ["a", "b"]).collect()
    assert sum((r.score > 0) == (r.y > 0) for r in got) > 290
