"""Windows and ranks computed in groups, against Spark's own window functions; findings of round 3 on panels of many instruments."""

import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodepanel.functions.expr import OPERATORS, Var, average_rank, call, evaluate
from lodepanel.functions.grouped import ROLLING, group_ics, ranked
from lodepanel.functions.library import ALPHAS, MICROSTRUCTURE
from lodepanel.operators import audit, campaign, crosssection, evidence
from lodepanel.operators import evaluate as evaluate_ops

PAIRS = ("ts_cov", "ts_corr")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def panel(spark):
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), 7.0, -0.0, 0.0]
    value = lambda d: odd[rng.integers(6)] if rng.random() < 0.1 else 3.0 if 40 < d < 60 else float(rng.normal())
    rows = [(i, date(2024, 1, 1) + timedelta(d), value(d), value(d), "ab"[d % 2]) for i in [*range(6), None] for d in range(3 if i == 5 else 90)]
    return spark.createDataFrame(rows, "instrument int, date date, x double, y double, sector string").repartition(3)


def test_full_windows_equal_those_of_spark_to_the_last_digit(spark):
    rows, n = panel(spark), 5
    asked = {op: call(op, *([Var("x"), Var("y")] if op in PAIRS else [Var("x")]), n) for op in ROLLING}
    native = rows.withColumns({op: OPERATORS[op].column(*([F.col("x"), F.col("y")] if op in PAIRS else [F.col("x")]), n) for op in ROLLING})
    key = lambda r: (r.instrument if r.instrument is not None else -1, r.date)
    got, want = (sorted(df.collect(), key=key) for df in (evaluate(rows, asked), native))
    assert len(got) == len(want) == 5 * 90 + 3 + 90
    for a, b in zip(got, want, strict=True):
        for op in ROLLING:
            assert a[op] == b[op] or (a[op] is not None and b[op] is not None and math.isnan(a[op]) and math.isnan(b[op])), (op, a, b)
    assert all(any(r[op] is not None and not math.isnan(r[op]) for r in got) for op in ROLLING)


def test_ranks_of_a_group_equal_those_of_spark(spark):
    rows = panel(spark)
    want = {(r.instrument, r.date): (r.a, r.b) for r in rows.select("instrument", "date", average_rank(F.col("x"), "date").alias("a"), (average_rank(F.col("y"), "date") / F.count("y").over(W.partitionBy("date"))).alias("b")).collect()}
    a = {(r.instrument, r.date): r.a for r in ranked(rows, {"a": "x"}, ["instrument", "date"], ["date"], share=False).collect()}
    b = {(r.instrument, r.date): r.b for r in ranked(rows, {"b": "y"}, ["instrument", "date"], ["date"]).collect()}
    assert {k: (a[k], b[k]) for k in a} == want


def test_windows_share_one_pass_and_ranks_sort_no_partition_twice(spark):
    bars = panel(spark).select("instrument", "date", *[F.col("x").alias(c) for c in ("open", "high", "low", "close", "volume")], "sector")
    for name, expressions, passes in (("ms_moments", MICROSTRUCTURE["ms_moments"], 1), ("alpha_026", {"a": ALPHAS["alpha_026"]}, 2), ("alpha_041", {"a": ALPHAS["alpha_041"]}, 1), ("alpha_002", {"a": ALPHAS["alpha_002"]}, 2)):
        text = plan(evaluate(bars, expressions, ["instrument", "date"]))
        assert text.count("FlatMapGroupsInArrow") == passes, name
        found = [f for f in ("skewness(", "kurtosis(", "stddev_samp(", "covar_samp(", "rank(") if f in text]
        assert not found, (name, found)


def test_pooled_correlations_over_tasks_and_constant_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x), float(x + rng.normal()), 0.1, None if rng.random() < 0.4 else float(rng.normal())) for x in rng.normal(1e6, 1.0, 400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r.a, r.b): r.corr for r in audit.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16 and "covar_samp(" not in plan(audit.correlation_matrix(df, ["a", "b", "c", "d"]))
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            assert abs(got[x, y] - (0.0 if "c" in (x, y) else np.corrcoef(both.T)[0, 1])) < 1e-9
    assert {r.corr for r in audit.correlation_matrix(df.where("a IS NULL"), ["a", "b"]).collect()} == {0.0}


def test_ics_of_groups_equal_those_of_window_ranks(spark):
    rows = panel(spark).where("abs(x) < 1e9 AND abs(y) < 1e9").withColumn("c", F.lit(0.1))
    pairs = rows.where("instrument IS NOT NULL").select("date", average_rank(F.col("x"), "date").alias("f"), average_rank(F.col("y"), "date").alias("l"), "x", "y")
    want = {r.date: (r.n, r.ic, r.own) for r in pairs.groupBy("date").agg(F.count("x").alias("n"), evaluate_ops.safe_corr(F.col("f"), F.col("l")).alias("ic"), evaluate_ops.safe_corr(F.col("x"), F.col("y")).alias("own")).collect()}
    got = group_ics(rows.where("instrument IS NOT NULL"), ["x", "c"], "y", ["date"], plain=True).collect()
    for r in got:
        if r.feature == "c":
            assert r.ic is None and r.plain_ic is None
        else:
            n, *ics = want[r.date]
            assert r.n == n
            for a, b in zip((r.ic, r.plain_ic), ics, strict=True):
                assert (a is None and b is None) or abs(a - b) < 1e-12
    assert len([r for r in got if r.feature == "x"]) == len(want) and any(r.ic is not None for r in got)


def test_campaign_steps_rank_in_one_group_and_stack_no_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(evidence, "settled", lambda df: sizes.append(df.count()) or df)
    rng = np.random.default_rng(7)
    rows = [(i, date(2020, 1, 1) + timedelta(d), *map(float, rng.normal(size=3))) for i in range(8) for d in range(90)]
    df = spark.createDataFrame(rows, "instrument int, date date, a double, b double, y double")
    got = evidence.fold_evidence(df, ["a", "b"], "y", ["a"])
    assert {r.name: (r.coverage, r.valid_folds) for r in got.collect()} == {"a": (720, 0), "b": (720, 0)} and not sizes
    for each in (got, campaign.ridge_by_ic(df, ["a", "b"], "y"), campaign.robust_weights(df, ["a", "b"], "y"), evaluate_ops.daily_ic(df, "a", "y")):
        text = plan(each)
        assert "rank(a" not in text and "rank(x" not in text and " rank(" not in text


def test_factors_of_a_date_share_one_group(spark):
    rows = [(i, date(2024, 1, 1), float(i), None if i % 2 else 1.0, float("nan")) for i in range(20)] + [(99, date(2024, 1, 1), None, None, None)]
    df = crosssection.factor_bundle(spark.createDataFrame(rows, "instrument int, date date, a double, b double, c double"), ["a", "b", "c"])
    got = {r.instrument: (r.a, r.b, r.c) for r in df.collect()}
    assert "Generate" not in plan(df) and sorted(got) == list(range(20))
    assert got[0] == (2 * 0.5 / 19 - 1, 0.0, None) and got[1] == (2 * 0.5 / 19 - 1, None, None) and got[10][0] == 2 * 10 / 19 - 1
