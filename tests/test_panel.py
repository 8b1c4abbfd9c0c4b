"""Panel operators on small hand-made tables: edge cases, point in time, stores and streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodepanel.functions.expr import Var, call, evaluate
from lodepanel.operators import asof, crosssection, portfolio, quality, regime
from lodepanel.operators import evaluate as ev
from lodepanel.plans import registry
from lodepanel.sources import store
from lodepanel.streaming import events

DAY0 = dt.date(2023, 1, 2)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def panel(spark, closes):
    """closes: {instrument: list of closes}"""
    rows = [(k, day(i), c, c, c, c, 1000.0, c) for k, v in closes.items() for i, c in enumerate(v)]
    return spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, close double, volume double, vwap double")


def test_windows_wait_until_full_and_skip_nothing(spark):
    rows = panel(spark, {"A": [1.0, 2.0, None, 4.0, 5.0, 6.0], "B": [3.0]})
    out = evaluate(rows, {"m": call("ts_mean", Var("close"), 3), "d": call("delay", Var("close"), 1), "part": call("part_mean", Var("close"), 3)})
    got = [(r.m, r.d, r.part) for r in out.where("instrument = 'A'").orderBy("date").collect()]
    assert [g[0] for g in got] == [None, None, None, None, None, 5.0]
    assert [g[1] for g in got] == [None, 1.0, 2.0, None, 4.0, 5.0]
    assert got[2][2] == 1.5
    assert out.where("instrument = 'B'").first().m is None


def test_division_by_zero_and_flat_windows_are_missing(spark):
    rows = panel(spark, {"A": [0.0, 2.0, 2.0, 2.0]})
    x = Var("close")
    out = evaluate(rows, {"q": x / call("delay", x, 1), "z": call("ts_zscore", x, 3), "c": call("ts_corr", x, x, 3)}).orderBy("date").collect()
    assert [r.q for r in out] == [None, None, 1.0, 1.0]
    assert out[3].z is None and out[3].c is None


def test_ranks_share_ties_and_leave_out_missing(spark):
    rows = spark.createDataFrame([("A", DAY0, 1.0), ("B", DAY0, 2.0), ("C", DAY0, 2.0), ("D", DAY0, None)], "instrument string, date date, close double")
    got = {r.instrument: r.r for r in evaluate(rows, {"r": call("rank", Var("close"))}).collect()}
    assert got == {"A": pytest.approx(1 / 3), "B": pytest.approx(2.5 / 3), "C": pytest.approx(2.5 / 3), "D": None}


def test_lookback_and_unknown_names(spark):
    e = call("ts_mean", call("delay", Var("close"), 5), 20)
    assert e.lookback == 24 and e.point_in_time and not call("lead", Var("close"), 1).point_in_time
    with pytest.raises(KeyError, match="ts_mean"):
        call("no_such_operator", Var("close"))
    with pytest.raises(ValueError, match="nothing"):
        evaluate(panel(spark, {"A": [1.0]}), {"x": Var("nothing")})


def test_no_value_depends_on_later_rows(spark):
    closes = [10 + math.sin(i) for i in range(40)]
    e = {"x": call("ts_rank", call("ts_std", Var("close"), 5), 10), "y": call("decay_linear", Var("close"), 4)}
    whole = {r.date: (r.x, r.y) for r in evaluate(panel(spark, {"A": closes}), e).collect()}
    cut = {r.date: (r.x, r.y) for r in evaluate(panel(spark, {"A": closes[:25]}), e).collect()}
    assert cut == {d: whole[d] for d in cut}


def test_asof_inclusive_strict_forward_and_parts(spark):
    left = spark.createDataFrame([(1, day(0)), (1, day(3)), (1, day(40)), (2, day(3)), (None, day(3))], "k int, t date")
    right = spark.createDataFrame([(1, day(1), "a"), (1, day(3), "b"), (1, day(3), "c"), (1, day(50), None), (3, day(0), "z")], "k int, s date, v string")

    def pairs(**kw):
        out = asof.asof_join(left, right, ["k"], "t", "s", ["v"], tiebreak=["v"], **kw).collect()
        return {(r.k, r.t): (r.match.at, r.match.v) if r.match else None for r in out}

    inclusive = pairs()
    assert inclusive == {(1, day(0)): None, (1, day(3)): (day(3), "c"), (1, day(40)): (day(3), "c"), (2, day(3)): None, (None, day(3)): None}
    assert pairs(strict=True)[1, day(3)] == (day(1), "a")
    assert pairs(forward=True) == {(1, day(0)): (day(1), "a"), (1, day(3)): (day(3), "c"), (1, day(40)): (day(50), None), (2, day(3)): None, (None, day(3)): None}
    assert {k: v for k, v in pairs(bucket="month").items() if k[0]} == {k: v for k, v in inclusive.items() if k[0]}


def test_latest_known_ignores_what_was_not_available(spark):
    rows = spark.createDataFrame([("A", day(1), day(2), 1.0), ("A", day(3), day(9), 2.0), ("B", day(8), day(8), 3.0)], "k string, as_of date, available date, v double")
    assert [(r.k, r.v) for r in asof.latest_known(rows, "k", "as_of", "available", F.lit(day(5))).collect()] == [("A", 1.0)]


def test_range_join_is_half_open(spark):
    left = spark.createDataFrame([(1, day(10))], "k int, t date")
    right = spark.createDataFrame([(1, day(i)) for i in range(12)] + [(2, day(9))], "k int, s date")
    assert sorted(r.s for r in asof.range_join(left, right, ["k"], "t", "s", 3).collect()) == [day(7), day(8), day(9)]
    assert sorted(r.s for r in asof.range_join(left, right, ["k"], "t", "s", 3, strict=False).collect()) == [day(7), day(8), day(9), day(10)]


def test_invalid_bars_gaps_and_latest_duplicates(spark):
    bars = panel(spark, {"A": [1.0, 2.0, -1.0], "B": [5.0]})
    assert {r.instrument: r.dropped for r in quality.drop_counts(bars).collect()} == {"A": 1, "B": 0}
    gaps = spark.createDataFrame([("A", day(0)), ("A", day(5)), ("A", day(11))], "instrument string, date date")
    assert [(r.to_date, r.days) for r in quality.continuity_gaps(gaps).collect()] == [(day(11), 6)]
    rows = spark.createDataFrame([("A", 1, "old"), ("A", 2, "new"), ("B", 1, "only")], "k string, seq int, v string")
    assert {r.k: r.v for r in quality.dedup_last(rows, ["k"], ["seq"]).collect()} == {"A": "new", "B": "only"}


def test_corporate_actions_fold_from_the_latest(spark):
    bars = panel(spark, {"A": [100.0, 100.0, 50.0], "B": [7.0]})
    actions = spark.createDataFrame([("A", day(2), "split", 2.0, None), ("A", day(1), "dividend", None, 1.0)], "instrument string, ex_date date, kind string, ratio double, cash double")
    got = {(r.instrument, r.date): (r.close, r.volume) for r in quality.adjust(bars, actions).collect()}
    assert got == {("A", day(0)): (49.0, 2000.0), ("A", day(1)): (50.0, 2000.0), ("A", day(2)): (50.0, 1000.0), ("B", day(0)): (7.0, 1000.0)}


def test_cross_section_with_one_name_or_no_spread(spark):
    rows = spark.createDataFrame([("A", DAY0, 3.0), ("B", DAY0, 3.0), ("C", day(1), 4.0)], "instrument string, date date, x double")
    out = rows.select("instrument", crosssection.zscore(F.col("x"), "date").alias("z"), crosssection.rank_pm1(F.col("x"), "date").alias("r")).collect()
    assert all(r.z is None or r.z == 0.0 for r in out) and {r.r for r in out if r.instrument in "AB"} == {0.0}


def test_folds_keep_a_purge_between_train_and_test():
    folds = ev.walk_forward_folds(DAY0, day(900), 252, 63, 21, 5)
    assert folds and all((f.test_start - f.train_end).days >= 21 for f in folds)


def test_weights_respect_the_cap(spark):
    rows = spark.createDataFrame([(chr(65 + i), DAY0, float(i), 0.01 * (i + 1)) for i in range(8)], "instrument string, date date, score double, vol double")
    picked = portfolio.top_n(rows, 4)
    assert {r.instrument for r in picked.collect()} == set("EFGH")
    for weights in (portfolio.equal_weights(picked, 1.0, 0.2), portfolio.inverse_vol_weights(picked, 1.0, 0.3)):
        got = [r.weight for r in weights.collect()]
        assert len(got) == 4 and max(got) <= 0.3 + 1e-9 and sum(got) <= 1 + 1e-9


def test_regime_label_moves_after_three_equal_candidates(spark, tmp_path):
    labels = ["flat", "up", "up", "flat", "up", "up", "up", "down"]
    rows = spark.createDataFrame([("m", day(i), c) for i, c in enumerate(labels)], "series string, date date, candidate string").coalesce(1)
    want = ["flat"] * 6 + ["up"] * 2
    assert [r.stable for r in regime.stable_labels(rows).orderBy("date").collect()] == want
    for i in range(0, 8, 2):
        rows.where(F.col("date").isin(day(i), day(i + 1))).write.parquet(f"{tmp_path}/in/{i}")
    got = []
    for i in range(0, 8, 2):  # the state is carried from run to run by the checkpoint
        (tmp_path / "seen").mkdir(exist_ok=True)
        (tmp_path / "in" / str(i)).rename(tmp_path / "seen" / str(i))
        part = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/seen")
        out = events.drain(regime.stable_label_stream(part), f"{tmp_path}/out", f"{tmp_path}/state")
        got = [r.stable for r in out.orderBy("date").collect()]
    assert got == want


def test_store_is_idempotent_and_keeps_the_last_ingested(spark, tmp_path):
    schema = "bar_id string, instrument string, ts timestamp, bar_seconds int, ingest_seq int, open double, high double, low double, close double, vwap double, volume double"
    bar = lambda b, y, seq, c, s=86_400: (b, "A", dt.datetime(y, 3, 1, 12), s, seq, c, c, c, c, c, 10.0)
    root = str(tmp_path / "bars")
    store.store_bars(spark.createDataFrame([bar("a", 2023, 1, 1.0), bar("b", 2024, 1, 2.0), bar("m", 2024, 1, 9.0, 60)], schema), root)
    store.store_bars(spark.createDataFrame([bar("a", 2023, 7, 99.0), bar("c", 2024, 2, 3.0)], schema), root)
    window = (dt.datetime(2023, 1, 1), dt.datetime(2024, 12, 31))
    got = store.load_bars(spark, root, *window, columns=["bar_id", "close"])
    assert sorted((r.bar_id, r.close) for r in got.collect()) == [("a", 1.0), ("c", 3.0)]
    assert store.load_bars(spark, root, *window, bar_seconds=60).count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_vendor_file(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("symbol,timestamp,open,high,low,close,volume\nAAA,2023-01-02 09:30:00,1,2,1,x,100\nZZZ,2023-01-02 09:30:00,1,2,1,2,100\n")
    symbols = spark.createDataFrame([("AAA", 7)], "symbol string, instrument int")
    (row,) = store.load_vendor_file(spark, str(path), symbols).collect()
    assert (row.instrument, row.close, row.volume, row.bar_seconds) == (7, None, 100.0, 60)
    path.write_text("symbol,timestamp\nAAA,2023-01-02\n")
    with pytest.raises(ValueError, match="open"):
        store.load_vendor_file(spark, str(path), symbols)


def test_document_text(spark):
    rows = spark.createDataFrame([(1, "<p>a &amp; b</p>\n\n<script>x = 1</script><br> c "), (2, None)], "id int, html string")
    got = {r.id: r.t for r in rows.select("id", store.document_text("html").alias("t")).collect()}
    assert got == {1: "a & b\nx = 1\nc", 2: ""}


def test_stream_delivers_the_readable_and_keeps_the_rest(spark, tmp_path):
    good = '{"event_id": %d, "ts": "2024-01-01T00:00:00Z", "user_id": 1, "event_type": "view", "value": 1.5}'
    spark.createDataFrame([(good % 1,), (good % 2,), ("no json",), ('{"event_id": 3}',), (None,)], "payload string").write.parquet(f"{tmp_path}/in")
    parsed = events.parse(spark.readStream.schema("payload string").parquet(f"{tmp_path}/in"))
    events.deliver(parsed, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/good").collect()) == [1, 2]
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 3


def test_stream_drops_repeated_ids(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1, 0, i), 1, "view", 1.0, None) for i in range(9)]
    spark.createDataFrame(rows, events.EVENT).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.once(events.event_files(spark, f"{tmp_path}/in", "*.parquet"))
    assert events.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state").count() == 3


def test_events_once_reads_a_folder_of_parts_over_any_span(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i % 150, day(i), 1, "view", 1.0, None) for i in range(300)]
    table = spark.createDataFrame(rows, events.EVENT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for name, files in (("parts", table.repartition(20, "ts")), ("sorted", table.repartitionByRange(20, "ts"))):
        files.write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = [r.event_id for r in registry.QUERIES["events_once"](spark, f"{tmp_path}/{name}").select("event_id").collect()]
        assert sorted(got) == list(range(150))
