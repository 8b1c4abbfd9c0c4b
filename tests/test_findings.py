"""What the findings of round 3 named: sums that do not hang on order, ranks of many groups in one pass."""

import hashlib
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from lodepanel.operators import audit, campaign, evaluate, fitting, pooled, portfolio
from lodepanel.plans import registry
from lodepanel.sources import filings


def test_books_with_equal_sums_agree_whatever_the_order(spark, tmp_path):
    rows = [(5, 1, 0.1), (10, 1, 0.2), (3, 1, 0.3), (5, 2, 0.1), (3, 2, 2000.0), (3, 3, 1.0), (10, 4, 1.0), (15, 5, 1.0), (7, 6, 0.7)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.k: r.kind for r in registry.QUERIES["reconcile_full_outer"](spark, str(tmp_path)).collect()}
    assert got == {2: "mismatch", 3: "missing_broker", 4: "missing_internal"}


def test_a_long_walk_hands_on_changes_and_not_every_held_name_of_every_day(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(portfolio, "settled", lambda df, put=portfolio.settled: seen.append(put(df)) or seen[-1])
    rng = np.random.default_rng(6)
    rows = [("m", date(2024, 1, 1) + timedelta(d), f"i{d:03d}-{k}", float(rng.random() + 0.1), 0.01) for d in range(150) for k in range(12)]
    got = portfolio.day_loop(spark.createDataFrame(rows, "arm string, date date, instrument string, score double, r double")).collect()
    assert len(got) == 150 and max(r.names for r in got) > 60
    assert 7 * seen[-1].count() < sum(r.names for r in got)


def test_pooled_ranks_of_overlapping_groups_over_ranges_and_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(pooled, "RANGE", 40)
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(500):
        x, y = float(rng.normal()), float(np.round(rng.normal(), 1))
        rows.append(([g for g in range(3) if rng.random() < 0.6], None if rng.random() < 0.3 else x, x if rng.random() < 0.5 else 7.0, y + x / 3 if rng.random() < 0.7 else 0.5))
    rows += [([1], 1.0, 2.0, None), ([], 1.0, 2.0, 3.0)]
    got = {(r.grp, r.feature): r.ic for r in pooled.rank_ics(spark.createDataFrame(rows, "g array<int>, a double, b double, y double"), ["a", "b"], "y", "g", 3).collect()}
    rank = lambda v: np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v])
    for g in range(3):
        mine = [r for r in rows if g in r[0] and r[3] is not None]
        for k, f in enumerate(("a", "b"), 1):
            want = np.corrcoef(rank(np.array([r[k] or 0.0 for r in mine])), rank(np.array([r[3] for r in mine])))[0, 1]
            assert abs(got[g, f] - want) < 1e-12
    assert pooled.rank_ics(spark.createDataFrame([], "g array<int>, a double, y double"), ["a"], "y", "g", 3).count() == 0


def test_a_campaign_writes_no_row_more_than_once_for_all_folds(spark, monkeypatch):
    sizes = []
    for module in (campaign, pooled):
        monkeypatch.setattr(module, "settled", lambda df, put=module.settled: (sizes.append((got := put(df)).count()), got)[1])
    rng = np.random.default_rng(8)
    rows = [(i, date(2020, 1, 1) + timedelta(d), d, d + 3, float(rng.normal()), float(rng.normal()), 0.01) for i in range(16) for d in range(200)]
    samples = spark.createDataFrame(rows, "instrument int, date date, day int, label_end_index int, a double, forward_return double, realized_return_1d double")
    folds = evaluate.walk_forward_folds(date(2020, 1, 1), date(2020, 7, 18), train=80, test=10, purge=5, embargo=1)
    weights, _, report = campaign.walk_forward(samples, folds, ["a"])
    assert weights.count() == report.count() == len(folds) > 5 and max(sizes) == len(rows)


def test_labels_are_dealt_in_one_group_a_date_for_all_seeds(spark, monkeypatch):
    monkeypatch.setattr(audit, "settled", lambda df: 1 / 0)  # nothing is written
    rng = np.random.default_rng(9)
    rows = [(i, date(2020, 1, 1 + d), float(rng.normal()), float(rng.normal())) for d in range(4) for i in range(2 if d == 3 else 12)]
    got = {r.seed: r.ic for r in audit.permuted_ics(spark.createDataFrame(rows, "instrument int, date date, f double, y double"), "f", "y", 3).collect()}
    for seed in range(3):
        ics = []
        for day in sorted({r[1] for r in rows})[:3]:
            mine = sorted(r for r in rows if r[1] == day)
            dealt = sorted(mine, key=lambda r: hashlib.md5(f"{seed}:{day}:{r[0]}".encode()).hexdigest())
            ics.append(np.corrcoef(np.argsort(np.argsort([r[2] for r in mine])), [sorted(r[3] for r in mine).index(r[3]) for r in dealt])[0, 1])
        assert abs(got[seed] - np.mean(ics)) < 1e-12


def test_plain_index_pages_are_read_without_the_parser_and_as_it_reads_them(spark, monkeypatch):
    def parsed(page):
        parser = filings._Rows()
        parser.feed(page)
        parser.close()
        while parser.open:
            parser._end_row()
        return parser.done

    bits = ["<tr>", "</tr>", '<TR class="x">', "<td>", "</td>", "<th nowrap>", "<table>", "</table>", "<td>a &amp; b</td>", '<td a="b"> <a href="x.htm?a&amp;b">x</a> y</th>', "<td></td>", "<A HREF=q.htm>", "</a>", "<b>", "&lt", " t\n", ">", "<!-- c -->"]
    odd = ["<", "<>", "<br/>", '<a href="a>b">', "<!-->", "<script>", "</script>", '</td x="1">', "<td"]
    rng = np.random.default_rng(10)
    for n in range(3000):
        page = "".join(rng.choice(bits if n % 2 else bits + odd, 20))
        assert filings.table_rows(page) == parsed(page), page
    pages = spark.createDataFrame([(k, "".join(rng.choice(bits + odd, 20)), f"http://h/{'../' * (k % 2)}a/b.htm") for k in range(60)] + [(60, None, None)], "k int, html string, url string")
    rows = lambda df: sorted((r.k, r.nth, r.cells, r.links) for r in df.collect())
    assert rows(filings.page_rows(pages, keep=["k"])) == rows(pages.lateralJoin(filings.TableRows(F.col("html").outer(), F.col("url").outer())))
    assert filings.page_rows(pages).columns == ["k", "html", "url", "nth", "cells", "links"]
    monkeypatch.setattr(filings._Rows, "feed", lambda *_: 1 / 0)
    assert filings.table_rows("<TABLE><tr><th>Seq<th>Type</tr><tr><td>1</td><td><a href='x'>y</a></td></tr></table>") == [(["Seq", "Type"], []), (["1", "y"], ["x"])]


def test_boosted_trees_of_bins_are_those_of_all_rows_in_any_layout(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    given = []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, fit=GBTRegressor.fit: (given.append(rows.count()), fit(self, rows))[1])
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=6000).round(3), rng.integers(0, 5, 6000) * 1.5
    values = np.column_stack([a, b, np.where(a > 0.3, 1.0, -1.0) + b / 5 + rng.normal(size=6000)])
    rows = spark.createDataFrame(values.tolist(), "a double, b double, y double")
    cuts = fitting.cut_points(rows, ["a", "b"], 32)
    assert cuts == [sorted({np.sort(a)[k * 6000 // 32] for k in range(1, 32)}), sorted(set(b))]
    skewed = np.concatenate([np.zeros(3000), rng.exponential(size=3000)])
    assert fitting.cut_points(spark.createDataFrame([(float(x),) for x in skewed], "x double").repartition(7), ["x"], 8) == [sorted({np.sort(skewed)[k * 750] for k in range(1, 8)})]
    got = {}
    for parts in (1, 7):
        fitted = fitting.fit_boosted(rows.repartition(parts), ["a", "b"], "y", rounds=5)
        got[parts] = {(r.a, r.b): r.score for r in fitting.boosted_score(fitted, rows, ["a", "b"]).collect()}
    assert max(given) <= 32 * 6 and max(abs(got[1][k] - got[7][k]) for k in got[1]) < 1e-9
    binned = VectorAssembler(inputCols=fitted.bins, outputCol="v").transform(fitted.binned(rows))
    plain = GBTRegressor(featuresCol="v", labelCol="y", maxIter=5, maxDepth=3, maxBins=33, stepSize=0.1, seed=7).fit(binned).transform(binned).collect()
    assert max(abs(r.prediction - got[1][r.a, r.b]) for r in plain) < 1e-9
    assert fitting.boosted_score(fitted, spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (0.5, 1.5)], "a double, b double"), ["a", "b"]).count() == 1
