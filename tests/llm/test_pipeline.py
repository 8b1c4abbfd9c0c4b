"""The pipeline's stages, each against a plain version on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests_support import SF_SMALL  # noqa: E402
from test_ops import brute_fingerprint, words  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], SF_SMALL).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [x.toPandas() for x in out]


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])
    assert set(stages[-1].columns) == {*stages[0].columns, "shard"} and set(stages[-1].shard) <= set(range(16))
    assert len(stages[-1]) == len(stages[-2])


def test_quality_keeps_clean(stages):
    before, after = stages[:2]

    def fails(text):
        w = words(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {i + k for i, g in enumerate(grams) if g in seen for k in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if not fails(t)}


def test_one_of_each_near_group_stays(stages):
    before, after = stages[1:3]
    prints = {i: brute_fingerprint(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(after.doc_id) == sorted({find(i) for i in ids})


def test_mixing_and_shards(stages):
    before, after = stages[3], stages[4]
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
    total = before.text.map(lambda t: len(words(t))).sum()
    assert abs(after.text.map(lambda t: len(words(t))).sum() / total - 1.5) < 0.1


def test_every_stage_takes_an_empty_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, -1), (1, "a b c", None, "s", 5), (1, "a b c", None, "s", 5)], docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name
        got = stage(spark, odd, SF_SMALL)
        assert set(docs.columns) <= set(got.columns) and got.count() <= 2 * odd.count(), name
