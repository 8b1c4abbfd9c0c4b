"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are put in partitions of doubling size (distinct five-word shingles). An item's sketch is its bottom-s
MinHash: the s smallest hashes of its shingles, with s fixed by its partition so that a document holding the
wanted share of any item of that size must hold one of the s (of n shingles at most n - ceil(share * n) can be
missing). A document's sketch against a partition is every shingle hash up to the largest in any sketch of it, so short
items are found in documents of any length and no window is cut. The sketches against all partitions are parts of the
longest one: each hash is sent once and meets the items of every partition in one join by hash. (Sent once for each
partition, the stage took 400 task seconds a GB against 201.) Each pair that meets is verified by exact shingle
containment. DataFrame functions only.

Words are lower-case runs of letters, marks and digits. Defined results: null or short texts (under five words)
have no shingle and match nothing; repeated item rows count once, repeated documents each yield their pairs once
an id; equal ids with different texts are compared text by text and give the largest containment; very
long texts are one array of hashes and, where a sketch meets, one of shingles; only ids and texts are read, whatever
else is called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import free_name, let, plain_words, settled, small, table, windows

WIDTH = 5
SHARE = 0.8


def _hashes(tokens: Column) -> Column:
    return windows(tokens, WIDTH, lambda i: F.xxhash64(*[tokens[i + k] for k in range(WIDTH)]), "bigint")


def _shingles(text: Column) -> Column:
    return F.array_distinct(
        let(plain_words(text), lambda w: windows(w, WIDTH, lambda i: F.array_join(F.slice(w, i + 1, WIDTH), " "), "string"))
    )


def item_sketches(items: DataFrame, item_id: str, text: str, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(items with their shingles and count, one row a sketch hash)."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("item_text")).distinct()
    rows = rows.select(
        "item_id",
        F.xxhash64("item_text").alias("item_mark"),
        _shingles(F.col("item_text")).alias("item_shingles"),
        let(plain_words(F.col("item_text")), lambda w: F.sort_array(F.array_distinct(_hashes(w)))).alias("hashes"),
    ).where(F.size("item_shingles") > 0)
    n = F.size("item_shingles")
    partition = F.floor(F.log2(n)).cast("int")
    largest = F.pow(F.lit(2), partition + 1).cast("int") - 1
    keep = F.least(F.size("hashes"), F.floor((1 - share) * largest + 1e-9).cast("int") + 1)
    rows = settled(rows.withColumns({"n_item_shingles": n, "size_partition": partition, "sketch": F.slice("hashes", 1, keep)}).drop("hashes"))
    index = rows.select("item_id", "item_mark", F.col("size_partition").alias("item_partition"), F.explode("sketch").alias("item_hash"))
    return rows, index


def candidates(docs: DataFrame, doc_id: str, text: str, index: DataFrame) -> DataFrame:
    """Distinct (doc_id, doc_mark, item_id, item_mark) whose sketches share a hash."""
    # The bound of each size partition; the largest covers the others.
    bounds = index.groupBy("item_partition").agg(F.max("item_hash").alias("b"))
    most = bounds.agg(F.max("b")).first()[0]
    body = F.coalesce(F.col(text), F.lit(""))
    sketch = let(plain_words(body), lambda w: F.array_distinct(F.filter(_hashes(w), lambda h: h <= F.lit(-(2**63) if most is None else most))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("doc_mark"), F.explode(sketch).alias("doc_hash"))
    met = rows.join(small(index), F.col("doc_hash") == F.col("item_hash"))
    return met.select("doc_id", "doc_mark", "item_id", "item_mark").distinct()


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """Verified pairs: doc_id, doc_mark, item_id, n_item_shingles, n_shared, containment (at least `share`)."""
    rows, index = item_sketches(items, item_id, item_text, share)
    pairs = settled(candidates(docs, doc_id, text, index))
    texts = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("m"), F.col(text).alias("body"))
    named = pairs.select("doc_id", "doc_mark").distinct()
    held = texts.join(small(named), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("doc_mark")))
    held = held.dropDuplicates(["doc_id", "doc_mark"]).select(
        F.col("doc_id").alias("hd"), F.col("doc_mark").alias("hm"), _shingles(F.col("body")).alias("doc_shingles")
    )
    both = pairs.join(held, F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("doc_mark") == F.col("hm")))
    wanted = small(rows.select(F.col("item_id").alias("wi"), F.col("item_mark").alias("wm"), "item_shingles", "n_item_shingles"))
    both = both.join(wanted, F.col("item_id").eqNullSafe(F.col("wi")) & (F.col("item_mark") == F.col("wm")))
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    out = both.select("doc_id", "doc_mark", "item_id", F.col("n_item_shingles").cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).where(F.col("containment") >= share)


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The documents that hold no item, with the columns of `docs`."""
    leaks = settled(find_leaks(docs, items, doc_id, text, share=share).select(F.col("doc_id").alias("leak_id"), "doc_mark").distinct())
    key, mark = free_name(docs, "leak_id"), free_name(docs, "leak_mark")
    leaks = small(leaks.select(F.col("leak_id").alias(key), F.col("doc_mark").alias(mark)))
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks[key]) & (F.xxhash64(docs[text]) == leaks[mark]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair of which the document holds at least 0.8 of the item's shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    best = leaks.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", F.round("b.containment", 6).alias("containment"))


OP1_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark),
di AS (
  SELECT doc_id, hash(w) AS m,
         unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d),
ii AS (
  SELECT DISTINCT item_id, hash(w) AS m,
         unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, m, count(*) AS n FROM ii GROUP BY ALL),
hit AS (
  SELECT di.doc_id, di.m AS dm, ii.item_id, ii.m AS im, count(DISTINCT di.s) AS k
  FROM di JOIN ii USING (s) GROUP BY ALL),
pair AS (
  SELECT doc_id, hit.item_id, n.n, k, k / n.n AS c,
         row_number() OVER (PARTITION BY doc_id, hit.item_id ORDER BY k / n.n DESC, n.n DESC) AS r
  FROM hit JOIN n ON hit.item_id = n.item_id AND hit.im = n.m WHERE k / n.n >= 0.8)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, k::BIGINT AS n_shared, round(c, 6) AS containment
FROM pair WHERE r = 1
"""
