"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius. Two fingerprints within the radius share a variant;
fingerprints are made distinct first, so copies of a text cost one row. All fingerprints of a variant lie within
half the radius of it, hence within the radius of one another: each is paired with the smallest of its variant
(never all with all), pairs are made distinct, their distance is verified, and components are built from them.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; a
shingle of a text with fewer words than the width is the whole sequence; repeated rows share a component; null
ids are ignored in a component's smallest id (null if it has no other); a text of any length is read whole, its hashes
in blocks; `keep_one` returns the given columns, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import free_name, row_hash, settled, small, table
from .components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 14


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    tokens = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - width + 1)
    stops = ends[min(width, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), stops.tolist(), strict=True))
    for at in range(0, n, _BLOCK):
        h = np.fromiter((digest(line[a:b], 42) for a, b in spans[at : at + _BLOCK]), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """`keys` and `fp` (the fingerprint as a signed long) of each row, in Arrow batches."""
    df = docs.select(*keys, F.col(text).alias("fp_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column("fp_text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(fps)], names=[*keys, "fp"])

    schema = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keys).dtypes)
    return df.mapInArrow(run, f"{schema}, fp long")


def variants(fp: Column, reach: int) -> Column:
    """All values within `reach` bits of `fp`."""
    masks = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(64), k)]
    signed = np.array(masks, dtype=np.uint64).view(np.int64).tolist()
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct verified pairs (u, v), u < v, whose components are those of all pairs within an even `radius`."""
    if radius % 2:
        raise ValueError("the radius must be even: a variant reaches half of it")
    # A settled table comes in few parts; a given number keeps them apart where each row becomes many.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    spread = fps.select("fp", F.explode(variants(F.col("fp"), radius // 2)).alias("variant"))
    centre = settled(
        spread.groupBy("variant").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("variant").alias("met"), "u")
    )
    found = spread.join(small(centre), F.col("variant") == F.col("met")).where(F.col("fp") != F.col("u"))
    pairs = found.select("u", F.col("fp").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_components(rows: DataFrame, id_column: str, radius: int = 2) -> DataFrame:
    """`rows(…, fp)` with `component` (its root fingerprint) and `component_id`, the smallest id reachable by links."""
    each = settled(rows.groupBy("fp").agg(F.min(id_column).alias("least")))
    tree = components(links(each.select("fp"), radius)).select(F.col("node").alias("nfp"), "root")
    tree = settled(tree)
    linked = each.join(tree, F.col("fp") == F.col("nfp")).groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = tree.join(linked.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("nfp").alias("lfp"), F.col("root").alias("lroot"), F.col("component_id").alias("lid"))
    least = F.when(F.col("lfp").isNotNull(), F.col("lid")).otherwise(F.col("least"))
    label = each.join(of_linked, F.col("fp") == F.col("lfp"), "left").select(F.col("fp").alias("ffp"), F.coalesce("lroot", "fp").alias("component"), least.alias("component_id"))
    return rows.join(settled(label), F.col("fp") == F.col("ffp")).drop("ffp")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """The row with the smallest (id, row hash) of each near-duplicate component, with the columns of `docs`."""
    mark = free_name(docs, "row_mark")
    marked = docs.withColumn(mark, row_hash(docs))
    rows = settled(fingerprints(marked.select(F.col(id_column).alias("id"), F.col(mark).alias("mark"), F.col(text).alias("body")), ["id", "mark"], "body"))
    best = near_components(rows, "id", radius).groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "mark")).alias("b"))
    best = best.select(F.col("b.id").alias("kid"), F.col("b.mark").alias("kmark"))
    return pick_rows(marked, id_column, mark, best, rows).drop(mark)


def pick_rows(marked: DataFrame, id_column: str, mark: str, best: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `marked` named by best(kid, kmark), one of each even where equal rows repeat."""
    times = rows.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeated = times.select(F.col("id").alias("tid"), F.col("mark").alias("tmark"), F.lit(True).alias("twice"))
    best = settled(
        best.join(repeated, F.col("kid").eqNullSafe(F.col("tid")) & (F.col("kmark") == F.col("tmark")), "left").select("kid", "kmark", F.coalesce("twice", F.lit(False)).alias("twice"))
    )
    kid, kmark = free_name(marked, "kid"), free_name(marked, "kmark")
    best = best.select(F.col("kid").alias(kid), F.col("kmark").alias(kmark), F.col("twice").alias("twice"))
    named = lambda rows: rows.select(kid, kmark)
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(kid)) & (F.col(mark) == F.col(kmark))
    once = marked.join(small(named(best.where("NOT twice"))), same, "left_semi")
    more = best.where("twice")
    if more.isEmpty():
        return once
    return once.unionByName(marked.join(small(named(more)), same, "left_semi").dropDuplicates([id_column, mark]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its fingerprint and component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = settled(fingerprints(docs, ["doc_id"]))
    out = near_components(rows, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
