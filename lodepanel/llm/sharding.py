"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight, with u a hash of the
document's key and the child's name, and the smallest draw wins: a child wins in proportion to its weight, and a
change of one weight moves rows only between that subtree and its siblings. A new shard joins as a region of its
own, so it takes rows only into itself. Slots within a shard are numbered by running totals over input parts, so no
task holds a whole shard. DataFrame functions only.

Law `key`: the id and the shard count decide, so rows of one id share a shard, and equal texts under different ids may
part. Defined results: null ids go to one shard; a null text has no bytes and the checksum of the empty text; a text of
any length is one row; repeated rows share a shard and have slots of their own; `with_shards` and `with_slots` replace a
column called like their result and keep all others, `shard_documents` takes a free name for its own; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import free_name, running_total, settled, table

#: Name of a node, and its children (or the number of the shard and its weight).
Tree = dict[str, "Tree | tuple[int, float]"]


def build_tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """`shards` of weight 1, numbered from 0, dealt evenly over `regions` of `racks` each."""
    tree: Tree = {}
    for k in range(shards):
        place = k * regions * racks // shards
        region = tree.setdefault(f"region-{place // racks}", {})
        region.setdefault(f"rack-{place % racks}", {})[f"shard-{k}"] = (k, 1.0)
    return tree


def grow(tree: Tree) -> Tree:
    """`tree` with one more shard, in a new region of its own."""
    k = 1 + max(_shards(tree))
    return tree | {f"region-of-{k}": {f"rack-of-{k}": {f"shard-{k}": (k, 1.0)}}}


def _shards(tree: Tree) -> list[int]:
    return [n for child in tree.values() for n in (_shards(child) if isinstance(child, dict) else [child[0]])]


def _weight(node: Tree | tuple[int, float]) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node[1]


def place(key: Column, tree: Tree, path: str = "") -> Column:
    """The number of the shard that `key` descends to."""
    if len(tree) == 1:
        (name, child), = tree.items()
        return place(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(child[0])

    def draw(name: str, node: Tree | tuple[int, float]) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 12)
        return -F.ln((bits + 0.5) / float(2**52)) / F.lit(float(_weight(node)))

    children = [(n, c) for n, c in tree.items() if _weight(c) > 0]
    best = F.array_min(F.array(*[F.struct(draw(n, c).alias("cost"), F.lit(i).alias("nth")) for i, (n, c) in enumerate(children)]))["nth"]
    out = F.lit(None).cast("int")
    for i, (name, child) in reversed(list(enumerate(children))):
        below = place(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(child[0])
        out = F.when(best == i, below).otherwise(out)
    return out


def with_shards(docs: DataFrame, tree: Tree, id_column: str = "doc_id", out: str = "shard") -> DataFrame:
    """`docs` with the shard of each row."""
    return docs.withColumn(out, place(F.col(id_column), tree).cast("int"))


def with_slots(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """`rows` with a gapless number from 0 within each shard, in order of input parts.

    Rows are written once with their place in the input, so that a lost executor cannot renumber them.
    """
    at, part, one = (free_name(rows, c) for c in ("slot_at", "slot_part", "slot_one"))
    fixed = settled(rows.withColumn(at, F.monotonically_increasing_id()))
    fixed = fixed.withColumn(part, F.shiftright(F.col(at), 33)).withColumn(one, F.lit(1))
    return running_total(fixed, [shard], part, [at], one, out).drop(at, part, one)


def shard_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id") -> DataFrame:
    """`docs` with `shard`, for writing one folder a shard."""
    return with_shards(docs, build_tree(shards), id_column, free_name(docs, "shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its shard of 16, its slot there, and its shard of 17."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = build_tree(16)
    rows = with_shards(with_shards(rows, tree), grow(tree), out="grown_shard")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
