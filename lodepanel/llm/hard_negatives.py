"""Hard negatives for a set of anchor vectors, by a vector-approximation file.

Components are whole numbers, floor(scale * x). Each dimension is quantised into 16 cells of about equally many rows,
two dimensions to a code byte. For an anchor, tables give for each code the least and the most that its two
dimensions can add to the score; their sums over a row's codes bound the row's score from both sides. Rows are read in parts;
within a part the k best surest rows set a threshold, and only rows that the bounds cannot rule out are scored exactly.

Two searches follow each other. The first finds each anchor's positives: the best rows of its own label. They fix a window
of scores for each positive, and the second finds the best rows of other labels inside the windows. Each part answers with
at most k rows a window; the answers are merged by Spark. All rows meet all anchors, in parts and groups of a bounded size.

The cells are fitted on approximate quantiles of all rows; outermost cells reach to a part's own extremes, so that the
bounds hold for every row. Bounds and scores are exact in 64-bit floats while no score can reach 2^52; rows of larger
components are scored in whole numbers of Python for every anchor, with no bounds, and scores beyond 64 bits end at
the largest (or smallest) long.

Defined results: rows with a null label, a null vector or a null, NaN or infinite component take no part; a row without an
id keeps its label, is no anchor, and comes last among equal scores; a shorter vector counts as filled up with zeros;
repeated rows and ids are rows of their own, and an anchor's copy is one of its other rows; ties go to the smaller id;
an empty table, or one without anchors, gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._text import settled, table

CELLS = 16
SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST = 80
#: Rows of a part (at least PARTS parts) and anchors of a group.
PART, PARTS, GROUP = 1 << 14, 16, 1 << 11
SAFE = float(1 << 52)
NO_ID = (1 << 63) - 1


class Cells:
    """Edges of each dimension's cells: cell c of dimension d holds whole numbers from edges[d, c - 1] to edges[d, c] - 1."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges if len(edges) % 2 == 0 else np.concatenate((edges, np.zeros((1, edges.shape[1]))))
        self.dims = len(self.edges)

    def widened(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if vectors.shape[1] == self.dims else np.concatenate((vectors, np.zeros((len(vectors), self.dims - vectors.shape[1]))), axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each two dimensions, a column for each vector."""
        cells = np.stack([np.searchsorted(self.edges[d], vectors[:, d], side="right") for d in range(self.dims)])
        return cells[0::2] * CELLS + cells[1::2]

    def reach(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that a component in each cell (dimension, cell) can be, for these vectors."""
        low = np.concatenate((np.minimum(vectors.min(axis=0), self.edges[:, 0])[:, None], self.edges), axis=1)
        high = np.concatenate((self.edges - 1, np.maximum(vectors.max(axis=0), self.edges[:, -1])[:, None]), axis=1)
        return low, np.maximum(high, low)

    def tables(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a code's two dimensions add to the score of `anchor` at least and at most."""
        a, b = anchor[:, None] * low, anchor[:, None] * high
        least, most = np.minimum(a, b), np.maximum(a, b)
        pair = lambda t: (t[0::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, CELLS * CELLS)
        return pair(least), pair(most)


def whole_vectors(column: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, with zeros up to `dims`."""
    arrays = column.combine_chunks()
    sizes = arrays.value_lengths().to_numpy()
    flat = np.floor(arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


class Part:
    """Rows of one part with their codes, sorted by id."""

    def __init__(self, rows: pa.Table, cells: Cells, scale: int):
        ids = rows["id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.own = ids[order], rows["row"].to_numpy()[order]
        self.labels = rows["label"].to_numpy()[order]
        self.vectors = cells.widened(whole_vectors(rows["vector"], cells.dims, scale))[order]
        self.cells = cells
        self.codes = cells.codes(self.vectors)
        self.low, self.high = cells.reach(self.vectors)
        self.span = np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1)
        self.by_label = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels)}

    def safe(self, anchor: np.ndarray) -> bool:
        return bool((np.abs(anchor) * self.span).sum() < SAFE)

    def bounds(self, anchor: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = self.cells.tables(anchor, self.low, self.high)
        low, high = least[0].take(codes[0]), most[0].take(codes[0])
        for k in range(1, len(codes)):
            low += least[k].take(codes[k])
            high += most[k].take(codes[k])
        return low, high

    def scores(self, anchor: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Exact scores of the rows `who`."""
        if self.safe(anchor):
            return (self.vectors[who] @ anchor).astype(np.int64)
        mine = [int(x) for x in anchor]
        exact = (sum(int(x) * y for x, y in zip(self.vectors[r], mine, strict=True)) for r in who)
        return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)

    def best(self, anchor: np.ndarray, who: np.ndarray, windows: list[tuple[int, int]], k: int, bounds=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends in it): the first k of the rows `who` in it, with their scores."""
        if not len(who):
            return [(who, np.zeros(0, dtype=np.int64)) for _ in windows]
        if not self.safe(anchor):
            possible, keeps = who, [np.ones(len(who), dtype=bool) for _ in windows]
        else:
            low, high = bounds
            keeps = []
            for least, most in windows:
                keep = (high >= least) & (low <= most)
                sure = low[(low >= least) & (high <= most)]
                if len(sure) > k:
                    keep &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keeps.append(keep)
            possible = who[np.logical_or.reduce(keeps)]
        score, out = self.scores(anchor, possible), []
        for least, most in windows:
            inside = np.flatnonzero((score >= least) & (score <= most))
            if len(inside) > k:  # rows come by id, so that a stable sort leaves the smaller id first
                inside = inside[np.argsort(-score[inside].astype(np.float64) if self.safe(anchor) else np.array([-int(x) for x in score[inside]], dtype=object), kind="stable")[:k]]
            out.append((possible[inside], score[inside]))
        return out


def _near(anchors: DataFrame, rows: DataFrame, search: Callable[[pa.Table, Part], pa.Table], edges: np.ndarray, groups: int, parts: int, scale: int, schema: str) -> DataFrame:
    """`search(anchors of a group, a part)` for each group of anchors and part of the rows."""
    cells = Cells(edges)
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides may come from one table
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    n = min(groups * parts, 4096)
    left, right = left.repartition(n, "group", "part"), right.repartition(n, "group", "part")
    empty = pa.schema([(f.name, f.type) for f in _arrow(schema)]).empty_table()

    def run(some: pa.Table, part: pa.Table) -> pa.Table:
        return search(some, Part(part, cells, scale)) if some.num_rows and part.num_rows else empty

    return left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(run, schema)


def _arrow(schema: str) -> list[pa.Field]:
    return [pa.field(x.split()[0], pa.int64()) for x in schema.split(", ")]


_FOUND = "anchor_row long, nth long, row long, id long, score long"


def _found(parts: list[tuple[int, int, Part, np.ndarray, np.ndarray]]) -> pa.Table:
    names = [f.name for f in _arrow(_FOUND)]
    if not parts:
        return pa.schema(_arrow(_FOUND)).empty_table()
    columns = [np.concatenate([np.full(len(who), a) for a, _, _, who, _ in parts]), np.concatenate([np.full(len(who), k) for _, k, _, who, _ in parts])]
    columns += [np.concatenate([p.own[who] for _, _, p, who, _ in parts]), np.concatenate([p.ids[who] for _, _, p, who, _ in parts]), np.concatenate([s for *_, s in parts])]
    return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=names)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key's rows, with their place from 1 on."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: str, vector: str = "embedding", label: str = "label", key: str = "vec_id",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` is a condition on `rows` in SQL. Of each anchor's first `positives` rows of its label, each gets the
    first `negatives` rows of other labels whose scores are at most its own and at least `least` hundredths of it.
    """
    x = F.col(f"`{vector}`")
    sound = F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    taken = rows.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), x.alias("vector"), F.coalesce(F.expr(anchors), F.lit(False)).alias("anchor")
    )
    taken = settled(taken)  # row numbers must not change when an executor is lost
    n, n_anchors, dims = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts, groups, dims = max(PARTS, -(-n // PART)), max(1, -(-n_anchors // GROUP)), max(dims, 2)
    edges = np.zeros((dims, CELLS - 1))
    shares = [k / CELLS for k in range(1, CELLS)]
    fitted = taken.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.percentile_approx(F.floor(F.col("x").cast("double") * scale).cast("double"), shares, 1000).alias("edges"))
    for r in fitted.collect():  # a row for each dimension
        edges[r["dim"]] = r["edges"]
    by_part, by_group = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    rows_in = taken.select("row", "id", "label", "vector", by_part.alias("part"))
    asking = taken.where("anchor").select("row", "id", "label", "vector", by_group.alias("group"))

    def same_label(some: pa.Table, part: Part) -> pa.Table:
        found, everything = [], [(-(1 << 63), (1 << 63) - 1)]
        vectors = part.cells.widened(whole_vectors(some["vector"], part.cells.dims, scale))
        for anchor, own, mine in zip(vectors, some["row"].to_pylist(), some["label"].to_pylist(), strict=True):
            who = part.by_label.get(mine)
            if who is None:
                continue
            who = who[part.own[who] != own]
            (got, score), = part.best(anchor, who, everything, positives, part.bounds(anchor, part.codes[:, who]) if part.safe(anchor) else None)
            found.append((own, 0, part, got, score))
        return _found(found)

    best = settled(_first(_near(asking, rows_in, same_label, edges, groups, parts, scale, _FOUND), ["anchor_row"], positives))
    windows = best.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("windows"))  # `positives` rows at most
    windowed = asking.join(windows, F.col("row") == F.col("anchor_row")).select("row", "id", "label", "vector", "group", F.col("windows.rank").alias("ranks"), F.col("windows.score").alias("tops"))

    def other_labels(some: pa.Table, part: Part) -> pa.Table:
        found = []
        vectors = part.cells.widened(whole_vectors(some["vector"], part.cells.dims, scale))
        for anchor, own, mine, ranks, tops in zip(vectors, *[some[c].to_pylist() for c in ("row", "label", "ranks", "tops")], strict=True):
            spans = [(-(-least * top // 100), top) for top in tops]
            others = np.flatnonzero(part.labels != mine)
            bounds = None
            if part.safe(anchor):
                low, high = part.bounds(anchor, part.codes)
                bounds = low[others], high[others]
            for rank, (got, score) in zip(ranks, part.best(anchor, others, spans, negatives, bounds), strict=True):
                found.append((own, rank, part, got, score))
        return _found(found)

    worst = _first(_near(windowed, rows_in, other_labels, edges, groups, parts, scale, _FOUND), ["anchor_row", "nth"], negatives)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pairs = best.select(F.col("anchor_row").alias("a"), F.col("rank").cast("long").alias("b"), real("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worst.join(pairs, (F.col("anchor_row") == F.col("a")) & (F.col("nth") == F.col("b"))).join(asking.select(F.col("row").alias("r"), F.col("id").alias("anchor_id")), F.col("anchor_row") == F.col("r"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of `embeddings` whose id is divisible by 100; each seventh id carries a wrong label."""
    rows = table(spark, sf_dir, "embeddings")
    wrong = F.col("vec_id") % 7 == 0
    rows = rows.select("vec_id", "embedding", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, "vec_id % 100 = 0")


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5"""
