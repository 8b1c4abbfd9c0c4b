"""Rank correlations pooled over all rows of many overlapping groups, by sorting each column once for all groups.

Bounds cut a column into ranges of about equal size; a value that fills a range by itself becomes a range of its own. How
many rows of each group lie in a range is counted where the rows are, so that a rank is a place within a range plus what
lies before it. A row is dealt once by its label and once by each feature, whatever the number of groups it counts in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settled

#: Rows of a range, each counted once for every group that it belongs to.
RANGE = 400_000


def _place(bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The range of each value: odd ones hold one bound, even ones what lies between two."""
    return np.searchsorted(bounds, x, "left") + np.searchsorted(bounds, x, "right")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _ranks(x: np.ndarray, row: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average ranks, from 1, of each (row, group) among the group's rows here."""
    values, at = np.unique(x, return_inverse=True)
    each, place, many = np.unique(group.astype(np.int64) * len(values) + at[row], return_inverse=True, return_counts=True)
    upto = np.cumsum(many)
    first = np.searchsorted(each, (each // len(values)) * len(values))  # the first value of the group
    before = np.where(first > 0, upto[first - 1], 0)
    return (upto - before - (many - 1) / 2)[place]


def rank_ics(df: DataFrame, features: list[str], label: str, groups: str, n_groups: int) -> DataFrame:
    """(grp, feature, ic): rank correlation of each feature and the label over the rows of each group, 0 without spread.

    `groups` is an array of the numbers, below `n_groups`, of the groups that a row counts in. Rows without a label do not
    count; a missing feature counts as 0. A row a range and group is all that is collected.
    """
    names = ["_l", *(f"_x{i}" for i in range(len(features)))]
    columns = [F.col(label).cast("double").alias("_l"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features))]
    rows = settled(df.where(F.col(label).isNotNull() & (F.size(groups) > 0)).select(F.col(groups).cast("array<int>").alias("_g"), *columns))
    n = rows.agg(F.coalesce(F.sum(F.size("_g")), F.lit(0))).first()[0]
    parts = max(1, -(-n // RANGE))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    cuts = rows.agg(*[F.percentile_approx(c, shares, F.lit(max(1000, 10 * parts))).alias(c) for c in names]).first()
    bounds = [np.unique(np.array(cuts[c] or [], dtype=float)) for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2 * len(b) + 1, n_groups), dtype=np.int64) for b in bounds]
        for batch in batches:
            row, group = _flat(batch.column("_g"))
            for t, b, c in zip(total, bounds, names, strict=True):
                place = _place(b, _numbers(batch.column(c)))[row]
                t += np.bincount(place * n_groups + group, minlength=t.size).reshape(t.shape)
        for k, t in enumerate(total):
            at, group = np.nonzero(t)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "at": pa.array(at, pa.int32()), "grp": pa.array(group, pa.int32()), "n": pa.array(t[at, group], pa.int64())})

    counted = [np.zeros((2 * len(b) + 1, n_groups), dtype=np.int64) for b in bounds]
    for r in rows.mapInArrow(count, "k int, at int, grp int, n long").groupBy("k", "at", "grp").agg(F.sum("n").alias("n")).collect():
        counted[r["k"]][r["at"], r["grp"]] = r["n"]
    before = [np.cumsum(t, axis=0) - t for t in counted]
    middle = (counted[0].sum(axis=0) + 1) / 2
    # A value that fills many ranges is dealt in parts: all its rows have one rank.
    pieces = [np.maximum(1, -(-t.sum(axis=1) // RANGE)) for t in counted]

    def key(k: int, x: np.ndarray) -> np.ndarray:
        at = _place(bounds[k], x)
        many = np.where(at % 2 == 1, pieces[k][at], 1)
        return at * 65536 + np.arange(len(x)) % many

    def centred(k: int, at: int, x: np.ndarray, row: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Average ranks over all rows, less their mean in the group."""
        own = (counted[k][at, group] + 1) / 2 if at % 2 else _ranks(x, row, group)
        return before[k][at, group] + own - middle[group]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key(0, _numbers(batch.column("_l"))), pa.int64()), *batch.columns], ["_k", *batch.schema.names])

    def by_label(table: pa.Table) -> pa.Table:
        at = int(table.column("_k")[0].as_py()) // 65536
        row, group = _flat(table.column("_g"))
        rank = _lists(centred(0, at, _numbers(table.column("_l")), row, group), row, table.num_rows)
        lists = table.column("_g").combine_chunks()
        out = []
        for i in range(len(features)):
            x = _numbers(table.column(f"_x{i}"))
            out.append(pa.table({"f": pa.array(np.full(len(x), i), pa.int32()), "k": pa.array(key(i + 1, x), pa.int64()), "g": lists, "r": rank, "x": pa.array(x, pa.float64())}))
        return pa.concat_tables(out)

    def by_feature(table: pa.Table) -> pa.Table:
        f, at = int(table.column("f")[0].as_py()), int(table.column("k")[0].as_py()) // 65536
        row, group = _flat(table.column("g"))
        b = _flat(table.column("r"))[1]
        a = centred(f + 1, at, _numbers(table.column("x")), row, group)
        sums = [np.bincount(group, weights=v, minlength=n_groups) for v in (a * b, a * a, b * b)]
        seen = np.unique(group)
        return pa.table({"f": pa.array(np.full(len(seen), f), pa.int32()), "grp": pa.array(seen, pa.int32()), **{c: pa.array(s[seen], pa.float64()) for c, s in zip(("ab", "aa", "bb"), sums, strict=True)}})

    kinds = ", ".join(f"{c} double" for c in names)
    dealt = rows.mapInArrow(deal, f"_k long, _g array<int>, {kinds}").groupBy("_k").applyInArrow(by_label, "f int, k long, g array<int>, r array<double>, x double")
    sums = dealt.groupBy("f", "k").applyInArrow(by_feature, "f int, grp int, ab double, aa double, bb double").groupBy("f", "grp").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])
    ic = F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))
    return sums.select("grp", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1).alias("feature"), ic.alias("ic"))
