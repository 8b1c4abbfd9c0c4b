"""Out-of-sample evidence of many expressions at once, the promotion gate, and a greedy choice of unlike ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import Expression, evaluate
from ..functions.grouped import group_ics, pooled_products, ranked
from .audit import longest_below_zero
from .settle import settled


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def date_folds(dates: DataFrame, folds: int = 4, embargo: int = 5, least: int = 20) -> DataFrame:
    """(date, fold) of `dates(date)` in `folds` contiguous parts of about equal length, trimmed by `embargo` dates at each inner
    boundary. Parts of under `least` dates after that, and all parts if there are under folds * least dates, go.

    Dates are numbered in one task; there are few.
    """
    days = dates.select("date").distinct().withColumns({"nth": F.row_number().over(W.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))})
    bound = lambda k: F.floor(F.lit(k) * F.col("n") / F.lit(folds))
    parts = F.array(*[
        F.struct(F.lit(k).alias("fold"), (bound(k) + (embargo if k else 0)).alias("first"), (bound(k + 1) - (0 if k == folds - 1 else embargo)).alias("end")) for k in range(folds)
    ])
    each = days.where(F.col("n") >= folds * least).select("date", "nth", F.explode(parts).alias("p")).select("date", "nth", "p.*")
    return each.where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("end")) & (F.col("end") - F.col("first") >= least)).select("date", "fold")


def evaluated(panel: DataFrame, expressions: dict[str, Expression], keep: list[str]) -> DataFrame:
    """`keep` and all expressions of a panel, written once; equal subtrees are computed once, infinities are missing."""
    out = evaluate(panel, expressions, keep)
    return settled(out.select(*keep, *[finite(F.col(n)).alias(n) for n in expressions]))


def fold_evidence(
    rows: DataFrame, names: list[str], label: str, baselines: list[str] | None = None,
    folds: int = 4, embargo: int = 5, least: int = 20,
) -> DataFrame:
    """A row a name: mean_ic, rank_ic, icir over valid folds, their ICs, worst run, valid folds and dates, turnover,
    coverage, and the largest pooled correlation with a baseline.

    `rows(instrument, date, …)` hold all names as columns, and stay that wide: ranks and ICs of all names come from one
    group a date, pooled correlations from sums of whole batches, and folds are a map from dates. A fold with under
    `least` dates with an IC is not valid.
    """
    baselines, places = baselines or [], {f"_r{k}": n for k, n in enumerate(names)}
    before = W.partitionBy("instrument").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    held = rows.select("instrument", "date", *[F.col(n).cast("double").alias(n) for n in names])
    moved = ranked(held, places, ["instrument", "date"], ["date"])
    moved = moved.select("date", *[F.abs(F.col(r) - F.last(r, ignorenulls=True).over(before)).alias(r) for r in places])
    daily = moved.groupBy("date").agg(*[F.avg(r).alias(r) for r in places]).agg(*[F.avg(r).alias(r) for r in places])
    turned = daily.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(r).alias("turnover")) for r, n in places.items()])).alias("e")).select("e.*")
    columns = list(dict.fromkeys([*names, *baselines]))
    sums = pooled_products(rows, columns).where("n > 1")
    at, size = F.array(*[F.lit(c) for c in columns]), F.abs(F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0))).alias("size")
    sides = F.array(F.struct(F.get(at, "i").alias("name"), F.get(at, "j").alias("base")), F.struct(F.get(at, "j").alias("name"), F.get(at, "i").alias("base")))
    near = sums.select(F.explode(sides).alias("e"), size).select("e.*", "size").where(F.col("base").isin(baselines)).groupBy("name").agg(F.max("size").alias("max_corr"))
    known = rows.agg(*[F.count(n).alias(f"_n{k}") for k, n in enumerate(names)], *[F.count(F.when(F.col(n).isNotNull(), F.col(label))).alias(f"_y{k}") for k, n in enumerate(names)])
    covered = known.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_n{k}").alias("many"), F.col(f"_y{k}").alias("coverage")) for k, n in enumerate(names)])).alias("e")).select("e.*").where("many > 0")
    corr = covered.join(near, "name", "left").select("name", "coverage", F.coalesce("max_corr", F.lit(0.0)).alias("max_corr"))
    mapped = F.broadcast(date_folds(rows, folds, embargo, least).select(F.col("date").alias("on_date"), "fold"))  # a row a date
    daily = group_ics(rows.join(mapped, F.col("date") == F.col("on_date")), names, label, ["fold", "date"], plain=True)
    daily = daily.select(F.col("feature").alias("name"), "fold", "date", F.col("plain_ic").alias("ic"), F.col("ic").alias("rank_ic"))
    each = daily.groupBy("name", "fold").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("ic").alias("dates"))
    # All folds of all names, so that a fold that is not valid ends a run.
    grid = corr.select("name").select("name", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    valid = grid.join(each.where(F.col("dates") >= least), ["name", "fold"], "left")
    line = F.sort_array(F.collect_list(F.struct("fold", "rank_ic")))
    got = valid.groupBy("name").agg(
        F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("rank_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.transform(line, lambda x: x["rank_ic"]).alias("fold_ics"), longest_below_zero("ic", "fold").alias("negative_folds"), F.count("ic").alias("valid_folds"), F.coalesce(F.sum("dates"), F.lit(0)).alias("dates"),
    )
    return got.join(corr, "name").join(turned, "name", "left")


class Bounds(NamedTuple):
    """What an expression must reach to be promoted."""

    rank_ic: float = 0.04
    icir: float = 0.3
    negative_folds: int = 1
    valid_folds: int = 4
    correlation: float = 0.5
    dates: int = 100
    turnover: float = 0.4


def failed_checks(bounds: Bounds = Bounds()) -> Column:
    """The names of the checks that a row of evidence fails, but for likeness; a missing measure fails."""
    short = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(
        short(F.col("rank_ic") >= bounds.rank_ic, "rank_ic"), short(F.col("icir") >= bounds.icir, "icir"), short(F.col("turnover") <= bounds.turnover, "turnover"),
        short(F.col("dates") >= bounds.dates, "dates"), short(F.col("negative_folds") <= bounds.negative_folds, "negative_folds"), short(F.col("valid_folds") >= bounds.valid_folds, "valid_folds"),
    ))


def promotions(evidence: DataFrame, matrix: DataFrame, order: list[str], library: list[str] | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """(name, nth, promoted, max_corr, failed): names in order, each held against the library and those promoted before it.

    `matrix(a, b, corr)` are pooled correlations, computed in Spark; a row a name and a row a pair of names is all
    that is walked here.
    """
    failed = {r["name"]: list(r["failed"]) for r in evidence.select("name", failed_checks(bounds).alias("failed")).collect()}
    alike = {(r["a"], r["b"]): abs(r["corr"]) for r in matrix.collect()}
    kept, out = list(library or []), []
    for k, name in enumerate(order):
        checks = failed.get(name, ["evidence"])
        near = max((alike.get((name, other), 0.0) for other in kept), default=0.0)
        if near > bounds.correlation:
            checks = [*checks, "correlation"]
        if not checks:
            kept.append(name)
        out.append((name, k, not checks, near, checks))
    return evidence.sparkSession.createDataFrame(out, "name string, nth int, promoted boolean, max_corr double, failed array<string>")
