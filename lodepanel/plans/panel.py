"""Queries of the expression language and the feature families, with generated SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library
from ..functions.expr import Expression, evaluate, rounded, to_sql
from ..sources import tables

PANELS = {"bars": (tables.bars, tables.BARS_SQL), "quarters": (tables.quarters, tables.QUARTERS_SQL)}


def query(panel: str, expressions: dict[str, Expression]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(Spark query, SQL) of expressions over a panel, rounded to six places."""
    build, sql = PANELS[panel]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = evaluate(build(spark, folder), expressions, ["instrument", "date"])
        return out.select("instrument", "date", *[rounded(F.col(c)).alias(c) for c in expressions])

    return run, "WITH" + sql + to_sql(panel, expressions, "instrument, date")


def all_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    groups: dict[str, tuple[str, dict[str, Expression]]] = {}
    groups |= {f"op_{n}": ("bars", {n: e}) for n, e in library.OPERATOR_SAMPLES.items()}
    groups |= {n if n.startswith("alpha") else f"alpha_{n}": ("bars", {n: e}) for n, e in library.ALPHAS.items()}
    groups |= {n: ("bars", e) for n, e in (library.PRICE_VOLUME | library.MICROSTRUCTURE).items()}
    groups |= {n: ("quarters", e) for n, e in library.FUNDAMENTALS.items()}
    groups |= {f"factor_{n}": ("bars", {n: e}) for n, e in library.CLOSE_FACTORS.items()}
    made = {n: query(p, e) for n, (p, e) in groups.items()}
    return {n: q for n, (q, _) in made.items()}, {n: s for n, (_, s) in made.items()}
