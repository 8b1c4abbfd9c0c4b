"""Corporate actions, samples and expression libraries at rest."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Expression
from ..functions.serialize import from_dict, stable_id, to_dict
from ..operators.quality import adjust
from .store import read_store

ACTIONS = "action_id string, instrument string, ex_date date, kind string, ratio double, cash double"


def store_actions(actions: DataFrame, root: str) -> None:
    """Append `actions` whose action_id the log does not have; of several new ones of an id the
    first in order of all columns is written, so that reruns agree."""
    others = [c for c in actions.columns if c != "action_id"]
    new = actions.groupBy("action_id").agg(F.min(F.struct(*others)).alias("row")).select("action_id", "row.*").select(*actions.columns)
    held = read_store(actions.sparkSession, root)
    if held is not None:
        new = new.join(held.select("action_id"), "action_id", "left_anti")
    new.write.mode("append").parquet(root)


def read_actions(spark: SparkSession, root: str, instruments: list | None = None) -> DataFrame:
    """The log of actions; none where nothing was stored."""
    held = read_store(spark, root)
    rows = spark.createDataFrame([], ACTIONS) if held is None else held
    return rows if instruments is None else rows.where(F.col("instrument").isin(instruments))


def reprocess(bars: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Adjusted bars of those instruments that have actions, by the log as it is now; a late action changes all bars before it."""
    actions = read_actions(spark, root)
    touched = bars.join(actions.select("instrument").distinct(), "instrument", "left_semi")
    return adjust(touched, actions)


def write_samples(samples: DataFrame, path: str) -> None:
    """One JSON object a line, with times as ISO text."""
    samples.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_bars_file(bars: DataFrame, path: str, kind: str = "parquet") -> None:
    """Vendor bars in the form that `store.load_vendor_file` reads: a folder of Parquet or of CSV with a header."""
    rows = bars.select("symbol", F.col("ts").alias("timestamp"), "open", "high", "low", "close", "volume", *[c for c in ("vwap",) if c in bars.columns])
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def promote(spark: SparkSession, path: str, expressions: dict[str, Expression]) -> list[str]:
    """Append expressions that the library at `path` does not have; the ids of those added."""
    known = {r["id"] for r in library(spark, path).select("id").collect()}
    new = {stable_id(e): (name, e) for name, e in sorted(expressions.items()) if stable_id(e) not in known}
    rows = [(i, name, json.dumps(to_dict(e), sort_keys=True)) for i, (name, e) in new.items()]
    if rows:
        spark.createDataFrame(rows, "id string, name string, expression string").coalesce(1).write.mode("append").json(path)
    return list(new)


def library(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, expression as JSON) of the promoted expressions."""
    schema = "id string, name string, expression string"
    try:
        rows = spark.read.schema(schema).json(path)
        rows.isEmpty()
    except AnalysisException as error:  # a missing folder is an empty library
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows


def expressions(spark: SparkSession, path: str, strict: bool = True) -> dict[str, Expression]:
    """The library's expressions by name; it is as small as the list of features.

    A line that cannot be read, lacks a name, or whose id is not that of its expression raises; unless `strict`, it is left out.
    """
    out: dict[str, Expression] = {}
    for r in sorted(library(spark, path).collect(), key=lambda r: (r["name"] or "", r["id"] or "")):
        try:
            found = from_dict(json.loads(r["expression"] or ""))
            if not r["name"] or stable_id(found) != r["id"]:
                raise ValueError(f"the id or name of {r['name']!r} does not fit its expression")
        except (ValueError, KeyError, TypeError) as error:
            if strict:
                raise ValueError(f"{path}: {r['name']!r} cannot be read: {error}") from error
            continue
        out[r["name"]] = found
    return out
