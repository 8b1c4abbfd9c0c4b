"""Bars at rest: a partitioned store with idempotent writes, vendor files, and documents as plain text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.quality import adjust, dedup_last
from ..operators.settle import settled

DAY_SECONDS = 86_400
#: Names of the store's folders.
FOLDERS = {True: "daily", False: "intraday"}


def read_store(spark: SparkSession, root: str) -> DataFrame | None:
    """The whole store, or None where nothing has been stored yet."""
    try:
        return spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def store_bars(bars: DataFrame, root: str) -> None:
    """Merge `bars(bar_id, instrument, ts, bar_seconds, ingest_seq, …)` into the store.

    Known bar ids change nothing; of several bars of an instrument, time and length the last ingested stays. Only
    the (bucket, year) partitions that get new bars are read and overwritten; a bar's id does not move between them.
    """
    spark = bars.sparkSession
    folder = F.when(F.col("bar_seconds") == DAY_SECONDS, FOLDERS[True]).otherwise(FOLDERS[False])
    new = bars.withColumns({"bucket": folder, "year": F.year("ts")})
    held = read_store(spark, root)
    if held is not None:
        touched = new.select("bucket", "year").distinct().collect()  # at most two a year
        among = F.lit(False)
        for part in touched:
            among = among | ((F.col("bucket") == part["bucket"]) & (F.col("year") == part["year"]))
        held = held.where(among)
        new = held.unionByName(new.join(held.select("bar_id"), "bar_id", "left_anti"))
    merged = dedup_last(new, ["instrument", "ts", "bar_seconds"], ["ingest_seq", "bar_id"])
    if held is not None:  # written aside first: a partition is not overwritten while it is read
        merged = settled(merged)
    merged.repartition("bucket", "year", F.pmod(F.hash("instrument"), F.lit(16))).write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "year").mode("overwrite").parquet(root)


def load_bars(spark: SparkSession, root: str, start, end, bar_seconds: int = DAY_SECONDS, instruments: list | None = None, columns: list[str] | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Bars of a closed time window; years, bucket, columns and instruments are pruned at the scan."""
    bucket = FOLDERS[bar_seconds == DAY_SECONDS]
    rows = spark.read.parquet(root).where((F.col("bucket") == bucket) & (F.col("bar_seconds") == bar_seconds) & F.col("ts").between(start, end))
    rows = rows.where(F.col("year").between(F.year(F.lit(start)), F.year(F.lit(end))))
    if instruments is not None:
        rows = rows.where(F.col("instrument").isin(instruments))
    if actions is not None:
        rows = adjust(rows.withColumn("date", F.to_date("ts")), actions)
    return rows.select(*columns) if columns else rows


def load_vendor_file(spark: SparkSession, path: str, symbols: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """Vendor bars of a CSV or Parquet file with `symbols(symbol, instrument)` resolved; unknown symbols are left out.

    Values that are no numbers or times become NULL; a missing column raises.
    """
    wanted = ("symbol", "timestamp", "open", "high", "low", "close", "volume")
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    numbers = [F.col(c).try_cast("double").alias(c) for c in (*wanted[2:], "vwap") if c in rows.columns]
    typed = rows.select("symbol", F.col("timestamp").try_cast("timestamp").alias("ts"), *numbers)
    return typed.join(symbols, "symbol").drop("symbol").withColumn("bar_seconds", F.lit(bar_seconds))


_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<[!?][^<>]*>", re.S)


def visible_lines(document: str | None) -> str:
    """The document's text between its markup, a line each, without blank ones; the document itself if that is nothing."""
    text = entities.unescape(_MARKUP.sub("\n", document or ""))
    kept = [bare for line in text.splitlines() if (bare := line.strip())]
    return "\n".join(kept) or (document or "").strip()


@F.pandas_udf(StringType())
def document_text(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in html:
        yield batch.map(visible_lines)
