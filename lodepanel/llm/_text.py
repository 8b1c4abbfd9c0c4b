"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..operators.settle import settled

__all__ = ["let", "words", "plain_words", "windows", "row_hash", "free_name", "settled", "small", "table", "running_total"]

#: White space that ends a word: blank, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_WORD_RUN = r"[^\p{L}\p{M}\p{N}]+"

#: Rows up to which a table of a few numbers a row is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` evaluated once a row although `body` names it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (trimmed == ""), none).otherwise(F.split(trimmed, SPACE_RUN))


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD_RUN), lambda w: w != "")


def windows(items: Column, width: int, build: Callable[[Column], Column], kind: str) -> Column:
    """`build(position)` for each full window of `width` items, by start position (from 0)."""
    n = F.size(items) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), build)).otherwise(
        F.array().cast(f"array<{kind}>")
    )


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns that can be hashed; tells apart rows that share an id."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def width(df: DataFrame) -> Column:
    """About the bytes of a row: eight a number, and the letters or members of strings, binaries and arrays."""
    total: Column = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, ArrayType):
            each = F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16) if isinstance(kind.elementType, StringType) else F.size(c) * 16
            size = F.when(c.isNotNull(), each)
        elif isinstance(kind, (MapType, StructType)):
            size = F.octet_length(F.to_json(c)) if isinstance(kind, StructType) else F.octet_length(F.to_json(F.struct(c)))
        else:
            continue
        total = total + F.coalesce(size, F.lit(0)).cast("long")
    return total


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is shown to have at most `rows` rows and `most` bytes, else as it is (the join shuffles)."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got["n"] <= rows and got["bytes"] <= most else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running total of `value` within `group`, by bucket and then `order`.

    `bucket` cuts a group into parts in order. Parts are summed, the sums of a group are added up over its few
    buckets, and only the rows of one bucket meet in a task, however many rows a group has.
    """
    from pyspark.sql import Window as W

    base, total = free_name(df, "base"), free_name(df, "total")
    parts = df.groupBy(*group, bucket).agg(F.sum(value).alias(total))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*group, bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).cast("long").alias(base))
    within = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
    keys = [*group, bucket]
    names = {k: free_name(local, f"r_{k}") for k in keys}
    right = parts.select(*[F.col(k).alias(names[k]) for k in keys], base)
    match = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return local.join(right, on).withColumn(out, F.col(out) + F.col(base)).drop(base, *names.values())
