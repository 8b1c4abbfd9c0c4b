"""Windows of feature vectors for sequence models: standardised, left-padded, masked, with the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import free_name


def sequences(
    rows: DataFrame, features: list[str], window: int, fit_on: Column, keep: Column | None = None,
    day: str = "day", time_gap: bool = True,
) -> DataFrame:
    """`rows` that `keep` selects (all, if not given), with sequence and mask.

    A sequence holds `window` vectors of an instrument, oldest first: its own last ones up to the row, and zeros before
    them; the mask is 1 where a vector is real. A vector is the features standardised by mean and population spread of
    the rows that `fit_on` selects (a feature without spread is only centred, a missing one counts as 0 before), and,
    with `time_gap`, ln(1 + days since the vector before). Windows reach back over all `rows`, so that those of a test
    go on from the training rows before it. One aggregation of one row, and one shuffle by instrument.
    """
    mean, spread, line, vector = (free_name(rows, x) for x in ("means", "spreads", "line", "vector"))
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    flat = lambda sd: F.when(sd < 1e-12, 1.0).otherwise(sd)
    fitted = rows.where(fit_on).agg(F.array(*[F.avg(c) for c in x]).alias(mean), F.array(*[flat(F.stddev_pop(c)) for c in x]).alias(spread))
    own = W.partitionBy("instrument").orderBy(day)
    gap = F.ln(1 + F.greatest(F.lit(0), F.coalesce(F.col(day) - F.lag(day).over(own), F.lit(0)))).cast("double")
    z = [F.try_divide(c - F.get(mean, F.lit(i)), F.get(spread, F.lit(i))) for i, c in enumerate(x)]
    got = rows.crossJoin(F.broadcast(fitted)).withColumn(vector, F.array(*z, *([gap] if time_gap else [])))  # one row on the right
    got = got.withColumn(line, F.collect_list(vector).over(own.rowsBetween(1 - window, 0)))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(features) + time_gap), F.lit(window) - F.size(line))
    mask = F.concat(F.array_repeat(F.lit(0), F.lit(window) - F.size(line)), F.array_repeat(F.lit(1), F.size(line)))
    got = got.where(keep) if keep is not None else got
    return got.select(*rows.columns, F.concat(pad, line).alias("sequence"), mask.alias("mask"))
