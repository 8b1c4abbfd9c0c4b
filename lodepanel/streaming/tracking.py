"""Rolling rank IC of scores against the prices that come after them, kept in a stream's state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import average_rank
from ..operators.evaluate import safe_corr

OUT = "strategy string, as_of timestamp, n int, ic double, rolling_ic double, observations int"


def rank_ic(scores: np.ndarray, returns: np.ndarray) -> float:
    """The correlation of average ranks; NaN for under two values or without spread."""
    if len(scores) < 2:
        return float("nan")
    a, b = pd.Series(scores).rank().to_numpy(), pd.Series(returns).rank().to_numpy()
    if np.ptp(a) == 0 or np.ptp(b) == 0:
        return float("nan")
    return float(np.corrcoef(a, b)[0, 1])


class RollingIC(StatefulProcessor):
    """Of each strategy: the scores of its last cycle with their prices, the cycles that wait, and the last ICs.

    Rows are (strategy, as_of, instrument, score, price). A cycle is all rows of one time. When a later cycle comes, the
    one before is held against the later prices; at most `window` ICs stay, so state is bounded by a cycle's names. A
    cycle is taken up when the watermark passes it: rows may be spread over batches, and a timer set for it fires then.
    """

    def __init__(self, window: int = 20, wait_ms: int = 0):
        self.window, self.wait_ms = window, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "as_of timestamp, instrument string, score double, price double")
        self.last = handle.getListState("last", "instrument string, score double, price double")
        self.ics = handle.getListState("ics", "ic double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            got = [(r.as_of.to_pydatetime(), r.instrument, r.score, r.price) for r in frame.itertuples(index=False)]
            self.waiting.appendList([(t, i, None if pd.isna(s) else float(s), None if pd.isna(p) else float(p)) for t, i, s, p in got])
            for at in {t for t, *_ in got}:
                self.handle.registerTimer(int(pd.Timestamp(at).value // 1_000_000) + self.wait_ms)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - self.wait_ms, unit="ms")
        waiting = list(self.waiting.get())
        due = [r for r in waiting if pd.Timestamp(r[0]) <= upto]
        out = []
        for at in sorted({r[0] for r in due}):
            cycle = {i: (s, p) for t, i, s, p in due if t == at}
            before = {i: (s, p) for i, s, p in self.last.get()}
            both = sorted(i for i in before if i in cycle and before[i][0] is not None and cycle[i][1] is not None and before[i][1] is not None and before[i][1] > 0)
            ic = rank_ic(np.array([before[i][0] for i in both]), np.array([(cycle[i][1] - before[i][1]) / before[i][1] for i in both]))
            ics = [x[0] for x in self.ics.get()]
            if not np.isnan(ic):
                ics = [*ics, ic][-self.window :]
                self.ics.put([(x,) for x in ics])
            rolling = float(np.mean(ics)) if len(ics) >= 2 else float("nan")
            out.append((key[0], at, len(both), ic, rolling, len(ics)))
            if any(s is not None for s, _ in cycle.values()):
                self.last.put([(i, s, p) for i, (s, p) in sorted(cycle.items()) if s is not None])
        if due:
            left = [r for r in waiting if pd.Timestamp(r[0]) > upto]
            self.waiting.put([tuple(r) for r in left]) if left else self.waiting.clear()
        frame = pd.DataFrame(out, columns=["strategy", "as_of", "n", "ic", "rolling_ic", "observations"])
        yield frame.astype({"n": "int32", "observations": "int32"})

    def close(self) -> None:
        pass


def rolling_ic_stream(scores: DataFrame, window: int = 20, delay: str = "0 seconds") -> DataFrame:
    """A row for each cycle of each strategy that the watermark has passed, from a stream of
    scores(strategy, as_of, instrument, score, price). Needs the RocksDB state store."""
    timed = scores.select("strategy", "as_of", "instrument", "score", "price").withWatermark("as_of", delay)
    return timed.groupBy("strategy").transformWithStateInPandas(RollingIC(window), OUT, "append", "eventTime")


def rolling_ic(scores: DataFrame, window: int = 20) -> DataFrame:
    """The same of a table. A score is held against the price of its instrument in the next cycle of its strategy."""
    cycles = scores.select("strategy", "as_of").distinct()
    line = W.partitionBy("strategy").orderBy("as_of")  # a row a cycle
    priced = scores.where("score IS NOT NULL").select("strategy", "as_of").distinct().withColumn("scored", F.lit(True))
    cycles = cycles.join(priced, ["strategy", "as_of"], "left").withColumn("before", F.last(F.when(F.col("scored"), F.col("as_of")), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)))
    now = scores.select("strategy", "as_of", "instrument", F.col("price").alias("later"))
    then = scores.where("score IS NOT NULL").select(F.col("strategy").alias("s"), F.col("as_of").alias("t"), F.col("instrument").alias("i"), "score", "price")
    met = cycles.select("strategy", "as_of", "before").join(now, ["strategy", "as_of"], "left")
    met = met.join(then, (F.col("strategy") == F.col("s")) & (F.col("before") == F.col("t")) & (F.col("instrument") == F.col("i")), "left")
    met = met.select("strategy", "as_of", F.when((F.col("price") > 0) & F.col("later").isNotNull(), F.col("score")).alias("x"), F.when(F.col("price") > 0, (F.col("later") - F.col("price")) / F.col("price")).alias("y"))
    met = met.withColumn("y", F.when(F.col("x").isNotNull(), F.col("y")))
    ranked = met.select("strategy", "as_of", average_rank(F.col("x"), "strategy", "as_of").alias("x"), average_rank(F.col("y"), "strategy", "as_of").alias("y"))
    each = ranked.groupBy("strategy", "as_of").agg(F.count("x").cast("int").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("ic"))
    valid = F.sum(F.when(F.col("ic").isNotNull(), 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("valid", valid)
    ics = F.slice(F.concat(F.array_repeat(F.lit(None).cast("double"), window), F.collect_list("ic").over(line.rowsBetween(W.unboundedPreceding, 0))), -window, window)
    known = F.array_compact(ics)
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return each.select("strategy", "as_of", "n", "ic", F.when(F.size(known) >= 2, mean).alias("rolling_ic"), F.least("valid", F.lit(window)).cast("int").alias("observations"))
