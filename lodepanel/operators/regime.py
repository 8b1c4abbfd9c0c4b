"""Market state by date: statistics over all instruments, a threshold tree, and a label that moves after a streak."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .names import free_name
from .settle import settled

STREAK = 3
TREND_DEFAULT, VOL_DEFAULT, BREADTH_DEFAULT = 0.0, 0.20, 0.5


def market_stats(bars: DataFrame, window: int = 20) -> DataFrame:
    """Per date: trend and yearly volatility of the equal-weight index, and the share of instruments above their mean.

    Instruments are reduced to one row a date first; only that short series is put in one order.
    """
    own = W.partitionBy("instrument").orderBy("date")
    trail = own.rowsBetween(1 - window, 0)
    rows = bars.withColumns({"r": F.try_divide("close", F.lag("close").over(own)) - 1, "m": F.when(F.count("close").over(trail) == window, F.avg("close").over(trail))})
    days = rows.groupBy("date").agg(F.avg("r").alias("r"), F.avg((F.col("close") > F.col("m")).cast("double")).alias("breadth"))
    line = W.orderBy("date").rowsBetween(1 - window, 0)
    full = F.count("r").over(line) == window
    return days.select(
        "date",
        F.when(full, F.avg("r").over(line) * window).otherwise(TREND_DEFAULT).alias("trend"),
        F.when(full, F.stddev_samp("r").over(line) * 252**0.5).otherwise(VOL_DEFAULT).alias("vol"),
        F.coalesce("breadth", F.lit(BREADTH_DEFAULT)).alias("breadth"),
    )


def candidate(trend: Column, vol: Column, breadth: Column, high_vol: float = 0.35, strong: float = 0.02) -> Column:
    """The label that the statistics alone give."""
    return F.when(vol > high_vol, "stress").when((trend > strong) & (breadth > 0.5), "up").when((trend < -strong) & (breadth < 0.5), "down").otherwise("flat")


def advance(state: tuple[str | None, str | None, int], label: str) -> tuple[str | None, str | None, int]:
    """(stable label, pending label, its run): the stable label follows after STREAK equal candidates."""
    stable, pending, run = state
    run = run + 1 if label == pending else 1
    return (label if stable is None or run >= STREAK else stable), label, run


def stable_labels(labelled: DataFrame) -> DataFrame:
    """`labelled(series, date, candidate)` with the stable label of each date: the last that ran for STREAK dates, else the first.

    A run is told by the difference of two row numbers; a series has one row a date.
    """
    line = W.partitionBy("series").orderBy("date")
    island = F.row_number().over(line) - F.row_number().over(W.partitionBy("series", "candidate").orderBy("date"))
    rows = labelled.select("series", "date", "candidate").withColumn("_island", island)
    run = F.row_number().over(W.partitionBy("series", "candidate", "_island").orderBy("date"))
    rows = rows.withColumn("_long", F.when(run >= STREAK, F.col("candidate")))
    return rows.select("series", "date", "candidate", F.coalesce(F.last("_long", ignorenulls=True).over(line), F.first("candidate").over(line)).alias("stable"))


def stable_label_stream(labelled: DataFrame) -> DataFrame:
    """The same over a stream of `labelled(series, date, candidate)`; rows come in date order from batch to batch."""

    def walk(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0)
        # A key's rows of a batch may come in several frames, in no order; a series has one row a date.
        frame, out = pd.concat(frames).sort_values("date"), []
        for label in frame.candidate:
            held = advance(held, label)
            out.append(held[0])
        state.update(held)
        yield pd.DataFrame({"series": key[0], "date": frame.date, "candidate": frame.candidate, "stable": out})

    return labelled.groupBy("series").applyInPandasWithState(
        walk, "series string, date date, candidate string, stable string", "stable string, pending string, run long", "append", GroupStateTimeout.NoTimeout
    )


#: Thresholds of the regime labels, and the share of its confidence that a label keeps while the latest
#: candidate is another one.
CRISIS_VOL, RISK_OFF_VOL, LOW_VOL, VOL_MARGIN = 0.35, 0.25, 0.20, 0.005
DOWNTREND, UPTREND, WEAK_BREADTH, STRONG_BREADTH = -0.05, 0.02, 0.40, 0.55
DISAGREEMENT = 0.75
LABELS = ("crisis", "risk_off", "risk_on", "transition")
START = "transition"
#: Dates whose maps are composed in one go.
FAN = 64


def classified(vol: Column, trend: Column, breadth: Column, current: Column) -> Column:
    """The label of a date's statistics, given the label that holds; a struct with its confidence.

    The label that holds is left later than it is entered, by a margin of volatility. A missing statistic meets no bound.
    """
    is_now = lambda label: current.eqNullSafe(F.lit(label))
    ok = lambda c: F.coalesce(c, F.lit(False))
    crisis_out = F.when(is_now("crisis"), CRISIS_VOL - VOL_MARGIN).otherwise(CRISIS_VOL)
    risk_off_out = F.when(is_now("risk_off"), RISK_OFF_VOL - VOL_MARGIN).otherwise(RISK_OFF_VOL)
    low_out = F.when(is_now("risk_on"), LOW_VOL + VOL_MARGIN).otherwise(LOW_VOL)
    high, falling = ok(vol >= CRISIS_VOL), ok(trend <= DOWNTREND)
    warnings = ok(vol >= risk_off_out).cast("int") + falling.cast("int") + ok(breadth <= WEAK_BREADTH).cast("int")
    rising = ok((vol < low_out) & (trend >= UPTREND) & (breadth >= STRONG_BREADTH))
    margin = F.least((LOW_VOL - vol) / LOW_VOL, trend / UPTREND, (breadth - STRONG_BREADTH) / (1 - STRONG_BREADTH))
    said = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.round(F.least(F.lit(1.0), confidence), 4).alias("confidence"))
    return (
        F.when(high, said("crisis", (vol - CRISIS_VOL) / 0.10 + 0.8))
        .when(is_now("crisis") & ok(vol >= crisis_out) | ok(vol >= RISK_OFF_VOL) & falling, said("crisis", F.lit(0.75)))
        .when(warnings > 0, said("risk_off", 0.5 + 0.15 * warnings))
        .when(rising, said("risk_on", 0.6 + 0.4 * margin))
        .otherwise(said("transition", F.lit(0.5)))
    )


def states_before(steps: DataFrame, by: list[str], nth: str, step: str, start: int) -> DataFrame:
    """(by, nth, state): the state before each step of a machine with few states, by a prefix scan.

    `step` is an array that maps state (from 0) to state; steps are numbered from 1 in `nth` within `by`. FAN
    neighbouring maps are composed to one, level by level, until one is left; then the states before are handed down.
    No task holds more than FAN maps of a series at a time, and no series is walked from end to end.
    """
    levels = [steps.select(*by, F.col(nth).cast("long").alias("nth"), F.col(step).alias("map"))]
    left = levels[0].agg(F.max("nth")).first()[0] or 0
    blocks = []
    while left > 1:
        level = levels[-1].groupBy(*by, F.floor((F.col("nth") - 1) / FAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct("nth", "map"))).alias("items"))
        blocks.append(settled(level))
        one = F.aggregate("items", F.lit(None).cast("array<int>"), lambda acc, x: F.when(acc.isNull(), x["map"]).otherwise(F.transform(acc, lambda s: F.get(x["map"], s))))
        levels.append(blocks[-1].select(*by, (F.col("block") + 1).alias("nth"), one.alias("map")))
        left = -(-left // FAN)
    known = levels[-1].select(*by, "nth", F.lit(start).alias("state"))
    for level in reversed(blocks):
        above = known.select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("nth") - 1).alias("_block"), "state")
        on = F.col("block") == F.col("_block")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        begin = F.struct(F.col("state").alias("s"), F.array().cast("array<int>").alias("seen"))
        seen = F.aggregate("items", begin, lambda acc, x: F.struct(F.get(x["map"], acc["s"]).alias("s"), F.array_append(acc["seen"], acc["s"]).alias("seen")))["seen"]
        each = level.join(above, on).select(*by, F.explode(F.arrays_zip(F.col("items.nth").alias("nth"), seen.alias("state"))).alias("e"))
        known = each.select(*by, "e.nth", "e.state")
    return known


def regime_states(stats: DataFrame, window: int = STREAK) -> DataFrame:
    """stats(series, date, vol, trend, breadth) with candidate, label and confidence of each date.

    The candidate is classified under the label that holds; `window` equal candidates in a row make it the label. A
    state of the machine is (label, last candidate, its run up to `window`); each date maps states to states, and the
    maps are composed by `states_before`. A series has one row a date.
    """
    runs = [(label, last, run) for label in LABELS for last in LABELS for run in range(1, window + 1)]
    states = [(label, None, 0) for label in LABELS] + runs
    number = {s: i for i, s in enumerate(states)}

    def after(label: str, last: str | None, run: int, seen: str) -> int:
        run = min(run + 1, window) if last == seen else 1
        return number[seen if run >= window else label, seen, run]

    table = F.lit([[after(*s, seen) for s in states] for seen in LABELS])
    nth, under, series, at, state, now, held = (free_name(stats, x) for x in ("_nth", "_under", "_series", "_at", "_state", "_now", "_held"))
    vol, trend, breadth = F.col("vol"), F.col("trend"), F.col("breadth")
    place = lambda label: F.array_position(F.lit(list(LABELS)), label).cast("int") - 1
    rows = stats.withColumn(nth, F.row_number().over(W.partitionBy("series").orderBy("date")))
    rows = settled(rows.withColumn(under, F.array(*[place(classified(vol, trend, breadth, F.lit(label))["label"]) for label in LABELS])))
    # For each state: what is seen under its label, and so the state after.
    of_state = F.lit([LABELS.index(s[0]) for s in states])
    step = F.transform(of_state, lambda label, i: F.get(F.get(table, F.get(F.col(under), label)), i))
    before = states_before(rows.select("series", F.col(nth).alias("nth"), step.alias("step")), ["series"], "nth", "step", number[START, None, 0])
    before = before.select(F.col("series").alias(series), F.col("nth").alias(at), F.col("state").alias(state))
    names = F.lit([s[0] for s in states])
    out = rows.join(before, F.col("series").eqNullSafe(F.col(series)) & (F.col(nth) == F.col(at)))
    out = out.withColumn(now, classified(vol, trend, breadth, F.get(names, F.col(state))))
    out = out.withColumn(held, F.get(names, F.get(F.get(table, place(F.col(f"{now}.label"))), F.col(state))))
    sure = F.when(F.col(held) == F.col(f"{now}.label"), F.col(f"{now}.confidence")).otherwise(F.col(f"{now}.confidence") * DISAGREEMENT)
    return out.select(*stats.columns, F.col(f"{now}.label").alias("candidate"), F.col(held).alias("label"), sure.alias("confidence"))
