"""Quality classification by co-training.

Two logistic classifiers see a document by two views: its text (counts and ratios over the whole text) and its
metadata (language, stated length, its source: how many documents it has, how long they are, and how its labelled ones
were judged, shrunk by a beta prior). Each is fitted on labelled documents; in each round each hands its confident
verdicts on the unlabelled documents of the whole table to the other as pseudo-labels, and is fitted anew. How far down
its ranking of a class a view is trusted is read off labelled documents that neither was fitted on: as far as the
smoothed share of wrong ones above the cut stays within ERROR, and is too small to be chance. A view that is not to be
trusted with both classes hands nothing on. Both views are calibrated on the same documents at the end, and a final curve over the two calibrated log odds scores every document.

Features and scores are column expressions over all rows. Of the labelled rows at most `sample` are fitted on, those
of smallest id hash, as numbers only; this bounds what reaches the driver. Unlabelled rows never reach the driver: each
Newton step adds up their gradient and Hessian where they are. Pseudo-labels of a kind share its part of a mass of half
their number, or MASS times the number of labelled rows if that is less, so that many rows shape the views without
drowning the labels.

Defined results: a null text counts as empty and a text of any length is counted whole; null metadata is a value of its
own; labels other than 0 and 1 are ignored, an id with several labels takes the smallest, labels without an id are
ignored; without labels of both kinds every score is the smoothed rate of label 1; repeated rows and ids, and null ids,
are scored row by row; other columns are not read, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import let, settled, small, table, words
from .quality_rules import SYMBOLS, repeated_words

SAMPLE = 20_000
ROUNDS = 5
#: Verdicts are handed on down to where this share of the labelled ones above may be wrong.
ERROR = 0.1
#: Chance at most that a view without any knowledge is as often right above the cut.
CHANCE = 0.001
#: Weight of all pseudo-labels at most, in units of that of the labels fitted on.
MASS = 4.0
#: Labelled documents that the mean of all counts for in a source's rate.
PRIOR_LABELS = 4.0
LANG_BUCKETS, SOURCE_BUCKETS = 16, 32
TEXT_VIEW = ("log_words", "word_length", "symbols", "exclaims", "capitals", "digits", "distinct", "repeats", "dup_lines", "line_words")
META_NUMBERS = ("log_chars", "no_chars", "rel_chars", "source_docs", "source_rate")
META_COLUMNS = (*META_NUMBERS, "lang_at", "source_at")
META_VIEW = (*META_NUMBERS, *(f"lang{i}" for i in range(LANG_BUCKETS)), *(f"source{i}" for i in range(SOURCE_BUCKETS)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the text view as doubles, and the metadata view but for source_rate; source_key names the source."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("double").alias("n"),
            F.length(F.array_join(w, "")).cast("double").alias("letters"),
            F.size(F.array_distinct(w)).cast("double").alias("different"),
            repeated_words(w).cast("double").alias("again"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("different"))

    rows = docs.select(
        "doc_id",
        let(words(F.col("text")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("double").alias("symbol_count"),
        F.regexp_count(body, F.lit("!")).cast("double").alias("exclaim_count"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("double").alias("capital_count"),
        F.regexp_count(body, F.lit(r"\p{N}")).cast("double").alias("digit_count"),
        F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")).alias("log_chars"),
        F.col("n_chars").isNull().cast("double").alias("no_chars"),
        F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\x00"))), F.lit(LANG_BUCKETS)).cast("int").alias("lang_at"),
        F.xxhash64(F.coalesce("source", F.lit("\x00"))).alias("source_key"),
    )
    n, letters = F.greatest(F.col("w.n"), F.lit(1.0)), F.greatest(F.col("w.letters"), F.lit(1.0))
    view = {
        "log_words": F.log1p("w.n"),
        "word_length": F.least(F.col("w.letters") / n, F.lit(40.0)),
        "symbols": F.least(F.col("symbol_count") / n, F.lit(3.0)),
        "exclaims": F.least(F.col("exclaim_count") / n, F.lit(3.0)),
        "capitals": F.col("capital_count") / letters,
        "digits": F.col("digit_count") / letters,
        "distinct": F.col("w.different") / n,
        "repeats": F.col("w.again") / n,
        "dup_lines": 1 - F.col("l.different") / F.greatest(F.col("l.n"), F.lit(1.0)),
        "line_words": F.log1p(F.col("w.n") / F.greatest(F.col("l.n"), F.lit(1.0))),
    }
    source_at = F.pmod("source_key", F.lit(SOURCE_BUCKETS)).cast("int").alias("source_at")
    rows = settled(rows.select("doc_id", *[c.alias(k) for k, c in view.items()], "log_chars", "no_chars", "lang_at", source_at, "source_key"))
    sources = rows.groupBy(F.col("source_key").alias("of_source")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("source_docs"), F.avg("log_chars").alias("usual_chars"))
    rows = rows.join(small(settled(sources)), F.col("source_key") == F.col("of_source"))
    return rows.withColumn("rel_chars", F.col("log_chars") - F.col("usual_chars")).drop("of_source", "usual_chars")


class View(NamedTuple):
    """A linear score of standardised features, and the line that calibrates it."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1]) + self.shift


class Model(NamedTuple):
    text: View
    meta: View
    mix: tuple[float, float, float]
    #: For each round and view: the labels 1 and 0 that the other view handed to it.
    exchanged: tuple[dict[str, tuple[int, int]], ...] = ()
    #: source_key -> rate of label 1, and the rate of all other sources.
    rates: dict[int, float] | None = None
    usual_rate: float = 0.5


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    x1 = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x1 + penalty, x1.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _of_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*TEXT_VIEW, *META_COLUMNS)}
    meta, at = np.zeros((batch.num_rows, len(META_VIEW))), np.arange(batch.num_rows)
    for i, c in enumerate(META_NUMBERS):
        meta[:, i] = column[c]
    meta[at, len(META_NUMBERS) + column["lang_at"]] = 1
    meta[at, len(META_NUMBERS) + LANG_BUCKETS + column["source_at"]] = 1
    return {"text": np.column_stack([column[c] for c in TEXT_VIEW]), "meta": meta}


def _sums(free: DataFrame, of: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of the `size` numbers that `of` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_of_batch(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in free.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _curve(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _slopes(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and upper half of the Hessian of a weighted logistic likelihood at `w`, one after the other."""
    z1 = np.column_stack([z, np.ones(len(z))])
    p = _curve(z1 @ w)
    return np.concatenate([z1.T @ (weight * (y - p)), ((z1 * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z1)[np.triu_indices(len(w))]])


def _step(slopes: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = len(w)
    penalty, hessian = np.diag([1.0] * (n - 1) + [1e-3]), np.zeros((n, n))
    hessian[np.triu_indices(n)] = slopes[n:]
    hessian += np.triu(hessian, 1).T
    return np.linalg.solve(hessian + penalty, slopes[:n] - penalty @ w)


def trusted(odds: np.ndarray, y: np.ndarray, error: float = ERROR, chance: float = CHANCE) -> tuple[float, float]:
    """(low, high): a row of at most `low` is trusted as 0, one of at least `high` as 1, by labelled rows.

    Without trust in both, neither is reached.
    """

    def reach(score: np.ndarray, wrong: np.ndarray) -> float:
        order, n = np.argsort(-score, kind="stable"), np.arange(1, len(score) + 1)
        ranked, missed = score[order], np.cumsum(wrong[order])
        share, usual = missed / n, wrong.mean()
        ends = np.append(ranked[1:] < ranked[:-1], True)  # equal scores stand or fall together
        # Chernoff's bound on so few wrong ones among n at the usual rate.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(share > 0, share * np.log(share / usual), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0)
        good = np.flatnonzero(ends & ((missed + 0.5) / (n + 1) <= error) & (share < usual) & (n * gain >= -np.log(chance)))
        return float(ranked[good[-1]]) if len(good) else np.inf

    low, high = -reach(-odds, y), reach(odds, 1 - y)
    return (low, high) if np.isfinite(low) and np.isfinite(high) else (-np.inf, np.inf)


def _verdicts(odds: np.ndarray, cut: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(rows trusted as 1, rows trusted as 0); rows within both reaches are neither."""
    low, high = cut
    return (odds >= high) & (odds > low), (odds <= low) & (odds < high)


def cotrain(x: dict[str, np.ndarray], y: np.ndarray, fit: np.ndarray, free: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit on the labelled rows that `fit` marks and on pseudo-labels of `free`; calibrate and combine on the other labelled rows."""
    names = ("text", "meta")
    other = {"text": "meta", "meta": "text"}
    width = {v: x[v].shape[1] for v in names}
    length = {v: (width[v] + 1) * (width[v] + 4) // 2 for v in names}
    rate, n_fit = y[fit].mean(), int(fit.sum())

    def moments(rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([[len(rows["text"])], *[part for v in names for part in (rows[v].sum(axis=0), (rows[v] ** 2).sum(axis=0))]])

    size = 1 + 2 * sum(width.values())
    total = _sums(free, moments, size) + moments({v: x[v][fit] for v in names})
    views: dict[str, View] = {}
    at = 1
    for v in names:
        centre, square = total[at : at + width[v]] / total[0], total[at + width[v] : at + 2 * width[v]] / total[0]
        scale = np.sqrt(np.maximum(square - centre**2, 0)) + 1e-6
        at += 2 * width[v]
        views[v] = View(centre, scale, _logistic((x[v][fit] - centre) / scale, y[fit], np.ones(n_fit), 1.0))

    held = ~fit
    exchanged = []
    for _ in range(rounds):
        judges = dict(views)
        cut = {v: trusted(judges[v].odds(x[v][held]), y[held]) for v in names}

        def handed(rows: dict[str, np.ndarray], judges=judges, cut=cut) -> np.ndarray:
            got = [_verdicts(judges[other[v]].odds(rows[other[v]]), cut[other[v]]) for v in names]
            return np.array([np.count_nonzero(part) for both in got for part in both], dtype=float)

        counts = _sums(free, handed, 4)
        exchanged.append({v: (int(counts[2 * k]), int(counts[2 * k + 1])) for k, v in enumerate(names)})
        share = {}
        for k, v in enumerate(names):
            ones, zeros = counts[2 * k], counts[2 * k + 1]
            mass = min(0.5 * (ones + zeros), MASS * n_fit)
            share[v] = (min(0.5, mass * rate / max(ones, 1)), min(0.5, mass * (1 - rate) / max(zeros, 1)))
        if not counts.any():
            break
        for _ in range(25):
            now = dict(views)

            def slopes(rows: dict[str, np.ndarray], judges=judges, cut=cut, now=now, share=share) -> np.ndarray:
                out = []
                for v in names:
                    ones, zeros = _verdicts(judges[other[v]].odds(rows[other[v]]), cut[other[v]])
                    sure = ones | zeros
                    label = ones[sure].astype(float)
                    out.append(_slopes((rows[v][sure] - now[v].centre) / now[v].scale, label, np.where(label > 0, *share[v]), now[v].weights))
                return np.concatenate(out)

            total, at, most = _sums(free, slopes, sum(length.values())), 0, 0.0
            for v in names:
                view = views[v]
                known = _slopes((x[v][fit] - view.centre) / view.scale, y[fit], np.ones(n_fit), view.weights)
                step = _step(total[at : at + length[v]] + known, view.weights)
                at += length[v]
                views[v] = view._replace(weights=view.weights + np.clip(step, -3, 3))
                most = max(most, float(np.abs(step).max()))
            if most < 1e-4:
                break
    ones = np.ones(held.sum())
    for v, view in views.items():
        slope, shift = _logistic(view.odds(x[v][held])[:, None], y[held], ones, 1e-3)
        views[v] = view._replace(slope=float(max(slope, 0.0)), shift=float(shift))
    both = np.column_stack([views[v].odds(x[v][held]) for v in ("text", "meta")])
    return Model(views["text"], views["meta"], tuple(float(w) for w in _logistic(both, y[held], ones, 1e-2)), tuple(exchanged))


def _arrays(rows: list) -> dict[str, np.ndarray]:
    text = np.array([[r[c] for c in TEXT_VIEW] for r in rows], dtype=float).reshape(len(rows), len(TEXT_VIEW))
    meta = np.zeros((len(rows), len(META_VIEW)))
    for i, r in enumerate(rows):
        meta[i, : len(META_NUMBERS)] = [r[c] for c in META_NUMBERS]
        meta[i, len(META_NUMBERS) + r["lang_at"]] = 1
        meta[i, len(META_NUMBERS) + LANG_BUCKETS + r["source_at"]] = 1
    return {"text": text, "meta": meta}


def source_rates(keys: np.ndarray, y: np.ndarray, fit: np.ndarray) -> tuple[dict[int, float], float, np.ndarray]:
    """(rate of label 1 by source over the rows to fit on, that of all, each row's rate without its own label)."""
    usual = float(y[fit].mean())
    sums: dict[int, list[float]] = {}
    for key, label in zip(keys[fit].tolist(), y[fit].tolist(), strict=True):
        got = sums.setdefault(key, [0.0, 0.0])
        got[0] += label
        got[1] += 1
    rate = lambda k, n: (k + PRIOR_LABELS * usual) / (n + PRIOR_LABELS)
    own = [
        rate(sums[key][0] - label, sums[key][1] - 1) if fitted else rate(*sums.get(key, (0.0, 0.0)))
        for key, label, fitted in zip(keys.tolist(), y.tolist(), fit.tolist(), strict=True)
    ]
    return {key: rate(k, n) for key, (k, n) in sums.items()}, usual, np.array(own)


def with_rates(rows: DataFrame, rates: dict[int, float], usual: float) -> DataFrame:
    """`rows` with source_rate; `rates` has at most as many sources as the sample has rows."""
    given = rows.sparkSession.createDataFrame(list(rates.items()), "rated long, rate double")
    return rows.join(F.broadcast(given), F.col("source_key") == F.col("rated"), "left").withColumn("source_rate", F.coalesce("rate", F.lit(usual))).drop("rated", "rate")


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | float:
    """The model, or the smoothed rate of label 1 where labels of one kind are missing."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").cast("double").alias("y"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    marked = rows.join(known, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    given = [r.asDict() for r in marked.where("y IS NOT NULL").orderBy(*first).limit(sample).collect()]
    y = np.array([r["y"] for r in given])
    fit = np.array([i % 5 < 3 for i in range(len(y))], dtype=bool)
    if len(y) < 2 or any(len(set(y[part])) < 2 for part in (fit, ~fit)):
        return float((y.sum() + 1) / (len(y) + 2))
    rates, usual, own = source_rates(np.array([r["source_key"] for r in given]), y, fit)
    for r, rate in zip(given, own.tolist(), strict=True):
        r["source_rate"] = rate
    free = settled(with_rates(marked.where("y IS NULL"), rates, usual).select(*TEXT_VIEW, *META_COLUMNS))
    return cotrain(_arrays(given), y, fit, free, rounds)._replace(rates=rates, usual_rate=usual)


def _odds(view: View, columns: list[Column]) -> Column:
    per = view.weights[:-1] / view.scale
    start = float(view.weights[-1] - (per * view.centre).sum())
    total = F.lit(start)
    for c, k in zip(columns, per, strict=True):
        total = total + c * F.lit(float(k))
    return total * F.lit(view.slope) + F.lit(view.shift)


def score(rows: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of each row of features."""
    if not isinstance(model, Model):
        return rows.select("doc_id", *[F.lit(model).alias(c) for c in ("text_score", "meta_score", "score")])
    text = _odds(model.text, [F.col(c) for c in TEXT_VIEW])
    per = model.meta.weights[:-1] / model.meta.scale
    pick = lambda at, a, n: F.element_at(F.array(*[F.lit(float(v)) for v in per[a : a + n]]), F.col(at) + 1)
    start = float(model.meta.weights[-1] - (per * model.meta.centre).sum())
    linear = F.lit(start) + pick("lang_at", len(META_NUMBERS), LANG_BUCKETS) + pick("source_at", len(META_NUMBERS) + LANG_BUCKETS, SOURCE_BUCKETS)
    for c, k in zip(META_NUMBERS, per, strict=False):
        linear = linear + F.col(c) * float(k)
    meta = linear * F.lit(model.meta.slope) + F.lit(model.meta.shift)
    a, b, c = model.mix
    curve = lambda odds: 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    rows = with_rates(rows, model.rates or {}, model.usual_rate)
    odds = rows.select("doc_id", text.alias("to"), meta.alias("mo"))
    return odds.select("doc_id", curve(F.col("to")).alias("text_score"), curve(F.col("mo")).alias("meta_score"), curve(a * F.col("to") + b * F.col("mo") + c).alias("score"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with both views' calibrated scores, the combined one, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = settled(features(docs))
    model = train(rows, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
