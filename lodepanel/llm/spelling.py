"""Spelling variants: words one edit apart, found by two-dimensional range reporting over wavelet trees.

A word of length L is a point: its place among all words of that length in code-point order, and its place in the order of
the words spelt backwards. Words with given letters before a position are one interval of the first order, words with
given letters behind it one interval of the second. For each edit position the two intervals of a word span a
rectangle, and its points are exactly the words that differ there: by another letter (words of the same length), or by
one more letter (words one longer; the two then also stand for the deletion). A wavelet tree over the second places in
first order reports a rectangle's points in a logarithm of steps each. Letters put into a run of the same letter give
the same word at several positions; the first counts.

Two words one edit apart share the letters before the middle of the longer one or those from the middle on. So each word is
sent to two places, by (length, half, the letters of that half), and to two more as a shorter word; the places are dealt
to buckets of a bounded size by a hash, each with trees of its own, in which all its words ask at once (numpy arrays).
Halves that very many words share are cut into a grid: points by one hash, askers by another, so that each pair of a
word and a point meets in one cell.

Defined results: a null text or no run of letters gives no words; a null id changes no run; runs of any length count,
repeated rows count each time, as does a word's every occurrence; of equally frequent near words the smallest in
code-point order is the form; a word without a form is its own root; an empty table gives no rows; other columns of
the documents are not read, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import settled, small, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: One run in so many loses a letter.
EVERY = 199
#: Entries of a bucket, and words of one half from which on it is cut into a grid.
BUCKET = 1 << 16
HOT = 1 << 15
#: Rectangles asked for at once.
ASKED = 1 << 18


class WaveletTree:
    """Range reporting over `values`, a permutation of 0 to n - 1, by its bits from the highest on."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros: list[np.ndarray] = []
        for k in reversed(range(self.bits)):
            one = (values >> k & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            values = np.concatenate((values[~one], values[one]))

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, value) for each value of places start to end - 1 that lies in low to high - 1."""
        ask, begun = np.arange(len(start)), np.zeros(len(start), dtype=np.int64)
        for k, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            left, right = zeros[start], zeros[end]
            ask, begun = np.concatenate((ask, ask)), np.concatenate((begun, begun + (1 << k)))
            start, end = np.concatenate((left, start - left + zeros[-1])), np.concatenate((right, end - right + zeros[-1]))
            live = (start < end) & (begun < high[ask]) & (begun + (1 << k) > low[ask])
            ask, begun, start, end = ask[live], begun[live], start[live], end[live]
        return ask, begun


def _matrix(words: list[bytes], length: int) -> np.ndarray:
    """The letters of words of at most `length`, a row each, zeros behind."""
    return np.array(words, dtype=f"S{length}").view(np.uint8).reshape(len(words), length)


def _shared(ordered: np.ndarray) -> np.ndarray:
    """How many first letters each row of a sorted matrix shares with the row before it."""
    differ = ordered[1:] != ordered[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), ordered.shape[1])
    return np.concatenate(([-1], first)) if len(ordered) else np.zeros(0, dtype=np.int64)


class Places:
    """The order of words (points and askers) by their letters, and the interval of points that share a beginning."""

    def __init__(self, letters: np.ndarray, point: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        self.shared = _shared(letters[self.order])
        self.before = np.concatenate(([0], np.cumsum(point[self.order])))
        self.place = np.empty(len(letters), dtype=np.int64)
        self.place[self.order] = np.arange(len(letters))

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the first and the last place + 1, among the points alone, of those that begin with the same `length` letters."""
        heads = np.flatnonzero(self.shared < length)
        group = np.cumsum(self.shared < length) - 1
        ends = np.append(heads[1:], len(self.shared))
        mine = group[self.place]
        return self.before[heads[mine]], self.before[ends[mine]]


def near_in(words: list[bytes], length: int, is_point: np.ndarray, asks: np.ndarray, least: int, most: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asker, point) pairs of numbers of `words` that are one edit apart at a position from `least` to `most` - 1.

    Points are `length` long; askers as long (another letter) or one shorter (one letter more). `words` are spelt
    backwards if `backwards`; positions count from the spelt beginning.
    """
    letters = _matrix(words, length)
    sizes = np.array([len(w) for w in words])
    back = _matrix([w[::-1] for w in words], length)
    forth, hind = Places(letters, is_point), Places(back, is_point)
    points = forth.order[is_point[forth.order]]  # words by first place
    second = hind.before[hind.place[points]]
    tree = WaveletTree(second)
    by_second = np.empty(len(points), dtype=np.int64)
    by_second[second] = points
    askers = np.flatnonzero(asks)
    itself = is_point.astype(np.int64)  # a point meets itself in its own rectangles
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(least, most):
        start, end = forth.interval(at)
        behind = {}
        for size in (length - 1, length):
            who = askers[sizes[askers] == size]
            # A word that shares a beginning with nobody else has no near word here or further on.
            who = who[end[who] - start[who] > itself[who]]
            if not len(who):
                continue
            tail = length - at - 1
            if tail not in behind:
                behind[tail] = hind.interval(tail)
            low, high = behind[tail]
            who = who[high[who] - low[who] > itself[who]]
            for k in range(0, len(who), ASKED):
                some = who[k : k + ASKED]
                ask, value = tree.report(start[some], end[some], low[some], high[some])
                one, other = some[ask], by_second[value]
                if size == length:
                    right = letters[one, at] != letters[other, at]
                elif backwards:  # the letter before it in the word's own order is the one behind it here
                    right = np.ones(len(one), dtype=bool) if at == length - 1 else letters[other, min(at + 1, length - 1)] != letters[other, at]
                else:
                    right = np.ones(len(one), dtype=bool) if at == 0 else letters[other, at - 1] != letters[other, at]
                out.append((one[right], other[right]))
        if not len(askers) or not (end[askers] - start[askers] > itself[askers]).any():
            break
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(entries: pa.Table) -> pa.Table:
    """The near pairs of one bucket: rows (length, half, i, j, point, ask, word, n). Only rows of one cell meet."""
    parts = []
    kinds = entries.select(["half", "length", "i", "j"])
    for kind in kinds.group_by(kinds.column_names).aggregate([]).to_pylist():
        rows = entries.filter(reduce(pc.and_, [pc.equal(entries[c], v) for c, v in kind.items()]))
        length, backwards, text = kind["length"], kind["half"] == "tail", rows["word"].to_pylist()
        # Letters up to U+00FF are one byte each, in code-point order.
        words = [w.encode("latin-1")[:: -1 if backwards else 1] for w in text]
        least = length - length // 2 if backwards else length // 2
        ask, point = near_in(words, length, rows["point"].to_numpy(), rows["ask"].to_numpy(), least, length, backwards)
        if len(ask):
            taken, n = pa.array(text), rows["n"].to_numpy()
            longer = np.array([len(w) for w in words])[ask] < length
            # A shorter asker found a longer word: both are near to each other.
            a, b = np.concatenate((ask, point[longer])), np.concatenate((point, ask[longer]))
            parts.append(pa.table([taken.take(pa.array(a)), taken.take(pa.array(b)), pa.array(n[b], type=pa.int64())], schema=_PAIRS))
    return pa.concat_tables(parts) if parts else _PAIRS.empty_table()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words one edit apart. `words`: distinct `word` of at least 6 letters
    U+0001 to U+00FF, and `n`."""
    size = F.length("word")

    def entry(half: str, length: Column, key: Column, point: bool) -> Column:
        return F.struct(F.lit(half).alias("half"), length.cast("int").alias("length"), key.alias("key"), F.lit(point).alias("point"), F.lit(True).alias("ask"))

    def halves(length: Column, point: bool) -> list[Column]:
        middle = F.floor(length / 2).cast("int")
        return [entry("head", length, F.substring("word", F.lit(1), middle), point), entry("tail", length, F.right("word", length - middle), point)]

    sent = words.select("word", "n", F.explode(F.array(*halves(size, True), *halves(size + 1, False))).alias("e")).select("word", "n", "e.*")
    group = ["half", "length", "key"]
    # Halves that very many words share, and the sides of their grids.
    hot = settled(sent.groupBy(*group).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HOT).select(*group, F.ceil(F.col("many") / HOT).cast("int").alias("side")))
    sent = sent.join(small(hot), group, "left")
    spread, whole = F.pmod(F.xxhash64("word"), F.col("side")).cast("int"), F.sequence(F.lit(0), F.col("side") - 1)
    cells = F.when(F.col("side").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("point"), F.col("ask")))).otherwise(
        F.concat(
            F.when(F.col("point"), F.transform(whole, lambda j: F.struct(spread.alias("i"), j.alias("j"), F.lit(True).alias("point"), F.lit(False).alias("ask")))).otherwise(
                F.array().cast("array<struct<i:int,j:int,point:boolean,ask:boolean>>")
            ),
            F.transform(whole, lambda i: F.struct(i.alias("i"), spread.alias("j"), F.lit(False).alias("point"), F.lit(True).alias("ask"))),
        )
    )
    sent = sent.select("word", "n", *group, F.explode(cells).alias("cell")).select("word", "n", *group, "cell.*")
    entries = words.count() * 4
    buckets = 16 + entries // BUCKET
    sent = sent.select("word", "n", "half", "length", "i", "j", "point", "ask", F.pmod(F.xxhash64(*group, "i", "j"), F.lit(buckets)).cast("int").alias("bucket"))
    spread_over = sent.repartition(min(buckets, 4096), "bucket")
    return spread_over.groupBy("bucket").applyInArrow(lambda t: _search(t), "word string, near string, near_n long")


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`word` and `n`: runs of letters by how often they occur, in lower case (A to Z only); one run in 199 loses a letter."""
    lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.explode(F.split(lowered, f"[^{LETTERS}]+")).alias("run")).where(F.col("run") != "")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.pmod(h, F.lit(EVERY)) == 0, lost).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def roots(links: DataFrame) -> DataFrame:
    """`word` and `root`, the last of the forms that follow from `links(word, form)`. Chains are halved in each round."""
    state = settled(links.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("step"), F.col("root").alias("onward"))
        after = settled(state.join(onward, F.col("root") == F.col("step"), "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        state = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return state


def spelling_forms(words: DataFrame) -> DataFrame:
    """`words(word, n)` with n_near, form, form_n and root."""
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    fits = form_n >= TIMES * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, form_n).alias("form_n"))
    out = settled(out)
    last = roots(out.where(F.col("form").isNotNull()))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of `documents` with their near words, forms and roots."""
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = settled(counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")
