"""Toxicity by compression distance.

Two zstandard dictionaries are trained with the library's own trainer. The ordinary one is trained on words of
ordinary text, the toxic one on the words of toxic text whose beginnings speak for toxic text by a likelihood-ratio
test over labelled documents. Every text is cut into windows of three words. A window's gain is its compressed length
with the ordinary dictionary less that with both dictionaries joined. Windows are counted by how many bytes they gain
at least, and a logistic curve, calibrated on labelled documents that trained no dictionary, turns these counts and the
number of windows into a score.

Dictionaries serve as content only (no entropy tables), and each window starts with letters that both dictionaries end
with: a window this short would otherwise be stored as it is, whatever it matches.

Labels come from a bounded sample: at most `per_class` rows of each label, those of smallest id hash. Near copies
within the sample (least and largest hash of five-word shingles both equal) count once. Everything else covers all texts.

Defined results: a null or empty text has one window without words and gets the score of no hits; a text of any length
is cut into windows throughout; null ids are scored but never learned from; labels other than 0 and 1 are ignored, an
id with several labels counts as toxic if any is; without labels of both kinds, or without a word that speaks for toxic
text, the score is the smoothed rate of toxic labels; repeated rows and ids are scored row by row; other columns of the
tables are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import let, plain_words, settled, table, windows

PER_CLASS = 10_000
#: Words of a window.
WINDOW = 3
#: Letters of a word's beginning at least.
SHORTEST = 4
#: Least evidence (twice the log likelihood ratio) for a word's beginning; chance gives 24 among a million.
EVIDENCE = 25.0
#: Bytes of the trained dictionaries at most, and the lengths of segment and match that the trainer counts in.
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
SEGMENT, MATCH = 16, 6
#: Words a dictionary is trained on at most; beyond it, each word's count is scaled down.
TRAINING_WORDS = 200_000
#: Byte gains that are counted as hits, each by itself.
HITS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12)
#: Stands before every word and after the last, so that a match from a word's beginning gains more than one within it.
MARK = "  "
#: Stands in every window and both dictionaries, so that a window always has a match and each further one pays.
LEAD = "0123456789abcdef"
THRESHOLD = 0.3


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxic, text, fit) of the labelled rows to learn from; `fit` tells the dictionaries' half."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    kinds = [usable.where(F.col("toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = kinds[0].unionByName(kinds[1]).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    shingles = let(plain_words(F.col("text")), lambda w: windows(w, 5, lambda i: F.xxhash64(*[w[i + k] for k in range(5)]), "bigint"))
    ends = let(shingles, lambda h: F.when(F.size(h) > 0, F.xxhash64(F.array_min(h), F.array_max(h))))
    texts = texts.withColumn("copy", F.coalesce(ends, F.xxhash64("text")))
    one = texts.groupBy("copy").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("one")).select("one.*")
    return settled(one.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0))


def speaking_words(fit: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(words of toxic texts that speak for toxic text, words of ordinary texts that do not), each with its texts.

    The counts are those of the labelled sample, which bounds what is collected here.
    """
    totals = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, no = totals.get(1, 0), totals.get(0, 0)
    if not nt or not no:
        return {}, {}
    starts = lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.length(w) + 1, F.lit(SHORTEST))), lambda n: F.substring(F.concat(w, F.lit(" ")), F.lit(1), n))
    words = fit.select("toxic", F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word"))
    words = settled(words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")))
    each = fit.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(plain_words(F.col("text")), starts)))).alias("start")).where(F.length("start") >= SHORTEST)
    counts = each.groupBy("start").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    k = F.col("t") + F.col("o")
    expected_t, expected_o = k * (nt / (nt + no)), k * (no / (nt + no))
    part = lambda n, e: F.when(F.col(n) > 0, F.col(n) * F.ln(F.col(n) / e)).otherwise(0.0)
    evidence = 2 * (part("t", expected_t) + part("o", expected_o))
    speaks = settled(counts.where((k >= 5) & (F.col("t") > expected_t) & (evidence >= EVIDENCE)).select("start"))
    begun = words.select("word", "t", "o", F.explode(starts(F.col("word"))).alias("start"))
    toxic = begun.join(speaks, "start", "left_semi").where("t > 0").select("word", F.col("t").alias("n")).distinct()
    ordinary = words.where((F.col("o") > 0) & (2 * F.col("t") * no <= 3 * F.col("o") * nt)).select("word", F.col("o").alias("n"))
    ordinary = ordinary.orderBy(F.col("n").desc(), "word").limit(TRAINING_WORDS)
    return {r["word"]: r["n"] for r in toxic.collect()}, {r["word"]: r["n"] for r in ordinary.collect()}


def trained(words: dict[str, int], size: int) -> bytes:
    """The dictionary of at most `size` bytes that zstandard's trainer makes of `words`, each given so many times.

    The trainer takes the best segment of each stretch of its input, so the samples are dealt by a hash. Words too few
    to train on are the dictionary themselves.
    """
    import zlib

    import zstandard as z

    scale = max(1.0, sum(words.values()) / TRAINING_WORDS)
    dealt = sorted((zlib.crc32(f"{i} {w}".encode()), w) for w, n in words.items() for i in range(max(1, round(n / scale))))
    samples = [f"{MARK}{w}{MARK}".encode() for _, w in dealt]
    try:
        return z.train_dictionary(size, samples, k=SEGMENT, d=MATCH, level=3).as_bytes()
    except z.ZstdError:
        return b"".join(f"{MARK}{w}{MARK}".encode() for w in sorted(words, key=lambda w: (words[w], w)))[-size:]


class Gains:
    """The byte gains of a text's windows; `toxic` and `ordinary` are the contents of the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import regex
        import zstandard as z

        self.words = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
        shape = z.ZstdCompressionParameters(
            window_log=15, chain_log=13, hash_log=13, search_log=4, min_match=6, target_length=16, strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False
        )
        made = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=shape) for d in (toxic, ordinary)]
        self.toxic, self.ordinary = (c.compress for c in made)

    def of(self, text: str | None) -> np.ndarray:
        words = self.words((text or "").lower())
        cuts = [MARK.join([LEAD, *words[i : i + WINDOW], ""]).encode() for i in range(0, len(words), WINDOW)] or [LEAD.encode()]
        ordinary, toxic = self.ordinary, self.toxic
        return np.fromiter((len(ordinary(x)) - len(toxic(x)) for x in cuts), dtype=np.int32, count=len(cuts))


def facts(gains: np.ndarray) -> list[float]:
    """What the curve sees of a text: its windows that gain so many bytes, for each of HITS, and all its windows."""
    return [*np.log1p([np.count_nonzero(gains >= h) for h in HITS]), np.log1p(len(gains))]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(learn: DataFrame) -> Model:
    speaking, usual = speaking_words(learn.where("fit"))
    lead = LEAD.encode()
    base = trained(usual, ORDINARY_BYTES) if usual else b""
    toxic, ordinary = base + (trained(speaking, TOXIC_BYTES) if speaking else b"") + lead, base + lead

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(toxic, ordinary)
        for batch in batches:
            rows = [facts(gains.of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "toxic", "facts"])

    kind = dict(learn.dtypes)["doc_id"]
    half = learn.where("NOT fit").select("doc_id", "toxic", "text").mapInArrow(measure, f"doc_id {kind}, toxic int, facts array<double>")
    rows = sorted(half.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows], dtype=float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not rows or y.min() == y.max() or not speaking:
        flat = (0.0,) * (len(HITS) + 1)
        return Model(toxic, ordinary, flat, (1.0,) * len(flat), (*flat, float(np.log(rate / (1 - rate)))))
    x = np.array([r["facts"] for r in rows])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = fit_curve((x - centre) / scale, y)
    return Model(toxic, ordinary, tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model.toxic, model.ordinary)
        centre, scale, w = (np.array(v) for v in (model.centre, model.scale, model.weights))
        for batch in batches:
            x = np.array([facts(gains.of(t.as_py())) for t in batch.column("text")]).reshape(-1, len(HITS) + 1)
            p = 1 / (1 + np.exp(-(((x - centre) / scale) @ w[:-1] + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its score; labels of held-out ids are never read for learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
