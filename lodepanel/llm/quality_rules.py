"""Quality rules with host-level verdicts.

A document fails by its own counts (too few words, too much repetition). Failures are summed by host (here the
column `source`); each host's failure rate is shrunk towards all hosts by a beta prior fitted from the hosts
themselves, and the verdict on a host is joined back to its documents. DataFrame functions only.

Defined results: a null or blank text has no words and fails; a text of any length is counted whole; null hosts are
one host; an empty table gives no rows; repeated rows are judged one by one; extra columns are kept. `with_counts` and
`apply_verdicts` replace columns called like their results; `filter_quality` returns the given columns, whatever they
are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import shared_folder
from ._text import SPACE_RUN, free_name, let, settled, small, table, windows, words

SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more (first occurrence included).

    Windows are compared by 64-bit hash. Texts whose windows all differ stop after one hash set; others sort
    (hash, position) and add up what each repeated window covers beyond the one before it.
    """

    def covered(hashes: Column) -> Column:
        last = F.size(hashes) - 1

        def positions(pairs: Column) -> Column:
            def repeats(pair: Column, i: Column) -> Column:
                h = pair["h"]
                return ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == h)) | (
                    (i < last) & (pairs[F.least(i + 1, last)]["h"] == h)
                )

            return F.sort_array(F.transform(F.filter(pairs, repeats), lambda p: p["p"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        total = F.aggregate(
            let(pairs, positions),
            start,
            lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n")),
        )["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    hashes = windows(tokens, 3, lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]), "bigint")
    return F.when(F.size(tokens) < 4, F.lit(0)).otherwise(let(hashes, covered))


def with_counts(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """`docs` with the five counts of COUNTS and `base_failed`."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)

    def of_words(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            repeated_words(tokens).cast("long").alias("n_repeat_words"),
        )

    got = free_name(docs, "counts")
    df = docs.withColumn(got, let(words(F.col(text)), of_words))
    df = df.withColumns(
        {
            "n_words": F.col(got)["n_words"],
            "word_chars": F.col(got)["word_chars"],
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col(got)["n_repeat_words"],
        }
    ).drop(got)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(counted: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row a host: its documents, failures, shrunk failure rate, and whether it is rejected.

    The prior is beta(m s, (1 - m) s): m is the failure rate of all documents, and s + 1 = m (1 - m) / v with v
    the variance of the hosts' rates, weighted by their documents. s stays within 1 and 10,000; it is 10,000 when
    the hosts do not differ.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    hosts = settled(hosts)
    rate = F.col("host_failed") / F.col("host_docs")
    sums = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("k"),
        F.sum(F.col("host_docs") * rate * rate).alias("squares"),
    ).first()
    n, k = sums["n"] or 0, sums["k"] or 0
    mean = k / n if n else 0.0
    spread = max(0.0, sums["squares"] / n - mean * mean) if n else 0.0
    strength = min(10_000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 10_000.0
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate")).withColumn(
        "host_rejected", F.col("host_rate") > max_rate
    )


def apply_verdicts(counted: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """`counted` with `kept`: neither failed by its own counts nor from a rejected host."""
    key, bad = free_name(counted, "verdict_host"), free_name(counted, "verdict")
    right = small(hosts.select(F.col("host").alias(key), F.col("host_rejected").alias(bad)))
    joined = counted.join(right, F.col(host).eqNullSafe(F.col(key)), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col(bad), F.lit(False))).drop(key, bad)


def filter_quality(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("source"))
    folder = shared_folder(docs.sparkSession, "quality")
    # Counted once and written: the verdicts on hosts need all counts before the first document can go.
    with_counts(packed).select("row", "source", "base_failed").write.parquet(folder)
    counted = docs.sparkSession.read.schema(packed.select("row", "source").schema.add("base_failed", "boolean")).parquet(folder)
    kept = apply_verdicts(counted, host_verdicts(counted.select("source", "base_failed"))).where("kept")
    return kept.select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its counts, own failure and final verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = settled(with_counts(docs).drop("text"))
    out = apply_verdicts(counted, host_verdicts(counted))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
word AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) >= 4),
tri AS (
  SELECT rid, p, word || ' ' || lead(word, 1) OVER r || ' ' || lead(word, 2) OVER r AS t
  FROM word WINDOW r AS (PARTITION BY rid ORDER BY p)),
marked AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS c FROM tri WHERE t IS NOT NULL),
covered AS (
  SELECT rid, count(DISTINCT q) AS n
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM marked WHERE c > 1) GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counted AS (
  SELECT d.doc_id, d.source, len(d.w)::BIGINT AS n_words,
         length(regexp_replace(d.text, '{SPACE_RUN}', '', 'g'))::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM failed GROUP BY source),
prior AS (
  SELECT sum(k) / sum(n) AS m, sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v
  FROM hosts),
strength AS (
  SELECT m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS s FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((h.k + m * s) / (h.n + s) > 0.5) AS kept
FROM failed f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source, strength
"""
