"""URL filters: rules first, then a character language-model ratio.

URLs that a rule decides train two variable-order Markov models, of accepted and of rejected URLs. A model's
probability of a character after a context of k characters is interpolated with that after k - 1 (down to a uniform
one). Of a character only the longest gram that was seen is looked up; each longer context that was seen without it
adds its back-off weight, which differs between the models. So the sum over a URL is the exact log-likelihood
difference of the two models; divided by all its characters it is set against a threshold calibrated on ruled URLs that
trained neither model. Models are tables of n-grams, grown from all URLs and joined to all URLs.

Defined results: a null URL, or one without `://`, has empty host and path; models without both kinds of ruled URLs
lead to `allow`; of two rules of equal length that fit, the greater by host and path wins; repeated rows are judged
alike; a URL of any length is read whole; other columns come through whatever they are called, but for host, path, rule
and verdict, which are the result's; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import free_name, settled, small, table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

ORDER = 5
SMOOTH = 2.0
CHARACTERS = 128


def host_and_path(url: Column) -> tuple[Column, Column]:
    body = F.coalesce(url, F.lit(""))
    at = F.instr(body, "://")
    rest = F.when(at > 0, F.substring(body, at + 3, F.length(body))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as host and path, its verdict); nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """uid, at, k (characters of the gram) and gram: for each character of a URL, and the place before the first, those ending there."""
    text = F.concat(F.lit("\x02" * (order - 1)), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^[^:]*://", ""), F.lit("\x03"))
    rows = urls.select("uid", *[c for c in ("accepted",) if c in urls.columns], text.alias("t"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(order - 1), F.length("t"))))
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, order + 1)]))).where(F.col("k") <= F.col("at"))
    return rows.withColumn("gram", F.substring(F.col("t"), F.col("at") - F.col("k") + 1, F.col("k"))).drop("t")


class Ratio(NamedTuple):
    """Two models as one table: known, llr and back (see train), and the difference at a character that neither has seen."""

    table: DataFrame
    unseen: float


def train(ruled: DataFrame, order: int = ORDER, smooth: float = SMOOTH) -> Ratio:
    """The models of urls(uid, url, accepted).

    llr is a gram's log probability as accepted less that as rejected; back is the same of leaving the gram, as a
    context, for a shorter one.
    """
    good = F.col("accepted")
    counts = settled(
        grams(ruled, order).where(F.col("at") >= order).groupBy("k", "gram").agg(F.sum(F.when(good, 1).otherwise(0)).alias("a"), F.sum(F.when(good, 0).otherwise(1)).alias("r"))
    )
    contexts = counts.groupBy("k", F.expr("left(gram, k - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    contexts = settled(contexts.select(F.col("k").alias("ck"), "context", "ca", "cr"))
    counts = settled(counts.join(contexts, (F.col("k") == F.col("ck")) & (F.expr("left(gram, k - 1)") == F.col("context"))).drop("ck", "context"))
    flat = 1.0 / CHARACTERS
    mixed = lambda n, total, lower: (F.col(n) + F.lit(smooth) * lower) / (F.col(total) + F.lit(smooth))
    level = counts.where("k = 1").select("gram", mixed("a", "ca", F.lit(flat)).alias("pa"), mixed("r", "cr", F.lit(flat)).alias("pr"))
    model = level
    for k in range(2, order + 1):
        lower = level.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        here = counts.where(F.col("k") == k).join(lower, F.expr("substring(gram, 2)") == F.col("tail"))
        level = settled(here.select("gram", mixed("a", "ca", F.col("la")).alias("pa"), mixed("r", "cr", F.col("lr")).alias("pr")))
        model = model.unionByName(level)
    away = F.ln((F.col("cr") + smooth) / (F.col("ca") + smooth)).alias("back")
    seen = model.select(F.col("gram").alias("known"), (F.ln("pa") - F.ln("pr")).alias("llr"), F.lit(None).cast("double").alias("back"))
    left = contexts.where("ck > 1").select(F.col("context").alias("known"), F.lit(None).cast("double").alias("llr"), away)
    unseen = contexts.where("ck = 1").select(away).first()
    both = seen.unionByName(left).groupBy("known").agg(F.max("llr").alias("llr"), F.max("back").alias("back"))
    return Ratio(settled(both), unseen[0] if unseen else 0.0)


def score(urls: DataFrame, model: Ratio, order: int = ORDER) -> DataFrame:
    """(uid, score): the models' log-likelihood difference of each URL, by its characters.

    URLs are spread by uid first, so that with a model small enough to broadcast nothing else moves.
    """
    # A given number of parts: few bytes come in, but each URL becomes many rows.
    spread = urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")
    found = grams(spread, order).join(small(model.table), F.col("gram") == F.col("known"), "left")
    # Plain numbers, one column a length, so that the aggregation hashes and need not sort.
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    each = found.groupBy("uid", "at").agg(
        F.max(F.when(F.col("llr").isNotNull(), F.col("k"))).alias("best"), *[of("llr", k).alias(f"l{k}") for k in range(1, order + 1)], *[of("back", k).alias(f"b{k}") for k in range(1, order)]
    )
    backs = F.array(*[F.coalesce(f"b{k}", F.lit(0.0)) for k in range(1, order)]).alias("backs")
    llr = F.coalesce(*[f"l{k}" for k in range(order, 0, -1)], F.lit(model.unseen)).alias("llr")
    line = each.select("uid", F.struct("at", F.coalesce("best", F.lit(0)).alias("k"), llr, backs).alias("x"))
    line = line.groupBy("uid").agg(F.sort_array(F.collect_list("x")).alias("line"))

    def character(x: Column, i: Column) -> Column:
        before = F.col("line")[F.greatest(i - 1, F.lit(0))]["backs"]
        left = F.aggregate(F.slice(before, F.greatest(x["k"], F.lit(1)), order), F.lit(0.0), lambda total, b: total + b)
        return F.when(i > 0, x["llr"] + left).otherwise(0.0)

    total = F.aggregate(F.transform("line", character), F.lit(0.0), lambda total, c: total + c)
    return line.select("uid", (total / (F.size("line") - 1)).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The score halfway between the means of accepted and rejected URLs, each in units of its own spread."""
    got = {r["accepted"]: r for r in scored.groupBy("accepted").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if True not in got or False not in got:
        return None
    a, r = got[True], got[False]
    sa, sr = a["s"] + 1e-6, r["s"] + 1e-6
    return (a["m"] * sr + r["m"] * sa) / (sa + sr)


def judge(urls: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`urls` with host, path, rule and verdict."""
    body = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host, path = host_and_path(body)
    uid, bad, ruled = (free_name(urls, c) for c in ("uid", "bad", "ruled"))
    parts = urls.withColumn(uid, F.xxhash64(body)).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, ruled: verdict})
    bare = urls.select(F.xxhash64(body).alias("uid"), body.alias("url"), host.alias("host"), path.alias("path"))
    each = bare.select("uid", "url", (rule_of(F.col("host"), F.col("path"), rules)[1] == "allow").alias("accepted")).dropDuplicates(["uid"])
    each = settled(each)
    known = each.where("accepted IS NOT NULL")
    for_calibration = F.pmod(F.col("uid"), F.lit(5)) == 0
    model = train(known.where(~for_calibration))
    scores = settled(score(each.where(F.col("accepted").isNull() | for_calibration), model))
    line = threshold(scores.join(known.where(for_calibration).select(F.col("uid").alias("k"), "accepted"), F.col("uid") == F.col("k")))
    rejected = scores.where(F.lit(False) if line is None else F.col("score") < line).select(F.col("uid").alias(bad))
    judged = judged.join(small(rejected), F.col(uid) == F.col(bad), "left")
    model_says = F.when(F.col(bad).isNotNull(), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(F.col(ruled), model_says)).drop(uid, bad, ruled)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` with the verdict on its URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
