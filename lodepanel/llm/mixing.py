"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the mix is given to the source in whose part of the cumulative slot weights the point frac(i * golden
ratio) falls, so every stretch of the mix is close to the weights. Slots are ranked within their source; each
source's documents, in hashed order, form one line of words cut into equal blocks, and the slot of rank r takes
block r (again from the first block after the last). A document gets what its blocks' slots take. Ranks and word
offsets are bucketed running totals: no task holds a whole source. DataFrame functions only.

Defined results: a null or blank text has size 0 and takes 0; a text of any length is one row whose words several
slots may take; null sources are one source, last in order; ids may repeat or be null: documents stand in the order of
a hash of id and text, and equal rows count as one with many copies; columns of `mix_documents` come through whatever
they are called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._text import free_name, row_hash, running_total, settled, small, table, words

#: 2 ** 64 over the golden ratio, odd.
GOLDEN = 11400714819323198485
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
_CELLS = 1024
_CHUNK = 65_536
#: Copies of a row that one row of the plan stands for.
_COPIES = 4096


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source_size, weight and target (words).

    Targets are level * weight, at most `most` times the source's size, and sum to `share` of all sizes. Sources
    in order of most * size / weight stop one after another; the level is fixed by the first that does not. The
    windows here run over one row a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), nth + 1)
    sources = settled(sums.withColumn("weight", picked).withColumn("most", F.col("source_size") * most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    up = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    levels = sources.select(
        "most", "weight", F.row_number().over(up).alias("at"), ((F.lit(share * total) - stopped) / open_weight).alias("level")
    )
    first = levels.where(F.col("level") <= F.col("most") / F.col("weight")).agg(F.min(F.struct("at", "level")).alias("f")).first()
    level = first["f"]["level"] if first and first["f"] is not None else 0.0
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))).drop("most")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: source, slot (its place in the mix), block, and the words it takes of the block."""
    spark = sources.sparkSession
    goal = F.floor(F.col("target") + 0.5).cast("long")
    over = F.greatest(F.lit(0), F.col("goal") - F.col("source_size"))
    plan = sources.withColumn("goal", F.least(goal, 2 * F.col("source_size")))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("over", over)
    plan = plan.withColumn("slots", F.ceil((F.col("goal") - F.col("over")) / block) + F.ceil(F.col("over") / block))
    before = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    plan = settled(
        plan.where("slots > 0").withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("high", F.col("low") + F.col("slots"))
    )
    n = plan.agg(F.sum("slots")).first()[0] or 0
    cell = lambda c: F.floor(c / F.lit(float(max(n, 1))) * _CELLS).cast("int")
    parts = plan.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    # Whole numbers throughout, so that the points of a long mix keep their digits.
    fraction = F.expr(f"CAST(CAST(id AS DECIMAL(18, 0)) * CAST({GOLDEN} AS DECIMAL(20, 0)) % CAST({1 << 64} AS DECIMAL(20, 0)) AS DECIMAL(20, 0))")
    points = spark.range(n).select(F.col("id").alias("slot"), fraction.alias("f"))
    points = points.select("slot", F.expr(f"(f * CAST({n} AS DECIMAL(18, 0))) div CAST({1 << 64} AS DECIMAL(20, 0))").alias("at"))
    points = points.withColumn("in_cell", cell(F.col("at")))
    drawn = points.join(small(parts), (F.col("in_cell") == F.col("cell")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    drawn = drawn.select("source", "slot", F.floor(F.col("slot") / _CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = settled(running_total(drawn, ["source"], "chunk", ["slot"], "one", "rank").select("source", "slot", "rank"))
    have = ranked.groupBy(F.col("source").alias("hs")).agg(F.count(F.lit(1)).alias("have"))
    plan = plan.join(have, F.col("source").eqNullSafe(F.col("hs")), "left").drop("hs").withColumn("have", F.coalesce("have", F.lit(0)))
    plan = settled(plan)
    short = plan.where(F.col("have") < F.col("slots")).select("source", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    # The points are spread so evenly that a source lacks few slots, in the order of the logarithm of all.
    added = short.select("source", (F.lit(n) + F.row_number().over(W.orderBy("rank", F.col("source").asc_nulls_last())) - 1).alias("slot"), "rank")
    sizes = small(plan.select(F.col("source").alias("ps"), "blocks", "source_size", "goal", "over", "slots"))
    slots = ranked.unionByName(added).join(sizes, F.col("source").eqNullSafe(F.col("ps"))).where(F.col("rank") < F.col("slots"))
    round_ = F.when(F.col("over") > 0, F.floor(F.col("rank") / F.col("blocks"))).otherwise(F.lit(0))
    nth = F.col("rank") - round_ * F.col("blocks")
    end = F.when(F.col("over") == 0, F.col("goal")).when(round_ == 0, F.col("source_size")).otherwise(F.col("over"))
    return slots.select("source", "slot", nth.cast("long").alias("block"), F.least(F.lit(block), end - nth * block).cast("long").alias("words"))


def mix(sized: DataFrame, targets: DataFrame, block: int = BLOCK, seed: str = "") -> DataFrame:
    """`sized(id, source, size, …)` with source_size, target, taken and first_slot (null if nothing is taken)."""
    own = [c for c in sized.columns if c != "mark"]
    # Equal rows are one row of the line, so that no id or text can fill a part.
    sized = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("mix_times")) if "mark" in sized.columns else sized.withColumn("mix_times", F.lit(1).cast("long"))
    sized = settled(sized)
    rows, many = sized.agg(F.count(F.lit(1)), F.coalesce(F.max("mix_times"), F.lit(0))).first()
    digits = 1
    while 16**digits * 4096 < rows:
        digits += 1
    mark = F.col("mark").cast("string") if "mark" in sized.columns else F.lit("")
    keyed = sized.withColumn("mix_key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), mark)))
    keyed = keyed.withColumn("mix_part", F.substring("mix_key", 1, digits)).withColumn("mix_all", F.col("size") * F.col("mix_times"))
    line = running_total(keyed, ["source"], "mix_part", ["mix_key", "size"], "mix_all", "start")
    # Copies are dealt in parts, which are spread over tasks where a row has very many, and then told one by one.
    last = F.col("mix_times") - 1
    line = line.withColumn("copy_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _COPIES))))
    if many > _COPIES:
        line = line.repartition("mix_key", "copy_part")
    first = F.col("copy_part") * _COPIES
    line = line.withColumn("nth_copy", F.explode(F.sequence(first, F.least(first + _COPIES - 1, last))))
    line = settled(line.select(*own, *[c for c in ("mark",) if c in sized.columns], (F.col("start") + F.col("nth_copy") * F.col("size")).alias("start")))
    own = [*own, *[c for c in ("mark",) if c in sized.columns]]
    end = F.col("start") + F.col("size")
    cuts = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = line.where("size > 0").withColumn("nth", F.explode(cuts)).withColumn("at", F.col("nth") * block)
    pieces = pieces.withColumn("from_word", F.greatest("start", "at") - F.col("at")).withColumn("to_word", F.least(end, F.col("at") + block) - F.col("at"))
    slots = schedule(targets, block).select(F.col("source").alias("ss"), "slot", F.col("block").alias("sb"), "words")
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("ss")) & (F.col("nth") == F.col("sb")), "left")
    got = F.greatest(F.lit(0), F.least("to_word", "words") - F.col("from_word"))
    got = F.when(F.col("words").isNull(), F.lit(0)).otherwise(got)
    joined = joined.withColumn("got", got.cast("long"))
    taken = joined.groupBy(*own, "start").agg(
        F.sum("got").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("slot"))).alias("first_slot")
    ).drop("start")
    none = line.where("size = 0 OR size IS NULL").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    sizes = small(targets.select(F.col("source").alias("ts"), "source_size", "target"))
    return taken.unionByName(none).join(sizes, F.col("source").eqNullSafe(F.col("ts"))).drop("ts")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` as mixed: each row as often as the mix takes it (nearest whole number, 0 to 2), same columns.

    Only the one or two documents of a source where its target ends are taken in part; these are rounded.
    """
    mark, again = free_name(docs, "mix_mark"), free_name(docs, "mix_again")
    marked = docs.withColumn(mark, row_hash(docs))
    sized = settled(marked.select(F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(mark).alias("mark")))
    mixed = mix(sized, settled(source_targets(sized)))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    copies = mixed.groupBy("id", "mark").agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).alias("rows"))
    copies = settled(copies.where("times > 0"))
    cid, cmark = free_name(marked, "cid"), free_name(marked, "cmark")

    def found(plan: DataFrame) -> DataFrame:
        plan = plan.select(F.col("id").alias(cid), F.col("mark").alias(cmark), F.col("times").alias(again))
        return marked.join(plan, F.col(f"`{id_column}`").eqNullSafe(F.col(cid)) & (F.col(mark) == F.col(cmark)))

    out = found(copies.where("rows = 1"))
    repeated = copies.where("rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(found(repeated).dropDuplicates([id_column, mark]))
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(again)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its source's target and the words the mix takes of it."""
    docs = table(spark, sf_dir, "documents")
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sized = settled(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), mark.alias("mark")))
    out = mix(sized, settled(source_targets(sized)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM s GROUP BY source),
lv AS (
  SELECT *, 2 * source_size / w AS r, row_number() OVER u AS nth,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM src)::DOUBLE
          - coalesce(sum(2 * source_size) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM src WINDOW u AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
one AS (SELECT arg_min(level, nth) AS level FROM lv WHERE level <= r),
tgt AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM one), 0) * w, (2 * source_size)::DOUBLE) AS target FROM src),
plan AS (
  SELECT *, ceil(source_size / 64)::BIGINT AS blocks, greatest(0, goal - source_size) AS over
  FROM (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS goal FROM tgt)),
cnt AS (
  SELECT *, (ceil((goal - over) / 64) + ceil(over / 64))::BIGINT AS slots FROM plan),
cum AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
  FROM cnt WHERE slots > 0),
n AS (SELECT sum(slots)::BIGINT AS n FROM cum),
pt AS (
  SELECT slot, ((slot::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT) * n::HUGEINT) // 18446744073709551616::HUGEINT AS point
  FROM (SELECT unnest(range(n)) AS slot, n FROM n)),
drawn AS (
  SELECT cum.source, slot, row_number() OVER (PARTITION BY cum.source ORDER BY slot) - 1 AS rank
  FROM pt JOIN cum ON point >= low AND point < low + slots),
lack AS (
  SELECT source, unnest(range(coalesce(have, 0), slots)) AS rank
  FROM cum LEFT JOIN (SELECT source AS hs, count(*) AS have FROM drawn GROUP BY source) h ON source IS NOT DISTINCT FROM hs),
added AS (
  SELECT source, (SELECT n FROM n) + row_number() OVER (ORDER BY rank, source NULLS LAST) - 1 AS slot, rank FROM lack),
slot AS (
  SELECT a.source, slot, CASE WHEN over > 0 THEN rank // blocks ELSE 0 END AS turn, rank, blocks, over, goal, source_size
  FROM (SELECT * FROM drawn UNION ALL SELECT * FROM added) a JOIN cum ON a.source IS NOT DISTINCT FROM cum.source
  WHERE rank < slots),
cut AS (
  SELECT source, slot, rank - turn * blocks AS b,
         least(64, CASE WHEN over = 0 THEN goal WHEN turn = 0 THEN source_size ELSE over END - (rank - turn * blocks) * 64) AS words
  FROM slot),
line AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s),
piece AS (
  SELECT doc_id, source, size, start, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS b FROM line WHERE size > 0),
got AS (
  SELECT p.*, slot, CASE WHEN words IS NULL THEN 0 ELSE
         greatest(0, least(start + size - p.b * 64, 64, words) - greatest(start - p.b * 64, 0)) END AS got
  FROM piece p LEFT JOIN cut c ON p.source IS NOT DISTINCT FROM c.source AND p.b = c.b),
doc AS (
  SELECT doc_id, source, size, start, sum(got)::BIGINT AS taken, min(slot) FILTER (WHERE got > 0) AS first_slot
  FROM got GROUP BY ALL
  UNION ALL SELECT doc_id, source, size, start, 0, NULL FROM line WHERE size = 0)
SELECT doc_id, size, source_size, target, taken, first_slot::BIGINT AS first_slot
FROM doc JOIN tgt ON doc.source IS NOT DISTINCT FROM tgt.source
"""
