"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a place in [0, 2^60), a digest of its id. A source whose target is r times its size takes every
document floor(r) times and those below a threshold once more. The threshold comes from nested histograms: words are
summed by source and bucket (LEVEL_BITS bits of the place), the first bucket at which the running sum passes the budget
is refined by the next bits, and so on for LEVELS rounds down to single places; nothing is sorted.

Sizes count words; a null text has none. A null source is a source of its own, the last. Documents with equal ids share a
place: they are taken together, and the place on the boundary is taken if that comes nearer to the budget. A null id has a
place too. Empty tables give empty results; sources without words have target 0. Other columns are carried by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import WORD, Scratch, checked_broadcast, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
LEVELS, LEVEL_BITS = 5, 12
PLACE_BITS = LEVELS * LEVEL_BITS
#: Up to so many sources the table of thresholds (32 bytes each) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 200_000


def place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, PLACE_BITS // 4), 16, 10).cast("long")


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target: share of all sizes by weight, at most `most` times the source's size.

    With sources ordered by cap / weight, the first k are at their caps where the rest's share per weight falls below the
    next one's; that is the fixed point of resharing what is above a cap. The windows run over one row a source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    d = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    d = d.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    d = d.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    d = d.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that is not at its cap holds for all that follow
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.when(F.col("capped") | level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return d.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs: source, size, place. Returns source, source_size, target, times and below: a document is taken `times` times, once more if place < below."""
    scratch = Scratch(docs.sparkSession, "mixing")
    t = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0)
    t = scratch.save(t.withColumn("last", F.lit(0).cast("long")).withColumn("none", ~F.col("open")))
    for level in range(LEVELS):
        shift = PLACE_BITS - (level + 1) * LEVEL_BITS
        near = t.where("open").select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        inside = docs.join(checked_broadcast(near, BROADCAST_SOURCES), docs["source"].eqNullSafe(F.col("s")) & (F.shiftright("place", shift + LEVEL_BITS) == F.col("p")))
        histogram = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        passing = histogram.withColumn("sum", F.sum("words").over(running)).join(t.where("open").select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        boundary = passing.where(F.col("sum") > F.col("left")).groupBy("s").agg(F.min(F.struct("bucket", (F.col("sum") - F.col("words")).alias("before"), "words")).alias("b"))
        t2 = t.join(boundary, t["source"].eqNullSafe(F.col("s")), "left").drop("s")
        hit = F.col("open") & F.col("b").isNotNull()
        t2 = t2.withColumns({
            "prefix": F.when(hit, F.col("b.bucket")).otherwise(F.col("prefix")),
            "left": F.when(hit, F.col("left") - F.col("b.before")).otherwise(F.col("left")),
            "last": F.when(hit, F.col("b.words")).otherwise(F.col("last")),
            "open": hit,
        }).drop("b")
        t = scratch.save(t2)
    # the boundary place itself comes in if that is nearer to the budget; a source that never passes its budget is taken whole
    nearer = (F.col("last") - F.col("left")) < F.col("left")
    below = F.when(F.col("none"), 0).when(~F.col("open"), 1 << PLACE_BITS).otherwise(F.col("prefix") + nearer.cast("long"))
    return scratch.save(t.select("source", "source_size", "target", "times", below.cast("long").alias("below")))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The narrow table (id, source, size, place) of all documents, and the thresholds of their sources."""
    narrow = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), place(F.col(key)).alias("place"))
    narrow = Scratch(docs.sparkSession, "mixing-sizes").save(narrow)
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    return narrow, thresholds(narrow, targets)


def _with_plan(docs: DataFrame, source: Column, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_plan_source")
    return docs.join(checked_broadcast(plan, BROADCAST_SOURCES), source.eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def mix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each document: its size, its source's size and target, and the words that the mix takes of it."""
    narrow, plan = plan_mix(docs, key, text, source)
    joined = _with_plan(narrow, F.col("source"), plan)
    taken = F.col("size") * (F.col("times") + (F.col("place") < F.col("below")).cast("long"))
    return joined.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"), "source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its columns."""
    _, plan = plan_mix(docs, key, text, source)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = _with_plan(inner, F.col(f"row.`{source}`"), plan)
    times = F.col("times") + (place(F.col(f"row.`{key}`")) < F.col("below")).cast("long")
    copies = joined.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy"))
    return copies.select("row.*")


#: The same mix in SQL, with a running sum in place of the histograms.
SQL = r"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2 AS cap FROM z),
o AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, cap / weight) AS level FROM o WHERE level * weight < cap),
t AS (SELECT o.source, source_size, CASE WHEN o.level * weight >= cap OR l.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, l.level * weight) END AS target FROM o, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
j AS (SELECT n.doc_id, n.size, n.source, n.place, r.source_size, r.target, r.times, r.target - r.times * r.source_size AS budget,
             sum(n.size) OVER (PARTITION BY n.source ORDER BY n.place RANGE UNBOUNDED PRECEDING) AS upto,
             sum(n.size) OVER (PARTITION BY n.source, n.place) AS here
      FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, source,
       size * (times + CASE WHEN budget > 0 AND (upto <= budget OR upto - here <= budget AND upto - budget < budget - (upto - here)) THEN 1 ELSE 0 END) AS taken
FROM j"""
