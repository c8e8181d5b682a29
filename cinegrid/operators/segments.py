"""Prefix sums, totals and following values within segments, in blocks, so that no task needs a whole segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.operators.fixed import fixed


def scanned(df: DataFrame, segment: str, order: str, sums: dict[str, Column], following: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each name of sums, the sum over the rows of the segment before (name) and over all its rows (name_total), and for
    each name of following its value in the segment's next row (null in the last). Sums are of longs; order is total in a segment.

    Rows are dealt out once by ranges of (segment, order): a long segment lies in several blocks. Each block adds up for
    itself; of the segments that go on beyond a block, one row a block says what lies before and after. Those are at most three
    for each block, whatever the data, so they are broadcast.
    """
    following = following or {}
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_s_{k}": v.cast("bigint") for k, v in sums.items()} | {f"_f_{k}": v for k, v in following.items()}
    ranged = fixed(df.withColumns(values).repartitionByRange(parts, segment, order).withColumn("_part", F.spark_partition_id()))

    edges = ranged.groupBy("_part").agg(F.min(F.struct(segment)).alias("a"), F.max(F.struct(segment)).alias("z"))
    edge = edges.select(F.explode(F.array("a", "z")).alias("e")).select(F.col("e").getField(segment).alias("_edge")).distinct()
    some = ranged.join(F.broadcast(edge), F.col(segment).eqNullSafe(F.col("_edge")), "left_semi")
    first = [F.min_by(F.struct(f"_f_{k}"), order).alias(f"_f_{k}") for k in following]
    blocks = some.groupBy(segment, "_part").agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums], F.count("*").alias("_rows"), *first)
    along = W.partitionBy(segment).orderBy("_part")
    before, whole = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = blocks.select(
        F.col(segment).alias("_of"), F.col("_part").alias("_in"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(f"_s_{k}").over(whole).alias(f"_t_{k}") for k in sums],
        *[F.lead(f"_f_{k}").over(along).alias(f"_n_{k}") for k in following],
    )

    block = W.partitionBy("_part", segment).orderBy(order)
    inside, all_of = block.rowsBetween(W.unboundedPreceding, -1), block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = ranged.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_s_{k}").over(inside), F.lit(0)) for k in sums} | {f"_a_{k}": F.sum(f"_s_{k}").over(all_of) for k in sums} | {f"_g_{k}": F.lead(F.struct(f"_f_{k}")).over(block) for k in following})
    met = local.join(F.broadcast(carried), (F.col("_part") == F.col("_in")) & F.col(segment).eqNullSafe(F.col("_of")), "left")
    out = {k: (F.col(f"_l_{k}") + F.coalesce(f"_b_{k}", F.lit(0))).cast("bigint") for k in sums} | {f"{k}_total": F.coalesce(f"_t_{k}", f"_a_{k}") for k in sums}
    out |= {k: F.coalesce(f"_g_{k}", f"_n_{k}").getField(f"_f_{k}") for k in following}
    kept = [c for c in df.columns if c not in out]
    return met.select(*kept, *[v.alias(k) for k, v in out.items()])
