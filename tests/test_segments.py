import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrid.operators import timeline as T
from cinegrid.operators.segments import scanned


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_scan_against_a_loop(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [("hot", i, int(rng.integers(0, 9))) for i in range(700)] + [(f"s{i % 40}", 1000 + i, int(rng.integers(0, 9))) for i in range(300)] + [(None, i, 1) for i in range(5)]
    rng.shuffle(rows)
    rows = [(None if s is None else str(s), int(o), int(v)) for s, o, v in rows]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "s string, o long, v long")
    got = {(r.s, r.o): (r.before, r.before_total, r.i, r.after) for r in scanned(df, "s", "o", {"before": F.col("v"), "i": F.lit(1)}, {"after": F.col("v")}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {}
    for s in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == s)
        for i, (o, _) in enumerate(mine):
            want[s, o] = (sum(v for _, v in mine[:i]), sum(v for _, v in mine), i, mine[i + 1][1] if i + 1 < len(mine) else None)
    assert got == want and len(got) == len(rows)


def test_blocks_of_a_hot_segment_are_even(spark):
    df = spark.range(4000).select(F.lit(7).alias("s"), F.col("id").alias("o"), F.lit(40_000).cast("long").alias("d"))
    s = T.samples(df, "s", "o", "d", (1_000_000, 1), (24, 1))
    sizes = [r["count"] for r in s.groupBy(F.spark_partition_id()).count().collect()]
    assert s.agg(F.max("until")).collect()[0][0] == 3840 and max(sizes) <= 2200


def test_rates_by_row(spark):
    df = spark.createDataFrame([("a", 1, 8, 100), ("a", 2, 17, 100), ("a", 3, 11, 100), ("a", 4, 24, 100), ("b", 1, 0, 1000), ("b", 2, None, 1000), ("c", 1, 3 * 10**9, 1)], "s string, o int, d long, r long")
    got = {(r.s, r.o): (r.tick, r.until, r["count"]) for r in T.samples(df, "s", "o", "d", "r", (24, 1)).collect()}
    assert [got["a", i] for i in (1, 2, 3, 4)] == [(0, 2, 15), (2, 6, 15), (6, 9, 15), (9, 15, 15)]
    assert got["b", 1] == (0, 2, 3) or got["b", 1] == (0, 1, 2) or got["b", 1][0] == 0
    assert got["c", 1][2] == 72 * 10**9
