import random
from fractions import Fraction
from math import ceil

import pytest

from cinegrid.operators import timeline as T

GOLDEN = [
    ([80, 170, 110, 240], (1000, 1), (24, 1), 15, [0, 2, 6, 9]),
    ([100], (1000, 1), (10, 1), 1, [0]),
    ([100] * 4, (1000, 1), (10, 1), 4, [0, 1, 2, 3]),
    ([1000], (1000, 1), (24, 1), 24, [0]),
    ([100] * 4, (1000, 1), (30000, 1001), 12, [0, 3, 6, 9]),
    ([1] * 3, (3, 1), (6, 1), 6, [0, 2, 4]),
    ([0] * 4, (1000, 1), (24, 1), 5, [0, 2, 3, 4]),
]


def table(spark, durations):
    return spark.createDataFrame([("a", i, d) for i, d in enumerate(durations)], "seg string, pos int, d long")


@pytest.mark.parametrize(("durations", "rate", "fps", "count", "ticks"), GOLDEN)
def test_golden_timelines(spark, durations, rate, fps, count, ticks):
    rows = T.samples(table(spark, durations), "seg", "pos", "d", rate, fps).orderBy("presentation").collect()
    assert {r["count"] for r in rows} == {count} and [r.tick for r in rows] == ticks


def test_pictures_below_a_tick_vanish(spark):
    s = T.samples(table(spark, [10] * 4), "seg", "pos", "d", (1000, 1), (24, 1))
    assert [(r.presentation, r.local) for r in T.frames(T.holds(s, "seg"), "seg").collect()] == [(0, 0)]


def model(durations, rate, fps):
    """Frame by frame: the last picture whose start, rounded up to a frame, is not after it."""
    tick = max(1, ceil(Fraction(rate[0] * fps[1], rate[1] * fps[0])))
    d = [x if x and x > 0 else tick for x in durations]
    scale = Fraction(rate[1] * fps[0], rate[0] * fps[1])
    count = max(1, ceil(sum(d) * scale))
    starts = [min(count, ceil(sum(d[:i]) * scale)) for i in range(len(d))]
    return [max(i for i, s in enumerate(starts) if s <= f) for f in range(count)]


def test_against_a_model(spark):
    rng = random.Random(3)
    for _ in range(6):
        rate, fps = (rng.choice([90000, 1000, 600]), 1), rng.choice([(24, 1), (30000, 1001), (5, 2)])
        durations = [rng.choice([None, 0, rng.randint(1, rate[0])]) for _ in range(rng.randint(1, 12))]
        got = T.frames(T.holds(T.samples(table(spark, durations), "seg", "pos", "d", rate, fps), "seg"), "seg").orderBy("local").collect()
        assert [r.presentation for r in got] == model(durations, rate, fps)


def test_segments_and_resolve(spark):
    counts = [3, 1, 10000, 7]
    seg = T.segment_starts(spark.createDataFrame(list(enumerate(counts)), "f long, count long"), "f", "count")
    assert [r.start for r in seg.orderBy("f").collect()] == [0, 3, 4, 10004]
    asked = spark.createDataFrame([(n,) for n in (0, 2, 3, 4, 10003, 10004, 10010, 10011)], "n long")
    got = {r.n: (r.f, r.local) for r in T.resolve(asked, seg, "n", "f", missing="drop").collect()}
    assert got == {0: (0, 0), 2: (0, 2), 3: (1, 0), 4: (2, 0), 10003: (2, 9999), 10004: (3, 0), 10010: (3, 6)}
    assert T.resolve(asked.where("n < 10011"), seg, "n", "f").count() == 7
    with pytest.raises(Exception, match="10011"):
        T.resolve(asked, seg, "n", "f").collect()
    with pytest.raises(Exception, match="too many frames"):
        T.segment_starts(spark.createDataFrame([(0, 2**31 - 5), (1, 9)], "f long, count long"), "f", "count").collect()


def test_apng_timebase(spark):
    rows = [("a", 1, 3), ("a", 1, 3), ("a", 1, 0), ("b", 1, 65521), ("b", 7, 65519), ("b", 1, 1), ("c", 5, 65535)]
    got = T.apng_delays(spark.createDataFrame(rows, "a string, num int, den int"), "a", "num", "den").collect()
    assert sorted((r.a, r.num, r.den, r.ticks, r.duration) for r in got) == [
        ("a", 1, 0, 300, 3), ("a", 1, 3, 300, 100), ("a", 1, 3, 300, 100), ("b", 1, 1, 1000, 1000), ("b", 1, 65521, 1000, 0), ("b", 7, 65519, 1000, 0), ("c", 5, 65535, 65535, 5),
    ]


def test_composition(spark):
    df = spark.createDataFrame([(1, i, d, o) for i, (d, o) in enumerate([(10, 5), (10, 0), (10, 3)])], "t long, i int, d long, o long")
    assert [(r.instant, r.duration) for r in T.composed(df, "t", "i", "d", "o").orderBy("i").collect()] == [(5, 5), (10, 13), (23, 7)]
    late = spark.createDataFrame([(1, 0, 10, 0, None), (1, 1, 10, 3, None), (1, 2, 10, 12, None), (2, 0, 10, 0, 12), (2, 1, 10, 0, 12), (2, 2, 10, 0, 12)], "t long, i int, d long, o long, s long")
    assert [(r.t, r.instant, r.duration) for r in T.composed(late, "t", "i", "d", "o", "s").orderBy("t", "i").collect()] == [(1, 0, 13), (1, 13, 17), (2, 0, 10), (2, 10, 2)]
    back = spark.createDataFrame([(1, 0, 10, 25), (1, 1, 10, 0)], "t long, i int, d long, o long")
    with pytest.raises(Exception, match="back in time"):
        T.composed(back, "t", "i", "d", "o").collect()


def test_invalid_rates():
    for bad in ((0, 1), (24, 0), (-1, 1)):
        with pytest.raises(ValueError):
            T.reduce_fps(*bad)
    assert T.reduce_fps(48, 2) == (24, 1)
    with pytest.raises(ValueError, match="invalid rate"):
        T.scale((0, 1), (24, 1))


def test_frames_by_a_column_of_rates_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(u, r) for u in (0, 1, 999, 10**12, (1 << 58) + 1, (1 << 62) + 7) for r in (1001, 90_000, (1 << 32) - 1)]
    got = spark.createDataFrame(rows, "u bigint, r bigint").select("u", "r", T.ceil_frames(F.col("u"), F.col("r"), (30000, 1001)).alias("n")).collect()
    assert all(x.n == -(-x.u * 30000 // (x.r * 1001)) for x in got)
