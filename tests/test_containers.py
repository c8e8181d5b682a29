"""Canvases, track tables, orientation and guards: refusals, empty input and borders that the queries' tables do not hold."""

import pytest
from pyspark.sql import functions as F

from cinegrid.functions import convert as X
from cinegrid.functions import metadata as M
from cinegrid.functions import raster as R
from cinegrid.operators import canvas
from cinegrid.operators import timeline as T

PICTURE = "name string, turn int, left int, top int, wide int, high int, pixels array<int>, over boolean, disposal string"
RED, CLEAR, HALF = [255, 0, 0, 255], [9, 9, 9, 0], [0, 0, 255, 128]


def shown(df):
    return {(r.name, r.turn, r.band): r.shown for r in df.collect()}


def test_disposal_restores_or_clears_the_rectangle_only(spark):
    rows = [
        ("a", 0, 0, 0, 2, 1, RED * 2, False, "none"), ("a", 1, 0, 0, 1, 1, [1, 2, 3, 255], False, "previous"), ("a", 2, 1, 0, 1, 1, CLEAR, True, "background"),
        ("a", 3, 0, 0, 1, 1, HALF, True, None), ("b", 0, 1, 0, 1, 1, HALF, None, None),
    ]
    got = shown(canvas.canvases(spark.createDataFrame(rows, PICTURE), "name", "turn", 2, 1, "apng"))
    assert got["a", 1, 0] == [1, 2, 3, 255] + RED
    assert got["a", 2, 0] == RED + RED  # the first pixel is back, a clear one keeps what is there
    assert got["a", 3, 0] == [127, 0, 128, 191, 0, 0, 0, 0]
    assert got["b", 0, 0] == [0, 0, 0, 0] + HALF


def test_webp_ignores_disposal_and_clips(spark):
    rows = [("a", 0, 0, 0, 3, 2, RED * 6, False, "background"), ("a", 1, 5, 5, 1, 1, HALF, True, "none"), ("a", 2, 1, 0, 2, 1, CLEAR * 2, True, "none")]
    got = shown(canvas.canvases(spark.createDataFrame(rows, PICTURE), "name", "turn", 2, 1, "webp"))
    assert [got["a", t, 0] for t in range(3)] == [RED * 2] * 3


def test_a_long_animation_passes_through_one_band_after_another(spark):
    n = 3000
    frames = spark.range(n).select(
        F.lit("a").alias("name"), F.col("id").cast("int").alias("turn"), (F.col("id") % 40).cast("int").alias("left"), (F.col("id") % 7).cast("int").alias("top"), F.lit(1).alias("wide"), F.lit(1).alias("high"),
        F.array(*[(F.col("id") % 251).cast("int")] * 3, F.lit(255)).alias("pixels"), F.lit(True).alias("over"), F.lit("none").alias("disposal"),
    )
    got = shown(canvas.canvases(frames, "name", "turn", 40, 7, "apng", band_rows=3))
    assert len(got) == n * 3
    want = [[0] * 4 for _ in range(280)]
    for i in range(n):
        want[i % 7 * 40 + i % 40] = [i % 251] * 3 + [255]
    assert [x for b in range(3) for x in got["a", n - 1, b]] == [x for p in want for x in p]


def test_apng_refuses_a_picture_beyond_its_canvas(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0, 2, 1, RED * 2, False, "none")], PICTURE)
    with pytest.raises(Exception, match="beyond its canvas"):
        canvas.canvases(rows, "name", "turn", 2, 1, "apng").collect()
    with pytest.raises(ValueError, match="rule"):
        canvas.canvases(rows, "name", "turn", 2, 1, "gif")
    assert canvas.canvases(rows.limit(0), "name", "turn", 2, 1, "webp").count() == 0


def test_runs_expand_unless_a_table_is_unsound(spark):
    rows = [("a", 1, 2, 10), ("a", 2, 1, -3), ("empty", 1, 0, 5), ("empty", 2, 4, 5), ("long", 1, T.MOST_SAMPLES, 1), ("long", 2, 1, 1)]
    got = T.expand_runs(spark.createDataFrame(rows, "track string, entry int, n long, value long"), "track", "entry", "n", "value")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 10), ("a", 1, 10), ("a", 2, -3)]
    raw = spark.createDataFrame([(0, 4294967295), (1, 4294967295), (1, 5)], "v int, raw long")
    assert [r[0] for r in raw.select(T.composition_offset(F.col("v"), F.col("raw"))).collect()] == [4294967295, -1, 5]


def test_edit_lists(spark):
    rows = [("delay", 1, 50, -1), ("delay", 2, 30, 0), ("whole", 1, 0, 0), ("skip", 1, 9, 4), ("twice", 1, 9, 0), ("twice", 2, 9, 3), ("none", 1, 9, -1)]
    got = T.edit_list(spark.createDataFrame(rows, "track string, pos int, duration long, media long"), "track", "pos", "duration", "media").collect()
    assert {r.track: (r.shown, r.refusal) for r in got} == {
        "delay": (30, None), "whole": (None, None), "skip": (None, "starts within its media"), "twice": (None, "edits its media more than once"), "none": (None, None),
    }


def test_a_clip_has_every_frame_once(spark):
    rows = [("a", 1, 2), ("a", 2, 1), ("b", 1, None), ("c", 1, 4)]
    got = T.clip_frames(spark.createDataFrame(rows, "file string, pos int, d long"), "file", "pos", "d", (2, 1), (1, 1)).orderBy("n").collect()
    assert [(r.n, r.file, r.local, r.presentation) for r in got] == [(0, "a", 0, 0), (1, "a", 1, 1), (2, "b", 0, 0), (3, "c", 0, 0), (4, "c", 1, 0)]


@pytest.mark.parametrize("payload", [b"", b"II", b"XX\x2a\x00\x08\x00\x00\x00", b"II\x2b\x00\x08\x00\x00\x00", b"MM\x00\x2a\xff\xff\xff\xff", b"MM\x00\x2a\x00\x00\x00\x08\x00\x00", b"MM\x00\x2a\x00\x00\x00\x08\xff\xff\x01\x12", None])
def test_exif_states_nothing_when_cut_or_foreign(spark, payload):
    one = spark.createDataFrame([(bytearray(payload) if payload is not None else None,)], "p binary")
    assert one.select(R.exif_orientation(F.col("p"))).first()[0] is None


def test_exif_finds_a_later_entry(spark):
    other = bytes([0x0F, 1, 3, 0, 1, 0, 0, 0, 0, 0, 0, 0])
    payload = b"II\x2a\x00\x08\x00\x00\x00\x02\x00" + other + bytes([0x12, 1, 3, 0, 1, 0, 0, 0, 6, 0])
    assert spark.createDataFrame([(bytearray(payload),)], "p binary").select(R.exif_orientation(F.col("p"))).first()[0] == 6


def test_refusals(spark):
    one = spark.range(1)
    numbers = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    for column, message in (
        (X.palette_entry(F.array(F.array(F.lit(1))), F.lit(1)), "past the end"), (X.yuv_matrix(F.lit(None).cast("int"), F.lit(2)), "states no matrix"), (X.yuv_matrix(F.lit(None).cast("int"), F.lit(3)), "unknown matrix: 3"), (X.yuv_matrix(F.lit(None).cast("int"), F.lit(None).cast("int")), "states no matrix"),
        (M.tiff_colour(numbers(1, 2), F.lit(None).cast("array<double>")), "not three numbers"), (M.tiff_colour(numbers(), numbers(1)), "not three pairs"),
    ):
        with pytest.raises(Exception, match=message):
            one.select(column).collect()


def test_matrix_that_is_given_wins_over_an_unknown_one(spark):
    row = spark.range(1).select(X.yuv_matrix(F.lit(6), F.lit(3)).alias("a"), X.yuv_matrix(F.lit(None).cast("int"), F.lit(3), refuse=False).alias("b"), X.yuv_matrix(F.lit(None).cast("int"), F.lit(9)).alias("c")).first()
    assert tuple(row) == (6, None, 9)


def test_alpha_meets_colour_in_parts_of_a_size(spark, monkeypatch):
    from cinegrid.operators import validate as V

    monkeypatch.setattr(V, "JOINED_ROWS", 10)
    side = lambda rows, family, depth: spark.range(rows).selectExpr("id % 3 AS clip", "CAST(id AS INT) AS n", f"'{family}' AS family", "'integer' AS sample", f"IF(id = 41, {depth}, 8) AS bits", "16 AS width", "12 AS height")
    d = V.alpha_clip(side(95, "RGB", 8), side(94, "Gray", 10), "clip", "n")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert {r.clip: (r.frames, r.alpha_frames, r["first"], r.refusal) for r in d.collect()} == {0: (32, 32, None, None), 1: (32, 31, None, "32 frames beside 31"), 2: (31, 31, 41, "samples of another depth")}
    assert plan.count("10), REPARTITION_BY_NUM") == 2 and "SortAggregate" not in plan
