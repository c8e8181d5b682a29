"""Planes cut out of buffers, and apertures of files, against numpy and by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrid.functions import planes as P
from cinegrid.functions import walk
from cinegrid.operators import file_timelines as T
from tests.test_file_timelines import box

TURNS = {
    1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.transpose(1, 0, 2),
    6: lambda a: a.transpose(1, 0, 2)[:, ::-1], 7: lambda a: a[::-1, ::-1].transpose(1, 0, 2), 8: lambda a: a.transpose(1, 0, 2)[::-1],
}


@pytest.mark.parametrize("size", [1, 2, 4])
def test_turned_planes_are_numpys(spark, size):
    width, height, pad = 5, 3, 3
    stored = np.random.default_rng(size).integers(0, 256, (height, width, size), np.uint8)
    buffer = b"head" + b"".join(row.tobytes() + b"#" * pad for row in stored)
    rows = []
    for code in TURNS:
        shown = TURNS[code](stored)
        rows.append((bytearray(buffer), code, size, width * size + pad, shown.shape[1], shown.shape[0], bytearray(shown.tobytes())))
    df = spark.createDataFrame(rows, "b binary, code int, size bigint, stride bigint, w bigint, h bigint, want binary")
    got = P.turned(F.col("b"), F.lit(4), F.col("stride"), F.col("size"), F.col("code"), (F.col("w"), F.col("h")))
    assert df.where(got == F.col("want")).count() == 8


def test_windows_and_their_refusals(spark):
    d = spark.createDataFrame([(bytearray(b"abc.def.ghi"), 4, 3, 3), (bytearray(b"abc.def.ghi."), 4, 3, 3), (bytearray(b"abcdef"), 2, 3, 2), (bytearray(b""), 4, 3, 0), (bytearray(b"abcdef"), 3, 3, 2), (None, 4, 3, 1)], "b binary, stride bigint, row bigint, rows bigint")
    c = {n: F.col(n) for n in d.columns}
    length = F.length("b").cast("bigint")
    zero = F.lit(0).cast("bigint")
    whole, loose = (P.strided_refusal(length, F.lit(0), zero, c["stride"], c["row"], c["rows"], w) for w in (True, False))
    got = [tuple(r) for r in d.select(P.window(c["b"], zero, c["stride"], c["row"], c["rows"]), whole.isNull(), loose.isNull()).collect()]
    assert got[0] == (b"abcdefghi", False, True) and got[1] == (b"abcdefghi", True, True) and got[2][1:] == (False, False)
    assert got[3] == (b"", True, True) and got[4] == (b"abcdef", True, True) and got[5][0] is None
    packed = d.select(P.packed_refusal(length, F.lit(1), c["row"], c["rows"])).collect()
    assert [r[0] is None for r in packed] == [False, False, True, True, True, True] and packed[0][0] == "plane 1 has 11 bytes instead of 9"


def test_odd_planes_lose_a_row_and_column(spark):
    one, two = F.lit(1), F.lit(1).cast("bigint")
    n = lambda v: F.lit(v).cast("bigint")
    stored, frame = P.plane_size(two, n(7), n(5), one, one, True), P.plane_size(two, n(7), n(5), one, one, False)
    row = spark.range(1).select(*stored, *frame, P.filling_refusal(two, F.lit(6), stored, (n(3), n(4))), P.filling_refusal(two, F.lit(1), stored, (n(3), n(4)))).first()
    assert tuple(row)[:5] == (4, 3, 3, 2, None) and row[5] == "plane 1 is 4x3, not 3x4"


def clap(*fields):
    return box(b"clap", b"".join(struct.pack(">iI", n, d) if d >= 0 else struct.pack(">ii", n, d) for n, d in fields))


def meta(properties, entries, item=1, version=0, wide=0):
    pitm = box(b"pitm", bytes([version, 0, 0, 0]), struct.pack(">I" if version else ">H", item))
    body = b"".join(struct.pack(">I" if version else ">H", i) + bytes([len(n)]) + b"".join(struct.pack(">H" if wide else ">B", x) for x in n) for i, n in entries)
    return box(b"meta", b"\0\0\0\0", pitm, box(b"iprp", box(b"ipco", *properties), box(b"ipma", bytes([version, 0, 0, wide]), struct.pack(">I", len(entries)), body)))


def ispe(w, h):
    return box(b"ispe", b"\0\0\0\0", struct.pack(">II", w, h))


def movie(handler, *inside):
    return box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", box(b"stbl", box(b"stsd", b"\0\0\0\0", struct.pack(">I", 1), box(b"hvc1", b"\0" * 78, *inside))))))


def test_apertures(spark):
    small, other = clap((33, 2), (6, 1), (3, 2), (-4, 1)), clap((2, 1), (2, 1), (0, 1), (0, 1))
    cases = [
        (meta([ispe(64, 64), small], [(1, [1, 2])]), (16, 6, 1, 0, None)),  # fractions are cut off, places before the picture are its start
        (meta([other, ispe(64, 64)], [(7, [1]), (1, [2])]), (64, 64, 0, 0, None)),  # another item's aperture
        (meta([ispe(9, 9), ispe(64, 64), small], [(1, [1]), (70000, [0x8002, 0x8003])], 70000, 1, 1), (16, 6, 1, 0, None)),
        (meta([ispe(64, 64), small], [(1, [1, 2])]) + box(b"moov", movie(b"auxv", clap((9, 1), (9, 1), (0, 1), (0, 1))), movie(b"pict", box(b"hvcC", b"x"), other)), (2, 2, 0, 0, None)),
        (meta([ispe(64, 64), small], [(1, [1, 2])]) + box(b"moov", movie(b"pict", clap((9, 0), (9, 1), (0, 1), (0, 1)))), (16, 6, 1, 0, None)),
        (meta([ispe(10, 10), small], [(1, [1, 2])]), (16, 6, 1, 0, "it presents 16x6 at 1,0 of 10x10")),
        (meta([ispe(64, 64), clap((0, 1), (6, 1), (0, 1), (0, 1))], [(1, [2, 1])]), (64, 64, 0, 0, None)),
        (meta([ispe(0, 64), small], [(1, [1, 2])]), (16, 6, 1, 0, "it states no size of its coded pictures")),
        (meta([small], [(1, [0, 5])]), (None,) * 4 + ("it states no size of its coded pictures",)),
        (b"", (None,) * 4 + ("it states no size of its coded pictures",)),
        (None, (None,) * 4 + ("it states no size of its coded pictures",)),
    ]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: tuple(r)[1:] for r in T.apertures(df, "i").select("i", "crop.width", "crop.height", "crop.x", "crop.y", "refusal").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_cut_off_associations(spark):
    whole = b"\0\0\0\0" + struct.pack(">I", 2) + b"\0\x05\x01\x01" + b"\0\x01\x02\x83\x02"
    rows = [(bytearray(b), i) for b, i in ((whole, 1), (whole[:-1], 1), (whole[:-1], 5), (whole, 2), (b"\0\0", 1))]
    got = spark.createDataFrame(rows, "b binary, i bigint").select(walk.item_properties(F.col("b"), F.col("i"))).collect()
    assert [r[0] for r in got] == [[3, 2], None, [1], None, None]


def test_cropped_plane(spark):
    a = np.arange(6 * 4 * 2, dtype=np.uint8).reshape(4, 6, 2)
    size = lambda **k: F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in k.items()])
    got = spark.createDataFrame([(bytearray(a.tobytes()),)], "p binary").select(P.cropped(F.col("p"), F.lit(2), size(width=3, height=2, x=2, y=1), size(width=6, height=4))).first()[0]
    assert got == a[1:3, 2:5].tobytes()


def test_an_aperture_stays_beside_its_files_columns(spark):
    files = spark.createDataFrame([(1, bytearray(meta([ispe(8, 6), clap((4, 1), (2, 1), (1, 1), (0, 1))], [(1, [1, 2])])), "a"), (2, None, "b")], "i int, content binary, plane string")
    d = T.apertures(files, "i", kept=("plane",))
    assert [(r.i, r.plane, tuple(r.crop) if r.crop else None) for r in d.orderBy("i").collect()] == [(1, "a", (4, 2, 1, 0)), (2, "b", None)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
