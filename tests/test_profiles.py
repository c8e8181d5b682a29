"""Embedded colour profiles: their fragments, and their way from a file into a written PNG."""

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from cinegrid.functions import profiles
from cinegrid.sources import codecs, images
from cinegrid.sources.png_sink import write_png


def segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*fragments, head=b"", tail=b"\xff\xda\0\x02junk"):
    return b"\xff\xd8" + head + b"".join(segment(0xE2, b"ICC_PROFILE\0" + bytes([i, n]) + b) for i, n, b in fragments) + tail


def gif(blocks, label=b"ICCRGBG1012", cut=0):
    out = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\1" * 6 + b"!\xf9\x04\0\0\0\0\0"
    out += b"!\xff\x0b" + label + b"".join(bytes([len(b)]) + b for b in blocks) + b"\0"
    return (out + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\0;")[: -cut or None]


def webp(*chunks):
    body = b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_fragments(spark):
    long = bytes(range(256)) * 200
    cases = [
        ("jpeg", jpeg((2, 2, b"World"), (1, 2, b"Hello")), b"HelloWorld"),
        ("jpeg", jpeg((1, 1, long), head=b"\xff\xff\xff\xd0" + segment(0xE0, b"JFIF")), long),
        ("jpeg", jpeg((1, 2, b"a")), None),  # one is missing
        ("jpeg", jpeg((1, 2, b"a"), (1, 2, b"b")), None),  # one twice
        ("jpeg", jpeg((1, 2, b"a"), (2, 3, b"b")), None),  # they disagree
        ("jpeg", jpeg((0, 1, b"a")), None),
        ("jpeg", jpeg((1, 1, b"")), b""),
        ("jpeg", jpeg(), None),
        ("jpeg", jpeg(tail=b"\xff\xda\0\x02") + jpeg((1, 1, b"late"))[2:], None),  # after the scan
        ("jpeg", jpeg((1, 1, b"cut off"))[:20], None),
        ("jpeg", jpeg(*[(i, 254, bytes([i])) for i in range(254, 0, -1)]), bytes(range(1, 255))),
        ("jpeg", jpeg(*[(i, 255, bytes([i])) for i in range(1, 256)]), None),
        ("gif", gif([b"a" * 255, b"bc"]), b"a" * 255 + b"bc"), ("gif", gif([b"x"], b"NETSCAPE2.0"), None), ("gif", gif([b"x"], cut=20), None), ("gif", gif([]), None),
        ("webp", webp((b"VP8X", b"\x20" + b"\0" * 9), (b"ICCP", b"odd"), (b"VP8 ", b"12")), b"odd"), ("webp", webp((b"VP8 ", b"12")), None), ("webp", webp((b"ICCP", b"1234"))[:-1], None),
        ("png", b"\x89PNG", None), ("jpeg", b"", None), ("jpeg", None, None), (None, b"x", None),
    ]
    df = spark.createDataFrame([(i, r, None if c is None else bytearray(c)) for i, (r, c, _) in enumerate(cases)], "i int, route string, content binary")
    got = {r.i: r.p for r in df.select("i", profiles.profile(F.col("route"), F.col("content")).alias("p")).collect()}
    assert {i: None if p is None else bytes(p) for i, p in got.items()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_a_plan_without_the_profile_drops_it(spark, tmp_path):
    spark.createDataFrame([(1, "jpeg", bytearray(jpeg((1, 1, b"p"))))], "k int, route string, content binary").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t")).withColumn("icc", profiles.profile(F.col("route"), F.col("content")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan(d.select("k", "icc")) and "content" not in plan(d.select("k", "route"))


def chunks(data):
    at, out = 8, {}
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        out[data[at + 4 : at + 8]] = data[at + 8 : at + 8 + size]
        at += size + 12
    return out


def test_colour_of_written_frames(spark, tmp_path):
    plane = bytearray([7, 8, 9, 10])
    base = ("p.png", "Gray8", 2, 2, [plane], None)
    rows = [(0, *base, 9, 16, 0, True, bytearray(b"profile")), (1, *base, 9, 2, 0, True, None), (2, *base, 9, 16, 1, True, None), (3, *base, 9, 16, None, None, None), (4, *base, 9, 16, 0, False, None), (5, *base, 300, 16, 0, True, bytearray(b""))]
    frames = spark.createDataFrame(rows, "n int, path string, format string, width int, height int, planes array<binary>, alpha binary, primaries int, transfer int, matrix int, full_range boolean, icc_profile binary")
    write_png(frames, output_path=str(tmp_path / "a%d.png"), export_icc_profile=True).collect()
    got = [chunks((tmp_path / f"a{i}.png").read_bytes()) for i in range(6)]
    assert [c.get(b"cICP") for c in got] == [b"\x09\x10\0\1", None, None, b"\x09\x10\0\1", None, None]
    assert [zlib.decompress(c[b"iCCP"].split(b"\0\0", 1)[1]) if b"iCCP" in c else None for c in got] == [b"profile", None, None, None, None, b""]
    assert list(got[0])[:4] == [b"IHDR", b"cICP", b"iCCP", b"IDAT"]
    write_png(frames, output_path=str(tmp_path / "b%d.png")).collect()
    assert b"iCCP" not in chunks((tmp_path / "b0.png").read_bytes())
    assert (codecs.decode("png", (tmp_path / "a0.png").read_bytes()).samples.ravel() == np.array([7, 8, 9, 10])).all()


def test_read_keeps_profiles_for_a_caller_who_asks(spark, tmp_path):
    # two pictures: an animation, whose pixels are not decoded
    one = gif([b"pro", b"file"])
    (tmp_path / "a.gif").write_bytes(one[:-1] + b"!\xf9\x04\0\x0a\0\0\0" + one[one.index(b",") :])
    path = [str(tmp_path / "a.gif")]
    assert "icc_profile" not in images.read(spark, path).columns
    assert {bytes(r.icc_profile) for r in images.read(spark, path, icc_profile=True).select("icc_profile").collect()} == {b"profile"}


def test_profile_files_are_put_together_in_one_shuffle(spark, tmp_path):
    from cinegrid.plans import profile_queries

    rows = [(o, 1, 10 + i, 20, i + 1, "1996-01-01") for o in (2, 3) for i in range(2)]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_extendedprice int, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate string")
    d.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = profile_queries.icc_profiles(spark, str(tmp_path))
    assert [(r.l_orderkey, r.has_icc) for r in got.orderBy("l_orderkey").collect()] == [(2, False), (3, False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ExistingRDD" not in plan


def test_fragments_of_profile_files_stand_by_part_in_jpegs_alone(spark, tmp_path):
    from cinegrid.plans import profile_queries

    rows = [(o, 1, part, 20, i + 1, "1996-01-01") for o in (4, 5, 6, 7) for i, part in enumerate((31, 9, 110))]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_extendedprice int, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate string")
    d.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: bytes(r.content) for r in profile_queries.profile_files(spark, str(tmp_path)).collect()}
    texts = [f"{part},20,1996-01-01".encode() for part in (31, 9, 110)]
    assert all(sorted(texts, key=got[o].index) == [texts[1], texts[0], texts[2]] for o in (4, 5))
    assert all(sorted(texts, key=got[o].index) == texts for o in (6, 7))
    want = {(o, r, True, len(b"".join(texts)), hashlib.md5(b"".join(texts)).hexdigest()) for o, r in ((4, "jpeg"), (5, "jpeg"), (6, "gif"), (7, "webp"))}
    assert {tuple(r) for r in profile_queries.icc_profiles(spark, str(tmp_path)).collect()} == want
