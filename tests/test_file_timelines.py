"""Files put together byte by byte, and what is read out of them."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from cinegrid.functions import walk
from cinegrid.operators import file_timelines as T
from cinegrid.sources import codecs, images

DELAYS = [80, 170, 110, 240]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + b"CRC_"


def png(delays, promised=None, extra=b""):
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 12, 8, 2, 0, 0, 0)) + extra
    if delays is not None:
        out += chunk(b"acTL", struct.pack(">II", len(delays) if promised is None else promised, 0))
    for i, ms in enumerate(delays or []):
        out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", i, 16, 12, 0, 0, ms, 1000, 0, 0)) + chunk(b"fdAT" if i else b"IDAT", b"x" * (300 * i))
    return out + chunk(b"IEND", b"")


def gif(delays, tail=b";"):
    out = b"GIF89a" + struct.pack("<HHBBB", 16, 12, 0x91, 0, 0) + b"\0" * 12
    for ms in delays:
        out += b"!\xf9\x04\0" + struct.pack("<H", ms // 10) + b"\0\0" + b"!\xfe\x03abc\0" + b"," + struct.pack("<HHHHB", 0, 0, 16, 12, 0) + b"\x02" + b"\xff" + b"z" * 255 + b"\x01q\0"
    return out + tail


def webp(delays, flags=2):
    def riff(kind, body):
        return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    body = riff(b"VP8X", bytes([flags]) + b"\0\0\0" + b"\x0f\0\0\x0b\0\0") + riff(b"ANIM", b"\0" * 6)
    body += b"".join(riff(b"ANMF", b"\0" * 12 + struct.pack("<I", ms)[:3] + b"\0" + b"v" * (i + 3)) for i, ms in enumerate(delays))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def box(kind, *inside):
    body = b"".join(inside)
    return struct.pack(">I", len(body) + 8) + kind + body


def runs(kind, entries, version=0):
    return box(kind, bytes([version, 0, 0, 0]), struct.pack(">I", len(entries)), *[struct.pack(">II", n, v & 0xFFFFFFFF) for n, v in entries])


def avif(durations, ctts=None, elst=None, brand=b"avis", handler=b"pict", runs_of=None, extra=b""):
    tables = [runs(b"stts", runs_of or [(1, d) for d in durations])] + ([runs(b"ctts", ctts, 1)] if ctts else [])
    mdia = box(b"mdia", box(b"mdhd", b"\0" * 12, struct.pack(">II", 1000, 600), b"\0" * 4), box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", box(b"stbl", *tables)))
    edit = [box(b"edts", box(b"elst", b"\0\0\0\0", struct.pack(">I", len(elst)), *[struct.pack(">Iii", d, m, 65536) for d, m in elst]))] if elst else []
    return box(b"ftyp", brand + b"\0\0\0\0") + box(b"mdat", b"m" * 50) + extra + box(b"moov", box(b"mvhd", b"\0" * 8), box(b"trak", *edit, mdia))


def starts(spark, contents, fps):
    files = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(contents)], "i int, route string, content binary")
    out = {}
    for r in T.clip(T.pictures(files, "i"), "i", fps).orderBy("n").collect():
        one = out.setdefault(r.i, [[], 0])
        if r.presentation == len(one[0]):
            one[0].append(r.local)
        one[1] += 1
    return [tuple(out[i]) for i in range(len(contents))]


def test_four_pictures_of_600_ms(spark):
    files = [
        ("png", png(DELAYS)), ("gif", gif(DELAYS)), ("webp", webp(DELAYS)), ("avif", avif(DELAYS)), ("heif", avif([150] * 4)),
        ("avif", avif(DELAYS, ctts=[(1, -40), (1, 100), (2, 0)])), ("avif", avif(DELAYS, elst=[(300, 0)])), ("avif", avif(DELAYS, elst=[(50, -1), (0, 0)])),
        ("png", png(None)), ("gif", gif([990])), ("webp", webp(DELAYS, flags=0)), ("avif", avif([600])), ("heif", avif(DELAYS, handler=b"auxv")), ("pnm", b"P1"),
    ]
    want = [([0, 2, 6, 9], 15)] * 4 + [([0, 4, 8, 11], 15), ([0, 5, 6, 9], 15), ([0, 2, 6], 8), ([0, 2, 6, 9], 15)] + [([0], 1)] * 6
    assert starts(spark, files, (24, 1)) == want
    assert [n for _, n in starts(spark, files, (10, 1))] == [6] * 6 + [3, 6] + [1] * 6


def test_refusals(spark):
    files = [
        ("png", png(DELAYS, promised=5)), ("png", png(DELAYS, promised=0)), ("png", png(DELAYS)[:-1000]), ("gif", gif(DELAYS, b"!\xfe\x09abc")), ("gif", gif(DELAYS, b"?;")), ("webp", b"RIFX" + webp(DELAYS)[4:]), ("webp", webp([])),
        ("avif", avif(DELAYS, elst=[(0, 250)])), ("avif", avif(DELAYS, elst=[(100, 0), (100, 0)])), ("avif", avif(DELAYS, ctts=[(4, 700)], elst=[(600, 0)])),
        ("gif", gif(DELAYS, b"")), ("avif", avif(DELAYS, runs_of=[(2, 5), (0, 5)])), ("png", b""), ("webp", b""), ("gif", None),
    ]
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(files)], "i int, route string, content binary")
    got = {r.i: r.refusal for r in T.refusals(T.pictures(df, "i"), "i").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13] and "4 of 5" in got[0] and "unknown" in got[4] and "within its media" in got[7]


def test_boxes(spark):
    wide = struct.pack(">I", 1) + b"free" + struct.pack(">Q", 20) + b"wxyz"
    data = box(b"ftyp", b"a") + wide + box(b"moov", box(b"trak"), box(b"trak", box(b"edts", box(b"elst", b"12")))) + box(b"meta", b"\0\0\0\0", box(b"iprp", box(b"ipco", box(b"irot", b"\x03"), struct.pack(">I", 99) + b"imir"))) + struct.pack(">I", 0) + b"mdatrest"
    got = [tuple(b) for b in spark.createDataFrame([(bytearray(data),)], "c binary").select(walk.boxes(F.col("c"))).first()[0]]
    assert [(p, t) for p, t, _, _ in got] == [("ftyp", 0), ("free", 0), ("moov", 0), ("moov/trak", 1), ("moov/trak", 2), ("moov/trak/edts", 2), ("moov/trak/edts/elst", 2), ("meta", 0), ("meta/iprp", 0), ("meta/iprp/ipco", 0), ("meta/iprp/ipco/irot", 0), ("mdat", 0)]
    assert data[got[1][2] : got[1][3]] == b"wxyz" and data[got[6][2] : got[6][3]] == b"12" and data[got[-1][2] : got[-1][3]] == b"rest"
    huge = struct.pack(">I", 1) + b"free" + b"\xff" * 8
    assert spark.createDataFrame([(bytearray(huge),)], "c binary").select(walk.boxes(F.col("c"))).first()[0] == []


def test_read_mixes_stills_and_animations(spark, tmp_path):
    exif = chunk(b"eXIf", b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0")
    import numpy as np

    still = codecs.write_png(np.zeros((12, 16, 3), np.uint8), 8)
    turned = still[:33] + exif + still[33:]
    names = {"a.png": png(DELAYS), "b.png": still, "c.gif": gif(DELAYS), "d.png": turned}
    for n, b in names.items():
        (tmp_path / n).write_bytes(b)
    paths = [str(tmp_path / n) for n in names]
    rows = images.read(spark, paths, mismatch=True).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(32)) and [r.file_index for r in rows] == [0] * 15 + [1] + [2] * 15 + [3]
    assert [r.hold for r in rows[:15]] == [2] * 2 + [4] * 4 + [3] * 3 + [6] * 6 and rows[15].planes is not None and rows[0].planes is None
    assert (rows[15].orientation, rows[31].orientation) == (1, 6)
    assert images.read(spark, paths[3:], apply_rotation=False).first().orientation == 1
    assert images.read(spark, paths[:1], fpsnum=10).count() == 6
    (tmp_path / "bad.png").write_bytes(png(DELAYS, promised=9))
    with pytest.raises(ValueError, match=r"bad.png.*4 of 9"):
        images.read(spark, [str(tmp_path / "bad.png")])


def test_file_replaced_between_probe_and_decode(spark, tmp_path):
    import numpy as np

    path = tmp_path / "a.png"
    path.write_bytes(codecs.write_png(np.zeros((2, 2, 3), np.uint8), 8))
    frames = images.read(spark, [str(path)])
    assert frames.count() == 1
    path.write_bytes(codecs.write_png(np.ones((2, 2, 3), np.uint8) * 9, 8))
    os.utime(path, (1, 1))
    with pytest.raises(Exception, match="changed since it was probed"):
        frames.collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def two_files(spark):
    return spark.createDataFrame([(1, "avif", avif(DELAYS)), (2, "png", png(DELAYS))], "i int, route string, content binary")


def test_an_orientation_is_read_in_its_files_row(spark):
    turned = box(b"meta", b"\0" * 4, box(b"iprp", box(b"ipco", box(b"irot", b"\1"), box(b"irot", b"\2"))))
    d = T.stated_orientation(spark.createDataFrame([(7, avif(DELAYS, extra=turned)), (8, avif(DELAYS))], "i int, content binary"), "i")
    assert [tuple(r) for r in d.collect()] == [(7, 8)] and "Exchange" not in plan(d)


def test_frames_meet_no_shuffle(spark):
    d = T.clip(T.pictures(two_files(spark), "i"), "i", (24, 1))
    assert [(r.n, r.i) for r in d.orderBy("n").collect()] == [(n, 1 + n // 15) for n in range(30)]
    # the frames are made above the join, not below it
    assert plan(d).index("Generate") < plan(d).index("Join")


def test_samples_of_a_sequence_meet_no_shuffle(spark):
    p = T.pictures(two_files(spark).where("i = 1"), "i")
    d = T.sampled(p, "i", (24, 1))
    assert [(r.presentation, r.duration, r.tick, r.until) for r in d.orderBy("tick").collect()] == [(0, 80, 0, 2), (1, 170, 2, 6), (2, 110, 6, 9), (3, 240, 9, 15)]
    assert "Exchange" not in plan(d) and "Join" not in plan(d)


def test_instants_before_zero_and_offsets_across_runs(spark):
    d = T.pictures(spark.createDataFrame([(1, "avif", avif([], runs_of=[(3, 10), (2, 0), (2, 30)], ctts=[(4, -15), (1, 0)], elst=[(75, 0)]))], "i int, route string, content binary"), "i")
    assert [(r.pos, r.duration, r.before, r.idle) for r in d.orderBy("pos").collect()] == [(1, 0, 0, 0), (2, 5, 0, 1), (3, 10, 5, 1), (4, 15, 15, 1), (5, 0, 30, 1), (6, 30, 30, 2), (7, 15, 60, 2)]


def test_samples_of_chained_files_meet_no_shuffle(spark):
    p = T.pictures(two_files(spark).where("i = 2"), "i")
    d = T.sampled(p, "i", (24, 1))
    assert [r.tick for r in d.orderBy("tick").collect()] == [0, 2, 6, 9]
    assert "Exchange" not in plan(d) and "Join" not in plan(d)


def test_a_gif_without_content_is_a_still(spark):
    p = T.pictures(spark.createDataFrame([(1, "gif", None)], "i int, route string, content binary"), "i")
    assert [(r.tick, r.until) for r in T.sampled(p, "i", (24, 1)).collect()] == [(0, 1)]


def test_refusals_of_a_sequence_need_no_join(spark):
    d = T.pictures(spark.createDataFrame([(1, "avif", avif(DELAYS, elst=[(0, 250)])), (2, "avif", avif(DELAYS, ctts=[(4, 700)]))], "i int, route string, content binary"), "i")
    assert {r.i: r.refusal for r in T.refusals(d, "i").collect()} == {1: "starts within its media", 2: "it shows no picture"}
    assert "Join" not in plan(T.refusals(d, "i"))


def test_refusals_of_chained_files_need_no_join(spark):
    d = T.pictures(spark.createDataFrame([(1, "png", png(DELAYS, promised=5)), (2, "gif", gif(DELAYS, b""))], "i int, route string, content binary"), "i")
    assert {r.i: r.refusal for r in T.refusals(d, "i").collect()} == {1: "it ends after 4 of 5 pictures"}
    assert "Join" not in plan(T.refusals(d, "i"))


def test_boxes_aside_of_a_sequences_tables_are_stepped_over(monkeypatch):
    aside = box(b"meta", b"\0" * 4, box(b"iprp", box(b"ipco", *[box(b"irot", b"\1")] * 50)))
    seen, boxes_in = [], walk.boxes_in

    def counted(*of):
        for b in boxes_in(*of):
            seen.append(b[0])
            yield b

    monkeypatch.setattr(walk, "boxes_in", counted)
    file = avif(DELAYS, extra=aside) + box(b"moov", box(b"trak"))
    assert walk.timeline_of("avif", file)[:3] == (True, 1000, 600) and b"irot" not in seen and seen.count(b"moov") == 1
    assert walk.timeline_of("avif", avif(DELAYS, handler=b"auxv") + file) is None


def test_files_read_once_are_not_saved(spark):
    d = T.sampled(T.pictures(two_files(spark), "i", saved=False), "i", (24, 1))
    assert [(r.i, r.tick) for r in d.orderBy("i", "tick").collect()] == [(i, t) for i in (1, 2) for t in (0, 2, 6, 9)]
    assert plan(d).count("MapInArrow") == 1 and "Scan ExistingRDD[i#" not in plan(d).split("MapInArrow")[0]


def test_one_pass_finds_refusals(spark):
    files = [("png", png(DELAYS, promised=5)), ("avif", avif(DELAYS, elst=[(0, 250)])), ("gif", None), ("webp", None), ("png", png(DELAYS)), ("avif", avif(DELAYS))]
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(files)], "i int, route string, content binary")
    d = T.refused(df, "i")
    assert {r.i: r.refusal for r in d.collect()} == {0: "it ends after 4 of 5 pictures", 1: "starts within its media", 3: "it is no WebP container"}
    assert "Generate" not in plan(d) and "Exchange" not in plan(d)


def test_lines_of_a_file_are_gathered_once(spark):
    from cinegrid.plans import file_queries as Q

    for files in (Q.boxed_files, Q.chained_files):
        p = plan(files(spark, "/root/testdata/sf0.001"))
        assert sum(l.count("collect_list(") for l in p.splitlines() if "partial_" in l) == 1
    pairs = [(v, n, little) for v in (0, 1, 255, 256, 40000) for n in (1, 2, 3, 4, 8) for little in (False, True) if v < 256**n]
    got = spark.range(1).select(*[Q.hexed(F.lit(v), n, little).alias(f"c{i}") for i, (v, n, little) in enumerate(pairs)]).first()
    assert list(got) == [v.to_bytes(n, "little" if little else "big").hex().upper() for v, n, little in pairs]
