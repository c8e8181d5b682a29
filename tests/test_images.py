import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrid.functions import identify as I
from cinegrid.operators import sink_plan as P
from cinegrid.sources import codecs, images, png_sink


def save(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.fixture
def pictures(tmp_path):
    rgb, gray = b"P3\n# c\n2 1\n255\n255 0 0 0 255 0\n", b"P2\n2 1\n65535\n1 2\n"
    return save(tmp_path, "rgb.ppm", rgb), save(tmp_path, "gray.pgm", gray)


def test_first_images(spark, pictures):
    rows = {r.n: r for r in images.read(spark, list(pictures), mismatch=True).collect()}
    assert (rows[0].format, rows[0].width, rows[0].height) == ("RGB24", 2, 1)
    assert [list(p) for p in rows[0].planes] == [[255, 0], [0, 255], [0, 0]]
    assert rows[1].format == "Gray16" and np.frombuffer(rows[1].planes[0], "<u2").tolist() == [1, 2]
    with pytest.raises(ValueError, match=r"file 1 .*Gray16.*RGB24"):
        images.read(spark, list(pictures))


def test_order_and_repeats_are_data(spark, pictures):
    rgb, gray = pictures
    rows = images.read(spark, [gray, rgb, gray], mismatch=True).orderBy("n").collect()
    assert [r.path for r in rows] == [gray, rgb, gray]


def test_names_do_not_matter_where_content_speaks(spark, tmp_path):
    png = codecs.write_png(np.arange(12, dtype=np.uint8).reshape(2, 2, 3), 8)
    paths = [save(tmp_path, f"a.{e}", png) for e in ("png", "tga", "ico", "dib", "txt")]
    got = images.read(spark, paths).collect()
    assert len({tuple(map(bytes, r.planes)) for r in got}) == 1 and {r.original_color_type for r in got} == {"Rgb8"}


def test_alpha(spark, tmp_path):
    la = np.array([[[10, 1], [20, 2]]], np.uint8)
    rgb = np.array([[[1, 2, 3], [4, 5, 6]]], np.uint8)
    paths = [save(tmp_path, "la.png", codecs.write_png(la, 8)), save(tmp_path, "rgb.png", codecs.write_png(rgb, 8)), save(tmp_path, "x.ff", b"farbfeld" + struct.pack(">II", 1, 1) + struct.pack(">4H", 1000, 2000, 3000, 100))]
    colour, alpha = images.read_alpha(spark, paths, mismatch=True)
    a = {r.n: r for r in alpha.collect()}
    assert list(a[0].planes[0]) == [1, 2] and list(a[1].planes[0]) == [255, 255] and np.frombuffer(a[2].planes[0], "<u2").tolist() == [100]
    assert [r.format for r in colour.orderBy("n").collect()] == ["Gray8", "RGB24", "RGB48"]


@pytest.mark.parametrize("kind", ["P1", "P4", "P2", "P5", "P3", "P6", "P7"])
def test_pnm_kinds(kind):
    w, h = 5, 3
    bits = [[(x + y) % 2 for x in range(w)] for y in range(h)]
    gray = [[(x * 7 + y) % 32 for x in range(w)] for y in range(h)]
    flat = [v for row in (bits if kind in ("P1", "P4") else gray) for v in row]
    data = {
        "P1": f"P1 #c\n{w} {h}\n{' '.join(map(str, flat))}".encode(),
        "P4": f"P4\n{w} {h}\n".encode() + bytes(int("".join(map(str, row)).ljust(8, "0"), 2) for row in bits),
        "P2": f"P2\n{w} {h} 31\n{' '.join(map(str, flat))}".encode(),
        "P5": f"P5\n{w} {h}\n31\n".encode() + bytes(flat),
        "P3": f"P3\n{w} {h} 31\n{' '.join(str(v) for v in flat for _ in range(3))}".encode(),
        "P6": f"P6\n{w} {h}\n31\n".encode() + bytes(v for v in flat for _ in range(3)),
        "P7": f"P7\nWIDTH {w}\nHEIGHT {h}\n# c\nDEPTH 1\nMAXVAL 31\nTUPLTYPE GRAYSCALE\nENDHDR\n".encode() + bytes(flat),
    }[kind]
    p = codecs.read_pnm(data)
    scale = np.float32(255) / np.float32(31)
    want = [255 * (1 - v) for v in flat] if kind in ("P1", "P4") else [int(np.floor(np.float32(v) * scale + np.float32(0.5))) for v in flat]
    assert (p.width, p.height) == (w, h) and p.samples[:, :, 0].reshape(-1).tolist() == want


def test_bad_files_are_refused(spark, tmp_path):
    dib, odd = save(tmp_path, "a.dib", b"this is not a bitmap of any kind, sir"), save(tmp_path, "b.pgm", b"P2\n2 1\n255\n1 # 2\n")
    with pytest.raises(ValueError, match="knows its format"):
        images.read(spark, [dib])
    with pytest.raises(Exception, match="ASCII raster"):
        images.read(spark, [odd]).collect()
    with pytest.raises(ValueError, match="at least one"):
        images.read(spark, [])
    with pytest.raises(ValueError, match="prefetch"):
        images.check_arguments(["a"], prefetch=17)


def parse_png(data):
    """An independent reader: chunks, checked, and rows filtered by none or up."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, names, body = 8, [], b""
    while at < len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        names.append(name)
        if name == b"IHDR":
            w, h, depth, kind = struct.unpack(">IIBB", data[at + 8 : at + 18])
        body += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += 12 + n
    raw, stride, rows = zlib.decompress(body), -(-w * {0: 1, 2: 3, 4: 2, 6: 4}[kind] * depth // 8), []
    for y in range(h):
        line = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        up = rows[-1] if rows and line[0] == 2 else bytes(stride)
        rows.append(bytes((a + b) & 255 for a, b in zip(line[1:], up, strict=True)))
    return names, w, h, depth, kind, b"".join(rows)


def test_sink_round_trip_and_receipts(spark, tmp_path, pictures):
    frames = images.read(spark, list(pictures), mismatch=True)
    receipts = png_sink.write_png(frames, output_path=f"{tmp_path}/f%03d.png", start_number=7).orderBy("n").collect()
    assert [r.path for r in receipts] == [f"{tmp_path}/f007.png", f"{tmp_path}/f008.png"] and all(r.performed for r in receipts)
    names, w, h, depth, kind, rows = parse_png(open(receipts[0].path, "rb").read())
    assert (w, h, depth, kind, rows) == (2, 1, 8, 2, bytes([255, 0, 0, 0, 255, 0])) and names[0] == b"IHDR"
    assert parse_png(open(receipts[1].path, "rb").read())[3:] == (16, 0, b"\x00\x01\x00\x02")
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".pngwrite")]
    with pytest.raises(Exception, match="exists already"):
        png_sink.write_png(frames, output_path=f"{tmp_path}/f%03d.png", start_number=7)
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".pngwrite")]
    png_sink.write_png(frames, output_path=f"{tmp_path}/f%03d.png", start_number=7, overwrite=True, depth=8)
    assert parse_png(open(receipts[1].path, "rb").read())[3] == 8


def test_sink_refusals(spark, tmp_path, pictures):
    frames = images.read(spark, list(pictures), mismatch=True)
    for bad in ({}, {"output_path": "a", "output_dir": "b"}, {"output_path": f"{tmp_path}/no/f%d.png"}, {"output_path": f"{tmp_path}/f%x.png"}, {"output_path": f"{tmp_path}/f.png"}, {"output_dir": f"{tmp_path}/d", "compression": 10}, {"output_dir": f"{tmp_path}/d", "start_number": 1}):
        with pytest.raises(ValueError):
            png_sink.write_png(frames, **bad)
    with pytest.raises(Exception, match="narrow word"):
        png_sink.write_png(frames, output_dir=f"{tmp_path}/d", depth=4)


def test_templates():
    assert P.parse_template("a%%b%d-%03d") == ["a", "%", "b", 0, "-", 3]
    for bad in ("%", "a%x", "%0", "%065d", "%0x"):
        with pytest.raises(ValueError):
            P.parse_template(bad)


def test_identification_order(spark):
    heads = [(b"\x00\x00\x00\x1cftypavif", "avif"), (b"\x00\x00\x00\x1cftypisom", None), (b"P6\n", "pnm"), (b"P6", "pnm"), (b"P8\n", None), (b"P6x", None), (b"RIFF0000WAVE", None), (b"\xff\x0a", "jxl"), (b"\xff\x4f", "jp2"), (b"BM", "bmp"), (b"", None)]
    df = spark.createDataFrame([(i, bytearray(h)) for i, (h, _) in enumerate(heads)], "i int, head binary")
    got = {r.i: r.f for r in df.select("i", I.identify(F.col("head")).alias("f")).collect()}
    assert [got[i] for i in range(len(heads))] == [f for _, f in heads]


def test_stream_ledger_equals_batch(spark, tmp_path):
    from cinegrid.streaming import ledger

    requests = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, frame long").repartition(3)
    requests.write.parquet(f"{tmp_path}/in")
    stream = ledger.first_requests(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.frame for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))
    batch = P.ledger(requests, "frame", "id").where("performed").collect()
    assert sorted((r.frame, r.id) for r in batch) == [(i, i) for i in range(7)]
