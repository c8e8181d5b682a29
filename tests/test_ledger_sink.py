import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrid.operators import validate as V
from cinegrid.sources import codecs, png_sink


def frames(spark, ns, value=1):
    return spark.createDataFrame([(n, f"/in/{n}.png", "Gray8", 2, 1, [bytearray([value, n])], None) for n in ns], "n int, path string, format string, width int, height int, planes array<binary>, alpha binary")


def receipts(df):
    return sorted((r.n, os.path.basename(r.path), r.saved, r.performed) for r in df.collect())


def test_second_request_is_saved_but_not_performed(spark, tmp_path):
    out, book = f"{tmp_path}/f%02d.png", f"{tmp_path}/book"
    got = receipts(png_sink.write_png(frames(spark, [1, 2, 2]), output_path=out, ledger=book))
    assert got == [(1, "f01.png", True, True), (2, "f02.png", True, False), (2, "f02.png", True, True)]
    stamp = os.stat(f"{tmp_path}/f01.png").st_mtime_ns
    again = receipts(png_sink.write_png(frames(spark, [1, 3], 9), output_path=out, ledger=book))
    assert again == [(1, "f01.png", True, False), (3, "f03.png", True, True)] and os.stat(f"{tmp_path}/f01.png").st_mtime_ns == stamp
    always = receipts(png_sink.write_png(frames(spark, [1], 7), output_path=out, ledger=book, always_save=True, overwrite=True))
    assert always == [(1, "f01.png", True, True)] and codecs.decode("png", open(f"{tmp_path}/f01.png", "rb").read()).samples.reshape(-1).tolist() == [7, 1]
    with pytest.raises(Exception, match="exists already"):
        png_sink.write_png(frames(spark, [1]), output_path=out)
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".pngwrite") or f.startswith(".ledger")]


def test_publish_is_exclusive(tmp_path):
    writer = png_sink.PngWriter({"ledger": str(tmp_path)}, False)
    for n in "ab":
        (tmp_path / f".{n}").write_text(n)
    (tmp_path / "x").write_text("other")
    with pytest.raises(FileExistsError):
        writer.publish(str(tmp_path / ".a"), str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "other"
    again = png_sink.PngWriter({"epoch": "3"}, False)
    (tmp_path / ".c").write_text("other")
    again.publish(str(tmp_path / ".c"), str(tmp_path / "x"))  # published by an attempt before
    assert not (tmp_path / ".c").exists()


def test_stream_batches_are_written_once(spark, tmp_path):
    out, book = f"{tmp_path}/f%d.png", f"{tmp_path}/book"
    write = png_sink.stream_writer(book, output_path=out)
    write(frames(spark, [1, 2]), 0)
    for f in os.listdir(book):
        os.remove(f"{book}/{f}")  # the driver was lost after publishing, before the ledger was written
    write(frames(spark, [1, 2]), 0)
    write(frames(spark, [1, 2]), 0)
    write(frames(spark, [2, 3]), 1)
    assert sorted(os.listdir(tmp_path)) == ["book", "f1.png", "f2.png", "f3.png"]
    assert sorted(r.n for r in spark.read.schema("n long, path string").json(book).distinct().collect()) == [1, 2, 3]


def test_alpha_clips_are_refused_by_name(spark):
    c = spark.createDataFrame([(1, n, "RGB", "integer", 8, 4, 4) for n in range(5)], "clip int, n int, family string, sample string, bits int, width int, height int")
    gray = c.withColumn("family", F.lit("Gray"))
    V.refuse_alpha(c, gray, "clip", "n")
    with pytest.raises(ValueError, match="5 frames beside 4"):
        V.refuse_alpha(c, gray.where("n < 4"), "clip", "n")
    with pytest.raises(ValueError, match="frame 2: samples of another depth"):
        V.refuse_alpha(c, gray.withColumn("bits", F.when(F.col("n") > 1, 16).otherwise(8)), "clip", "n")
