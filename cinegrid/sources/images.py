"""Reading image sequences: files are identified and probed in Column expressions, decoded in Arrow batches of whole files.

The frames table has one row a frame: n, file_index, path, local, presentation, hold, format, width, height, orientation, planes
(binary, row-major, 16-bit samples little-endian), alpha and the original colour type. Order is data: file_index and n, never the scan's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions import identify as I
from cinegrid.functions import profiles
from cinegrid.functions import raster as R
from cinegrid.functions import walk
from cinegrid.operators import file_timelines
from cinegrid.operators import validate as V
from cinegrid.operators.timeline import reduce_fps
from cinegrid.sources import codecs

FRAMES = "file_index long, width int, height int, format string, planes array<binary>, alpha binary, error string"
HEAD_BYTES = 64 << 10


def check_arguments(files: list[str], fpsnum: int = 24, fpsden: int = 1, prefetch: int | None = None, prefetch_memory: int | None = None) -> tuple[int, int]:
    """The reduced rate; prefetch settings are accepted, since Spark schedules the work itself."""
    if not files:
        raise ValueError("files must name at least one file")
    if prefetch is not None and not 0 <= prefetch <= 16:
        raise ValueError("prefetch must be between 0 and 16 workers")
    if prefetch_memory is not None and prefetch_memory < 1:
        raise ValueError("prefetch_memory must be at least 1 MiB")
    return reduce_fps(fpsnum, fpsden)


def file_table(spark: SparkSession, files: list[str]) -> DataFrame:
    """file_index, path, length, changed and content of the listed files; a file listed twice has two rows."""
    listed = spark.createDataFrame(list(enumerate(files)), "file_index long, path string")
    found = spark.read.format("binaryFile").load(sorted(set(files))).select(F.col("path").alias("uri"), "length", F.col("modificationTime").alias("changed"), "content")
    key = F.regexp_replace("uri", "^file:(//)?", "")
    return listed.join(found.withColumn("path", key), F.regexp_replace(listed["path"], "^file:(//)?", "") == key).select("file_index", listed["path"], "length", "changed", "content")


def unchanged(table: DataFrame, stamps: DataFrame) -> DataFrame:
    """table's rows, whose content is an error where the file's length or time is not that of stamps (file_index, length, changed).
    A scan that reads a file again must find the one that was probed."""
    then = stamps.select("file_index", F.col("length").alias("_length"), F.col("changed").alias("_changed"))
    same = (F.col("length") == F.col("_length")) & (F.col("changed") == F.col("_changed"))
    said = F.raise_error(F.concat(F.lit("changed since it was probed: "), F.col("path")))
    return table.join(F.broadcast(then), "file_index").withColumn("content", F.when(same, F.col("content")).otherwise(said.cast("binary"))).drop("_length", "_changed")


def big_endian(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def probe(files: DataFrame) -> DataFrame:
    """Adds route, width, height and original_color_type from each file's first bytes. No Python is involved."""
    head = F.substring("content", 1, HEAD_BYTES)
    d = files.withColumn("route", I.route(F.substring("content", 1, 20), F.col("path"))).withColumn("_h", head)
    h = F.col("_h")
    text = F.regexp_replace(F.decode(h, "ISO-8859-1"), r"#[^\n\r]*[\n\r]", " ")
    pnm = r"^P[1-6]\s+([0-9]+)\s+([0-9]+)(?:\s+([0-9]+))?"

    def pam(field: str) -> Column:
        return F.regexp_extract(text, rf"\n{field}[ \t]+([A-Z_0-9]+)", 1)

    number = lambda c: F.when(c != "", c).cast("bigint")
    is_pam = F.substring(text, 1, 2) == "P7"
    width = (
        F.when(d["route"] == "png", big_endian(h, 16, 4)).when(d["route"] == "gif", I.little_endian(h, 6, 2)).when(d["route"] == "farbfeld", big_endian(h, 8, 4))
        .when(d["route"] == "qoi", big_endian(h, 4, 4)).when(d["route"] == "dds", I.little_endian(h, 16, 4)).when(d["route"] == "bmp", I.little_endian(h, 18, 4)).when(d["route"] == "tga", I.little_endian(h, 12, 2))
        .when((d["route"] == "pnm") & is_pam, number(pam("WIDTH"))).when(d["route"] == "pnm", number(F.regexp_extract(text, pnm, 1)))
    )
    height = (
        F.when(d["route"] == "png", big_endian(h, 20, 4)).when(d["route"] == "gif", I.little_endian(h, 8, 2)).when(d["route"] == "farbfeld", big_endian(h, 12, 4))
        .when(d["route"] == "qoi", big_endian(h, 8, 4)).when(d["route"] == "dds", I.little_endian(h, 12, 4)).when(d["route"] == "bmp", I.little_endian(h, 22, 4)).when(d["route"] == "tga", I.little_endian(h, 14, 2))
        .when((d["route"] == "pnm") & is_pam, number(pam("HEIGHT"))).when(d["route"] == "pnm", number(F.regexp_extract(text, pnm, 2)))
    )
    # png: bit depth and colour type; palettes and narrow samples come out as 8 bits
    depth, kind = big_endian(h, 24, 1), big_endian(h, 25, 1)
    wide = F.when(depth == 16, "16").otherwise("8")
    png = F.concat(F.when(kind == 0, "L").when(kind == 4, "La").when(kind.isin(2, 3), "Rgb").otherwise("Rgba"), F.when(kind == 3, "8").otherwise(wide))
    most = F.when(is_pam, number(pam("MAXVAL"))).otherwise(number(F.regexp_extract(text, pnm, 3)))
    of = F.when(is_pam, F.get(F.array(*map(F.lit, ["L", "La", "Rgb", "Rgba"])), (number(pam("DEPTH")) - 1).cast("int"))).when(F.substring(text, 2, 1).isin("3", "6"), "Rgb").otherwise("L")
    bitmap = F.substring(text, 2, 1).isin("1", "4") & ~is_pam
    source = (
        F.when(d["route"] == "png", F.when((kind == 0) & (depth == 1), "L1").otherwise(png))
        .when(d["route"] == "pnm", F.when(bitmap, "L1").otherwise(F.concat(of, F.when(most > 255, "16").otherwise("8"))))
        .when(d["route"] == "farbfeld", "Rgba16").when(d["route"] == "gif", "Rgba8").when(d["route"] == "qoi", F.when(big_endian(h, 12, 1) == 4, "Rgba8").otherwise("Rgb8"))
    )
    base = F.regexp_replace(F.when(source == "L1", "L8").otherwise(source), "a(8|16)$", "$1")
    fmt = F.when(base == "L8", "Gray8").when(base == "L16", "Gray16").when(base.isin("Rgb8", "Rgb"), "RGB24").when(base == "Rgb16", "RGB48")
    return d.select(*files.columns, "route", width.cast("int").alias("width"), height.cast("int").alias("height"), source.alias("original_color_type"), fmt.alias("format"))


def probe_orientation(route: Column, content: Column) -> Column:
    """The orientation code that a file states: a PNG in its eXIf chunk; null where none is stated or looked for."""
    return F.when(route == "png", walk.png_exif(content)).cast("int")


def _decoded(with_alpha: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, route, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    p = codecs.decode(route, content)
                except ValueError as wrong:
                    yield pa.RecordBatch.from_pylist([{"file_index": index, "width": None, "height": None, "format": None, "planes": None, "alpha": None, "error": str(wrong)}], schema())
                    continue
                colours = p.channels - (p.channels in (2, 4))
                kind = np.dtype("<u2") if p.bits == 16 else np.dtype(np.uint8)
                planes = [np.ascontiguousarray(p.samples[:, :, c]).astype(kind).tobytes() for c in range(p.channels)]
                fmt = {(1, 8): "Gray8", (1, 16): "Gray16", (3, 8): "RGB24", (3, 16): "RGB48"}[colours, p.bits]
                opaque = np.full(p.width * p.height, (1 << p.bits) - 1, kind).tobytes()
                alpha = (planes[colours] if p.channels > colours else opaque) if with_alpha else None
                yield pa.RecordBatch.from_pylist([{"file_index": index, "width": p.width, "height": p.height, "format": fmt, "planes": planes[:colours], "alpha": alpha, "error": None}], schema())

    def schema() -> pa.Schema:
        return pa.schema([("file_index", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("format", pa.string()), ("planes", pa.list_(pa.binary())), ("alpha", pa.binary()), ("error", pa.string())])

    return run


def clip_of(probed: DataFrame, fps: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """probed: file_index, path, route, content. n, file_index, local, presentation and hold of every frame of the clip, and the
    file_index of animations; a file that states a timeline which cannot be shown raises, and names the file."""
    stated = file_timelines.pictures(probed, "file_index")
    refused = file_timelines.refusals(stated, "file_index").orderBy("file_index").limit(1).collect()
    if refused:
        path = probed.where(F.col("file_index") == refused[0].file_index).select("path").first()[0]
        raise ValueError(f"{path}: {refused[0].refusal}")
    return file_timelines.clip(stated, "file_index", fps), stated.where("animated").select("file_index").distinct()


def read(spark: SparkSession, files: list[str], fpsnum: int = 24, fpsden: int = 1, mismatch: bool = False, with_alpha: bool = False, apply_rotation: bool = True, icc_profile: bool = False, **prefetch) -> DataFrame:
    """One row a frame: n, file_index, path, local, presentation, hold, format, width, height, orientation, planes, alpha,
    original_color_type and, with icc_profile, the profile that a JPEG, GIF or WebP embeds. A still is one frame; an animation lasts as many frames at the rate as its file states.

    Headers and timelines are probed at once, and unless mismatch is set every file must look like the first. Pixels of stills
    decode when the frames are used, and a file that has changed by then raises; the pictures of animations are not decoded here,
    their planes are null. orientation is the code that a picture is to be turned by: 1 without apply_rotation.
    A file that cannot be decoded raises.
    """
    fps = check_arguments(files, fpsnum, fpsden, **prefetch)
    table = file_table(spark, files)
    probed = probe(table)
    seen = probed.select("file_index", "path", "route", "width", "height", "format", "length", "changed", "original_color_type", probe_orientation(F.col("route"), F.col("content")).alias("orientation"))
    seen = spark.createDataFrame(seen.collect(), seen.schema)  # a row a listed file, as many as the caller has named
    unknown = seen.where("route is null").orderBy("file_index").limit(1).collect()
    if unknown:
        raise ValueError(f"{unknown[0].path}: no reader here knows its format")
    if not mismatch:
        V.refuse_mismatch(seen, "file_index", "path", ["width", "height", "format"])
    frames, moving = clip_of(probed, fps)
    stills = unchanged(probed, seen).join(moving, "file_index", "left_anti")
    pixels = stills.select("file_index", "route", "content").mapInArrow(_decoded(with_alpha), FRAMES)
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("file "), F.col("file_index").cast("string"), F.lit(": "), F.col("error"))))
    pixels = pixels.withColumn("format", F.coalesce(failed.cast("string"), F.col("format"))).drop("error")
    pixels = pixels.select("file_index", *[F.col(c).alias(f"_{c}") for c in ("format", "width", "height")], "planes", "alpha")
    named = seen.select("file_index", "path", "format", "width", "height", "original_color_type", R.shown_orientation(F.col("orientation"), F.lit(apply_rotation)).alias("orientation"))
    out = frames.join(F.broadcast(named), "file_index").join(pixels, "file_index", "left")
    size = [F.coalesce(f"_{c}", c).alias(c) for c in ("format", "width", "height")]
    kept = []
    if icc_profile:  # only then are the bytes read and carried
        embedded = unchanged(probed, seen).select("file_index", profiles.profile(F.col("route"), F.col("content")).alias("icc_profile"))
        out, kept = out.join(embedded, "file_index", "left"), ["icc_profile"]
    return out.select(F.col("n").cast("int").alias("n"), "file_index", "path", F.col("local").cast("int").alias("local"), "presentation", "hold", *size, "orientation", "planes", "alpha", "original_color_type", *kept)


def read_alpha(spark: SparkSession, files: list[str], **arguments) -> tuple[DataFrame, DataFrame]:
    """The colour frames and the alpha frames of one sequence; both are projections of the same decode."""
    frames = read(spark, files, with_alpha=True, **arguments)
    depth = F.when(F.col("format").isin("Gray16", "RGB48"), "Gray16").otherwise("Gray8")
    return frames.drop("alpha"), frames.select("n", "file_index", "path", depth.alias("format"), "width", "height", F.array("alpha").alias("planes"))

