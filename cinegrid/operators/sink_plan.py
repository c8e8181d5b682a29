"""What the PNG sink writes and where: templates, names, claims, the ledger and the plan of each frame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_PADDING = 64


def parse_template(text: str) -> list[str | int]:
    """Literal pieces and numbers (their padding; 0 for none) of an output path."""
    pieces: list[str | int] = []
    at = 0
    for m in re.finditer(r"%(%|d|0([0-9]*)d|.?)", text, re.S):
        if m.start() > at:
            pieces.append(text[at : m.start()])
        at = m.end()
        kind = m[1]
        if kind == "%":
            pieces.append("%")
        elif kind == "d":
            pieces.append(0)
        elif m[2] is not None:
            width = int(m[2] or 0)
            if width > MOST_PADDING:
                raise ValueError(f"an output path number may be padded to at most {MOST_PADDING} digits, got {width}")
            pieces.append(width)
        else:
            raise ValueError("an output path knows '%d', '%0Nd' and '%%' only" if kind else "an output path ends with an incomplete '%'")
    if at < len(text):
        pieces.append(text[at:])
    return pieces


def render_template(text: str, number: Column) -> Column:
    digits = number.cast("string")
    out = []
    for p in parse_template(text):
        if isinstance(p, str):
            out.append(F.lit(p))
        else:
            out.append(F.when(F.length(digits) >= p, digits).otherwise(F.lpad(digits, max(p, 1), "0")) if p else digits)
    return F.concat(*out) if out else F.lit("")


def source_name(path: Column, animated: Column, number: Column) -> Column:
    """<stem>.png, or <stem>-NNNN.png for a picture of an animation."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(file.rlike(r"^.+\.[^.]*$"), F.regexp_extract(file, r"^(.+)\.[^.]*$", 1)).otherwise(file)
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    return F.concat(stem, F.when(animated, F.concat(F.lit("-"), padded)).otherwise(""), F.lit(".png"))


def conflicts(named: DataFrame, path: str = "path", frame: str = "n") -> DataFrame:
    """Paths that more than one frame claims, with the first two frames."""
    g = named.groupBy(path).agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count_distinct(frame).alias("frames"))
    return g.where("frames > 1")


def ledger(requests: DataFrame, frame: str, seq: str, always_save: bool = False) -> DataFrame:
    """Receipts of requests: a frame is written by its first request, later ones find it saved. Of requests with one sequence
    number each performs. First requests are aggregated by task, so no task needs all requests of a frame."""
    if always_save:
        return requests.withColumn("saved", F.lit(True)).withColumn("performed", F.lit(True))
    first = requests.groupBy(F.col(frame).alias("_frame")).agg(F.min(seq).alias("_first"))
    met = requests.join(first, F.col(frame).eqNullSafe(F.col("_frame")))
    return met.withColumn("saved", F.lit(True)).withColumn("performed", F.col(seq) == F.col("_first")).drop("_frame", "_first")


def write_plan(family: Column, sample: Column, bits: Column, alpha: Column, depth: Column) -> list[Column]:
    """kind, stored bits, carried bits, storage, colour type, whether sBIT is written, and why a frame is refused (else null)."""
    floats = sample == "float"
    kind = F.when((family == "YUV") & ~floats, "yuv").when(floats, "float").otherwise("integer")
    source = F.when(floats, 16).otherwise(bits)
    stored = F.coalesce(depth, F.when(source > 8, 16).otherwise(8))
    carried = F.when(kind == "integer", source).otherwise(F.least(source, stored))
    gray = family == "Gray"
    refused = (
        F.when((family == "YUV") & floats, "float yuv")
        .when(floats & (bits != 32), "float depth")
        .when(~floats & ~bits.between(8, 16), "integer depth")
        .when((stored < 8) & (~gray | alpha), "narrow word")
    )
    storage = F.when(carried == stored, "direct").when(carried > stored, "reduce").otherwise("widen")
    colour = F.when(gray & ~alpha, 0).when(gray, 4).when(~alpha, 2).otherwise(6)
    return [
        kind.alias("kind"), stored.cast("int").alias("stored"), carried.cast("int").alias("carried"), storage.alias("storage"),
        colour.cast("int").alias("color_type"), (F.least(carried, stored) != stored).alias("sbit"), refused.alias("refused"),
    ]


def cicp_chunk(primaries: Column, transfer: Column, converted: Column, matrix: Column, full: Column) -> Column:
    """The cICP chunk's bytes as an array, or null: both codes named, and an unconverted frame must be full-range RGB."""
    plain = F.coalesce(matrix == 0, F.lit(True)) & F.coalesce(full, F.lit(True))
    return F.when(primaries.isNotNull() & transfer.isNotNull() & (converted | plain), F.array(primaries, transfer, F.lit(0), F.lit(1)))


def best_icon_entry(entries: DataFrame, key: str, bpp: str, area: str, position: str) -> DataFrame:
    """For each icon its deepest, then largest entry; of equals the last."""
    return entries.groupBy(key).agg(F.max(F.struct(bpp, area, position)).alias("best")).select(key, "best.*")
