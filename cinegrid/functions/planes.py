"""Planes as windows of a buffer: a first byte, rows that are a stride apart, samples of a fixed size. Column expressions over binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions import raster as R


def joined(pieces: Column) -> Column:
    """An array of binaries, one after the other; null where one is null."""
    return F.when(F.forall(pieces, lambda p: p.isNotNull()), F.unhex(F.array_join(F.transform(pieces, F.hex), "")))


def upto(count: Column) -> Column:
    """0 to count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def cut(data: Column, at: Column, size: Column) -> Column:
    return F.substr(data, (at + 1).cast("int"), size.cast("int"))


def window(buffer: Column, first: Column, stride: Column, row: Column, rows: Column) -> Column:
    """The rows of `row` bytes that begin at `first` and are `stride` bytes apart, without what lies between them."""
    read = lambda d: F.when(stride == row, cut(d, first, row * rows)).otherwise(joined(F.transform(upto(rows), lambda y: cut(d, first + y * stride, row))))
    return R.bound(buffer, read)


def plane_size(plane: Column, width: Column, height: Column, across: Column, down: Column, up: bool) -> tuple[Column, Column]:
    """Size of a plane of a picture whose planes after the first are halved where across and down are 1; a decoder rounds odd sizes
    up, a frame rounds them down."""
    half = lambda n, bit: F.when((plane > 0) & (bit == 1), F.floor((n + (1 if up else 0)) / 2)).otherwise(n).cast("bigint")
    return half(width, across), half(height, down)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def packed_refusal(length: Column, plane: Column, row: Column, rows: Column) -> Column:
    """A packed plane is the whole picture and nothing else."""
    return F.when(length != row * rows, text("plane ", plane, " has ", length, " bytes instead of ", row * rows))


def strided_refusal(length: Column, plane: Column, first: Column, stride: Column, row: Column, rows: Column, whole: bool = True) -> Column:
    """Rows must not be wider than their stride, nor lie beyond the buffer; unless whole, the last row needs no padding after it."""
    needed = stride * rows if whole else F.when(rows > 0, stride * (rows - 1) + row).otherwise(0)
    return F.when(stride < row, text("plane ", plane, " has rows of ", row, " bytes, ", stride, " bytes apart")).when(
        first + needed > length, text("plane ", plane, " needs ", needed, " bytes from ", first, " on, of ", length)
    )


def filling_refusal(plane: Column, code: Column, stored: tuple[Column, Column], frame: tuple[Column, Column]) -> Column:
    """A stored plane, as it is shown, must not be smaller than the frame's; one that is larger loses its last row or column."""
    wide, high = R.output_size(code, *stored)
    return F.when((wide < frame[0]) | (high < frame[1]), text("plane ", plane, " is ", wide, "x", high, ", not ", frame[0], "x", frame[1]))


def turned(buffer: Column, first: Column, stride: Column, size: Column, code: Column, frame: tuple[Column, Column]) -> Column:
    """A packed plane of the frame's size, as an orientation code shows the stored plane. Rows that keep their samples' order move
    whole, others sample by sample."""
    wide, high = frame
    row = wide * size

    def read(d: Column) -> Column:
        flipped = joined(F.transform(upto(high), lambda y: cut(d, first + (high - 1 - y) * stride, row)))

        def sample(i: Column) -> Column:
            x, y = R.source_of(code, i % wide, F.floor(i / wide), wide, high)
            return cut(d, first + y * stride + x * size, size)

        moved = joined(F.transform(upto(wide * high), sample))
        straight = ~R.transform_flag(code, 0) & ~R.transform_flag(code, 1)
        return F.when(straight & R.transform_flag(code, 2), flipped).when(straight, window(d, first, stride, row, high)).otherwise(moved)

    return R.bound(buffer, read)


def aperture_refusal(crop: Column, coded: Column) -> Column:
    """crop (width, height, x, y) must lie within the coded picture (width, height)."""
    beyond = (crop["x"] + crop["width"] > coded["width"]) | (crop["y"] + crop["height"] > coded["height"])
    shown = text("it presents ", crop["width"], "x", crop["height"], " at ", crop["x"], ",", crop["y"], " of ", coded["width"], "x", coded["height"])
    return F.when(coded.isNull(), "it states no size of its coded pictures").when(beyond, shown)


def cropped(plane: Column, size: Column, crop: Column, coded: Column) -> Column:
    """The aperture of a packed plane of the coded size."""
    stride = coded["width"] * size
    return window(plane, crop["y"] * stride + crop["x"] * size, stride, crop["width"] * size, crop["height"])
