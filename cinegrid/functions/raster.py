"""Geometry and planes as Column expressions over row-major sample arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions import tables as t


def transform_flag(code: Column, which: int) -> Column:
    """transpose (0), flip x (1) or flip y (2) of an orientation code 1..8."""
    return code.isin([c for c, flags in t.ORIENTATIONS.items() if flags[which]])


def inverse_orientation(code: Column) -> Column:
    out = code
    for a, b in t.INVERSE_ORIENTATION.items():
        if a != b:
            out = F.when(code == a, b).otherwise(out)
    return out


def output_size(code: Column, width: Column | int, height: Column | int) -> tuple[Column, Column]:
    swap = transform_flag(code, 0)
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)


def source_of(code: Column, x: Column, y: Column, out_width: Column, out_height: Column) -> tuple[Column, Column]:
    """The stored sample that an output sample shows: mirrors in output space, then the transpose."""
    fx = F.when(transform_flag(code, 1), out_width - 1 - x).otherwise(x)
    fy = F.when(transform_flag(code, 2), out_height - 1 - y).otherwise(y)
    swap = transform_flag(code, 0)
    return F.when(swap, fy).otherwise(fx), F.when(swap, fx).otherwise(fy)


def oriented(plane: Column, code: Column, width: int, height: int) -> Column:
    """A whole plane as it is shown."""
    ow, oh = output_size(code, width, height)

    def sample(i: Column) -> Column:
        sx, sy = source_of(code, i % ow, F.floor(i / ow).cast("int"), ow, oh)
        return F.get(plane, (sy * width + sx).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), sample)


def channel(interleaved: Column, channels: int, which: int) -> Column:
    """One plane of an interleaved row."""
    return F.filter(interleaved, lambda v, i: i % channels == which)


def opaque(samples: int, most: Column | int) -> Column:
    """The alpha plane of a picture that has none."""
    return F.array_repeat(F.lit(most) if isinstance(most, int) else most, samples)


def at_depth(fmt: Column, bits: Column) -> Column:
    """Gray16 and RGB48 take the label of a smaller depth; other formats keep theirs."""
    return (
        F.when(fmt == "Gray16", F.concat(F.lit("Gray"), bits.cast("string")))
        .when(fmt == "RGB48", F.concat(F.lit("RGB"), (bits * 3).cast("string")))
        .otherwise(fmt)
    )


# Orientation codes of counter-clockwise quarter turns without a mirror, and with one about axis 0 or 1.
TURNED = {None: [1, 8, 3, 6], 0: [4, 5, 2, 7], 1: [2, 7, 4, 5]}


def container_orientation(angle: Column, mirror: Column) -> Column:
    """The orientation code of a container's rotation (quarter turns) and mirror (axis, null for none)."""

    def of(axis: int | None) -> Column:
        return F.get(F.array(*map(F.lit, TURNED[axis])), angle.cast("int"))

    return F.when(mirror == 0, of(0)).when(mirror == 1, of(1)).otherwise(of(None))


def shown_orientation(code: Column, apply: Column) -> Column:
    """The code that a picture is turned by: its own, or none where pictures stay as they are stored."""
    return F.when(apply, F.coalesce(code, F.lit(1))).otherwise(F.lit(1))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value's expression standing in the plan once."""
    return F.get(F.transform(F.array(value), use), 0)


def exif_orientation(payload: Column) -> Column:
    """The orientation 1 to 8 that an EXIF payload (a TIFF header on) states, null where it states none or is cut off."""

    def stated(text: Column) -> Column:  # two hexadecimal digits a byte
        big = F.substring(text, 1, 8) == "4D4D002A"
        known = big | (F.substring(text, 1, 8) == "49492A00")

        def number(at: Column, size: int) -> Column:
            digits = 2 * size

            def read(d: Column) -> Column:
                little = F.concat(*[F.substring(d, i, 2) for i in reversed(range(1, digits, 2))])
                return F.when(F.length(d) == digits, F.conv(F.when(big, d).otherwise(little), 16, 10).cast("bigint"))

            return bound(F.substr(text, (at * 2 + 1).cast("int"), F.lit(digits)), read)

        def of_directory(directory: Column) -> Column:
            # entries beyond the payload hold nothing
            room = F.floor((F.length(text) / 2 - directory - 2) / 12).cast("bigint") + 1
            entries = bound(F.least(number(directory, 2), room), lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)))
            places = F.transform(entries, lambda i: directory + 2 + i * 12)
            mine = F.get(F.filter(places, lambda at: number(at, 2) == 0x0112), F.lit(0))
            return bound(bound(mine + 8, lambda at: number(at, 2)), lambda code: F.when(code.between(1, 8), code.cast("int")))

        within = F.when(known, number(F.lit(4), 4))
        return bound(bound(within, lambda at: F.when(at + 2 <= F.length(text) / 2, at)), of_directory)

    return bound(F.hex(payload), stated)


def fits(width: Column, height: Column, across: Column, down: Column) -> Column:
    """Whether planes subsampled by so many bits an axis hold a picture of that size."""
    return (width % F.call_function("shiftleft", F.lit(1), across) == 0) & (height % F.call_function("shiftleft", F.lit(1), down) == 0)
