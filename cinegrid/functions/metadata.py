"""Colour metadata of frames as typed nullable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions import tables as t


def chroma_location(av1_position: Column) -> Column:
    """AV1's sample position 1 is left (0), 2 top left (2); others say nothing."""
    return F.when(av1_position == 1, 0).when(av1_position == 2, 2)


def usable_matrix(code: Column) -> Column:
    return ~code.isin(0, 2)


def frame_props(family: Column, primaries: Column, transfer: Column, matrix: Column, full: Column, position: Column, subsampled: Column) -> list[Column]:
    """The colour properties of a frame. Codes are null where the file states none; unnamed codes are not passed on."""
    yuv, rgb = family == "YUV", family == "RGB"
    named = F.when(matrix.isin(t.MATRICES), matrix)
    return [
        F.when(primaries.isin(t.PRIMARIES), primaries).cast("int").alias("primaries"),
        F.when(transfer.isin(t.TRANSFERS), transfer).cast("int").alias("transfer"),
        F.when(rgb, 0).when(yuv, F.coalesce(named, F.lit(5))).cast("int").alias("matrix"),
        F.when(yuv & ~F.coalesce(full, F.lit(False)), "limited").otherwise("full").alias("range"),
        F.when(yuv & subsampled, chroma_location(position)).cast("int").alias("chroma_location"),
        F.lit(0).alias("field_based"),
    ]


# Luma coefficients (red, green, blue) that a YCbCr page can name, by matrix code, and how near they must be.
PAGE_COEFFICIENTS = {5: (0.299, 0.587, 0.114), 1: (0.2126, 0.7152, 0.0722)}
NEAR = 0.005


def tiff_colour(coefficients: Column, levels: Column) -> Column:
    """Struct matrix, full of a YCbCr page from its coefficients and reference levels (arrays; null or empty where it states none).
    Null where no matrix is named: such a page is converted by its own coefficients. Other lengths are errors."""
    none = F.coalesce(F.size(coefficients), F.lit(0)) <= 0
    matrix = F.when(none, 5)
    for code, named in PAGE_COEFFICIENTS.items():
        close = F.lit(True)
        for i, v in enumerate(named):
            close = close & (F.abs(F.get(coefficients, i) - F.lit(v)) < NEAR)
        matrix = matrix.when(close, code)
    matrix = F.when(~none & (F.size(coefficients) != 3), F.raise_error(F.lit("the coefficients of a YCbCr page are not three numbers"))).otherwise(matrix).cast("int")
    silent = F.coalesce(F.size(levels), F.lit(0)) <= 0
    full = F.when(silent, True).when(F.size(levels) != 6, F.raise_error(F.lit("the reference levels of a YCbCr page are not three pairs"))).otherwise((F.get(levels, 0) == 0) & (F.get(levels, 1) == 255)).cast("boolean")
    return F.when(matrix.isNotNull(), F.struct(matrix.alias("matrix"), full.alias("full")))
