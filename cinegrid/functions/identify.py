"""Content identification as Column expressions over the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions import tables as t


def _begins(head: Column, hexes: list[str]) -> Column:
    out = F.lit(False)
    for h in hexes:
        out = out | (F.substring(head, 1, len(h) // 2) == F.lit(bytes.fromhex(h)))
    return out


def identify(head: Column) -> Column:
    """The format that the bytes show, or null. An ISO file of any other brand is nothing at all."""
    brand = F.decode(F.substring(head, 9, 4), "ISO-8859-1")
    iso = F.when(brand.isin(t.AVIF_BRANDS), "avif").when(brand.isin(t.HEIF_BRANDS), "heif")
    out = F.when((F.substring(head, 5, 4) == F.lit(b"ftyp")) & (F.length(head) >= 12), iso)
    for name, hexes in t.SIGNATURES:
        if name == "webp":
            found = _begins(head, ["52494646"]) & (F.substring(head, 9, 4) == F.lit(b"WEBP"))
        elif name == "pnm":
            second, third = F.substring(head, 2, 1), F.substring(head, 3, 1)
            kind = second.isin([bytes([48 + i]) for i in range(1, 8)])
            space = third.isin([bytes([c]) for c in (9, 10, 12, 13, 32)])
            found = _begins(head, ["50"]) & kind & ((F.length(head) == 2) | space)
        else:
            found = _begins(head, hexes)
        out = out.when(found, name)
    return out


def extension(path: Column) -> Column:
    """The lower-cased extension of the last path segment; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def from_extension(path: Column) -> Column:
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, known in t.EXTENSIONS.items():
        out = F.when(ext.isin(known), name).otherwise(out)
    return out


def little_endian(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number at a byte offset; null where the bytes end before."""
    piece = F.substring(data, at + 1, size)
    swapped = F.concat(*[F.substring(data, at + i, 1) for i in range(size, 0, -1)])
    return F.when(F.length(piece) == size, F.conv(F.hex(swapped), 16, 10).cast("bigint"))


def is_bare_dib(head: Column) -> Column:
    """Whether the bytes are a bitmap header without the file header, of a depth and compression that can be read."""
    size = little_endian(head, 0, 4)
    core = size == 12
    depth = F.when(core, little_endian(head, 10, 2)).otherwise(little_endian(head, 14, 2))
    compression = F.when(core, F.lit(0).cast("bigint")).otherwise(little_endian(head, 16, 4))
    fits = F.lit(False)
    for code, depths in t.DIB_DEPTHS.items():
        fits = fits | ((compression == code) & depth.isin(depths))
    return F.coalesce(size.isin(t.DIB_SIZES) & fits, F.lit(False))


def route(head: Column, path: Column) -> Column:
    """Content decides, the name helps out; a bitmap by name alone must have a bare bitmap header."""
    named = from_extension(path)
    return F.coalesce(identify(head), F.when((named != "bmp") | is_bare_dib(head), named))


def has_signature(fmt: Column) -> Column:
    return ~fmt.isin("tga", "ico")
