"""Colour profiles embedded in JPEG, GIF and WebP files, put together from their fragments: walks over a file's bytes, which a plan
drops where nothing asks for the profile."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column

from cinegrid.functions import walk

#: The routes whose profiles are read.
ROUTES = ["jpeg", "gif", "webp"]
# Markers of a JPEG, what its profile segments begin with, the GIF extension and the WebP chunk of a profile.
SEGMENT, SCAN, END, ALONE = 0xE2, 0xDA, 0xD9, {0x01, *range(0xD0, 0xD9)}
JPEG_LABEL, GIF_LABEL, WEBP_CHUNK = b"ICC_PROFILE\0", b"!\xff\x0bICCRGBG1012", b"ICCP"


def jpeg_profile(d: bytes) -> bytes | None:
    """None where fragments are not numbered 1 to as many as there are, once each, or state another number; at most 254."""
    at, found = 2, []
    while at + 2 <= len(d) and d[at] == 0xFF:
        kind = d[at + 1]
        if kind in ALONE:
            at += 2
            continue
        if kind == 0xFF:
            at += 1
            continue
        size = walk.num(d, at + 2, 2)
        if kind in (SCAN, END) or size is None or size < 2 or at + 2 + size > len(d):
            break
        if kind == SEGMENT and size >= 16 and d[at + 4 : at + 16] == JPEG_LABEL:
            found.append((d[at + 16], d[at + 17], d[at + 18 : at + 2 + size]))
        at += 2 + size
    found.sort()
    whole = found and len(found) < 255 and [f[:2] for f in found] == [(i + 1, len(found)) for i in range(len(found))]
    return b"".join(f[2] for f in found) if whole else None


def gif_profile(d: bytes) -> bytes | None:
    """The sub-blocks of the profile's extension; one that is cut off is none."""
    at = 13 + walk.colour_table(d[10] if len(d) > 10 else 0)
    while at < len(d):
        found = None
        if d[at] == 0x21:
            if d[at : at + 14] == GIF_LABEL:
                at, found = at + 14, []
            else:
                at += 2
        elif d[at] == 0x2C and at + 11 <= len(d):
            at += 11 + walk.colour_table(d[at + 9])
        else:
            return None
        while at < len(d) and d[at]:
            if found is not None:
                found.append(d[at + 1 : at + 1 + d[at]])
            at += 1 + d[at]
        if at >= len(d):
            return None
        if found is not None:
            return b"".join(found) if found else None
        at += 1
    return None


def webp_profile(d: bytes) -> bytes | None:
    """The last whole profile chunk."""
    at, found = 12, None
    while at + 8 <= len(d):
        size = walk.num(d, at + 4, 4, "little")
        if at + 8 + size > len(d):
            break
        if d[at : at + 4] == WEBP_CHUNK:
            found = d[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found


def profile(route: Column, content: Column) -> Column:
    """A file's embedded profile; null where it has none, or where fragments are missing, repeated or disagree about their number."""
    of = {"jpeg": jpeg_profile, "gif": gif_profile, "webp": webp_profile}
    return walk.walked(pa.binary(), lambda r, d: of[r](d) if d is not None and r in of else None, route, content)
