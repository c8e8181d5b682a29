"""Blending of one sample over another, as integer Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.operators.timeline import int_div, long


def blend_full(s: Column, sa: Column, d: Column, most: int) -> Column:
    """APNG: alpha 0 keeps what is there, full alpha copies, between them all channels mix, truncated."""
    s, sa, d = (c.cast("bigint") for c in (s, sa, d))
    mixed = int_div(s * sa + d * (long(most) - sa), most)
    return F.when(sa == 0, d).when(sa == most, s).otherwise(mixed)


def div255(v: Column) -> Column:
    """v / 255 for 0 <= v <= 255 * 255, rounded."""
    x = v + long(128)
    return F.shiftright(x + F.shiftright(x, 8), 8)


def over_alpha(sa: Column, ua: Column) -> Column:
    """WebP: the alpha of a pixel over another."""
    sa, ua = sa.cast("bigint"), ua.cast("bigint")
    return sa + div255(ua * (long(255) - sa))


def over_colour(s: Column, sa: Column, u: Column, ua: Column) -> Column:
    """WebP: one colour of a pixel over another; a clear pixel shows what is under it."""
    s, sa, u, ua = (c.cast("bigint") for c in (s, sa, u, ua))
    keep = div255(ua * (long(255) - sa))
    alpha = F.greatest(sa + keep, long(1))
    return F.when(sa == 0, u).otherwise(F.shiftright((s * sa + u * keep) * int_div(long(1 << 24), alpha), 24))
