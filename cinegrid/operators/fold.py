"""Compositing as an order-dependent fold over the pictures of one animation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gif_pixel(frames: DataFrame, animation: str, order: str) -> DataFrame:
    """What one pixel shows in every picture: -1 is clear. frames: colour, clear, disposal (keep, any, background,
    previous; null where the picture does not reach the pixel).

    A clear pixel shows the base. What a picture leaves is itself (keep or any), clear (background) or the base before (previous),
    so the base of a picture is what the last earlier picture left that left anything of its own: no fold is needed.
    """
    w = W.partitionBy(animation).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    leaves = F.when(F.col("disposal") == "background", F.lit(-1)).when(F.col("disposal").isin("keep", "any") & ~F.col("clear"), F.col("colour"))
    base = F.coalesce(F.last(leaves, ignorenulls=True).over(w), F.lit(-1))
    shown: Column = F.when(F.col("clear"), base).otherwise(F.col("colour"))
    return frames.select(animation, order, shown.cast("int").alias("shown"))


def gif_canvas(frames: DataFrame, animation: str, order: str, width: int, height: int) -> DataFrame:
    """Every picture of every animation on a canvas of that size: animation, order and shown (row by row, -1 is clear).

    frames: left, top, wide (of the picture's rectangle), pixels (its colours row by row, null where clear) and disposal. A pixel of
    the canvas is a fold of its own, so the canvases of an animation are spread over as many groups as there are pixels.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    d = frames.withColumn("_at", at)
    x, y = F.col("_at") % width - F.col("left"), F.floor(F.col("_at") / width) - F.col("top")
    inside = (x >= 0) & (x < F.col("wide")) & (y >= 0) & (y * F.col("wide") + x < F.size("pixels"))
    colour = F.when(inside, F.get("pixels", (y * F.col("wide") + x).cast("int")))
    d = d.select(F.struct(F.col(animation), F.col("_at")).alias("_pixel"), order, colour.alias("colour"), F.when(inside, F.col("disposal")).alias("disposal"))
    shown = gif_pixel(d.withColumn("clear", F.col("colour").isNull()), "_pixel", order)
    listed = shown.groupBy(F.col(f"_pixel.{animation}").alias(animation), order).agg(F.array_sort(F.collect_list(F.struct(F.col("_pixel._at"), "shown"))).alias("p"))
    return listed.select(animation, order, F.col("p.shown").alias("shown"))
