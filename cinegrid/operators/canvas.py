"""Canvases of animations whose pictures blend with what is there: a fold in picture order, streamed over sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a canvas that are folded together; the bands of an animation are independent.
BAND_ROWS = 64
#: Samples of a batch that is handed on.
BATCH_SAMPLES = 1 << 20


def canvases(frames: DataFrame, animation: str, order: str, width: int, height: int, rule: str, most: int = 255, start: int = 0, band_rows: int = BAND_ROWS) -> DataFrame:
    """Every picture of every animation on its canvas: animation, order, band (of band_rows canvas rows) and shown (its RGBA
    samples, row by row).

    frames: left, top, wide, high, pixels (RGBA samples, row by row), over (blend, or else replace) and disposal (none, background,
    previous). With rule "apng" a picture beyond the canvas is an error; with "webp" it is clipped, and nothing is disposed of.
    The canvas starts with all samples at `start`. A picture is cut into bands before the shuffle, and each band of each
    animation is folded by one task, which holds that band only, however many pictures follow.
    """
    if rule not in ("apng", "webp"):
        raise ValueError("rule must be apng or webp")
    d = frames
    if rule == "apng":
        beyond = (F.col("left") + F.col("wide") > width) | (F.col("top") + F.col("high") > height)
        d = d.withColumn("wide", F.when(beyond, F.raise_error(F.lit("a picture reaches beyond its canvas"))).otherwise(F.col("wide")).cast("int"))
    bands = -(-height // band_rows)
    d = d.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    upper = F.col("band") * band_rows
    first = F.greatest(F.col("top"), upper)
    last = F.least(F.col("top") + F.col("high"), upper + band_rows, F.lit(height))
    stride = F.col("wide") * 4
    part = F.slice("pixels", ((first - F.col("top")) * stride + 1).cast("int"), (F.greatest(last - first, F.lit(0)) * stride).cast("int"))
    d = d.select(
        F.col(animation).alias("animation"), F.col(order).alias("place"), "band", F.col("left").cast("int").alias("left"), F.greatest(first - upper, F.lit(0)).cast("int").alias("row"),
        F.col("wide").cast("int").alias("wide"), part.cast("array<int>").alias("pixels"), F.coalesce("over", F.lit(False)).alias("over"), F.coalesce("disposal", F.lit("none")).alias("disposal"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    dealt = d.repartition("animation", "band").sortWithinPartitions("animation", "band", "place")
    out = dealt.mapInArrow(_folding(rule, width, height, most, start, band_rows), f"animation {kinds['animation']}, place {kinds['place']}, band int, shown array<int>")
    return out.select(F.col("animation").alias(animation), F.col("place").alias(order), "band", "shown")


def blended(rule: str, s: np.ndarray, u: np.ndarray, most: int) -> np.ndarray:
    """Straight-alpha RGBA samples s over u, as functions/composite.py has it for single samples."""
    sa, ua = s[..., 3:], u[..., 3:]
    if rule == "apng":
        return np.where(sa == 0, u, np.where(sa == most, s, (s * sa + u * (most - sa)) // most))
    x = ua * (255 - sa) + 128
    keep = (x + (x >> 8)) >> 8
    mixed = ((s * sa + u * keep) * ((1 << 24) // np.maximum(sa + keep, 1))) >> 24
    mixed[..., 3:] = sa + keep
    return np.where(sa == 0, u, mixed)


def _folding(rule: str, width: int, height: int, most: int, start: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, canvas = None, np.zeros((0, width, 4), np.int64)
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            held = c["pixels"]
            ends, samples = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
            small = {n: c[n].to_pylist() for n in ("animation", "band", "left", "row", "wide", "over", "disposal")}
            shown: list[np.ndarray] = []
            begun = 0

            def packed(begun: int, shown: list[np.ndarray]) -> pa.RecordBatch:
                n = len(shown)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(shown).astype(np.int32)))
                return pa.RecordBatch.from_arrays([c["animation"].slice(begun, n), c["place"].slice(begun, n), c["band"].slice(begun, n), lists], names=["animation", "place", "band", "shown"])

            for i in range(batch.num_rows):
                key = small["animation"][i], small["band"][i]
                if key != at:
                    at, canvas = key, np.full((min(band_rows, height - key[1] * band_rows), width, 4), start, np.int64)
                left, row, wide = small["left"][i], small["row"][i], small["wide"][i]
                part = samples[ends[i] : ends[i + 1]].astype(np.int64).reshape(-1, max(wide, 1), 4)[:, : max(0, width - left)]
                area = canvas[row : row + len(part), left : left + part.shape[1]]
                before = area.copy()
                area[...] = blended(rule, part, before, most) if small["over"][i] else part
                shown.append(canvas.reshape(-1).copy())
                if rule == "apng" and small["disposal"][i] != "none":
                    area[...] = 0 if small["disposal"][i] == "background" else before
                if len(shown) * canvas.size >= BATCH_SAMPLES:
                    yield packed(begun, shown)
                    begun, shown = i + 1, []
            if shown:
                yield packed(begun, shown)

    return run
