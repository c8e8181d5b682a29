"""Homogeneity of a sequence: every segment is compared with its first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_mismatch(df: DataFrame, sequence: str, order: str, compared: list[str]) -> DataFrame:
    """For each sequence with a mismatch: the first offender's order, and its and the first segment's values.

    Two aggregations on the sequence key instead of a window, so no sequence is sorted.
    """
    values = F.struct(*compared)
    first = df.groupBy(sequence).agg(F.min_by(values, order).alias("first"))
    odd = df.select(sequence, order, values.alias("seen")).join(first, sequence).where(~F.col("seen").eqNullSafe(F.col("first")))
    return odd.groupBy(sequence).agg(F.min(order).alias(order), F.min_by("seen", order).alias("seen"), F.first("first").alias("first"))


def clip_info(df: DataFrame, sequence: str, order: str, compared: list[str]) -> DataFrame:
    """One row a sequence: variable, and the first segment's values (null where they vary)."""
    values = F.struct(*compared)
    info = df.groupBy(sequence).agg(F.min_by(values, order).alias("first"), (F.count_distinct(values) > 1).alias("variable"))
    return info.select(sequence, "variable", *[F.when(~F.col("variable"), F.col(f"first.{c}")).alias(c) for c in compared])


def refuse_mismatch(df: DataFrame, order: str, path: str, compared: list[str]) -> None:
    """Raises, naming both files, if any segment differs from the first."""
    one = first_mismatch(df.withColumn("_all", F.lit(1)).select("_all", order, *compared), "_all", order, compared).collect()
    if one:
        at = one[0]
        base = df.orderBy(order).select(path).first()[0]
        other = df.where(F.col(order) == at[order]).select(path).first()[0]
        raise ValueError(f"file {at[order]} ({other}) is {tuple(at['seen'])} but the first file ({base}) is {tuple(at['first'])}; pass mismatch=True to allow it")


def compatible_alpha(colour: Column, alpha: Column) -> Column:
    """Whether an alpha frame (struct format, width, height) fits a colour frame."""
    gray = alpha["format"].startswith("Gray")
    depth = F.regexp_extract(alpha["format"], "[0-9S]+$", 0)
    colour_depth = F.regexp_extract(colour["format"], "[0-9S]+$", 0)
    bits = F.when(colour["format"].startswith("RGB") & (colour_depth != "S"), (colour_depth.try_cast("int") / 3).cast("int").cast("string")).otherwise(colour_depth)
    return gray & (depth == bits) & (alpha["width"] == colour["width"]) & (alpha["height"] == colour["height"])


#: Rows of a clip's colour that one task joins with their alpha.
JOINED_ROWS = 1 << 19
MISFITS = ["it needs one gray plane", "samples of another type", "samples of another depth", "another size"]


def alpha_clip(colour: DataFrame, alpha: DataFrame, clip: str, n: str) -> DataFrame:
    """For each clip: its frames and those of its alpha clip, the first frame n that does not fit, and the refusal, null where all fit.

    Both sides have family, sample, bits, width and height. Frames meet by an outer equi-join on (clip, n), in as many parts as
    their number asks for, so that a task's share stays the same; what is wrong with each is reduced to the first offender by
    partial aggregation, as one number, so that nothing is sorted for it. A count that differs is refused before anything else.
    """
    names = ["family", "sample", "bits", "width", "height"]
    parts = max(colour.sparkSession.sparkContext.defaultParallelism, -(-colour.count() // JOINED_ROWS))
    c = colour.select(clip, n, F.struct(*names).alias("_c")).repartition(parts, clip, n)
    a = alpha.select(clip, n, F.struct(*names).alias("_a")).repartition(parts, clip, n)
    both = c.join(a, [clip, n], "full")
    c, a = F.col("_c"), F.col("_a")
    wrong = (
        F.when(c.isNull() | a.isNull(), None).when(a["family"] != "Gray", 0).when(a["sample"] != c["sample"], 1)
        .when((c["sample"] == "integer") & (a["bits"] != c["bits"]), 2).when((a["width"] != c["width"]) | (a["height"] != c["height"]), 3)
    )
    spot = F.col(n).cast("bigint") * len(MISFITS) + wrong
    d = both.groupBy(clip).agg(F.count("_c").alias("frames"), F.count("_a").alias("alpha_frames"), F.min(spot).alias("_first"))
    counts = F.col("frames") != F.col("alpha_frames")
    why = F.get(F.array(*map(F.lit, MISFITS)), F.pmod("_first", F.lit(len(MISFITS))).cast("int"))
    first = F.call_function("div", F.col("_first") - F.pmod("_first", F.lit(len(MISFITS))), F.lit(len(MISFITS))).cast(colour.schema[n].dataType)
    refusal = F.when(counts, F.concat("frames", F.lit(" frames beside "), "alpha_frames")).otherwise(why)
    return d.select(clip, "frames", "alpha_frames", F.when(~counts, first).alias("first"), refusal.alias("refusal"))


def refuse_alpha(colour: DataFrame, alpha: DataFrame, clip: str, n: str) -> None:
    """Raises, naming clip, frame and reason, if any alpha clip does not fit its colour clip."""
    one = alpha_clip(colour, alpha, clip, n).where("refusal is not null").orderBy(clip).limit(1).collect()
    if one:
        at = "" if one[0]["first"] is None else f" at frame {one[0]['first']}"
        raise ValueError(f"the alpha of clip {one[0][clip]} does not fit{at}: {one[0].refusal}")
