"""Timeline operators: presentations with durations become frames at a rational output rate.

A presentation row has a segment key, a position within the segment and a duration in units of 1 / rate seconds.
All arithmetic is on BIGINT; with ANSI mode on an overflow raises.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.functions.walk import MOST_SAMPLES, TIMEBASE_LIMIT
from cinegrid.operators.fixed import fixed
from cinegrid.operators.segments import scanned


def reduce_fps(num: int, den: int) -> tuple[int, int]:
    """The output rate in lowest terms."""
    if num <= 0 or den <= 0:
        raise ValueError("fpsnum and fpsden must be positive")
    g = gcd(num, den)
    return num // g, den // g


def scale(rate: tuple[int, int], fps: tuple[int, int]) -> tuple[int, int]:
    """(mul, div): a span of d units lasts d * mul / div output frames."""
    if min(*rate, *fps) <= 0:
        raise ValueError("invalid rate")
    mul, div = rate[1] * fps[0], rate[0] * fps[1]
    g = gcd(mul, div)
    return mul // g, div // g


def long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, long(b) if isinstance(b, int) else b)


def ceil_scaled(units: Column, mul: int, div: int) -> Column:
    """ceil(units * mul / div) for units >= 0."""
    return int_div(units * long(mul) + long(div - 1), div)


def delay_or_tick(duration: Column, rate: tuple[int, int] | Column, fps: tuple[int, int]) -> Column:
    """A missing or non-positive duration lasts one output frame, rounded up to whole units. rate: or the units a second."""
    if isinstance(rate, Column):
        return F.when(duration > 0, duration).otherwise(F.greatest(long(1), int_div(rate * long(fps[1]) + long(fps[0] - 1), fps[0])))
    mul, div = scale(rate, fps)
    tick = max(1, -(-div // mul))
    return F.when(duration > 0, duration).otherwise(long(tick))


def ceil_frames(units: Column, rate: tuple[int, int] | Column, fps: tuple[int, int]) -> Column:
    """Output frames that units last, rounded up; where each row has its own rate, over 128 bits."""
    if not isinstance(rate, Column):
        return ceil_scaled(units, *scale(rate, fps))
    wide = units.cast("decimal(20,0)") * F.lit(fps[0]).cast("decimal(10,0)")
    div = rate.cast("decimal(10,0)") * F.lit(fps[1]).cast("decimal(10,0)")
    far = F.call_function("div", wide + div - F.lit(1).cast("decimal(1,0)"), div).cast("bigint")
    # a rate has ten digits at most; what is surely within 64 bits needs no decimals, which take far longer
    near = ((1 << 63) - 1 - 10**10 * fps[1]) // fps[0]
    if near <= 0:
        return far
    return F.when(units <= long(near), int_div(units * long(fps[0]) + rate * long(fps[1]) - long(1), rate * long(fps[1]))).otherwise(far)


def samples(df: DataFrame, segment: str, order: str, duration: str, rate: tuple[int, int] | str, fps: tuple[int, int]) -> DataFrame:
    """Adds to each presentation: presentation (0-based), duration (substituted), tick, until and count (of its segment).

    tick_i = min(count, ceil(sum of the durations before i, scaled)); until is the tick of the next one, or the count; count =
    max(1, ceil(sum of all, scaled)). rate: one of all rows, or the column of each segment's units a second. The sums run in
    blocks, so that a long segment is no task's own.
    """
    of = F.col(rate) if isinstance(rate, str) else rate
    d = df.withColumn("duration", delay_or_tick(F.col(duration), of, fps))
    d = scanned(d, segment, order, {"presentation": F.lit(1), "_before": F.col("duration")})
    d = placed(d, F.col("_before"), F.col("_before_total"), of, fps)
    return d.withColumn("presentation", F.col("presentation").cast("int")).drop("presentation_total", "_before", "_before_total")


def placed(df: DataFrame, before: Column, total: Column, rate: tuple[int, int] | Column, fps: tuple[int, int]) -> DataFrame:
    """Adds count, tick and until to presentations of which it is known how long those before them, and all, last."""
    d = df.withColumn("count", F.greatest(long(1), ceil_frames(total, rate, fps)))
    d = d.withColumn("tick", F.least(F.col("count"), ceil_frames(before, rate, fps)))
    return d.withColumn("until", F.least(F.col("count"), ceil_frames(before + F.col("duration"), rate, fps)))


def holds(sampled: DataFrame, segment: str) -> DataFrame:
    """The frames [sample_from, sample_to) that show each presentation; those shorter than a tick vanish."""
    return sampled.withColumn("sample_from", F.col("tick")).withColumn("sample_to", F.col("until")).where("sample_from < sample_to")


def frames(held: DataFrame, segment: str) -> DataFrame:
    """One row for each output frame of each segment; linear in the output, no range join."""
    n = F.explode(F.sequence("sample_from", F.col("sample_to") - 1))
    return held.select(segment, n.alias("local"), "presentation")


def segment_starts(df: DataFrame, order: str, count: str) -> DataFrame:
    """Adds start, the number of frames in all segments before.

    Counts are summed within ranges of the order key first, so only one row a range meets in the last, small window.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled, so rows are dealt out once and keep their part
    ranged = fixed(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum(count).over(within), long(0)))
    totals = ranged.groupBy("_part").agg(F.sum(count).alias("_total"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), long(0)))
    out = local.join(F.broadcast(base.select("_part", "_base")), "_part")  # one row a partition
    start = F.col("_base") + F.col("_before")
    most = F.when(start + F.col(count) > long(MOST_FRAMES), F.raise_error(F.lit("the clip has too many frames"))).otherwise(start)
    return out.withColumn("start", most.cast("bigint")).drop("_part", "_base", "_before", "_total")


#: Frame numbers are 32-bit integers.
MOST_FRAMES = (1 << 31) - 1
BUCKET = 4096


def resolve(asked: DataFrame, segments: DataFrame, n: str, segment: str, missing: str = "error") -> DataFrame:
    """The segment and local frame of each asked frame number, by an equi-join on buckets of BUCKET frames.

    A number that no segment holds is an error, or (missing="drop") has no row.
    """
    last = F.col("start") + F.col("count") - 1
    spread = segments.withColumn("_b", F.explode(F.sequence(int_div(F.col("start"), BUCKET), int_div(last, BUCKET)))).withColumn("_last", last)
    keyed = asked.withColumn("_b", int_div(F.col(n).cast("bigint"), BUCKET))
    inside = (keyed["_b"] == spread["_b"]) & (F.col(n) >= F.col("start")) & (F.col(n) <= F.col("_last"))
    met = keyed.join(spread, inside, "inner" if missing == "drop" else "left").drop(keyed["_b"]).drop("_b", "_last")
    local = F.col(n) - F.col("start")
    if missing != "drop":
        local = F.when(F.col("start").isNull(), F.raise_error(F.concat(F.lit("requested a frame that the clip has not: "), F.col(n).cast("string")))).otherwise(local).cast("bigint")
    return met.withColumn("local", local)


def gif_delay(centiseconds: Column) -> Column:
    return centiseconds.cast("bigint") * long(10_000)


def webp_delay(milliseconds: Column) -> Column:
    return milliseconds.cast("bigint") * long(1_000)


def common_multiple(a: Column, b: Column) -> Column:
    """The least common multiple of two positive numbers, b below 2^16, by Euclid's steps (24 are enough for such a b)."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(26)), F.struct(a.alias("x"), b.alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))),
    )
    return int_div(a, step["x"]) * b


def apng_delays(df: DataFrame, animation: str, num: str, den: str) -> DataFrame:
    """Adds ticks and duration: each animation's num / den delays on their lowest common denominator, so that nothing drifts; on
    milliseconds, rounded down, where that has more than TIMEBASE_LIMIT ticks a second. A denominator of 0 means hundredths."""
    hundredths = F.when(F.col(den) == 0, 100).otherwise(F.col(den)).cast("bigint")
    dens = df.groupBy(animation).agg(F.array_sort(F.collect_set(hundredths)).alias("_dens"))  # 16-bit numbers
    base = F.aggregate("_dens", long(1), lambda t, d: F.when(t > TIMEBASE_LIMIT, t).otherwise(common_multiple(t, d)))
    bases = dens.select(animation, base.alias("_base"))
    exact = F.col(num).cast("bigint") * int_div(F.col("_base"), hundredths)
    d = df.join(bases, animation)
    fits = F.col("_base") <= TIMEBASE_LIMIT
    duration = F.when(fits, exact).otherwise(int_div(F.col(num).cast("bigint") * long(1000), hundredths))
    return d.withColumn("ticks", F.when(fits, F.col("_base")).otherwise(long(1000))).withColumn("duration", duration).drop("_base")


def composed(df: DataFrame, track: str, order: str, duration: str, offset: str, shown: str | None = None) -> DataFrame:
    """Presentation instants of coded pictures: decode time plus offset, never negative; a picture lasts until the next one.

    Instants that go back are refused. The track ends with its last decode time, or before that at `shown`, a column that is
    null where nothing cuts it: pictures from there on are not shown, and the one it falls into lasts until then.
    """
    w = W.partitionBy(track).orderBy(order)
    dts = F.coalesce(F.sum(duration).over(w.rowsBetween(W.unboundedPreceding, -1)), long(0))
    end = F.sum(duration).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = df.withColumn("_end", end).withColumn("instant", F.greatest(long(0), dts + F.col(offset)))
    d = d.withColumn("_shown", F.least("_end", shown) if shown else F.col("_end"))
    back = F.lag("instant").over(w) > F.col("instant")
    d = d.withColumn("_back", F.coalesce(back, F.lit(False))).withColumn("_next", F.coalesce(F.lead("instant").over(w), F.col("_end")))
    d = d.withColumn("instant", F.when(F.col("_back"), F.raise_error(F.lit("composition goes back in time"))).otherwise(F.col("instant")).cast("bigint"))
    d = d.where(F.col("instant") < F.col("_shown"))
    return d.select(track, order, "instant", (F.least("_next", "_shown") - F.col("instant")).alias("duration"))


def capped(df: DataFrame, track: str, order: str, duration: str, shown: str) -> DataFrame:
    """A timeline that ends after `shown` units: later pictures go, the last one is cut."""
    w = W.partitionBy(track).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_from", F.coalesce(F.sum(duration).over(w), long(0))).where(F.col("_from") < F.col(shown))
    return d.withColumn(duration, F.least(F.col(duration), F.col(shown) - F.col("_from"))).drop("_from")


def clip_frames(df: DataFrame, segment: str, order: str, duration: str, rate: tuple[int, int], fps: tuple[int, int]) -> DataFrame:
    """Every frame of the concatenation of all segments, in the order of their keys: n, segment, local and presentation."""
    sampled = samples(df, segment, order, duration, rate, fps)
    starts = segment_starts(sampled.groupBy(segment).agg(F.max("count").alias("count")), segment, "count")
    each = frames(holds(sampled, segment), segment).join(starts.select(segment, "start"), segment)
    return each.select((F.col("start") + F.col("local")).alias("n"), segment, "local", "presentation")


def composition_offset(version: Column, raw: Column) -> Column:
    """A composition offset from its unsigned 32 bits: signed in version 1 of the table."""
    return F.when((version == 1) & (raw >= long(1 << 31)), raw - long(1 << 32)).otherwise(raw)


def expand_runs(runs: DataFrame, track: str, order: str, count: str, value: str) -> DataFrame:
    """track, sample (from 0) and value of every sample of run-length tables. A track with an empty run, or with more than
    MOST_SAMPLES samples, states no timeline: it has no rows. Only runs are sorted, never samples."""
    whole = W.partitionBy(track)
    before = F.coalesce(F.sum(count).over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), long(0))
    sound = (F.min(count).over(whole) > 0) & (F.sum(count).over(whole) <= MOST_SAMPLES)
    d = runs.withColumn("_before", before).withColumn("_sound", sound).where("_sound")
    return d.select(track, F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col(count) - 1)).alias("sample"), value)


def edit_list(edits: DataFrame, track: str, order: str, duration: str, media_time: str) -> DataFrame:
    """track, shown (where its media ends, null for all of it) and refusal (null where the list can be played).

    Empty edits (a negative media time) only delay. One edit from the media's start may cut its end; a list that skips the
    start or edits the media more than once is refused.
    """
    real = F.when(F.col(media_time) >= 0, F.struct(order, F.col(media_time).alias("m"), F.col(duration).alias("d")))
    d = edits.groupBy(track).agg(F.min(real).alias("first"), F.count(real).alias("edits"))
    refusal = F.when(F.col("first.m") > 0, "starts within its media").when(F.col("edits") > 1, "edits its media more than once")
    return d.select(track, F.when(refusal.isNull() & (F.col("first.d") > 0), F.col("first.d")).alias("shown"), refusal.alias("refusal"))
