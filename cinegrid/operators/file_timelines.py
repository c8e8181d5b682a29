"""Timelines out of files: the pictures that PNG, GIF, WebP and ISO base media files state, as presentations, and their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.functions import planes
from cinegrid.functions import raster as R
from cinegrid.functions import walk
from cinegrid.operators import timeline as T
from cinegrid.operators.fixed import fixed

# The boxes that state a picture's rotation and mirror.
ITEM_BOXES = {"irot": "meta/iprp/ipco/irot", "imir": "meta/iprp/ipco/imir"}


def box_table(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, path, track, start, end of every box."""
    return files.select(key, F.explode(walk.boxes(F.col(content))).alias("b")).select(key, "b.*")


def first_boxes(files: DataFrame, key: str, paths: dict[str, str], content: str = "content") -> DataFrame:
    """key, track and, for each name of paths, what the first such box of the track (0: of no track) holds. Only these bytes leave
    the row that has the file."""
    return files.select(key, F.explode(walk.first_bodies(F.col(content), paths)).alias("b")).select(key, "b.*")


def clean_aperture(body: Column) -> Column:
    """width, height, x and y that a clap box states, as the whole pixels its fractions cover; null where it states none. A negative
    place is read as the start."""

    def read(d: Column) -> Column:
        signed = lambda at: F.when(walk.number(d, at, 4) >= T.long(1 << 31), walk.number(d, at, 4) - T.long(1 << 32)).otherwise(walk.number(d, at, 4))
        # fractions are cut off towards zero
        whole = lambda i: F.call_function("try_divide", signed(F.lit(i * 8)).cast("decimal(20,0)"), signed(F.lit(i * 8 + 4))).cast("bigint")
        field = F.struct(*[whole(i).alias(n) for i, n in enumerate(("width", "height", "x", "y"))])

        def judged(c: Column) -> Column:
            sound = (c["width"] > 0) & (c["height"] > 0) & c["x"].isNotNull() & c["y"].isNotNull()
            zero = T.long(0)
            return F.when(sound, F.struct(c["width"], c["height"], F.greatest(c["x"], zero).alias("x"), F.greatest(c["y"], zero).alias("y")))

        return R.bound(field, judged)

    return R.bound(body, read)


def coded_size(body: Column) -> Column:
    """width and height that an ispe box states."""
    size = lambda d: F.struct(walk.number(d, F.lit(4), 4).alias("width"), walk.number(d, F.lit(8), 4).alias("height"))
    return R.bound(R.bound(body, size), lambda s: F.when((s["width"] > 0) & (s["height"] > 0), s))


def apertures(files: DataFrame, key: str, content: str = "content", kept: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns kept, coded (width, height), crop (width, height, x, y) and refusal of ISO base media files: what a sequence shows of its coded
    pictures. The size is the primary item's; the aperture is that of the first picture track's first sample entry, else the primary
    item's, else the whole picture."""

    d = files.select(key, *kept, walk.aperture_boxes(F.col(content)).alias("b"))
    coded = coded_size(F.col("b.ispe"))
    stated = F.coalesce(clean_aperture(F.col("b.own")), clean_aperture(F.col("b.clap")))
    d = d.select(key, *kept, coded.alias("coded"), stated.alias("_stated"))
    zero, c = T.long(0), F.col("coded")
    whole = F.when(c.isNotNull(), F.struct(c["width"].alias("width"), c["height"].alias("height"), zero.alias("x"), zero.alias("y")))
    d = d.withColumn("crop", F.coalesce("_stated", whole)).drop("_stated")
    return d.withColumn("refusal", planes.aperture_refusal(F.col("crop"), F.col("coded")))


def stated_orientation(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and orientation code that the first rotation and mirror properties of an ISO base media file make."""
    b = first_boxes(files.select(key, content), key, ITEM_BOXES, content).where("track = 0")
    angle, axis = walk.number(F.col("irot"), F.lit(0), 1) % 4, walk.number(F.col("imir"), F.lit(0), 1) % 2
    return b.select(key, R.container_orientation(F.coalesce(angle, T.long(0)), axis).alias("orientation"))


def pictures(files: DataFrame, key: str, route: str = "route", content: str = "content", saved: bool = True) -> DataFrame:
    """key, animated, pos (from 1), duration, ticks (a second) and refusal of every file: what it states if it is an animation, else one
    still; before, idle, total and total_idle say what those before and all last, and how many of them have no time of their own.

    Files are read once, in their rows; what follows reads the saved runs of equal pictures. saved=False: what follows reads them in
    one place only, so they go on from their walk.
    """
    d = walk.timelines(files, key, route, content)
    d = (fixed(d) if saved else d).select("*", F.explode(F.sequence(T.long(0), F.col("count") - 1)).alias("_i"))
    pos, one = (F.col("pos") + F.col("_i")).cast("int"), F.col("duration")
    before, idle = F.col("before") + F.col("_i") * one, F.col("idle") + F.when(one > 0, 0).otherwise(F.col("_i"))
    return d.select(key, "animated", pos.alias("pos"), "duration", "ticks", "refusal", before.alias("before"), idle.alias("idle"), "total", "total_idle")


def sampled(stated: DataFrame, key: str, fps: tuple[int, int]) -> DataFrame:
    """key, presentation, duration, ticks, tick, until and count of pictures; a still is shown for one frame. Refused files are left
    out: see refusals. A picture knows what those before it last, so files meet no shuffle."""
    ticks, moving = F.col("ticks"), F.col("animated")
    d = stated.where("refusal is null").withColumn("_tick", T.delay_or_tick(F.lit(None).cast("bigint"), ticks, fps))
    d = d.withColumn("duration", F.when(moving, F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.col("_tick"))))
    before, total = F.col("before") + F.col("idle") * F.col("_tick"), F.col("total") + F.col("total_idle") * F.col("_tick")
    d = T.placed(d, before, total, ticks, fps)
    still = {"tick": 0, "until": 1, "count": 1}
    columns = [F.when(moving, F.col(c)).otherwise(T.long(v)).alias(c) for c, v in still.items()]
    return d.select(key, (F.col("pos") - 1).alias("presentation"), "duration", F.when(moving, ticks).alias("ticks"), *columns)


def refusals(stated: DataFrame, key: str) -> DataFrame:
    return stated.where("refusal is not null").select(key, "refusal").distinct()


def refused(files: DataFrame, key: str, route: str = "route", content: str = "content") -> DataFrame:
    """key and refusal of the files whose timeline is refused, in one pass over them: no picture is made."""
    return walk.refusals(files, key, route, content)


def clip(stated: DataFrame, key: str, fps: tuple[int, int]) -> DataFrame:
    """Every frame of the files in the order of key: n, key, local, presentation, hold (frames that show the presentation)."""
    s = sampled(stated, key, fps)
    starts = T.segment_starts(s.where("presentation = 0").select(key, "count"), key, "count").select(key, "start")
    held = T.holds(s, key).withColumn("hold", (F.col("sample_to") - F.col("sample_from")).cast("int"))
    # pictures meet their start, not each of their frames
    met = held.select(key, "presentation", "hold", "sample_from", "sample_to").join(starts, key)
    each = met.select(key, "presentation", "hold", "start", F.explode(F.sequence("sample_from", F.col("sample_to") - 1)).alias("local"))
    return each.select((F.col("start") + F.col("local")).alias("n"), key, "local", "presentation", "hold")
