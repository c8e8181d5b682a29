"""Timelines read out of files that are put together from the driver's tables: an order is a file, its lines are its pictures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.operators import file_timelines as T
from cinegrid.plans.timeline_queries import POS_SQL, numbered_lines

FPS = (24, 1)


def hexed(value: Column, size: int, little: bool = False) -> Column:
    """The digits of the low `size` bytes of a number."""
    value = value.cast("bigint")
    if little:  # bytes change places as numbers, so that digits are made once
        value = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255).cast("bigint")), 8 * (size - 1 - i)) for i in range(size)])
    return F.substring(F.concat(F.lit("0" * 16), F.hex(value)), -2 * size, 2 * size)


def gathered(order: list[Column], **pieces: Column) -> Column:
    """A group's rows in that order; see joined."""
    fields = [c.alias(f"_{i}") for i, c in enumerate(order)] + [c.alias(n) for n, c in pieces.items()]
    return F.sort_array(F.collect_list(F.struct(*fields)))


def joined(rows: str, piece: str) -> Column:
    """One piece of gathered rows, one after the other."""
    return F.array_join(F.col(rows).getField(piece), "")


def chained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG, GIF and WebP files of order lines: some are stills, some promise a picture too many, some are cut off."""
    d = numbered_lines(spark, sf_dir)
    q, part = F.col("l_quantity").cast("long"), F.col("l_partkey")
    den = F.get(F.array(*map(F.lit, [0, 100, 30, 1000])), (part % 4).cast("int"))
    png = F.concat(
        F.lit("0000001A6663544C"), hexed(F.col("pos"), 4), F.lit("0000000100000001" + "00" * 8), hexed(q, 2), hexed(den, 2), F.lit("0000" + "EE" * 4),
        F.when(F.col("pos") == 1, F.lit("0000000249444154AABB")).otherwise(F.lit("000000066664415400000001AABB")), F.lit("DD" * 4),
    )
    gif = F.concat(F.lit("21F90400"), hexed(q % 20, 2, True), F.lit("0000"), F.when(part % 3 == 0, "21FE0341424300").otherwise(""), F.lit("2C0000000001000100"), F.when(part % 5 == 0, "81" + "10" * 12).otherwise("00"), F.lit("02024C0103AABBCC00"))
    webp = F.concat(F.lit("414E4D46"), hexed(F.lit(16) + part % 4, 4, True), F.lit("00" * 12), hexed(part % 500, 3, True), F.lit("02"), F.repeat(F.lit("AB"), (part % 4).cast("int")), F.when(part % 2 == 1, "00").otherwise(""))
    kind = F.col("l_orderkey") % 4
    piece = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, webp).otherwise("")
    d = d.groupBy("l_orderkey").agg(F.count("*").alias("n"), gathered([F.col("pos")], piece=piece).alias("rows"))
    d = d.select("l_orderkey", "n", joined("rows", "piece").alias("body"), kind.alias("kind"))
    head = F.lit("89504E470D0A1A0A0000000D49484452" + "00000001" * 2 + "0806000000" + "CC" * 4)
    promised = F.col("n") + F.when(F.col("l_orderkey") % 20 == 0, 1).otherwise(0)
    control = F.concat(F.lit("000000086163544C"), hexed(promised, 4), F.lit("00" * 4 + "CC" * 4))
    frames = F.concat(F.lit("565038580A00000002" + "00" * 9), F.lit("414E494D06000000" + "00" * 6), F.col("body"))
    text = (
        F.when(F.col("kind") == 0, F.concat(head, control, "body", F.lit("0000000049454E44AE426082")))
        .when(F.col("kind") == 1, F.concat(F.lit("4749463839610100010080" + "0000" + "11" * 6), "body", F.when(F.col("l_orderkey") % 20 == 1, "21FE05AA").otherwise("3B")))
        .when(F.col("kind") == 2, F.concat(F.lit("52494646"), hexed(F.length(frames) / 2 + 4, 4, True), F.lit("57454250"), frames))
        .otherwise(F.concat(head, F.lit("0000000249444154AABB" + "DD" * 4 + "0000000049454E44AE426082")))
    )
    route = F.get(F.array(*map(F.lit, ["png", "gif", "webp", "png"])), F.col("kind").cast("int"))
    return d.select("l_orderkey", route.alias("route"), F.unhex(text).alias("content"))


def file_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sampled(T.pictures(chained_files(spark, sf_dir), "l_orderkey", saved=False), "l_orderkey", FPS)


def file_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.refused(chained_files(spark, sf_dir), "l_orderkey")


def file_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of all files, one after the other."""
    return T.clip(T.pictures(chained_files(spark, sf_dir), "l_orderkey"), "l_orderkey", FPS)


#: Hexadecimal digits and how many bytes they are; sizes are added up, so that no text is made twice.
Piece = tuple[Column, Column | int]


def plain(digits: str) -> Piece:
    return F.lit(digits), len(digits) // 2


def figure(value: Column, size: int) -> Piece:
    return hexed(value, size), size


def whole(*pieces: Piece) -> Piece:
    fixed, open_ended = sum(n for _, n in pieces if isinstance(n, int)), [n for _, n in pieces if not isinstance(n, int)]
    return F.concat(*[t for t, _ in pieces]), sum(open_ended, F.lit(fixed)) if open_ended else fixed


def where(condition: Column, piece: Piece, other: Piece | None = None) -> Piece:
    other = other or plain("")
    a, b = piece[1], other[1]
    size = a if isinstance(a, int) and isinstance(b, int) and a == b else F.when(condition, a).otherwise(b)
    return F.when(condition, piece[0]).otherwise(other[0]), size


def box(kind: str, *inside: Piece) -> Piece:
    body, size = whole(*inside)
    digits = F.lit(f"{size + 8:08X}") if isinstance(size, int) else hexed(size + 8, 4)
    return F.concat(digits, F.lit(kind.encode().hex().upper()), body), size + 8


def boxed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVIF and HEIF files of order lines: runs of samples, some with composition offsets, an edit list or an auxiliary track before
    the picture track; boxes with 64-bit sizes; a rotation and a mirror."""
    d = numbered_lines(spark, sf_dir)
    q, part, key = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_orderkey")
    run = F.concat(hexed(q % 3 + 1, 4), hexed(part % 90 + 10, 4))
    shift = F.when(key % 2 == 0, F.concat(hexed(q % 2 + 1, 4), hexed(part % 5, 4))).otherwise("")
    d = d.groupBy("l_orderkey").agg(F.count("*").alias("n"), gathered([F.col("pos")], run=run, shift=shift).alias("rows"))
    d = d.select("l_orderkey", "n", joined("rows", "run").alias("runs"), joined("rows", "shift").alias("shifts"))
    full, ticks = plain("00000000"), key % 3 * 500 + 100
    count, each = figure(F.col("n"), 4), F.col("n") * 8
    old = box("mdhd", full, plain("00" * 8), figure(ticks, 4), plain("00" * 8))
    new = box("mdhd", plain("01000000" + "00" * 16), figure(ticks, 4), plain("00" * 12))
    offsets = where(key % 2 == 0, box("ctts", full, count, (F.col("shifts"), each)))
    tables = box("minf", box("stbl", box("stsd", full, plain("00000001"), box("av01", plain("00" * 8))), box("stts", full, count, (F.col("runs"), each)), offsets))
    handler = lambda kind: box("hdlr", plain("00" * 8 + kind.encode().hex() + "00" * 12))
    two = box("edts", box("elst", full, plain("00000002" + "00000064FFFFFFFF00010000"), figure(key % 200 + 1, 4), plain("0000000000010000")))
    edit = where(key % 5 == 0, two, where(key % 5 == 1, box("edts", box("elst", plain("01000000" + "00000001"), figure(key % 300 + 1, 8), figure(key % 15 % 2, 8), plain("00010000")))))
    movie = box("trak", edit, box("mdia", where(key % 2 == 0, old, new), handler("pict"), tables))
    aux = where(key % 4 == 0, box("trak", box("mdia", old, handler("auxv"), tables)))
    turned = box("meta", full, box("iprp", box("ipco", box("ispe", plain("00" * 12)), where(key % 3 > 0, box("irot", figure(key % 7 % 4, 1))), where(key % 6 > 1, box("imir", figure(key % 2, 1))))))
    data = where(key % 3 == 0, plain("000000016D646174" + "00" * 7 + "14" + "AA" * 4), plain("0000000C6D646174AABBCCDD"))
    text, _ = whole(box("ftyp", plain("6176697300000000")), data, turned, box("moov", box("mvhd", full), aux, movie), where(key % 2 == 0, plain("000000006D646174EEEEEE"), plain("0000")))
    return d.select("l_orderkey", F.when(key % 2 == 0, "avif").otherwise("heif").alias("route"), F.unhex(text).alias("content"))


def sequence_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sampled(T.pictures(boxed_files(spark, sf_dir), "l_orderkey", saved=False), "l_orderkey", FPS)


def sequence_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.refused(boxed_files(spark, sf_dir), "l_orderkey")


def sequence_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stated_orientation(boxed_files(spark, sf_dir), "l_orderkey")


QUERIES = {
    "file_timelines": file_timelines, "file_refusals": file_refusals, "file_clip": file_clip, "sequence_timelines": sequence_timelines,
    "sequence_refusals": sequence_refusals, "sequence_orientation": sequence_orientation,
}

#: From (l_orderkey, pos, duration, ticks): the frames of each at FPS; an order of which nothing is in it is a still.
SAMPLED = """
u AS (SELECT l_orderkey, pos, ticks, CASE WHEN duration > 0 THEN duration ELSE greatest(1, (ticks + 23) // 24) END AS duration FROM p),
c AS (SELECT *, CAST(sum(duration) OVER (PARTITION BY l_orderkey ORDER BY pos) AS BIGINT) AS upto, CAST(sum(duration) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM u),
s AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) - 1 AS INTEGER) AS presentation, duration, ticks, ((upto - duration) * 24 + ticks - 1) // ticks AS tick,
  (upto * 24 + ticks - 1) // ticks AS until, greatest(1, (total * 24 + ticks - 1) // ticks) AS count FROM c)"""
CHAINED_CTE = f"""
l AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 4 AS kind, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT *, {POS_SQL} AS pos FROM lineitem)),
x AS (SELECT l_orderkey, pos, kind, n, q, l_partkey, [100, 100, 30, 1000][l_partkey % 4 + 1] AS den FROM l WHERE l_orderkey % 20 > 1 AND kind < 3 AND (kind <> 1 OR n > 1)),
b AS (SELECT l_orderkey, list_reduce(list_distinct(list(den)), lambda a, b: lcm(a, b)) AS base FROM x GROUP BY l_orderkey),
p AS (SELECT l_orderkey, pos, CASE kind WHEN 0 THEN base ELSE 1000000 END AS ticks, CASE kind WHEN 0 THEN q * base // den WHEN 1 THEN q % 20 * 10000 ELSE l_partkey % 500 * 1000 END AS duration FROM x JOIN b USING (l_orderkey)),
{SAMPLED},
a AS (SELECT * FROM s UNION ALL SELECT DISTINCT l_orderkey, CAST(0 AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0, 1, 1 FROM l WHERE (l_orderkey % 20 > 1) AND (kind = 3 OR kind = 1 AND n = 1))"""
BOXED_CTE = f"""
l AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM (SELECT *, {POS_SQL} AS pos FROM lineitem)),
m AS (SELECT l_orderkey, pos, k, l_partkey % 90 + 10 AS delta FROM l, LATERAL (SELECT unnest(range(q % 3 + 1)) AS k)),
r AS (SELECT l_orderkey, delta, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, k) AS i, count(*) OVER (PARTITION BY l_orderkey) AS samples FROM m),
o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, k) AS i, l_partkey % 5 AS moved FROM l, LATERAL (SELECT unnest(range(q % 2 + 1)) AS k) WHERE l_orderkey % 2 = 0),
w AS (SELECT l_orderkey, r.i, delta, CAST(sum(delta) OVER (PARTITION BY l_orderkey) AS BIGINT) AS media, CAST(sum(delta) OVER (PARTITION BY l_orderkey ORDER BY r.i) - delta AS BIGINT) + coalesce(moved, 0) AS instant
  FROM r LEFT JOIN o USING (l_orderkey, i) WHERE samples > 1 AND NOT (l_orderkey % 5 = 1 AND l_orderkey % 15 % 2 = 1)),
z AS (SELECT *, least(media, CASE l_orderkey % 5 WHEN 0 THEN l_orderkey % 200 + 1 WHEN 1 THEN l_orderkey % 300 + 1 END) AS shown, coalesce(lead(instant) OVER (PARTITION BY l_orderkey ORDER BY i), media) AS next FROM w),
p AS (SELECT l_orderkey, i AS pos, l_orderkey % 3 * 500 + 100 AS ticks, least(next, shown) - instant AS duration FROM z WHERE instant < shown),
{SAMPLED},
a AS (SELECT * FROM s UNION ALL SELECT DISTINCT l_orderkey, CAST(0 AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0, 1, 1 FROM r WHERE samples = 1)"""
ORACLE = {
    "file_timelines": f"WITH {CHAINED_CTE} SELECT l_orderkey, presentation, duration, ticks, least(count, tick) AS tick, least(count, until) AS until, count FROM a",
    "file_clip": f"""WITH {CHAINED_CTE},
t AS (SELECT l_orderkey, count, sum(count) OVER (ORDER BY l_orderkey) - count AS start FROM (SELECT l_orderkey, max(count) AS count FROM a GROUP BY l_orderkey))
SELECT CAST(start + local AS BIGINT) AS n, l_orderkey, local, presentation, hold FROM
  (SELECT l_orderkey, presentation, CAST(until - tick AS INTEGER) AS hold, unnest(range(tick, until)) AS local FROM a WHERE tick < until) JOIN t USING (l_orderkey)""",
    "file_refusals": f"""
SELECT l_orderkey, 'it ends after ' || count(*) || ' of ' || (count(*) + 1) || ' pictures' AS refusal FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey
UNION ALL SELECT DISTINCT l_orderkey, 'it ends within a block' FROM lineitem WHERE l_orderkey % 20 = 1""",
    "sequence_timelines": f"WITH {BOXED_CTE} SELECT l_orderkey, presentation, duration, ticks, least(count, tick) AS tick, least(count, until) AS until, count FROM a",
    "sequence_refusals": f"""
WITH {BOXED_CTE}
SELECT l_orderkey, 'it shows no picture' AS refusal FROM z GROUP BY l_orderkey HAVING min(instant) >= min(shown)
UNION ALL SELECT l_orderkey, 'starts within its media' AS refusal FROM lineitem WHERE l_orderkey % 5 = 1 AND l_orderkey % 15 % 2 = 1
GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS BIGINT) % 3 + 1) > 1""",
    "sequence_orientation": """
SELECT DISTINCT l_orderkey, CASE WHEN mirror IS NULL THEN [1, 8, 3, 6][angle + 1] WHEN mirror = 0 THEN [4, 5, 2, 7][angle + 1] ELSE [2, 7, 4, 5][angle + 1] END AS orientation
FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 7 % 4 ELSE 0 END AS angle, CASE WHEN l_orderkey % 6 > 1 THEN l_orderkey % 2 END AS mirror FROM lineitem)
WHERE l_orderkey % 3 > 0 OR l_orderkey % 6 > 1""",
}
