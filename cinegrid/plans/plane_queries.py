"""Planes cut out of larger buffers: the bytes of documents are decoders' buffers, orders are files that state an aperture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions import planes as P
from cinegrid.operators import file_timelines as T
from cinegrid.plans.file_queries import box, figure, plain, where, whole


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as three planes end to end: rows padded by up to three bytes, or a byte too close together, planes
    up to two bytes apart, so that some lie beyond the buffer; the layout follows from the id."""
    i = F.col("doc_id").cast("bigint")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("buffer"))
    d = d.select("*", (i % 2 + 1).alias("size"), (i % 13 + 1).alias("width"), (i % 2).alias("across"), (i % 3 % 2).alias("down"), (i % 8 + 1).cast("int").alias("code"))
    d = d.withColumn("stride", F.greatest(F.col("width") * F.col("size") + F.when(i % 17 == 0, -1).otherwise(i % 4), F.lit(1)))
    d = d.withColumn("height", F.floor(F.length("buffer") / (F.col("stride") * 3)).cast("bigint"))
    return d.withColumn("apart", F.col("stride") * F.col("height") + i % 3)


def frame_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planes of every buffer as its orientation shows them, packed, or why there is none."""
    d = buffers(spark, sf_dir).withColumn("plane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    c = {n: F.col(n) for n in d.columns}
    stored = P.plane_size(c["plane"], c["width"], c["height"], c["across"], c["down"], up=True)
    d = d.withColumns({"wide": stored[0], "high": stored[1]})
    shown = P.R.output_size(c["code"], c["width"], c["height"])
    turn = P.R.transform_flag(c["code"], 0)
    frame = P.plane_size(c["plane"], *shown, c["across"], c["down"], up=False)
    d = d.withColumns({"frame_width": frame[0], "frame_height": frame[1], "first": c["plane"] * c["apart"], "turn": turn})
    frame = F.col("frame_width"), F.col("frame_height")
    refusal = F.coalesce(
        P.strided_refusal(F.length("buffer").cast("bigint"), c["plane"], F.col("first"), c["stride"], F.col("wide") * c["size"], F.col("high")),
        P.filling_refusal(c["plane"], c["code"], (F.col("wide"), F.col("high")), frame),
    )
    packed = P.turned(c["buffer"], F.col("first"), c["stride"], c["size"], c["code"], frame)
    return d.withColumn("refusal", refusal).select("doc_id", "plane", *frame, F.when(F.col("refusal").isNull(), F.md5(packed)).alias("packed"), "refusal")


def packed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first plane of every buffer without the padding of its rows; the last row needs none."""
    d = buffers(spark, sf_dir)
    row, rows = F.col("width") * F.col("size"), F.floor((F.length("buffer") + F.col("doc_id") % 4) / F.col("stride")).cast("bigint")
    d = d.withColumns({"row": row, "rows": rows, "plane": F.lit(0)})
    refusal = P.strided_refusal(F.length("buffer").cast("bigint"), F.col("plane"), F.lit(0).cast("bigint"), F.col("stride"), F.col("row"), F.col("rows"), whole=False)
    packed = P.window(F.col("buffer"), F.lit(0), F.col("stride"), F.col("row"), F.col("rows"))
    return d.withColumn("refusal", refusal).select("doc_id", "rows", F.when(F.col("refusal").isNull(), F.md5(packed)).alias("packed"), "refusal")


def aperture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders whose first or second item is the primary one; its aperture is a box of its own, of the sample entry, or
    missing, and some reach beyond the coded picture or have no denominator."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    full = plain("00000000")
    fraction = lambda n, d: whole(figure(n, 4), figure(d, 4))
    offset = cents % 5 - 1
    signed = where(offset < 0, plain("FFFFFFFF"), figure(offset, 4))
    clap = lambda shift: box("clap", fraction((cents % 9 + 4 + shift) * 2 + 1, F.lit(2)), fraction(F.lit(6), F.when(key % 11 == 0, 0).otherwise(cents % 3 + 1)), signed, plain("00000001"), fraction(cents % 7, F.lit(3)))
    ispe = box("ispe", full, figure(key % 5 + 10, 4), figure(key % 3 + 4, 4))
    small = box("ispe", full, plain("0000000100000001"))
    even, wide = key % 2 == 0, key % 3 == 0
    pitm = where(even, box("pitm", full, plain("0001")), box("pitm", plain("01000000"), plain("00010002")))
    listed = lambda *numbers: where(wide, plain("".join(f"80{n:02X}" for n in numbers)), plain("".join(f"{n:02X}" for n in numbers)))
    ident = where(even, plain("0001"), plain("00010002"))
    other = where(even, plain("0007"), plain("00000007"))
    mine = where(key % 7 == 0, whole(plain("01"), listed(2)), where(key % 13 == 0, whole(plain("01"), listed(9)), whole(plain("02"), listed(2, 3))))
    ipma = box("ipma", where(even, plain("0000"), plain("0100")), plain("00"), where(wide, plain("01"), plain("00")), plain("00000002"), other, plain("01"), listed(1), ident, mine)
    meta = box("meta", full, pitm, box("iprp", box("ipco", small, ispe, clap(F.lit(0))), ipma))
    entry = box("av01", plain("00" * 78), box("av1C", plain("81000000")), where(key % 5 == 0, clap(F.lit(-3))))
    movie = box("moov", box("trak", box("mdia", box("hdlr", plain("00" * 8 + b"pict".hex() + "00" * 12)), box("minf", box("stbl", box("stsd", full, plain("00000001"), entry))))))
    content, _ = whole(box("ftyp", plain("6176697300000000")), meta, movie)
    plane = F.unhex(F.repeat(F.sha2(key.cast("string"), 256), 3))
    return d.select("o_orderkey", F.unhex(content).alias("content"), plane.alias("plane"))


def aperture_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file shows of its coded pictures, and one plane cut to it."""
    d = T.apertures(aperture_files(spark, sf_dir), "o_orderkey", kept=("plane",))
    coded, crop = F.col("coded"), F.col("crop")
    whole = P.cut(F.col("plane"), F.lit(0), coded["width"] * coded["height"])
    shown = F.when(F.col("refusal").isNull(), F.hex(P.cropped(whole, F.lit(1), crop, coded)))
    return d.select("o_orderkey", "crop.width", "crop.height", "crop.x", "crop.y", "refusal", shown.alias("shown"))


QUERIES = {"frame_planes": frame_planes, "packed_planes": packed_planes, "aperture_crop": aperture_crop}

BUFFERS = """
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT *, length(h) // 2 AS n, doc_id % 2 + 1 AS size, doc_id % 13 + 1 AS width, doc_id % 2 AS across, doc_id % 3 % 2 AS down FROM d),
f AS (SELECT *, greatest(width * size + CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id % 4 END, 1) AS stride FROM e),
b AS (SELECT *, n // (stride * 3) AS height, stride * (n // (stride * 3)) + doc_id % 3 AS apart FROM f),
y AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS v, unnest(range(n)) AS i FROM b)"""
ORACLE = {
    "frame_planes": f"""
WITH {BUFFERS},
p AS (SELECT *, plane * apart AS first, CASE WHEN plane > 0 AND across = 1 THEN (width + 1) // 2 ELSE width END AS wide, CASE WHEN plane > 0 AND down = 1 THEN (height + 1) // 2 ELSE height END AS high,
  doc_id % 8 + 1 AS code, doc_id % 8 + 1 > 4 AS turn FROM b, (SELECT unnest([0, 1, 2]) AS plane)),
q AS (SELECT *, CASE WHEN turn THEN height ELSE width END AS ow, CASE WHEN turn THEN width ELSE height END AS oh FROM p),
r AS (SELECT *, CASE WHEN plane > 0 AND across = 1 THEN ow // 2 ELSE ow END AS fw, CASE WHEN plane > 0 AND down = 1 THEN oh // 2 ELSE oh END AS fh FROM q),
s AS (SELECT *, CASE WHEN stride < wide * size THEN 'plane ' || plane || ' has rows of ' || wide * size || ' bytes, ' || stride || ' bytes apart'
  WHEN first + stride * high > n THEN 'plane ' || plane || ' needs ' || stride * high || ' bytes from ' || first || ' on, of ' || n
  WHEN CASE WHEN turn THEN high ELSE wide END < fw OR CASE WHEN turn THEN wide ELSE high END < fh THEN
    'plane ' || plane || ' is ' || CASE WHEN turn THEN high ELSE wide END || 'x' || CASE WHEN turn THEN wide ELSE high END || ', not ' || fw || 'x' || fh END AS refusal FROM r),
t AS (SELECT *, unnest(range(fw * fh * size)) AS j FROM s WHERE refusal IS NULL),
u AS (SELECT *, j // size % fw AS x, j // size // fw AS z, j % size AS k FROM t),
v AS (SELECT *, CASE WHEN code IN (2, 3, 6, 7) THEN fw - 1 - x ELSE x END AS fx, CASE WHEN code IN (3, 4, 7, 8) THEN fh - 1 - z ELSE z END AS fz FROM u),
w AS (SELECT v.doc_id, plane, md5(unhex(string_agg(y.v, '' ORDER BY j))) AS packed
  FROM v JOIN y ON y.doc_id = v.doc_id AND y.i = first + CASE WHEN turn THEN fx ELSE fz END * stride + CASE WHEN turn THEN fz ELSE fx END * size + k GROUP BY ALL)
SELECT doc_id, plane, fw AS frame_width, fh AS frame_height, CASE WHEN refusal IS NULL THEN coalesce(packed, md5('')) END AS packed, refusal FROM s LEFT JOIN w USING (doc_id, plane)""",
    "packed_planes": f"""
WITH {BUFFERS},
p AS (SELECT *, width * size AS row, (n + doc_id % 4) // stride AS rows FROM b),
q AS (SELECT *, CASE WHEN rows > 0 THEN stride * (rows - 1) + row ELSE 0 END AS needed FROM p),
r AS (SELECT *, CASE WHEN stride < row THEN 'plane 0 has rows of ' || row || ' bytes, ' || stride || ' bytes apart' WHEN needed > n THEN 'plane 0 needs ' || needed || ' bytes from 0 on, of ' || n END AS refusal FROM q),
w AS (SELECT r.doc_id, md5(unhex(string_agg(y.v, '' ORDER BY i))) AS packed FROM r JOIN y ON y.doc_id = r.doc_id AND i // stride < rows AND i % stride < row WHERE refusal IS NULL GROUP BY ALL)
SELECT doc_id, rows, CASE WHEN refusal IS NULL THEN coalesce(packed, md5('')) END AS packed, refusal FROM r LEFT JOIN w USING (doc_id)""",
    "aperture_crop": """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_orderkey % 13 <> 0 OR o_orderkey % 7 = 0 THEN o_orderkey % 5 + 10 END AS cw, o_orderkey % 3 + 4 AS ch FROM orders),
c AS (SELECT *, o_orderkey % 11 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0 AND cw IS NOT NULL) AS has, 6 // (cents % 3 + 1) AS tall FROM o),
d AS (SELECT *, CASE WHEN has THEN cents % 9 + 4 - CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END WHEN cw IS NOT NULL THEN cw END AS width, CASE WHEN has THEN tall WHEN cw IS NOT NULL THEN ch END AS height,
  CASE WHEN has THEN greatest(0, cents % 5 - 1) WHEN cw IS NOT NULL THEN 0 END AS x, CASE WHEN has THEN cents % 7 // 3 WHEN cw IS NOT NULL THEN 0 END AS y FROM c),
e AS (SELECT *, CASE WHEN cw IS NULL THEN 'it states no size of its coded pictures' WHEN x + width > cw OR y + height > ch THEN
  'it presents ' || width || 'x' || height || ' at ' || x || ',' || y || ' of ' || cw || 'x' || ch END AS refusal, upper(repeat(sha256(CAST(o_orderkey AS VARCHAR)), 3)) AS plane FROM d)
SELECT o_orderkey, width, height, x, y, refusal,
  CASE WHEN refusal IS NULL THEN array_to_string(list_transform(range(height), lambda i: substring(plane, CAST(((y + i) * cw + x) * 2 + 1 AS BIGINT), CAST(width * 2 AS BIGINT))), '') END AS shown FROM e""",
}
