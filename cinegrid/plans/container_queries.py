"""What containers state (track tables, orientation, colour), canvases, and guards of conversion, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions import convert as X
from cinegrid.functions import metadata as M
from cinegrid.functions import raster as R
from cinegrid.operators import canvas
from cinegrid.operators import timeline as T
from cinegrid.operators import validate as V
from cinegrid.plans.timeline_queries import HOURLY, LINE_ORDER, MICROS, POS_SQL, SEGMENTS, event_presentations, load, numbered_lines

WIDTH, HEIGHT, BAND = 6, 4, 2
CLIPPED_WIDTH, CLIPPED_HEIGHT = 4, 3


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as animations: each turn draws a rectangle whose place, size, samples and rules follow from its text's length."""
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    wide, high = F.col("n") % 4 + 1, F.floor(F.col("n") / 4) % 3 + 1

    def sample(k: Column) -> Column:
        i, c = F.floor(k / 4), k % 4
        colour = (F.col("n") * 3 + i * 7 + c * 50) % 256
        alpha = F.when((F.col("n") + i) % 4 == 0, 0).when((F.col("n") + i) % 4 == 1, 255).otherwise((F.col("n") * 5 + i * 11) % 256)
        return F.when(c == 3, alpha).otherwise(colour)

    pixels = F.transform(F.sequence(F.lit(0), (wide * high * 4).cast("int") - 1), sample)
    disposal = F.get(F.array(F.lit("none"), F.lit("background"), F.lit("previous")), ((F.col("n") + F.col("turn")) % 3).cast("int"))
    return d.select(
        "conv_id", "turn", (F.col("n") % 3).alias("left"), (F.floor(F.col("n") / 2) % 2).alias("top"), wide.alias("wide"), high.alias("high"),
        pixels.alias("pixels"), (F.floor(F.col("n") / 3) % 2 == 0).alias("over"), disposal.alias("disposal"),
    )


def apng_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.canvases(pictures(spark, sf_dir), "conv_id", "turn", WIDTH, HEIGHT, "apng", band_rows=BAND)


def webp_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canvas smaller than some pictures, which are clipped."""
    return canvas.canvases(pictures(spark, sf_dir), "conv_id", "turn", CLIPPED_WIDTH, CLIPPED_HEIGHT, "webp", band_rows=BAND)


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the concatenation of all users' timelines."""
    return T.clip_frames(event_presentations(spark, sf_dir), "user_id", "pos", "gap", MICROS, HOURLY)


def track_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs of a sample table; orders with an empty run state no timeline."""
    count = ((F.col("l_quantity").cast("long") + F.col("l_orderkey")) % 9).alias("count")
    raw = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(F.lit(1 << 32) - F.col("l_partkey")).cast("long")
    offset = T.composition_offset((F.col("l_orderkey") % 2).cast("int"), raw)
    runs = numbered_lines(spark, sf_dir).select("l_orderkey", "pos", count, offset.alias("value"))
    return T.expand_runs(runs, "l_orderkey", "pos", "count", "value")


def edit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edits: most are empty ones, some start within the media."""
    media = F.when(F.col("l_partkey") % 4 < 3, F.lit(-1)).when(F.col("l_suppkey") % 3 == 0, F.lit(7)).otherwise(F.lit(0)).cast("long")
    duration = F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_quantity")).cast("long")
    edits = numbered_lines(spark, sf_dir).select("l_orderkey", "pos", duration.alias("duration"), media.alias("media_time"))
    return T.edit_list(edits, "l_orderkey", "pos", "duration", "media_time")


def container_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of a rotation and a mirror, and what is shown with the rotation applied or not."""
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("angle"), F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3).cast("int").alias("mirror"))
    code = R.container_orientation(F.col("angle"), F.col("mirror"))
    return d.select("p_partkey", code.alias("code"), R.shown_orientation(code, F.col("p_partkey") % 5 > 0).alias("shown"))


def exif_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with 0 to 3 other entries before the orientation, in both byte orders; some are cut within the value or state no code."""
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("big"), (F.col("p_size") % 4).cast("int").alias("others"), (F.col("p_partkey") % 11).cast("int").alias("code"))

    def number(value: Column, digits: int) -> Column:
        plain = F.lpad(F.hex(value), digits, "0")
        pairs = [F.substring(plain, i, 2) for i in range(1, digits, 2)]
        return F.when(F.col("big"), plain).otherwise(F.concat(*reversed(pairs)))

    other = F.concat(number(F.lit(0x010F), 4), F.lit("0" * 20))
    mine = F.concat(number(F.lit(0x0112), 4), number(F.lit(3), 4), number(F.lit(1), 8), number(F.col("code"), 4), F.lit("0000"))
    body = F.concat(F.when(F.col("big"), "4D4D002A").otherwise("49492A00"), number(F.lit(8), 8), number(F.col("others") + 1, 4), F.repeat(other, F.col("others")), mine)
    cut = F.when(F.col("p_partkey") % 7 == 0, F.substring(body, 1, 36)).when(F.col("p_partkey") % 13 == 0, F.lit("5858002A")).otherwise(body)
    return d.select("p_partkey", R.exif_orientation(F.unhex(cut)).alias("orientation"))


def tiff_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients near or off the named ones, and reference levels that are absent, full or limited."""
    kind, off = F.col("p_partkey") % 3, F.col("p_size") / 10000.0
    named = F.when(kind == 0, F.array(F.lit(0.299) + off, F.lit(0.587), F.lit(0.114))).when(kind == 1, F.array(F.lit(0.2126), F.lit(0.7152) - off, F.lit(0.0722)))
    levels = F.when(F.col("p_partkey") % 4 == 0, F.array(*[F.lit(float(x)) for x in (0, 255, 128, 255, 128, 255)])).when(F.col("p_partkey") % 4 == 1, F.array(*[F.lit(float(x)) for x in (16, 235, 128, 240, 128, 240)]))
    d = load(spark, sf_dir, "part").select("p_partkey", M.tiff_colour(named, levels).alias("c"))
    return d.select("p_partkey", "c.matrix", "c.full")


def conversion_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pictures of which shape can be converted or kept in planes, and why not."""
    d = load(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % 12 + 6).cast("int").alias("bits"), (F.col("p_size") % 19).cast("int").alias("precision"), (F.col("p_partkey") % 7 % 3).cast("int").alias("across"), (F.col("p_size") % 5 % 3).cast("int").alias("down"),
        (F.col("p_partkey") % 5).cast("int").alias("width"), (F.col("p_size") % 3 + 1).cast("int").alias("height"), (F.col("p_partkey") % 15).cast("int").alias("matrix"),
    )
    c = {n: F.col(n) for n in d.columns}
    why = X.yuv_refusal(c["bits"], c["precision"], c["across"], c["down"], c["width"], c["height"], c["matrix"])
    return d.select("p_partkey", why.alias("refusal"), R.fits(c["width"], c["height"], c["across"], c["down"]).alias("fits"))


def matrix_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, F.lit(6))
    stated = F.when(F.col("p_size") % 4 > 0, F.get(F.array(*[F.lit(m) for m in (1, 9, 2, 5)]), (F.col("p_partkey") % 4).cast("int")))
    d = load(spark, sf_dir, "part").select("p_partkey", given.alias("given"), stated.alias("stated"))
    return d.select("p_partkey", X.yuv_matrix(F.col("given"), F.col("stated"), refuse=False).cast("int").alias("matrix"))


def alpha_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips, their lines as frames: some alpha clips lack a frame, or have one of another family, type, depth or size."""
    d = numbered_lines(spark, sf_dir)
    p, k = F.col("l_partkey"), F.col("l_orderkey")
    sample, bits = F.when(k % 7 == 0, "float").otherwise("integer"), F.when(k % 2 == 0, 8).otherwise(16)
    colour = d.select("l_orderkey", "pos", F.lit("RGB").alias("family"), sample.alias("sample"), bits.alias("bits"), F.lit(16).alias("width"), F.lit(12).alias("height"))
    alpha = d.where((k % 5 > 0) | (F.col("pos") > 1)).select(
        "l_orderkey", "pos", F.when(p % 31 == 0, "RGB").otherwise("Gray").alias("family"), F.when(p % 37 == 0, "float").otherwise(sample).alias("sample"),
        F.when(p % 11 == 0, 10).otherwise(bits).alias("bits"), F.when(p % 41 == 0, 15).otherwise(16).alias("width"), F.lit(12).alias("height"),
    )
    return V.alpha_clip(colour, alpha, "l_orderkey", "pos")


PALETTE = [[0, 10, 20], [250, 251, 252], [7, 8, 9], [100, 110, 120], [255, 0, 255]]


def jp2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 5 to 14 bits as words, beside the palette's colours for an index."""
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10 + 5).cast("int").alias("depth"), ((F.col("p_partkey") * 37 % 40000) / 2.0 - 50).alias("sample"))
    entry = X.palette_entry(F.array(*[F.array(*map(F.lit, e)) for e in PALETTE]), F.col("p_partkey") % len(PALETTE))
    d = d.withColumn("e", entry)
    return d.select("p_partkey", X.sample_word(F.col("sample"), F.col("depth")).alias("word"), *[F.get("e", i).alias(c) for i, c in enumerate("rgb")])


def alpha_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames (parts) with alpha frames of the same number, some of another depth, kind or size."""
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("k"), (F.col("p_size") % 5).alias("s"))
    formats = F.array(*map(F.lit, ["RGB24", "RGB48", "Gray8", "Gray16"]))
    alphas = F.array(*map(F.lit, ["Gray8", "Gray16", "RGB24", "Gray8", "Gray16"]))
    colour = F.struct(F.get(formats, F.col("k").cast("int")).alias("format"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    alpha = F.struct(F.get(alphas, F.col("s").cast("int")).alias("format"), F.lit(64).alias("width"), F.when(F.col("p_partkey") % 6 == 0, 47).otherwise(48).alias("height"))
    d = d.select("p_partkey", colour.alias("colour"), alpha.alias("alpha"))
    return d.select("p_partkey", V.compatible_alpha(F.col("colour"), F.col("alpha")).alias("fits"))


def canvas_sql(width: int, height: int, mix: dict[str, str], left_over: str) -> str:
    """The fold of one pixel at a time, recursively: u_ is what the picture before left."""
    own = {c: f"CASE WHEN NOT hit THEN u{c} WHEN NOT over THEN s{c} ELSE {mix[c]} END" for c in "rgba"}
    return f"""WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
x AS (SELECT conv_id, turn, k, n, n % 3 AS l, n // 2 % 2 AS t, n % 4 + 1 AS w, n // 4 % 3 + 1 AS h, n // 3 % 2 = 0 AS over, (n + turn) % 3 AS d, unnest(range({width * height})) AS p FROM f),
y AS (SELECT *, p % {width} - l AS px, p // {width} - t AS py FROM x),
z AS (SELECT *, px BETWEEN 0 AND w - 1 AND py BETWEEN 0 AND h - 1 AS hit, py * w + px AS i FROM y),
c AS (SELECT conv_id, turn, k, p, over, d, hit, (n * 3 + i * 7) % 256 AS sr, (n * 3 + i * 7 + 50) % 256 AS sg, (n * 3 + i * 7 + 100) % 256 AS sb, CASE (n + i) % 4 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE (n * 5 + i * 11) % 256 END AS sa FROM z),
s AS (SELECT conv_id, turn, k, p, 0::BIGINT AS o_r, 0::BIGINT AS o_g, 0::BIGINT AS o_b, 0::BIGINT AS o_a, 0::BIGINT AS br, 0::BIGINT AS bg, 0::BIGINT AS bb, 0::BIGINT AS ba FROM (SELECT DISTINCT conv_id, NULL::INTEGER AS turn, 0::BIGINT AS k, p FROM c)
 UNION ALL SELECT conv_id, turn, k, p, o_r, o_g, o_b, o_a, {', '.join(left_over.format(c=c) for c in 'rgba')} FROM (
  SELECT *, {', '.join(f'CAST({own[c]} AS BIGINT) AS o_{c}' for c in 'rgba')} FROM (
   SELECT c.*, s.br AS ur, s.bg AS ug, s.bb AS ub, s.ba AS ua FROM s JOIN c ON c.conv_id = s.conv_id AND c.p = s.p AND c.k = s.k + 1))),
v AS (SELECT conv_id, turn, p, unnest([0, 1, 2, 3]) AS ch, unnest([o_r, o_g, o_b, o_a]) AS v FROM s WHERE k > 0)
SELECT conv_id, turn, CAST(p // {width * BAND} AS INTEGER) AS band, list(CAST(v AS INTEGER) ORDER BY p, ch) AS shown FROM v GROUP BY 1, 2, 3"""


APNG_MIX = {c: f"CASE sa WHEN 0 THEN u{c} WHEN 255 THEN s{c} ELSE (s{c} * sa + u{c} * (255 - sa)) // 255 END" for c in "rgba"}
KEEP = "((((ua * (255 - sa) + 128) >> 8) + ua * (255 - sa) + 128) >> 8)"
WEBP_MIX = {c: f"CASE WHEN sa = 0 THEN u{c} ELSE ((s{c} * sa + u{c} * {KEEP}) * (16777216 // greatest(sa + {KEEP}, 1))) >> 24 END" for c in "rgb"} | {"a": f"CASE WHEN sa = 0 THEN ua ELSE sa + {KEEP} END"}
GUARD_SQL = """WITH p AS (SELECT p_partkey, p_partkey % 12 + 6 AS bits, p_size % 19 AS precision, p_partkey % 7 % 3 AS across, p_size % 5 % 3 AS down, p_partkey % 5 AS width, p_size % 3 + 1 AS height, p_partkey % 15 AS matrix FROM part)
SELECT p_partkey, CASE WHEN bits NOT BETWEEN 8 AND 16 THEN 'depth' WHEN precision NOT BETWEEN 1 AND 16 THEN 'precision' WHEN across > 1 OR down > 1 THEN 'subsampling' WHEN matrix IN (3, 11) THEN 'unknown matrix'
 WHEN matrix = 2 THEN 'matrix not stated' WHEN matrix IN (10, 13, 14) THEN 'constant luminance' WHEN matrix = 12 THEN 'derived matrix' WHEN width < (1 << CAST(across AS INTEGER)) OR height < (1 << CAST(down AS INTEGER)) THEN 'no chroma sample' END AS refusal,
 width % (1 << CAST(across AS INTEGER)) = 0 AND height % (1 << CAST(down AS INTEGER)) = 0 AS fits FROM p"""

QUERIES = {f.__name__: f for f in (apng_canvas, webp_canvas, clip_frames, track_samples, edit_lists, container_orientation, exif_orientation, tiff_colour, conversion_guards, matrix_choice, jp2_words, alpha_fit, alpha_clips)}
ORACLE = {
    "alpha_clips": f"""
WITH l AS (SELECT *, {POS_SQL} AS pos, l_orderkey % 7 = 0 AS fl FROM lineitem),
w AS (SELECT l_orderkey, pos, l_orderkey % 5 > 0 OR pos > 1 AS there, CASE WHEN l_partkey % 31 = 0 THEN 'it needs one gray plane' WHEN l_partkey % 37 = 0 AND NOT fl THEN 'samples of another type'
  WHEN NOT fl AND l_partkey % 11 = 0 THEN 'samples of another depth' WHEN l_partkey % 41 = 0 THEN 'another size' END AS wrong FROM l),
g AS (SELECT l_orderkey, count(*) AS frames, count(*) FILTER (there) AS alpha_frames, min(pos) FILTER (there AND wrong IS NOT NULL) AS spot, arg_min(wrong, pos) FILTER (there AND wrong IS NOT NULL) AS wrong FROM w GROUP BY l_orderkey)
SELECT l_orderkey, frames, alpha_frames, CASE WHEN frames = alpha_frames THEN spot END AS first,
  CASE WHEN frames <> alpha_frames THEN frames || ' frames beside ' || alpha_frames ELSE wrong END AS refusal FROM g""",
    "apng_canvas": canvas_sql(WIDTH, HEIGHT, APNG_MIX, "CASE WHEN NOT hit OR d = 0 THEN o_{c} WHEN d = 1 THEN 0 ELSE u{c} END"),
    "webp_canvas": canvas_sql(CLIPPED_WIDTH, CLIPPED_HEIGHT, WEBP_MIX, "o_{c}"),
    "clip_frames": f"WITH {SEGMENTS}, fr AS (SELECT user_id, unnest(range(f, t)) AS local, presentation FROM h WHERE f < t) SELECT start + local AS n, user_id, local, presentation FROM fr JOIN seg USING (user_id)",
    "track_samples": f"""WITH a AS (SELECT l_orderkey, {POS_SQL} AS pos, (CAST(l_quantity AS BIGINT) + l_orderkey) % 9 AS c,
 CASE WHEN l_suppkey % 2 = 0 THEN l_partkey WHEN l_orderkey % 2 = 1 THEN -l_partkey ELSE 4294967296 - l_partkey END AS value FROM lineitem),
b AS (SELECT * FROM a WHERE l_orderkey NOT IN (SELECT l_orderkey FROM a WHERE c = 0)), e AS (SELECT l_orderkey, pos, value, unnest(range(c)) AS i FROM b)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, i) - 1 AS sample, CAST(value AS BIGINT) AS value FROM e""",
    "edit_lists": """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(LINE_ORDER) + """) AS pos, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS duration,
 CASE WHEN l_partkey % 4 < 3 THEN -1 WHEN l_suppkey % 3 = 0 THEN 7 ELSE 0 END AS media FROM lineitem),
r AS (SELECT l_orderkey, list(duration ORDER BY pos) FILTER (WHERE media >= 0) AS ds, list(media ORDER BY pos) FILTER (WHERE media >= 0) AS ms FROM a GROUP BY 1),
q AS (SELECT l_orderkey, ds, CASE WHEN ms[1] > 0 THEN 'starts within its media' WHEN len(ms) > 1 THEN 'edits its media more than once' END AS refusal FROM r)
SELECT l_orderkey, CASE WHEN refusal IS NULL AND ds[1] > 0 THEN ds[1] END AS shown, refusal FROM q""",
    "container_orientation": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS a, CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS m FROM part),
c AS (SELECT p_partkey, CAST(CASE WHEN m IS NULL THEN ([1, 8, 3, 6])[a + 1] WHEN m = 0 THEN ([4, 5, 2, 7])[a + 1] ELSE ([2, 7, 4, 5])[a + 1] END AS INTEGER) AS code FROM p)
SELECT p_partkey, code, CASE WHEN p_partkey % 5 > 0 THEN code ELSE 1 END AS shown FROM c""",
    "exif_orientation": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 13 = 0 OR p_partkey % 11 NOT BETWEEN 1 AND 8 THEN NULL ELSE p_partkey % 11 END AS INTEGER) AS orientation FROM part",
    "tiff_colour": "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 2 THEN 5 WHEN 0 THEN CASE WHEN p_size < 50 THEN 5 END ELSE CASE WHEN p_size < 50 THEN 1 END END AS INTEGER) AS matrix, CASE WHEN p_partkey % 3 < 2 AND p_size >= 50 THEN NULL ELSE p_partkey % 4 <> 1 END AS full FROM part",
    "conversion_guards": GUARD_SQL,
    "matrix_choice": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 6 WHEN p_size % 4 > 0 AND p_partkey % 4 <> 2 THEN ([1, 9, 2, 5])[CAST(p_partkey % 4 AS INTEGER) + 1] END AS INTEGER) AS matrix FROM part",
    "jp2_words": f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 10 + 5 AS INTEGER) AS d, round((p_partkey * 37 % 40000) / 2.0::DOUBLE - 50) AS s FROM part), w AS (SELECT p_partkey, d, CAST(least(greatest(s, 0), (1 << d) - 1) AS INTEGER) AS v FROM p)
SELECT p_partkey, CAST(CASE WHEN d > 8 THEN v << (16 - d) ELSE v END AS INTEGER) AS word, {', '.join(f"({[e[i] for e in PALETTE]})[CAST(p_partkey % 5 AS INTEGER) + 1] AS {c}" for i, c in enumerate('rgb'))} FROM w""",
    "alpha_fit": "SELECT p_partkey, p_size % 5 <> 2 AND p_partkey % 6 <> 0 AND (p_partkey % 2 = 0) = (p_size % 5 IN (0, 3)) AS fits FROM part",
}
