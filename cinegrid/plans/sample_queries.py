"""Sample conversion, geometry and blending over the driver's tables: each 64-value embedding is a picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions import composite as C
from cinegrid.functions import convert as X
from cinegrid.functions import raster as R
from cinegrid.functions import tables as t
from cinegrid.operators import fold
from cinegrid.plans.timeline_queries import load


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))


def samples(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    """vec_id, label and s: each value, moved to [0, 1], as a sample."""
    s = F.transform("v", lambda x: X.quantise(X.clean(x) + X.f32(0.5), bits))
    return vectors(spark, sf_dir).select("vec_id", "label", s.alias("s"))


def flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("s").alias("i", "s"))


def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "x"))
    return d.select("vec_id", "i", X.quantise(X.clean(F.col("x")), 8).alias("q8"), X.quantise(X.clean(F.col("x")), 16).alias("q16"))


def orientation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture as 16 x 4, shown by an orientation; the inverse orientation's code beside it."""
    d = samples(spark, sf_dir).select("vec_id", (F.col("vec_id") % 8 + 1).cast("int").alias("code"), "s")
    w, _ = R.output_size(F.col("code"), 16, 4)
    shown = d.select("vec_id", "code", R.inverse_orientation(F.col("code")).alias("inverse"), w.alias("width"), R.oriented(F.col("s"), F.col("code"), 16, 4).alias("s"))
    return flat(shown, "vec_id", "code", "inverse", "width")


def depth_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flat(samples(spark, sf_dir, 16).withColumn("bits", (F.col("vec_id") % 7 + 9).cast("int")), "vec_id", "bits")
    fmt = R.at_depth(F.when(F.col("vec_id") % 2 == 0, "Gray16").otherwise("RGB48"), F.col("bits"))
    return d.select("vec_id", "i", fmt.alias("format"), X.depth_shift(F.col("s"), F.col("bits")).alias("s"))


def split_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir)
    planes = F.array(*[R.channel(F.col("s"), 4, c) for c in range(3)])
    return d.select("vec_id", F.posexplode(planes).alias("plane", "p")).select("vec_id", "plane", F.posexplode("p").alias("i", "s"))


def alpha_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alpha of RGBA pictures; every third picture has none and is opaque."""
    a = F.when(F.col("vec_id") % 3 != 0, R.channel(F.col("s"), 4, 3))
    return flat(samples(spark, sf_dir).select("vec_id", F.coalesce(a, R.opaque(16, 255)).alias("s")), "vec_id")


def widen_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flat(samples(spark, sf_dir, 10), "vec_id")
    return d.select("vec_id", "i", X.widen(F.col("s"), 10).alias("w10"), X.widen(F.shiftright("s", 2), 8).alias("w8"))


def reduce_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flat(samples(spark, sf_dir, 16), "vec_id")
    return d.select("vec_id", "i", X.reduce_depth(F.col("s"), 16, 8).alias("r8"), X.reduce_depth(F.shiftright("s", 6), 10, 8).alias("r10"), X.reduce_depth(F.shiftright("s", 8), 8, 1).alias("r1"))


def triples(spark: SparkSession, sf_dir: str, width: int = 3) -> DataFrame:
    names = "abcd"[:width]
    d = samples(spark, sf_dir).select("vec_id", "label", "s", F.explode(F.sequence(F.lit(0), F.lit(64 // width - 1))).alias("k"))
    return d.select("vec_id", "label", "k", *[F.get("s", F.col("k") * width + i).alias(n) for i, n in enumerate(names)])


MATRICES = [0, *t.COEFFICIENTS]


def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.get(F.array(*[F.lit(x) for x in MATRICES]), (F.col("vec_id") % len(MATRICES)).cast("int"))
    d = triples(spark, sf_dir).select("vec_id", "k", m.alias("m"), *[F.col(c).cast("float").alias(c) for c in "abc"])
    p = X.yuv_to_rgb(F.col("a"), F.col("b"), F.col("c"), X.matrix_of(F.col("m")), F.col("vec_id") % 2 == 0, 8, 8)
    return d.select("vec_id", "k", p.alias("p")).select("vec_id", "k", "p.*")


def chroma_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 samples as a 4 x 4 chroma plane of an 8 x 8 picture, for all six sample positions."""
    d = samples(spark, sf_dir).select("vec_id", F.transform(F.slice("s", 1, 16), lambda x: x.cast("float")).alias("g"), (F.col("vec_id") % 6).cast("int").alias("loc"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))

    def phase(which: int) -> Column:
        return F.get(F.array(*[X.f32(v[which]) for v in t.CHROMA_PHASES.values()]), F.col("loc"))

    d = d.select("vec_id", "at", "g", phase(0).alias("px"), phase(1).alias("py"))
    c = X.chroma_at(F.col("g"), 4, 4, F.col("at") % 8, F.floor(F.col("at") / 8), (2, 2), (F.col("px"), F.col("py")))
    return d.select("vec_id", F.col("at").alias("pos"), F.round(c.cast("double") * 4).cast("int").alias("c4"))


def cmyk_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = triples(spark, sf_dir, 4)
    return d.select("vec_id", "k", *[X.cmyk_to_rgb(F.col(c), F.col("d"), 255).alias(n) for c, n in zip("abc", "rgb", strict=True)])


def ycbcr_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select("vec_id", "k", X.ycbcr_to_rgb(F.col("a"), F.col("b"), F.col("c")).alias("p")).select("vec_id", "k", "p.*")


def jp2_sycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select("vec_id", "k", X.sycc_to_rgb(F.col("a"), F.col("b"), F.col("c"), 8).alias("p")).select("vec_id", "k", "p.*")


def bit_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 32).cast("int").alias("v"))
    return d.select("p_partkey", X.bit_expand(F.col("v"), 5, "round").alias("rounded"), X.bit_expand(F.col("v"), 5, "truncate").alias("truncated"), X.bit_expand(F.col("v"), 5, "float").alias("scaled"))


def narrow_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of packed samples, the first in the high bits; every other picture is stored with white as zero."""
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).cast("int").alias("byte"), F.get(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("p_partkey") % 3).cast("int")).alias("bits"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).where((F.col("i") + 1) * F.col("bits") <= 8)
    raw = F.call_function("shiftright", F.col("byte"), 8 - (F.col("i") + 1) * F.col("bits")) % F.call_function("shiftleft", F.lit(1), F.col("bits"))
    v = F.when(F.col("bits") == 1, X.bit_expand(raw, 1, "truncate")).when(F.col("bits") == 2, X.bit_expand(raw, 2, "truncate")).otherwise(X.bit_expand(raw, 4, "truncate"))
    return d.select("p_partkey", "i", F.when(F.col("p_partkey") % 2 == 0, 255 - v).otherwise(v).alias("v"))


def hdr_radiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("c"), (F.col("p_size") * 5 % 256).cast("int").alias("e"))
    return d.select("p_partkey", X.radiance(F.col("c"), F.col("e")).cast("double").alias("radiance"))


def pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two RGBA pixels of each picture: s over u."""
    d = samples(spark, sf_dir).select("vec_id", "s", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    at = lambda i: F.get("s", F.col("k") * 8 + i)
    # alphas reach both ends
    alpha = lambda c: F.when(c % 5 == 0, 0).when(c % 5 == 1, 255).otherwise(c)
    return d.select("vec_id", "k", *[at(i).alias(n) for i, n in enumerate(["sr", "sg", "sb"])], alpha(at(3)).alias("sa"), *[at(i + 4).alias(n) for i, n in enumerate(["ur", "ug", "ub"])], alpha(at(7)).alias("ua"))


def blend_over_apng(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pixel_pairs(spark, sf_dir)
    return d.select("vec_id", "k", *[C.blend_full(F.col(f"s{c}"), F.col("sa"), F.col(f"u{c}"), 255).cast("int").alias(c) for c in "rgba"])


def blend_over_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pixel_pairs(spark, sf_dir)
    return d.select("vec_id", "k", *[C.over_colour(F.col(f"s{c}"), F.col("sa"), F.col(f"u{c}"), F.col("ua")).cast("int").alias(c) for c in "rgb"], C.over_alpha(F.col("sa"), F.col("ua")).cast("int").alias("a"))


def gif_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as animations of one pixel: a turn's text length is its colour, every fifth is transparent."""
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    frames = d.select("conv_id", "turn", (F.col("n") % 256).cast("int").alias("colour"), (F.col("n") % 5 == 0).alias("clear"), F.get(F.array(*map(F.lit, DISPOSALS)), (F.col("turn") % 4).cast("int")).alias("disposal"))
    return fold.gif_pixel(frames, "conv_id", "turn")


DISPOSALS = ["keep", "background", "previous", "any"]


def gif_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as animations of 6 by 4 pixels: each turn draws a rectangle whose place, size, colours and disposal follow from
    its text's length."""
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    wide, high = F.col("n") % 4 + 1, F.floor(F.col("n") / 4) % 3 + 1
    pixels = F.transform(F.sequence(F.lit(0), (wide * high).cast("int") - 1), lambda i: F.when((F.col("n") + i) % 5 != 0, (F.col("n") * 3 + i) % 256))
    disposal = F.get(F.array(*map(F.lit, DISPOSALS)), ((F.col("n") + F.col("turn")) % 4).cast("int"))
    frames = d.select("conv_id", "turn", (F.col("n") % 3).alias("left"), (F.floor(F.col("n") / 2) % 2).alias("top"), wide.alias("wide"), pixels.alias("pixels"), disposal.alias("disposal"))
    return fold.gif_canvas(frames, "conv_id", "turn", 6, 4)


F32 = "CAST({} AS FLOAT)"
SAMPLES_SQL = "SELECT vec_id, label, unnest(range(64)) AS i, CAST(floor(least(greatest(unnest(embedding) + 0.5::FLOAT, 0::FLOAT), 1::FLOAT) * {most}::FLOAT + 0.5::FLOAT) AS INTEGER) AS s FROM embeddings"
S8, S10, S16 = (SAMPLES_SQL.format(most=(1 << b) - 1) for b in (8, 10, 16))
TRIPLES_SQL = f"SELECT vec_id, CAST(i // 3 AS INTEGER) AS k, max(CASE WHEN i % 3 = 0 THEN s END) AS a, max(CASE WHEN i % 3 = 1 THEN s END) AS b, max(CASE WHEN i % 3 = 2 THEN s END) AS c FROM ({S8}) WHERE i < 63 GROUP BY 1, 2"
PAIRS_SQL = f"""WITH x AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS k, list(s ORDER BY i) AS p FROM ({S8}) GROUP BY 1, 2),
y AS (SELECT vec_id, k, p[1] AS sr, p[2] AS sg, p[3] AS sb, CASE p[4] % 5 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE p[4] END AS sa, p[5] AS ur, p[6] AS ug, p[7] AS ub, CASE p[8] % 5 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE p[8] END AS ua FROM x)"""


def q(v: str, most: int = 255) -> str:
    return f"CAST(floor(least(greatest(CAST({v} AS FLOAT), 0::FLOAT), 1::FLOAT) * {most}::FLOAT + 0.5::FLOAT) AS INTEGER)"


def lit32(v: float) -> str:
    import numpy as np

    return f"CAST({float(np.float32(v))!r} AS FLOAT)"


KR = "CASE m " + " ".join(f"WHEN {c} THEN {lit32(k[0])}" for c, k in t.COEFFICIENTS.items()) + " END"
KB = "CASE m " + " ".join(f"WHEN {c} THEN {lit32(k[1])}" for c, k in t.COEFFICIENTS.items()) + " END"
LUMA = "CASE WHEN vec_id % 2 = 0 THEN {0} * " + lit32(X.float_ratio(1, 255)) + " ELSE ({0} - 16::FLOAT) * " + lit32(X.float_ratio(1, 219)) + " END"
CHROMA = "CASE WHEN vec_id % 2 = 0 THEN ({0} - 128::FLOAT) * " + lit32(X.float_ratio(1, 255)) + " ELSE ({0} - 128::FLOAT) * " + lit32(X.float_ratio(1, 224)) + " END"
BYTE = "CAST(least(greatest(round({}), 0), 255) AS INTEGER)"
KG = 1.0 - 0.299 - 0.114

QUERIES = {
    f.__name__: f for f in (quantise, orientation_map, depth_shift, split_planes, alpha_plane, widen_depth, reduce_depth, yuv_to_rgb, chroma_upsample, cmyk_to_rgb, ycbcr_tiff, jp2_sycc, bit_expand, narrow_gray, hdr_radiance, blend_over_apng, blend_over_webp, gif_compose, gif_canvas)
}
ORACLE = {
    "quantise": f"WITH e AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings) SELECT vec_id, i, {q('x')} AS q8, {q('x', 65535)} AS q16 FROM e",
    "orientation_map": f"""WITH s AS ({S8}), o AS (SELECT vec_id, CAST(vec_id % 8 + 1 AS INTEGER) AS code, CAST(i % 16 AS INTEGER) AS sx, CAST(i // 16 AS INTEGER) AS sy, s FROM s),
p AS (SELECT *, CASE code WHEN 6 THEN 8 WHEN 8 THEN 6 ELSE code END AS inverse, CASE WHEN code >= 5 THEN 4 ELSE 16 END AS width FROM o),
r AS (SELECT *, CASE code WHEN 1 THEN sx WHEN 2 THEN 15 - sx WHEN 3 THEN 15 - sx WHEN 4 THEN sx WHEN 5 THEN sy WHEN 6 THEN 3 - sy WHEN 7 THEN 3 - sy ELSE sy END AS x, CASE code WHEN 1 THEN sy WHEN 2 THEN sy WHEN 3 THEN 3 - sy WHEN 4 THEN 3 - sy WHEN 5 THEN sx WHEN 6 THEN sx WHEN 7 THEN 15 - sx ELSE 15 - sx END AS y FROM p)
SELECT vec_id, code, inverse, width, CAST(y * width + x AS INTEGER) AS i, s FROM r""",
    "depth_shift": f"SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN vec_id % 2 = 0 THEN 'Gray' || (vec_id % 7 + 9) ELSE 'RGB' || (vec_id % 7 + 9) * 3 END AS format, s >> CAST(7 - vec_id % 7 AS INTEGER) AS s FROM ({S16})",
    "split_planes": f"SELECT vec_id, CAST(i % 4 AS INTEGER) AS plane, CAST(i // 4 AS INTEGER) AS i, s FROM ({S8}) WHERE i % 4 < 3",
    "alpha_plane": f"SELECT vec_id, CAST(i // 4 AS INTEGER) AS i, CASE WHEN vec_id % 3 = 0 THEN 255 ELSE s END AS s FROM ({S8}) WHERE i % 4 = 3",
    "widen_depth": f"SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(s * 64 + s // 16 AS INTEGER) AS w10, CAST((s // 4) * 257 AS INTEGER) AS w8 FROM ({S10})",
    "reduce_depth": f"SELECT vec_id, CAST(i AS INTEGER) AS i, CAST((s::BIGINT * 510 + 65535) // 131070 AS INTEGER) AS r8, CAST(((s // 64) * 510 + 1023) // 2046 AS INTEGER) AS r10, CAST(((s // 256) * 2 + 255) // 510 AS INTEGER) AS r1 FROM ({S16})",
    "yuv_to_rgb": f"""WITH t AS ({TRIPLES_SQL}), u AS (SELECT vec_id, k, ([{', '.join(map(str, MATRICES))}])[CAST(vec_id % {len(MATRICES)} AS INTEGER) + 1] AS m, a::FLOAT AS a, b::FLOAT AS b, c::FLOAT AS c FROM t),
v AS (SELECT *, CAST({LUMA.format('a')} AS FLOAT) AS y, CAST({LUMA.format('b')} AS FLOAT) AS yb, CAST({LUMA.format('c')} AS FLOAT) AS yc, CAST({CHROMA.format('b')} AS FLOAT) AS cb, CAST({CHROMA.format('c')} AS FLOAT) AS cr, {KR} AS kr, {KB} AS kb FROM u),
w AS (SELECT *, 1::FLOAT - kr - kb AS kg FROM v)
SELECT vec_id, k, {q('CASE WHEN m = 0 THEN y ELSE y + 2::FLOAT * (1::FLOAT - kr) * cr END')} AS r,
{q('CASE WHEN m = 0 THEN yb ELSE y - (2::FLOAT * kb * (1::FLOAT - kb) / kg) * cb - (2::FLOAT * kr * (1::FLOAT - kr) / kg) * cr END')} AS g, {q('CASE WHEN m = 0 THEN yc ELSE y + 2::FLOAT * (1::FLOAT - kb) * cb END')} AS b FROM w""",
    "chroma_upsample": f"""WITH s AS ({S8}), g AS (SELECT vec_id, list(s::DOUBLE ORDER BY i) AS g FROM s WHERE i < 16 GROUP BY 1),
a AS (SELECT vec_id, g, unnest(range(64)) AS pos, ([0, .5, 0, .5, 0, .5])[CAST(vec_id % 6 AS INTEGER) + 1] AS px, ([.5, .5, 0, 0, 1, 1])[CAST(vec_id % 6 AS INTEGER) + 1] AS py FROM g),
b AS (SELECT vec_id, g, pos, (pos % 8 - px) / 2 AS x, (pos // 8 - py) / 2 AS y FROM a),
c AS (SELECT vec_id, g, pos, x - floor(x) AS wx, y - floor(y) AS wy, CAST(least(greatest(floor(x), 0), 3) AS INTEGER) AS x0, CAST(least(greatest(floor(x) + 1, 0), 3) AS INTEGER) AS x1, CAST(least(greatest(floor(y), 0), 3) AS INTEGER) AS y0, CAST(least(greatest(floor(y) + 1, 0), 3) AS INTEGER) AS y1 FROM b)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(round(4 * ((g[y0 * 4 + x0 + 1] * (1 - wx) + g[y0 * 4 + x1 + 1] * wx) * (1 - wy) + (g[y1 * 4 + x0 + 1] * (1 - wx) + g[y1 * 4 + x1 + 1] * wx) * wy)) AS INTEGER) AS c4 FROM c""",
    "cmyk_to_rgb": f"""WITH t AS (SELECT vec_id, CAST(i // 4 AS INTEGER) AS k, list(s ORDER BY i) AS p FROM ({S8}) GROUP BY 1, 2)
SELECT vec_id, k, {', '.join(f"CAST(floor((255::FLOAT - p[{n + 1}]::FLOAT) * (1::FLOAT - p[4]::FLOAT / 255::FLOAT)) AS INTEGER) AS {c}" for n, c in enumerate('rgb'))} FROM t""",
    "ycbcr_tiff": f"""WITH t AS ({TRIPLES_SQL}) SELECT vec_id, k, {BYTE.format('a + (c - 128) * (2.0::DOUBLE - 2.0::DOUBLE * 0.299::DOUBLE)')} AS r,
{BYTE.format(f'a - (b - 128) * {(2 - 2 * 0.114) * 0.114 / KG!r}::DOUBLE - (c - 128) * {(2 - 2 * 0.299) * 0.299 / KG!r}::DOUBLE')} AS g, {BYTE.format('a + (b - 128) * (2.0::DOUBLE - 2.0::DOUBLE * 0.114::DOUBLE)')} AS b FROM t""",
    "jp2_sycc": f"""WITH t AS ({TRIPLES_SQL}), n AS (SELECT vec_id, k, a::FLOAT / 255::FLOAT AS y, b::FLOAT / 255::FLOAT - 0.5::FLOAT AS cb, c::FLOAT / 255::FLOAT - 0.5::FLOAT AS cr FROM t)
SELECT vec_id, k, {', '.join(f"CAST(round(least(greatest(CAST({e} AS FLOAT), 0::FLOAT), 1::FLOAT) * 255::FLOAT) AS INTEGER) AS {c}" for c, e in (('r', f'y + {lit32(1.402)} * cr'), ('g', f'y - {lit32(0.344136)} * cb - {lit32(0.714136)} * cr'), ('b', f'y + {lit32(1.772)} * cb')))} FROM n""",
    "bit_expand": f"WITH p AS (SELECT p_partkey, p_partkey % 32 AS v FROM part) SELECT p_partkey, CAST((v * 255 + 15) // 31 AS INTEGER) AS rounded, CAST(v * 255 // 31 AS INTEGER) AS truncated, CAST(round(v::FLOAT * {lit32(X.float_ratio(255, 31))}) AS INTEGER) AS scaled FROM p",
    "narrow_gray": """WITH p AS (SELECT p_partkey, p_partkey * 37 % 256 AS byte, ([1, 2, 4])[CAST(p_partkey % 3 AS INTEGER) + 1] AS bits, unnest(range(8)) AS i FROM part),
r AS (SELECT p_partkey, i, bits, (byte >> CAST(8 - (i + 1) * bits AS INTEGER)) % (1 << bits) AS raw FROM p WHERE (i + 1) * bits <= 8), v AS (SELECT p_partkey, i, raw * 255 // ((1 << bits) - 1) AS v FROM r)
SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN p_partkey % 2 = 0 THEN 255 - v ELSE v END AS INTEGER) AS v FROM v""",
    "hdr_radiance": "WITH p AS (SELECT p_partkey, p_partkey % 256 AS c, p_size * 5 % 256 AS e FROM part) SELECT p_partkey, CAST(CAST(CASE WHEN e = 0 THEN 0 ELSE c * pow(2.0::DOUBLE, e - 136) END AS FLOAT) AS DOUBLE) AS radiance FROM p",
    "blend_over_apng": PAIRS_SQL + " SELECT vec_id, k, " + ", ".join(f"CAST(CASE sa WHEN 0 THEN u{c} WHEN 255 THEN s{c} ELSE (s{c} * sa + u{c} * (255 - sa)) // 255 END AS INTEGER) AS {c}" for c in "rgba") + " FROM y",
    "blend_over_webp": PAIRS_SQL + ", z AS (SELECT *, ((((ua * (255 - sa) + 128) >> 8) + ua * (255 - sa) + 128) >> 8)::BIGINT AS keep FROM y) SELECT vec_id, k, " + ", ".join(f"CAST(CASE WHEN sa = 0 THEN u{c} ELSE ((s{c} * sa + u{c} * keep) * (16777216 // greatest(sa + keep, 1))) >> 24 END AS INTEGER) AS {c}" for c in "rgb") + ", CAST(CASE WHEN sa = 0 THEN ua ELSE sa + keep END AS INTEGER) AS a FROM z",
    "gif_compose": """WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
x AS (SELECT conv_id, r, turn, CAST(n % 256 AS INTEGER) AS colour, n % 5 = 0 AS clear, turn % 4 AS d FROM f),
s AS (SELECT conv_id, r, turn, CASE WHEN clear THEN -1 ELSE colour END AS shown, CASE WHEN d IN (0, 3) AND NOT clear THEN colour ELSE -1 END AS base FROM x WHERE r = 1
 UNION ALL SELECT x.conv_id, x.r, x.turn, CASE WHEN x.clear THEN s.base ELSE x.colour END, CASE WHEN x.d = 1 THEN -1 WHEN x.d <> 2 AND NOT x.clear THEN x.colour ELSE s.base END FROM s JOIN x ON x.conv_id = s.conv_id AND x.r = s.r + 1)
SELECT conv_id, turn, CAST(shown AS INTEGER) AS shown FROM s""",
    "gif_canvas": """WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
x AS (SELECT conv_id, turn, r, n, n % 3 AS l, n // 2 % 2 AS t, n % 4 + 1 AS w, n // 4 % 3 + 1 AS h, (n + turn) % 4 AS d, unnest(range(24)) AS p FROM f),
y AS (SELECT *, p % 6 - l AS px, p // 6 - t AS py FROM x),
z AS (SELECT conv_id, turn, r, p, d, px BETWEEN 0 AND w - 1 AND py BETWEEN 0 AND h - 1 AS hit, py * w + px AS i, n FROM y),
c AS (SELECT conv_id, turn, r, p, d, hit, CASE WHEN hit AND (n + i) % 5 <> 0 THEN (n * 3 + i) % 256 ELSE -1 END AS own FROM z),
s AS (SELECT conv_id, turn, r, p, own AS shown, CASE WHEN hit AND d IN (0, 3) THEN own ELSE -1 END AS base FROM c WHERE r = 1
 UNION ALL SELECT c.conv_id, c.turn, c.r, c.p, CASE WHEN c.own < 0 THEN s.base ELSE c.own END,
  CASE WHEN NOT c.hit OR c.d = 2 THEN s.base WHEN c.d = 1 THEN -1 WHEN c.own < 0 THEN s.base ELSE c.own END FROM s JOIN c ON c.conv_id = s.conv_id AND c.p = s.p AND c.r = s.r + 1)
SELECT conv_id, turn, list(CAST(shown AS INTEGER) ORDER BY p) AS shown FROM s GROUP BY conv_id, turn""",
}
