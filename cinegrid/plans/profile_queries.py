"""Colour profiles out of files that are put together from orders: each line is a fragment of its order's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.functions import profiles
from cinegrid.plans.file_queries import gathered, hexed, joined
from cinegrid.plans.timeline_queries import POS_SQL, numbered_lines


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files whose fragments stand in the order of their parts, GIF and WebP files. Of the JPEGs some repeat a number and some
    state a fragment too many; some GIFs and WebPs have no profile."""
    d, key, pos = numbered_lines(spark, sf_dir), F.col("l_orderkey"), F.col("pos")
    text = F.hex(F.encode(F.concat_ws(",", "l_partkey", "l_suppkey", "l_shipdate"), "UTF-8"))
    d = d.withColumn("text", text)
    d = d.withColumn("n", F.count("*").over(W.partitionBy("l_orderkey")))
    stated = F.col("n") + F.when(key % 12 == 0, 1).otherwise(0)
    number = F.when(key % 16 == 1, 1).otherwise(pos)
    segment = F.concat(F.lit("FFE2"), hexed(F.length("text") / 2 + 16, 2), F.lit(b"ICC_PROFILE\0".hex()), hexed(number, 1), hexed(stated, 1), "text")

    block = F.concat(hexed(F.length("text") / 2, 1), "text")
    piece = F.when(key % 4 < 2, segment).when(key % 4 == 2, block).otherwise(F.col("text"))
    d = d.groupBy("l_orderkey").agg(gathered([F.when(key % 4 < 2, F.col("l_partkey")), pos], piece=piece).alias("rows"))
    d = d.select("l_orderkey", joined("rows", "piece").alias("body"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FF"), "body", F.lit("FFE20008494343000102FFDA000203FFE20010" + b"ICC_PROFILE\0".hex() + "0909"))
    label = F.when(key % 10 == 2, F.lit("21FF0B" + b"NETSCAPE2.0".hex())).otherwise(F.lit("21FF0B" + b"ICCRGBG1012".hex()))
    gif = F.concat(F.lit("4749463839610100010080" + "0000" + "11" * 6 + "21F9040000000000"), label, "body", F.lit("002C000000000100010000" + "02024C01003B"))
    pad = F.when(F.length("body") % 4 == 2, "00").otherwise("")
    chunk = F.when(key % 8 == 3, "").otherwise(F.concat(F.lit(b"ICCP".hex()), hexed(F.length("body") / 2, 4, True), "body", pad))
    chunks = F.concat(F.lit(b"VP8X".hex() + "0A000000" + "20" + "00" * 9), chunk, F.lit(b"VP8 ".hex() + "02000000AABB"))
    webp = F.concat(F.lit(b"RIFF".hex()), hexed(F.length(chunks) / 2 + 4, 4, True), F.lit(b"WEBP".hex()), chunks)
    route = F.get(F.array(*map(F.lit, ["jpeg", "jpeg", "gif", "webp"])), (key % 4).cast("int"))
    content = F.when(key % 4 < 2, jpeg).when(key % 4 == 2, gif).otherwise(webp)
    return d.select("l_orderkey", route.alias("route"), F.unhex(content).alias("content"))


def icc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's profile, put together."""
    d = profile_files(spark, sf_dir).select("l_orderkey", "route", profiles.profile(F.col("route"), F.col("content")).alias("p"))
    return d.select("l_orderkey", "route", F.col("p").isNotNull().alias("has_icc"), F.length("p").cast("bigint").alias("size"), F.md5("p").alias("profile"))


QUERIES = {"icc_profiles": icc_profiles}
ORACLE = {
    "icc_profiles": f"""
WITH l AS (SELECT l_orderkey, {POS_SQL} AS pos, l_partkey || ',' || l_suppkey || ',' || CAST(l_shipdate AS VARCHAR) AS t FROM lineitem),
o AS (SELECT l_orderkey, count(*) AS n, string_agg(t, '' ORDER BY pos) AS p FROM l GROUP BY l_orderkey),
k AS (SELECT *, CASE l_orderkey % 4 WHEN 2 THEN l_orderkey % 10 <> 2 WHEN 3 THEN l_orderkey % 8 <> 3 ELSE l_orderkey % 12 <> 0 AND NOT (l_orderkey % 16 = 1 AND n > 1) END AS has_icc FROM o)
SELECT l_orderkey, ['jpeg', 'jpeg', 'gif', 'webp'][l_orderkey % 4 + 1] AS route, has_icc, CASE WHEN has_icc THEN length(p) END AS size, CASE WHEN has_icc THEN md5(p) END AS profile FROM k""",
}
