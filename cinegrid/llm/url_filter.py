"""URL filters by expression lookup, in DataFrame functions only.

Each url becomes expressions, a host suffix and a path prefix each; their digests meet the rules' in an equi-join on the
first PREFIX_HEX digits, the full digest then confirms, and the longest rule wins (of equally long ones the one with the
longer host, then block). Suffixes and prefixes are made in the lengths that occur in the rules, so any rule path is
found, and a long url makes no more expressions than the rules have lengths.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. A null url, or
one without ://, has neither, fits no rule and gets the default verdict. Repeated pages each keep their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
PREFIX_HEX = 8
#: Up to so many rules their digests (100 bytes each) are broadcast; beyond, the join shuffles and AQE splits hot rules.
BROADCAST_RULES = 200_000


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    labels = sorted(r[0] for r in shape.select("labels").distinct().collect())  # at most one for each length there is
    chars = sorted(r[0] for r in shape.select("chars").distinct().collect())

    named = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    host, path = url_parts(F.col("url"))
    named = named.select("id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    named = scratch.save(named)  # fixes the row numbers

    known = (F.col("host") != "") | (F.col("path") != "")
    n = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in chars]))
    pairs = named.where(known).select("row", F.explode(suffixes).alias("s"), prefixes.alias("ps")).select("row", "s", F.explode("ps").alias("p"))
    asked = pairs.select("row", digest(F.col("s"), F.col("p")).alias("d")).withColumn("h", F.substring("d", 1, PREFIX_HEX))

    ruled = rules.select(
        digest(lower_ascii(F.col("host")), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"), "verdict",
        F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("host_len"), (F.col("verdict") == "block").alias("blocks")).alias("weight"),
    )
    ruled = scratch.save(ruled.withColumn("h", F.substring("full", 1, PREFIX_HEX)))
    met = asked.join(checked_broadcast(ruled, BROADCAST_RULES), "h").where(F.col("d") == F.col("full"))
    best = met.groupBy("row").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    out = named.join(best, "row", "left")
    return out.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""
