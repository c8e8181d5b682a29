"""Timeline operators over the driver's tables: each user's events are a segment whose pictures last until the next event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.operators import timeline as T
from cinegrid.operators.segments import scanned

MICROS, HOURLY = (1_000_000, 1), (1, 3600)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("at"))
    e = scanned(e.withColumn("order", F.struct("at", "event_id")), "user_id", "order", {"pos": F.lit(1)}, {"next": F.col("at")})
    return e.select("user_id", "event_id", "at", (F.col("next") - F.col("at")).alias("gap"), (F.col("pos") + 1).alias("pos"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.samples(event_presentations(spark, sf_dir), "user_id", "pos", "gap", MICROS, HOURLY)


def timeline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).select("user_id", "presentation", "duration", "tick", "count")


def hot_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all users' events as one segment, as one very long animation: no task has more than its block."""
    e = load(spark, sf_dir, "events").select(F.lit(1).alias("clip"), "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("at"))
    e = scanned(e.withColumn("order", F.struct("at", "event_id")), "clip", "order", {}, {"next": F.col("at")})
    s = T.samples(e.select("clip", "event_id", "order", (F.col("next") - F.col("at")).alias("gap")), "clip", "order", "gap", MICROS, HOURLY)
    return s.select("event_id", "presentation", "duration", "tick", "until", "count")


def timeline_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frames(T.holds(event_samples(spark, sf_dir), "user_id"), "user_id").select("user_id", F.col("local").alias("n"), "presentation")


SAMPLES_CTE = """
e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
p AS (SELECT user_id, lead(us) OVER w - us AS gap, row_number() OVER w AS pos FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT user_id, pos, CASE WHEN gap > 0 THEN gap ELSE 3600000000 END AS duration FROM p),
c AS (SELECT user_id, pos, duration,
             CAST(coalesce(sum(duration) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior,
             CAST(sum(duration) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM d),
k AS (SELECT *, greatest(1, (total + 3599999999) // 3600000000) AS cnt FROM c),
s AS (SELECT user_id, CAST(pos - 1 AS INTEGER) AS presentation, duration, least(cnt, (prior + 3599999999) // 3600000000) AS tick, cnt AS count FROM k),
h AS (SELECT user_id, presentation, tick AS f, coalesce(lead(tick) OVER (PARTITION BY user_id ORDER BY presentation), count) AS t, count FROM s)"""

QUERIES = {"timeline_samples": timeline_samples, "timeline_frames": timeline_frames, "hot_timeline": hot_timeline}
ORACLE = {
    "timeline_samples": f"WITH {SAMPLES_CTE} SELECT user_id, presentation, duration, tick, count FROM s",
    "hot_timeline": """
WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events),
g AS (SELECT event_id, row_number() OVER w - 1 AS i, lead(us) OVER w - us AS gap FROM e WINDOW w AS (ORDER BY us, event_id)),
d AS (SELECT event_id, i, CASE WHEN gap > 0 THEN gap ELSE 3600000000 END AS duration FROM g),
c AS (SELECT *, CAST(sum(duration) OVER (ORDER BY i) AS BIGINT) AS upto, greatest(1, CAST((sum(duration) OVER () + 3599999999) // 3600000000 AS BIGINT)) AS count FROM d)
SELECT event_id, CAST(i AS INTEGER) AS presentation, duration, least(count, (upto - duration + 3599999999) // 3600000000) AS tick,
  least(count, (upto + 3599999999) // 3600000000) AS until, count FROM c""",
    "timeline_frames": f"WITH {SAMPLES_CTE} SELECT user_id, unnest(range(f, t)) AS n, presentation FROM h WHERE f < t",
}


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline_samples(spark, sf_dir).groupBy("user_id").agg(F.first("count").alias("count"))
    return T.segment_starts(s, "user_id", "count")


def resolve_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 frames of the concatenation, asked for once for each order line: which user and local frame they show."""
    asked = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50000).alias("n"))
    return T.resolve(asked, segment_table(spark, sf_dir), "n", "user_id", missing="drop").select("l_orderkey", "l_linenumber", "n", "user_id", "local")


def gif_webp_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.gif_delay(F.col("p_size")).alias("gif_us"), T.webp_delay(F.col("p_size")).alias("webp_us"))


DENOMINATORS = [0, 1, 24, 30, 1000, 90, 65521, 60000]


def apng_timebases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as animations: each line's quantity is a delay's numerator, its denominator goes by the part."""
    li = numbered_lines(spark, sf_dir)
    den = F.get(F.array(*[F.lit(d) for d in DENOMINATORS]), (F.col("l_partkey") % len(DENOMINATORS)).cast("int"))
    li = li.select("l_orderkey", "pos", F.col("l_quantity").cast("long").alias("num"), den.alias("den"))
    return T.apng_delays(li, "l_orderkey", "num", "den").select("l_orderkey", "pos", "ticks", "duration")


#: Line numbers repeat within an order, so lines are numbered anew.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return load(spark, sf_dir, "lineitem").withColumn("pos", pos)


def composition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as coded pictures: quantity is the duration; instants are shifted later and later, in some orders beyond the end,
    and every third order is cut after 60 units."""
    shift, cut = F.col("pos") * (F.col("l_orderkey") % 20) - 5, F.when(F.col("l_orderkey") % 3 == 0, F.lit(60).cast("long"))
    li = numbered_lines(spark, sf_dir).select("l_orderkey", "pos", F.col("l_quantity").cast("long").alias("duration"), shift.alias("offset"), cut.alias("shown"))
    return T.composed(li, "l_orderkey", "pos", "duration", "offset", "shown")


def edit_list_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's timeline shown for half its length only."""
    s = timeline_samples(spark, sf_dir)
    return T.capped(s.withColumn("shown", T.int_div(F.sum("duration").over(W.partitionBy("user_id")), 2)), "user_id", "presentation", "duration", "shown").select("user_id", "presentation", "duration")


QUERIES |= {"segment_table": segment_table, "resolve_frames": resolve_frames, "gif_webp_delays": gif_webp_delays, "apng_timebases": apng_timebases, "composition_order": composition_order, "edit_list_cap": edit_list_cap}
POS_SQL = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INTEGER)"
SEGMENTS = f"{SAMPLES_CTE}, g AS (SELECT user_id, max(count) AS count FROM s GROUP BY user_id), seg AS (SELECT user_id, count, CAST(coalesce(sum(count) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g)"
ORACLE |= {
    "segment_table": f"WITH {SEGMENTS} SELECT user_id, count, start FROM seg",
    "resolve_frames": f"WITH {SEGMENTS}, r AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 50000 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, n, user_id, n - start AS local FROM r ASOF JOIN seg ON r.n >= seg.start WHERE n < start + count",
    "gif_webp_delays": "SELECT p_partkey, p_size::BIGINT * 10000 AS gif_us, p_size::BIGINT * 1000 AS webp_us FROM part",
    "apng_timebases": f"""WITH a AS (SELECT l_orderkey, {POS_SQL} AS pos, CAST(l_quantity AS BIGINT) AS num, CAST(({DENOMINATORS})[CAST(l_partkey % 8 AS INTEGER) + 1] AS BIGINT) AS raw FROM lineitem),
b AS (SELECT *, CASE raw WHEN 0 THEN 100 ELSE raw END AS den FROM a),
c AS (SELECT l_orderkey, list_reduce(list(DISTINCT den), lambda x, y: lcm(x, y)) AS base FROM b GROUP BY 1)
SELECT l_orderkey, pos, CASE WHEN base <= 2147483648 THEN base ELSE 1000 END AS ticks, CASE WHEN base <= 2147483648 THEN num * (base // den) ELSE num * 1000 // den END AS duration FROM b JOIN c USING (l_orderkey)""",
    "composition_order": f"""WITH a AS (SELECT l_orderkey, {POS_SQL} AS pos, CAST(l_quantity AS BIGINT) AS d FROM lineitem),
b AS (SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode, CAST(sum(d) OVER (PARTITION BY l_orderkey) AS BIGINT) AS track_end FROM a),
c AS (SELECT *, greatest(decode + pos * (l_orderkey % 20) - 5, 0) AS instant, CASE WHEN l_orderkey % 3 = 0 AND track_end > 60 THEN 60 ELSE track_end END AS stop FROM b),
n AS (SELECT *, coalesce(lead(instant) OVER (PARTITION BY l_orderkey ORDER BY pos), track_end) AS following FROM c)
SELECT l_orderkey, pos, instant, least(following, stop) - instant AS duration FROM n WHERE instant < stop""",
    "edit_list_cap": f"""WITH {SAMPLES_CTE}, x AS (SELECT user_id, presentation, duration, CAST(sum(duration) OVER (PARTITION BY user_id) AS BIGINT) // 2 AS shown,
CAST(coalesce(sum(duration) OVER (PARTITION BY user_id ORDER BY presentation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM s)
SELECT user_id, presentation, least(duration, shown - f) AS duration FROM x WHERE f < shown""",
}
