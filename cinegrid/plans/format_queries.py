"""Identification, validation, metadata and sink planning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions import identify as I
from cinegrid.functions import metadata as M
from cinegrid.functions import tables as t
from cinegrid.operators import sink_plan as P
from cinegrid.operators import validate as V
from cinegrid.plans.timeline_queries import POS_SQL, load, numbered_lines

#: Heads that the documents' first bytes are appended to, in hex; near misses among them.
HEADS = ["", "0000001C6674797061766966", "000000186674797068656963", "0000001C6674797069736F6D", "0000000C6A5020200D0A870A", "FF4F", "89504E470D0A1A0A", "89504E470D0A1A", "FFD8FF", "474946383961", "474946383861", "524946460000000057454250", "5249464600000000574156", "6661726266656C64", "716F6966", "44445320", "424D", "762F3101", "49492A00", "4D4D002B", "233F52414449414E4345", "233F52474245", "50360A", "5037", "503858", "FF0A"]


def picked(index, values: list[str]):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    head = F.concat(F.unhex(picked(F.col("doc_id") % len(HEADS), HEADS)), F.encode(F.coalesce(F.substring("text", 1, 12), F.lit("")), "UTF-8"))
    return d.select("doc_id", F.substring(head, 1, 20).alias("head"))


def identify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("doc_id", I.identify(F.col("head")).alias("format"))


EXTS = ["avif", "BMP", "dib", "dds", "farbfeld", "gif", "Heic", "avci", "pic", "cur", "jpx", "jfif", "jxl", "apng", "pam", "qoi", "vst", "tif", "webp", "txt", "", "tar.PNG"]


def route_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    # named once: each is used many times, and what it takes would otherwise be written out as often
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("."), picked(F.col("page_id") % len(EXTS), EXTS))
    head = F.unhex(picked(F.floor(F.col("page_id") / 3) % len(HEADS), HEADS))
    p = p.select("page_id", name.alias("name"), head.alias("head"))
    head, name = F.col("head"), F.col("name")
    return p.select("page_id", I.route(head, name).alias("route"), I.from_extension(name).alias("named"), I.has_signature(I.from_extension(name)).alias("has_signature"))


def bare_dib(spark: SparkSession, sf_dir: str) -> DataFrame:
    def le(v, size: int):
        return F.substring(F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)]), 1, size)

    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("a"), (F.col("p_size") % 9).alias("b"), (F.floor(F.col("p_partkey") / 8) % 5).cast("long").alias("compression"))
    size = picked(F.col("a"), ["12", "40", "52", "56", "108", "124", "13", "16777228"]).cast("long")
    depth = picked(F.col("b"), ["1", "2", "4", "8", "16", "24", "32", "3", "264"]).cast("long")
    p = p.select("p_partkey", size.alias("size"), depth.alias("depth"), "compression")
    zero = F.lit(0).cast("long")
    head = F.concat(le(F.col("size"), 4), le(zero, 6), le(F.when(F.col("size") == 12, F.col("depth")).otherwise(0).cast("long"), 2), le(zero, 2), le(F.col("depth"), 2), le(F.col("compression"), 4))
    return p.select("p_partkey", I.is_bare_dib(head).alias("bare"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).select("l_orderkey", "pos", "l_returnflag", "l_linestatus")


def validate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.first_mismatch(lines(spark, sf_dir), "l_orderkey", "pos", ["l_returnflag", "l_linestatus"])
    return m.select("l_orderkey", "pos", F.col("seen.l_returnflag").alias("flag"), F.col("seen.l_linestatus").alias("status"), F.col("first.l_returnflag").alias("first_flag"), F.col("first.l_linestatus").alias("first_status"))


def variable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clip_info(lines(spark, sf_dir), "l_orderkey", "pos", ["l_returnflag", "l_linestatus"])


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size"), (F.col("p_partkey") % 24).cast("int").alias("a"), (F.floor(F.col("p_partkey") / 3) % 20).cast("int").alias("b"), (F.floor(F.col("p_partkey") / 7) % 16).cast("int").alias("c"))


def frame_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_codes(spark, sf_dir)
    family = picked(F.col("p_size") % 3, ["Gray", "RGB", "YUV"])
    maybe = lambda c: F.when(F.col(c) > 0, F.col(c) - 1)  # noqa: E731  0 stands for a code that is not stated
    props = M.frame_props(family, maybe("a"), maybe("b"), maybe("c"), F.when(F.col("p_partkey") % 3 < 2, F.col("p_partkey") % 3 == 1), F.col("p_partkey") % 4, F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", *props, M.usable_matrix(F.col("c")).alias("usable"))


def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", P.render_template("out/100%%/f%06d-%d.png", F.col("p_partkey") * 37).alias("path"))


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.select("page_id", P.source_name(F.col("path"), F.col("page_id") % 2 == 1, F.col("page_id")).alias("name"), P.source_name(F.col("path"), F.lit(False), F.col("page_id")).alias("still"))


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_pages(spark, sf_dir).select("page_id", "name")


def destination_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conflicts(named_pages(spark, sf_dir), "still", "page_id").withColumnRenamed("still", "path")


def save_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 997).alias("frame"))
    return P.ledger(e, "frame", "event_id").select("event_id", "frame", "saved", "performed")


def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_codes(spark, sf_dir)
    family = picked(F.col("p_size") % 3, ["Gray", "RGB", "YUV"])
    sample = picked(F.col("a") % 4, ["integer", "integer", "integer", "float"])
    bits = F.when(sample == "float", F.when(F.col("b") == 0, 16).otherwise(32)).otherwise(F.col("b") % 12 + 7)
    depth = picked(F.col("c") % 6, ["0", "1", "2", "4", "8", "16"]).cast("int")
    return p.select("p_partkey", *P.write_plan(family, sample, bits, F.col("p_partkey") % 5 == 0, F.when(depth > 0, depth)))


def ico_best_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5).cast("long").alias("bpp"), F.floor(F.col("p_retailprice") / 100).cast("long").alias("area"), F.col("p_partkey").alias("position"))
    return P.best_icon_entry(p, "p_brand", "bpp", "area", "position")


def listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def sql_pick(index: str, values: list[str]) -> str:
    return f"([{listed(values)}])[CAST({index} AS INTEGER) + 1]"


HEAD_SQL = "SELECT doc_id, substr({pick} || hex(encode(coalesce(substr(text, 1, 12), ''))), 1, 40) AS h FROM documents".format(pick=sql_pick(f"doc_id % {len(HEADS)}", HEADS))
IDENTIFY_SQL = """CASE
 WHEN substr(h, 9, 8) = '66747970' AND length(h) >= 24 THEN CASE WHEN substr(h, 17, 8) IN ('61766966', '61766973') THEN 'avif'
   WHEN substr(h, 17, 8) IN ('68656963', '68656978', '68657663', '68657678', '6D696631', '6D736631', '6865696D', '68656973', '6865766D', '68657673') THEN 'heif' END
 WHEN starts_with(h, '0000000C6A5020200D0A870A') OR starts_with(h, 'FF4F') THEN 'jp2'
 WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg'
 WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif'
 WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp'
 WHEN starts_with(h, '6661726266656C64') THEN 'farbfeld' WHEN starts_with(h, '716F6966') THEN 'qoi' WHEN starts_with(h, '44445320') THEN 'dds'
 WHEN starts_with(h, '424D') THEN 'bmp' WHEN starts_with(h, '762F3101') THEN 'exr'
 WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') OR starts_with(h, '49492B00') OR starts_with(h, '4D4D002B') THEN 'tiff'
 WHEN starts_with(h, '233F52414449414E4345') OR starts_with(h, '233F52474245') THEN 'hdr'
 WHEN regexp_matches(h, '^503[1-7]($|09|0A|0C|0D|20)') THEN 'pnm'
 WHEN starts_with(h, '0000000C4A584C200D0A870A') OR starts_with(h, 'FF0A') THEN 'jxl' END"""
NAMED_SQL = "CASE " + " ".join(f"WHEN ext IN ({listed(e)}) THEN '{f}'" for f, e in t.EXTENSIONS.items()) + " END"
URL = "regexp_replace(url, '[?#].*$', '')"
STEM = "regexp_replace(regexp_extract({u}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')".format(u=URL)

QUERIES = {
    "identify_content": identify_content, "route_by_name": route_by_name, "bare_dib": bare_dib, "validate_sequence": validate_sequence, "variable_flag": variable_flag,
    "frame_props": frame_props, "path_template": path_template, "source_names": source_names, "destination_conflicts": destination_conflicts, "save_ledger": save_ledger,
    "write_plan": write_plan, "ico_best_entry": ico_best_entry,
}
ORACLE = {
    "identify_content": f"WITH d AS ({HEAD_SQL}) SELECT doc_id, {IDENTIFY_SQL} AS format FROM d",
    "route_by_name": f"""WITH p AS (SELECT page_id, lower(regexp_extract({URL} || '.' || {sql_pick(f'page_id % {len(EXTS)}', EXTS)}, '[^/.][^/]*\\.([^./]*)$', 1)) AS ext, {sql_pick(f'(page_id // 3) % {len(HEADS)}', HEADS)} AS h FROM pages),
n AS (SELECT page_id, h, {NAMED_SQL} AS named FROM p)
SELECT page_id, named, coalesce({IDENTIFY_SQL}, CASE WHEN named <> 'bmp' THEN named END) AS route, named NOT IN ('tga', 'ico') AS has_signature FROM n""",
    "bare_dib": f"""WITH p AS (SELECT p_partkey, {sql_pick('p_partkey % 8', [12, 40, 52, 56, 108, 124, 13, 16777228])} AS size, {sql_pick('p_size % 9', [1, 2, 4, 8, 16, 24, 32, 3, 264])} AS depth, (p_partkey // 8) % 5 AS c FROM part),
q AS (SELECT *, CASE WHEN size = 12 THEN 0 ELSE c END AS code FROM p)
SELECT p_partkey, size IN (12, 40, 52, 56, 108, 124) AND (code = 0 AND depth IN (1, 2, 4, 8, 16, 24, 32) OR code = 1 AND depth = 8 OR code = 2 AND depth = 4 OR code = 3 AND depth IN (16, 32)) AS bare FROM q""",
    "validate_sequence": f"""WITH n AS (SELECT *, {POS_SQL} AS pos FROM lineitem),
w AS (SELECT *, first_value(l_returnflag) OVER o AS ff, first_value(l_linestatus) OVER o AS fs FROM n WINDOW o AS (PARTITION BY l_orderkey ORDER BY pos)),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS r FROM w WHERE l_returnflag <> ff OR l_linestatus <> fs)
SELECT l_orderkey, pos, l_returnflag AS flag, l_linestatus AS status, ff AS first_flag, fs AS first_status FROM x WHERE r = 1""",
    "variable_flag": """WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) > 1 AS variable, arg_min(l_returnflag, l_linenumber) AS f, arg_min(l_linestatus, l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, variable, CASE WHEN NOT variable THEN f END AS l_returnflag, CASE WHEN NOT variable THEN s END AS l_linestatus FROM g""",
    "frame_props": f"""WITH p AS (SELECT p_partkey, {sql_pick('p_size % 3', ['Gray', 'RGB', 'YUV'])} AS fam, nullif(p_partkey % 24, 0) - 1 AS a, nullif((p_partkey // 3) % 20, 0) - 1 AS b, nullif((p_partkey // 7) % 16, 0) - 1 AS c, (p_partkey // 7) % 16 AS raw FROM part)
SELECT p_partkey, CAST(CASE WHEN a IN ({listed(t.PRIMARIES)}) THEN a END AS INTEGER) AS primaries, CAST(CASE WHEN b IN ({listed(t.TRANSFERS)}) THEN b END AS INTEGER) AS transfer,
CAST(CASE fam WHEN 'RGB' THEN 0 WHEN 'YUV' THEN CASE WHEN c IN ({listed(t.MATRICES)}) THEN c ELSE 5 END END AS INTEGER) AS matrix,
CASE WHEN fam = 'YUV' AND p_partkey % 3 <> 1 THEN 'limited' ELSE 'full' END AS range,
CAST(CASE WHEN fam = 'YUV' AND p_partkey % 2 = 0 THEN CASE p_partkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 2 END END AS INTEGER) AS chroma_location, 0 AS field_based, raw NOT IN (0, 2) AS usable FROM p""",
    "path_template": "SELECT p_partkey, printf('out/100%%/f%06d-%d.png', p_partkey * 37, p_partkey * 37) AS path FROM part",
    "source_names": f"SELECT page_id, {STEM} || CASE WHEN page_id % 2 = 1 THEN printf('-%04d', page_id) ELSE '' END || '.png' AS name FROM pages",
    "destination_conflicts": f"SELECT {STEM} || '.png' AS path, min(page_id) AS first, max(page_id) AS last, count(*) AS frames FROM pages GROUP BY 1 HAVING count(*) > 1",
    "save_ledger": "SELECT event_id, event_id % 997 AS frame, true AS saved, row_number() OVER (PARTITION BY event_id % 997 ORDER BY event_id) = 1 AS performed FROM events",
    "write_plan": f"""WITH p AS (SELECT p_partkey, {sql_pick('p_size % 3', ['Gray', 'RGB', 'YUV'])} AS fam, p_partkey % 24 % 4 = 3 AS fl, (p_partkey // 3) % 20 AS b, p_partkey % 5 = 0 AS al, nullif({sql_pick('(p_partkey // 7) % 16 % 6', [0, 1, 2, 4, 8, 16])}, 0) AS dep FROM part),
q AS (SELECT *, CASE WHEN fl THEN CASE WHEN b = 0 THEN 16 ELSE 32 END ELSE b % 12 + 7 END AS bits FROM p),
r AS (SELECT *, CASE WHEN fl THEN 16 ELSE bits END AS src FROM q), s AS (SELECT *, coalesce(dep, CASE WHEN src > 8 THEN 16 ELSE 8 END) AS st, CASE WHEN fam = 'YUV' AND NOT fl THEN 'yuv' WHEN fl THEN 'float' ELSE 'integer' END AS kind FROM r),
u AS (SELECT *, CASE WHEN kind = 'integer' THEN src ELSE least(src, st) END AS car FROM s)
SELECT p_partkey, kind, CAST(st AS INTEGER) AS stored, CAST(car AS INTEGER) AS carried, CASE WHEN car = st THEN 'direct' WHEN car > st THEN 'reduce' ELSE 'widen' END AS storage,
CASE WHEN fam = 'Gray' THEN CASE WHEN al THEN 4 ELSE 0 END ELSE CASE WHEN al THEN 6 ELSE 2 END END AS color_type, car < st AS sbit,
CASE WHEN fam = 'YUV' AND fl THEN 'float yuv' WHEN fl AND bits <> 32 THEN 'float depth' WHEN NOT fl AND (bits < 8 OR bits > 16) THEN 'integer depth' WHEN st < 8 AND (fam <> 'Gray' OR al) THEN 'narrow word' END AS refused FROM u""",
    "ico_best_entry": "WITH p AS (SELECT p_brand, p_size % 5 AS bpp, CAST(floor(p_retailprice / 100) AS BIGINT) AS area, p_partkey AS position FROM part) SELECT p_brand, CAST(bpp AS BIGINT) AS bpp, area, position FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY bpp DESC, area DESC, position DESC) AS r FROM p) WHERE r = 1",
}
