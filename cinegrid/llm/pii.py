"""Personal data: bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the base matches of four kinds (email, ip, card, phone). What stands around an instance, its two words before or the
word on either side, is a lexical pattern of the instance's kind. Patterns and instances form a graph: an instance is a
distinct string, seeds and other identifier-like strings alike (tokens of a kind's shape, and runs of digits, spaces and
brackets, so numbers written in groups too). Rounds go on until one finds nothing new:

* a pattern's trust is the mass of its known instances (1 for a seed, FOUND_WEIGHT for one found before) over the number of
  all its instances, known or not; it counts from PATTERN_TRUST on, if PATTERN_SUPPORT distinct instances are known;
* an instance's score is the noisy-or of its trusted patterns' trusts; from ACCEPT on it is found, and supports patterns from
  then on, so a context that only found instances share can become a pattern too.

Both only ever grow, so the rounds end. Found instances are added to the spans wherever they stand (the longer one where two
overlap by containment); base spans stay, and nothing is added that overlaps one.

A null text counts as empty. Offsets count code points, ends are exclusive. Every row of the table gives one row, repeated
ids included; an empty table gives none; other columns are ignored. Texts of any length are read whole, and no pattern
has a nested repeat, so the scan neither backtracks far nor recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PATTERN_SUPPORT = 3
PATTERN_TRUST = 0.5
FOUND_WEIGHT = 0.9
ACCEPT = 0.8
#: Trusted patterns and instance scores (a short string and a number each) are broadcast up to so many rows.
BROADCAST_ROWS = 100_000

SPACE = r"\x20\x09-\x0D"
#: In a text whose dots before anything but a domain character are replaced, a domain holds no empty label, so one class
#: is enough for all labels. A match starts where a run of local characters starts or the last match ended.
LONE_DOT = r"\.(?![A-Za-z0-9-])"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
#: Every ip, card or phone match lies inside one such run, and no two runs touch the same match.
RUN = r"\+?[0-9][\x20().0-9-]{5,}[0-9]"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What parts the card-like stretches of a run: anything but one space or hyphen between digits.
CARD_BREAK = r"[\x20().+-]{2,}|[().+]"
#: A token with a digit or an @.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: The last two words of a gap, and its first one.
LAST_TWO = rf"(?<![^{SPACE}])(?:([^{SPACE}]++)[{SPACE}]++)?+([^{SPACE}]++)[{SPACE}]*+\z"
FIRST = rf"\A[{SPACE}]*+([^{SPACE}]++)"


def _pieces(stream: str, text: Column, pattern: str) -> Column:
    """Array of (stream, at, gap, hit, l2, l1, head, glued, glues): each match with the length of the text since the last one, the
    words around, and whether that text ends or begins with a letter or digit; the last element has no match but the head of
    what follows the last one."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def piece(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(stream).alias("stream"), i.alias("at"), F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"),
            F.regexp_extract(x["gap"], LAST_TWO, 1).alias("l2"), F.regexp_extract(x["gap"], LAST_TWO, 2).alias("l1"), F.regexp_extract(x["gap"], FIRST, 1).alias("head"),
            F.right(x["gap"], F.lit(1)).rlike(r"[\p{L}\p{N}]").alias("glued"), F.left(x["gap"], F.lit(1)).rlike(r"[\p{L}\p{N}]").alias("glues"),
        )

    return F.transform(zipped, piece)


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def _shape(v: Column) -> Column:
    """The kind that an identifier-like token or run could be of, or null."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return (
        F.when(v.contains("@") & v.rlike("[A-Za-z]"), 0)
        .when(v.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), 1)
        .when(v.rlike("^[0-9 -]+$") & digits.between(13, 19), 2)
        .when(v.rlike("^[+0-9(). -]+$") & digits.between(7, 15), 3)
    )


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Spans of every text: row, id, kind, s, e, v, l2, l1, r1, base; a row without kind for each text besides."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), text_or_empty(text).alias("text"))
    has_digit = F.col("text").rlike("[0-9]")
    none = F.array().cast("array<struct<stream:string,at:int,gap:bigint,hit:string,l2:string,l1:string,head:string,glued:boolean,glues:boolean>>")
    mail = F.when(F.col("text").contains("@"), _pieces("mail", F.regexp_replace("text", LONE_DOT, "_"), EMAIL)).otherwise(none)
    runs = F.when(has_digit, _pieces("run", F.col("text"), RUN)).otherwise(none)
    tokens = F.when(has_digit | F.col("text").contains("@"), _pieces("token", F.col("text"), TOKEN)).otherwise(none)
    p = d.select("row", "id", F.explode_outer(F.concat(mail, runs, tokens)).alias("x")).select("row", "id", "x.*")

    inside = W.partitionBy("row", "stream").orderBy("at")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(inside.rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumns({"e": upto, "r1": F.lead("head").over(inside), "apart": ~(F.col("glued") | F.coalesce(F.lead("glues").over(inside), F.lit(False)))}).withColumn("s", F.col("e") - F.length("hit"))
    p = p.withColumns({c: _word(F.col(c)) for c in ("l2", "l1", "r1")})
    first = F.coalesce(F.col("at"), F.lit(0)) == 0

    # inside a run: the ips and the card-like stretches, again by their distance from what came before
    hit = F.col("hit")
    ips = F.when(hit.contains("."), F.arrays_zip(F.split(hit, IP, -1).alias("gap"), F.regexp_extract_all(hit, F.lit(IP), F.lit(0)).alias("v")))
    cards = F.arrays_zip(F.regexp_extract_all(hit, F.lit(CARD_BREAK), F.lit(0)).alias("gap"), F.split(hit, CARD_BREAK, -1).alias("v"))
    empty = F.array().cast("array<struct<gap:string,v:string>>")
    both = F.concat(
        F.transform(F.coalesce(ips, empty), lambda x, i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("pre"), F.lit(0).alias("post"), x["v"].alias("v"))),
        F.transform(cards, lambda x, i: F.struct(F.lit(2).alias("kind"), i.alias("i"), F.lit(0).alias("pre"), F.coalesce(F.length(x["gap"]), F.lit(0)).alias("post"), x["v"].alias("v"))),
        F.array(F.struct(F.lit(3).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("pre"), F.lit(0).alias("post"), hit.alias("v"))),
        F.when(first, F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("pre"), F.lit(0).alias("post"), F.lit(None).cast("string").alias("v")))).otherwise(F.array()),
    )
    whole = F.array(F.struct(F.when(F.col("stream") == "mail", 0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("pre"), F.lit(0).alias("post"), hit.alias("v")))
    # a text without any piece has one row whose stream is null; it stays as the row without kind
    q = p.withColumn("sub", F.when(F.col("stream") == "run", F.when(hit.isNull(), F.slice(both, -1, 1)).otherwise(both)).otherwise(whole))
    q = q.select("row", "id", "stream", F.col("s").alias("run_s"), "l2", "l1", "r1", "at", "apart", F.explode("sub").alias("y")).select("*", "y.*").drop("y")
    nested = W.partitionBy("row", "stream", "run_s", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    e = F.col("run_s") + F.sum(F.col("pre") + F.coalesce(F.length("v"), F.lit(0)) + F.col("post")).over(nested) - F.col("post")
    q = q.withColumn("e", e).withColumn("s", F.col("e") - F.length("v"))

    digits = F.length(F.regexp_replace("v", "[^0-9]", ""))
    octets = r"\.".join([OCTET] * 4)
    valid = (
        F.when(F.col("v").isNull(), False)
        .when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("v").rlike(f"^{octets}$"))
        .when(F.col("kind") == 2, digits.between(13, 19) & F.call_function("luhn_check", F.regexp_replace("v", "[^0-9]", "")))
        .when(F.col("kind") == 3, F.col("v").startswith("+") & digits.between(9, 15))
        .otherwise(False)
    )
    q = q.withColumn("base", valid)
    # identifier-like tokens lose the punctuation around them
    lead, trail = F.length(F.regexp_extract("v", r"^[^\p{L}\p{N}+]*", 0)), F.length(F.regexp_extract("v", r"[^\p{L}\p{N}]*\z", 0))
    token = F.col("stream") == "token"
    cut = F.expr("substring(v, lead + 1, length(v) - lead - trail)")
    q = q.withColumns({"lead": lead, "trail": trail}).withColumns({
        "v": F.when(token, cut).otherwise(F.col("v")), "s": F.when(token, F.col("s") + F.col("lead")).otherwise(F.col("s")), "e": F.when(token, F.col("e") - F.col("trail")).otherwise(F.col("e")),
    })
    run = (F.col("stream") == "run") & (F.col("kind") == 3) & ~F.col("base") & F.col("apart")
    q = q.withColumn("open", token | run).withColumn("kind", F.when(F.col("open"), _shape(F.col("v"))).otherwise(F.col("kind")))
    # what overlaps a base span is no candidate
    by_start = W.partitionBy("row").orderBy("s", F.col("base").desc())
    reach = F.max(F.when(F.col("base"), F.col("e"))).over(by_start.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("s"))).over(by_start.rowsBetween(0, W.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("s")) & (F.coalesce(ahead, F.col("e")) >= F.col("e"))
    q = q.withColumn("candidate", F.col("open") & F.col("kind").isNotNull() & free)
    marker = (F.coalesce(F.col("at"), F.lit(0)) == 0) & ~F.col("base") & ~F.col("candidate")
    q = q.where(F.col("base") | F.col("candidate") | marker)
    kind = F.when(F.col("base") | F.col("candidate"), F.col("kind"))
    return q.select("row", "id", kind.alias("kind"), "s", "e", F.lower("v").alias("v"), "l2", "l1", "r1", "base")


def discover(spans: DataFrame) -> DataFrame:
    """The instances (kind, v) that are found beside the seeds. spans: what `scan` returned, saved."""
    scratch = Scratch(spans.sparkSession, "pii-graph")
    contexts = F.array_compact(F.array(
        F.when((F.col("l2") != "") & (F.col("l1") != ""), F.concat_ws(" ", F.lit("<"), "l2", "l1")),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat_ws(" ", F.lit("="), "l1", "r1")),
    ))
    edges = spans.where("kind is not null").select("kind", "v", "base", F.explode(contexts).alias("context"))
    edges = edges.groupBy("kind", "context", "v").agg(F.max("base").alias("seed"))
    # a context of fewer instances can never have the support it needs
    enough = edges.groupBy("kind", "context").agg(F.count("*").alias("all")).where(F.col("all") >= PATTERN_SUPPORT)
    edges = edges.join(scratch.save(enough), ["kind", "context"]).withColumn("mass", F.col("seed").cast("double"))
    edges = scratch.save(edges)
    found = 0
    while True:
        mass, known = F.sum("mass"), F.sum((F.col("mass") > 0).cast("int"))
        trusted = edges.groupBy("kind", "context").agg((mass / F.first("all")).alias("trust"), known.alias("known"))
        trusted = scratch.save(trusted.where((F.col("known") >= PATTERN_SUPPORT) & (F.col("trust") >= PATTERN_TRUST)).drop("known"))
        doubt = F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))
        scores = edges.where("not seed").join(checked_broadcast(trusted, BROADCAST_ROWS), ["kind", "context"]).groupBy("kind", "v").agg((1 - doubt).alias("score"))
        scores = scratch.save(scores.where(F.col("score") >= ACCEPT).select("kind", "v"))
        now = scores.count()
        if now == found:  # none is ever lost, so these are the same ones
            return scores
        found, old = now, edges
        hit = checked_broadcast(scores.withColumn("hit", F.lit(True)), BROADCAST_ROWS)
        edges = old.drop("mass").join(hit, ["kind", "v"], "left").withColumn("mass", F.when(F.col("seed"), 1.0).when(F.col("hit"), FOUND_WEIGHT).otherwise(0.0)).drop("hit")
        edges = scratch.save(edges)
        scratch.drop(old)


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: base counts by kind, the digest of the base spans, all spans, and the added spans' number."""
    spans = Scratch(docs.sparkSession, "pii").save(scan(docs, key, text))
    found = discover(spans)
    added = spans.where("not base and kind is not null").join(checked_broadcast(found, BROADCAST_ROWS), ["kind", "v"], "left_semi")
    by_start = W.partitionBy("row").orderBy("s", F.desc("e"), "kind").rowsBetween(W.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("e").over(by_start)).where(F.col("reach").isNull() | (F.col("e") > F.col("reach"))).drop("reach")
    both = spans.where("base or kind is null").unionByName(added).select("row", "id", "kind", "s", "e", "base")
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(keep: Column) -> Column:
        spans = F.array_sort(F.collect_list(F.when(keep, F.struct("kind", "s", "e"))))
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))

    counts = [F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    out = both.groupBy("row", "id").agg(
        *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("kind").isNotNull()).alias("spans"),
        F.count(F.when(~F.col("base") & F.col("kind").isNotNull(), 1)).alias("n_added"),
    )
    return out.drop("row").withColumnRenamed("id", key)
