"""Substring dedup by paragraph MinHash banding.

Two kinds of paragraphs are signed:

* stretches, content-defined: one ends where the hash of a word pair is the least within REACH words on either side, so a
  passage is cut alike wherever it stands, in the middle of a line too; 2 * REACH + 1 words on average;
* lines of MIN_WORDS words or more, which near copies with an edit in every stretch still share.

1. Every paragraph of SHINGLE words or more gets a MinHash signature over its word shingles. `tune_bands` picks the bands for
   a recall of RECALL at the similarity asked for. (The words before a text's first cut and after its last one may be fewer;
   step 4 reaches them.)
2. Paragraphs that collide in a band are compared: with the band's first one and with their neighbour, then, where a band
   still holds several components, across components. There the join itself leaves out what sizes and bit sketches of the
   shingle sets rule out. Exact Jaccard of the shingle sets decides.
3. Connected components of paragraphs are clusters. A cluster in two different texts is repeated.
4. A repeated line is a repeated passage. Adjoining repeated stretches of a text make a run; of a run, what is covered by
   windows of MIN_WORDS words that stand word for word in another text too is a repeated passage, which equal window hashes
   tell without pairs. Windows reach beyond the run at both ends; within a long run they start where stretches do.
5. In each cluster the smallest document id keeps its paragraph; in other documents that paragraph is cut from the passage, so
   every text that is cut somewhere stays somewhere, as itself or as a near copy.

Equal texts (the same words) are treated once and answered for every document; they repeat each other whole if they have
MIN_WORDS words. Words are what is between white space, case counts. Null and empty texts have no passages. Rows that share
an id are separate documents of that id; a null id keeps only if its cluster has no other. An empty table gives an empty
result; other columns are carried by `remove_repeats` and ignored by `repeated_passages`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast
from cinegrid.llm.components import connected_components
from cinegrid.llm.wordhash import MULTIPLIERS, WordHasher, Words, mix, slices

REACH = 4
SHINGLE = 5
PERCENT = 80
RECALL = 0.98
#: Minima a band, of a stretch (a handful of shingles, compared cheaply) and of a line.
ROWS_A_BAND, ROWS_A_LINE_BAND = 2, 4
MIN_WORDS = 50
#: Words on either side of a long run in which windows are tried, and the numbers of 64 bits in a set's sketch.
EDGE, SKETCH_LONGS = 3 * REACH, 8
#: Tables of a few numbers a row are broadcast up to so many rows; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Tables of arrays are broadcast up to so many elements.
BROADCAST_ELEMENTS = 2_000_000


def tune_bands(percent: int = PERCENT, rows: int = ROWS_A_BAND, recall: float = RECALL) -> int:
    """The fewest bands of `rows` minima each that collide for sets of that similarity with at least that probability."""
    bands = 1
    while 1 - (1 - (percent / 100) ** rows) ** bands < recall:
        bands += 1
    return bands


def text_keys(w: Words) -> np.ndarray:
    """A hash of each text's word sequence; 0 for texts without words."""
    within = np.arange(len(w.start)) - w.first[w.text]
    spread = mix(w.hash + (within.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    return mix(total[w.first[1:]] - total[w.first[:-1]])


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every paragraph, as word numbers."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    pair = w.hash.copy()
    pair[:-1] += w.hash[1:] * np.uint64(MULTIPLIERS[3])
    g = mix(pair)
    last = np.zeros(n, bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    g[last] = most  # a text's last word starts no pair
    cut = ~last
    for k in range(1, REACH + 1):
        if n > k:
            same = w.text[k:] == w.text[:-k]
            cut[k:] &= ~same | (g[k:] < g[:-k])
            cut[:-k] &= ~same | (g[:-k] <= g[k:])
    firsts = w.first[:-1][np.diff(w.first) > 0]
    cut[firsts] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    return start, end


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every line of MIN_WORDS words or more, as word numbers."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.cumsum(w.data == 10)[w.start]
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (w.text[1:] != w.text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    long = end - start >= MIN_WORDS
    return start[long], end[long]


def window_hashes(w: Words, size: int) -> np.ndarray:
    """The hash of the `size` words from each word on; meaningless where the text ends before."""
    n = len(w.start)
    out = np.zeros(n, np.uint64)
    mul = 0x2545F4914F6CDD1D
    for j in range(size):
        if n > j:
            out[: n - j] += w.hash[j:] * np.uint64(pow(mul, j + 1, 1 << 64))
    return mix(out)


def _each(hasher: WordHasher, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part, texts in slices(batch, "text"):
        yield part, hasher(texts, lower=False)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def grams_of(w: Words) -> np.ndarray:
    """The shingle from each word on; one more than there are words, and meaningless where a text ends before."""
    gram = np.zeros(len(w.start), np.uint64)
    for j in range(SHINGLE):
        gram[: max(0, len(gram) - j)] += w.hash[j:] * np.uint64(MULTIPLIERS[j])
    return np.append(mix(gram), np.uint64(0))


class Units:
    """The paragraphs of some texts: text number, start, end, whether a line, and a key that tells their words."""

    def __init__(self, w: Words, gram: np.ndarray):
        (s1, e1), (s2, e2) = paragraphs(w), lines(w)
        enough = e1 - s1 >= SHINGLE
        self.start, self.end = np.concatenate([s1[enough], s2]), np.concatenate([e1[enough], e2])
        self.line = np.arange(len(self.start)) >= enough.sum()
        self.text = w.text[self.start]
        self.spans = np.stack([self.start, self.end - SHINGLE + 1], 1).reshape(-1)
        words = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash * np.uint64(3) + np.uint64(1)), dtype=np.uint64)])
        if len(self.start):
            signed = np.add.reduceat(mix(gram + np.uint64(77)), self.spans)[::2]
            self.key = mix(signed ^ mix(words[self.end] - words[self.start]) + ((self.end - self.start) * 2 + self.line).astype(np.uint64))
        else:
            self.key = np.zeros(0, np.uint64)


def unit_table(docs: DataFrame) -> DataFrame:
    """docs: id, x, text. For each row id, x, t (its text's key), words and units, its paragraphs: start, end, key, line.

    Of a text that a task meets again the units are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for part, w in _each(hasher, batch):
                t, u = text_keys(w), Units(w, grams_of(w))
                new = np.array([k not in seen and not seen.add(k) for k in t.tolist()], bool)
                order = np.argsort(u.text, kind="stable")
                order = order[new[u.text[order]]] if len(order) else order
                ends = np.concatenate([[0], np.cumsum(np.bincount(u.text[order], minlength=part.num_rows))]).astype(np.int32)
                at = w.first[u.text[order]]
                units = pa.StructArray.from_arrays(
                    [pa.array((u.start[order] - at).astype(np.int32)), pa.array((u.end[order] - at).astype(np.int32)), _long(u.key[order]), pa.array(u.line[order])], names=["start", "end", "key", "line"]
                )
                own = [part.column(part.schema.get_field_index(c)) for c in ("id", "x")]
                yield pa.RecordBatch.from_arrays([*own, _long(t), _long(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(ends), units)], names=["id", "x", "t", "words", "units"])

    return docs.mapInArrow(run, "id long, x long, t long, words long, units array<struct<start:int,end:int,key:bigint,line:boolean>>")


def band_table(docs: DataFrame, percent: int) -> DataFrame:
    """key and band of every paragraph's bands. A second scan: hashing anew costs less than keeping them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for _, w in _each(hasher, batch):
                gram = grams_of(w)
                u = Units(w, gram)
                new = np.array([k not in seen and not seen.add(k) for k in text_keys(w).tolist()], bool)
                for line, rows in ((False, ROWS_A_BAND), (True, ROWS_A_LINE_BAND)):
                    pick = np.flatnonzero((u.line == line) & new[u.text]) if len(u.text) else u.text
                    if not len(pick):
                        continue
                    _, one = np.unique(u.key[pick], return_index=True)  # copies within the slice go once
                    pick = np.sort(pick[one])
                    spans, keys, bands = np.stack([u.spans[::2][pick], u.spans[1::2][pick]], 1).reshape(-1), [], []
                    for b in range(tune_bands(percent, rows)):
                        value = np.full(len(pick), b + 1000 * line, np.uint64)
                        for r in range(rows):
                            seed = np.uint64(pow(0xD1342543DE82EF95, b * rows + r + 1, 1 << 64))
                            h = gram * seed
                            value = mix(value + np.minimum.reduceat(h ^ h >> np.uint64(32), spans)[::2])
                        keys.append(u.key[pick])
                        bands.append(value)
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), _long(np.concatenate(bands))], names=["key", "band"])

    return docs.select("text").mapInArrow(run, "key long, band long")


def at_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs: id, x, text. wanted: rep (id, x), t, spots (an array; a text's own at most). Each wanted text once or, where rows
    repeat, a few times: text, t, spots. Rows meet by id and by the hash of the text, so a common id brings nothing together."""
    wanted = Scratch(docs.sparkSession, "substring-spots").save(wanted.select(F.col("rep.id").alias("rep_id"), F.col("rep.x").alias("rep_x"), "t", "spots"))
    few = (wanted.agg(F.sum(F.size("spots") + 3)).collect()[0][0] or 0) <= BROADCAST_ELEMENTS
    met = (docs["x"] == wanted["rep_x"]) & docs["id"].eqNullSafe(wanted["rep_id"])
    return docs.join(F.broadcast(wanted) if few else wanted, met).select("text", "t", "spots")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of wanted paragraphs (rep, t, start, end, key): key, grams, n and a sketch, in which each shingle
    sets one bit."""
    spots = wanted.groupBy("rep", "t").agg(F.collect_list(F.struct("start", "end", "key")).alias("spots"))  # one text's paragraphs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part, w in _each(hasher, batch):
                mine, gram, keys, sets, sketches = text_keys(w).view(np.int64), grams_of(w), [], [], []
                for i, (t, spots) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if t != mine[i]:
                        continue  # another text of the same hash
                    for s in spots:
                        g = np.unique(gram[w.first[i] + s["start"] : w.first[i] + s["end"] - SHINGLE + 1])
                        bits = np.zeros(64 * SKETCH_LONGS, bool)
                        bits[(g >> np.uint64(20)).astype(np.int64) % len(bits)] = True
                        keys.append(s["key"])
                        sets.append(g.view(np.int64))
                        sketches.append(np.packbits(bits).view(np.int64))
                n = pa.array([len(g) for g in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64())), n, pa.array(sketches, pa.list_(pa.int64()))], names=["key", "grams", "n", "sketch"])

    got = at_texts(docs, spots).mapInArrow(run, "key long, grams array<long>, n int, sketch array<long>")
    return got.groupBy("key").agg(*[F.first(c).alias(c) for c in ("grams", "n", "sketch")])


def room(percent: int, a: str, b: str) -> Column:
    """Whether sizes and sketches leave room for the similarity: a bit of one sketch that the other lacks is a shingle it lacks."""

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.sketch")[i]))) for i in range(SKETCH_LONGS)), F.lit(0))

    common = F.least(F.col(f"{a}.n") - lacking(a, b), F.col(f"{b}.n") - lacking(b, a))
    return (100 + percent) * common >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of paragraph keys whose shingle sets are as similar as asked."""
    one, other = sets.alias("one"), sets.alias("other")
    met = pairs.join(one, F.col("a") == F.col("one.key")).join(other, (F.col("b") == F.col("other.key")) & room(percent, "one", "other"))
    met = met.select("a", "b", F.size(F.array_intersect("one.grams", "other.grams")).alias("common"), (F.col("one.n") + F.col("other.n")).alias("sum"))
    return met.where((100 + percent) * F.col("common") >= percent * F.col("sum")).select("a", "b")


def representatives(texts: DataFrame) -> DataFrame:
    """t and rep (id, x): one row that has the text."""
    return texts.groupBy("t").agg(F.min(F.struct("id", "x")).alias("rep"))


def clusters(docs: DataFrame, found: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """key, root for each paragraph content that is similar to another one. found: the paragraphs; texts: t, rep."""
    scratch = Scratch(docs.sparkSession, "substring-bands")
    # few bands hold more than one content; their rows are all that goes on
    by_band = W.partitionBy("band")
    listed = band_table(docs, percent).withColumns({"lead": F.min("key").over(by_band), "top": F.max("key").over(by_band), "before": F.lag("key").over(by_band.orderBy("key"))})
    listed = scratch.save(listed.where("lead <> top").drop("top"))
    keys = scratch.save(listed.select("key").distinct())
    spots = found.join(checked_broadcast(keys, BROADCAST_ROWS), "key").groupBy("key").agg(F.min(F.struct("t", "start", "end")).alias("s")).select("key", "s.*")
    sets = scratch.save(shingle_sets(docs, spots.join(texts, "t")))
    first = listed.select(F.col("lead").alias("a"), F.col("key").alias("b")).union(listed.where("before is not null").select("before", "key")).where("a <> b").distinct()
    links = scratch.save(verified(first, sets, percent))
    roots = scratch.save(connected_components(links).withColumnRenamed("node", "key"))
    rooted = scratch.save(listed.select("band", "key").distinct().join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    # at their bands with size and sketch, but without the sets
    mixed = scratch.save(rooted.join(scratch.save(mixed), "band").join(sets.drop("grams"), "key"))
    a, b = mixed.alias("a"), mixed.alias("b")
    apart = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & room(percent, "a", "b")
    second = a.join(b, apart).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    more = scratch.save(verified(second, sets, percent))
    return scratch.save(connected_components(scratch.save(links.union(more))).withColumnRenamed("node", "key"))


def passages_of_texts(docs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Repeated passages of each text: t, start, end (words) and its repeated paragraphs (start, end, cluster). texts: what
    `unit_table` returned, saved."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = texts.select("t", F.explode("units").alias("u")).select("t", "u.*")
    reps = scratch.save(representatives(texts))
    roots = clusters(docs, found, reps, percent)
    spots = found.join(checked_broadcast(roots, BROADCAST_ROWS), "key", "left").select("t", "start", "end", "line", F.coalesce("root", "key").alias("cluster"))
    shared = scratch.save(spots.groupBy("cluster").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("cluster"))
    spots = scratch.save(spots.join(checked_broadcast(shared, BROADCAST_ROWS), "cluster").distinct())

    in_text = W.partitionBy("t").orderBy("start")
    part = F.struct("start", "end", "cluster")
    new = F.coalesce(F.lag("end").over(in_text) != F.col("start"), F.lit(True))
    runs = spots.where("not line").withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(in_text))
    runs = scratch.save(runs.groupBy("t", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(part)).alias("parts")).drop("run"))

    by_text = runs.groupBy("t").agg(F.collect_list(F.struct("start", "end", F.col("parts.start").alias("inner"))).alias("spots")).join(reps, "t")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part, w in _each(hasher, batch):
                mine, hashes = text_keys(w).view(np.int64), window_hashes(w, MIN_WORDS).view(np.int64)
                out: list[tuple[int, int, int, int]] = []
                for i, (t, spots) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if t == mine[i]:
                        first, last = int(w.first[i]), int(w.first[i + 1] - w.first[i]) - MIN_WORDS
                        for s in spots:
                            a, b = s["start"], s["end"] - MIN_WORDS
                            if b < a:  # the windows that hold a short run
                                at = range(max(0, b), min(a, last) + 1)
                            else:
                                at = {k for k in (*range(a - EDGE, a + 1), *(k for k in s["inner"] if k <= b), *range(b, b + EDGE + 1)) if 0 <= k <= last}
                            out += [(t, a, k, int(hashes[first + k])) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [], []))], names=["t", "start", "at", "window"])

    seen = scratch.save(at_texts(docs, by_text).mapInArrow(windows, "t long, start long, at long, window long"))
    twice = scratch.save(seen.groupBy("window").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("window"))
    good = seen.join(checked_broadcast(twice, BROADCAST_ROWS), "window").select("t", "start", "at").distinct()
    in_run = W.partitionBy("t", "start").orderBy("at")
    good = good.withColumn("apart", F.coalesce(F.col("at") > F.lag("at").over(in_run) + MIN_WORDS, F.lit(True)).cast("int")).withColumn("piece", F.sum("apart").over(in_run))
    good = good.groupBy("t", "start", "piece").agg(F.min("at").alias("from"), (F.max("at") + MIN_WORDS).alias("to"))
    inside = F.filter("parts", lambda x: (x["start"] >= F.col("from")) & (x["end"] <= F.col("to")))
    exact = good.join(runs.drop("end"), ["t", "start"]).select("t", F.col("from").alias("start"), F.col("to").alias("end"), inside.alias("parts"))
    whole = spots.where("line").select("t", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.array(part).alias("parts"))
    # passages that overlap are one
    each = exact.union(whole)
    by_start = W.partitionBy("t").orderBy("start", F.desc("end"))
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("piece", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("piece", F.sum("piece").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    joined = each.groupBy("t", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))
    return scratch.save(joined.drop("piece"))


def located(docs: DataFrame, percent: int) -> DataFrame:
    """docs: id, x (a hash of the text), text. Each repeated passage of each document: id, x, start, end, keep_id and cut."""
    scratch = Scratch(docs.sparkSession, "substring-out")
    texts = scratch.save(unit_table(docs))
    found = passages_of_texts(docs, texts, percent)
    # equal texts repeat each other whole
    copied = texts.groupBy("t").agg(F.count("*").alias("copies"), F.max("words").alias("words")).where((F.col("copies") > 1) & (F.col("words") >= MIN_WORDS))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("words").cast("int").alias("end"), F.col("t").alias("cluster")))
    inner = found.groupBy("t").agg(F.flatten(F.collect_list("parts")).alias("inner"))
    copied = copied.join(inner, "t", "left").select("t", F.lit(0).cast("long").alias("start"), F.col("words").alias("end"), F.concat(all_of_it, F.coalesce("inner", F.filter(all_of_it, lambda x: F.lit(False)))).alias("parts"))
    copied = scratch.save(copied)
    found = scratch.save(found.join(copied.select("t"), "t", "left_anti").select("t", "start", "end", "parts").union(copied))
    ids = scratch.save(texts.select("id", "x", "t").join(found.select("t").distinct(), "t"))
    # a null id comes after all others
    rank = F.struct(F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(-1)).alias("id"))
    first_of = scratch.save(ids.groupBy("t").agg(F.min(rank).alias("who")))
    parts = found.select("t", "start", "end", F.explode("parts").alias("p"))
    keepers = scratch.save(parts.select("t", "p.cluster").distinct().join(first_of, "t").groupBy("cluster").agg(F.min("who").alias("keeper")))
    kept = parts.join(checked_broadcast(keepers, BROADCAST_ROWS), F.col("p.cluster") == F.col("cluster"))
    kept = kept.groupBy("t", "start", "end").agg(F.sort_array(F.collect_list(F.struct(F.col("p.start").alias("start"), F.col("p.end").alias("end"), "keeper"))).alias("kept"))
    out = ids.join(scratch.save(kept), "t").withColumn("rank", rank)
    keep = F.array_min(F.col("kept.keeper"))
    cut = F.transform(F.filter("kept", lambda x: x["keeper"] != F.col("rank")), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return out.select("id", "x", "start", "end", F.when(~keep["late"], keep["id"]).alias("keep_id"), cut.alias("cut"))


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("text"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each repeated passage of each document: id, start_word, end_word, keep_id (the smallest id that keeps a part
    of it), removed (whether anything is cut here) and the spans of words that are cut."""
    out = located(_plain(docs, key, text), percent)
    return out.select(F.col("id").alias(key), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "keep_id", (F.size("cut") > 0).alias("removed"), "cut")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with the removed passages cut out of their texts."""
    scratch = Scratch(docs.sparkSession, "substring-cut")
    found = located(_plain(docs, key, text), percent).where(F.size("cut") > 0).distinct()
    found = scratch.save(found.groupBy(F.col("id").alias("_id"), F.col("x").alias("_x")).agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("_cut")))
    few = (found.agg(F.sum(F.size("_cut") + 2)).collect()[0][0] or 0) <= BROADCAST_ELEMENTS
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = F.col(f"c{names.index(key)}").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(f"c{names.index(text)}") == F.col("_x"))
    joined = plain.join(F.broadcast(found) if few else found, own, "left").drop("_id", "_x")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile("[^ \t\n\x0b\x0c\r]+")
        for batch in batches:
            out = []
            for t, cuts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if t and cuts:
                    places = [m.span() for m in word.finditer(t)]
                    before = len(places)
                    for c in sorted(cuts, key=lambda c: (-c["end"], c["start"])):
                        if (to := min(c["end"], before)) > c["start"]:
                            t = t[: places[c["start"]][0]] + t[places[to - 1][1] :]
                            before = c["start"]
                out.append(t)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    return joined.mapInArrow(run, joined.drop("_cut").schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
