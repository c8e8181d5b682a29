"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100.

Grouped prefix join. Shingles are ordered by the frequency of their hash bucket (a count of BUCKETS numbers over all
documents), rare first, then by hash. Two sets of the asked similarity share a shingle within the first
n - ceil(percent * n / 100) + 1 of each. Documents with equal sets are one class; classes with equal size and prefix are one
group, and only groups enter the inverted lists. A candidate pair first meets the
bitmap filter: each set keeps a parity bitmap of about two bits a shingle, and the bits in which two bitmaps differ bound
the overlap from above, so few pairs that are no links go on. The rest are verified on whole texts, in two rounds:

1. A class is compared with the first of its group, a group with the list neighbour that shares most prefix
   shingles and with the group that leads most of its lists (the one that has fewest rarer shingles, so most likely the
   original of a copy). That links most copies, however many there are, with about two comparisons each.
2. Lists that hold a single component are done, for all their links would stay within it. In the others every two groups of
   different components (and of fitting sizes, which are dealt into cells, positions and sketches) are a candidate, expanded to
   their classes and verified. So
   no link between different components is missed, and no group of copies is expanded into all its pairs.

Words are what is between white space, A-Z lower-cased. A text with fewer words than a shingle has its whole sequence as
its one shingle; a null text or one without words has an empty set, is linked with nothing and is its own component.
Shingles are compared by 64-bit hashes, classes by 128 bits and size. Rows are told apart by a number of their own, fixed by
saving the table with it, so repeated and null ids are fine: each row is answered, and a component's id, which is only
reported, is its smallest document id, null only if all are. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast, text_or_empty
from cinegrid.llm.components import connected_components
from cinegrid.llm.wordhash import SLICE_BYTES, WordHasher, mix, shingles, slices

BUCKETS, BLOCK = 1 << 20, 1 << 12
SALTS = 64
#: Numbers of 64 bits in the sketch that the join of the lists itself compares.
SKETCH_LONGS = 8
#: Ids are broadcast up to so many (8 bytes each), and candidate documents with their pairs up to a quarter of that; beyond,
#: the joins shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs, with both texts, that one task compares.
PAIRS_A_TASK = 512
#: In longer lists of a shingle, neighbours are looked for among about so many groups at a time.
LIST_PART = 256


def shingle_sets(hasher: WordHasher, texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, first = shingles(hasher(texts), words)
    return [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def class_key(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    k2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles that hash to i; a power of two of at least two bits a shingle."""
    bits = max(64 * SKETCH_LONGS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64 * SKETCH_LONGS
    count = np.bincount((s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((count & 1).astype(bool), bitorder="little").tobytes()


def most_common(n_a: int, n_b: int, a: bytes, b: bytes) -> int:
    """No two sets of these sizes and bitmaps share more shingles than this."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a bitmap of half the bits is the exclusive or of both halves
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def sketch_of(bitmap: bytes) -> list[int]:
    """A parity bitmap folded to at most SKETCH_LONGS numbers, for filtering inside a join."""
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > 8 * SKETCH_LONGS:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.frombuffer(x.tobytes(), np.int64).tolist()


def bucket_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each hash bucket, a level that grows with the number of documents' shingles in it. docs: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        hasher, total = WordHasher(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                sets = shingle_sets(hasher, texts, words)
                total += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        if total.any():
            blocks = [zlib.compress(b.tobytes(), 1) for b in total.reshape(-1, BLOCK)]
            salt = [TaskContext.get().partitionId() % SALTS] * len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(salt, pa.int32()), pa.array(blocks, pa.binary())], names=["block", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        import zlib

        total = np.zeros(BLOCK, np.uint64)
        for raw in table.column("counts").to_pylist():
            piece = zlib.decompress(raw)
            total += np.frombuffer(piece, np.uint32 if len(piece) == 4 * BLOCK else np.uint64)
        return pa.table({"block": table.column("block").slice(0, 1), "salt": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    ddl = "block int, salt int, counts binary"
    partial = docs.mapInArrow(count, ddl).groupBy("block", "salt").applyInArrow(add, ddl)
    total = np.zeros(BUCKETS, np.uint64)
    import zlib

    # at most SALTS pieces a block come from the first step: these tasks are enough for any input
    whole = partial.coalesce(SALTS).groupBy("block").applyInArrow(add, ddl).coalesce(SALTS // 4)
    for row in whole.collect():  # BUCKETS numbers, whatever the input's size
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(row.counts), np.uint64)
    return np.minimum(255, 8 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8)


def profiles(docs: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """docs: row, id, text. For each row its set's size, class key and prefix, the rarest shingles first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level = WordHasher(), shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = shingle_sets(hasher, texts, words)
                prefixes = []
                for s in sets:
                    take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    rare = s[np.argsort(level[(s >> np.uint64(44)).astype(np.int64)], kind="stable")]  # s is sorted by hash
                    prefixes.append(rare[:take])
                flat = pa.array(np.concatenate(prefixes).view(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
                ph = np.array([mix(p * np.uint64(2) * np.arange(1, len(p) + 1, dtype=np.uint64) + p).sum(dtype=np.uint64) for p in prefixes], np.uint64).view(np.int64)
                n = pa.array([len(s) for s in sets], pa.int64())
                own = [part.column(part.schema.get_field_index(c)) for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([*own, n, *class_key(sets), pa.array(ph), pa.ListArray.from_arrays(offsets, flat)], names=["row", "id", "n", "k1", "k2", "ph", "prefix"]).append_column("bitmap", pa.array([parity_bitmap(s) for s in sets], pa.binary()))

    return docs.mapInArrow(run, "row long, id long, n long, k1 long, k2 long, ph long, prefix array<long>, bitmap binary")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch_of(b) for b in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["gid", "sketch"])


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose bitmaps leave room for the similarity, with the row that stands for each class."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cid").alias(name), F.col("rep").alias(f"of_{name}"), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"bitmap_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ba, bb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "bitmap_a", "bitmap_b"))
            ok = [(100 + percent) * most_common(x, y, u, v) >= percent * (x + y) for x, y, u, v in zip(na, nb, ba, bb, strict=True)]
            yield batch.select(["a", "b", "of_a", "of_b"]).filter(pa.array(ok, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "of_a", "of_b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(run, "a long, b long, of_a long, of_b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, rows: int) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets are as similar as asked. The two texts of a pair meet in one shuffle.

    rows: the number of documents; it sets how many tasks write.
    """
    scratch = Scratch(docs.sparkSession, "ngram-verify")
    pairs = scratch.save(possible(pairs, classes, percent), rows)
    count = pairs.count()
    sides = pairs.select("a", "b", F.explode(F.array("of_a", "of_b")).alias("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            both, good, at = batch.column(2).flatten(), [], 0  # the texts of a pair side by side
            ends = np.cumsum(pc.binary_length(both).to_numpy(zero_copy_only=False).astype(np.int64))[1::2]
            while at < batch.num_rows:  # SLICE_BYTES at a time, one pair at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                sets = shingle_sets(hasher, both.slice(2 * at, 2 * (to - at)), words)
                for one, other in zip(sets[::2], sets[1::2], strict=True):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    good.append(100 * common >= percent * (len(one) + len(other) - common))
                at = to
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = F.broadcast(sides) if 2 * count <= BROADCAST_IDS // 4 else sides
    texts = docs.join(wanted, docs["row"] == sides["rep"])
    met = texts.groupBy("a", "b").agg(F.collect_list(text_or_empty("text")).alias("both"))  # two texts
    return scratch.save(met.mapInArrow(run, "a long, b long"), count, PAIRS_A_TASK)


def linked_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs: row (a number of its own), id, text, a saved table. For each row: row, id, n, and of its component component_id
    (the smallest id) and first_row (the smallest row). Rows without shingles have no first_row."""
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = scratch.save(profiles(docs, words, percent, bucket_levels(docs.select("text"), words)))

    # a class is its smallest row; only numbers are aggregated, sets and bitmaps stay with that row
    least = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("row").alias("row"), F.min("id").alias("low_id"), F.first("ph").alias("ph"))
    least = scratch.save(least.select("row", "low_id", "n", "ph"))
    groups = least.groupBy("n", "ph").agg(F.min("row").alias("gid"))
    least = scratch.save(least.join(groups, ["n", "ph"]).select("row", "low_id", "gid"))
    classes = rows.drop("id").join(checked_broadcast(least, BROADCAST_IDS), "row").withColumn("cid", F.col("row")).withColumnRenamed("row", "rep")
    count = rows.count()
    classes, wide = scratch.save(classes, count), rows
    rows = scratch.save(wide.select("row", "id", "n", "k1", "k2"), count)
    scratch.drop(wide)
    members = classes.select("cid", "gid", "n")

    # inverted lists of the groups' leaders, in order of size. A posting whose neighbours in that order don't fit its size links
    # nothing and goes, in the one shuffle by shingle. "up": sizes that fit reach into the next cell. What is said of a whole list
    # (its lead, whether it is open) is aggregated by task first and joined back
    def fit(small: Column, large: Column) -> Column:
        return F.coalesce(100 * small >= percent * large, F.lit(False))

    # sizes that fit lie in one cell or in two that adjoin
    cell = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    posted = classes.where("cid = gid").select(F.col("cid").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    posted = posted.repartition("token").withColumn("cell", cell)  # what follows from n needn't travel
    falling = W.partitionBy("token").orderBy(F.desc("n"))
    above = F.lag("n").over(falling)
    posted = posted.withColumns({"beside": fit(F.col("n"), above) | fit(F.lead("n").over(falling), F.col("n")), "step": F.when(F.lag("cell").over(falling) != F.col("cell"), above)})
    over = F.last("step", ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, 0))
    posted = posted.withColumns({"m": F.count("*").over(W.partitionBy("token")), "up": fit(F.col("n"), over)}).where("beside")
    posted = scratch.save(posted.drop("beside", "step", "cell"), 8 * count)
    lists = posted.groupBy("token").agg(F.min_by(F.struct("gid", "n"), F.struct("pos", "gid")).alias("lead"))

    part = F.when(F.col("m") > LIST_PART, F.pmod(F.xxhash64("gid"), F.ceil(F.col("m") / LIST_PART))).otherwise(0)
    near = W.partitionBy("token", "part").orderBy("n", "gid")
    beside = posted.withColumn("part", part).select("gid", "n", F.lag("gid").over(near).alias("other"), F.lag("n").over(near).alias("other_n"))
    beside = beside.where(100 * F.col("other_n") >= percent * F.col("n")).groupBy("gid", "other").agg(F.count("*").alias("shared"))
    beside = beside.groupBy("gid").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    lists = scratch.save(lists)
    led = posted.join(lists, "token").where((F.col("gid") != F.col("lead.gid")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    led = led.groupBy("gid", F.col("lead.gid").alias("other")).agg(F.count("*").alias("lists")).groupBy("gid").agg(F.max_by("other", F.struct("lists", "other")).alias("other"))
    stars = beside.select("gid", "other").union(led).select(F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b"))
    before = members.where("cid <> gid").select(F.col("gid").alias("before"), "cid")
    first = before.select(F.col("before").alias("a"), F.col("cid").alias("b")).union(stars).distinct()
    links = verified(first, docs, classes, words, percent, count)
    scratch.drop(lists)

    roots = scratch.save(connected_components(links))
    members = scratch.save(members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "gid", "n", F.coalesce("root", "cid").alias("root")), count)
    # a group of one class that the first round linked to nothing is its own root
    span = members.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.count("*") == 1).alias("single"))
    span = scratch.save(span.where("low <> gid or high <> gid or not single"), count)
    own = [F.coalesce(c, "gid").alias(c) for c in ("low", "high")]
    listed = posted.join(checked_broadcast(span, BROADCAST_IDS // 4), "gid", "left").select("token", "gid", "n", "pos", "up", *own, F.coalesce("single", F.lit(True)).alias("single"))
    mixed = listed.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("token")
    # a group of one class carries its sketch into the join; for others nothing is ruled out there
    sketches = classes.select(F.col("cid").alias("gid"), "bitmap").mapInArrow(_sketches, "gid long, sketch array<long>")
    open_lists = listed.join(mixed, "token").join(sketches, "gid").withColumn("sketch", F.when(F.col("single"), F.col("sketch"))).drop("single")
    open_lists = scratch.save(open_lists, 8 * count)
    scratch.drop(posted)
    open_lists = open_lists.withColumn("cell", cell)
    wider = open_lists.withColumn("cell", F.explode(F.when(F.col("up"), F.array("cell", F.col("cell") + 1)).otherwise(F.array("cell"))))
    a, b = open_lists.alias("a"), wider.alias("b")
    # what can still be common from these positions on must reach the overlap that the similarity asks for
    reach = 1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) - 1
    fitting = (F.col("a.gid") != F.col("b.gid")) & (F.col("a.cell") == F.col("b.cell")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * reach >= percent * (F.col("a.n") + F.col("b.n")))
    differ = sum((F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    total = F.col("a.n") + F.col("b.n")
    fitting = fitting & F.coalesce((100 + percent) * (total - differ) >= 2 * percent * total, F.lit(True))
    apart = ~((F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low")))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & fitting & apart).select(F.least("a.gid", "b.gid").alias("ga"), F.greatest("a.gid", "b.gid").alias("gb")).distinct()
    pairs = pairs.union(span.where("low <> high").select("gid", "gid"))
    left = members.select(F.col("gid").alias("ga"), F.col("cid").alias("a"), F.col("root").alias("ra"))
    right = members.select(F.col("gid").alias("gb"), F.col("cid").alias("b"), F.col("root").alias("rb"))
    second = pairs.join(left, "ga").join(right, "gb").where("ra <> rb").select("a", "b")
    more = verified(second, docs, classes, words, percent, count)

    # the new links join components of the first round: only those are gone over again
    root_of = members.select(F.col("cid"), "root")
    joined = more.join(root_of.toDF("a", "ra"), "a").join(root_of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    joined = connected_components(scratch.save(joined, more.count() or 1)).select(F.col("node").alias("root"), F.col("root").alias("over"))
    roots = members.join(joined, "root", "left").select("cid", F.coalesce("over", "root").alias("root"))
    named = classes.select("n", "k1", "k2", "cid", "rep", "low_id").join(roots, "cid")
    smallest = named.groupBy("root").agg(F.min("low_id").alias("component_id"), F.min("rep").alias("first_row"))
    named = scratch.save(named.join(smallest, "root").select("n", "k1", "k2", "component_id", "first_row"), count)
    out = rows.select("row", "id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("row", "id", "n", component.alias("component_id"), "first_row")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs: id, n_shingles and component_id, the smallest id reachable by links."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = linked_rows(Scratch(docs.sparkSession, "ngram-rows").save(numbered), words, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are their component's document: the one of its smallest id or, if all its
    ids are null, its first row. Rows of one component that share that id are one document; in other components rows of the
    same id are judged on their own. Rows without words stay."""
    scratch, names = Scratch(docs.sparkSession, "ngram-rows"), docs.columns
    # by position, so that no column of docs stands in the way
    plain = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    numbered = scratch.save(plain)
    found = linked_rows(numbered.select("row", F.col(f"c{names.index(key)}").cast("long").alias("id"), F.col(f"c{names.index(text)}").alias("text")), words, percent)
    stays = F.when(F.col("component_id").isNull(), F.col("row") == F.col("first_row")).otherwise(F.col("id").eqNullSafe(F.col("component_id")))
    gone = scratch.save(found.where((F.col("n") > 0) & ~stays).select("row"))
    return numbered.join(checked_broadcast(gone, BROADCAST_IDS), "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
