"""Importance resampling towards a target: documents whose features are commoner in the target than in the corpus are drawn more.

Features are all runs of 1 to FEATURE_WORDS words, hashed into BUCKETS buckets. Two histograms, one of the corpus and one of
the target, give each bucket a gain; a document's weight is the sum over its features of an array of gains, which is all that
tasks need (BUCKETS numbers, broadcast). A Gumbel number from the document's id makes the weight a score, so that the highest
scores are a draw without replacement in proportion to exp(weight / 1000).

The draw: each partition of eligible documents is sorted into a run, cut into pages. Keys from a sample of rows cut the order
into ranges, whose rows are counted; of the ranges that the draw reaches, each is merged by a tournament over its pages, which
come in the order of their first keys, so that one page of each run is open at most. A merge starts at the rank that the
counts give and stops at the exact number of draws. The sample only evens out the ranges; results do not depend on it.

Edges: a null or empty text has no features and weight 0. A null id hashes as an empty one and comes after all others. Of
equal scores the smaller id is drawn first; repeated rows are rows of their own, in any order. Empty tables give no rows; an
empty target is a target without features. Texts of any length are read in pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch
from cinegrid.llm.wordhash import SLICE_BYTES, slices

FEATURE_WORDS, BUCKETS = 3, 10_000
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Rows of a page of a run; rows that a merged range holds about; rows of the sample that the ranges are cut by, and the most ranges.
PAGE, RANGE_ROWS, SAMPLED, MOST_RANGES = 2048, 8192, 16_384, 4096


class FeatureHasher:
    """CRC-32 of runs of words, put together from those of the words: the checksum of A and B is that of A, moved on by B's
    length, and that of B."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        self.step = byte
        at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        near = [at]  # what 0 to 64 further bytes make of each byte of a checksum
        for _ in range(64):
            near.append(byte[near[-1] & 255] ^ (near[-1] >> 8))
        self.near, self.far = np.stack(near[:64]).reshape(-1), [near[64].reshape(-1)]
        for _ in range(24):
            self.far.append(self._look(self.far[-1], self.far[-1]))
        self.kind = np.zeros(256, np.uint8)  # bytes of words, lower-cased; 0 separates
        for a, b in ((48, 58), (97, 123), (128, 256)):
            self.kind[a:b] = np.arange(a, b)
        self.kind[65:91] = np.arange(97, 123)

    @staticmethod
    def _look(table: np.ndarray, crc: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
        return table[base + (crc & 255)] ^ table[base + 256 + (crc >> 8 & 255)] ^ table[base + 512 + (crc >> 16 & 255)] ^ table[base + 768 + (crc >> 24)]

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        out, rest = self._look(self.near, crc, (by & 63) * 1024), by >> 6
        for table in self.far:
            if not rest.any():
                break
            odd = rest & 1 == 1
            out[odd] = self._look(table, out[odd])
            rest = rest >> 1
        return out

    def checksums(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        order = np.argsort(-np.minimum(size, 65), kind="stable")
        at, n = start[order], size[order]
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for j in range(min(int(n.max(initial=0)), 64)):
            m = np.searchsorted(-n, -j)  # words longer than j come first
            crc[:m] = self.step[(crc[:m] ^ data[at[:m] + j]) & 255] ^ (crc[:m] >> 8)
        out = np.empty_like(crc)
        out[order] = ~crc
        for i in np.flatnonzero(size > 64):
            out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
        return out

    def pieces(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts of a long text between words."""
        a = 0
        while len(raw) - a > SLICE_BYTES:
            b = a + SLICE_BYTES
            while b < len(raw):
                gap = np.flatnonzero(self.kind[raw[b : b + SLICE_BYTES]] == 0)
                if len(gap):
                    b += int(gap[0])
                    break
                b += SLICE_BYTES
            b = min(b, len(raw))
            yield a, b
            a = b
        yield a, len(raw)

    def __call__(self, texts: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """texts: without nulls; several only if they are short together. A piece at a time, and for runs of 1, 2, ... words in
        it: the number of the text and the bucket of each."""
        at = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kept = [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for a, b in self.pieces(raw) if len(texts) == 1 else [(0, len(raw))]:
            data = self.kind[raw[a:b]]
            word = np.zeros(b - a + 2, bool)
            word[1:-1] = data != 0
            opens, closes = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
            edge = at[(at > a) & (at < b)] - a  # words end with their text
            opens[edge] |= word[1:-1][edge]
            closes[edge - 1] |= word[1:-1][edge - 1]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            text = np.searchsorted(at, start + a, "right") - 1
            old = len(kept[0])
            crc, size, text = (np.concatenate(x) for x in zip(kept, (self.checksums(data, start, end - start), end - start, text), strict=True))
            spaced = self.moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
            runs, out = crc, [(text[old:], (crc[old:] % self.buckets).astype(np.int64))]
            for n in range(2, FEATURE_WORDS + 1):
                runs = self.moved(runs[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :] if len(crc) >= n else runs[:0]
                new = (np.arange(n - 1, n - 1 + len(runs)) >= old) & (text[n - 1 :] == text[: len(runs)])
                out.append((text[n - 1 :][new], (runs[new] % self.buckets).astype(np.int64)))
            yield out
            kept = [x[-(FEATURE_WORDS - 1) :] for x in (crc, size, text)]


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; each task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = FeatureHasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in slices(batch, "text"):
                for runs in hasher(part):
                    for _, bucket in runs:
                        total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    each = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, k = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str, text: str) -> DataFrame:
    """key, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, value = FeatureHasher(len(shared.value)), shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, words, features, weight = part.num_rows, *np.zeros((3, part.num_rows), np.int64)
                for runs in hasher(texts):
                    words += np.bincount(runs[0][0], minlength=n)
                    for of, bucket in runs:
                        features += np.bincount(of, minlength=n)
                        sums = np.concatenate([[0], np.cumsum(value[bucket])])
                        weight += np.diff(sums[np.searchsorted(of, np.arange(n + 1))])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, features, weight))], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A number of the Gumbel distribution in thousandths, from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


class Page:
    """Sorted rows of a run, and how far they have been merged."""

    def __init__(self, row: dict):
        self.score, self.key, self.row = row["score"], row["key"], row["row"]
        self.values, self.at = (self.key, row["n_features"], row["weight"], self.score), 0

    def order(self, i: int) -> tuple:
        key = self.key[i]
        return -self.score[i], key is None, "" if key is None else key, self.row[i]


class Tournament:
    """A tree of matches between pages; each match keeps its winner, the page whose next row comes first."""

    def __init__(self) -> None:
        self.size, self.tree, self.free = 1, [None, None], [0]

    def _first(self, a: Page | None, b: Page | None) -> Page | None:
        return a if b is None or a is not None and a.order(a.at) <= b.order(b.at) else b

    def _replay(self, place: int) -> None:
        i = (self.size + place) // 2
        while i:
            self.tree[i] = self._first(self.tree[2 * i], self.tree[2 * i + 1])
            i //= 2

    def enter(self, page: Page) -> None:
        if not self.free:
            leaves = self.tree[self.size :]
            self.free = list(range(self.size, 2 * self.size))
            self.tree = [None] * (2 * self.size) + leaves + [None] * self.size
            self.size *= 2
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = self._first(self.tree[2 * i], self.tree[2 * i + 1])
        page.place = self.free.pop()
        self.tree[self.size + page.place] = page
        self._replay(page.place)

    def merge(self, until: tuple | None = None) -> Iterator[tuple[Page, int, int]]:
        """Stretches of rows in order, as far as they come before `until`: page, from, to."""
        while (page := self.tree[1]) is not None and (until is None or page.order(page.at) < until):
            rivals, i = [until] if until is not None else [], self.size + page.place
            while i > 1:  # the best of those that the winner has beaten
                if (other := self.tree[i ^ 1]) is not None:
                    rivals.append(other.order(other.at))
                i //= 2
            n = len(page.row)
            to = bisect_left(range(n), min(rivals), page.at + 1, n, key=page.order) if rivals else n
            yield page, page.at, to
            page.at = to
            if to == n:
                self.tree[self.size + page.place] = None
                self.free.append(page.place)
            self._replay(page.place)


def merged_ranks(pages: Iterator[dict], start: int, most: int) -> Iterator[tuple[list[list], range, list]]:
    """The first `most` rows of pages that come in the order of their first rows, ranked from start on: columns, ranks, row numbers."""
    tree, done = Tournament(), 0

    def stretches() -> Iterator[tuple[Page, int, int]]:
        for row in pages:
            page = Page(row)
            yield from tree.merge(page.order(0))
            tree.enter(page)
        yield from tree.merge()

    for page, a, b in stretches():
        b = min(b, a + most - done)
        yield [v[a:b] for v in page.values], range(start + done, start + done + b - a), page.row[a:b]
        done += b - a
        if done == most:
            return


def draw(scored: DataFrame, eligible: Column, percent: int, scratch: Scratch) -> DataFrame:
    """scored: a saved table of key, n_features, weight, score and row (a number of its own). Adds rank, null where not drawn."""
    able = scored.where(eligible)
    count = able.count()
    wanted = percent * count // 100
    names = ["key", "n_features", "weight", "score"]
    out = scored.select(*names, F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return out
    kind = scored.schema["key"].dataType.simpleString()
    fields = f"score array<long>, key array<{kind}>, row array<long>, n_features array<long>, weight array<long>"
    columns = ["score", "key", "row", "n_features", "weight"]

    def to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PAGE):
                part = batch.slice(a, PAGE)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, names=columns)

    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    runs = scratch.save(able.select(*columns).sortWithinPartitions(*order).mapInArrow(to_pages, fields))

    sample = able.where(F.pmod(F.xxhash64("row"), F.lit(count)) < SAMPLED).select(*columns[:3]).collect()  # SAMPLED rows, about
    cuts = sorted((-r.score, r.key is None, "" if r.key is None else r.key, r.row) for r in sample)
    reach = -(-len(cuts) * wanted // count)  # of the sample, so many come as far as the draw
    ranges = min(MOST_RANGES, -(-wanted // RANGE_ROWS), max(1, reach))
    cuts = sorted({cuts[i * reach // ranges] for i in range(1, ranges + 1) if i * reach // ranges < len(cuts)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                page, part = Page(row), batch.slice(i, 1)
                n = len(page.row)
                ends = [0, *(bisect_left(range(n), c, key=page.order) for c in cuts), n]
                for k in range(len(ends) - 1):
                    a, b = ends[k], ends[k + 1]
                    if a < b:
                        lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c.flatten().slice(a, b - a)) for c in part.columns]
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *lists], names=["range", *columns])

    dealt = runs.mapInArrow(cut, f"range int, {fields}")
    sizes = {r["range"]: r.n for r in dealt.groupBy("range").agg(F.sum(F.size("row")).alias("n")).collect()}  # MOST_RANGES rows at most
    starts, done = {}, 0
    for k in sorted(sizes):
        if done < wanted:
            starts[k] = (done + 1, min(sizes[k], wanted - done))
        done += sizes[k]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        ahead = next(rows, None)

        def same(k: int) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["range"] == k:
                row, ahead = ahead, next(rows, None)
                yield row

        while ahead is not None:
            k = ahead["range"]
            mine = same(k)
            for values, ranks, row in merged_ranks(mine, *starts[k]):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*values, ranks, row), types, strict=True)], names=[*names, "rank", "row"])
            for _ in mine:  # the pages past the last draw
                pass

    types = [pa.int64()] * 6
    if kind != "bigint":
        from pyspark.sql.pandas.types import to_arrow_type

        types[0] = to_arrow_type(scored.schema["key"].dataType)
    heads = [F.desc(F.col("score")[0]), F.asc_nulls_last(F.col("key")[0]), F.asc(F.col("row")[0])]
    reached = dealt.where(F.col("range").isin(list(starts))).repartition(len(starts), "range").sortWithinPartitions("range", *heads)
    drawn = scratch.save(reached.mapInArrow(merge, f"key {kind}, n_features long, weight long, score long, rank long, row long"))

    last = drawn.where(F.col("rank") == wanted).select("score", "key", "row").collect()[0]
    same_key = F.col("key").eqNullSafe(F.lit(last.key)) & (F.col("row") > last.row)
    later = F.lit(False) if last.key is None else F.col("key").isNull() | (F.col("key") > F.lit(last.key))
    after = (F.col("score") < last.score) | ((F.col("score") == last.score) & (F.coalesce(later, F.lit(False)) | same_key))
    return out.where(~eligible | after).union(drawn.select(*names, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's key, n_features, weight, score and rank in a draw of percent of the rows of at least least_words words."""
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weigh(docs, gain, key, text).withColumns({"score": F.col("weight") + gumbel(F.col("key"), seed), "row": F.monotonically_increasing_id()})
    return draw(scratch.save(scored), F.col("n_words") >= least_words, percent, scratch).withColumnRenamed("key", key)
