"""Compression of vectors to short codes by product quantisation over distinct integer parts.

Components become integers, floor(SCALE * x), and a vector is cut into PARTS consecutive parts. Equal parts of one position are
one weighted row, counted by a partial aggregation, so that copies and frequent parts cost nothing more. Lloyd's rounds run over
those rows: each goes to the nearest entry of its position's codebook (ENTRIES entries, broadcast), tasks add up weighted sums
by entry, and the entries become the floors of the means. The coded rows are then joined back to the vectors' parts by position
and value, and each vector puts its indexes and errors together. Hot parts are split by adaptive execution, as both sides of
that join are shuffled for it.

Edges: rows whose vector is null or holds a null or non-finite component are dropped. Vectors of each length have codebooks
of their own; where PARTS does not divide the length n, part p runs from n*p // PARTS to n*(p+1) // PARTS, and may be empty,
which codes as 00 without error. Integers beyond +-MOST stand as +-MOST. Of rows that share a vec_id, the smallest vector
starts a codebook; null ids come last. With fewer than ENTRIES ids, codebooks are smaller. Repeated rows each give a row.
Errors of equal labels are summed, nulls together; without a label column all rows count as one label. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Squared distances of 512 components within it still fit a long.
MOST = 1 << 26
#: Rows of distances that a task holds at a time, and rows up to which the labels' sums are broadcast.
BLOCK, BROADCAST_ROWS = 4096, 200_000

Books = dict[tuple[int, int], np.ndarray]  # by vector length and position: entries by components


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """row, key, label and v: the kept vectors in integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), SCALE * x.cast("double")))))).cast("int"))
    kept = vectors.where(F.col(vector).isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), scaled.alias("v"))


def parts_of(rows: DataFrame, *names: str) -> DataFrame:
    """n (the vector's length), pos, part for each position of each vector, with the columns named."""
    n = F.size("v")
    ends = F.expr(f"transform(sequence(0, {PARTS - 1}), p -> struct(p as pos, slice(v, int(size(v) * p div {PARTS}) + 1, int(size(v) * (p + 1) div {PARTS} - size(v) * p div {PARTS})) as part))")
    return rows.select(*names, n.alias("n"), F.explode(ends).alias("x")).select(*names, "n", "x.pos", "x.part")


def starting_books(rows: DataFrame) -> Books:
    """The parts of the ENTRIES smallest ids of each length: as many rows a length come to the driver."""
    books: Books = {}
    for (n,) in rows.select(F.size("v")).distinct().collect():  # the lengths there are
        some = rows.where(F.size("v") == n)
        ids = some.select("key").distinct().orderBy(F.asc_nulls_last("key")).limit(ENTRIES)
        first = some.join(F.broadcast(ids), some["key"].eqNullSafe(ids["key"]), "left_semi").groupBy("key").agg(F.min("v").alias("v"))
        v = np.array([r.v for r in first.orderBy(F.asc_nulls_last("key")).collect()], np.int64)
        for p in range(PARTS):
            books[n, p] = v[:, n * p // PARTS : n * (p + 1) // PARTS]
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower, and its squared distance."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), BLOCK):
        far = np.zeros((len(x[a : a + BLOCK]), len(book)), np.int64)
        for c in range(x.shape[1]):
            far += np.square(x[a : a + BLOCK, c, None] - book[None, :, c])
        index[a : a + BLOCK] = far.argmin(1)
        error[a : a + BLOCK] = far.min(1)
    return index, error


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch (n, pos, part first) by length and position: n, pos, their numbers, their parts."""
    n, pos = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    part = batch.column(2)
    values, starts = part.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy())])
    both = n * PARTS + pos
    for b in np.unique(both):
        at = np.flatnonzero(both == b)
        width = starts[at[0] + 1] - starts[at[0]]
        yield int(b // PARTS), int(b % PARTS), at, values[starts[at][:, None] + np.arange(width)]


def assigned(distinct: DataFrame, books: Books) -> DataFrame:
    """distinct: n, pos, part. Adds entry and error of the nearest entry."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = np.zeros((2, batch.num_rows), np.int64)
            for n, pos, at, x in _groups(batch):
                index[at], error[at] = nearest(x, shared.value[n, pos])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(index.astype(np.int32)), pa.array(error)], names=["n", "pos", "part", "entry", "error"])

    return distinct.select("n", "pos", "part").mapInArrow(run, "n int, pos int, part array<int>, entry int, error long")


def lloyd(distinct: DataFrame, books: Books) -> Books:
    """One round over the weighted distinct parts: n, pos, part, weight."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # of the task: by entry its weight and the weighted sum of each component
        for batch in batches:
            weight = batch.column(3).to_numpy()
            for n, pos, at, x in _groups(batch):
                book = shared.value[n, pos]
                mine = sums.setdefault((n, pos), np.zeros((len(book), book.shape[1] + 1), np.int64))
                index, w = nearest(x, book)[0], weight[at]
                np.add.at(mine, index, np.column_stack([w, x * w[:, None]]))
        for (n, pos), mine in sums.items():
            used = np.flatnonzero(mine[:, 0])
            e, c = np.repeat(used, mine.shape[1]), np.tile(np.arange(mine.shape[1]), len(used))
            fixed = [pa.array(np.full(len(e), v, np.int32)) for v in (n, pos)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(e.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(mine[used].reshape(-1))], names=["n", "pos", "entry", "place", "total"])

    each = distinct.select("n", "pos", "part", "weight").mapInArrow(run, "n int, pos int, entry int, place int, total long")
    found: dict[tuple[int, int, int], dict[int, int]] = defaultdict(dict)
    for r in each.groupBy("n", "pos", "entry", "place").agg(F.sum("total").alias("total")).collect():  # a row for each number of the codebooks
        found[r.n, r.pos, r.entry][r.place] = r.total
    out = {k: book.copy() for k, book in books.items()}
    for (n, pos, entry), total in found.items():
        out[n, pos][entry] = [total[i + 1] // total[0] for i in range(out[n, pos].shape[1])]
    return out


def book_digest(books: Books, n: int) -> str:
    return hashlib.sha256(",".join(str(x) for p in range(PARTS) for x in books[n, p].reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """Every kept row's key, code, error, label_error and codebooks_sha256."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = scratch.save(whole_numbers(vectors, key, vector, label if label in vectors.columns else None))
    books = starting_books(rows)
    distinct = scratch.save(parts_of(rows).groupBy("n", "pos", "part").agg(F.count("*").alias("weight")))
    for _ in range(ROUNDS):
        books = lloyd(distinct, books)
    coded = assigned(distinct, books)

    met = parts_of(rows, "row", "key", "label").join(coded, ["n", "pos", "part"])
    own = met.groupBy("row", "key", "label", "n").agg(F.collect_list(F.struct("pos", "entry")).alias("x"), F.sum("error").alias("error"))  # PARTS entries a row
    own = own.withColumn("code", F.array_join(F.transform(F.array_sort("x"), lambda e: F.lpad(F.lower(F.hex(e["entry"])), 2, "0")), ""))
    own = scratch.save(own.select("key", "label", "n", "code", "error"))
    totals = scratch.save(own.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    out = own.join(checked_broadcast(totals, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("of")))
    digests = {n: book_digest(books, n) for n in {n for n, _ in books}}
    named = F.create_map(*(F.lit(x) for pair in digests.items() for x in pair))[F.col("n")] if digests else F.lit(None).cast("string")
    return out.select(F.col("key").alias(key), "code", "error", "label_error", named.alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, for vectors of one length that PARTS divides."""
    head = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, label, pos, v[pos * len(v) // {PARTS} + 1 : (pos + 1) * len(v) // {PARTS}] AS part FROM v, range({PARTS}) t(pos)),
d AS (SELECT pos, part, count(*) AS weight FROM p GROUP BY pos, part),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part AS book FROM p
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY vec_id) <= {ENTRIES}),"""
    far = "list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - book[i]) * (part[i] - book[i])))"
    nearest_of = "a{k} AS (SELECT pos, part, any_value(weight) AS weight, min((" + far + ", entry)) AS best FROM d JOIN b{k} USING (pos) GROUP BY pos, part),"
    step = """
m{k} AS (SELECT pos, best[2] AS entry, i, sum(part[i] * weight) AS s, sum(weight) AS c FROM a{k}, range(1, (SELECT max(len(part)) FROM d) + 1) t(i) GROUP BY ALL),
n{k} AS (SELECT pos, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS book FROM m{k} GROUP BY pos, entry),
b{j} AS (SELECT pos, entry, coalesce(n.book, o.book) AS book FROM b{k} o LEFT JOIN n{k} n USING (pos, entry)),"""
    rounds = "".join("\n" + nearest_of.format(k=k) + step.format(k=k, j=k + 1) for k in range(ROUNDS))
    tail = f"""
{nearest_of.format(k=ROUNDS)}
c AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', best[2])), '' ORDER BY pos) AS code,
  CAST(sum(best[1]) AS BIGINT) AS error FROM p JOIN a{ROUNDS} USING (pos, part) GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(book, ','), ',' ORDER BY pos, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c"""
    return head + rounds + tail


SQL = _sql()
