"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors are scaled by a power of two, which changes no cosine; equal ones are one node, so copies cost nothing and tie as they
should. The neighbour graph (DEGREE neighbours a node) starts from blocks: nodes go to their nearest pivots (a sample of at
most PIVOTS vectors); a pivot's nodes are cut by the signs of random projections of what lies between them and the pivot, as
many as its size asks for, into blocks of BLOCK nodes at most (what is larger still is cut by hash), and each block finds its
nodes' neighbours. NN-descent then joins, around every node, the nodes that it points to and that
point to it, in chunks where a hub has many, which are dealt anew each round; of two that met before neither is new, so only
pairs with a new link are compared, and nodes without any are left out. Each keeps what beats its list, until a round changes
few entries. All this is the same at every size. Then the queries walk the graph: each round expands a query's best WIDTH
unvisited candidates by the graph's links in both directions, until no query has an unvisited one among its best REACH.
Vectors travel as unit vectors in 32-bit floats; nearness is minus half the squared distance, in double precision, which tells
near copies apart where cosines would not. The best FINAL candidates are scored exactly, in double precision on the original
vectors. A query whose FINAL-th score isn't below its k-th, so that more candidates may tie, is compared with all nodes, in
blocks of such queries, of which each task keeps the k best.

Vectors that are null, zero, empty or hold null or non-finite components take no part. Vectors of different lengths are no
candidates of each other; each length has a graph of its own. A row with a null id is no query and no neighbour. Repeated
rows count once. Ties go to the smaller id. Fewer candidates than asked for give fewer rows; an empty table gives none. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, checked_broadcast

DEGREE = 24
PIVOTS, PIVOTS_EACH, PASSES, BLOCK = 1024, 3, 4, 512
#: Nodes a pivot gets on average while PIVOTS allows it, and the neighbours that each block names.
PIVOT_NODES, BLOCK_DEGREE = 128, 12
#: NN-descent ends when a round changes less than GAIN of the lists' entries.
GAIN, CHUNK = 0.002, 64
#: Neighbours found that a task holds before it gives out lists, and tied queries that are compared with all nodes at a time.
HELD, SCAN = 200_000, 512
WIDTH, BEAM, REACH, LINKS = 32, 160, 128, 64
FINAL = 48
SALTS = 64
#: Tables of a few numbers a row are broadcast up to so many rows.
BROADCAST_ROWS = 500_000

LISTS = "node long, nbrs array<long>, sims array<float>, fresh array<boolean>"


def scaled(vectors: list[list[float]]) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5 up to 1: no digit of a cosine changes."""
    x = np.array(vectors, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _rows(values: list[bytes]) -> np.ndarray:
    if not values:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1).astype(np.float64)


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus half the squared distances of all rows of a and of b: 0 for equal ones, -2 at least."""
    return np.minimum(a @ b.T - ((a * a).sum(1)[:, None] + (b * b).sum(1)) / 2, 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of scaled vectors, one by one."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _lists(nodes: list[int], nbrs: list[np.ndarray], sims: list[np.ndarray], fresh: list[np.ndarray] | None = None) -> pa.RecordBatch:
    fresh = [np.ones(len(n), bool) for n in nbrs] if fresh is None else fresh
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(nbrs, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())), pa.array(fresh, pa.list_(pa.bool_()))], names=["node", "nbrs", "sims", "fresh"]
    )


def best_of(ids: np.ndarray, sims: np.ndarray, most: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The `most` most similar distinct ids, the most similar first, ties to the smaller id; of equal ones the one that is old."""
    fresh = np.zeros(len(ids), bool) if fresh is None else fresh
    order = np.lexsort((fresh, ids, -sims))
    ids, sims, fresh = ids[order], sims[order], fresh[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    first = first[:most]
    return ids[first], sims[first], fresh[first]


def _best_each(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, most: int) -> pa.RecordBatch:
    """One list for each node of (node, nbr, sim) rows, of its best `most`."""
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    at = np.flatnonzero(np.diff(node, prepend=-1))  # nodes are not negative
    got = [best_of(nbr[a:b], sim[a:b], most) for a, b in zip(at, [*at[1:], len(node)][: len(at)], strict=True)]
    return _lists(node[at].tolist(), [g[0] for g in got], [g[1] for g in got])


def usable(v: str) -> Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def as_scaled(vectors: DataFrame) -> DataFrame:
    """vectors: id, v, usable ones. v becomes scaled, in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            out: list = [None] * len(rows)
            for n in {len(r) for r in rows}:
                which = [i for i, r in enumerate(rows) if len(r) == n]
                for i, x in zip(which, scaled([rows[i] for i in which]), strict=True):
                    out[i] = x + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>")


def make_nodes(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vectors: id, v, all of one length. Returns the nodes: node, v, unit."""

    def with_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in units(np.array(v))] if v else [], pa.binary())], names=["v", "unit"])

    nodes = vectors.select("v").distinct().mapInArrow(with_unit, "v array<double>, unit binary")
    return scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()))


def smallest_ids(vectors: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """node and its `most` smallest ids, by salted groups first."""
    d = vectors.join(nodes.select("node", "v"), "v").select("node", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["node", "salt"], ["node"]):
        d = d.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= most)
    return d.select("node", "id")


def block_lists(nodes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """Neighbour lists from PASSES dealings into blocks, each by pivots and planes of its own. nodes: node, unit."""
    wanted = max(1, min(PIVOTS, count // PIVOT_NODES))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(wanted * PASSES).select("unit").collect()  # PIVOTS vectors a pass at most
    pivots = [_rows([bytes(p.unit) for p in drawn[i::PASSES] or drawn]) for i in range(PASSES)]
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng(i).normal(size=(p.shape[1], 48)) for i, p in enumerate(shared.value)]
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1).to_pylist())
                for i, p in enumerate(shared.value):
                    each = min(PIVOTS_EACH, len(p))
                    near = np.argpartition(-nearness(x, p), each - 1, axis=1)[:, :each].reshape(-1)
                    rows = np.repeat(np.arange(batch.num_rows), each)
                    side = (x @ planes[i])[rows] > (p @ planes[i])[near]
                    code = (side @ (np.int64(1) << np.arange(48, dtype=np.int64))).astype(np.int64)
                    part = batch.take(pa.array(rows))
                    pivot = (i * PIVOTS + near).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(pivot), part.column(0), part.column(1), pa.array(code)], names=["pivot", "node", "unit", "code"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0).to_pylist():
                ids, x = np.array([m["node"] for m in members]), _rows([m["unit"] for m in members])
                sims = nearness(x, x)
                np.fill_diagonal(sims, -9)
                k = min(BLOCK_DEGREE, len(ids) - 1)
                if k > 0:
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield _lists(ids.tolist(), list(ids[top]), list(np.take_along_axis(sims, top, 1)))

    spread = scratch.save(nodes.select("node", "unit").mapInArrow(assign, "pivot int, node long, unit binary, code long"))
    # as many signs as bring a pivot's nodes to the size of a block; PIVOTS rows a pass at most
    signs = F.broadcast(spread.groupBy("pivot").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK))).cast("int").alias("signs")))
    cells = spread.join(signs, "pivot").withColumn("cell", F.pmod("code", F.expr("shiftleft(1L, signs)"))).drop("code", "signs")
    sizes = scratch.save(cells.groupBy("pivot", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    blocks = cells.join(checked_broadcast(sizes, BROADCAST_ROWS), ["pivot", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")))
    grouped = blocks.groupBy("pivot", "cell", "block").agg(F.collect_list(F.struct("node", "unit")).alias("members")).select("members")
    return scratch.save(grouped.mapInArrow(local, LISTS))


def merged(lists: DataFrame, most: int) -> DataFrame:
    """One list a node, of the best `most` neighbours. A node has few lists: its own, and one from each batch that met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, got = [], []
            for node, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sims, fresh = (np.concatenate([p[c] for p in parts]) for c in ("nbrs", "sims", "fresh"))
                got.append(best_of(ids.astype(np.int64), sims.astype(np.float32), most, fresh.astype(bool)))
                nodes.append(node)
            yield _lists(nodes, [g[0] for g in got], [g[1] for g in got], [g[2] for g in got])

    return lists.groupBy("node").agg(F.collect_list(F.struct("nbrs", "sims", "fresh")).alias("parts")).mapInArrow(run, LISTS)


def descend(graph: DataFrame, nodes: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """One NN-descent round: lists that hold what each node met and did not have."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for members in batch.column(0).to_pylist():
                ids, inverse = np.unique([m["u"] for m in members], return_inverse=True)
                first = np.zeros(len(ids), np.int64)
                first[inverse] = np.arange(len(members))
                new = np.zeros(len(ids), bool)
                np.logical_or.at(new, inverse, [m["fresh"] for m in members])
                x, floor = _rows([members[i]["unit"] for i in first]), np.array([members[i]["floor"] for i in first], np.float32)
                sims = nearness(x[new], x).astype(np.float32)  # what is new against all
                own = np.flatnonzero(new)
                sims[np.arange(len(own)), own] = -9
                i, j = np.nonzero(sims > floor[own][:, None])
                k, m = np.nonzero(sims > floor[None, :])
                found.append((np.concatenate([ids[own[i]], ids[m]]), np.concatenate([ids[j], ids[own[k]]]), np.concatenate([sims[i, j], sims[k, m]])))
                held += len(found[-1][0])
                if held > HELD:
                    yield _best_each(*map(np.concatenate, zip(*found, strict=True)), DEGREE)
                    found, held = [], 0
        if held:
            yield _best_each(*map(np.concatenate, zip(*found, strict=True)), DEGREE)

    out = graph.select(F.col("node").alias("v"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("x")).select("v", F.col("x.nbrs").alias("u"), F.col("x.fresh").alias("fresh"))
    back = out.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh")
    # where nothing is new, nobody meets anew
    active = out.where("fresh").select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.lit(1).alias("one"))
    chunks = back.groupBy("v").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunks = scratch.save(active.join(chunks, "v", "left").select("v", F.coalesce("chunks", F.lit(1)).alias("chunks")))
    back = back.join(chunks, "v").select("v", "u", "fresh", F.pmod(F.xxhash64("u", F.lit(seed)), F.col("chunks")).alias("chunk"))
    ahead = out.join(chunks, "v").select("v", "u", "fresh", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    # a full list only takes what is more similar than its last entry
    floors = graph.select("node", F.when(F.size("nbrs") >= DEGREE, F.array_min("sims")).otherwise(-9.0).cast("float").alias("floor"))
    known = nodes.select("node", "unit").join(floors, "node").withColumnRenamed("node", "u")
    met = ahead.unionByName(back).join(known, "u").groupBy("v", "chunk").agg(F.collect_list(F.struct("u", "unit", "floor", "fresh")).alias("members"))
    return met.where(F.exists("members", lambda m: m["fresh"])).select("members").mapInArrow(local, LISTS)


def build_graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    graph = scratch.save(merged(block_lists(nodes, nodes.count(), scratch), DEGREE))
    seed = PASSES
    while True:
        old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        newer = scratch.save(merged(old.unionByName(descend(graph, nodes, seed, scratch)), DEGREE))
        scratch.drop(graph)
        graph, seed = newer, seed + 1
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("fresh")).alias("all")).collect()[0]
        if (changed.new or 0) <= GAIN * (changed["all"] or 0):
            return graph


def search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """starts: node. For each, its BEAM best candidates found by greedy search: node, nbrs, sims."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_, got = [], []
            for node, unit, old, old_sims, fresh in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.array([f["u"] for f in fresh], np.int64)
                s = nearness(_rows([unit]), _rows([f["unit"] for f in fresh]))[0].astype(np.float32)
                got.append(best_of(np.concatenate([np.array(old, np.int64), ids]), np.concatenate([np.array(old_sims, np.float32), s]), BEAM))
                nodes_.append(node)
            yield _lists(nodes_, [g[0] for g in got], [g[1] for g in got])

    # links in both directions, the closest LINKS; a hub's other links are found from their own ends
    ahead = graph.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("x")).select("node", F.col("x.nbrs").alias("nbr"), F.col("x.sims").alias("sim"))
    both = ahead.union(ahead.select("nbr", "node", "sim")).groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    near = both.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).where(F.col("r") <= LINKS)
    near = scratch.save(near.groupBy(F.col("node").alias("u")).agg(F.collect_list("nbr").alias("links")))
    units = nodes.select("node", "unit")
    beam = scratch.save(starts.join(graph, "node").select("node", "nbrs", "sims", F.array().cast("array<bigint>").alias("visited")))
    unseen = F.array_except(F.slice("nbrs", 1, REACH), F.col("visited"))
    while not beam.where(F.size(unseen) > 0).isEmpty():
        chosen = beam.select("*", F.slice(unseen, 1, WIDTH).alias("go"))
        asked = chosen.select("node", "nbrs", "visited", F.explode("go").alias("u")).join(near, "u")
        fresh = asked.select("node", F.explode(F.array_except("links", F.concat("nbrs", "visited", F.array("node")))).alias("u")).distinct()
        met = fresh.join(units.withColumnRenamed("node", "u"), "u").groupBy("node").agg(F.collect_list(F.struct("u", "unit")).alias("fresh"))
        ready = chosen.join(met, "node").join(units, "node").select("node", "unit", "nbrs", "sims", "fresh")
        scored = ready.mapInArrow(score, LISTS).drop("fresh")
        rest = beam.select("node", F.col("nbrs").alias("old"), F.col("sims").alias("old_sims"), "visited")
        step = chosen.select("node", "go").join(rest, "node").join(scored, "node", "left")
        newer = scratch.save(step.select("node", F.coalesce("nbrs", "old").alias("nbrs"), F.coalesce("sims", "old_sims").alias("sims"), F.array_union("visited", "go").alias("visited")))
        scratch.drop(beam)
        beam = newer
    return beam.select("node", "nbrs", "sims")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest rows of every query row: query_id, rank, id, score. is_query: a condition on the column `id`."""
    scratch = Scratch(vectors.sparkSession, "ann")
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    vectors = scratch.save(as_scaled(vectors.where(usable("v") & F.col("id").isNotNull())))
    out = None
    for n in sorted(r.n for r in vectors.select(F.size("v").alias("n")).distinct().collect()) or [0]:  # the lengths there are
        one = _nearest(vectors.where(F.size("v") == n), is_query, k, scratch)
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("found", key)


def scanned(tied: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """tied: node; nodes: node, v, least (its smallest id); saved tables. node, u and score of the k best of all nodes for each
    tied one, ties to the smaller least, SCAN queries at a time: every task gives k rows a query."""
    blocks, out = -(-tied.count() // SCAN), None
    placed = tied.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    for block in range(blocks):
        asked = placed.where(F.col("block") == block).join(nodes, "node").select("node", "v").collect()  # SCAN rows, about
        shared = nodes.sparkSession.sparkContext.broadcast(([r.node for r in asked], [np.array(r.v) for r in asked]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
            for batch in batches:
                if batch.num_rows:
                    u, least = (batch.column(i).to_numpy() for i in (0, 2))
                    b = np.array(batch.column(1).to_pylist())
                    for i, a in enumerate(vectors):
                        s = np.where(u == ids[i], -2, cosines(a, b))
                        both = [np.concatenate(x) for x in zip(best[i], (s, least, u), strict=True)]
                        top = np.lexsort((both[1], -both[0]))[:k]
                        best[i] = tuple(x[top] for x in both)
            for i, (s, _, u) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), ids[i])), pa.array(u), pa.array(s)], names=["node", "u", "score"])

        one = nodes.select("node", "v", "least").mapInArrow(run, "node long, u long, score double").where("node <> u")
        out = one if out is None else out.union(one)
    return out


def _nearest(vectors: DataFrame, is_query: Column, k: int, scratch: Scratch) -> DataFrame:
    """vectors: id, v, all of one length."""
    nodes = make_nodes(vectors, scratch)
    asked = scratch.save(vectors.where(is_query).join(nodes.select("node", "v"), "v").select("id", "node").distinct())
    graph = build_graph(nodes, scratch)
    found = search(asked.select("node").distinct(), graph, nodes, scratch)

    own = asked.select("node", F.col("node").alias("u")).distinct()  # copies of the query's vector
    pairs = found.select("node", F.explode(F.slice("nbrs", 1, FINAL)).alias("u")).union(own)
    exact = pairs.join(nodes.select("node", F.col("v").alias("a")), "node").join(nodes.select(F.col("node").alias("u"), F.col("v").alias("b")), "u")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.array(batch.column(i).to_pylist(), np.float64) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosines(a, b))], names=["node", "u", "score"])

    ids = smallest_ids(vectors, nodes, k + 1)
    scored = scratch.save(exact.select("node", "u", "a", "b").mapInArrow(score, "node long, u long, score double"))
    listed = scored.where("node <> u").groupBy("node").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # FINAL scores
    tied = scratch.save(listed.where((F.size("s") >= FINAL) & (F.element_at("s", -1) >= F.get("s", F.lit(k - 1)))).select("node"))
    if not tied.isEmpty():
        least = ids.groupBy("node").agg(F.min("id").alias("least"))
        all_nodes = scratch.save(nodes.join(least, "node").select("node", "v", "least"))
        scored = scored.union(scratch.save(scanned(tied, all_nodes, k))).distinct()
    ids = ids.select(F.col("node").alias("u"), F.col("id").alias("found"))
    rows = asked.join(scored, "node").join(ids, "u").where("id <> found").select("id", "found", "score").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "found"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "found", "score")
