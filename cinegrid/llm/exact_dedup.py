"""Exact dedup by skew-safe combining.

1. Each task combines the equal texts that it reads, comparing whole normalised texts.
2. What is left (one row for each text and task) is grouped by digest, salt and whole text. The salt is 0 but for the
   HOT_GROUPS digests that most tasks hold, whose rows are spread over SALTS groups.
3. Of hot digests, the salt winners are combined by digest and whole text, and their verdict joins back on narrow keys.

Texts are equal when identical after deleting white space. Of equal texts the row with the most code points stays, then
the one with the smallest id (null ids last), then the first row read. A null text counts as empty, and empty texts equal
each other. Repeated rows are ordinary members of their group. An empty table gives an empty result. Other columns are
carried along by `drop_duplicates` and ignored by `duplicate_groups`; their names cannot clash with internal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinegrid.llm.common import SPACE_CHARS, Scratch

#: Digests that get salted: at most so many, the most frequent first. With N rows, any other group has at most
#: N / HOT_GROUPS rows left after step 1, so the list stays small and complete at every size.
HOT_GROUPS = 10_000
#: A digest is worth salting when so many tasks hold it.
HOT_FROM = 64
SALTS = 32
#: A task combines within windows of so many bytes, which bounds its memory: of the texts it holds (with payload, of all rows
#: read, else of the different texts), and ROW_BYTES for each row.
WINDOW_BYTES, ROW_BYTES = 16 << 20, 64


def _combiner(text: str, key: str | None, payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1. With payload the best row of each text goes on whole, else its normalised text and its members' ids."""
    spaces = SPACE_CHARS.encode()
    ids_too = key is not None and not payload

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        best: dict[bytes, list] = {}  # text -> chars, -id, -tag, batch, row, ids
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = sorted(best.items(), key=lambda kv: (kv[1][3], kv[1][4]))
            for at, batch in enumerate(held):
                mine = [kv for kv in items if kv[1][3] == at]
                if not mine:
                    continue
                rows = [v for _, v in mine]
                out = {
                    "chars": pa.array([v[0] for v in rows], pa.int64()), "neg_id": pa.array([v[1] for v in rows], pa.int64()), "neg_tag": pa.array([v[2] for v in rows], pa.int64()),
                    "digest": pa.array([hashlib.sha256(k).digest() for k, _ in mine], pa.binary()),
                }
                if payload:
                    taken = pa.Table.from_batches([batch]).take([v[4] for v in rows]).combine_chunks()
                    out = {f"p{i}": c for i, c in enumerate(taken.columns)} | out
                elif ids_too:
                    out |= {"content": pa.array([k for k, _ in mine], pa.binary()), "ids": pa.array([v[5] for v in rows], pa.list_(pa.int64()))}
                yield from pa.Table.from_pydict(out).to_batches()
            held.clear()
            best.clear()

        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            chars = pc.utf8_length(texts).to_pylist()
            ids = batch.column(batch.schema.get_field_index(key)).to_pylist() if key else [None] * len(chars)
            for row, (raw, n, i) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), chars, ids, strict=True)):
                norm = raw.translate(None, spaces)
                tag += 1
                mine = [n, -(1 << 63) if i is None else -i, -tag, len(held), row, [i]]
                old = best.get(norm)
                size += ROW_BYTES + (len(raw) if payload or old is None else 0)
                if old is None:
                    best[norm] = mine
                elif mine[:3] > old[:3]:
                    if ids_too:
                        old[5].append(i)
                        old[5][0], old[5][-1] = i, old[5][0]  # the best one's id is the first
                        mine[5] = old[5]
                    best[norm] = mine
                elif ids_too:
                    old[5].append(i)
            held.append(batch if payload else None)
            if size > WINDOW_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return combine


def _salted(local: DataFrame, digests: DataFrame) -> tuple[DataFrame, bool]:
    """local with a salt, and whether any digest is hot."""
    hot = digests.groupBy("digest").count().where(F.col("count") >= HOT_FROM).orderBy(F.desc("count"), "digest").limit(HOT_GROUPS).select("digest")
    hot = Scratch(local.sparkSession, "exact-hot").save(hot)
    if hot.isEmpty():
        return local.withColumn("salt", F.lit(0)), False
    spread = F.pmod(F.xxhash64("neg_tag"), F.lit(SALTS)).cast("int") + 1
    marked = local.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")  # HOT_GROUPS rows of 32 bytes at most
    return marked.withColumn("salt", F.when(F.col("hot"), spread).otherwise(0)).drop("hot"), True


BEST = ("chars", "neg_id", "neg_tag")
LOCAL = "chars long, neg_id long, neg_tag long, digest binary"


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept and the digest of the normalised text."""
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    local = narrow.mapInArrow(_combiner("text", "id", False), f"{LOCAL}, content binary, ids array<long>")
    local, any_hot = _salted(local, narrow.mapInArrow(_combiner("text", None, False), LOCAL))
    group = W.partitionBy("digest", "salt", "content")
    combined = local.withColumns({"best": F.max(F.struct(*BEST)).over(group), "group_size": F.sum(F.size("ids")).over(group)})
    if any_hot:
        narrow_cols = ["digest", "salt", "neg_tag", "ids", "best", "group_size"]
        winner = F.when((F.col("salt") > 0) & (F.col("neg_tag") == F.col("best.neg_tag")), F.col("content"))
        combined = Scratch(docs.sparkSession, "exact-salted").save(combined.select(*narrow_cols, winner.alias("content")))
        final = W.partitionBy("digest", "content")
        verdict = (
            combined.where(F.col("content").isNotNull())
            .withColumns({"top": F.max("best").over(final), "all": F.sum("group_size").over(final)})
            .select("digest", "salt", F.col("best.neg_tag").alias("winner"), "top", "all")
        )
        combined = combined.withColumn("winner", F.col("best.neg_tag")).join(verdict, ["digest", "salt", "winner"], "left")
        combined = combined.withColumns({"best": F.coalesce("top", "best"), "group_size": F.coalesce("all", "group_size")})
    keep = F.when(F.col("best.neg_id") != F.lit(-(1 << 63)), -F.col("best.neg_id"))
    return combined.select(
        "neg_tag", "best", "group_size", "digest", F.posexplode("ids").alias("at", "id")
    ).select(
        F.col("id").alias(key), keep.alias("keep_id"), "group_size",
        ((F.col("at") == 0) & (F.col("neg_tag") == F.col("best.neg_tag"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; texts are shuffled once."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(names)])
    p_key, p_text = f"p{names.index(key)}", f"p{names.index(text)}"
    types = ", ".join(f"p{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    local = plain.mapInArrow(_combiner(p_text, p_key, True), f"{types}, {LOCAL}")
    narrow = plain.select(F.col(p_text).alias("text"))
    local, any_hot = _salted(local, narrow.mapInArrow(_combiner("text", None, False), LOCAL))
    content = F.translate(F.coalesce(F.col(p_text), F.lit("")), SPACE_CHARS, "")
    columns = [F.col(f"p{i}").alias(c) for i, c in enumerate(names)]
    for keys in (["digest", "salt", "content"], ["digest", "content"])[: 1 + any_hot]:
        local = local.withColumn("content", content).withColumn("best", F.max(F.struct(*BEST)).over(W.partitionBy(*keys)))
        local = local.where(F.col("neg_tag") == F.col("best.neg_tag")).drop("best", "content")
    return local.select(*columns)
