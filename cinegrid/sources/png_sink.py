"""Writing frames as PNG files exactly once: planned and named in Column expressions, encoded in tasks, published on commit.

Every task attempt writes files under names of its own beside their destinations. The driver's commit publishes what the
winning attempts wrote, so a retried or speculative task leaves no file behind and no frame is published twice. A ledger of what
commits have published outlives the call.
"""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from cinegrid.operators import sink_plan as P
from cinegrid.operators.fixed import fixed
from cinegrid.sources import codecs

SINK = "cinegrid_png"
COLUMNS = ["n", "path", "width", "height", "bits", "stored", "planes", "alpha", "cicp", "icc"]


def moved(v: np.ndarray, bits: int, stored: int) -> np.ndarray:
    """Samples of `bits` bits as samples of `stored` bits: repeated upwards, rounded downwards."""
    v = v.astype(np.int64)
    if bits == stored:
        return v
    if bits < stored:
        wide = (v << (16 - bits)) | (v >> (2 * bits - 16))
        return wide if stored == 16 else (wide * ((1 << stored) - 1) * 2 + 65535) // (2 * 65535)
    source, target = (1 << bits) - 1, (1 << stored) - 1
    return (v * target * 2 + source) // (2 * source)


def frame_bytes(row, level: int) -> bytes:
    kind = np.dtype("<u2") if row["bits"] > 8 else np.dtype(np.uint8)
    planes = [np.frombuffer(p, kind) for p in [*row["planes"], *([row["alpha"]] if row["alpha"] is not None else [])]]
    samples = np.stack([moved(p, row["bits"], row["stored"]).reshape(row["height"], row["width"]) for p in planes], 2)
    # colour chunks stand before what depends on them
    colour = [(b"cICP", bytes(row["cicp"]))] if row["cicp"] is not None else []
    colour += [(b"iCCP", b"ICC Profile\0\0" + zlib.compress(row["icc"], level))] if row["icc"] is not None else []
    extra = [(b"sBIT", bytes([row["bits"]] * len(planes)))] if row["bits"] < row["stored"] else []
    return codecs.write_png(samples, row["stored"], level, colour + extra)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, str]] = field(default_factory=list)


def same_bytes(a: str, b: str) -> bool:
    return filecmp.cmp(a, b, shallow=False)


class PngWriter(DataSourceWriter):
    """Tasks write temporary files beside their destinations; the commit publishes them and then says so in a file of the ledger.

    Publishing is exclusive: a name that exists is never replaced unless `replace` is set. Within an epoch (a batch of a stream) a
    file that exists with the same bytes was published by an attempt before this one, and counts. Temporary files, destinations and
    ledger are on a mount that driver and executors share.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.level, self.overwrite = int(options.get("compression", "6")), overwrite
        self.ledger, self.epoch = options.get("ledger"), options.get("epoch")

    def write(self, rows: Iterator[Row]) -> Written:
        out = Written()
        for row in rows:
            folder, name = os.path.split(row["path"])
            temp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.pngwrite")
            with open(temp, "xb") as f:
                f.write(frame_bytes(row, self.level))
            out.files.append((row["n"], temp, row["path"]))
        return out

    def mine(self, temp: str, path: str) -> bool:
        return self.epoch is not None and same_bytes(temp, path)

    def publish(self, temp: str, path: str) -> None:
        if self.overwrite:
            os.replace(temp, path)
            return
        try:
            os.link(temp, path)  # fails where the name exists, whoever made it meanwhile
        except FileExistsError:
            if not self.mine(temp, path):
                raise FileExistsError(f"{path} exists already; pass overwrite=True to replace it") from None
        os.remove(temp)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        try:
            if not self.overwrite and (there := [p for _, t, p in files if os.path.exists(p) and not self.mine(t, p)]):
                raise FileExistsError(f"{there[0]} exists already; pass overwrite=True to replace it")
            for _, temp, path in files:
                self.publish(temp, path)
        except FileExistsError:
            self.abort(messages)
            raise
        if self.ledger:
            label = uuid.uuid4().hex if self.epoch is None else f"epoch-{self.epoch}-{uuid.uuid4().hex}"
            temp = os.path.join(self.ledger, f".{label}")
            with open(temp, "x") as f:
                f.writelines(json.dumps({"n": n, "path": path}) + "\n" for n, _, path in files)
            os.replace(temp, os.path.join(self.ledger, f"{label}.json"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for _, temp, _ in m.files if m else []:
                if os.path.exists(temp):
                    os.remove(temp)


class PngSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options, overwrite or self.options.get("replace") == "true")


def write_png(frames: DataFrame, output_path: str | None = None, output_dir: str | None = None, start_number: int = 0, overwrite: bool = False, compression: int = 6, depth: int | None = None, ledger: str | None = None, always_save: bool = False, epoch: int | None = None, export_icc_profile: bool = False) -> DataFrame:
    """Writes frames (n, path, format, width, height, planes, alpha) and returns their receipts, one for each row that asks for a
    frame: n, path, saved, performed.

    Exactly one of output_path (a template with %d, %0Nd, %%) and output_dir (files named after their sources) is given.
    A frame that is asked for twice is written once: one of its receipts says performed. Two frames with one destination are
    refused before anything is written. ledger names a folder that remembers what was published: frames in it are not written
    again, and their receipts say so, unless always_save is set, which writes every frame asked for. saved is what the commit has
    recorded there (in a folder of the call without a ledger). epoch makes a repeated call idempotent.

    Where frames have the columns primaries and transfer, a frame that names both is given a cICP chunk, unless its matrix isn't 0 or
    its full_range false. icc_profile is written with export_icc_profile only.
    """
    if (output_path is None) == (output_dir is None):
        raise ValueError("exactly one of output_path and output_dir is needed")
    if not 0 <= compression <= 9:
        raise ValueError("compression must be between 0 and 9")
    if depth not in (None, 1, 2, 4, 8, 16):
        raise ValueError("depth must be 1, 2, 4, 8 or 16")
    if output_dir is not None:
        if start_number:
            raise ValueError("start_number needs output_path")
        os.makedirs(output_dir, exist_ok=True)
        target = F.concat(F.lit(output_dir.rstrip("/") + "/"), P.source_name(F.col("path"), F.lit(False), F.col("n")))
    else:
        if start_number < 0:
            raise ValueError("start_number must not be negative")
        if not os.path.isdir(os.path.dirname(os.path.abspath(output_path))):
            raise ValueError("the folder of output_path does not exist")
        target = P.render_template(output_path, F.col("n") + start_number)
    bits = F.when(F.col("format").isin("Gray16", "RGB48"), 16).otherwise(8)
    family = F.when(F.col("format").startswith("Gray"), "Gray").otherwise("RGB")
    plan = P.write_plan(family, F.lit("integer"), bits, F.col("alpha").isNotNull(), F.lit(depth).cast("int"))
    spark = frames.sparkSession
    known = "n long, path string"
    book = ledger or tempfile.mkdtemp(prefix=".ledger-", dir=output_dir or os.path.dirname(os.path.abspath(output_path)))
    try:
        os.makedirs(book, exist_ok=True)
        before = fixed(spark.read.schema(known).json(book).distinct())
        named = frames.withColumn("target", target).withColumn("_seq", F.monotonically_increasing_id())
        asked = fixed(named.select("n", "target", "_seq"))  # what is asked for is settled before anything is written
        clash = P.conflicts(asked.select("n", "target").distinct(), "target", "n").limit(1).collect()
        if clash:
            raise ValueError(f"frames {clash[0]['first']} and {clash[0]['last']} would both be written to {clash[0].target}")
        wanted = frames.dropDuplicates(["n"]).withColumn("target", target)
        if not always_save:
            wanted = wanted.join(before.select("n"), "n", "left_anti")
        has = lambda name, kind: F.col(name).cast(kind) if name in frames.columns else F.lit(None).cast(kind)
        # 2 is "unspecified", and a chunk holds bytes
        code = lambda name: F.when(has(name, "int").between(0, 255) & (has(name, "int") != 2), has(name, "int"))
        cicp = P.cicp_chunk(code("primaries"), code("transfer"), F.lit(False), has("matrix", "int"), has("full_range", "boolean"))
        icc = has("icc_profile", "binary") if export_icc_profile else F.lit(None).cast("binary")
        ready = wanted.select("n", F.col("target").alias("path"), "width", "height", bits.alias("bits"), "planes", "alpha", cicp.alias("cicp"), icc.alias("icc"), *plan)
        refused = F.when(F.col("refused").isNotNull(), F.raise_error(F.concat(F.lit("frame "), F.col("n").cast("string"), F.lit(" cannot be written: "), F.col("refused"))))
        ready = ready.withColumn("path", F.coalesce(refused.cast("string"), F.col("path"))).select(*COLUMNS)
        register(spark)
        options = {"compression": str(compression), "replace": str(overwrite).lower(), "ledger": book} | ({} if epoch is None else {"epoch": str(epoch)})
        ready.write.format(SINK).options(**options).mode("append").save()
        after = fixed(spark.read.schema(known).json(book).select("n").distinct())
    finally:
        if ledger is None:
            shutil.rmtree(book)
    receipts = P.ledger(asked, "n", "_seq", always_save).drop("saved")
    receipts = receipts.join(before.select("n", F.lit(True).alias("_old")).distinct(), "n", "left").join(after.withColumn("_kept", F.lit(True)), "n", "left")
    performed = F.col("performed") if always_save else F.col("performed") & F.col("_old").isNull()
    return receipts.select("n", F.col("target").alias("path"), F.col("_kept").isNotNull().alias("saved"), performed.alias("performed"))


def stream_writer(ledger: str, **arguments) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch that writes each batch's frames once: a batch that is given again after a failure
    finds its own files, and frames of earlier batches are in the ledger."""

    def write(batch: DataFrame, epoch: int) -> None:
        write_png(batch, ledger=ledger, epoch=epoch, **arguments)

    return write


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PngSink)
