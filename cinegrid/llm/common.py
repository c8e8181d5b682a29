"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch at most (but one row): batches of 64 MB, Spark's own limit, take several times that in both processes.
ARROW_BYTES = 4 << 20
#: Rows that one task writes of an intermediate table whose size is known.
ROWS_A_TASK = 8192
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a temporary one if all run in one process (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cinegrid-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ARROW_BYTES; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name) or ""
    if not held.removesuffix("b").isdigit() or int(held.removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


class Scratch:
    """Intermediate tables in the shared folder: each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, rows: int = 0, each: int = ROWS_A_TASK) -> DataFrame:
        """df, written and read again. With rows (about how many, or more): by one task for `each` of them, so that a small
        table is not written in as many files as a shuffle has partitions."""
        if rows:
            df = df.coalesce(-(-rows // each))
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows; else df itself, so that the join shuffles.

    df must be cheap to count (a saved table). Both plans give the same rows.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
