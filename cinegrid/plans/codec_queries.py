"""Encode and decode round trips: each embedding is a 64-sample gray picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.plans.sample_queries import S16, S8, samples
from cinegrid.sources import codecs


def _png(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in batch.column(1).to_pylist():
            coded = codecs.write_png(np.array(s, np.uint16).reshape(8, 8, 1), 16)
            out.append(codecs.decode("png", coded).samples.reshape(-1).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["vec_id", "s"])


def _pnm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [codecs.decode("pnm", b"P5\n# a comment\n16 4\n255\n" + bytes(s)).samples.reshape(-1).tolist() for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["vec_id", "s"])


def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir, 16).select("vec_id", "s").mapInArrow(_png, "vec_id long, s array<int>")
    return d.select("vec_id", F.posexplode("s").alias("i", "s"))


def pnm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).select("vec_id", "s").mapInArrow(_pnm, "vec_id long, s array<int>")
    return d.select("vec_id", F.posexplode("s").alias("i", "s"))


QUERIES = {"png_roundtrip": png_roundtrip, "pnm_decode": pnm_decode}
ORACLE = {
    "png_roundtrip": f"SELECT vec_id, CAST(i AS INTEGER) AS i, s FROM ({S16})",
    "pnm_decode": f"SELECT vec_id, CAST(i AS INTEGER) AS i, s FROM ({S8})",
}
