"""The once-only ledger on a stream of frame requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_requests(requests: DataFrame, frame: str = "frame", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The requests that perform a write: the first of each frame.

    Without a time column the state keeps every frame; with one, frames are forgotten after the watermark has passed.
    """
    if time is None:
        return requests.dropDuplicates([frame]).withColumn("performed", F.lit(True))
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark([frame]).withColumn("performed", F.lit(True))
