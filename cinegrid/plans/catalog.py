"""The registered queries of the frame-sequence operators, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

from cinegrid.plans import codec_queries, container_queries, file_queries, format_queries, plane_queries, profile_queries, sample_queries, timeline_queries  # noqa: E402

for module in (timeline_queries, format_queries, sample_queries, codec_queries, container_queries, file_queries, plane_queries, profile_queries):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
