"""Streaming forms of the window operators, for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity (key, ts) with at most ``gap`` between neighbours, as rows come in."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("run"), "key").agg(F.count("*").alias("n")).select("key", "run.start", "run.end", "n")
