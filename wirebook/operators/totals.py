"""Counts over stored traces. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.operators.filters import url_contains


def count_traces(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count(F.lit(1)).alias("total_traces"))


def count_listed(traces: DataFrame, url_filter: str = "") -> DataFrame:
    """Held traces and those that pass the list filter."""
    return traces.agg(
        F.count(F.lit(1)).alias("held"),
        F.count_if(url_contains(url_filter, F.col("url"))).alias("listed"),
    )


def stats(traces: DataFrame, data_dir: str) -> DataFrame:
    """One row: exact count, where the data lives, running capture queries."""
    active = len(traces.sparkSession.streams.active)
    return count_traces(traces).select(
        "total_traces", F.lit(data_dir).alias("data_dir"), F.lit(active).alias("active_sessions")
    )


def capture_status(traces: DataFrame, capture_id: str | None = None) -> DataFrame:
    """Traces per capture, ordered by the capture's first trace."""
    chosen = traces if capture_id is None else traces.where(F.col("capture_id") == capture_id)
    return (
        chosen.groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("trace_count"),
            F.min("ts_ns").alias("first_ns"),
            F.max("ts_ns").alias("last_ns"),
        )
        .orderBy("first_ns", "capture_id")
    )
