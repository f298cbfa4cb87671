"""Lookups and pages over a frame of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.operators.filters import TraceQuery, url_contains
from wirebook.params import parse_span_id, parse_trace_id
from wirebook.schema import STORE_PAGE


def newest_first(traces: DataFrame) -> DataFrame:
    """Time descending; equal times by span id descending."""
    return traces.orderBy(F.desc("ts_ns"), F.desc("span_id"))


def _cut(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def get_by_span_id(traces: DataFrame, span_id: str) -> DataFrame:
    """At most one row."""
    return traces.where(F.col("span_id") == parse_span_id(span_id)).limit(1)


def spans_of_trace(traces: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace, by span id."""
    return traces.where(F.col("trace_id") == parse_trace_id(trace_id)).orderBy("span_id")


def list_recent(traces: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; a limit of 0 gives nothing."""
    return _cut(newest_first(traces), limit, offset)


def search_by_url(traces: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Case-sensitive URL search, newest first; a limit of 0 gives nothing."""
    return _cut(newest_first(traces.where(url_contains(pattern, F.col("url"), ignore_case=False))), limit, 0)


def query_page(traces: DataFrame, query: TraceQuery, newest: bool = False) -> DataFrame:
    """Filter, order, skip, take: one top-k node, no full sort.

    A page of one trace id comes in span id order, every other page newest
    first. ``newest=True`` asks for newest first in both cases.
    """
    matching = traces.where(query.predicate(has_dt="dt" in traces.columns, newest=newest))
    if query.trace_id is not None and not newest:
        ordered = matching.orderBy("span_id")
    else:
        ordered = newest_first(matching)
    return _cut(ordered, query.limit or STORE_PAGE, query.offset)
