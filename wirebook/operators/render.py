"""Text output of views: JSON lines, one JSON array, a fixed-width table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.functions.text import rfc3339_ms
from wirebook.schema import VIEW_COLUMNS

TABLE_HEADER = f"{'TIME':<24}  {'METHOD':<7}  {'STATUS':>6}  {'DURATION':>8}  {'SPAN_ID':<17}  URL"


def view_json() -> Column:
    """One view row as a JSON object; null fields are left out."""
    return F.to_json(F.struct(*VIEW_COLUMNS))


def json_lines(view: DataFrame) -> DataFrame:
    return view.select(view_json().alias("line"))


def json_array(page: DataFrame) -> DataFrame:
    """One indented JSON array for a page that is already cut and ordered.

    The array is ordered again by the page's own order, so the page may be
    gathered in any order. Only for pages: a page is bounded by its limit.
    """
    return _gathered(page).select(F.to_json(F.transform("rows", lambda r: r["row"]), {"pretty": "true"}).alias("json"))


def _gathered(page: DataFrame) -> DataFrame:
    rows = page.select(F.struct(*VIEW_COLUMNS).alias("row"), F.monotonically_increasing_id().alias("at"))
    gathered = F.array_sort(
        F.collect_list(F.struct("at", "row")),
        lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0),
    )
    return rows.agg(gathered.alias("rows"))


def json_object(view: DataFrame) -> DataFrame:
    """Each row as one indented JSON object; for a view of one trace."""
    return view.select(F.to_json(F.struct(*VIEW_COLUMNS), {"pretty": "true"}).alias("json"))


def traces_object(page: DataFrame) -> DataFrame:
    """One JSON object, ``{"traces": [...]}``, for a page that is already cut and ordered, like ``json_array``."""
    return _gathered(page).select(F.to_json(F.struct(F.transform("rows", lambda r: r["row"]).alias("traces"))).alias("json"))


def table_lines(view: DataFrame) -> DataFrame:
    """``TIME METHOD STATUS DURATION SPAN_ID URL``; print TABLE_HEADER above."""
    return view.select(
        F.format_string(
            "%-24s  %-7s  %6d  %6dms  %-17s  %s",
            rfc3339_ms(F.col("timestamp_ms")),
            "method", "status_code", "duration_ms", "span_id", "url",
        ).alias("line")
    )
