"""The reduced view of a trace: bodies as text, sizes, flags, redaction."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wirebook.functions.http import status_class
from wirebook.functions.text import (
    body_is_longer, body_text, clock_utc, duration_label, ellipsis, first_lines, redact,
)

PREVIEW_LINES = 30
#: JSON of more levels is shown as plain text.
JSON_DEPTH = 127


@dataclass(frozen=True)
class ViewOptions:
    """``max_body`` None means whole bodies, 0 means empty ones."""

    max_body: int | None = None
    headers_only: bool = False
    redact_headers: list[str] = field(default_factory=list)


def floor_ms(ns: Column) -> Column:
    """Whole milliseconds, exact for every BIGINT; times before 1970 read 0."""
    ms = F.call_function("div", F.greatest(ns, F.lit(0)), F.lit(1_000_000))
    return ms


def _true_or_null(flag: Column) -> Column:
    return F.when(flag, F.lit(True))


def _body(name: str, options: ViewOptions) -> Column:
    if options.headers_only:
        return F.lit(None).cast("string").alias(name)
    return body_text(F.col(name), options.max_body).alias(name)


def _truncated(name: str, options: ViewOptions) -> Column:
    out = f"{name}_truncated"
    if options.headers_only or options.max_body is None:
        return F.lit(None).cast("boolean").alias(out)
    return _true_or_null(body_is_longer(F.col(name), options.max_body)).alias(out)


def render_view(traces: DataFrame, options: ViewOptions = ViewOptions()) -> DataFrame:
    """The 18 view columns. Absent values and false flags are null, so that
    JSON output leaves them out. Headers-only views never read the bodies."""
    return traces.select(
        floor_ms(F.col("ts_ns")).alias("timestamp_ms"),
        floor_ms(F.col("duration_ns")).alias("duration_ms"),
        "method", "url", "status_code",
        redact(F.col("request_headers"), options.redact_headers).alias("request_headers"),
        redact(F.col("response_headers"), options.redact_headers).alias("response_headers"),
        _body("request_body", options), _body("response_body", options),
        "request_body_bytes", "response_body_bytes",
        _truncated("request_body", options), _truncated("response_body", options),
        "source_addr", "dest_addr", "protocol_version", "trace_id", "span_id",
    )


def summary_rows(traces: DataFrame) -> DataFrame:
    """One list line per trace: time of day, URL without scheme, status class."""
    shown = F.regexp_replace("url", r"\Ahttps?://", "")
    return traces.select(
        "span_id",
        clock_utc(F.col("ts_ns")).alias("time"),
        "method",
        ellipsis(shown, 30).alias("url"),
        "status_code",
        status_class(F.col("status_code")).alias("status_class"),
        duration_label(F.col("duration_ns")).alias("duration"),
    )


def header_preview(headers: Column) -> Column:
    """Header values cut to 60 bytes."""
    return F.transform_values(headers, lambda _, value: ellipsis(value, 60))


def _indented_json(text: Column) -> Column:
    # Defined in here, so that it is shipped with the query and the package
    # need not be installed on the executors.
    @F.pandas_udf(StringType())
    def indented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json
        import math
        import re
        from decimal import Decimal

        token = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?e[+-][0-9]+|[\[{\]}]', re.S)

        def number(text):
            value = float(text)
            if math.isinf(value):
                raise ValueError(text)
            return value

        def whole(text):
            value = int(text)
            return value if -(1 << 63) <= value < 1 << 64 and text != "-0" else number(text)

        def exponent(found):
            """Python's 1e+16 and 1e-05 in the form 1e16 and 0.00001."""
            text = found[0]
            if "e" not in text or text[0] == '"':
                return text
            digits, power = text.split("e")
            return format(Decimal(text), "f") if int(power) == -5 else f"{digits}e{int(power)}"

        def depth(text):
            level = most = 0
            for found in token.finditer(text):
                level += (found[0] in "[{") - (found[0] in "]}")
                most = max(most, level)
            return most

        def indent(value):
            """Null for what is only nearly JSON: a lone surrogate, a number out of range, too many levels."""
            if value is None or depth(value) > JSON_DEPTH:
                return None
            try:
                parsed = json.loads(value, parse_float=number, parse_int=whole)
                text = json.dumps(parsed, indent=2, sort_keys=True, ensure_ascii=False)
                text.encode()
            except (ValueError, RecursionError):
                return None
            return token.sub(exponent, text)

        for batch in batches:
            yield batch.map(indent)

    return indented(text)


def body_kind(body: Column) -> Column:
    """``json``, ``text`` or ``binary``; null without a body."""
    text = body.cast("string")
    return (
        F.when(~F.is_valid_utf8(text), F.lit("binary"))
        .when(F.try_parse_json(text).isNotNull(), F.lit("json"))
        .when(body.isNotNull(), F.lit("text"))
    )


def body_preview(body: Column) -> Column:
    """First 30 lines: JSON indented with sorted keys, other text as it is;
    ``<binary, N bytes>`` when the body is not UTF-8. Meant for a page of traces."""
    kind = body_kind(body)
    text = body.cast("string")
    pretty = _indented_json(F.when(kind == "json", text))
    return (
        F.when(kind == "binary", F.format_string("<binary, %d bytes>", F.octet_length(body)))
        .when(kind.isNotNull(), first_lines(F.coalesce(pretty, text), PREVIEW_LINES))
    )


def trace_detail(traces: DataFrame) -> DataFrame:
    """The detail pane of each trace."""
    return traces.select(
        "span_id", "method", "url", "status_code",
        status_class(F.col("status_code")).alias("status_class"),
        duration_label(F.col("duration_ns")).alias("duration"),
        header_preview(F.col("request_headers")).alias("request_headers"),
        header_preview(F.col("response_headers")).alias("response_headers"),
        body_preview(F.col("request_body")).alias("request_preview"),
        body_preview(F.col("response_body")).alias("response_preview"),
    )
