"""Collector messages: JSON text of one exchange each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.functions.http import known_method, trace_ids
from wirebook.functions.text import base64_decode, base64_encode, last_wins
from wirebook.schema import MESSAGE_LIMIT
from wirebook.sources.tables import with_storage_columns

# Texts are read as VARIANT first: a number in place of a text must fail the
# message, and a STRING field would quietly accept it.
_READ_DDL = """
    method VARIANT, url VARIANT, status_code BIGINT,
    request_headers MAP<STRING,VARIANT>, response_headers MAP<STRING,VARIANT>,
    request_body_b64 VARIANT, response_body_b64 VARIANT,
    duration_ms BIGINT, timestamp_ms BIGINT, dest_addr VARIANT, protocol_version VARIANT,
    _corrupt_record STRING
"""
_REQUIRED_TEXTS = ["method", "url"]
_OPTIONAL_TEXTS = ["request_body_b64", "response_body_b64", "dest_addr", "protocol_version"]
_HEADERS = ["request_headers", "response_headers"]


def fits_message(value: Column) -> Column:
    """Whether a message is short enough to be sent."""
    return F.octet_length(value) <= MESSAGE_LIMIT


def _variant_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_text(name: str) -> Column:
    return F.coalesce(_variant_type(F.col(name)) == "STRING", F.lit(False))


def _is_text_or_absent(name: str) -> Column:
    return F.coalesce(_variant_type(F.col(name)).isin("STRING", "VOID"), F.lit(True))


def _all_texts(name: str) -> Column:
    return F.coalesce(
        F.forall(F.map_values(name), lambda v: F.coalesce(_variant_type(v) == "STRING", F.lit(False))),
        F.lit(False),
    )


def read_messages(lines: DataFrame) -> DataFrame:
    """Parse ``value`` and add ``accepted``. Every other column is kept, so
    rejected rows can go to a quarantine table as they came."""
    # Generated columns, because a filter on plain ones would be pushed down
    # with one copy of the parser per condition.
    message = F.from_json("value", _READ_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select("*", F.inline_outer(F.array(message)))
    good = fits_message(F.col("value")) & F.col("_corrupt_record").isNull()
    for name in _REQUIRED_TEXTS:
        good = good & _is_text(name)
    for name in _OPTIONAL_TEXTS:
        good = good & _is_text_or_absent(name)
    for name in _HEADERS:
        good = good & _all_texts(name)
    good = (
        good
        & F.coalesce(F.col("status_code").between(0, 65535), F.lit(False))
        & F.coalesce(F.col("duration_ms") >= 0, F.lit(False))
        & F.coalesce(F.col("timestamp_ms") >= 0, F.lit(False))
    )
    return parsed.withColumn("accepted", F.coalesce(good, F.lit(False)))


def _text(name: str) -> Column:
    return F.try_variant_get(F.col(name), "$", "string")


def _header_entries(name: str) -> Column:
    return F.transform(
        F.map_entries(name),
        lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")),
    )


def message_traces(lines: DataFrame, source: Column | None = None) -> DataFrame:
    """Traces of the accepted messages.

    Ids come from ``source`` (default: the message text), so a message that is
    read again gives the same row again.
    """
    accepted = read_messages(lines).where("accepted").withColumns({
        **{name: _text(name) for name in [*_REQUIRED_TEXTS, *_OPTIONAL_TEXTS]},
        **{name: _header_entries(name) for name in _HEADERS},
    })
    c = F.col
    trace_id, span_id = trace_ids(c("value") if source is None else source)
    return with_storage_columns(accepted.select(
        span_id.alias("span_id"), trace_id.alias("trace_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        known_method(c("method")).alias("method"),
        "url",
        last_wins(c("request_headers")).alias("request_headers"),
        base64_decode(c("request_body_b64")).alias("request_body"),
        c("status_code").cast("int").alias("status_code"),
        last_wins(c("response_headers")).alias("response_headers"),
        base64_decode(c("response_body_b64")).alias("response_body"),
        (c("timestamp_ms") * 1_000_000).alias("ts_ns"),
        (c("duration_ms") * 1_000_000).alias("duration_ns"),
        F.lit(None).cast("string").alias("source_addr"),
        "dest_addr",
        F.coalesce("protocol_version", F.lit("HTTP/1.1")).alias("protocol_version"),
        F.lit("agent").alias("capture_id"),
    ))


def rejected_messages(lines: DataFrame) -> DataFrame:
    return read_messages(lines).where("NOT accepted").select(*lines.columns)


def to_messages(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reassembled exchanges as collector messages, ``span_id, value``, and with
    the same columns those that are too long to be sent."""
    message = F.to_json(F.struct(
        "method", "url", "status_code", "request_headers", "response_headers",
        base64_encode(F.col("request_body")).alias("request_body_b64"),
        base64_encode(F.col("response_body")).alias("response_body_b64"),
        F.call_function("div", F.col("duration_ns"), F.lit(1_000_000)).alias("duration_ms"),
        F.call_function("div", F.col("ts_ns"), F.lit(1_000_000)).alias("timestamp_ms"),
        "dest_addr", "protocol_version",
    ))
    rendered = exchanges.select("span_id", message.alias("value"))
    fits = fits_message(F.col("value"))
    return rendered.where(fits), rendered.where(~fits)
