"""Request and response records of connections, joined into traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.functions.http import absolute_url, known_method, trace_ids
from wirebook.functions.text import present
from wirebook.operators.scan import Max, scan
from wirebook.session import durable
from wirebook.sources.tables import with_storage_columns


def paired_keys(requests: DataFrame, responses: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conn_id, request_seq, response_seq) of every answered request.

    A request waits until the next response, and a newer request replaces it;
    so a response answers exactly the record right before it on its
    connection, if that is a request. Works on keys alone, no payload moves.
    """
    # The last bit of the code tells the kind, the rest is the sequence number.
    code = F.col("seq") * 2
    codes = durable(requests.select("conn_id", (code + 1).alias("code")).unionAll(responses.select("conn_id", code.alias("code"))), "codes")
    previous = scan(codes, ["conn_id"], "code", {"previous": Max(F.col("code"), before=True)}, partitions)
    halved = lambda c: F.call_function("div", F.col(c), F.lit(2))
    return previous.where("code % 2 = 0 AND previous % 2 = 1").select(
        "conn_id", halved("previous").alias("request_seq"), halved("code").alias("response_seq")
    )


def paired_record(pairs: DataFrame) -> DataFrame:
    """Trace rows from joined request and response columns (r_*, s_*)."""
    trace_id, span_id = trace_ids(F.col("conn_id"), F.col("request_seq").cast("string"))
    return with_storage_columns(pairs.select(
        span_id.alias("span_id"), trace_id.alias("trace_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        known_method(F.col("method"), ignore_case=False).alias("method"),
        absolute_url(F.col("uri"), F.col("host"), F.col("path")).alias("url"),
        F.col("request_headers"),
        present(F.col("request_body")).alias("request_body"),
        "status_code", "response_headers",
        present(F.col("response_body")).alias("response_body"),
        F.col("started_ns").alias("ts_ns"),
        F.greatest(F.col("ended_ns") - F.col("started_ns"), F.lit(0)).alias("duration_ns"),
        "source_addr", F.lit(None).cast("string").alias("dest_addr"), "protocol_version",
        F.col("conn_id").alias("capture_id"),
    ))


def pair_requests(requests: DataFrame, responses: DataFrame, partitions: int | None = None) -> DataFrame:
    """Traces of all answered requests. Both payload joins are on unique keys,
    so no connection is hot."""
    keys = paired_keys(requests, responses, partitions)
    answered = responses.select(
        "conn_id", F.col("seq").alias("response_seq"), "ended_ns", "status_code",
        F.col("headers").alias("response_headers"), F.col("body").alias("response_body"),
    ).join(keys, ["conn_id", "response_seq"])
    asked = requests.select(
        "conn_id", F.col("seq").alias("request_seq"), "started_ns", "method", "uri", "host", "path",
        F.col("headers").alias("request_headers"), F.col("body").alias("request_body"),
        "source_addr", "protocol_version",
    )
    return paired_record(answered.join(asked, ["conn_id", "request_seq"]))
