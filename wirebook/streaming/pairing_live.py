"""Live pairing: a connection's request waits for its response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.operators.pairing import paired_record
from wirebook.schema import REQUEST_DDL, RESPONSE_DDL
from wirebook.streaming.state import IDLE_MS, ConnectionProcessor, per_connection

RECORD_DDL = "conn_id STRING, seq BIGINT, kind STRING, record STRING"
PAIR_DDL = "conn_id STRING, request_seq BIGINT, request STRING, response STRING"


def connection_records(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Both sides as (conn_id, seq, kind, record); ``record`` is the whole row as JSON."""

    def side(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("conn_id", "seq", F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("record"))

    return side(requests, "request").unionAll(side(responses, "response"))


class PairProcessor(ConnectionProcessor):
    def fresh(self):
        return {"pending": None}

    def is_empty(self, state):
        return state["pending"] is None

    def step(self, state, row):
        if row.kind == "request":
            state["pending"] = (row.seq, row.record)
            return []
        waiting, state["pending"] = state["pending"], None
        if waiting is None:
            return []
        return [{"request_seq": waiting[0], "request": waiting[1], "response": row.record}]


def pair_stream(records: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Traces from a stream of connection records, the same rows as the batch form."""
    pairs = per_connection(records, PairProcessor(idle_ms), PAIR_DDL)
    asked = F.from_json("request", REQUEST_DDL)
    answered = F.from_json("response", RESPONSE_DDL)
    return paired_record(pairs.select("conn_id", "request_seq", asked.alias("q"), answered.alias("s")).select(
        "conn_id", "request_seq", "q.started_ns", "q.method", "q.uri", "q.host", "q.path",
        F.col("q.headers").alias("request_headers"), F.col("q.body").alias("request_body"),
        "q.source_addr", "q.protocol_version",
        "s.ended_ns", "s.status_code",
        F.col("s.headers").alias("response_headers"), F.col("s.body").alias("response_body"),
    ))


def pair_keyed_streams(
    requests: DataFrame, responses: DataFrame, key: str = "exchange_id", wait: str = "10 minutes"
) -> DataFrame:
    """Pairing of two streams whose rows already carry the key of their exchange.

    A plain stream-stream join: no order per connection is needed, so a busy
    connection is spread over all tasks. ``wait`` bounds both the state and
    how late a response may come.
    """

    def moment(ns: str):
        return F.timestamp_micros(F.call_function("div", F.col(ns), F.lit(1000)))

    asked = requests.select(
        key, "conn_id", F.col("seq").alias("request_seq"), "started_ns", "method", "uri", "host", "path",
        F.col("headers").alias("request_headers"), F.col("body").alias("request_body"),
        "source_addr", "protocol_version", moment("started_ns").alias("asked_at"),
    ).withWatermark("asked_at", wait)
    answered = responses.select(
        F.col(key).alias("answered_key"), "ended_ns", "status_code",
        F.col("headers").alias("response_headers"), F.col("body").alias("response_body"),
        moment("ended_ns").alias("answered_at"),
    ).withWatermark("answered_at", wait)
    in_time = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {wait}")
    return paired_record(asked.join(answered, (F.col(key) == F.col("answered_key")) & in_time))
