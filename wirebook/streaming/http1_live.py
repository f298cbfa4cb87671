"""Live HTTP/1.x reassembly.

The processor only decides which chunks belong together; heads and bodies are
parsed by the same columns as in the batch form.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.functions.http import HEADER_LINE, REQUEST_LINE, STATUS_LINE
from wirebook.operators.http1 import EXCHANGE, exchange_traces, parsed_requests, parsed_responses
from wirebook.schema import BUFFER_LIMIT, H2_PREFACE, METHODS
from wirebook.streaming.state import IDLE_MS, ConnectionProcessor, per_connection

EXCHANGE_DDL = """
    conn_id STRING, exchange BIGINT, tls BOOLEAN, asked_seq BIGINT, asked_ns BIGINT, ended_ns BIGINT,
    request BINARY, response BINARY
"""

_STARTS = tuple(f"{method} ".encode() for method in METHODS)
_END_OF_HEAD = re.compile(rb"\n\r?\n")


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace(r"\z", r"\Z"), re.ASCII)


_LINES = {"request": _pattern(REQUEST_LINE), "response": _pattern(STATUS_LINE)}
_FIELD = _pattern(HEADER_LINE)


def head_fields(buffer: bytes, kind: str) -> tuple[int, dict[str, str]] | None:
    """(size, headers) of a complete and valid head, else None."""
    end = _END_OF_HEAD.search(buffer)
    if end is None:
        return None
    first, *fields = re.split("\r?\n", buffer[: end.start()].decode("latin-1").removesuffix("\r"))
    if not _LINES[kind].match(first):
        return None
    parsed = [_FIELD.match(field) for field in fields]
    if not all(parsed):
        return None
    return end.end(), {field[1].lower(): field[2] for field in parsed}


def declared_length(headers: dict[str, str]) -> int | None:
    if "chunked" in headers.get("transfer-encoding", "").lower():
        return None
    text = headers.get("content-length", "")
    length = int(text) if re.fullmatch(r"\+?0*[0-9]{1,20}", text, re.ASCII) else None
    return length if length is not None and length < 1 << 64 else None


class Http1Processor(ConnectionProcessor):
    """State: ``http2`` while the connection speaks HTTP/2, and the open exchange."""

    def fresh(self):
        return {"http2": False, "open": None}

    def is_empty(self, state):
        return state["open"] is None and not state["http2"]

    def step(self, state, row):
        if row.dir == "close":
            opened = state["open"]
            state.update(http2=False, open=None)
            return self.finished(opened, row.ts_ns) if opened and opened.get("head") else []
        data = bytes(row.data or b"")
        if state["http2"] or not data:
            return []
        if row.dir == "out":
            self.sent(state, row, data)
            return []
        return self.received(state, row, data)

    def sent(self, state, row, data):
        if data.startswith(H2_PREFACE):
            state.update(http2=True, open=None)
            return
        if data.startswith(_STARTS):
            state["open"] = {"exchange": row.seq, "tls": bool(row.tls), "request": b"", "response": b""}
        opened = state["open"]
        if opened is None or "asked_seq" in opened or len(opened["request"]) >= BUFFER_LIMIT:
            return
        opened["request"] += data
        if head_fields(opened["request"], "request"):
            opened.update(asked_seq=row.seq, asked_ns=row.ts_ns)

    def received(self, state, row, data):
        opened = state["open"]
        if opened is None or "asked_seq" not in opened:
            return []
        if len(opened["response"]) < BUFFER_LIMIT:
            opened["response"] += data
        if "head" not in opened:
            head = head_fields(opened["response"], "response")
            if head is None:
                return []
            opened["head"] = (head[0], declared_length(head[1]))
        size, length = opened["head"]
        if length is None or len(opened["response"]) < size + length:
            return []
        state["open"] = None
        return self.finished(opened, row.ts_ns)

    def finished(self, opened, ended_ns):
        kept = {name: opened[name] for name in ("exchange", "tls", "asked_seq", "asked_ns", "request", "response")}
        return [{**kept, "ended_ns": ended_ns}]


def http1_stream(segments: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Traces from a stream of segments, the same rows as the batch form."""
    found = per_connection(segments, Http1Processor(idle_ms), EXCHANGE_DDL)

    def marks(buffer: str):
        return F.array(F.struct(
            F.col("asked_seq").alias("seq"), F.col("asked_ns").alias("ts_ns"),
            F.octet_length(buffer).cast("bigint").alias("filled"),
        )).alias("marks")

    # Streams cannot join with themselves, so the response rides along while
    # the request is parsed, and the other way round.
    requests = parsed_requests(
        found.select(
            *EXCHANGE, "tls", F.struct("response", "ended_ns").alias("carried"),
            F.col("request").alias("buffer"), marks("request"),
        ),
        keep=["carried"],
    ).where("head_size IS NOT NULL")
    asked = F.struct(
        F.col("carried.ended_ns").alias("ended_ns"),
        "tls", "asked_ns", "method", "url", "request_headers", "request_body",
    )
    responses = parsed_responses(
        requests.select(
            *EXCHANGE, F.col("carried.response").alias("buffer"), marks("carried.response"), asked.alias("asked"),
        ),
        keep=["asked"],
    )
    return exchange_traces(responses.where("head_size IS NOT NULL").select("*", "asked.*"))
