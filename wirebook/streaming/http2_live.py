"""Live HTTP/2 reassembly from decoded frames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.operators.http2 import (
    CONTINUATION, DATA, END_HEADERS, END_STREAM, HEADERS, PADDED, stream_traces,
)
from wirebook.schema import BUFFER_LIMIT
from wirebook.streaming.state import IDLE_MS, ConnectionProcessor, per_connection

STREAM_DDL = """
    conn_id STRING, epoch BIGINT, stream_id BIGINT, born_seq BIGINT, tls BOOLEAN, born_ns BIGINT, last_ns BIGINT,
    request STRING, response STRING, request_body BINARY, response_body BINARY
"""


def _data(payload: bytes, flags: int) -> bytes:
    if flags & PADDED and payload:
        return payload[1 : max(len(payload) - payload[0], 1)]
    return payload


class Http2Processor(ConnectionProcessor):
    """State: open streams by id, and the unfinished header block of each direction."""

    def fresh(self):
        return {"epoch": -1, "streams": {}, "blocks": {}}

    def is_empty(self, state):
        return state["epoch"] == -1 and not state["streams"] and not state["blocks"]

    def step(self, state, row):
        if row.dir == "close":
            ended = [self.finished(state, i, s, row.ts_ns) for i, s in state["streams"].items() if self.status(s)]
            state.update(epoch=row.seq, streams={}, blocks={})
            return ended
        if row.frame_type not in (DATA, HEADERS, CONTINUATION) or not row.stream_id > 0:
            return []
        if row.frame_type == DATA:
            self.body(state, row)
        else:
            self.header(state, row)
        stream = state["streams"].get(row.stream_id)
        if row.dir == "in" and stream and stream["answered"] and self.status(stream):
            del state["streams"][row.stream_id]
            return [self.finished(state, row.stream_id, stream, row.ts_ns)]
        return []

    def body(self, state, row):
        stream = state["streams"].get(row.stream_id)
        if stream is None:
            return
        body = f"{row.dir}_body"
        if len(stream[body]) < BUFFER_LIMIT:
            stream[body] += _data(bytes(row.payload), int(row.flags))
        stream["answered"] |= row.dir == "in" and bool(int(row.flags) & END_STREAM)

    def header(self, state, row):
        flags = int(row.flags)
        fields = [(h["name"], h["value"]) for h in row.headers]
        ends = bool(flags & END_STREAM)
        if row.frame_type == CONTINUATION:
            # Goes on with the direction's unfinished block, if that has its stream id.
            stream_id, begun, ends = state["blocks"].get(row.dir, (None, [], False))
            if stream_id != row.stream_id:
                return
            fields = begun + fields
            del state["blocks"][row.dir]
        if not flags & END_HEADERS:
            state["blocks"][row.dir] = (row.stream_id, fields, ends)
            return
        stream = state["streams"].setdefault(row.stream_id, {
            "tls": bool(row.tls), "born_seq": int(row.seq), "born_ns": row.ts_ns, "out": {}, "in": {},
            "out_body": b"", "in_body": b"", "answered": False,
        })
        stream[row.dir].update(fields)
        stream["answered"] |= row.dir == "in" and ends

    def status(self, stream):
        text = stream["in"].get(":status", "")
        return bool(re.fullmatch(r"\+?0*[0-9]{1,5}", text, re.ASCII)) and int(text) <= 65535

    def finished(self, state, stream_id, stream, last_ns):
        return {
            "epoch": state["epoch"], "stream_id": int(stream_id), "born_seq": stream["born_seq"], "tls": stream["tls"],
            "born_ns": stream["born_ns"], "last_ns": last_ns,
            "request": json.dumps(stream["out"]), "response": json.dumps(stream["in"]),
            "request_body": stream["out_body"], "response_body": stream["in_body"],
        }


def http2_stream(frames: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Traces from a stream of frames, the same rows as the batch form."""
    found = per_connection(frames, Http2Processor(idle_ms), STREAM_DDL)
    return stream_traces(found.withColumns({
        "request": F.from_json("request", "MAP<STRING,STRING>"),
        "response": F.from_json("response", "MAP<STRING,STRING>"),
    }))
