"""The given tables as HTTP traffic.

``events`` rows become exchanges: as stored traces, as collector messages, as
request and response records, as raw HTTP/1.x segments and as HTTP/2 frames.
``pages`` and ``documents`` become traces with long bodies. All of it is
derived by Spark from the whole tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.functions.text import base64_encode
from wirebook.schema import FAULT_BODY, FAULT_HEADER, H2_PREFACE, TRACE_COLUMNS

EVENT_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
PAGE_DDL = "page_id BIGINT, url STRING, html STRING"
DOCUMENT_DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
MS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, in any session time zone."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
        + F.hour(ts) * F.lit(3_600_000_000).cast("bigint")
        + F.minute(ts) * F.lit(60_000_000).cast("bigint")
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )


def with_storage_columns(traces: DataFrame) -> DataFrame:
    """Add the columns that follow from others: sizes (unless there, for bodies
    that are kept elsewhere), timestamp, day."""
    moment = F.greatest("ts_ns", F.lit(0))
    sizes = {
        f"{body}_bytes": F.octet_length(body).cast("bigint")
        for body in ("request_body", "response_body") if f"{body}_bytes" not in traces.columns
    }
    return traces.withColumns({
        **sizes,
        "ts": F.timestamp_micros(F.call_function("div", moment, F.lit(1000))),
        "dt": F.date_from_unix_date(F.call_function("div", moment, F.lit(86_400_000_000_000)).cast("int")),
    }).select(*TRACE_COLUMNS)


def _hex_id(number: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(number), digits, "0"))


def _event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", EVENT_DDL)
    kind = F.col("event_type")
    method = F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").otherwise("GET")
    status = (
        F.when(kind == "error", 500 + F.col("event_id") % 4)
        .when((kind == "click") & (F.col("event_id") % 5 == 0), F.lit(404))
        .when(kind == "click", F.lit(304))
        .when(kind == "purchase", F.lit(201))
        .otherwise(F.lit(200))
    )
    return e.select(
        "event_id", "user_id", "event_type", "value", "props",
        method.alias("method"),
        status.cast("int").alias("status_code"),
        F.concat(F.lit("svc"), F.col("user_id") % 4, F.lit(".Example.com")).alias("host"),
        F.concat(F.lit("/API/"), kind, F.lit("/"), "user_id").alias("path"),
        (micros(F.col("ts")) * 1000).alias("ts_ns"),
        (F.floor(F.col("value") * 1000) * 1000).alias("duration_ns"),
        F.when(method != "GET", F.col("props")).alias("request_text"),
        F.when(kind == "error", FAULT_BODY).when(kind != "click", F.col("props")).alias("response_text"),
    )


def traces_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    plain = F.create_map(
        F.lit("content-type"), F.lit("application/json"),
        F.lit("Set-Cookie"), F.concat(F.lit("sid="), "user_id"),
    )
    traces = _event_fields(spark, sf_dir).select(
        _hex_id(F.col("event_id"), 16).alias("span_id"),
        _hex_id(F.col("user_id"), 32).alias("trace_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        "method",
        F.concat(
            F.when(F.col("event_id") % 2 == 0, "https").otherwise("http"), F.lit("://"), "host", "path"
        ).alias("url"),
        F.create_map(
            F.lit("authorization"), F.concat(F.lit("Bearer "), "user_id"), F.lit("accept"), F.lit("*/*")
        ).alias("request_headers"),
        F.col("request_text").cast("binary").alias("request_body"),
        "status_code",
        F.when(fault, F.map_concat(plain, F.create_map(F.lit(FAULT_HEADER), F.lit("yes"))))
        .otherwise(plain).alias("response_headers"),
        F.col("response_text").cast("binary").alias("response_body"),
        "ts_ns", "duration_ns",
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250, F.lit(":4000")).alias("source_addr"),
        F.lit(None).cast("string").alias("dest_addr"),
        F.lit("HTTP/1.1").alias("protocol_version"),
        F.concat(F.lit("capture-"), F.col("user_id") % 7).alias("capture_id"),
    )
    return with_storage_columns(traces)


def _body_traces(rows: DataFrame, key: str, url: Column, body: Column) -> DataFrame:
    return with_storage_columns(rows.select(
        _hex_id(F.col(key), 16).alias("span_id"),
        _hex_id(F.col(key), 32).alias("trace_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("GET").alias("method"),
        url.alias("url"),
        F.create_map(F.lit("accept"), F.lit("*/*")).alias("request_headers"),
        F.lit(None).cast("binary").alias("request_body"),
        F.lit(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.lit("text/plain")).alias("response_headers"),
        body.alias("response_body"),
        (F.col(key) * 1_000_000_007).alias("ts_ns"),
        (F.col(key) % 1000 * MS).alias("duration_ns"),
        F.lit(None).cast("string").alias("source_addr"),
        F.lit(None).cast("string").alias("dest_addr"),
        F.lit("HTTP/1.1").alias("protocol_version"),
        F.lit("crawl").alias("capture_id"),
    ))


def traces_from_pages(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """One trace per page, the HTML as its body. ``broken`` puts a stray byte
    before it and the beginning of a character after it."""
    rows = read_table(spark, sf_dir, "pages", PAGE_DDL)
    body = F.col("html").cast("binary")
    if broken:
        body = F.concat(F.lit(b"\xff"), body, F.lit(b"\xe3\x81"))
    return _body_traces(rows, "page_id", F.col("url"), body)


def traces_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents", DOCUMENT_DDL)
    url = F.concat(F.lit("http://docs.example.com/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id")
    return _body_traces(rows, "doc_id", url, F.col("text").cast("binary"))


def agent_messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` lines as the collector receives them. By ``event_id % 10``:
    3 has an impossible status, 5 a lower-case method, 6 broken base64, 7 is
    cut short, 8 misses a field, 9 has a number for a text."""
    e = _event_fields(spark, sf_dir)
    variant = F.col("event_id") % 10
    body = base64_encode(F.col("request_text").cast("binary"))
    message = F.to_json(F.struct(
        F.when(variant == 5, F.lower("method")).otherwise(F.col("method")).alias("method"),
        F.concat(F.lit("http://"), "host", "path").alias("url"),
        F.when(variant == 3, F.lit(70_000)).otherwise(F.col("status_code")).alias("status_code"),
        F.create_map(F.lit("host"), F.col("host")).alias("request_headers"),
        F.when(variant != 8, F.create_map(F.lit("server"), F.lit("s"))).alias("response_headers"),
        F.when(variant == 6, F.concat(F.lit("*"), body)).otherwise(body).alias("request_body_b64"),
        base64_encode(F.col("response_text").cast("binary")).alias("response_body_b64"),
        F.call_function("div", F.col("duration_ns"), F.lit(MS)).alias("duration_ms"),
        F.call_function("div", F.col("ts_ns"), F.lit(MS)).alias("timestamp_ms"),
    ))
    value = (
        F.when(variant == 7, F.left(message, F.lit(40)))
        .when(variant == 9, F.replace(message, F.lit('"method":"'), F.lit('"extra":1,"method":7,"was":"')))
        .otherwise(message)
    )
    return e.select("event_id", value.alias("value"))


def _connection(prefix: str) -> Column:
    """A third of all exchanges share one connection."""
    return F.when(F.col("user_id") % 3 == 0, F.lit(f"{prefix}-hot")).otherwise(
        F.concat(F.lit(f"{prefix}-"), "user_id")
    )


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_fields(spark, sf_dir)
    return e.select(
        _connection("p").alias("conn_id"),
        (F.col("event_id") * 4).alias("seq"),
        F.col("ts_ns").alias("started_ns"),
        F.when(F.col("event_id") % 13 == 0, F.lower("method")).otherwise(F.col("method")).alias("method"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://"), "host", "path"))
        .otherwise(F.col("path")).alias("uri"),
        F.when(F.col("event_id") % 9 != 1, F.col("host")).alias("host"),
        "path",
        F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), "user_id")).alias("headers"),
        F.coalesce("request_text", F.lit("")).cast("binary").alias("body"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("source_addr"),
        F.lit("HTTP/1.1").alias("protocol_version"),
    )


def responses_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ``event_id``: every seventh request stays unanswered, every eleventh is answered twice."""
    e = _event_fields(spark, sf_dir).where(F.col("event_id") % 7 != 3)
    seqs = F.when(F.col("event_id") % 11 == 5, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))
    return e.select("*", F.explode(seqs).alias("step")).select(
        _connection("p").alias("conn_id"),
        (F.col("event_id") * 4 + F.col("step")).alias("seq"),
        (F.col("ts_ns") + F.col("duration_ns")).alias("ended_ns"),
        "status_code",
        F.create_map(F.lit("content-type"), F.lit("application/json")).alias("headers"),
        F.coalesce("response_text", F.lit("")).cast("binary").alias("body"),
    )


SEGMENT_STRIDE = 64

# How each kind of exchange is cut into chunks: (kind, step, direction, text, piece, pieces).
CHUNK_SCRIPT = [
    (0, 0, "out", "request", 0, 1), (0, 1, "in", "response", 0, 1),
    (6, 0, "out", "request", 0, 1), (6, 1, "in", "response", 0, 1),
    (1, 0, "out", "request", 0, 3), (1, 1, "out", "request", 1, 3), (1, 2, "out", "request", 2, 3),
    *[(1, 3 + piece, "in", "response", piece, 7) for piece in range(7)],
    (2, 0, "out", "head", 0, 1), (2, 1, "out", "tail", 0, 1),
    (2, 2, "in", "response", 0, 2), (2, 3, "in", "response", 1, 2),
    (3, 0, "out", "request", 0, 1),
    (4, 0, "out", "request", 0, 1), (4, 1, "in", "chunked_head", 0, 1),
    (4, 2, "in", "chunked_body", 0, 1), (4, 3, "close", None, 0, 1),
    (5, 0, "out", "request", 0, 1), (5, 1, "in", "short", 0, 1), (5, 2, "close", None, 0, 1),
    (7, 0, "out", "request", 0, 2), (7, 1, "in", "early", 0, 1),
    (7, 2, "out", "request", 1, 2), (7, 3, "in", "response", 0, 1),
]


def segments_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTTP/1.x chunks. By ``event_id % 8``: 0 plain; 1 everything split;
    2 request body in its own chunk; 3 unanswered; 4 chunked until close;
    5 closed early; 6 TLS; 7 bytes come in before the request is complete."""
    c, eol = F.col, "\r\n"
    size = F.octet_length("tail")
    head = F.concat(
        "method", F.lit(" "), "path", F.lit(f" HTTP/1.1{eol}Host: "), "host",
        F.lit(f"{eol}Authorization: Bearer "), "user_id",
        F.when(size > 0, F.concat(F.lit(f"{eol}Content-Length: "), size)).otherwise(F.lit("")),
        F.lit(eol + eol),
    )
    announced = F.octet_length("body") + F.when(c("kind") == 5, F.lit(10)).otherwise(F.lit(0))
    answer = F.concat(
        F.lit("HTTP/1.1 "), "status_code", F.lit(f" Any Reason{eol}Content-Type: application/json{eol}"),
        F.lit(f"X-Twice: one{eol}x-twice: two{eol}Content-Length: "), announced, F.lit(eol + eol), "body",
    )
    chunked_head = F.concat(
        F.lit("HTTP/1.1 "), "status_code", F.lit(f" Any{eol}Transfer-Encoding: Chunked{eol}{eol}"))
    chunked_body = F.concat(F.lit("1f" + eol), "body", F.lit(f"{eol}0{eol}{eol}"))
    script = spark.createDataFrame(
        CHUNK_SCRIPT, "kind BIGINT, step INT, dir STRING, part STRING, piece INT, pieces INT")
    exchanges = _event_fields(spark, sf_dir).select(
        "*", (c("event_id") % 8).alias("kind"),
        F.coalesce("request_text", F.lit("")).alias("tail"),
        F.coalesce("response_text", F.lit("")).alias("body"),
    )
    # The script is the fixed list above, so its size is known.
    chunks = exchanges.join(F.broadcast(script), "kind").withColumn(
        "text",
        F.when(c("part") == "request", F.concat(head, "tail"))
        .when(c("part").isin("response", "short"), answer)
        .when(c("part") == "head", head)
        .when(c("part") == "tail", c("tail"))
        .when(c("part") == "chunked_head", chunked_head)
        .when(c("part") == "chunked_body", chunked_body)
        .when(c("part") == "early", F.lit(f"HTTP/1.1 100 Continue{eol}{eol}")),
    )
    start = F.floor(F.length("text") * c("piece") / c("pieces")).cast("int")
    stop = F.floor(F.length("text") * (c("piece") + 1) / c("pieces")).cast("int")
    return chunks.select(
        _connection("c").alias("conn_id"),
        (c("event_id") * SEGMENT_STRIDE + c("step")).alias("seq"),
        (c("ts_ns") + c("step") * MS).alias("ts_ns"),
        "dir",
        (c("kind") == 6).alias("tls"),
        F.substring(c("text"), start + 1, stop - start).cast("binary").alias("data"),
    )


FRAME_STRIDE = 16


def h2_frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP/2 frames. By ``event_id % 6``: 0 plain; 1 padded data and a split
    header block; 2 never ends; 3 never ends, then the connection closes;
    4 a bare status; 5 early data, other frames, an interim status, trailers."""
    c = F.col
    field_type = "array<struct<name:string,value:string>>"
    none = F.array().cast(field_type)

    def fields(*pairs) -> Column:
        return F.array(*[
            F.struct(F.lit(n).alias("name"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
            for n, v in pairs
        ]).cast(field_type)

    def frame(step, direction, kind, flags, payload=None, headers=None) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(direction).alias("dir"),
            F.lit(kind).cast("int").alias("frame_type"), F.lit(flags).cast("int").alias("flags"),
            (F.lit(b"") if payload is None else payload).alias("payload"),
            (none if headers is None else headers).alias("headers"),
        )

    data = F.coalesce("response_text", F.lit("")).cast("binary")
    sent = F.coalesce("request_text", F.lit("")).cast("binary")
    padded = F.concat(F.lit(b"\x03"), sent, F.lit(b"\x00\x00\x00"))
    status = c("status_code").cast("string")
    ask = fields((":method", c("method")), (":path", c("path")), (":authority", c("host")),
                 ("user-agent", "u"), ("x-seq", c("event_id").cast("string")))
    answer = fields((":status", status), ("content-type", "application/json"))
    variant = c("event_id") % 6
    plain = [frame(0, "out", 1, 5, headers=ask), frame(1, "in", 1, 4, headers=answer)]
    steps = (
        F.when(variant == 0, F.array(*plain, frame(2, "in", 0, 1, data)))
        .when(variant == 1, F.array(
            frame(0, "out", 1, 4, headers=ask), frame(1, "out", 0, 8, padded), frame(2, "out", 0, 1, sent),
            frame(3, "in", 1, 0, headers=fields((":status", status))),
            frame(4, "in", 9, 4, headers=fields(("content-type", "text/plain"))),
            frame(5, "in", 0, 0, data), frame(6, "in", 0, 1, data)))
        .when(variant == 2, F.array(*plain, frame(2, "in", 0, 0, data)))
        .when(variant == 3, F.array(*plain, frame(2, "in", 0, 0, data), frame(3, "close", None, None)))
        .when(variant == 4, F.array(
            frame(0, "out", 1, 5, headers=fields(("user-agent", "bare"))),
            frame(1, "in", 1, 5, headers=fields((":status", status)))))
        .when(variant == 5, F.array(
            frame(0, "in", 0, 1, data), frame(1, "out", 4, 0, F.lit(b"\x00\x01")),
            frame(2, "out", 1, 5, headers=ask),
            frame(3, "in", 1, 4, headers=fields((":status", "100"), ("x-interim", "1"))),
            frame(4, "in", 1, 4, headers=answer), frame(5, "in", 0, 0, data),
            frame(6, "in", 1, 5, headers=fields(("content-type", "late")))))
    )
    return _event_fields(spark, sf_dir).select(
        _connection("h").alias("conn_id"), "event_id", "ts_ns",
        (c("event_id") % 2 == 0).alias("tls"), F.inline(steps),
    ).select(
        "conn_id",
        (c("event_id") * FRAME_STRIDE + c("step")).alias("seq"),
        (c("ts_ns") + c("step") * MS).alias("ts_ns"),
        "dir", "tls", "frame_type", "flags",
        F.when(c("dir") != "close", c("event_id") * 2 + 1).alias("stream_id"),
        "payload", "headers",
    )


def h2_segments_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTTP/2 bytes, one connection per event: the preface, a HEADERS frame
    with the path as its (uncoded) block and a DATA frame each way, every
    stream cut into three chunks in the middle of frames."""
    c = F.col

    def frame(kind: int, flags: int, payload: Column) -> Column:
        head = F.concat(
            F.lpad(F.hex(F.octet_length(payload)), 6, "0"), F.lit(f"{kind:02X}{flags:02X}"),
            F.lpad(F.hex(c("event_id") % 1_000_000 * 2 + 1), 8, "0"),
        )
        return F.concat(F.unhex(head), payload)

    path, sent = c("path").cast("binary"), F.coalesce("request_text", F.lit("")).cast("binary")
    answered = F.coalesce("response_text", F.lit("")).cast("binary")
    streams = _event_fields(spark, sf_dir).select(
        "event_id", "ts_ns",
        F.concat(F.lit(H2_PREFACE), frame(1, 4, path), frame(0, 1, sent)).alias("out"),
        F.concat(frame(4, 0, F.lit(b"\x00\x03\x00\x00\x00\x64")), frame(1, 4, path), frame(0, 1, answered)).alias("in"),
    )
    chunks = streams.select(
        "event_id", "ts_ns", F.explode(F.array(
            F.struct(F.lit("out").alias("dir"), c("out").alias("bytes"), F.lit(30).alias("first")),
            F.struct(F.lit("in").alias("dir"), c("in").alias("bytes"), F.lit(4).alias("first")),
        )).alias("s"),
    ).select("event_id", "ts_ns", "s.*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    start = F.when(c("step") == 0, 1).when(c("step") == 1, c("first") + 1).otherwise(c("first") + 21)
    size = F.when(c("step") == 0, c("first")).when(c("step") == 1, 20).otherwise(F.octet_length("bytes"))
    return chunks.select(
        F.concat(F.lit("s-"), "event_id").alias("conn_id"),
        (F.when(c("dir") == "in", 3).otherwise(0) + c("step")).cast("bigint").alias("seq"),
        "ts_ns", "dir", F.lit(False).alias("tls"),
        F.substring(c("bytes"), start, size).alias("data"),
    )


#: Body sizes that the texts are repeated to, and bytes of a chunk.
LARGE_BODIES = (1 << 14, 1 << 20, 1 << 26)
LARGE_CHUNK = 1 << 16


def large_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how often its text is repeated in a chunk, and the
    chunks that take it past a size: 64 MiB for every 500th, 1 MiB for every 50th, 16 KiB for the others."""
    c = F.col
    small, middle, large = LARGE_BODIES
    docs = read_table(spark, sf_dir, "documents", DOCUMENT_DDL).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("size", F.octet_length("text").cast("bigint"))
    target = F.when(c("doc_id") % 500 == 0, large).when(c("doc_id") % 50 == 1, middle).otherwise(small) + F.lit(1)
    copies = F.greatest(F.lit(1), F.call_function("div", F.lit(LARGE_CHUNK), F.greatest(c("size"), F.lit(1))))
    chunk = F.greatest(copies * c("size"), F.lit(1))
    chunks = F.when(c("size") > 0, F.call_function("div", target + chunk - 1, chunk)).otherwise(F.lit(0))
    return sized.withColumns({"copies": copies.cast("int"), "chunks": chunks.cast("int")})


def segments_of_large_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange a document, the repeated text as its response, one chunk after another."""
    c, eol = F.col, "\r\n"
    docs = large_texts(spark, sf_dir).withColumn("total", c("size") * c("copies") * c("chunks"))
    ask = F.concat(F.lit("GET /docs/"), "doc_id", F.lit(f" HTTP/1.1{eol}Host: docs.example.com{eol}{eol}"))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Length: "), "total", F.lit(eol + eol))
    steps = docs.select("*", F.explode(F.sequence(F.lit(0), c("chunks") + 1)).alias("step"))
    text = F.when(c("step") == 0, ask).when(c("step") == 1, answer).otherwise(F.repeat("text", c("copies")))
    return steps.select(
        F.concat(F.lit("d-"), "doc_id").alias("conn_id"), c("step").cast("bigint").alias("seq"),
        (c("doc_id") * 1_000_000_007 + c("step") * MS).alias("ts_ns"),
        F.when(c("step") == 0, F.lit("out")).otherwise(F.lit("in")).alias("dir"), F.lit(False).alias("tls"), text.cast("binary").alias("data"),
    )


_FIELD_TYPE = "array<struct<name:string,value:string>>"


def _fields(*pairs) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("name"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for n, v in pairs
    ]).cast(_FIELD_TYPE)


def h2_frames_of_large_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream a document on seven connections, the repeated text as its DATA frames."""
    c = F.col
    docs = large_texts(spark, sf_dir)
    steps = docs.select("*", F.explode(F.sequence(F.lit(0), c("chunks") + 1)).alias("step"))
    head = c("step") <= 1
    last = c("step") == c("chunks") + 1
    ask = _fields((":method", "GET"), (":path", F.concat(F.lit("/docs/"), "doc_id")), (":authority", "docs.example.com"))
    fields = F.when(c("step") == 0, ask).when(c("step") == 1, _fields((":status", "200"))).otherwise(F.array().cast(_FIELD_TYPE))
    return steps.select(
        F.concat(F.lit("d-"), c("doc_id") % 7).alias("conn_id"), (c("doc_id") * 100_000 + c("step")).alias("seq"),
        (c("doc_id") * 1_000_000_007 + c("step") * MS).alias("ts_ns"),
        F.when(c("step") == 0, F.lit("out")).otherwise(F.lit("in")).alias("dir"), F.lit(False).alias("tls"),
        F.when(head, 1).otherwise(0).cast("int").alias("frame_type"),
        (F.when(head, 4).otherwise(0) + F.when(last | (c("step") == 0), 1).otherwise(0)).cast("int").alias("flags"),
        (c("doc_id") * 2 + 1).alias("stream_id"),
        F.when(head, F.lit(b"")).otherwise(F.repeat("text", c("copies")).cast("binary")).alias("payload"),
        fields.alias("headers"),
    )


def h2_frames_of_reused_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP/2 frames of five connections whose stream ids 1, 3 and 5 are used
    again and again. By ``event_id % 5``: 0 plain; 1 a bad status first, a good
    one after the end; 2 a good status that a bad one takes back; 3 a header
    block that another one replaces; 4 unfinished blocks in both directions at once."""
    c = F.col

    def frame(step, direction, kind, flags, stream, payload=None, headers=None) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(direction).alias("dir"), F.lit(kind).cast("int").alias("frame_type"),
            F.lit(flags).cast("int").alias("flags"), stream.alias("stream_id"),
            (F.lit(b"") if payload is None else payload).alias("payload"),
            (F.array().cast(_FIELD_TYPE) if headers is None else headers).alias("headers"),
        )

    data = F.coalesce("response_text", F.lit("")).cast("binary")
    status = c("status_code").cast("string")
    shared, own = (c("event_id") % 3 * 2 + 1).cast("bigint"), (c("event_id") * 2 + 101).cast("bigint")
    ask = _fields((":method", c("method")), (":path", c("path")), (":authority", c("host")))
    good, variant = _fields((":status", status)), c("event_id") % 5
    steps = (
        F.when(variant == 0, F.array(
            frame(0, "out", 1, 5, shared, headers=ask), frame(1, "in", 1, 4, shared, headers=good), frame(2, "in", 0, 1, shared, data)))
        .when(variant == 1, F.array(
            frame(0, "out", 1, 5, shared, headers=ask), frame(1, "in", 1, 4, shared, headers=_fields((":status", "bad"))),
            frame(2, "in", 0, 1, shared, data), frame(3, "in", 1, 4, shared, headers=good)))
        .when(variant == 2, F.array(
            frame(0, "out", 1, 5, own, headers=ask), frame(1, "in", 1, 4, own, headers=good),
            frame(2, "in", 1, 4, own, headers=_fields((":status", "70000"))), frame(3, "in", 0, 1, own, data)))
        .when(variant == 3, F.array(
            frame(0, "out", 1, 0, own, headers=_fields((":path", "/lost"))),
            frame(1, "out", 1, 1, shared, headers=_fields((":method", c("method")), (":path", c("path")))),
            frame(2, "out", 9, 4, own, headers=_fields((":authority", "lost"))),
            frame(3, "out", 9, 4, shared, headers=_fields((":authority", c("host")))),
            frame(4, "in", 1, 4, shared, headers=good), frame(5, "in", 0, 1, shared, data)))
        .otherwise(F.array(
            frame(0, "out", 1, 0, shared, headers=_fields((":method", c("method")), (":path", c("path")))),
            frame(1, "in", 1, 0, shared, headers=good), frame(2, "in", 9, 4, shared, headers=_fields(("content-type", "text/plain"))),
            frame(3, "out", 9, 4, shared, headers=_fields((":authority", c("host")))), frame(4, "in", 0, 1, shared, data)))
    )
    return _event_fields(spark, sf_dir).select("event_id", "user_id", "ts_ns", F.inline(steps)).select(
        F.concat(F.lit("r-"), c("user_id") % 5).alias("conn_id"), (c("event_id") * FRAME_STRIDE + c("step")).alias("seq"),
        (c("ts_ns") + c("step") * MS).alias("ts_ns"), "dir", F.lit(False).alias("tls"), "frame_type", "flags", "stream_id", "payload", "headers",
    )


def h2_hot_segments_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTTP/2 bytes of twelve connections, one of them with a third of all
    events. Each event adds three frames a direction, one of them padded, cut
    into three chunks in the middle of frames."""
    c = F.col
    name = F.when(c("user_id") % 3 == 0, "f-hot").otherwise(F.concat(F.lit("f-"), c("user_id") % 11))
    events = _event_fields(spark, sf_dir).withColumn("conn_id", name)

    def frame(kind: int, flags: int, payload: Column) -> Column:
        head = F.concat(
            F.lpad(F.hex(F.octet_length(payload)), 6, "0"), F.lit(f"{kind:02X}{flags:02X}"),
            F.lpad(F.hex(c("event_id") % 1_000_000 * 2 + 1), 8, "0"),
        )
        return F.concat(F.unhex(head), payload)

    path = c("path").cast("binary")
    prioritised = F.concat(F.lit(b"\x00\x00\x00\x00\x07"), path)
    text = F.coalesce("response_text", F.lit("")).cast("binary")
    padded = F.concat(F.lit(b"\x02"), text, F.lit(b"\x00\x00"))
    directions = F.array(
        F.struct(F.lit("out").alias("dir"), F.concat(frame(1, 0x24, prioritised), frame(0, 0, text), frame(8, 0, F.lit(b"\x00\x00\x10\x00"))).alias("bytes")),
        F.struct(F.lit("in").alias("dir"), F.concat(frame(1, 4, path), frame(0, 8, padded), frame(0, 1, text)).alias("bytes")),
    )
    chunks = events.select("conn_id", "event_id", "ts_ns", F.inline(directions)).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    start = F.when(c("step") == 0, 1).when(c("step") == 1, 6).otherwise(26)
    size = F.when(c("step") == 0, 5).when(c("step") == 1, 20).otherwise(F.octet_length("bytes"))
    data = chunks.select(
        "conn_id", (c("event_id") * 8 + F.when(c("dir") == "in", 3).otherwise(0) + c("step")).alias("seq"), "ts_ns", "dir", F.lit(False).alias("tls"),
        F.substring("bytes", start, size).alias("data"),
    )
    greeting = events.groupBy("conn_id").agg((F.min("event_id") * 8 - 1).alias("seq"), F.min("ts_ns").alias("ts_ns"))
    return data.unionByName(greeting.select("conn_id", "seq", "ts_ns", F.lit("out").alias("dir"), F.lit(False).alias("tls"), F.lit(H2_PREFACE).alias("data")))


def nested_spans_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that last ``value`` minutes, so that many enclose others. A third of all share one trace; every fiftieth comes twice."""
    c = F.col
    trace = F.when(c("user_id") % 3 == 0, F.lit(9)).otherwise(c("user_id") % 8)
    spans = read_table(spark, sf_dir, "events", EVENT_DDL).select(
        _hex_id(trace, 32).alias("trace_id"), _hex_id(c("event_id"), 16).alias("span_id"), (micros(c("ts")) * 1000).alias("ts_ns"),
        F.when(c("event_id") % 17 != 4, F.floor(c("value") * 60) * 1_000_000_000).alias("duration_ns"),
        F.when(c("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return spans.select("trace_id", "span_id", "ts_ns", "duration_ns", F.explode("copies").alias("copy")).drop("copy")
