"""Table layouts and fixed values.

Every reader in the package gets one of these schemas; nothing is inferred.
"""

TRACE_DDL = """
    span_id STRING, trace_id STRING, parent_span_id STRING, method STRING, url STRING,
    request_headers MAP<STRING,STRING>, request_body BINARY, request_body_bytes BIGINT,
    status_code INT,
    response_headers MAP<STRING,STRING>, response_body BINARY, response_body_bytes BIGINT,
    ts_ns BIGINT, ts TIMESTAMP, dt DATE, duration_ns BIGINT,
    source_addr STRING, dest_addr STRING, protocol_version STRING, capture_id STRING
"""

TRACE_COLUMNS = [
    "span_id", "trace_id", "parent_span_id", "method", "url",
    "request_headers", "request_body", "request_body_bytes",
    "status_code",
    "response_headers", "response_body", "response_body_bytes",
    "ts_ns", "ts", "dt", "duration_ns",
    "source_addr", "dest_addr", "protocol_version", "capture_id",
]

BODY_COLUMNS = ["request_body", "response_body"]

VIEW_COLUMNS = [
    "timestamp_ms", "duration_ms", "method", "url", "status_code",
    "request_headers", "response_headers", "request_body", "response_body",
    "request_body_bytes", "response_body_bytes",
    "request_body_truncated", "response_body_truncated",
    "source_addr", "dest_addr", "protocol_version", "trace_id", "span_id",
]

SEGMENT_DDL = "conn_id STRING, seq BIGINT, ts_ns BIGINT, dir STRING, tls BOOLEAN, data BINARY"

H2_FRAME_DDL = """
    conn_id STRING, seq BIGINT, ts_ns BIGINT, dir STRING, tls BOOLEAN,
    frame_type INT, flags INT, stream_id BIGINT, payload BINARY,
    headers ARRAY<STRUCT<name: STRING, value: STRING>>
"""

REQUEST_DDL = """
    conn_id STRING, seq BIGINT, started_ns BIGINT, method STRING, uri STRING, host STRING, path STRING,
    headers MAP<STRING,STRING>, body BINARY, source_addr STRING, protocol_version STRING
"""

RESPONSE_DDL = """
    conn_id STRING, seq BIGINT, ended_ns BIGINT, status_code INT, headers MAP<STRING,STRING>, body BINARY
"""

# Fixed values that results depend on.
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT"]
SENSITIVE_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie"]
REDACTED = "[redacted]"
FAULT_HEADER = "x-fault-injected"
FAULT_BODY = '{"fault":"injected"}'
MESSAGE_LIMIT = 60_000        # bytes of one agent message
BUFFER_LIMIT = 1 << 30        # bytes of a message that are put together: half of what one value can hold
H2_PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"

# Page sizes and body limits of the presets.
CLI_PAGE = 50
AGENT_PAGE = 20
STORE_PAGE = 100
HISTORY_PAGE = 1000
CLI_LIST_BODY = 1024
AGENT_LIST_BODY = 256
AGENT_GET_BODY = 4096
