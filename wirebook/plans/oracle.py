"""DuckDB SQL for the registered queries, written from the given tables."""

from __future__ import annotations

# The events table as stored traces, the same rows as traces_from_events.
EVENTS = """
ev AS (
  SELECT *,
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
    CAST(CASE WHEN event_type = 'error' THEN 500 + event_id % 4
         WHEN event_type = 'click' AND event_id % 5 = 0 THEN 404
         WHEN event_type = 'click' THEN 304
         WHEN event_type = 'purchase' THEN 201 ELSE 200 END AS INTEGER) AS status_code,
    'svc' || (user_id % 4) || '.Example.com' AS host,
    '/API/' || event_type || '/' || user_id AS path,
    epoch_us(ts) * 1000 AS ts_ns,
    CAST(floor(value * 1000) AS BIGINT) * 1000 AS duration_ns,
    CASE WHEN event_type IN ('purchase', 'signup') THEN props END AS request_text,
    CASE WHEN event_type = 'error' THEN '{"fault":"injected"}'
         WHEN event_type <> 'click' THEN props END AS response_text
  FROM events),
t AS (
  SELECT *,
    printf('%016x', event_id) AS span_id, printf('%032x', user_id) AS trace_id,
    CASE WHEN event_id % 2 = 0 THEN 'https' ELSE 'http' END || '://' || host || path AS url,
    'Bearer ' || user_id AS authorization_, 'sid=' || user_id AS cookie,
    event_type = 'error' AND event_id % 3 = 0 AS fault,
    'capture-' || (user_id % 7) AS capture_id
  FROM ev)
"""

CORE = "span_id, trace_id, method, url, status_code, ts_ns, duration_ns"


def events(select: str) -> str:
    return f"WITH {EVENTS} {select}"


def core(rest: str = "") -> str:
    return events(f"SELECT {CORE} FROM t {rest}")


def lossy_cut(text: str, limit: int) -> str:
    """Longest run of whole characters that takes at most ``limit`` bytes."""
    return (
        f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE left({text}, "
        f"list_max(list_filter(range({limit // 4}, {limit} + 1), lambda k: strlen(left({text}, k)) <= {limit}))) END"
    )


def rfc3339(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
