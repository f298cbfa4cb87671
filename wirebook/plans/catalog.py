"""Every registered query, each next to its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.functions.http import absolute_url, header_map, known_method, status_class
from wirebook.functions.text import (
    base64_decode, base64_encode, cap_bytes, hex_lower, hex_to_bytes,
)
from wirebook.operators.endpoints import endpoint_fields, endpoint_schemas, path_templates
from wirebook.operators.faults import injected_faults, rule_coverage, rule_matches
from wirebook.operators.frames import frame_fragments, split_frames
from wirebook.operators.filters import TraceQuery, failed, url_contains
from wirebook.operators.http1 import http1_body_parts, http1_exchanges
from wirebook.operators.http2 import http2_body_parts, http2_exchanges
from wirebook.operators.links import causal_parents
from wirebook.operators.page import (
    get_by_span_id, list_recent, query_page, search_by_url, spans_of_trace,
)
from wirebook.operators.pairing import pair_requests
from wirebook.operators.render import json_array, json_lines, table_lines
from wirebook.operators.totals import capture_status, count_listed, count_traces, stats
from wirebook.operators.view import ViewOptions, header_preview, render_view, summary_rows, trace_detail
from wirebook.operators.values import value_links
from wirebook.params import parse_fault_rules
from wirebook.plans.oracle import CORE, EVENTS, core, events, lossy_cut, rfc3339
from wirebook.plans.presets import (
    agent_get_trace, agent_list_json, agent_list_traces, agent_stats_json, get_trace, get_trace_json, list_traces, live_list,
    search_traces,
)
from wirebook.schema import METHODS, SENSITIVE_HEADERS
from wirebook.session import durable, shared_dir
from wirebook.sources import tables
from wirebook.sources.messages import message_traces, rejected_messages, to_messages
from wirebook.sources.store import TraceTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CORE_COLUMNS = CORE.split(", ")
SPAN = "000000000000002a"
TRACE = f"{7:032x}"
NEWEST = "ORDER BY ts_ns DESC, span_id DESC"
DAY_9_NS = 1_704_758_400_000_000_000   # 2024-01-09T00:00:00Z
DAY_11_NS = 1_704_931_200_000_000_000  # 2024-01-11T00:00:00Z


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _core(traces: DataFrame) -> DataFrame:
    return traces.select(*CORE_COLUMNS)


def _text(body: str) -> Column:
    return F.col(body).cast("string").alias(body)


# Pages and lookups

@query("list_recent", core(f"{NEWEST} LIMIT 50"))
def _(spark, sf):
    return _core(list_recent(tables.traces_from_events(spark, sf), 50))


@query("list_limit_zero", core("LIMIT 0"))
def _(spark, sf):
    return _core(list_recent(tables.traces_from_events(spark, sf), 0))


@query("list_default_limit", core(f"{NEWEST} LIMIT 100"))
def _(spark, sf):
    return _core(query_page(tables.traces_from_events(spark, sf), TraceQuery()))


@query("list_offset", core(f"WHERE method = 'GET' {NEWEST} LIMIT 30 OFFSET 25"))
def _(spark, sf):
    page = TraceQuery.parse(methods=["get"], limit=30, offset=25)
    return _core(query_page(tables.traces_from_events(spark, sf), page))


@query("get_by_span", core(f"WHERE span_id = '{SPAN}'"))
def _(spark, sf):
    return _core(get_by_span_id(tables.traces_from_events(spark, sf), SPAN.upper()))


@query("spans_of_trace", core(f"WHERE trace_id = '{TRACE}'"))
def _(spark, sf):
    return _core(spans_of_trace(tables.traces_from_events(spark, sf), TRACE))


@query("trace_id_page_order", core(f"WHERE trace_id = '{TRACE}' ORDER BY span_id LIMIT 10 OFFSET 3"))
def _(spark, sf):
    page = TraceQuery.parse(trace_id=TRACE, limit=10, offset=3)
    return _core(query_page(tables.traces_from_events(spark, sf), page))


@query("trace_id_newest_first", core(f"WHERE trace_id = '{TRACE}' {NEWEST} LIMIT 10 OFFSET 3"))
def _(spark, sf):
    page = TraceQuery.parse(trace_id=TRACE, limit=10, offset=3)
    return _core(query_page(tables.traces_from_events(spark, sf), page, newest=True))


@query("search_by_url", core(f"WHERE contains(url, 'API/error') {NEWEST} LIMIT 40"))
def _(spark, sf):
    return _core(search_by_url(tables.traces_from_events(spark, sf), "API/error", 40))


@query("search_alias", events(
    f"SELECT span_id, url, status_code, ts_ns // 1000000 AS timestamp_ms FROM t "
    f"WHERE contains(lower(url), 'example.com/api/sign') {NEWEST} LIMIT 50"))
def _(spark, sf):
    found = search_traces(tables.traces_from_events(spark, sf), "EXAMPLE.com/api/SIGN")
    return found.select("span_id", "url", "status_code", "timestamp_ms")


@query("recent_failures", events(
    "SELECT ts_ns // 1000000 AS timestamp_ms, duration_ns // 1000000 AS duration_ms, method, url, "
    "status_code, response_text AS response_body, span_id FROM t "
    f"WHERE status_code BETWEEN 500 AND 599 AND ts_ns >= {DAY_9_NS} {NEWEST} LIMIT 50"))
def recent_failures(spark, sf):
    """Flagship: the latest server errors since a moment, as views."""
    page = list_traces(tables.traces_from_events(spark, sf), status="5xx", since="2024-01-09T00:00:00Z")
    return page.select(
        "timestamp_ms", "duration_ms", "method", "url", "status_code", "response_body", "span_id")


# Filters, over the whole table

def _filter(name: str, where: str, **settings) -> None:
    parsed = TraceQuery.parse(**settings)

    @query(name, core(f"WHERE {where}"))
    def _(spark, sf):
        return _core(tables.traces_from_events(spark, sf).where(parsed.predicate()))


_filter("filter_none", "true")
_filter("filter_method", "method IN ('POST', 'PUT')", methods=["post", "PUT"])
_filter("filter_status_exact", "status_code = 404", status="404")
_filter("filter_status_class", "status_code BETWEEN 500 AND 599", status="5XX")
_filter("filter_status_range", "status_code BETWEEN 201 AND 404", status="201-404")
_filter("filter_url_ci", "contains(lower(url), 'svc1.example.com/api/v')", url_contains="SVC1.example.COM/api/v")
_filter("filter_url_wildcards", "contains(lower(url), '%_')", url_contains="%_")
_filter("filter_since", f"ts_ns >= {DAY_9_NS}", since="2024-01-09T00:00:00Z")
_filter("filter_until", f"ts_ns <= {DAY_11_NS}", until="2024-01-11T00:00:00Z")
_filter("filter_time_range", f"ts_ns BETWEEN {DAY_9_NS} AND {DAY_11_NS}",
        since="2024-01-09T00:00:00Z", until="2024-01-11T00:00:00Z")
_filter("filter_time_inverted", "false", since="2024-01-11T00:00:00Z", until="2024-01-09T00:00:00Z")
_filter("filter_trace_id", f"trace_id = '{TRACE}'", trace_id=TRACE.upper())
_filter("filter_combined",
        f"method = 'GET' AND status_code = 200 AND contains(lower(url), '/api') AND ts_ns >= {DAY_9_NS}",
        methods=["GET"], status="200", url_contains="/api", since="2024-01-09T00:00:00Z")


@query("filter_url_cs", core("WHERE contains(url, '.Example.com/API/view')"))
def _(spark, sf):
    traces = tables.traces_from_events(spark, sf)
    return _core(traces.where(url_contains(".Example.com/API/view", F.col("url"), ignore_case=False)))


@query("filter_url_pages", "SELECT printf('%016x', page_id) AS span_id, url FROM pages WHERE contains(lower(url), 'example.org')")
def _(spark, sf):
    pages = tables.traces_from_pages(spark, sf)
    return pages.where(url_contains("EXAMPLE.org", F.col("url"))).select("span_id", "url")


@query("filter_url_unicode", """
    SELECT printf('%016x', doc_id) AS span_id FROM documents WHERE contains(lower('http://x/' || text), 'réau') OR contains(lower('http://x/' || text), 'schü')""")
def _(spark, sf):
    d = tables.read_table(spark, sf, "documents", tables.DOCUMENT_DDL)
    url = F.concat(F.lit("http://x/"), "text")
    return d.where(url_contains("RÉAU", url) | url_contains("SchÜ", url)).select(F.lower(F.lpad(F.hex("doc_id"), 16, "0")).alias("span_id"))


@query("filter_failed", core("WHERE status_code >= 400"))
def _(spark, sf):
    return _core(tables.traces_from_events(spark, sf).where(failed(F.col("status_code"))))


@query("live_filter", events(
    f"SELECT {CORE} FROM (SELECT * FROM t {NEWEST} LIMIT 1000) WHERE contains(lower(url), 'click') {NEWEST}"))
def _(spark, sf):
    return _core(live_list(tables.traces_from_events(spark, sf), "CLICK"))


# Counts

@query("count", "SELECT count(*) AS total_traces FROM events")
def _(spark, sf):
    return count_traces(tables.traces_from_events(spark, sf))


@query("stats", "SELECT count(*) AS total_traces, 'events' AS data_dir FROM events")
def _(spark, sf):
    return stats(tables.traces_from_events(spark, sf), "events").select("total_traces", "data_dir")


@query("stats_sessions", "SELECT count(*) AS total_traces, 'events' AS data_dir, 0 AS active_sessions FROM events")
def _(spark, sf):
    return stats(tables.traces_from_events(spark, sf), "events")


@query("session_status", events(
    "SELECT capture_id, count(*) AS trace_count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns "
    "FROM t GROUP BY capture_id"))
def _(spark, sf):
    return capture_status(tables.traces_from_events(spark, sf))


@query("listed_count", events(
    "SELECT count(*) AS held, count(*) FILTER (WHERE contains(lower(url), 'view')) AS listed FROM t"))
def _(spark, sf):
    return count_listed(tables.traces_from_events(spark, sf), "View")


@query("status_class", events(
    "SELECT CASE WHEN status_code BETWEEN 200 AND 599 THEN (status_code // 100) || 'xx' ELSE 'other' END "
    "AS status_class, count(*) AS n FROM t GROUP BY 1"))
def _(spark, sf):
    traces = tables.traces_from_events(spark, sf)
    return traces.groupBy(status_class(F.col("status_code")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


# Views

_VIEW_SQL = """
    SELECT ts_ns // 1000000 AS timestamp_ms, duration_ns // 1000000 AS duration_ms, method, url, status_code,
      {auth} AS authorization_, '*/*' AS accept, {cookie} AS cookie,
      {request} AS request_body, {response} AS response_body,
      strlen(request_text) AS request_body_bytes, strlen(response_text) AS response_body_bytes,
      {request_cut} AS request_body_truncated, {response_cut} AS response_body_truncated,
      '10.0.0.' || (user_id % 250) || ':4000' AS source_addr, 'HTTP/1.1' AS protocol_version, trace_id, span_id
    FROM t"""


def _view_sql(**parts) -> str:
    plain = {
        "auth": "authorization_", "cookie": "cookie", "request": "request_text", "response": "response_text",
        "request_cut": "CAST(NULL AS BOOLEAN)", "response_cut": "CAST(NULL AS BOOLEAN)",
    }
    return events(_VIEW_SQL.format(**{**plain, **parts}))


def _flat_view(view: DataFrame) -> DataFrame:
    return view.select(
        "timestamp_ms", "duration_ms", "method", "url", "status_code",
        F.col("request_headers")["authorization"].alias("authorization_"),
        F.col("request_headers")["accept"].alias("accept"),
        F.col("response_headers")["Set-Cookie"].alias("cookie"),
        "request_body", "response_body", "request_body_bytes", "response_body_bytes",
        "request_body_truncated", "response_body_truncated",
        "source_addr", "protocol_version", "trace_id", "span_id",
    )


def _view(name: str, options: ViewOptions, **parts) -> None:
    @query(name, _view_sql(**parts))
    def _(spark, sf):
        return _flat_view(render_view(tables.traces_from_events(spark, sf), options))


_view("view_basic", ViewOptions())
_view("view_max_body_8", ViewOptions(max_body=8),
      request="left(request_text, 8)", response="left(response_text, 8)",
      request_cut="CASE WHEN strlen(request_text) > 8 THEN true END",
      response_cut="CASE WHEN strlen(response_text) > 8 THEN true END")
_view("view_max_body_zero", ViewOptions(max_body=0),
      request="left(request_text, 0)", response="left(response_text, 0)",
      request_cut="CASE WHEN strlen(request_text) > 0 THEN true END",
      response_cut="CASE WHEN strlen(response_text) > 0 THEN true END")
_view("view_headers_only", ViewOptions(headers_only=True),
      request="CAST(NULL AS VARCHAR)", response="CAST(NULL AS VARCHAR)")
_view("view_redact", ViewOptions(redact_headers=["AUTHORIZATION"]), auth="'[redacted]'")
_view("view_redact_sensitive", ViewOptions(redact_headers=SENSITIVE_HEADERS),
      auth="'[redacted]'", cookie="'[redacted]'")


@query("view_char_boundary", f"""
    SELECT printf('%016x', page_id) AS span_id, {lossy_cut('html', 256)} AS response_body,
      strlen(html) AS response_body_bytes, CASE WHEN strlen(html) > 256 THEN true END AS response_body_truncated
    FROM pages""")
def _(spark, sf):
    return render_view(tables.traces_from_pages(spark, sf), ViewOptions(max_body=256)).select(
        "span_id", "response_body", "response_body_bytes", "response_body_truncated")


@query("view_long_bodies", f"""
    SELECT printf('%016x', doc_id) AS span_id, {lossy_cut('text', 128)} AS response_body,
      strlen(text) AS response_body_bytes, CASE WHEN strlen(text) > 128 THEN true END AS response_body_truncated
    FROM documents""")
def _(spark, sf):
    return render_view(tables.traces_from_documents(spark, sf), ViewOptions(max_body=128)).select(
        "span_id", "response_body", "response_body_bytes", "response_body_truncated")


@query("view_broken_bytes", """
    SELECT printf('%016x', page_id) AS span_id, chr(65533) || html || chr(65533) AS response_body,
      strlen(html) + 3 AS response_body_bytes FROM pages""")
def _(spark, sf):
    return render_view(tables.traces_from_pages(spark, sf, broken=True)).select(
        "span_id", "response_body", "response_body_bytes")


@query("body_size", """
    SELECT printf('%016x', doc_id) AS span_id, strlen(text) AS response_body_bytes,
      CAST(NULL AS BIGINT) AS request_body_bytes FROM documents""")
def _(spark, sf):
    view = render_view(tables.traces_from_documents(spark, sf), ViewOptions(headers_only=True))
    return view.select("span_id", "response_body_bytes", "request_body_bytes")


_JSON_PREVIEW = """CASE WHEN {0} LIKE '{{"k":%' THEN '{{' || chr(10) || '  "k": ' || regexp_extract({0}, '-?[0-9]+') || chr(10) || '}}'
      WHEN {0} LIKE '{{"fault%' THEN '{{' || chr(10) || '  "fault": "injected"' || chr(10) || '}}' END"""


@query("body_preview", events(f"""
    SELECT span_id, {_JSON_PREVIEW.format('request_text')} AS request_preview,
      {_JSON_PREVIEW.format('response_text')} AS response_preview FROM t"""))
def _(spark, sf):
    detail = trace_detail(tables.traces_from_events(spark, sf))
    return detail.select("span_id", "request_preview", "response_preview")


@query("body_preview_lines", """
    SELECT printf('%016x', doc_id) AS span_id,
      array_to_string(list_slice(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), 1, 30), chr(10))
        AS response_preview FROM documents""")
def _(spark, sf):
    detail = trace_detail(tables.traces_from_documents(spark, sf))
    return detail.select("span_id", "response_preview")


_DURATION_SQL = """CASE
    WHEN duration_ns >= 1000000000 THEN CAST(round_even(duration_ns / 1000000000.0, 0) AS BIGINT) || 's'
    WHEN duration_ns >= 1000000 THEN CAST(round_even(duration_ns / 1000000.0, 0) AS BIGINT) || 'ms'
    WHEN duration_ns >= 1000 THEN CAST(round_even(duration_ns / 1000.0, 0) AS BIGINT) || 'µs'
    ELSE duration_ns || 'ns' END"""


@query("summary_row", events(f"""
    SELECT span_id, strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S') AS time, method,
      CASE WHEN strlen(host || path) > 30 THEN left(host || path, 29) || '…' ELSE host || path END AS url, status_code,
      (status_code // 100) || 'xx' AS status_class, {_DURATION_SQL} AS duration FROM t"""))
def _(spark, sf):
    return summary_rows(tables.traces_from_events(spark, sf))


@query("header_preview", events(
    "SELECT span_id, authorization_, cookie FROM t"))
def _(spark, sf):
    detail = trace_detail(tables.traces_from_events(spark, sf))
    return detail.select(
        "span_id", F.col("request_headers")["authorization"].alias("authorization_"),
        F.col("response_headers")["Set-Cookie"].alias("cookie"))


@query("header_preview_cut", f"""
    SELECT doc_id, CASE WHEN strlen(text) > 60 THEN {lossy_cut('text', 59)} || '…' ELSE text END AS long, lang AS short FROM documents""")
def _(spark, sf):
    d = tables.read_table(spark, sf, "documents", tables.DOCUMENT_DDL)
    shown = header_preview(F.create_map(F.lit("x-text"), F.col("text"), F.lit("x-lang"), F.col("lang")))
    return d.select("doc_id", shown["x-text"].alias("long"), shown["x-lang"].alias("short"))


@query("table_render", events(f"""
    SELECT {rfc3339('ts_ns // 1000000')} || '  ' || rpad(method, 7, ' ') || '  ' || lpad(status_code::VARCHAR, 6, ' ')
      || '  ' || lpad((duration_ns // 1000000)::VARCHAR, CAST(greatest(6, length((duration_ns // 1000000)::VARCHAR)) AS INTEGER), ' ') || 'ms  ' || rpad(span_id, 17, ' ') || '  ' || url AS line FROM t"""))
def _(spark, sf):
    return table_lines(render_view(tables.traces_from_events(spark, sf), ViewOptions(headers_only=True)))


def _sql_text(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


_VIEW_JSON = f"""'{{"timestamp_ms":' || (ts_ns // 1000000) || ',"duration_ms":' || (duration_ns // 1000000) || ',"method":"' || method
      || '","url":"' || url || '","status_code":' || status_code || ',"request_headers":{{"authorization":"' || authorization_
      || '","accept":"*/*"}},"response_headers":{{"content-type":"application/json","Set-Cookie":"' || cookie || '"'
      || CASE WHEN fault THEN ',"x-fault-injected":"yes"' ELSE '' END || '}}'
      || coalesce(',"request_body":' || {_sql_text('request_text')}, '') || coalesce(',"response_body":' || {_sql_text('response_text')}, '')
      || coalesce(',"request_body_bytes":' || strlen(request_text), '') || coalesce(',"response_body_bytes":' || strlen(response_text), '')
      || ',"source_addr":"10.0.0.' || (user_id % 250) || ':4000","protocol_version":"HTTP/1.1","trace_id":"' || trace_id || '","span_id":"' || span_id || '"}}'"""


@query("jsonl_render", events(f"SELECT {_VIEW_JSON} AS line FROM t"))
def _(spark, sf):
    return json_lines(render_view(tables.traces_from_events(spark, sf)))


@query("jsonl_fields", events("""
    SELECT span_id, (ts_ns // 1000000)::VARCHAR AS timestamp_ms, url,
      request_text IS NOT NULL AS has_request_body, response_text AS response_body, true AS starts_with_time FROM t"""))
def _(spark, sf):
    lines = json_lines(render_view(tables.traces_from_events(spark, sf)))
    return lines.select(
        F.get_json_object("line", "$.span_id").alias("span_id"),
        F.get_json_object("line", "$.timestamp_ms").alias("timestamp_ms"),
        F.get_json_object("line", "$.url").alias("url"),
        F.contains("line", F.lit('"request_body":')).alias("has_request_body"),
        F.get_json_object("line", "$.response_body").alias("response_body"),
        F.startswith("line", F.lit('{"timestamp_ms"')).alias("starts_with_time"),
    )


@query("json_array_render", events(
    f"SELECT string_agg(span_id, ',' {NEWEST}) AS spans FROM (SELECT * FROM t {NEWEST} LIMIT 50)"))
def _(spark, sf):
    page = list_traces(tables.traces_from_events(spark, sf))
    rows = F.from_json("json", "array<struct<span_id:string>>")
    return json_array(page).select(F.array_join(F.transform(rows, lambda r: r["span_id"]), ",").alias("spans"))


_PAGE_FIELDS = "timestamp_ms BIGINT, method STRING, url STRING, status_code INT, response_body STRING, span_id STRING"


@query("json_array_fields", events(f"""
    SELECT ts_ns // 1000000 AS timestamp_ms, method, url, status_code, response_text AS response_body, span_id,
      CAST(row_number() OVER ({NEWEST}) - 1 AS INTEGER) AS place FROM t {NEWEST} LIMIT 50"""))
def _(spark, sf):
    page = list_traces(tables.traces_from_events(spark, sf), max_body=0)
    rows = F.from_json("json", f"array<struct<{_PAGE_FIELDS.replace(' BIGINT', ':BIGINT').replace(' STRING', ':STRING').replace(' INT', ':INT')}>>")
    return json_array(page).select(F.posexplode(rows).alias("place", "r")).select("r.*", "place")


# Presets

@query("cli_get_object", events(f"SELECT {_VIEW_JSON} AS json FROM t WHERE span_id = '{SPAN}'"))
def _(spark, sf):
    text = get_trace_json(tables.traces_from_events(spark, sf), SPAN)
    # The text is indented, as the first line shows; without the space it is the line of the JSON lines form.
    pretty = F.startswith("json", F.lit('{\n  "timestamp_ms" : '))
    return text.where(pretty).select(F.regexp_replace(F.regexp_replace("json", r'\n *', ""), '" : ', '":').alias("json"))


@query("agent_list_object", events(f"""
    SELECT '{{"traces":[' || string_agg({_VIEW_JSON.replace("|| authorization_", "|| '[redacted]'").replace("|| cookie", "|| '[redacted]'")}, ',' {NEWEST}) || ']}}' AS json
    FROM (SELECT * FROM t WHERE status_code BETWEEN 400 AND 499 {NEWEST} LIMIT 20)"""))
def _(spark, sf):
    return agent_list_json(tables.traces_from_events(spark, sf), status="4xx")


@query("agent_stats_object", """SELECT '{"total_traces":' || count(*) || ',"data_dir":"events","active_sessions":0}' AS json FROM events""")
def _(spark, sf):
    return agent_stats_json(tables.traces_from_events(spark, sf), "events")


@query("agent_get_redacted", events(f"""
    SELECT span_id, '[redacted]' AS authorization_, '[redacted]' AS cookie, '*/*' AS accept, response_text AS response_body
    FROM t WHERE span_id = '{SPAN}'"""))
def _(spark, sf):
    found = agent_get_trace(tables.traces_from_events(spark, sf), SPAN)
    return found.select(
        "span_id", F.col("request_headers")["authorization"].alias("authorization_"), F.col("response_headers")["Set-Cookie"].alias("cookie"),
        F.col("request_headers")["accept"].alias("accept"), "response_body")


@query("cli_list", events(f"""
    SELECT span_id, authorization_, response_text AS response_body FROM t
    WHERE method IN ('POST') {NEWEST} LIMIT 5 OFFSET 2"""))
def _(spark, sf):
    page = list_traces(tables.traces_from_events(spark, sf), methods=["post"], limit=5, offset=2)
    return page.select("span_id", F.col("request_headers")["authorization"].alias("authorization_"), "response_body")


@query("cli_get", events(
    f"SELECT span_id, authorization_, response_text AS response_body FROM t WHERE span_id = '{SPAN}'"))
def _(spark, sf):
    found = get_trace(tables.traces_from_events(spark, sf), SPAN)
    return found.select("span_id", F.col("request_headers")["authorization"].alias("authorization_"), "response_body")


@query("agent_list", events(f"""
    SELECT span_id, '[redacted]' AS authorization_, '[redacted]' AS cookie, status_code FROM t
    WHERE ts_ns BETWEEN {DAY_9_NS} AND {DAY_11_NS} AND status_code BETWEEN 400 AND 599 {NEWEST} LIMIT 20"""))
def _(spark, sf):
    page = agent_list_traces(
        tables.traces_from_events(spark, sf), status="400-599",
        since_ms=DAY_9_NS // 1_000_000, until_ms=DAY_11_NS // 1_000_000)
    return page.select(
        "span_id", F.col("request_headers")["authorization"].alias("authorization_"),
        F.col("response_headers")["Set-Cookie"].alias("cookie"), "status_code")


@query("agent_get", f"""
    SELECT printf('%016x', page_id) AS span_id, {lossy_cut('html', 4096)} AS response_body,
      strlen(html) AS response_body_bytes FROM pages WHERE printf('%016x', page_id) = '{SPAN}'""")
def _(spark, sf):
    return agent_get_trace(tables.traces_from_pages(spark, sf), SPAN).select(
        "span_id", "response_body", "response_body_bytes")


# Scalar functions at ingest

@query("agent_ingest", events("""
    SELECT method,
      'http://' || host || path AS url, status_code, host AS host_header,
      CASE WHEN event_id % 10 = 6 THEN NULL ELSE request_text END AS request_body, response_text AS response_body,
      ts_ns // 1000000 * 1000000 AS ts_ns, duration_ns // 1000000 * 1000000 AS duration_ns, 'HTTP/1.1' AS protocol_version
    FROM t WHERE event_id % 10 NOT IN (3, 7, 8, 9)"""))
def _(spark, sf):
    lines = tables.agent_messages_from_events(spark, sf)
    return message_traces(lines, F.col("event_id").cast("string")).select(
        "method", "url", "status_code", F.col("request_headers")["host"].alias("host_header"),
        _text("request_body"), _text("response_body"), "ts_ns", "duration_ns", "protocol_version")


@query("agent_rejects", "SELECT event_id FROM events WHERE event_id % 10 IN (3, 7, 8, 9)")
def _(spark, sf):
    return rejected_messages(tables.agent_messages_from_events(spark, sf)).select("event_id")


@query("ingest_ids", events("""
    SELECT event_id, substr(sha256(event_id::VARCHAR), 1, 32) AS trace_id, substr(sha256(event_id::VARCHAR), 33, 16) AS span_id
    FROM t WHERE event_id % 10 NOT IN (3, 7, 8, 9)"""))
def _(spark, sf):
    lines = tables.agent_messages_from_events(spark, sf)
    found = message_traces(lines, F.col("event_id").cast("string")).select("trace_id", "span_id", "ts_ns")
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    # All lines are on both sides: neither is for the driver to hand out.
    return lines.select("event_id", F.substring(digest, 33, 16).alias("span_id")).join(found.drop("ts_ns").hint("merge"), "span_id").select("event_id", "trace_id", "span_id")


@query("message_sizes", """
    WITH m AS (SELECT printf('%016x', doc_id) AS span_id, '{"method":"GET","url":"http://docs.example.com/' || source || '/' || lang || '/' || doc_id
        || '","status_code":200,"request_headers":{"accept":"*/*"},"response_headers":{"content-type":"text/plain"},"response_body_b64":"' || to_base64(encode(text))
        || '","duration_ms":' || (doc_id % 1000) || ',"timestamp_ms":' || (doc_id * 1000000007 // 1000000) || ',"protocol_version":"HTTP/1.1"}' AS value FROM documents)
    SELECT span_id, md5(value) AS digest, strlen(value) AS bytes, strlen(value) <= 60000 AS sent FROM m""")
def _(spark, sf):
    sent, too_long = to_messages(tables.traces_from_documents(spark, sf))
    sides = [side.select("span_id", F.md5("value").alias("digest"), F.octet_length("value").alias("bytes"), F.lit(fits).alias("sent")) for side, fits in ((sent, True), (too_long, False))]
    return sides[0].unionAll(sides[1])


_NAMES = ["get", "POST", "Put", "delete", "PATCH", "head", "OPTIONS", "trace", "CONNECT", "brew", ""]


@query("method_values", f"""
    WITH m AS (SELECT event_id, [{', '.join(repr(n) for n in _NAMES)}][event_id % 11 + 1] AS name FROM events), k AS (SELECT [{', '.join(repr(m) for m in METHODS)}] AS known)
    SELECT event_id, CASE WHEN list_contains(known, upper(name)) THEN upper(name) ELSE 'GET' END AS any_case,
      CASE WHEN list_contains(known, name) THEN name ELSE 'GET' END AS exact_case FROM m, k""")
def _(spark, sf):
    e = tables.read_table(spark, sf, "events", tables.EVENT_DDL)
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 11).cast("int"))
    return e.select("event_id", known_method(name).alias("any_case"), known_method(name, ignore_case=False).alias("exact_case"))


@query("method_normalise", """
    SELECT event_id, 'GET' AS any_case,
      'GET' AS exact_case, CASE WHEN event_id % 2 = 0 THEN 'DELETE' ELSE 'GET' END AS deleted FROM events""")
def _(spark, sf):
    e = tables.read_table(spark, sf, "events", tables.EVENT_DDL)
    deleted = F.when(F.col("event_id") % 2 == 0, "DELETE").otherwise("delete")
    return e.select(
        "event_id",
        known_method(F.when(F.col("event_type") == "view", "get").otherwise(F.col("event_type"))).alias("any_case"),
        known_method(F.lit("get"), ignore_case=False).alias("exact_case"),
        known_method(deleted, ignore_case=False).alias("deleted"),
    )


@query("url_rebuild", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url
      ELSE 'http://' || CASE WHEN page_id % 3 = 1 THEN 'h.example' ELSE 'unknown' END
        || CASE WHEN page_id % 2 = 0 THEN '/p' ELSE '/' END END AS rebuilt FROM pages""")
def _(spark, sf):
    p = tables.read_table(spark, sf, "pages", tables.PAGE_DDL)
    rest = F.col("page_id") % 3
    return p.select("page_id", absolute_url(
        F.when(rest == 0, F.col("url")).otherwise(F.lit("/p")),
        F.when(rest == 1, F.lit("h.example")),
        F.when(F.col("page_id") % 2 == 0, F.lit("/p")),
    ).alias("rebuilt"))


@query("b64_roundtrip", """
    SELECT doc_id, to_base64(encode(text)) AS coded, true AS same, CAST(NULL AS BOOLEAN) AS unpadded FROM documents""")
def _(spark, sf):
    d = tables.read_table(spark, sf, "documents", tables.DOCUMENT_DDL)
    data = F.col("text").cast("binary")
    coded = base64_encode(data)
    return d.select(
        "doc_id", coded.alias("coded"), (base64_decode(coded) == data).alias("same"),
        (base64_decode(F.concat(coded, F.lit(" "))) == data).alias("unpadded"))


@query("hex_roundtrip", """
    SELECT event_id, lower(hex(encode(props))) AS coded, true AS same, CAST(NULL AS VARCHAR) AS short FROM events""")
def _(spark, sf):
    e = tables.read_table(spark, sf, "events", tables.EVENT_DDL)
    coded = hex_lower(F.col("props").cast("binary"))
    span = F.lower(F.lpad(F.hex("event_id"), 16, "0"))
    return e.select(
        "event_id", coded.alias("coded"),
        (hex_lower(hex_to_bytes(F.upper(span), 8)) == span).alias("same"),
        hex_lower(hex_to_bytes(F.substring(span, 1, 15), 8)).alias("short"))


@query("body_cap", """
    SELECT doc_id, least(strlen(text), 1000) AS capped, CAST(NULL AS BIGINT) AS empty FROM documents""")
def _(spark, sf):
    d = tables.read_table(spark, sf, "documents", tables.DOCUMENT_DDL)
    data = F.col("text").cast("binary")
    return d.select(
        "doc_id", F.octet_length(cap_bytes(data, 1000)).cast("bigint").alias("capped"),
        F.octet_length(cap_bytes(F.substring(data, 1, 0), 1000)).cast("bigint").alias("empty"))


@query("header_values", """
    SELECT doc_id, lang AS first_value,
      CASE WHEN regexp_full_match(text, '[ -~\\t]*') THEN text ELSE '<binary>' END AS text_value FROM documents""")
def _(spark, sf):
    d = tables.read_table(spark, sf, "documents", tables.DOCUMENT_DDL)

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("binary").alias("value"))

    headers = header_map(F.array(
        entry("X-Lang", F.lit("none")), entry("X-Text", F.col("text")), entry("x-lang", F.col("lang"))))
    return d.select("doc_id", headers["x-lang"].alias("first_value"), headers["x-text"].alias("text_value"))


# Reassembly

def _written(traffic: DataFrame) -> DataFrame:
    """Raw traffic as a table of its own, as a capture would leave it."""
    return durable(traffic, "traffic", "zstd")


@query("pair_requests", events("""
    SELECT CASE WHEN event_id % 13 = 0 THEN 'GET' ELSE method END AS method,
      CASE WHEN event_id % 2 = 0 THEN 'https://' || host || path
           ELSE 'http://' || CASE WHEN event_id % 9 <> 1 THEN host ELSE 'unknown' END || path END AS url,
      status_code, authorization_, request_text AS request_body, response_text AS response_body,
      ts_ns, duration_ns, CASE WHEN user_id % 3 = 0 THEN 'p-hot' ELSE 'p-' || user_id END AS capture_id
    FROM t WHERE event_id % 7 <> 3"""))
def pairing(spark, sf):
    traces = pair_requests(
        tables.requests_from_events(spark, sf), tables.responses_from_events(spark, sf))
    return traces.select(
        "method", "url", "status_code", F.col("request_headers")["authorization"].alias("authorization_"),
        _text("request_body"), _text("response_body"), "ts_ns", "duration_ns", "capture_id")


_HTTP1_SQL = """
    SELECT CASE WHEN user_id % 3 = 0 THEN 'c-hot' ELSE 'c-' || user_id END AS capture_id,
      event_id % 8 AS variant, method,
      CASE WHEN event_id % 8 = 6 THEN 'https://' ELSE 'http://' END || host || path AS url, status_code,
      authorization_,
      CASE WHEN event_id % 8 = 4 THEN NULL ELSE 'two' END AS twice,
      CASE WHEN event_id % 8 = 2 THEN NULL ELSE request_text END AS request_body,
      CASE WHEN event_id % 8 = 4 THEN '1f' || chr(13) || chr(10) || coalesce(response_text, '') || chr(13) || chr(10)
             || '0' || chr(13) || chr(10) || chr(13) || chr(10)
           ELSE response_text END AS response_body,
      ts_ns + CASE WHEN event_id % 8 IN (1, 7) THEN 2000000 ELSE 0 END AS ts_ns,
      CAST(CASE event_id % 8 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS BIGINT) * 1000000
        AS duration_ns
    FROM t WHERE event_id % 8 <> 3"""


def _exchange_columns(traces: DataFrame, variant: Column) -> DataFrame:
    return traces.select(
        "capture_id", variant.alias("variant"), "method", "url", "status_code",
        F.col("request_headers")["authorization"].alias("authorization_"),
        F.col("response_headers")["x-twice"].alias("twice"),
        _text("request_body"), _text("response_body"), "ts_ns", "duration_ns",
    )


@query("http1_exchanges", events(f"SELECT * EXCLUDE (variant) FROM ({_HTTP1_SQL})"))
def http1(spark, sf):
    traces = http1_exchanges(_written(tables.segments_from_events(spark, sf)))
    return _exchange_columns(traces, F.lit(0)).drop("variant")


@query("http1_sparse_connections", events(f"SELECT * EXCLUDE (variant) FROM ({_HTTP1_SQL})"))
def _(spark, sf):
    """One dense connection with a third of all rows beside connections whose sequence numbers have large gaps."""
    segments = tables.segments_from_events(spark, sf)
    sparse = F.when(F.col("conn_id") == "c-hot", F.col("seq")).otherwise(F.col("seq") * 1_000_000_007)
    return _exchange_columns(http1_exchanges(_written(segments.withColumn("seq", sparse))), F.lit(0)).drop("variant")


_LARGE_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size FROM documents), p AS (
      SELECT *, CASE WHEN doc_id % 500 = 0 THEN 67108865 WHEN doc_id % 50 = 1 THEN 1048577 ELSE 16385 END AS target,
        greatest(1, 65536 // greatest(size, 1)) AS copies FROM d), r AS (
      SELECT doc_id, text, CASE WHEN size = 0 THEN 0 ELSE copies * ((target + copies * size - 1) // (copies * size)) END AS times FROM p)
    SELECT 'http://docs.example.com/docs/' || doc_id AS url, nullif(strlen(text) * times, 0) AS response_body_bytes,
      CASE WHEN times > 0 THEN md5(repeat(text, times)) END AS digest FROM r"""


@query("http1_large_bodies", _LARGE_SQL)
def _(spark, sf):
    traces = http1_exchanges(_written(tables.segments_of_large_bodies(spark, sf)))
    return traces.select("url", "response_body_bytes", F.md5("response_body").alias("digest"))


@query("http2_large_bodies", _LARGE_SQL)
def _(spark, sf):
    traces = http2_exchanges(_written(tables.h2_frames_of_large_bodies(spark, sf)))
    return traces.select("url", "response_body_bytes", F.md5("response_body").alias("digest"))


_PARTS_SQL = f"SELECT count(*) AS bodies, sum(response_body_bytes)::BIGINT AS bytes, max(response_body_bytes)::BIGINT AS longest FROM ({_LARGE_SQL}) WHERE response_body_bytes > 0"


def _part_totals(parts: DataFrame) -> DataFrame:
    """Totals over all bodies; parts that overlap, or leave a gap, would show in the sizes."""
    each = parts.groupBy("span_id", "side").agg(F.sum(F.octet_length("bytes")).alias("n"), F.max(F.col("at") + F.octet_length("bytes")).alias("reach"))
    return each.where("n = reach").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("bytes"), F.max("n").alias("longest"))


@query("http1_body_parts", _PARTS_SQL)
def _(spark, sf):
    return _part_totals(http1_body_parts(_written(tables.segments_of_large_bodies(spark, sf))))


@query("http2_body_parts", _PARTS_SQL)
def _(spark, sf):
    return _part_totals(http2_body_parts(_written(tables.h2_frames_of_large_bodies(spark, sf))))


@query("http1_teardown", events(f"SELECT * EXCLUDE (variant) FROM ({_HTTP1_SQL}) WHERE variant IN (4, 5)"))
def _(spark, sf):
    # Only a close ends a chunked answer, or one with fewer bytes than announced.
    traces = http1_exchanges(_written(tables.segments_from_events(spark, sf)))
    announced = F.col("response_headers")["content-length"].cast("bigint")
    partial = announced.isNull() | (announced > F.coalesce("response_body_bytes", F.lit(0)))
    return _exchange_columns(traces.where(partial), F.lit(0)).drop("variant")


@query("http2_streams", events("""
    SELECT s.* FROM (
      SELECT CASE WHEN user_id % 3 = 0 THEN 'h-hot' ELSE 'h-' || user_id END AS capture_id, *,
        min(CASE WHEN event_id % 6 = 3 THEN event_id END) OVER (
          PARTITION BY CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END ORDER BY event_id
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closer
      FROM t) e
    LEFT JOIN (SELECT event_id AS closer_id, ts_ns AS closer_ns FROM t) c ON e.closer = c.closer_id,
    LATERAL (SELECT e.capture_id,
      CASE WHEN e.event_id % 6 = 4 THEN 'GET' ELSE e.method END AS method,
      CASE WHEN e.event_id % 2 = 0 THEN 'https://' ELSE 'http://' END
        || CASE WHEN e.event_id % 6 = 4 THEN '/' ELSE e.host || e.path END AS url,
      e.status_code, CASE e.event_id % 6 WHEN 4 THEN 'bare' ELSE 'u' END AS agent,
      CASE e.event_id % 6 WHEN 1 THEN 'text/plain' WHEN 4 THEN NULL WHEN 5 THEN 'late' ELSE 'application/json' END AS content_type,
      CASE WHEN e.event_id % 6 = 1 THEN e.request_text || e.request_text END AS request_body,
      CASE e.event_id % 6 WHEN 1 THEN e.response_text || e.response_text WHEN 4 THEN NULL ELSE e.response_text END AS response_body,
      e.ts_ns + CASE WHEN e.event_id % 6 = 5 THEN 2000000 ELSE 0 END AS ts_ns,
      CASE e.event_id % 6 WHEN 0 THEN 2000000 WHEN 1 THEN 6000000 WHEN 3 THEN 3000000 WHEN 4 THEN 1000000 WHEN 5 THEN 4000000
        ELSE c.closer_ns + 3000000 - e.ts_ns END AS duration_ns) s
    WHERE e.event_id % 6 <> 2 OR e.closer IS NOT NULL"""))
def http2(spark, sf):
    traces = http2_exchanges(_written(tables.h2_frames_from_events(spark, sf)))
    return traces.select(
        "capture_id", "method", "url", "status_code",
        F.col("request_headers")["user-agent"].alias("agent"),
        F.col("response_headers")["content-type"].alias("content_type"),
        _text("request_body"), _text("response_body"), "ts_ns", "duration_ns")


@query("http2_reused_streams", events("""
    SELECT 'r-' || (user_id % 5) AS capture_id, method, 'http://' || host || path AS url, status_code,
      CASE WHEN event_id % 5 = 4 THEN 'text/plain' END AS content_type, response_text AS response_body,
      ts_ns + CASE event_id % 5 WHEN 3 THEN 3000000 WHEN 4 THEN 2000000 ELSE 0 END AS ts_ns,
      CAST(CASE WHEN event_id % 5 = 1 THEN 3000000 ELSE 2000000 END AS BIGINT) AS duration_ns
    FROM t WHERE event_id % 5 <> 2"""))
def _(spark, sf):
    traces = http2_exchanges(_written(tables.h2_frames_of_reused_streams(spark, sf)))
    return traces.select(
        "capture_id", "method", "url", "status_code", F.col("response_headers")["content-type"].alias("content_type"),
        _text("response_body"), "ts_ns", "duration_ns")


@query("pair_ids", events("""
    WITH p AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'p-hot' ELSE 'p-' || user_id END AS conn FROM t WHERE event_id % 7 <> 3)
    SELECT conn AS capture_id, ts_ns, substr(sha256(conn || ':' || (event_id * 4)), 1, 32) AS trace_id, substr(sha256(conn || ':' || (event_id * 4)), 33, 16) AS span_id FROM p""").replace("WITH p AS", ", p AS", 1))
def _(spark, sf):
    traces = pair_requests(tables.requests_from_events(spark, sf), tables.responses_from_events(spark, sf))
    return traces.select("capture_id", "ts_ns", "trace_id", "span_id")


@query("http2_split_frames", events("""
    SELECT 's-' || event_id AS conn_id, f.dir, f.frame_type, f.flags, event_id % 1000000 * 2 + 1 AS stream_id, f.payload
    FROM t, LATERAL (VALUES
      ('out', 1, 4, path), ('out', 0, 1, coalesce(request_text, '')), ('in', 4, 0, 'settings'),
      ('in', 1, 4, path), ('in', 0, 1, coalesce(response_text, ''))) f(dir, frame_type, flags, payload)"""))
def _(spark, sf):
    frames = split_frames(_written(tables.h2_segments_from_events(spark, sf)))
    payload = F.when(F.col("frame_type") == 4, F.lit("settings")).otherwise(F.col("payload").cast("string"))
    return frames.select("conn_id", "dir", "frame_type", "flags", "stream_id", payload.alias("payload"))


_HOT_FRAMES_SQL = """
    SELECT CASE WHEN user_id % 3 = 0 THEN 'f-hot' ELSE 'f-' || (user_id % 11) END AS conn_id, f.dir, event_id * 8 + f.seq AS seq, f.frame_type, f.flags,
      event_id % 1000000 * 2 + 1 AS stream_id, f.fragment
    FROM t, LATERAL (VALUES
      ('out', CASE WHEN 14 + strlen(path) <= 25 THEN 1 ELSE 2 END, 1, 36, path), ('out', 2, 0, 0, coalesce(response_text, '')), ('out', 2, 8, 0, 'window'),
      ('in', CASE WHEN 9 + strlen(path) <= 25 THEN 4 ELSE 5 END, 1, 4, path), ('in', 5, 0, 8, coalesce(response_text, '')), ('in', 5, 0, 1, coalesce(response_text, ''))
    ) f(dir, seq, frame_type, flags, fragment)"""


def _hot_frames(spark: SparkSession, sf: str, **settings) -> DataFrame:
    frames = frame_fragments(split_frames(_written(tables.h2_hot_segments_from_events(spark, sf)), **settings))
    fragment = F.when(F.col("frame_type") == 8, F.lit("window")).otherwise(F.col("fragment").cast("string"))
    return frames.select("conn_id", "dir", "seq", "frame_type", "flags", "stream_id", fragment.alias("fragment"))


@query("http2_hot_frames", events(_HOT_FRAMES_SQL))
def _(spark, sf):
    return _hot_frames(spark, sf)


@query("http2_hot_frames_in_blocks", events(_HOT_FRAMES_SQL))
def _(spark, sf):
    """The same in blocks of 4 KiB, so that small tables have many of them."""
    return _hot_frames(spark, sf, block=4096)


# Fault rules

FAULTS = ["delay:100ms-500ms:/API/view", "delay:10", "error:503:0.5:/API/error", "error:500:/12", "delay:1s"]
_RULES_SQL = """
    rules(rule_no, kind, min_ms, max_ms, status_code, probability, pattern) AS (VALUES
      (0, 'delay', 100, 500, NULL, NULL, '/API/view'), (1, 'delay', 10, 10, NULL, NULL, NULL),
      (2, 'error', NULL, NULL, 503, 0.5, '/API/error'), (3, 'error', NULL, NULL, 500, 1.0, '/12'),
      (4, 'delay', 1000, 1000, NULL, NULL, NULL)),
    m AS (SELECT t.span_id, t.url, r.rule_no, r.kind, r.min_ms, r.max_ms, r.status_code AS error_code, r.probability
          FROM t JOIN rules r ON r.pattern IS NULL OR contains(t.url, r.pattern))"""


@query("fault_match", f"WITH {EVENTS}, {_RULES_SQL} SELECT span_id, url, rule_no, kind FROM m")
def _(spark, sf):
    found = rule_matches(tables.traces_from_events(spark, sf), parse_fault_rules(FAULTS))
    return found.select("span_id", "url", "rule_no", "kind")


@query("fault_coverage", f"""WITH {EVENTS}, {_RULES_SQL},
    reach AS (SELECT *, min(CASE WHEN probability = 1 THEN rule_no END) OVER (PARTITION BY span_id) AS last_rule FROM m)
    SELECT span_id, url, CAST(coalesce(sum(min_ms), 0) AS BIGINT) AS delay_min_ms,
      CAST(coalesce(sum(max_ms), 0) AS BIGINT) AS delay_max_ms, CAST(min_by(error_code, rule_no) AS INTEGER) AS error_status,
      round(1.0 - coalesce(product(1.0 - probability), 1.0), 6) AS error_probability
    FROM reach WHERE rule_no <= coalesce(last_rule, 99) GROUP BY span_id, url""")
def fault_coverage(spark, sf):
    found = rule_coverage(tables.traces_from_events(spark, sf), parse_fault_rules(FAULTS))
    return found.withColumn("error_probability", F.round("error_probability", 6))


@query("fault_detect", core("WHERE fault"))
def _(spark, sf):
    return _core(injected_faults(tables.traces_from_events(spark, sf)))


# Causes

@query("trace_parents", """
    WITH s AS (
      SELECT printf('%032x', CASE WHEN user_id % 3 = 0 THEN 9 ELSE user_id % 8 END) AS trace_id, printf('%016x', event_id) AS span_id,
        epoch_us(ts) * 1000 AS a, epoch_us(ts) * 1000 + CASE WHEN event_id % 17 = 4 THEN 0 ELSE CAST(floor(value * 60) AS BIGINT) * 1000000000 END AS b,
        CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS copies
      FROM events),
    p AS (
      SELECT s.trace_id, s.span_id, arg_max(o.span_id, {'a': o.a, 'b': -o.b, 'id': o.span_id}) AS parent_span_id, any_value(s.copies) AS copies
      FROM s LEFT JOIN s o ON o.trace_id = s.trace_id AND o.a <= s.a AND o.b >= s.b AND (o.a < s.a OR o.b > s.b OR o.span_id < s.span_id)
      GROUP BY s.trace_id, s.span_id)
    SELECT trace_id, span_id, parent_span_id FROM p, range(2) r(k) WHERE k < copies""")
def trace_parents(spark, sf):
    """One trace with a third of all spans, in many ranges; nothing of it goes through one task."""
    return causal_parents(tables.nested_spans_from_events(spark, sf))


# Endpoints

_ENDPOINTS = """
    v AS (SELECT lower(host) AS host, count(DISTINCT user_id) > 20 AS many FROM t GROUP BY 1),
    e AS (
      SELECT t.method, v.host, t.path, '/API/' || event_type || '/' || CASE WHEN many THEN '{}' ELSE CAST(user_id AS VARCHAR) END AS template,
        unnest([{'body': 'request', 'content': request_text}, {'body': 'response', 'content': response_text}], recursive := true)
      FROM t JOIN v ON v.host = lower(t.host))"""


@query("path_templates", f"WITH {EVENTS}, {_ENDPOINTS} SELECT DISTINCT host, path, template FROM e")
def _(spark, sf):
    return path_templates(tables.traces_from_events(spark, sf))


@query("endpoint_schemas", f"""WITH {EVENTS}, {_ENDPOINTS}
    SELECT method, host, template, body,
      'OBJECT<' || array_to_string(list_transform(json_keys(content), lambda k: k || ': ' || CASE json_type(content, k) WHEN 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END), ', ') || '>' AS body_schema,
      count(*) AS n FROM e GROUP BY ALL""")
def _(spark, sf):
    return endpoint_schemas(tables.traces_from_events(spark, sf))


@query("endpoint_fields", f"""WITH {EVENTS}, {_ENDPOINTS},
    k AS (SELECT method, host, template, body, unnest(json_keys(content)) AS field FROM e WHERE content IS NOT NULL),
    f AS (SELECT *, count(*) AS n FROM k GROUP BY ALL),
    o AS (SELECT method, host, template, body, count(*) AS objects FROM e WHERE content IS NOT NULL GROUP BY ALL)
    SELECT f.*, n = objects AS required FROM f JOIN o USING (method, host, template, body)""")
def _(spark, sf):
    return endpoint_fields(tables.traces_from_events(spark, sf))


@query("value_links", f"""WITH {EVENTS},
    made AS (
      SELECT trace_id, span_id, ts_ns + duration_ns AS at, unnest(json_keys(response_text)) AS name, response_text FROM t WHERE response_text IS NOT NULL),
    given AS (SELECT *, 'body/' || name AS place, json_extract_string(response_text, '$.' || name) AS value FROM made),
    used AS (
      SELECT trace_id, span_id, ts_ns AS at, 'path/' || k AS place, split_part(path, '/', CAST(k + 2 AS INTEGER)) AS value FROM t, range(3) r(k)
      UNION ALL
      SELECT trace_id, span_id, ts_ns, 'body/k', json_extract_string(request_text, '$.k') FROM t WHERE request_text IS NOT NULL)
    SELECT u.trace_id, u.span_id, u.place, u.value,
      arg_max(g.span_id, {{'at': g.at, 'id': g.span_id}}) AS source_span_id, arg_max(g.place, {{'at': g.at, 'id': g.span_id}}) AS source_place
    FROM used u JOIN given g ON g.trace_id = u.trace_id AND g.value = u.value AND g.at < u.at GROUP BY ALL""")
def _(spark, sf):
    return value_links(tables.traces_from_events(spark, sf))


# The stored table

def _stored(spark: SparkSession, traces: DataFrame) -> TraceTable:
    table = TraceTable(spark, f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}")
    table.append(traces, "first")
    return table


@query("store_scan", core(f"WHERE ts_ns BETWEEN {DAY_9_NS} AND {DAY_11_NS}"))
def _(spark, sf):
    table = _stored(spark, tables.traces_from_events(spark, sf))
    bounds = TraceQuery.parse(since="2024-01-09T00:00:00Z", until="2024-01-11T00:00:00Z")
    return _core(table.read().where(bounds.predicate()))


@query("store_page", events(
    f"SELECT {CORE}, response_text AS response_body FROM t WHERE status_code BETWEEN 500 AND 599 {NEWEST} LIMIT 50"))
def store_page(spark, sf):
    table = _stored(spark, tables.traces_from_events(spark, sf))
    page = table.page(TraceQuery.parse(status="5xx", limit=50))
    return page.select(*CORE_COLUMNS, _text("response_body"))


@query("store_replace", events("""
    SELECT span_id, CASE WHEN status_code = 404 THEN 'PATCH' ELSE method END AS method, url, ts_ns FROM t"""))
def _(spark, sf):
    traces = tables.traces_from_events(spark, sf)
    table = _stored(spark, traces)
    table.insert(traces.where("status_code = 404").withColumn("method", F.lit("PATCH")))
    return table.read().select("span_id", "method", "url", "ts_ns")


@query("store_clear", "SELECT count(*) AS total_traces FROM events WHERE false")
def _(spark, sf):
    table = _stored(spark, tables.traces_from_events(spark, sf))
    table.clear(confirm=True)
    return table.stats().select("total_traces")


def _changed(spark: SparkSession, sf: str) -> TraceTable:
    """All traces appended; then failures come again with an earlier time, and those not found once more."""
    traces = tables.traces_from_events(spark, sf)
    table = _stored(spark, traces)
    table.insert(traces.where("status_code >= 400").withColumns({
        "method": F.lit("PATCH"), "ts_ns": F.col("ts_ns") - 3 * 86_400_000_000_000, "dt": F.date_sub("dt", 3)}), "failures")
    table.insert(traces.where("status_code = 404").withColumn("method", F.lit("HEAD")), "not-found")
    return table


def _changed_sql(rest: str = "") -> str:
    return events(f"""SELECT span_id, trace_id, CASE WHEN status_code = 404 THEN 'HEAD' WHEN status_code >= 400 THEN 'PATCH' ELSE method END AS method, url, status_code,
      ts_ns - CASE WHEN status_code >= 400 AND status_code <> 404 THEN 259200000000000 ELSE 0 END AS ts_ns, duration_ns FROM t {rest}""")


@query("store_duplicate_ids", _changed_sql())
def _(spark, sf):
    return _core(_changed(spark, sf).read())


@query("store_lookup", _changed_sql("WHERE span_id = '0000000000000005'"))
def _(spark, sf):
    return _core(_changed(spark, sf).get_by_span_id("0000000000000005"))


@query("store_spans", _changed_sql(f"WHERE trace_id = '{TRACE}'"))
def _(spark, sf):
    return _core(_changed(spark, sf).spans_of_trace(TRACE))


@query("store_compact", _changed_sql())
def _(spark, sf):
    table = _changed(spark, sf)
    table.compact()
    return _core(table.read())


@query("store_changed_page", f"SELECT * FROM ({_changed_sql()}) WHERE status_code >= 400 {NEWEST} LIMIT 60 OFFSET 10")
def _(spark, sf):
    return _core(_changed(spark, sf).page(TraceQuery.parse(status="400-599", limit=60, offset=10)))


@query("store_cursor", core(f"WHERE method = 'GET' {NEWEST} LIMIT 40 OFFSET 40"))
def _(spark, sf):
    table = _stored(spark, tables.traces_from_events(spark, sf))
    first = TraceQuery.parse(methods=["get"], limit=40)
    # A cursor is the last row of the page before: one row, whatever the table.
    last = table.page(first).select("ts_ns", "span_id").orderBy("ts_ns", "span_id").first()
    return _core(table.page(replace(first, after=(last.ts_ns, last.span_id))))


@query("store_history", core(f"WHERE status_code < 400 {NEWEST} LIMIT 1000"))
def _(spark, sf):
    traces = tables.traces_from_events(spark, sf)
    table = TraceTable(spark, f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}")
    table.append(traces.where("status_code < 400"), "first")
    history, _ = table.history_and_tail()
    table.append(traces.where("status_code >= 400"), "later")  # belongs to the tail
    return _core(history)


@query("store_count", "SELECT count(*) AS total_traces FROM events")
def _(spark, sf):
    return spark.range(1).select(F.lit(_changed(spark, sf).count()).cast("bigint").alias("total_traces"))
