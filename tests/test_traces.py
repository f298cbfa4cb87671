"""Filters, pages, views and text output on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from wirebook.functions.text import clock_utc, cut_utf8, duration_label, first_lines, last_wins, lossy_utf8, rfc3339_ms
from wirebook.operators.filters import TraceQuery
from wirebook.operators.page import list_recent, query_page, search_by_url, spans_of_trace
from wirebook.operators.render import TABLE_HEADER, json_array, json_lines, table_lines
from wirebook.operators.view import ViewOptions, body_preview, render_view, summary_rows
from wirebook.plans.presets import agent_capture_status, agent_get_trace, agent_list_traces, get_trace, list_traces, render
from wirebook.schema import SENSITIVE_HEADERS
from wirebook.sources.store import TraceTable
from wirebook.sources.tables import traces_from_events, with_storage_columns

DDL = """span_id STRING, trace_id STRING, parent_span_id STRING, method STRING, url STRING,
    request_headers MAP<STRING,STRING>, request_body BINARY, status_code INT,
    response_headers MAP<STRING,STRING>, response_body BINARY, ts_ns BIGINT, duration_ns BIGINT,
    source_addr STRING, dest_addr STRING, protocol_version STRING, capture_id STRING"""


def trace(number, url="http://x/api/users/1", method="GET", status=200, ts_ns=None, trace_id=None,
          request=None, response=None, headers=None, duration_ns=42_000_000):
    return (
        f"{number:016x}", f"{number if trace_id is None else trace_id:032x}", None, method, url, headers or {},
        request, status, {}, response, number * 10**9 if ts_ns is None else ts_ns, duration_ns,
        None, None, "HTTP/1.1", "c",
    )


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: with_storage_columns(spark.createDataFrame(list(rows), DDL))


def numbers(df):
    return [int(r.span_id, 16) for r in df.collect()]


def test_recent_and_ties(make):
    traces = make(*[trace(n) for n in range(5)], trace(9, ts_ns=2 * 10**9))
    assert numbers(list_recent(traces, 3)) == [4, 3, 9]
    assert numbers(list_recent(traces, 2, offset=2)) == [9, 2]
    assert numbers(list_recent(traces, 0)) == []


def test_nanoseconds_order(make):
    traces = make(trace(1, ts_ns=1001), trace(2, ts_ns=1000), trace(3, ts_ns=1002))
    assert numbers(list_recent(traces, 3)) == [3, 1, 2]


def test_trace_pages(make):
    traces = make(trace(1, trace_id=7, ts_ns=30), trace(2, trace_id=7, ts_ns=10), trace(3, trace_id=7, ts_ns=20), trace(4))
    assert numbers(spans_of_trace(traces, f"{7:032x}")) == [1, 2, 3]
    page = TraceQuery.parse(trace_id=f"{7:032x}", limit=2, offset=1)
    assert numbers(query_page(traces, page)) == [2, 3]
    assert numbers(query_page(traces, page, newest=True)) == [3, 2]


def test_url_searches(make):
    traces = make(trace(1, "http://x/api/users"), trace(2, "http://x/api/Orders"), trace(3, "http://x/health"))
    assert numbers(search_by_url(traces, "/api/", 10)) == [2, 1]
    assert numbers(search_by_url(traces, "orders", 10)) == []
    assert numbers(query_page(traces, TraceQuery(url_contains="ORDERS"))) == [2]
    assert numbers(query_page(traces, TraceQuery(url_contains=""))) == [3, 2, 1]


def test_time_bounds(make):
    traces = make(*[trace(n) for n in (99, 100, 200, 201)])
    bounds = TraceQuery(since_ns=100 * 10**9, until_ns=200 * 10**9)
    assert numbers(query_page(traces, bounds)) == [200, 100]
    assert numbers(query_page(traces, TraceQuery(since_ns=2, until_ns=1))) == []


def test_limits_and_offset(make):
    traces = make(*[trace(n, status=404 if n % 2 == 0 else 200) for n in range(120)])
    assert numbers(query_page(traces, TraceQuery())) == list(range(119, 19, -1))
    assert len(numbers(query_page(traces, TraceQuery(limit=5)))) == 5
    assert numbers(query_page(traces, TraceQuery.parse(status="404", limit=1, offset=1))) == [116]


def test_combined(make):
    traces = make(trace(1), trace(2, method="POST"), trace(3, status=500), trace(4, url="http://x/health"))
    assert numbers(query_page(traces, TraceQuery.parse(methods=["get"], status="200", url_contains="/api"))) == [1]


def view_of(make, options, **body):
    return render_view(make(trace(1, ts_ns=1_500_999_999, **body)), options).first()


def test_view_shape(make):
    row = view_of(make, ViewOptions(), response="ok".encode())
    assert (row.timestamp_ms, row.duration_ms) == (1500, 42)
    assert (row.response_body, row.response_body_bytes, row.response_body_truncated) == ("ok", 2, None)
    assert row.request_body is None and row.request_body_bytes is None


@pytest.mark.parametrize("body, limit, text, cut", [
    (b"0123456789", 4, "0123", True), ("ああ".encode(), 4, "あ", True), (b"1234", 4, "1234", None),
    (b"data", 0, "", True), (b"", 0, "", None), (b"hi\xff\xfe", None, "hi��", None),
    (b"\xff\xff", 4, "�", True), (b"ab\xe3\x81", 2, "ab", True), (b"ab\xe3\x81", 5, "ab�", None),
])
def test_view_bodies(make, body, limit, text, cut):
    row = view_of(make, ViewOptions(max_body=limit), response=body)
    assert (row.response_body, row.response_body_bytes, row.response_body_truncated) == (text, len(body), cut)


def test_headers_only(make):
    row = view_of(make, ViewOptions(headers_only=True, max_body=1), request=b"req", response=b"resp")
    assert (row.request_body, row.response_body) == (None, None)
    assert (row.request_body_bytes, row.response_body_bytes) == (3, 4)
    assert row.response_body_truncated is None


def test_headers_only_reads_no_bodies(spark, make, tmp_path):
    make(trace(1, response=b"x")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = render_view(stored, ViewOptions(headers_only=True))._jdf.queryExecution().executedPlan().toString()
    assert "response_body:binary" not in plan and "response_body_bytes" in plan


def test_redaction(make):
    headers = {"AUTHORIZATION": "a", "Cookie": "b", "accept": "c", "cooKie": "d"}
    row = view_of(make, ViewOptions(redact_headers=SENSITIVE_HEADERS), headers=headers)
    assert row.request_headers == {
        "AUTHORIZATION": "[redacted]", "Cookie": "[redacted]", "accept": "c", "cooKie": "d"}


def test_json_leaves_out_nothing_but_absent_fields(make):
    line = json.loads(json_lines(render_view(make(trace(1)))).first().line)
    assert list(line)[0] == "timestamp_ms"
    assert set(line) == {
        "timestamp_ms", "duration_ms", "method", "url", "status_code", "request_headers", "response_headers",
        "protocol_version", "trace_id", "span_id"}


def test_json_array_and_table(make):
    page = list_traces(make(*[trace(n) for n in range(12)]), limit=11)
    spans = [int(row["span_id"], 16) for row in json.loads(json_array(page).first().json)]
    assert spans == list(range(11, 0, -1))
    line = table_lines(page).first().line
    assert line == "1970-01-01T00:00:11.000Z  GET         200      42ms  000000000000000b   http://x/api/users/1"
    assert TABLE_HEADER.index("URL") == line.index("http")
    with pytest.raises(ValueError):
        render(page, "xml")


def test_summary(make):
    long = "https://example.com/" + "é" * 20
    rows = summary_rows(make(trace(3661, long, status=404, duration_ns=1_500_000_000))).first()
    assert (rows.time, rows.status_class, rows.duration) == ("01:01:01", "4xx", "2s")
    assert rows.url == "example.com/" + "é" * 8 + "…"


def test_durations(spark):
    cases = {0: "0ns", 999: "999ns", 1500: "2µs", 2500: "2µs", 42_400_000: "42ms", 999_600_000: "1000ms", 2_500_000_000: "2s"}
    df = spark.createDataFrame([(n,) for n in cases], "n BIGINT")
    assert {r.n: r.d for r in df.select("n", duration_label(F.col("n")).alias("d")).collect()} == cases


def test_text_functions(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    assert value(first_lines(F.lit("a\r\nb\n\nc\n"), 3)) == "a\nb\n"
    assert value(first_lines(F.lit("a\n"), 30)) == "a"
    assert value(rfc3339_ms(F.lit(1704067798778).cast("bigint"))) == "2024-01-01T00:09:58.778Z"
    entries = F.expr("array(named_struct('key','a','value','1'), named_struct('key','b','value','2'), named_struct('key','a','value','3'))")
    assert value(last_wins(entries)) == {"a": "3", "b": "2"}


def test_cut_matches_python(spark):
    texts = ["", "a", "é", "日本語", "a😀b", "😀😀", "x" * 9, "añ日😀z"]
    rows = [(t,) for t in texts]
    df = spark.createDataFrame(rows, "t STRING")
    for limit in range(10):
        for row in df.select("t", cut_utf8(F.col("t"), limit).alias("c")).collect():
            assert row.c == row.t.encode()[:limit].decode(errors="ignore")


def test_lossy_matches_python(spark):
    data = [b"ok", b"\xff", b"\xe3\x81", b"a\xf0\x9f\x98b", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d BINARY")
    for row in df.select("d", lossy_utf8(F.col("d")).alias("t")).collect():
        assert row.t == bytes(row.d).decode(errors="replace")


def test_previews(spark):
    bodies = [b'{"b":[1,{"c":null}],"a":"x"}', b"line\n" * 40, b"\xff\xfe\xfd", None, b"{broken"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i INT, b BINARY")
    found = {r.i: r.p for r in df.select("i", body_preview(F.col("b")).alias("p")).collect()}
    assert found[0] == '{\n  "a": "x",\n  "b": [\n    1,\n    {\n      "c": null\n    }\n  ]\n}'
    assert found[1] == "\n".join(["line"] * 30)
    assert found[2] == "<binary, 3 bytes>"
    assert found[3] is None
    assert found[4] == "{broken"


def test_presets(make):
    traces = make(*[trace(n, response=b"x" * 5000, headers={"cookie": "c"}) for n in range(60)])
    cli = list_traces(traces)
    assert cli.count() == 50 and len(cli.first().response_body) == 1024
    assert cli.first().request_headers == {"cookie": "c"}
    assert len(list_traces(traces, max_body=0).first().response_body) == 5000
    agent = agent_list_traces(traces)
    assert agent.count() == 20 and len(agent.first().response_body) == 256
    assert agent.first().request_headers == {"cookie": "[redacted]"}
    assert len(get_trace(traces, f"{3:016x}").first().response_body) == 5000
    assert get_trace(traces, f"{77:016x}").isEmpty()
    assert len(agent_get_trace(traces, f"{3:016x}").first().response_body) == 4096
    with pytest.raises(ValueError, match="not stored"):
        agent_get_trace(traces, f"{77:016x}")
    for bad in ({"status": "9xx"}, {"methods": ["NOPE"]}, {"trace_id": "12"}, {"since": "soon"}):
        with pytest.raises(ValueError):
            list_traces(traces, **bad)
    with pytest.raises(ValueError):
        agent_get_trace(traces, "zz")
    assert agent_capture_status(traces, "c").first().trace_count == 60
    with pytest.raises(ValueError, match="unknown capture"):
        agent_capture_status(traces, "d")


def test_pages_of_every_size_agree(spark, tmp_path, sf_dir):
    """Rows stored under two batch names count as rows, whatever the page size."""
    table = TraceTable(spark, str(tmp_path / "twice"))
    stored = traces_from_events(spark, sf_dir).limit(600).persist()
    table.append(stored, "one")
    table.append(stored, "two")
    many = [r.span_id for r in table.page(TraceQuery(limit=1001)).collect()]
    assert len(many) == 1001
    assert [r.span_id for r in table.page(TraceQuery(limit=5)).collect()] == many[:5]
    assert [r.span_id for r in table.page(TraceQuery(limit=5, offset=3)).collect()] == many[3:8]


def test_far_bounds(spark, tmp_path, sf_dir):
    table = TraceTable(spark, str(tmp_path / "far"))
    table.append(traces_from_events(spark, sf_dir).limit(20), "one")
    assert table.page(TraceQuery(until_ns=10**21, since_ns=0)).count() == 20
    assert table.page(TraceQuery(since_ns=10**21)).count() == 0


def test_previews_of_hard_bodies(spark):
    bodies = ['{"a":"\\ud800"}', "1e400", '[1e16,0.00001,1.5,"1e+16"]', "[" * 128 + "]" * 128, '{"b":1,"a":-0}']
    df = spark.createDataFrame([(i, bytearray(b.encode())) for i, b in enumerate(bodies)], "i INT, body BINARY")
    found = [r.p for r in df.select("i", body_preview(F.col("body")).alias("p")).orderBy("i").collect()]
    assert found[0] == bodies[0] and found[1] == "1e400" and found[3] == bodies[3]
    assert found[2] == '[\n  1e16,\n  0.00001,\n  1.5,\n  "1e+16"\n]'
    assert found[4] == '{\n  "a": -0.0,\n  "b": 1\n}'


def test_clock_of_nanoseconds(spark):
    row = spark.sql("SELECT 1704758400999999999L AS t, 999999999999999999L AS d").select(clock_utc(F.col("t")).alias("c"), duration_label(F.col("d")).alias("l")).first()
    assert row.c == "00:00:00" and row.l == "1000000000s"
