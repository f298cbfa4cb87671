"""HTTP/1.x reassembly: heads read in one pass, tasks dealt by the size of the traffic."""

import re

from wirebook import session
from wirebook.functions.http import HEADER_LINE, REQUEST_LINE, with_head
from wirebook.operators import http1
from wirebook.sources import tables


def test_tasks_grow_with_the_input(spark, sf_dir, monkeypatch):
    """With a fixed number, what a task sorts and keeps for its join would grow with the traffic."""
    segments = tables.segments_from_events(spark, sf_dir)
    want = http1.http1_exchanges(segments)
    dealt_to, real = [], http1.scan
    monkeypatch.setattr(session, "TASK_ROWS", 40, raising=False)
    monkeypatch.setattr(http1, "scan", lambda df, keys, order, values, partitions=None: dealt_to.append(partitions) or real(df, keys, order, values, partitions))
    found = http1.http1_exchanges(segments)
    assert dealt_to == [-(-http1.narrow_chunks(segments).count() // 40)] * 2 and dealt_to[0] > 4
    columns = ["span_id", "method", "url", "status_code", "request_body", "response_body", "ts_ns", "duration_ns"]
    assert found.count() > 0
    assert sorted(found.select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)


def test_tasks_for(spark):
    assert session.tasks_for(spark, 0, 0) is None
    assert session.tasks_for(spark, 4 * session.TASK_ROWS, 0) is None
    assert session.tasks_for(spark, 4 * session.TASK_ROWS + 1, 0) == 5
    assert session.tasks_for(spark, 1, 4 * session.TASK_BYTES + 1) == 5


def test_header_lines_read_once(spark):
    """Names and values as the groups of HEADER_LINE have them."""
    lines = [b"a:", b"A: \t ", b"b:x", b"c: \tx : y\t ", b"D:x  y:z ", b"e:\xc3\xa9\xff ", b"f::", b"g:\xa0 \x85"]
    bad = [b"a b: c", b":x", b"no colon", b"h:\x01", b" i: x", b"j : x", b""]
    heads = [(0, b"GET / HTTP/1.1\r\n" + b"\r\n".join(lines) + b"\r\n\r\nbody\r\n\r\n"), (1, b"GET / HTTP/1.1\n\r\n"), (2, b"GET / HTTP/1.1\r\na: b"), (3, b"\n\n")]
    heads += [(10 + n, b"GET / HTTP/1.1\r\nok: 1\r\n" + line + b"\n\n") for n, line in enumerate(bad[:-1])]
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in heads], "n INT, buffer BINARY")
    found = {r["n"]: r for r in with_head(rows, "buffer", REQUEST_LINE).collect()}
    matches = [re.match(HEADER_LINE.replace(r"\z", r"\Z"), line.decode("latin-1")) for line in lines]
    assert found[0]["head_headers"] == {m[1].lower(): m[2].encode("latin-1").decode("utf-8", "replace") for m in matches}
    assert found[0]["head_size"] == len(heads[0][1]) - 8
    assert found[1]["head_headers"] == {} and found[1]["start_line"] == "GET / HTTP/1.1"
    assert (found[2]["head_ended"], found[2]["head_size"], found[2]["start_line"]) == (False, None, "")
    assert (found[3]["head_ended"], found[3]["head_size"], found[3]["start_line"]) == (True, None, "")
    assert all(found[n]["head_ended"] and found[n]["head_headers"] is None for n in found if n >= 10)
