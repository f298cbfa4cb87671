"""Reassembly against plain Python on small, hard inputs."""

import collections
import itertools
import json
import random

import numpy as np
from pyspark.sql import functions as F

from wirebook.operators.frames import chain, frame_header, split_frames, usual_chains
from wirebook.operators.http1 import http1_body_parts, http1_exchanges
from wirebook.operators.http2 import (
    _streams, data_range, header_block_range, http2_body_parts, http2_exchanges, stream_bodies, stream_headers,
)
from wirebook.operators.pairing import paired_keys
from wirebook.operators.scan import FirstSince, Last, Machine, Max, Sum, SumSince, scan
from wirebook.schema import H2_FRAME_DDL, H2_PREFACE, SEGMENT_DDL
from wirebook.streaming.http1_live import Http1Processor
from wirebook.streaming.http2_live import Http2Processor


def expected_values(rows):
    """Every running value by plain loops, per row of (key, order, value, reset, code)."""
    found, state = {}, {}
    for k, order, value, reset, code in sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1])):
        s = state.setdefault(k, {"sum": 0, "max": None, "last": None, "first": None, "since": 0, "state": 0, "round": 0})
        before = dict(s)
        if value is not None:
            s["sum"] += value
            s["max"] = value if s["max"] is None else max(s["max"], value)
            s["last"] = value
        if reset:
            s["first"] = None
        elif s["first"] is None:
            s["first"] = value
        s["since"] = (0 if reset else s["since"]) + (value or 0)
        if code is not None:
            s["round"] += code >> (8 + s["state"]) & 1
            s["state"] = code >> (2 * s["state"]) & 3
        found[k, order] = (*s.values(), before["sum"], before["max"], before["last"], before["state"], before["round"])
    return found


def test_scan_equals_loops(spark):
    """A hot key with dense and one with sparse order values, null keys, keys that fill whole partitions."""
    rng = random.Random(5)
    keys = [*["hot"] * 1500, *[f"k{i}" for i in range(40)] * 3, *[None] * 60]
    rows = [
        (k, i * (1 if k == "hot" else 10**9), rng.choice([None, 1, 5, -2, 7]), rng.choice([None, 0, 0, 0, 1]),
         rng.choice([None, Machine.STAY, *(rng.randrange(1 << 12) for _ in range(3))]))
        for i, k in enumerate(keys)
    ]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT, r INT, code BIGINT")
    v, code = F.col("v"), F.col("code")
    values = {
        "sum": Sum(v), "max": Max(v), "last": Last(v), "first": FirstSince(v, F.col("r")), "since": SumSince(v, F.col("r")),
        "state": Machine(code), "sum_before": Sum(v, before=True), "max_before": Max(v, before=True),
        "last_before": Last(v, before=True), "earlier": Machine(code, before=True),
    }
    want = expected_values(rows)
    for partitions in (None, 1, 4, 37):
        got = scan(df, ["k"], "seq", values, partitions).drop("v", "r", "code").collect()
        assert len(got) == len(rows)
        assert {(r[0], r[1]): tuple(r[2:]) for r in got} == want
    assert scan(df.where("false"), ["k"], "seq", values).count() == 0


def test_scan_has_no_window_and_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = scan(df, ["k"], "id", {"n": Sum(F.lit(1)), "m": Max(F.col("id"), before=True)}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange range" not in plan  # the shuffle is done, its result written


def test_pairing_by_hand(spark):
    asked = spark.createDataFrame([("a", s) for s in (0, 1, 5, 9)] + [("b", 0)], "conn_id STRING, seq BIGINT")
    answered = spark.createDataFrame([("a", s) for s in (2, 3, 6)] + [("c", 1)], "conn_id STRING, seq BIGINT")
    for partitions in (None, 1, 6):
        pairs = paired_keys(asked, answered, partitions)
        assert sorted(map(tuple, pairs.collect())) == [("a", 1, 2), ("a", 5, 6)]


REQUEST = b"POST /p?q=1 HTTP/1.1\r\nHost: h.example\r\nX-A: caf\xc3\xa9\r\nContent-Length: 3\r\n\r\nabc"
RESPONSE = b"HTTP/1.1 201 Created\r\nContent-Length: 4\r\nX: 1\r\nx: 2\r\n\r\nwxyz"


def segments_frame(spark, connections):
    rows = []
    for name, chunks in connections.items():
        for seq, (direction, data) in enumerate(chunks):
            rows.append((name, seq, seq * 1_000_000, direction, False, None if data is None else bytearray(data)))
    return spark.createDataFrame(rows, SEGMENT_DDL)


def by_connection(traces):
    found = {}
    for row in sorted(traces.collect(), key=lambda r: (r.capture_id, r.ts_ns)):
        found.setdefault(row.capture_id, []).append(row)
    return found


def test_every_split_gives_the_same_exchange(spark):
    connections = {}
    for at in range(1, len(REQUEST) - 3):  # never inside the body, see test below
        connections[f"q{at}"] = [("out", REQUEST[:at]), ("out", REQUEST[at:]), ("in", RESPONSE)]
    for at in range(1, len(RESPONSE)):
        connections[f"r{at}"] = [("out", REQUEST), ("in", RESPONSE[:at]), ("in", RESPONSE[at:])]
    connections["bytes"] = [("out", bytes([b])) for b in REQUEST[:-3]] + [("in", bytes([b])) for b in RESPONSE]
    found = by_connection(http1_exchanges(segments_frame(spark, connections), 8))
    # A request method that is cut in two is not recognised as a request.
    missing = {f"q{at}" for at in range(1, 5)} | {"bytes"}
    assert set(found) == set(connections) - missing
    for name, (row,) in found.items():
        assert (row.method, row.url, row.status_code) == ("POST", "http://h.example/p?q=1", 201)
        assert row.request_headers == {"host": "h.example", "x-a": "café", "content-length": "3"}
        assert row.response_headers == {"content-length": "4", "x": "2"}
        assert (bytes(row.request_body), bytes(row.response_body)) == (b"abc", b"wxyz")


def reference_machine(chunks):
    """What the live processor finds, as (exchange, ended, request, response) tuples."""
    class Row:
        pass

    machine = Http1Processor()
    state, found = machine.fresh(), []
    for seq, (direction, data) in enumerate(chunks):
        row = Row()
        row.seq, row.ts_ns, row.dir, row.tls, row.data = seq, seq * 1_000_000, direction, False, data
        found += [(f["exchange"], f["ended_ns"]) for f in machine.step(state, row)]
    return found


def test_random_connections(spark):
    rng = random.Random(11)
    pieces = [
        ("out", REQUEST), ("out", REQUEST[:30]), ("out", REQUEST[30:]), ("out", b"noise"), ("out", b""),
        ("in", RESPONSE), ("in", RESPONSE[:40]), ("in", RESPONSE[40:]), ("in", b"HTTP/1.1 200 OK\n\nrest"),
        ("in", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, CHUNKED\r\nContent-Length: 1\r\n\r\nz"),
        ("in", b"junk"), ("close", None), ("out", H2_PREFACE + b"x"), ("out", b"GET / HTTP/1.1\n\n"),
        ("out", b"GET /bad HTTP/2\r\n\r\n"), ("in", b"HTTP/1.1 204 None\r\nContent-Length: +0\r\n\r\n"),
        ("out", b"GET /h HTTP/1.1\r\n" + b"".join(b"a%d: b\r\n" % i for i in range(65)) + b"\r\n"),
    ]
    connections = {f"c{i}": [rng.choice(pieces) for _ in range(rng.randrange(2, 40))] for i in range(120)}
    found = by_connection(http1_exchanges(segments_frame(spark, connections), 4))
    for name, chunks in connections.items():
        mine = sorted((r.ts_ns + r.duration_ns) for r in found.get(name, []))
        assert mine == sorted(ended for _, ended in reference_machine(chunks)), name


def test_whole_bodies(spark):
    fields = b"".join(b"X-%d: v\r\n" % i for i in range(70))
    big = b"HTTP/1.1 200 OK\r\nContent-Length: 900000\r\n\r\n"
    chunk = b"y" * 200_000
    found = by_connection(http1_exchanges(segments_frame(spark, {
        "closed": [("out", REQUEST), ("in", big)] + [("in", chunk)] * 4 + [("close", None)],
        "whole": [("out", REQUEST), ("in", big)] + [("in", chunk)] * 5,
        "endless": [("out", REQUEST), ("in", big.replace(b"900000", b"18446744073709551615")), ("in", chunk), ("close", None)],
        "headers": [("out", REQUEST), ("in", b"HTTP/1.1 200 OK\r\n" + fields + b"Content-Length: 0\r\n\r\n")],
        "fits": [("out", REQUEST), ("in", big.replace(b"900000", b"400000"))] + [("in", chunk)] * 5,
    }), 2))
    assert set(found) == {"closed", "whole", "endless", "headers", "fits"}
    assert found["closed"][0].response_body_bytes == 800_000
    assert found["whole"][0].duration_ns == 6_000_000
    assert bytes(found["whole"][0].response_body) == b"y" * 900_000
    assert found["endless"][0].response_body_bytes == 200_000
    assert len(found["headers"][0].response_headers) == 71
    assert found["fits"][0].duration_ns == 3_000_000
    assert found["fits"][0].response_body_bytes == 400_000


def test_frame_ranges(spark):
    rows = [(8, b"\x02abXX"), (0, b"abc"), (8, b"\x09ab"), (8, b""), (40, b"\x01PPPPPhdrX"), (32, b"PPPPPhdr"), (32, b"x")]
    df = spark.createDataFrame([(f, bytearray(p)) for f, p in rows], "flags INT, payload BINARY")
    cut = lambda r: F.substring("payload", r[0] + 1, r[1]).cast("string")
    data, block = data_range(F.col("payload")), header_block_range(F.col("payload"))
    found = [tuple(r) for r in df.select(cut(data), cut(block)).collect()]
    assert found[:4] == [("ab", "ab"), ("abc", "abc"), ("", ""), ("", "")]
    assert [f[1] for f in found[4:]] == ["hdr", "hdr", ""]


def test_http2_reused_connection_and_hot_stream(spark):
    def frame(seq, direction, kind, flags, payload=b"", headers=(), stream=1):
        return ("c", seq, seq * 10, direction, False, kind, flags, stream, bytearray(payload), list(headers))

    ask, answer = [(":method", "PUT"), (":path", "/x"), (":authority", "h"), (":scheme", "https")], [(":status", "200")]
    rows = [
        frame(0, "out", 1, 5, headers=ask), frame(1, "in", 1, 4, headers=answer), frame(2, "in", 0, 0, b"a"),
        ("c", 3, 30, "close", False, None, None, None, None, None),
        frame(4, "out", 1, 4, headers=ask), frame(5, "in", 1, 4, headers=answer),
    ] + [frame(6 + i, "in", 0, 0, b"%d" % (i % 10)) for i in range(50)] + [
        frame(56, "out", 0, 0, b"late"), frame(57, "in", 0, 1, b"!"), frame(58, "in", 0, 1, b"ignored"),
        frame(59, "in", 9, 4, headers=[(":status", "500")]),
    ]
    df = spark.createDataFrame(rows, H2_FRAME_DDL)
    first, second = sorted(http2_exchanges(df, 8).collect(), key=lambda r: r.ts_ns)
    assert (first.method, first.url, first.status_code, bytes(first.response_body)) == ("PUT", "https://h/x", 200, b"a")
    assert bytes(second.response_body) == b"0123456789" * 5 + b"!"
    assert (bytes(second.request_body), second.duration_ns, second.status_code) == (b"late", 530, 200)


def test_frames_from_any_split(spark):
    rng = random.Random(3)

    def frame(kind, flags, stream, payload):
        return len(payload).to_bytes(3, "big") + bytes([kind, flags]) + (stream | 1 << 31).to_bytes(4, "big") + payload

    def wire(count):
        frames = [(rng.choice([0, 1, 4, 9]), rng.randrange(64), rng.randrange(9), rng.randbytes(rng.randrange(40))) for _ in range(count)]
        return frames, b"".join(frame(*f) for f in frames)

    chunks, want = [("out", b"GET / HTTP/1.1\r\n\r\n"), ("in", b"ignored")], []
    for _ in range(2):  # the connection id is used again after a close
        for direction, lead in (("out", H2_PREFACE), ("in", b"")):
            frames, data = wire(25)
            want += [(direction, *f) for f in frames]
            data = lead + data + b"\x00\x00"  # an unfinished frame at the end
            at = len(lead)
            cuts = [0] + sorted(rng.sample(range(at + 1, len(data)), 12)) + [len(data)]
            chunks += [(direction, data[a:b]) for a, b in zip(cuts, cuts[1:])]
        chunks.append(("close", None))
    for partitions, block in ((None, 1 << 20), (4, 64), (None, 33), (2, 500)):
        found = split_frames(segments_frame(spark, {"c": chunks, "plain": chunks[:2]}), partitions, block)
        rows = sorted(found.collect(), key=lambda r: (r.seq, r.part))
        assert [(r.dir, r.frame_type, r.flags, r.stream_id, bytes(r.payload)) for r in rows] == want
        assert {r.conn_id for r in rows} == {"c"}
    head = spark.createDataFrame([(bytearray(frame(9, 5, 77, b"xyz")),), (bytearray(b"short"),)], "d BINARY")
    parsed = [r.h for r in head.select(frame_header(F.col("d")).alias("h")).collect()]
    assert tuple(parsed[0]) == (3, 9, 5, 77) and parsed[1] is None


def test_body_parts_and_long_heads(spark):
    """Bodies past the first window, cut anywhere; heads longer than it; parts put together are the bodies."""
    rng = random.Random(4)
    body = rng.randbytes(300_000)
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 300000\r\n\r\n" + body
    long_head = b"HTTP/1.1 200 OK\r\nX-Long: " + b"a" * 200_000 + b"\r\nContent-Length: 5\r\n\r\n"
    cuts = [0, *sorted(rng.sample(range(1, len(answer)), 30)), len(answer)]
    pieces = [("in", answer[a:b]) for a, b in zip(cuts, cuts[1:])]
    head_pieces = [("in", long_head[a : a + 50_000]) for a in range(0, len(long_head), 50_000)]
    connections = {
        "long": [("out", REQUEST), *pieces, ("in", b"more")],
        "closed": [("out", REQUEST), *pieces[:20], ("close", None)],
        "one": [("out", REQUEST), ("in", answer)],
        "chunked": [("out", REQUEST), ("in", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"), *[("in", body[:40_000])] * 4, ("close", None)],
        "head": [("out", REQUEST), *head_pieces, ("in", b"12345")],
        "no_end": [("out", REQUEST), *head_pieces[:3], ("close", None)],
        "long_question": [("out", b"GET /a HTTP/1.1\r\nX: " + b"b" * 100_000), ("out", b"\r\n\r\n"), ("in", RESPONSE)],
    }
    segments = segments_frame(spark, connections)
    found = {r.capture_id: r for r in http1_exchanges(segments).collect()}
    want = {
        "long": body, "one": body, "chunked": body[:40_000] * 4, "head": b"12345", "long_question": b"wxyz",
        "closed": b"".join(d for _, d in pieces[:20])[len(answer) - len(body) :],
    }
    assert {name: bytes(r.response_body) for name, r in found.items()} == want
    assert {name: r.response_body_bytes for name, r in found.items()} == {name: len(b) for name, b in want.items()}
    assert found["long"].duration_ns == len(pieces) * 1_000_000
    parts = {}
    for r in sorted(http1_body_parts(segments).collect(), key=lambda r: (r.span_id, r.side, r.part)):
        assert len(parts.setdefault((r.span_id, r.side), b"")) == r["at"]
        parts[r.span_id, r.side] += bytes(r.bytes)
    asked = {name: b"abc" for name in found if name != "long_question"}
    assert parts == {(r.span_id, side): (want if side == "response" else asked)[name] for name, r in found.items() for side in ("request", "response") if side == "response" or name in asked}
    # Too long for one value: no body, but its size; the parts have it all.
    short = {r.capture_id: r for r in http1_exchanges(segments, longest=200_000).collect()}
    assert (short["long"].response_body, short["long"].response_body_bytes) == (None, 300_000)
    assert bytes(short["chunked"].response_body) == want["chunked"]


def live_streams(rows):
    """What the live processor makes of one connection's frames."""
    machine = Http2Processor()
    state, found = machine.fresh(), []
    for row in rows:
        found += machine.step(state, row)
    return sorted((f["epoch"], f["stream_id"], f["born_seq"], f["born_ns"], f["last_ns"], f["request"], f["response"], f["request_body"], f["response_body"], f["tls"]) for f in found)


def test_random_frames_batch_equals_live(spark):
    """Reused stream ids, late, bad and repeated status, interleaved and stray CONTINUATION frames, closes."""
    rng = random.Random(21)
    fields = [[], [(":status", "200")], [(":status", "404"), ("a", "1")], [(":status", "bad")], [("a", "2"), ("b", "3")], [(":method", "PUT"), (":path", "/x")], [(":status", "1"), (":status", "70000")]]
    rows, names = [], H2_FRAME_DDL.replace("\n", " ")
    for connection in range(200):
        for seq in range(rng.randrange(5, 60)):
            at = (f"c{connection}", seq, seq * 10)
            if rng.random() < 0.05:
                rows.append((*at, "close", False, None, None, None, None, None))
                continue
            kind = rng.choice([0, 0, 1, 1, 1, 9, 9, 4])
            payload = bytearray(rng.randbytes(rng.randrange(6)))
            rows.append((*at, rng.choice(["in", "in", "out"]), rng.random() < 0.5, kind, rng.choice([0, 1, 4, 5, 4, 8, 9]), rng.choice([1, 1, 3, 0]), payload, rng.choice(fields)))
    frames = spark.createDataFrame(rows, names)
    collected = frames.orderBy("conn_id", "seq").collect()
    want = {}
    for name in {r.conn_id for r in collected}:
        for f in live_streams([r for r in collected if r.conn_id == name]):
            want[name, f[1], f[2], f[0]] = f
    assert len(want) > 100 and any(n > 1 for n in collections.Counter((k[0], k[1], k[3]) for k in want).values())
    for partitions in (None, 9):
        spans, events, members = _streams(frames, partitions)
        got = {(r.conn_id, r.stream_id, r.born_seq, r.epoch): r for r in spans.collect()}
        assert set(got) == set(want)
        headers = {(r.conn_id, r.epoch, r.stream_id, r.round): r for r in stream_headers(frames, events, members).collect()}
        bodies = {(r.conn_id, r.epoch, r.stream_id, r.round): r for r in stream_bodies(frames, events, spans, 1 << 30).collect()}
        for key, f in want.items():
            r = got[key]
            at = (r.conn_id, r.epoch, r.stream_id, r["round"])
            assert (r.born_ns, r.last_ns, r.tls) == (f[3], f[4], f[9])
            own = headers.get(at)
            assert ((own.request or {}) if own else {}, (own.response or {}) if own else {}) == (json.loads(f[5]), json.loads(f[6]))
            body = bodies.get(at)
            assert (bytes(body.request_body or b"") if body else b"", bytes(body.response_body or b"") if body else b"") == (f[7], f[8])
    parts = {}
    for r in sorted(http2_body_parts(frames).collect(), key=lambda r: (r.span_id, r.side, r.part)):
        assert len(parts.setdefault((r.span_id, r.side), b"")) == r["at"]
        parts[r.span_id, r.side] += bytes(r.bytes)
    assert sorted(parts.values()) == sorted(b for f in want.values() for b in (f[7], f[8]) if b)


def test_long_direction_is_cut_in_blocks(spark):
    """Many blocks of one direction; frames longer than blocks, headers over borders, unusual frames that no table lists."""
    rng = random.Random(8)

    def frame(kind, payload):
        return len(payload).to_bytes(3, "big") + bytes([kind, 0]) + (5).to_bytes(4, "big") + payload

    kinds = [0] * 40 + [200]
    frames = [(rng.choice(kinds), rng.choice([b"", b"\x00" * 50, rng.randbytes(rng.randrange(300)), rng.randbytes(3000), b"text " * 30])) for _ in range(400)]
    wire = b"".join(frame(*f) for f in frames)
    cuts = [0, *sorted(rng.sample(range(1, len(wire)), 90)), len(wire)]
    chunks = [("out", H2_PREFACE)] + [("in", wire[a:b]) for a, b in zip(cuts, cuts[1:])]
    segments = segments_frame(spark, {"hot": chunks})
    for block in (512, 4096):
        rows = sorted(split_frames(segments, None, block).collect(), key=lambda r: (r.seq, r.part))
        assert [(r.frame_type, bytes(r.payload)) for r in rows] == frames
        ends = list(itertools.accumulate(9 + len(p) for _, p in frames))
        assert [r.seq for r in rows] == [next(i for i, c in enumerate(cuts[1:], 1) if c >= e) for e in ends]
        assert all(r.part == (0 if i == 0 or rows[i - 1].seq != r.seq else rows[i - 1].part + 1) for i, r in enumerate(rows))


def test_chains_of_frames():
    rng = random.Random(9)
    for _ in range(50):
        data = np.frombuffer(bytes(rng.choice([0, 0, 0, 1, 9, 40, rng.randrange(256)]) for _ in range(208)), np.uint8)
        entries, exits, lasts = usual_chains(data, 200)
        for entry, leaves, last in zip(entries, exits, lasts):
            assert chain(data, entry, 200) == (leaves, last)
