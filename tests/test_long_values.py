"""Tables with long values: read a few rows at a time, joined and put together in bounded memory."""

import random

from pyspark.sql import functions as F

from wirebook import session
from wirebook.operators import frames, gather, http1, http2
from wirebook.schema import H2_FRAME_DDL, H2_PREFACE, SEGMENT_DDL


def batches(df) -> int:
    """How many batches the file reader of a plan gives."""
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.children().head()
    return node.executeColumnar().count()


def test_long_values_are_read_a_few_at_a_time(spark):
    """4096 rows of 64 KB or 1 MiB, as Spark reads by default, do not fit a task."""
    df = spark.range(0, 50, 1, 1).select("id", F.repeat(F.lit("x"), 1000).cast("binary").alias("data"))
    kept = session.durable(df, "long", "zstd", 8)
    assert batches(kept) >= 7
    assert kept.sparkSession is spark and kept.schema == df.schema.fromJson({**df.schema.jsonValue(), "fields": [f | {"nullable": True} for f in df.schema.jsonValue()["fields"]]})
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Union" not in kept._jdf.queryExecution().optimizedPlan().toString()
    # The caller's own reads stay as they are.
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096" and batches(session.durable(df, "short")) == 1


def test_shuffle_files_go_with_the_write(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    assert session.durable(spark.range(100).repartition(3, "id"), "dealt").count() == 100
    assert spark.conf.get(name, None) == before


def test_frame_tasks_grow_with_the_input(spark, monkeypatch):
    """the join of chunks with their places keeps the places of a task in memory; with a fixed number of tasks they grow with the traffic."""
    rng = random.Random(5)
    wire = b"".join(len(p).to_bytes(3, "big") + bytes([0, 0]) + (5).to_bytes(4, "big") + p for p in (rng.randbytes(rng.randrange(60)) for _ in range(300)))
    cuts = [0, *sorted(rng.sample(range(1, len(wire)), 200)), len(wire)]
    rows = [("c", 0, 0, "out", False, H2_PREFACE)] + [("c", 1 + i, i, "in", False, wire[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    segments = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], SEGMENT_DDL)
    want = sorted(frames.split_frames(segments, None, 512).collect())
    dealt_to, real = [], frames.wire_blocks
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    monkeypatch.setattr(frames, "wire_blocks", lambda chunks, segments, block, partitions=None: dealt_to.append(partitions) or real(chunks, segments, block, partitions))
    found = frames.split_frames(segments, None, 512)
    assert dealt_to == [-(-len(rows) // 40)] and dealt_to[0] > 4
    assert len(want) == 300 and sorted(found.collect()) == want


def body(rng, n: int) -> bytes:
    """Half of it packs well, half not at all."""
    return b"".join(rng.choice([b"word " * 400, rng.randbytes(1500)]) for _ in range(n // 1700))


def test_packed_values(spark):
    rng = random.Random(6)
    values = [None, b"", b"short", b"a" * 1023, b"a" * 1024, b"ab" * 40_000, rng.randbytes(5000), rng.randbytes(2000) * 9] * 3
    df = spark.createDataFrame([(n, v and bytearray(v) if v is not None else None) for n, v in enumerate(values)], "n INT, v BINARY").coalesce(2)
    small = gather.packed(df, "v")
    got = {r.n: r for r in small.collect()}
    assert [n for n in got if got[n].full is not None] and all((got[n].full is not None) == (n % 8 in (4, 5, 7)) for n in got)
    assert all(len(got[n].v) < got[n].full == len(values[n]) for n in got if got[n].full is not None)
    back = {r.n: r.v for r in gather.unpacked(small, "v").collect()}
    assert {n: v if v is None else bytes(v) for n, v in back.items()} == dict(enumerate(values))
    cut = small.withColumns({"skip": F.lit(3).cast("bigint"), "size": F.lit(7).cast("bigint")})
    back = {r.n: r.v for r in gather.unpacked(cut, "v").collect()}
    assert all(bytes(back[n]) == values[n][3:10] for n in back if got[n].full is not None) and bytes(back[6]) == values[6]


def test_packed_pieces_put_together(spark, monkeypatch):
    """Groups over batches, of one batch, longer than a lot; packed pieces between others; rows twice and without pieces."""
    rng = random.Random(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = [0, 1, 2, 3, 30, 1, 1, 5, 1, 12]
        pieces = [(k, side, i, bytearray(rng.choice([b"", b"x" * 10, b"yz" * 3000, rng.randbytes(1200)]))) for k, n in enumerate(sizes) for side in (0, 1) for i in range(n if side == 0 or k % 2 else 0)]
        rows = spark.createDataFrame([(k, f"row {k}") for k in range(9)] + [(4, "again"), (None, "no key")], "k INT, v STRING")
        df = spark.createDataFrame(pieces, "k INT, side INT, place INT, bytes BINARY")
        want = {}
        for k, side, _, b in pieces:
            want[k, side] = want.get((k, side), b"") + bytes(b)
        expected = sorted((str(k), v, want.get((k, 0)), want.get((k, 1))) for k, v in [*((r.k, r.v) for r in rows.collect())])
        for some in (df, gather.packed(df, "bytes")):
            for partitions in (None, 1):
                found = gather.put_together(rows, some, ["k"], ["one", "two"], partitions).collect()
                assert sorted((str(r.k), r.v, *[x if x is None else bytes(x) for x in (r.one, r.two)]) for r in found) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_http1_bodies_are_packed(spark):
    """bodies go packed through every shuffle, and their joins are dealt by their size."""
    rng, rows, bodies = random.Random(8), [], {}
    for n in range(4):
        bodies[f"c{n}"] = body(rng, 200_000)
        answer = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(bodies[f"c{n}"]) + bodies[f"c{n}"]
        rows.append((f"c{n}", 0, 0, "out", False, bytearray(b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n" % n)))
        rows += [(f"c{n}", 1 + i, i, "in", False, bytearray(answer[at : at + 9000])) for i, at in enumerate(range(0, len(answer), 9000))]
    segments = spark.createDataFrame(rows, SEGMENT_DDL)
    found = http1.reassemble(segments, 5)
    assert "full" in found.payload.columns and found.payload.where("full IS NOT NULL").count() > 20
    assert http1.part_bytes(found.long_parts, found).where("full IS NOT NULL").count() > 20
    for partitions in (None, 5):
        traces = {r.capture_id: bytes(r.response_body) for r in http1.http1_exchanges(segments, partitions).collect()}
        assert traces == bodies
        parts = {}
        for r in sorted(http1.http1_body_parts(segments, partitions).collect(), key=lambda r: (r.span_id, r.part)):
            assert len(parts.setdefault(r.span_id, b"")) == r["at"]
            parts[r.span_id] += bytes(r.bytes)
        assert sorted(parts.values()) == sorted(bodies.values())


def test_part_tasks_grow_with_the_input(spark, monkeypatch):
    """the join of parts with their data keeps the parts of a task in memory."""
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 300000\r\n\r\n" + b"0123456789" * 30_000
    rows = [("c", 0, 0, "out", False, bytearray(b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"))]
    rows += [("c", 1 + i, i, "in", False, bytearray(answer[at : at + 1000])) for i, at in enumerate(range(0, len(answer), 1000))]
    monkeypatch.setattr(session, "TASK_ROWS", 30)
    segments = spark.createDataFrame(rows, SEGMENT_DDL)
    found = http1.reassemble(segments)
    dealt_to, real = [], type(segments).repartition
    monkeypatch.setattr(type(segments), "repartition", lambda df, *to: dealt_to.append(to) or real(df, *to))
    sizes = [r.n for r in http1.part_bytes(found.long_parts, found).select(F.octet_length("bytes").alias("n")).collect()]
    assert dealt_to == [(-(-len(rows) // 30), "conn_id", "part")] and sum(sizes) == 300_000


def test_long_http2_bodies_are_packed(spark):
    """payloads go packed through both of their shuffles."""
    rng, rows, bodies = random.Random(9), [], {}
    for n in range(4):
        stream, text = 2 * n + 1, body(rng, 100_000)
        at = lambda k, n=n: ("c", n * 1000 + k, k)
        rows.append((*at(0), "out", False, 1, 5, stream, bytearray(), [(":method", "GET"), (":path", f"/{n}")]))
        rows.append((*at(1), "in", False, 1, 4, stream, bytearray(), [(":status", "200")]))
        pieces = [text[a : a + 5000] for a in range(0, len(text), 5000)]
        for k, piece in enumerate(pieces):  # every second one is padded
            padded = bytearray(b"\x03" + piece + b"\x00" * 3) if k % 2 else bytearray(piece)
            rows.append((*at(2 + k), "in", False, 0, (8 if k % 2 else 0) + (k == len(pieces) - 1), stream, padded, []))
        bodies[f"http:///{n}"] = text
    frames_ = spark.createDataFrame(rows, H2_FRAME_DDL.replace("\n", " "))
    spans, events, _, way = http2._dealt_streams(frames_, 3)
    assert way == http2.Dealing(3, True) and http2.body_pieces(frames_, events, spans, 1 << 30, way).where("full IS NOT NULL").count() > 20
    for partitions in (None, 3):
        assert {r.url: bytes(r.response_body) for r in http2.http2_exchanges(frames_, partitions).collect()} == bodies
        parts = {}
        for r in sorted(http2.http2_body_parts(frames_, partitions).collect(), key=lambda r: (r.span_id, r.part)):
            assert len(parts.setdefault(r.span_id, b"")) == r["at"]
            parts[r.span_id] += bytes(r.bytes)
        assert sorted(parts.values()) == sorted(bodies.values())
