"""Streams give the same rows as the batch forms."""

import pytest
from pyspark.sql import functions as F

from wirebook.operators.http1 import http1_exchanges
from wirebook.operators.http2 import http2_exchanges
from wirebook.operators.pairing import pair_requests
from wirebook.operators.view import ViewOptions
from wirebook.schema import H2_FRAME_DDL, REQUEST_DDL, RESPONSE_DDL, SEGMENT_DDL
from wirebook.sources import tables
from wirebook.sources.store import TraceTable
from wirebook.streaming.http1_live import http1_stream
from wirebook.streaming.http2_live import http2_stream
from wirebook.streaming.ingest import (
    number_copies, read_message_stream, run_summary, start_capture, start_trace_sink,
)
from wirebook.streaming.pairing_live import (
    RECORD_DDL, connection_records, pair_keyed_streams, pair_stream,
)


def plain(traces):
    rows = traces.drop("ts", "dt").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["span_id"])


def through_stream(spark, tmp_path, rows, ddl, live, steps=2):
    """Write ``rows`` as files in order of seq, one file per micro-batch."""
    folder = str(tmp_path / "in")
    top = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(steps):
        part = rows.where((F.col("seq") >= top * i // steps) & (F.col("seq") < top * (i + 1) // steps))
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)
    table = TraceTable(spark, str(tmp_path / "table"))
    table.create()
    start_trace_sink(live(stream), table, "live", str(tmp_path / "checkpoint")).awaitTermination()
    return table.read()


def test_live_pairing(spark, sf_dir, tmp_path):
    requests = tables.requests_from_events(spark, sf_dir)
    responses = tables.responses_from_events(spark, sf_dir)
    records = connection_records(requests, responses)
    live = through_stream(spark, tmp_path, records, RECORD_DDL, pair_stream)
    assert plain(live) == plain(pair_requests(requests, responses))


def test_keyed_pairing(spark, sf_dir, tmp_path):
    key = F.expr("seq div 4").alias("exchange_id")
    requests = tables.requests_from_events(spark, sf_dir)
    responses = tables.responses_from_events(spark, sf_dir).where("seq % 4 = 2")  # first answers
    for name, rows in (("q", requests), ("s", responses)):
        rows.select("*", key).coalesce(1).write.parquet(str(tmp_path / name))
    read = spark.readStream
    live = pair_keyed_streams(
        read.schema(f"{REQUEST_DDL}, exchange_id BIGINT").parquet(str(tmp_path / "q")),
        read.schema(f"{RESPONSE_DDL}, exchange_id BIGINT").parquet(str(tmp_path / "s")),
    )
    table = TraceTable(spark, str(tmp_path / "table"))
    table.create()
    start_trace_sink(live, table, "keyed", str(tmp_path / "checkpoint")).awaitTermination()
    assert plain(table.read()) == plain(pair_requests(requests, responses))


def test_live_http1(spark, sf_dir, tmp_path):
    segments = tables.segments_from_events(spark, sf_dir).cache()
    live = through_stream(spark, tmp_path, segments, SEGMENT_DDL, http1_stream)
    assert plain(live) == plain(http1_exchanges(segments))


def test_live_http2(spark, sf_dir, tmp_path):
    frames = tables.h2_frames_from_events(spark, sf_dir).cache()
    live = through_stream(spark, tmp_path, frames, H2_FRAME_DDL, http2_stream)
    assert plain(live) == plain(http2_exchanges(frames))


def test_capture_tee(spark, sf_dir, tmp_path):
    lines = tables.agent_messages_from_events(spark, sf_dir).select("value")
    folder = str(tmp_path / "messages")
    lines.coalesce(2).write.text(folder)
    table = TraceTable(spark, str(tmp_path / "table"))
    table.create()

    def run():
        query = start_capture(
            read_message_stream(spark, folder, max_files=1), table, "run1", str(tmp_path / "checkpoint"),
            view_folder=str(tmp_path / "view"), quarantine=str(tmp_path / "bad"),
            options=ViewOptions(max_body=4),
        )
        query.awaitTermination()

    run()
    assert table.count() == 600
    assert run_summary(table, "run1").first().asDict() == {
        "event": "exit", "child_exit_code": None, "traces_captured": 600}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 400
    view = spark.read.schema("value STRING, batch STRING").text(str(tmp_path / "view"))
    assert view.count() == 600
    assert view.where(F.length(F.get_json_object("value", "$.response_body")) > 4).count() == 0
    # The table keeps whole bodies.
    assert table.read().agg(F.max("response_body_bytes")).first()[0] > 4
    run()  # nothing new
    assert table.count() == 600


def test_equal_lines_stay_apart(spark):
    lines = spark.createDataFrame([("a", "f")] * 3 + [("b", "f")], "value STRING, origin STRING")
    assert sorted((r.value, r.copy) for r in number_copies(lines).collect()) == [
        ("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_state_needs_rocksdb(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError):
            http1_stream(spark.readStream.schema(SEGMENT_DDL).parquet(str(tmp_path)))
    finally:
        spark.conf.set(name, before)
