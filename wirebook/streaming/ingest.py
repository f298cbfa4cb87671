"""Streams of collector messages into the trace table and a live view."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wirebook.operators.render import json_lines
from wirebook.operators.view import ViewOptions, render_view
from wirebook.schema import TRACE_COLUMNS
from wirebook.sources.messages import fits_message, message_traces, rejected_messages
from wirebook.sources.store import TraceTable


def read_message_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of message files. A flood is delayed (``max_files`` per trigger), never dropped."""
    return (
        spark.readStream.schema("value STRING").option("maxFilesPerTrigger", max_files)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("origin"))
    )


def number_copies(lines: DataFrame) -> DataFrame:
    """Tell equal lines of one source apart by a copy number.

    Only hashes are shuffled to find the lines that come again; the others are
    not moved. Copies are counted, which combines map-side, and the count is
    then spread out again, so many copies of one line are no hot group.
    """
    others = [c for c in lines.columns if c != "value"]
    keyed = lines.withColumn("_hash", F.sha2("value", 256))
    again = keyed.groupBy(*others, "_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    once = keyed.join(again, [*others, "_hash"], "left_anti").select(*lines.columns, F.lit(1).cast("bigint").alias("copy"))
    copied = keyed.join(again, [*others, "_hash"]).groupBy(*others, "_hash").agg(F.first("value").alias("value"), F.first("copies").alias("copies"))
    return once.unionByName(copied.select(*lines.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")))


def batch_traces(lines: DataFrame, capture_id: str) -> DataFrame:
    """Traces of one micro-batch, with ids that a retry repeats and another capture does not share."""
    numbered = number_copies(lines)
    source = F.concat_ws(":", F.lit(capture_id), "origin", F.col("copy").cast("string"), "value")
    return message_traces(numbered, source).withColumn("capture_id", F.lit(capture_id))


def write_traces(
    traces: DataFrame,
    table: TraceTable,
    view_folder: str | None,
    batch: str,
    options: ViewOptions,
) -> None:
    """Full traces to the table, the reduced view to JSON lines; both repeatable."""
    table.append(traces, batch)
    if view_folder is not None:
        lines = json_lines(render_view(traces.select(*TRACE_COLUMNS), options))
        lines.write.mode("overwrite").text(f"{view_folder}/batch={batch}")


#: One query at a time starts with the setting changed; a running query keeps the settings it started with.
_STARTING = threading.Lock()


def _start(spark: SparkSession, writer: DataStreamWriter, drain: bool, every: str) -> StreamingQuery:
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    with _STARTING:
        if not drain:
            return writer.trigger(processingTime=every).start()
        # State with a time to live asks for empty batches for ever; a draining
        # query must not run them, or it would never end.
        before = spark.conf.get(setting)
        spark.conf.set(setting, "false")
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            spark.conf.set(setting, before)


def start_capture(
    messages: DataFrame,
    table: TraceTable,
    capture_id: str,
    checkpoint: str,
    view_folder: str | None = None,
    quarantine: str | None = None,
    options: ViewOptions = ViewOptions(),
    drain: bool = True,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Pump a message stream (value, origin) into the table and the live view.

    Bad messages go to ``quarantine`` and do not stop the stream. With
    ``drain`` the query takes what is there and stops.
    """

    def pump(lines: DataFrame, batch_id: int) -> None:
        lines = lines.persist()
        try:
            batch = f"{capture_id}-{batch_id}"
            traces = batch_traces(lines, capture_id).persist()
            try:
                write_traces(traces, table, view_folder, batch, options)
            finally:
                traces.unpersist()
            if quarantine is not None:
                rejected_messages(lines).write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        finally:
            lines.unpersist()

    observed = messages.observe(
        "messages",
        F.count(F.lit(1)).alias("received"),
        F.count_if(~fits_message(F.col("value"))).alias("oversize"),
    )
    writer = observed.writeStream.queryName(capture_id).option("checkpointLocation", checkpoint).foreachBatch(pump)
    return _start(messages.sparkSession, writer, drain, every)


def start_trace_sink(
    traces: DataFrame,
    table: TraceTable,
    name: str,
    checkpoint: str,
    view_folder: str | None = None,
    options: ViewOptions = ViewOptions(),
    drain: bool = True,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Pump a stream of traces (from live pairing or reassembly) into the table."""

    def pump(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_traces(batch, table, view_folder, f"{name}-{batch_id}", options)
        finally:
            batch.unpersist()

    writer = traces.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(pump)
    return _start(traces.sparkSession, writer, drain, every)


def run_summary(table: TraceTable, capture_id: str) -> DataFrame:
    """The line that ends a run. Counted from the table, so that it is right
    after a restart, too; there is no child process, hence no exit code."""
    return (
        table.read().where(F.col("capture_id") == capture_id)
        .agg(F.count(F.lit(1)).alias("traces_captured"))
        .select(F.lit("exit").alias("event"), F.lit(None).cast("int").alias("child_exit_code"), "traces_captured")
    )
