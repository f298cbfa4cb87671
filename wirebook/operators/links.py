"""Which span caused which: the nearest span of the same trace that encloses it in time.

A window or a self-join over a trace puts it into one task, and one trace may
hold a third of all spans. Here spans are dealt out by ranges of (trace, start,
longest first, id). In that order a span's cause is the last span before it
that ends no earlier, so a task goes through its rows once with a stack of
spans that are still open. Only a task's first trace can have begun before, and
only spans of it that nothing in the task encloses remain. Of each task's last
trace what is left of the stack is written beside the rows; a remaining span is
sent to the last task before its own where a span ends no earlier, and finds
its cause there by one running value over both, in the order of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.operators.scan import Last, scan
from wirebook.session import durable, ship

ROW, OPEN, LEFT = 0, 1, 2
_PASSED = pa.schema([
    ("trace_id", pa.string()), ("span_id", pa.string()), ("parent_span_id", pa.string()), ("_end", pa.int64()),
    ("_what", pa.int32()), ("_holder", pa.int32()), ("_place", pa.int64()),
])
_PASSED_DDL = "trace_id string, span_id string, parent_span_id string, _end bigint, _what int, _holder int, _place bigint"


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each of a task's sorted spans its parent inside the task, and at the end what is left of the stack."""
    task = TaskContext.get().partitionId()
    stack: list[tuple[int, str, int]] = []  # ends, ids and places of open spans; no end is above the one before
    trace, first, begun, last, place = None, True, False, None, 0
    for batch in batches:
        traces, spans, starts, ends = (batch.column(k).to_pylist() for k in range(4))
        parents, kinds = [], []
        for own, span, start, end in zip(traces, spans, starts, ends, strict=True):
            if own != trace:
                first, begun, trace, last = not begun, True, own, None
                stack.clear()
            if last is not None and last[0] == (span, start, end):
                parents.append(last[1])  # a repeated row: the parent of its copy
                kinds.append(last[2])
            else:
                while stack and stack[-1][0] < end:
                    stack.pop()
                parent = stack[-1][1] if stack else None
                kind = OPEN if parent is None and first else ROW
                parents.append(parent)
                kinds.append(kind)
                last = (span, start, end), parent, kind
                stack.append((end, span, place + len(parents) - 1))
        n = len(parents)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(parents, pa.string()), batch.column(3), pa.array(kinds, pa.int32()),
            pa.array([task] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()),
        ], schema=_PASSED)
        place += n
    for at in range(0, len(stack), 10_000):
        ends, spans, places = zip(*stack[at : at + 10_000], strict=True)
        n = len(ends)
        yield pa.RecordBatch.from_arrays([
            pa.array([trace] * n, pa.string()), pa.array(spans, pa.string()), pa.nulls(n, pa.string()), pa.array(ends, pa.int64()),
            pa.array([LEFT] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(places, pa.int64()),
        ], schema=_PASSED)


def causal_parents(traces: DataFrame, partitions: int | None = None) -> DataFrame:
    """``trace_id, span_id, parent_span_id`` for every row of ``traces``.

    A span lasts from ``ts_ns`` for ``duration_ns`` (null: 0), both ends
    included. Its parent is the shortest reaching one of the spans of its trace
    that begin no later and end no earlier: the one that begins last, then the
    one that ends first, then the greatest id. Of spans with the same times the
    smaller id is the cause. A span without such a one, or without a trace, an
    id or a time, has no parent. Repeated rows of a span have the same parent.
    Ids are 16 hexadecimal digits, as everywhere in the table; other columns are
    not read. What a task remembers grows with how deep spans are nested.
    """
    ship(traces.sparkSession)
    end = (F.col("ts_ns") + F.coalesce("duration_ns", F.lit(0))).cast("bigint")
    spans = traces.select("trace_id", "span_id", F.col("ts_ns").cast("bigint").alias("_start"), end.alias("_end"))
    timed = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("_start").isNotNull()
    order = ["trace_id", "_start", F.desc("_end"), "span_id"]
    placed = spans.where(timed)
    placed = placed.repartitionByRange(partitions, *order) if partitions else placed.repartitionByRange(*order)
    passed = durable(placed.sortWithinPartitions(*order).mapInArrow(_through, _PASSED_DDL), "spans")

    left, opened = passed.where(F.col("_what") == LEFT), passed.where(F.col("_what") == OPEN)
    # One element for each task: what it has of the trace that may go on ends there at the latest.
    reach = left.groupBy("trace_id", "_holder").agg(F.max("_end").alias("until")).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("_holder", "until"))).alias("tasks"))
    before = F.filter("tasks", lambda t: (t["_holder"] < F.col("_holder")) & (t["until"] >= F.col("_end")))
    sent = durable(opened.join(F.broadcast(reach), "trace_id", "left").withColumn("_at", F.get(before, F.size(before) - 1)["_holder"]).drop("tasks"), "sent")

    asked = sent.where(F.col("_at").isNotNull()).withColumnRenamed("_holder", "_from")
    there = left.withColumns({"_at": F.col("_holder"), "_from": F.col("_holder")})
    columns = ["trace_id", "span_id", "_what", "_at", F.struct((-F.col("_end")).alias("end"), (-F.col("_what")).alias("kind"), "_from", "_place").alias("_order")]
    needed = asked.select("_at").distinct()  # a row for each task at most
    both = durable(asked.select(*columns).unionByName(there.join(F.broadcast(needed), "_at", "left_semi").select(*columns)), "met")
    half = [F.when(F.col("_what") == LEFT, F.conv(F.substring("span_id", at, 8), 16, 10)).cast("bigint") for at in (1, 9)]
    found = scan(both, ["_at"], "_order", {"_high": Last(half[0]), "_low": Last(half[1])}, partitions).where(F.col("_what") == OPEN)
    parent = F.lower(F.concat(*[F.lpad(F.hex(part), 8, "0") for part in ("_high", "_low")]))

    result = ["trace_id", "span_id", "parent_span_id"]
    none = F.lit(None).cast("string").alias("parent_span_id")
    return (
        passed.where(F.col("_what") == ROW).select(*result)
        .unionByName(sent.where(F.col("_at").isNull()).select("trace_id", "span_id", none))
        .unionByName(found.select("trace_id", "span_id", parent.alias("parent_span_id")))
        .unionByName(spans.where(~timed).select("trace_id", "span_id", none))
    )
