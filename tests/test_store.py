import dataclasses

import pytest
from pyspark.sql import functions as F

from wirebook.operators.filters import TraceQuery
from wirebook.operators.page import query_page
from wirebook.plans.presets import agent_list_traces, clear_traces, list_traces
from wirebook.schema import BODY_COLUMNS
from wirebook.sources import tables
from wirebook.sources.store import TraceTable


@pytest.fixture(scope="module")
def traces(spark, sf_dir):
    return tables.traces_from_events(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def table(spark, traces, tmp_path_factory):
    table = TraceTable(spark, str(tmp_path_factory.mktemp("store")), files_per_write=4)
    table.append(traces, "first")
    return table


def spans(df):
    return [r.span_id for r in df.collect()]


def test_round_trip(table, traces):
    assert table.count() == traces.count()
    # Maps cannot be compared by set operations, so their sorted entries are.
    flat = lambda df: df.withColumns({c: F.array_sort(F.map_entries(c)) for c in ("request_headers", "response_headers")})
    assert flat(table.read()).exceptAll(flat(traces)).isEmpty()


def test_repeated_batch_changes_nothing(table, traces):
    table.append(traces, "first")
    assert table.count() == traces.count()


def test_pages_match_frame(table, traces):
    for settings in ({}, {"status": "5xx", "limit": 7, "offset": 3}, {"trace_id": f"{7:032x}", "limit": 5},
                     {"since": "2024-01-09T00:00:00Z", "until": "2024-01-11T00:00:00Z", "limit": 30}):
        assert spans(list_traces(table, **settings)) == spans(list_traces(traces, **settings))
    assert spans(agent_list_traces(table)) == spans(agent_list_traces(traces))
    assert spans(table.page(TraceQuery(limit=900, offset=50))) == spans(list_traces(traces, limit=900, offset=50))
    assert table.list_recent(0).isEmpty()
    assert spans(table.page(TraceQuery(url_contains="nowhere"))) == []


def test_time_bound_prunes(table):
    query = TraceQuery.parse(since="2024-01-09T00:00:00Z", until="2024-01-11T00:00:00Z")
    plan = table.read().where(query.predicate()).drop(*BODY_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dt" in partition_filters
    assert "GreaterThanOrEqual(ts_ns" in plan and "_body:binary" not in plan


def test_lookup(table):
    assert spans(table.get_by_span_id("000000000000002A")) == ["000000000000002a"]
    assert spans(table.get_by_span_id("ffffffffffffffff")) == []
    found = spans(table.spans_of_trace(f"{7:032x}"))
    assert found == sorted(found) and found
    assert table.stats().first().data_dir == table.path


def test_insert_replaces_and_clear(spark, traces, tmp_path):
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=2)
    table.create()
    assert table.count() == 0
    table.append(traces.where("status_code = 404"), "a")  # days of this batch will lose all their rows
    table.append(traces.where("status_code <> 404"), "b")
    moved = traces.where("status_code = 404").withColumns({
        "method": F.lit("PATCH"), "ts_ns": F.col("ts_ns") + 86_400_000_000_000, "dt": F.date_add("dt", 1)})
    older = moved.withColumns({"method": F.lit("OLD"), "ts_ns": F.col("ts_ns") - 1})
    table.insert(moved.unionByName(older))
    assert table.count() == traces.count() == table.read().select("span_id").distinct().count()
    assert table.read().where("status_code = 404").select("method").distinct().collect()[0].method == "PATCH"
    with pytest.raises(ValueError):
        clear_traces(table, confirm=False)
    assert clear_traces(table, confirm=True) == {"cleared": True}
    assert table.count() == 0 and table.page(TraceQuery()).isEmpty() and table.days() == []


def test_last_written_row_counts(spark, traces, tmp_path):
    """Inserted rows replace whatever their time; of equal ids in one insert the greatest order stays."""
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=2)
    some = traces.orderBy("span_id").limit(30).persist()
    table.append(some, "first")
    one = some.orderBy("span_id").limit(1)
    span = one.first().span_id
    for method, shift in (("PUT", 0), ("DELETE", -400), ("PATCH", -3)):
        later = one.withColumns({"method": F.lit(method), "ts_ns": F.col("ts_ns") + shift * 86_400_000_000_000, "dt": F.date_add("dt", shift)})
        table.insert(later)
        assert table.get_by_span_id(span).first().method == method
        assert table.read().where(F.col("span_id") == span).select("method").collect() == [(method,)]
        assert table.count() == 30
        found = table.spans_of_trace(one.first().trace_id).collect()
        assert [r.method for r in found if r.span_id == span] == [method]
        assert [r.span_id for r in table.page(TraceQuery(limit=100)).collect()].count(span) == 1
    assert len(spans(table.page(TraceQuery(limit=29)))) == 29
    before = sorted(map(str, table.read().collect()))
    table.compact()
    assert sorted(map(str, table.read().collect())) == before and table.count() == 30
    assert table.get_by_span_id(span).first().method == "PATCH"
    assert table._stored().select("batch").distinct().count() == 1
    table.insert(one.withColumn("method", F.lit("HEAD")))
    assert table.get_by_span_id(span).first().method == "HEAD" and table.count() == 30
    table.compact()
    assert table.count() == 30 and table.get_by_span_id(span).first().method == "HEAD"


def test_history_and_tail_meet(spark, traces, tmp_path):
    """The tail has what is written after the history, once, whatever is inserted or compacted."""
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=2)
    ids = traces.select("span_id").orderBy("span_id").limit(60)
    some = traces.join(ids, "span_id").select(*traces.columns).persist()
    part = lambda low, high: some.where((F.substring("span_id", 15, 2) >= f"{low:02x}") & (F.substring("span_id", 15, 2) < f"{high:02x}"))
    table.append(part(0, 10), "a")
    table.insert(part(5, 15))
    table.compact()
    history, tail = table.history_and_tail()
    assert history.count() == 15
    running = tail.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        running.processAllAvailable()
        assert spark.table("seen").isEmpty()
        table.append(part(15, 20), "b")
        table.insert(part(3, 6).withColumn("method", F.lit("PATCH")))
        running.processAllAvailable()
        table.append(part(15, 20), "b")  # repeated after a failure: the same files again
        seen = sorted(r.span_id[-2:] for r in spark.table("seen").where("method = 'PATCH'").collect())
        assert seen == ["03", "04", "05"]
        table.append(part(20, 22), "d")
        running.processAllAvailable()
        new = sorted(r.span_id[-2:] for r in spark.table("seen").where("method <> 'PATCH'").dropDuplicates(["span_id"]).collect())
        assert new == ["0f", "10", "11", "12", "13", "14", "15"]
    finally:
        running.stop()
    assert table.count() == 22


def test_unfinished_batches_belong_to_the_tail(spark, traces, tmp_path):
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=1)
    table.append(traces.limit(5), "a")
    assert table.frontier() == 0
    begun = table._begin("a", "b")
    table.append(traces.orderBy("span_id").limit(3).withColumn("span_id", F.concat(F.lit("f"), F.substring("span_id", 2, 15))), "c")
    assert (begun.number, table.frontier()) == (1, 0)
    assert table._begin("a", "b").number == 1
    assert table.history_and_tail()[0].count() == 5


def test_lookup_opens_only_what_the_index_names(spark, traces, tmp_path):
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=1)
    table.append(traces.where("pmod(hash(span_id), 3) <> 0"), "a")
    table.append(traces.where("pmod(hash(span_id), 3) = 0"), "b")
    row = table.read().orderBy("span_id").first()
    holds = {(r.dt, r.batch) for r in table._stored().where(F.col("trace_id") == row.trace_id).select("dt", "batch").distinct().collect()}
    every = {(r.dt, r.batch) for r in table._stored().select("dt", "batch").distinct().collect()}
    # Days and batches prune each for itself.
    kept = {(day, batch) for day, batch in every if day in {d for d, _ in holds} and batch in {b for _, b in holds}}
    assert len(kept) < len(every)
    for day, batch in every - kept:  # these files cannot be read any more
        for file in (tmp_path / "t" / "traces" / f"dt={day}" / f"batch={batch}").glob("*.parquet"):
            file.write_bytes(b"not parquet")
        for crc in (tmp_path / "t" / "traces" / f"dt={day}" / f"batch={batch}").glob(".*.crc"):
            crc.unlink()
    assert table.get_by_span_id(row.span_id).first().span_id == row.span_id
    assert row.span_id in spans(table.spans_of_trace(row.trace_id))
    assert row.span_id in spans(table.page(TraceQuery(trace_id=row.trace_id, limit=1000)))


def test_pages_by_cursor(table, traces):
    """Pages that go on behind the last row are those that skip rows."""
    for settings in ({}, {"status": "5xx"}, {"methods": ["POST"]}, {"url_contains": "CLICK"}, {"until": "2024-01-11T00:00:00Z"}):
        query = TraceQuery.parse(limit=40, **settings)
        page = table.page(query).collect()
        for at in range(40, 121, 40):
            last = page[-1]
            page = table.page(dataclasses.replace(query, after=(last.ts_ns, last.span_id))).collect()
            assert [r.span_id for r in page] == spans(query_page(traces, dataclasses.replace(query, offset=at)))
    trace = TraceQuery.parse(trace_id=f"{7:032x}", limit=3)
    first = spans(table.page(trace))
    assert spans(table.page(dataclasses.replace(trace, after=(0, first[-1])))) == spans(query_page(traces, dataclasses.replace(trace, offset=3)))


def test_page_reads_the_newest_days_only(spark, traces, tmp_path):
    """The ledger's counts name the days; older ones are not opened, and no job runs for the plan."""
    table = TraceTable(spark, str(tmp_path / "t"), files_per_write=1)
    table.append(traces, "a")
    days = table.days()
    per_day = {r.dt: r["count"] for r in traces.groupBy("dt").count().collect()}
    assert days == sorted(per_day, reverse=True)
    for day in days[2:]:
        for file in (tmp_path / "t" / "traces" / f"dt={day}").glob("batch=*/*.parquet"):
            file.write_bytes(b"not parquet")
        for crc in (tmp_path / "t" / "traces" / f"dt={day}").glob("batch=*/.*.crc"):
            crc.unlink()
    wanted = per_day[days[0]] + 1
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    page = table.page(TraceQuery(limit=wanted))
    assert not tracker.getJobIdsForGroup("plan")
    assert spans(page) == spans(query_page(traces, TraceQuery(limit=wanted)))
