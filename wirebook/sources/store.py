"""The stored trace table: Parquet, partitioned by day and write batch.

Three folders belong to a table:

* ``traces``: the rows, ``dt=<day>/batch=<number>-<kind>-<name>``. Files are
  cut and sorted by (ts_ns, span_id), so that a time bound prunes days, then
  files and row groups.
* ``index``: for each span id and trace id the partitions that hold it,
  ``bucket=<first digit>/batch=...``, sorted by id.
* ``ledger``: for each batch when it was begun and, once all of it is in place,
  how many rows of each day, method and status it has.

Batches are numbered in the order they are written. ``append`` is for rows with
new ids. ``insert`` also only adds rows: where an id comes again the row that
was written last counts, which readers resolve from the inserted batches' ids.
So nothing is rewritten while others read, and a live tail never sees a row twice.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirebook.operators.filters import TraceQuery, day_of, method_in, status_between
from wirebook.operators.page import query_page
from wirebook.operators.totals import stats
from wirebook.params import parse_span_id, parse_trace_id
from wirebook.schema import BODY_COLUMNS, HISTORY_PAGE, STORE_PAGE, TRACE_COLUMNS, TRACE_DDL
from wirebook.session import durable

# Ids are spread evenly over all files, so only bloom filters can skip row groups for them.
WRITE_OPTIONS = {
    "partitionOverwriteMode": "dynamic",
    "parquet.bloom.filter.enabled#span_id": "true",
    "parquet.bloom.filter.enabled#trace_id": "true",
}
APPENDED, INSERTED = "a", "i"
INDEX_DDL = "kind STRING, id STRING, dt DATE, place STRING, bucket STRING, batch STRING"
LEDGER_DDL = "number BIGINT, name STRING, kind STRING, dt DATE, method STRING, status_code INT, rows BIGINT, stage STRING, batch STRING"
BATCH = re.compile(r"[A-Za-z0-9_.-]+")


def latest_per_span(traces: DataFrame, order: str = "ts_ns") -> DataFrame:
    """One row per span id, the one with the greatest ``order``; of equal ones
    that of the greatest hash, so that a retry keeps the same. Copies of a
    span id are combined map-side, so many copies of one id are no hot group."""
    rest = [c for c in traces.columns if c != "span_id"]
    plain = [F.to_json(c) if c.endswith("_headers") else F.col(c) for c in rest]
    # A struct with a map cannot be compared, so max_by compares ``order`` and the hash only.
    return traces.groupBy("span_id").agg(
        F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*plain))).alias("row")
    ).select("span_id", "row.*").select(*traces.columns)


def batch_number(batch: Column | str = "batch") -> Column:
    return F.substring(batch, 1, 20).cast("bigint")


def _kind(batch: str = "batch") -> Column:
    return F.substring(batch, 22, 1)


@dataclass(frozen=True)
class Batch:
    number: int
    kind: str
    name: str

    @property
    def folder(self) -> str:
        return f"{self.number:020d}-{self.kind}-{self.name}"


class TraceTable:
    """Table of traces under one folder; the last row written for a span id counts."""

    def __init__(self, spark: SparkSession, path: str, files_per_write: int | None = None):
        self.spark = spark
        self.path = path
        self.files_per_write = files_per_write

    # Reading

    def _folder(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _stored(self) -> DataFrame:
        """Every stored row, replaced ones too."""
        return self._folder("traces", f"{TRACE_DDL}, batch STRING")

    def ledger(self) -> DataFrame:
        """Batches by ``stage``: begun, and done with counts per day, method and status."""
        return self._folder("ledger", LEDGER_DDL)

    def _resolved(self, until: int | None = None) -> DataFrame:
        """Rows that count, with their batch. ``until`` leaves later batches out.

        Only ids of inserted batches are compared, and only a row that they
        hold again is left out. Filters on the result reach the scans, so days
        that are not asked for are not read.
        """
        stored = self._stored()
        if until is not None:
            stored = stored.where(batch_number() <= until)
        inserted = stored.where(_kind() == INSERTED)
        newest = inserted.groupBy("span_id").agg(F.max("batch").alias("_newest"))
        appended = stored.where(_kind() == APPENDED)
        again = newest.withColumnRenamed("span_id", "_id")
        kept = appended.join(again, (F.col("span_id") == F.col("_id")) & (F.col("_newest") > F.col("batch")), "left_anti")
        last = inserted.join(newest, "span_id").where(F.col("batch") == F.col("_newest")).select(*stored.columns)
        return kept.unionByName(last)

    def read(self) -> DataFrame:
        return self._resolved().select(*TRACE_COLUMNS)

    def read_stream(self, after: int = -1, max_files: int = 1000) -> DataFrame:
        """Rows of the batches numbered above ``after`` as a stream;
        ``max_files`` per trigger holds a flood back. A replacing row comes as
        a row of its own; what ``compact`` wrote does not come again."""
        return (
            self.spark.readStream.schema(f"{TRACE_DDL}, batch STRING")
            .option("maxFilesPerTrigger", max_files)
            .parquet(f"{self.path}/traces")
            .where((batch_number() > after) & ~F.contains("batch", F.lit("-compact-")))
            .select(*TRACE_COLUMNS)
        )

    def frontier(self) -> int:
        """The last batch number up to which every batch is done; -1 without any."""
        stages = self.ledger().groupBy("number", "name").agg(F.max((F.col("stage") == "done").cast("int")).alias("done"))
        seen = stages.agg(F.max("number").alias("last"), F.min(F.when(F.col("done") == 0, F.col("number"))).alias("open")).first()
        if seen["last"] is None:
            return -1
        return seen["last"] if seen["open"] is None else seen["open"] - 1

    def history_and_tail(self, held: int = HISTORY_PAGE) -> tuple[DataFrame, DataFrame]:
        """What a live list starts with: the latest traces up to now, and the
        stream of those written later. Every row is in one of them, none in both."""
        now = self.frontier()
        return query_page(self._resolved(now), TraceQuery(limit=held)).select(*TRACE_COLUMNS), self.read_stream(now)

    def days(self) -> list[dt.date]:
        """Days present, newest first."""
        found = self.ledger().where("stage = 'done' AND rows > 0").select("dt").distinct().collect()
        return sorted((r.dt for r in found), reverse=True)

    # Writing

    def _begin(self, kind: str, name: str) -> Batch:
        """Number a batch. A repeated write finds the number that it had.

        Writers that begin at the same moment may share a number; then the name decides which is later.
        """
        if not BATCH.fullmatch(name):
            raise ValueError(f"a batch name has letters, digits, dots and dashes only, not {name!r}")
        seen = self.ledger().agg(
            F.max("number").alias("last"), F.max(F.when((F.col("name") == name) & (F.col("kind") == kind), F.col("number"))).alias("own")
        ).first()
        batch = Batch(seen["own"] if seen["own"] is not None else (-1 if seen["last"] is None else seen["last"]) + 1, kind, name)
        self._note(batch, "begun", self.spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (("dt", "date"), ("method", "string"), ("status_code", "int"))], F.lit(0).cast("bigint").alias("rows")))
        return batch

    def _note(self, batch: Batch, stage: str, counts: DataFrame) -> None:
        counts.select(
            F.lit(batch.number).cast("bigint").alias("number"), F.lit(batch.name).alias("name"), F.lit(batch.kind).alias("kind"),
            "dt", "method", "status_code", "rows", F.lit(stage).alias("stage"), F.lit(batch.folder).alias("batch"),
        ).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "batch").parquet(f"{self.path}/ledger")

    def _write(self, traces: DataFrame, batch: Batch) -> None:
        # Range partitioning on time splits a day that holds most of the rows.
        order = ["dt", "ts_ns", "span_id"]
        placed = traces.repartitionByRange(self.files_per_write, *order) if self.files_per_write else traces.repartitionByRange(*order)
        (
            placed.withColumn("batch", F.lit(batch.folder))
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .options(**WRITE_OPTIONS)
            .partitionBy("dt", "batch")
            .parquet(f"{self.path}/traces")
        )

    def _index(self, rows: DataFrame, batch: Batch) -> None:
        """Which partitions hold an id. Trace ids are combined first, so a trace with many spans is one row a day."""
        spans = rows.select(F.lit("span").alias("kind"), F.col("span_id").alias("id"), "dt")
        traces = rows.select(F.lit("trace").alias("kind"), F.col("trace_id").alias("id"), "dt").where("id IS NOT NULL").distinct()
        entries = spans.unionAll(traces).withColumns({"place": F.lit(batch.folder), "bucket": F.substring("id", 1, 1), "batch": F.lit(batch.folder)})
        order = ["bucket", "kind", "id"]
        placed = entries.repartitionByRange(self.files_per_write, *order) if self.files_per_write else entries.repartitionByRange(*order)
        placed.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/index")

    def _commit(self, traces: DataFrame, kind: str, name: str) -> None:
        """Begin, rows, index from the written rows, done. A failure in between leaves a
        batch that is not done; writing it again replaces what is there."""
        batch = self._begin(kind, name)
        self._write(traces.select(*TRACE_COLUMNS), batch)
        rows = self._stored().where(F.col("batch") == batch.folder)
        self._index(rows, batch)
        counts = rows.groupBy("dt", "method", "status_code").agg(F.count(F.lit(1)).alias("rows"))
        none = self.spark.sql("SELECT DATE'1970-01-01' AS dt, '' AS method, 0 AS status_code, 0L AS rows")
        self._note(batch, "done", counts.unionByName(none))

    def create(self) -> None:
        """Make an empty table (or keep the one that is there)."""
        for folder, ddl, by in (("traces", f"{TRACE_DDL}, batch STRING", ["dt", "batch"]), ("index", INDEX_DDL, ["bucket", "batch"]), ("ledger", LEDGER_DDL, ["stage", "batch"])):
            self.spark.createDataFrame([], ddl).write.mode("append").partitionBy(*by).parquet(f"{self.path}/{folder}")

    def append(self, traces: DataFrame, batch: str) -> None:
        """Write one named batch. Writing it again, after a failure, replaces
        it. Span ids must not be in the table yet; ids derived from content,
        as all readers here make them, keep that promise."""
        self._commit(traces, APPENDED, batch)

    def insert(self, traces: DataFrame, batch: str | None = None, order: str = "ts_ns") -> None:
        """Add traces; a span id that is stored already is replaced, and of
        several rows with one span id in ``traces`` the one with the greatest
        ``order`` stays. Nothing stored is read or rewritten."""
        self._commit(latest_per_span(traces, order).select(*TRACE_COLUMNS), INSERTED, batch or f"insert-{uuid.uuid4().hex}")

    def compact(self, before: int | None = None) -> None:
        """Join the batches numbered up to ``before`` (default: all that are
        done) into one, without the rows that were replaced.

        The joined rows are first written as an inserted batch of the highest
        of these numbers, so that they count beside the old ones; then the old
        batches go. Run it while no other writer does, on batches that live
        tails have read.
        """
        now = self.frontier() if before is None else before
        old = [r.batch for r in self.ledger().where((F.col("number") <= now) & (F.col("stage") == "done")).select("batch").distinct().collect()]
        if len(old) < 2:
            return
        # Its name comes after any other of the same number, so its rows are the latest.
        batch = Batch(now, INSERTED, f"zz-compact-{uuid.uuid4().hex}")
        rows = durable(self._resolved(now).select(*TRACE_COLUMNS), "compacted")
        self._write(rows, batch)
        written = self._stored().where(F.col("batch") == batch.folder)
        self._index(written, batch)
        counts = written.groupBy("dt", "method", "status_code").agg(F.count(F.lit(1)).alias("rows"))
        self._note(batch, "done", counts)
        for name in old:
            self._drop(name)
        # Nothing older is left, so the batch holds new ids only.
        self._settle(batch)

    def _folders(self, batch: str) -> list:
        """The partition folders of a batch, by their names alone."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = []
        for folder in ("traces/dt=*", "index/bucket=*", "ledger/stage=*"):
            pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/batch={batch}")
            fs = pattern.getFileSystem(conf)
            found += [(fs, s.getPath()) for s in fs.globStatus(pattern) or []]
        return found

    def _drop(self, batch: str) -> None:
        for fs, path in self._folders(batch):
            fs.delete(path, True)

    def _settle(self, batch: Batch) -> None:
        appended = replace(batch, kind=APPENDED)
        rows = self._stored().where(F.col("batch") == batch.folder)
        counts = rows.groupBy("dt", "method", "status_code").agg(F.count(F.lit(1)).alias("rows"))
        entries = self._folder("index", INDEX_DDL).where(F.col("batch") == batch.folder)
        # Renaming a folder moves no row.
        self._note(appended, "done", counts)
        entries.withColumns({"place": F.lit(appended.folder), "batch": F.lit(appended.folder)}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "batch").parquet(f"{self.path}/index")
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for fs, path in self._folders(batch.folder):
            if "/traces/" in path.toString():
                fs.rename(path, path_of(path.getParent(), f"batch={appended.folder}"))
            else:
                fs.delete(path, True)

    def clear(self, confirm: bool = False) -> None:
        """Delete every trace. Refuses unless confirmed. Numbers go on, so live tails stay right."""
        if not confirm:
            raise ValueError("clearing deletes every trace; it needs confirm=True")
        batch = self._begin("c", f"clear-{uuid.uuid4().hex}")
        for folder, ddl, by in (("traces", f"{TRACE_DDL}, batch STRING", ["dt", "batch"]), ("index", INDEX_DDL, ["bucket", "batch"]), ("ledger", LEDGER_DDL, ["stage", "batch"])):
            empty = self.spark.createDataFrame([], ddl)
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{self.path}/{folder}")
        self._note(batch, "done", self.spark.sql("SELECT DATE'1970-01-01' AS dt, '' AS method, 0 AS status_code, 0L AS rows"))

    # Queries

    def _counts(self) -> DataFrame:
        return self.ledger().where("stage = 'done' AND rows > 0")

    def count(self) -> int:
        """Exact. The ledger has it, unless rows were inserted that may replace others."""
        known = self._counts().groupBy("kind").agg(F.sum("rows").alias("rows")).collect()
        rows = {r.kind: r.rows for r in known}
        return self.read().count() if rows.get(INSERTED) else rows.get(APPENDED, 0)

    def stats(self) -> DataFrame:
        return stats(self.read(), self.path)

    def _holding(self, kind: str, id_: str) -> DataFrame:
        """Rows that count, of the partitions that the index names for an id.

        The join prunes the other partitions before they are opened. It is
        broadcast: no more rows than the table has partitions.
        """
        index = self._folder("index", INDEX_DDL).where((F.col("bucket") == id_[0]) & (F.col("kind") == kind) & (F.col("id") == id_))
        places = index.select("dt", F.col("place").alias("batch")).distinct()
        return self._stored().join(F.broadcast(places), ["dt", "batch"], "left_semi").where(F.col(f"{kind}_id") == id_)

    def get_by_span_id(self, span_id: str) -> DataFrame:
        found = self._holding("span", parse_span_id(span_id))
        return found.orderBy(F.desc("batch")).limit(1).select(*TRACE_COLUMNS)

    def spans_of_trace(self, trace_id: str) -> DataFrame:
        return self._spans(parse_trace_id(trace_id)).orderBy("span_id").select(*TRACE_COLUMNS)

    def _spans(self, trace_id: str) -> DataFrame:
        found = self._holding("trace", trace_id)
        inserted = self._stored().where(_kind() == INSERTED).select(F.col("span_id").alias("_id"), F.col("batch").alias("_batch"))
        return found.join(inserted, (F.col("span_id") == F.col("_id")) & (F.col("_batch") > F.col("batch")), "left_anti")

    def list_recent(self, limit: int, offset: int = 0) -> DataFrame:
        if limit == 0:
            return self.read().limit(0)
        return self.page(TraceQuery(limit=limit, offset=offset))

    def page(self, query: TraceQuery, newest: bool = False) -> DataFrame:
        """One page of the stored query; ``query.after`` goes on behind a row without counting the ones before.

        No job runs for the plan. The ledger's counts say, as a subquery, from
        which day on there are enough rows. The page's keys are found without
        touching the bodies; the full rows are joined to these keys, whose days
        prune the second scan while it runs. One path for every page size.
        """
        table = self._resolved() if query.trace_id is None else self._spans(query.trace_id)
        first = self._first_day(query) if query.trace_id is None else None
        if first is not None:
            table = table.where(F.col("dt") >= first)
        key = ["dt", "batch", "ts_ns", "span_id"]
        keys = query_page(table.drop(*BODY_COLUMNS), query, newest).select(*key).distinct()
        matching = table.where(query.predicate(newest=newest)).join(keys, key, "left_semi")
        return query_page(matching, replace(query, limit=query.limit or STORE_PAGE, offset=0), newest).select(*TRACE_COLUMNS)

    def _first_day(self, query: TraceQuery) -> Column | None:
        """The latest day from which on there surely are as many matching rows as the page needs.

        Counts are known by day, method and status; a URL filter is not, so
        with one every day is looked at. An inserted row may replace another
        one, so each raises what is needed by one. The day of a bound in time
        has an unknown share, so it is not counted.
        """
        if query.url_contains is not None:
            return None
        counts = self._counts()
        matching = F.lit(True)
        if query.methods:
            matching &= method_in(list(query.methods), F.col("method"))
        if query.status is not None:
            matching &= status_between(query.status, F.col("status_code"))
        ends = [day_of(ns) for ns in (query.until_ns, query.after[0] if query.after else None) if ns is not None]
        for end in ends:
            matching &= F.col("dt") < F.lit(end)
        wanted = query.offset + (query.limit or STORE_PAGE)
        per_day = counts.groupBy("dt").agg(
            F.sum(F.when(matching & (F.col("kind") == APPENDED), F.col("rows")).otherwise(F.lit(0))).alias("rows"),
            F.sum(F.when(F.col("kind") == INSERTED, F.col("rows")).otherwise(F.lit(0))).alias("inserted"),
        )
        # One row for each day.
        behind = Window.orderBy(F.desc("dt")).rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        summed = per_day.select("dt", F.sum("rows").over(behind).alias("so_far"), F.sum("inserted").over(everything).alias("replaced"))
        enough = summed.where(F.col("so_far") >= F.lit(wanted) + F.col("replaced")).agg(F.max("dt").alias("dt"))
        return enough.select(F.expr("coalesce(dt, DATE'0001-01-01')")).scalar()
