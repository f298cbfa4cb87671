"""Session settings and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PARTITION_BYTES = 256 * 1024 * 1024


def configure(builder: SparkSession.Builder, input_bytes: int | None = None) -> SparkSession.Builder:
    """Settings the package is tuned for; anything the cluster sets later wins.

    ``input_bytes`` is the size of the data a job shuffles: 100 TB need far
    more than the default 200 partitions, and adaptive execution only joins
    partitions, it never makes more of them.
    """
    if input_bytes is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", min(max(input_bytes // PARTITION_BYTES, 200), 400_000)
        )
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only on a local master, where driver and executors share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="wirebook-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame, name: str, codec: str | None = None, at_once: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps that use it twice do not recompute it, lost executors do not
    lose it, and its real size is known to the optimizer. ``codec`` is for
    tables that hold bodies, which take most of the disk; they are read
    ``at_once`` rows at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    long = codec is not None or at_once is not None
    with _shuffles_dropped(spark):
        df.write.options(**(LONG_VALUES if long else {})).parquet(path, compression=codec)
    return _read_slowly(spark, df, path, at_once or AT_ONCE) if long else spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here needs its shuffle files no more; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of long values that a task reads at once. Spark's reader takes 4096, which may be gigabytes.
AT_ONCE = 256
#: Pages and row groups by their size from the first rows on: by default 100 rows are kept before it is looked at.
LONG_VALUES = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4"}

_READERS: dict[tuple, SparkSession] = {}


def _reader(spark: SparkSession, at_once: int) -> SparkSession:
    """A session like ``spark`` that reads so many rows at once; a file's reader goes by the session that names the file."""
    settings = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and spark.conf.isModifiable(k)}
    key = spark.sparkContext.applicationId, at_once, *sorted(settings.items())
    if key not in _READERS:
        _READERS[key] = spark.newSession()
        for name, value in settings.items():
            _READERS[key].conf.set(name, value)
        _READERS[key].conf.set("spark.sql.parquet.columnarReaderBatchSize", at_once)
    return _READERS[key]


def _read_slowly(spark: SparkSession, df: DataFrame, path: str, at_once: int) -> DataFrame:
    found = _reader(spark, at_once).read.schema(df.schema).parquet(path)
    # Nothing of the caller's session goes before it, so that all that follows is planned there; the optimizer takes it out.
    nothing = spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return nothing.unionAll(found)


#: Bytes that go to a worker at once where the session does not say.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of long values for workers: of 64 MB, each is held several times over on its way."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


#: Rows and bytes a task is dealt at most where the number of tasks is up to the package.
TASK_ROWS, TASK_BYTES = 1 << 20, 1 << 28


def tasks_for(spark: SparkSession, rows: int, size: int) -> int | None:
    """Tasks that so many rows and bytes are dealt to; None where the session's number is as many.

    Adaptive execution only joins partitions, so with a fixed number of them
    what a task sorts and keeps in memory would grow with the input.
    """
    needed = -(-max(rows * TASK_BYTES, size * TASK_ROWS) // (TASK_ROWS * TASK_BYTES))
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys``; with None to as many tasks as the session says."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


@functools.cache
def _shipped(application: str) -> str:
    """The package as a zip file, made once for each application."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wirebook-"), "wirebook_code.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                packed.write(file, os.path.relpath(file, os.path.dirname(top)))
    return path


_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the workers; Spark hands it to every executor."""
    path = _shipped(spark.sparkContext.applicationId)
    if path not in _SENT:
        spark.sparkContext.addPyFile(path)
        _SENT.add(path)


def release() -> None:
    """Give memory that a task has freed back to the system: workers stay, and many idle ones add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
