"""What several operators of this folder need."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.session import durable, release

__all__ = ["WORD", "durable", "free_name", "kept", "read", "release", "ship", "slices", "strings", "unit_hash", "without"]

#: A word: a run of characters that are not ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _shipped(application: str) -> str:
    """The package as a zip file, made once for each application."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="wirebook-"), "wirebook_code.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                packed.write(file, os.path.relpath(file, os.path.dirname(top)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package's code to the workers, which keep what they cache in it from task to task."""
    path = _shipped(spark.sparkContext.applicationId)
    if path not in _SENT:
        spark.sparkContext.addPyFile(path)
        _SENT.add(path)


_SENT: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that the frame doesn't have."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns of these names, in any case: result columns replace them."""
    gone = {name.lower() for name in names}
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in gone])


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, nulls told apart from texts.

    DuckDB's md5 gives the same digits, so that SQL can repeat the draw.
    """
    told = [F.coalesce(F.concat(F.lit("="), F.col(p).cast("string") if isinstance(p, str) else p.cast("string")), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *told)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array, null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


#: Text that an operator works on at once.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many bytes together, a longer text alone: what a run needs besides follows its bytes."""
    sizes = np.asarray(pc.binary_length(texts)) if len(texts) else np.zeros(0, np.int64)
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


_KEPT: dict[str, dict] = {}


def kept(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a worker from task to task.

    Spark reuses workers for all operators of an application, so a worker lets
    go of the others' things first, and gives their memory back.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[owner] = {}
    own = _KEPT[owner]
    if key not in own:
        own.clear()
        own[key] = make()
    return own[key]
