"""Shards of nearly equal size from sampled splitters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import free_name, ship, without

#: Ranges for each shard at least, bytes of a range at most where that needs more, and ranges at most.
RANGES_PER_SHARD = 8
RANGE_BYTES = 256 << 20
MOST_RANGES = 200_000
#: Samples for each range: 3.2 million keys on the driver at most.
OVERSAMPLE = 16
ROUNDS = 4


def _locate(splitters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each key pair the number of splitters up to it; ``splitters`` are sorted pairs."""
    first, second = splitters[:, 0], splitters[:, 1]
    low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    equal = np.flatnonzero(low < high)
    for lo in np.unique(low[equal]):  # keys whose first part is a splitter's
        own = equal[low[equal] == lo]
        low[own] = lo + np.searchsorted(second[lo : high[own[0]]], b[own], "right")
    return low


def _range_of(splitters: np.ndarray):
    @F.arrow_udf("int")
    def find(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_locate(splitters, np.asarray(a), np.asarray(b)).astype(np.int32))

    return find


def _splitters(sample: np.ndarray, weights: np.ndarray, pieces: int) -> np.ndarray:
    """The weighted quantiles of sampled key pairs."""
    if not len(sample) or pieces < 2:
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((sample[:, 1], sample[:, 0]))
    sample, reached = sample[order], np.cumsum(weights[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, pieces) / pieces)
    return np.unique(sample[at], axis=0)


def write_shards(docs: DataFrame, path: str, shards: int, size: Column, key: list[str], tie: list[str]) -> DataFrame:
    """Write every row into one of ``shards`` shards of nearly equal total ``size``; return them read again.

    Rows are ordered by the hash of ``key`` and then of ``tie``. A sample of
    these key pairs, drawn with a chance in proportion to ``size``, gives
    quantile boundaries; ranges that hold more than twice their share are
    subdivided by further samples, inside one key too, so that copies of one
    text fill several ranges when they must. Sizes of ranges are then counted
    exactly, and a running sum inside each range gives the shard whose part of
    the whole holds the row's middle: shards differ from the mean by one row's
    size at most. Rows of equal key stay together but where a boundary falls
    among them.

    The result has the columns of ``docs`` (those named ``shard`` or ``slot``
    are replaced), ``shard`` from 0 and ``slot``, gapless from 0 inside each
    shard. The folder ``path`` is partitioned by shard. Nulls in ``key`` and
    ``tie`` are values like others; a null size counts as 0. Rows that agree
    in key and tie get neighbouring slots in any order. No rows give no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, ["shard", "slot"])
    a, b, w, r, g = (free_name(docs, n) for n in ("_key", "_tie", "_size", "_range", "_row"))
    keyed = docs.withColumns({a: F.xxhash64(*key), b: F.xxhash64(F.lit("tie"), *tie), w: F.coalesce(size, F.lit(0)).cast("bigint")})
    total, rows = keyed.agg(F.coalesce(F.sum(w), F.lit(0)), F.count("*")).first()
    count = int(min(max(shards * RANGES_PER_SHARD, total // RANGE_BYTES), MOST_RANGES))
    share = max(1, total) / count

    def drawn(frame: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
        chance = F.col(w) * F.lit(OVERSAMPLE / share)
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a, b), 11) * F.lit(2.0**-53)
        got = frame.filter(unit < chance).select(a, b, F.greatest(chance, F.lit(1.0)).alias(w)).toPandas()
        return got[[a, b]].to_numpy(np.int64).reshape(-1, 2), got[w].to_numpy(np.float64)

    splitters = _splitters(*drawn(keyed, 0), count)
    for again in range(1, ROUNDS + 1):
        placed = keyed.withColumn(r, _range_of(splitters)(a, b))
        # As many rows as ranges: bounded by MOST_RANGES and what subdividing adds.
        several = (F.min(a) < F.max(a)) | (F.min(b) < F.max(b))
        sizes = sorted(tuple(x) for x in placed.groupBy(r).agg(F.sum(w), F.count("*"), several).collect())
        over = {own: max(2, round(held / share)) for own, held, _, more in sizes if held > 2 * share and more}
        if not over or again == ROUNDS:
            break
        keys, weights = drawn(placed.filter(F.col(r).isin(list(over))), again)
        which = _locate(splitters, keys[:, 0], keys[:, 1])
        added = [_splitters(keys[which == own], weights[which == own], pieces) for own, pieces in over.items()]
        splitters = np.unique(np.concatenate([splitters, *added]), axis=0)

    starts, at, row = [], 0, 0
    for own, held, n, _ in sizes:
        starts.append((own, at, row))
        at, row = at + held, row + n
    before = F.broadcast(spark.createDataFrame(starts, f"{r} int, _bytes_before bigint, _rows_before bigint"))
    inside = Window.partitionBy(r).orderBy(a, b, w)
    reached = F.col("_bytes_before") + F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = (2 * reached.cast("decimal(38,0)") - F.col(w)) * F.lit(shards)
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * max(1, total))).cast("int"))
    written = placed.join(before, r).withColumns({"shard": shard, g: F.col("_rows_before") + F.row_number().over(inside) - 1})
    kept = [*docs.columns, "shard", g]
    written.select(*[F.col(f"`{c}`") for c in kept]).write.partitionBy("shard").parquet(path)
    back = spark.read.schema(written.select(*[F.col(f"`{c}`") for c in [*docs.columns, g, "shard"]]).schema).parquet(path)
    first = F.broadcast(back.groupBy("shard").agg(F.min(g).alias("_first")))  # one row for each shard
    return back.join(first, "shard").withColumn("slot", F.col(g) - F.col("_first")).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")
