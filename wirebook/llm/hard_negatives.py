"""Hard negatives by slots: for each anchor and positive the closest rows of another label below the positive.

Scores are integer inner products. Every anchor meets every row, in blocks: the
first pass finds the anchor's positives. Their scores are the upper limits of
overlapping windows; sorted, they cut the scores into disjoint slots. The second
pass keeps the first rows of each slot, in every task and then in all, and a
window is answered from its own slot and those below it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import durable, ship

#: Anchors that are compared with a row at once, rows of a block, and blocks of rows that meet an anchor block in one task.
ANCHORS, ROWS, BLOCKS = 4096, 4096, 16
#: Scores that are held at once.
SCORES = 1 << 22
#: Larger components (after scaling) would not leave sums of products exact.
LARGEST = 1 << 24

BLOCK_DDL = "ids binary, labels binary, vectors binary"
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _sound(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantised(table: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, v``: sound rows, components as floor(scale * x). See ``mine`` for what is left out."""
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.dropna().where(F.forall("x", _sound))
    v = F.transform("x", lambda x: F.floor(x * scale))
    rows = rows.select("vec_id", "label", v.alias("v")).where(F.forall("v", lambda x: F.abs(x) < LARGEST))
    longest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (longest[0]["n"] if longest else 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")


def _packed(size: int):
    """Rows of each task as blocks of at most ``size``, sorted by label."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                labels = np.asarray(some.column(1))
                by = np.argsort(labels, kind="stable")
                vectors = np.asarray(some.column(2).flatten()).astype(np.int32).reshape(len(by), -1)[by]
                yield pa.RecordBatch.from_arrays([
                    pa.array([np.asarray(some.column(0))[by].tobytes()], pa.binary()), pa.array([labels[by].tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()),
                ], ["ids", "labels", "vectors"])

    return pack


@dataclasses.dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, ids: bytes, labels: bytes, vectors: bytes) -> Block:
        ids = np.frombuffer(ids, np.int64)
        return cls(ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int32).reshape(len(ids), -1))

    def scores(self, rows: Block, begin: int, end: int) -> np.ndarray:
        """Exact inner products of some of the anchors with all rows."""
        own, other = self.vectors[begin:end], rows.vectors
        reach = float(np.abs(own).max(initial=0)) * float(np.abs(other).max(initial=0)) * own.shape[1]
        kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
        return (own.astype(kind) @ other.astype(kind).T).astype(np.int64)


def first_of_each(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group: greater scores first, then smaller ids."""
    by = np.lexsort((ids, -scores, groups))
    sorted_groups = groups[by]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(sorted_groups)) + 1]) if len(by) else np.zeros(0, np.int64)
    place = np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))
    return by[place < k]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _grid(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows: a stated query set against all rows.

    Blocks of rows are dealt to lots, and a block of anchors goes to every lot
    once, so both sides are shuffled in blocks, and no task gets more than a lot.
    """
    lots = max(1, -(-rows.count() // BLOCKS))
    own = anchors.withColumnsRenamed({"ids": "a_ids", "labels": "a_labels", "vectors": "a_vectors"})
    own = own.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(lots)).cast("int"))
    return own.join(dealt, "lot")


def mine(
    table: DataFrame, anchor_filter: str, label: Column, *, scale: int = 256, positives: int = 5, negatives: int = 5,
    least_percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that fulfil ``anchor_filter``, a SQL condition on
    ``vec_id``; their positives are the first ``positives`` other rows of the
    same ``label``. For each positive come the first ``negatives`` rows of other
    labels whose score is between ``least_percent`` of the positive's and the
    positive's; so none for a negative one. Greater scores come first, ties by
    the smaller id.

    Rows without an id or a label, with a null vector, a null or non-finite
    component or a component of 2^24 or more after scaling, and vectors of
    another length than most take no part. An id that comes more than once
    counts with its least label and vector. Columns besides the three are not
    read. An empty table gives no rows.
    """
    ship(table.sparkSession)
    rows = durable(quantised(table, label, scale, id_col, vector_col), "quantised")
    blocks = durable(rows.mapInArrow(_packed(ROWS), BLOCK_DDL), "row-blocks")
    anchors = durable(rows.where(anchor_filter).repartition(max(1, -(-rows.where(anchor_filter).count() // ANCHORS)), "vec_id").mapInArrow(_packed(ANCHORS), BLOCK_DDL), "anchor-blocks")
    grid = _grid(anchors, blocks)

    def nearest_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                own, other = Block.of(r["a_ids"], r["a_labels"], r["a_vectors"]), Block.of(r["ids"], r["labels"], r["vectors"])
                # Both are sorted by label: only equal labels are multiplied.
                for label in np.intersect1d(own.labels, other.labels):
                    (a, b), (c, d) = (np.searchsorted(x.labels, [label, label + 1]) for x in (own, other))
                    some = Block(other.ids[c:d], other.labels[c:d], other.vectors[c:d])
                    step = max(1, SCORES // (d - c))
                    for begin in range(a, b, step):
                        end = min(begin + step, b)
                        scores = own.scores(some, begin, end)
                        ids = np.broadcast_to(some.ids, scores.shape)
                        other_row = ids != own.ids[begin:end, None]
                        # What lies below an anchor's k-th score cannot be among its first; ties stay.
                        if scores.shape[1] > positives + 1:
                            edge = np.partition(scores, -positives - 1, axis=1)[:, -positives - 1]
                            other_row &= scores >= edge[:, None]
                        at, col = np.nonzero(other_row)
                        kept = first_of_each(at, scores[at, col], some.ids[col], positives)
                        at, col = at[kept], col[kept]
                        yield pa.RecordBatch.from_arrays([pa.array(own.ids[begin + at]), pa.array(np.zeros(len(at), np.int32)), pa.array(scores[at, col]), pa.array(some.ids[col])], schema=FOUND)

    found_ddl = "anchor_id bigint, slot int, score bigint, vec_id bigint"
    order = [F.desc("score"), "vec_id"]
    alike = grid.select("a_ids", "a_labels", "a_vectors", "ids", "labels", "vectors").mapInArrow(nearest_alike, found_ddl)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))
    best = alike.withColumn("place", place).where(F.col("place") <= positives).drop("slot")
    # Slot s ends at the s-th greatest of an anchor's different limits.
    slot = F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"))) - 1
    limits = durable(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), slot.alias("slot")), "positives")
    per_anchor = limits.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), False).alias("limits"))
    # The limits travel with the anchors; anchors without positives need no second pass.
    with_limits = rows.where(anchor_filter).withColumnRenamed("vec_id", "anchor_id").join(per_anchor, "anchor_id")
    wanted = with_limits.select("anchor_id", "label", "v", F.concat("limits", F.array_repeat(F.element_at("limits", -1), F.lit(positives) - F.size("limits"))).alias("limits"))

    def pack_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                some = batch.slice(at, ANCHORS)
                columns = [np.asarray(some.column(0)), np.asarray(some.column(1)), np.asarray(some.column(2).flatten()).astype(np.int32), np.asarray(some.column(3).flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["ids", "labels", "vectors", "limits"])

    asked = durable(wanted.repartition(max(1, -(-wanted.count() // ANCHORS)), "anchor_id").mapInArrow(pack_limits, f"{BLOCK_DDL}, limits binary"), "limited-anchors")

    def in_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                own, other = Block.of(r["a_ids"], r["a_labels"], r["a_vectors"]), Block.of(r["ids"], r["labels"], r["vectors"])
                upper = np.frombuffer(r["limits"], np.int64).reshape(len(own.ids), -1)
                # A window reaches down to a share of its limit; nothing below the least limit's share is asked for.
                lowest = -(-upper[:, -1] * least_percent // 100)
                step = max(1, SCORES // max(1, len(other.ids)))
                for begin in range(0, len(own.ids), step):
                    end = min(begin + step, len(own.ids))
                    scores = own.scores(other, begin, end)
                    asked = (scores <= upper[begin:end, :1]) & (scores >= lowest[begin:end, None]) & (other.labels != own.labels[begin:end, None])
                    at, col = np.nonzero(asked)
                    score = scores[at, col]
                    # How many different limits are at least this score, less one; repeated last limits don't count.
                    slots = np.zeros(len(at), np.int64)
                    for k in range(1, upper.shape[1]):
                        above, here = upper[begin + at, k - 1], upper[begin + at, k]
                        slots += (score <= here) & (here < above)
                    kept = first_of_each(at * upper.shape[1] + slots, score, other.ids[col], negatives)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own.ids[begin + at[kept]]), pa.array(slots[kept].astype(np.int32)), pa.array(score[kept]), pa.array(other.ids[col[kept]]),
                    ], schema=FOUND)

    second = _grid(asked, blocks).select("a_ids", "a_labels", "a_vectors", "limits", "ids", "labels", "vectors").mapInArrow(in_slots, found_ddl)
    in_slot = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(*order))
    firsts = second.withColumn("place", in_slot).where(F.col("place") <= negatives)
    # At most negatives x positives rows of an anchor.
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id").alias("negative_id"), "slot")))
    slots = firsts.groupBy("anchor_id").agg(ordered.alias("found"))
    suffix = F.slice(F.filter("found", lambda f: f["slot"] >= F.col("slot")), 1, negatives)
    inside = F.filter(suffix, lambda f: -f["minus"] * 100 >= F.col("positive_score") * least_percent)
    answered = limits.join(slots, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "f"))
    return answered.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "f.negative_id", "positive_score", (-F.col("f.minus")).alias("negative_score"),
    )
