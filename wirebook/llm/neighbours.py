"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is then sent down every tree
to a leaf. A query searches all trees at once through one priority queue of
branches, ordered by how far it lies beyond their hyperplanes, until the leaves
it has taken hold enough vectors. What those leaves hold is ranked exactly. How
many are enough is measured on the table itself: the exact neighbours of a
sample of the queries tell how far the queue has to be followed.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import durable, ship, unit_hash

#: Rows that trees are fitted on at most on average, trees, and sampled rows of a leaf at most.
FIT_ROWS, TREES, LEAF = 20_000, 12, 40
#: A query takes leaves until they hold so many vectors at least, counted in each tree.
CANDIDATES = 6000
#: Queries whose exact neighbours are found, and the share of those that the leaves must hold: then more candidates are taken.
MEASURED, RECALL = 64, 0.95
#: Vectors of a leaf that are ranked together, and queries; larger leaves are dealt out.
BLOCK = 20_000


@dataclasses.dataclass(frozen=True)
class Tree:
    """Inner nodes: a normal, an offset and two children, negative for leaves (-1 - number)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), 0 if len(self.normals) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", vectors[inner], self.normals[node]) > self.offsets[node]).astype(int)
            at[inner] = self.children[node, side]
        return -1 - at


def grow(sample: np.ndarray, seed: int) -> Tree:
    """Split at the middle of two random points' projections, or at the median where that puts all on one side."""
    draw = np.random.default_rng(seed)
    normals, offsets, children, leaf = [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, parent = todo.pop()
        number = None
        if len(rows) > LEAF:
            for _ in range(4):
                a, b = sample[draw.choice(rows, 2, replace=False)]
                normal = b - a
                if np.any(normal):
                    along = sample[rows] @ normal
                    cut = float(normal @ (a + b) / 2)
                    if not 0.05 < (along > cut).mean() < 0.95:
                        cut = float(np.median(along))
                    right = along > cut
                    if right.any() and not right.all():
                        number = len(normals)
                        normals.append(normal)
                        offsets.append(cut)
                        children.append([0, 0])
                        todo += [(rows[~right], (number, 0)), (rows[right], (number, 1))]
                        break
        if number is None:
            number, leaf = -1 - leaf, leaf + 1
        if parent is not None:
            children[parent[0]][parent[1]] = number
    shape = (len(normals), sample.shape[1])
    return Tree(np.array(normals, np.float64).reshape(shape), np.array(offsets, np.float64), np.array(children, np.int64).reshape(-1, 2))


def taken(forest: list[Tree], sizes: dict[tuple[int, int], int], query: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The leaves (tree, leaf) in the order in which a query takes them, best branch of any tree first, and how much all so far hold."""
    queue = [(-np.inf, tree, 0 if len(t.normals) else -1) for tree, t in enumerate(forest)]
    heapq.heapify(queue)
    margins = [t.normals @ query - t.offsets for t in forest]
    held = 0
    while queue:
        worst, tree, node = heapq.heappop(queue)
        if node < 0:
            held += sizes.get((tree, -1 - node), 0)
            yield tree, -1 - node, held
            continue
        norm = forest[tree].normals[node]
        margin = margins[tree][node] / np.sqrt(norm @ norm)
        for side, away in ((0, margin), (1, -margin)):
            heapq.heappush(queue, (max(worst, away), tree, int(forest[tree].children[node, side])))


def probes(forest: list[Tree], sizes: dict[tuple[int, int], int], query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """The leaves that a query takes until they hold as many vectors as wanted."""
    out = []
    for tree, leaf, held in taken(forest, sizes, query):
        out.append((tree, leaf))
        if held >= wanted:
            break
    return out


def needed(forest: list[Tree], sizes: dict[tuple[int, int], int], query: np.ndarray, near: np.ndarray) -> list[int]:
    """For each of the vectors ``near`` what the leaves hold once one of them has it."""
    missing = list(range(len(near)))
    places = np.stack([t.leaves(near) for t in forest]) if len(near) else np.zeros((len(forest), 0), int)
    out = [0] * len(near)
    for tree, leaf, held in taken(forest, sizes, query):
        for i in [i for i in missing if places[tree, i] == leaf]:
            out[i] = held
            missing.remove(i)
        if not missing:
            break
    return out


def enough(classes: DataFrame, queries: DataFrame, forest: list[Tree], sizes: dict[tuple[int, int], int], k: int) -> int:
    """What the leaves have to hold so that RECALL of the exact neighbours of MEASURED queries, those of the smallest hashes, are among it."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).select("v").toPandas()
    if not len(sample):
        return 0
    asked = np.array(sample["v"].tolist(), np.float64)

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 vectors of each batch nearest to each query."""
        for batch in batches:
            raw = batch.column(0)
            vectors = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
            for number, query in enumerate(asked):
                distance = ((vectors - query) ** 2).sum(axis=1)
                near = np.argpartition(distance, k)[: k + 1] if len(distance) > k + 1 else np.arange(len(distance))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), number, np.int32)), pa.array(distance[near]), raw.take(pa.array(near))], ["q", "distance", "raw"])

    found = classes.select("raw").mapInArrow(closest, "q int, distance double, raw binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "raw"))
    rows = found.withColumn("place", place).filter(F.col("place") <= k + 1).select("q", "distance", "raw").collect()
    reached: list[int] = []
    for number, query in enumerate(asked):
        own = [np.frombuffer(r["raw"], np.float64) for r in rows if r["q"] == number and r["distance"] > 0][:k]
        reached += needed(forest, sizes, query, np.array(own).reshape(len(own), len(query)))
    return int(np.sort(reached)[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) if reached else 0


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(table: DataFrame, query_filter: str, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows found for each query row, by Euclidean distance.

    ``query_filter`` is a SQL condition on ``vec_id``. Vectors that are null,
    empty, zero, of another length than most or with null or non-finite
    components take no part, and rows without an id neither; an id that comes
    more than once counts with its least vector. Ties go to the smaller id. Of
    rows with equal vectors only the k + 1 smallest ids can be among a query's
    k nearest, so only these are kept, in each task and then in all, with
    equal results. A query finds all others where there are k or fewer.
    """
    ship(table.sparkSession)
    plain = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = plain.filter(F.coalesce(sound, F.lit(False)))
    lengths = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    once = valid.filter(F.size("v") == length).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = durable(once, "vectors")
    count = rows.count()
    sample = rows.filter(unit_hash(F.lit("forest"), "vec_id") < min(1.0, FIT_ROWS / max(1, count))).orderBy("vec_id").toPandas()
    points = np.unique(np.array(sample["v"].tolist(), np.float64).reshape(len(sample), length), axis=0) if length else np.zeros((0, 1))
    forest = [grow(points, seed) for seed in range(TREES)]

    # Equal vectors: the k + 1 smallest ids of each task, then of all.
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec, raw in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) + 0.0, strict=True):
                ids = held.setdefault(raw.tobytes(), [])
                heapq.heappush(ids, -vec)
                if len(ids) > k + 1:
                    heapq.heappop(ids)
            if len(held) > 50_000:
                yield packed(held)
                held = {}
        yield packed(held)

    def packed(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted(-i for i in ids) for ids in held.values()], pa.list_(pa.int64())), pa.array(list(held), pa.binary())], ["ids", "raw"])

    partial = rows.select("vec_id", "v").mapInArrow(smallest, "ids array<bigint>, raw binary")
    merged = partial.groupBy("raw").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    classes = durable(merged, "vector_classes")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0)
            vectors = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
            for number, tree in enumerate(forest):
                leaves = tree.leaves(vectors)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), number, np.int32)), pa.array(leaves.astype(np.int32)), raw, batch.column(1)], ["tree", "leaf", "raw", "ids"])

    index = classes.select("raw", "ids").mapInArrow(routed, "tree int, leaf int, raw binary, ids array<bigint>")
    counted = index.groupBy("tree", "leaf").count().collect()  # as many rows as leaves: bounded by the sample
    sizes = {(r["tree"], r["leaf"]): r["count"] for r in counted}
    parts = {key: max(1, -(-n // BLOCK)) for key, n in sizes.items()}
    wanted = max(CANDIDATES, enough(classes, rows.filter(query_filter), forest, sizes, k))
    lots = max(1, -(-rows.filter(query_filter).count() // BLOCK))  # no part of a leaf meets more queries than BLOCK, on average

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, raw in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) + 0.0, strict=True):
                for tree, leaf in probes(forest, sizes, raw, wanted):
                    out += [(query, raw.tobytes(), tree, leaf, part) for part in range(parts.get((tree, leaf), 0))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["query_id", "q", "tree", "leaf", "part"])

    asked = rows.filter(query_filter).select("vec_id", "v").mapInArrow(search, "query_id bigint, q binary, tree int, leaf int, part int")
    many = {key: n for key, n in parts.items() if n > 1}
    split = F.lit(0)
    if many:
        of = F.create_map(*[F.lit(x) for key, n in many.items() for x in (f"{key[0]}-{key[1]}", n)])
        split = F.pmod(F.xxhash64("raw"), F.coalesce(F.element_at(of, F.concat_ws("-", "tree", "leaf")), F.lit(1))).cast("int")
    dealt = index.withColumn("part", split).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int"))

    def rank(key, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one leaf's part for each query; copies beyond what a query needs were left out before."""
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(held):
            vectors = np.frombuffer(b"".join(held["raw"]), np.float64).reshape(len(held), -1)
            ids = [np.asarray(x) for x in held["ids"]]
            for query, raw in zip(queries["query_id"], queries["q"], strict=True):
                distance = np.sqrt(((vectors - np.frombuffer(raw, np.float64)) ** 2).sum(axis=1))
                near = np.argsort(distance, kind="stable")[: k + 1] if len(distance) <= k + 1 else np.flatnonzero(distance <= np.partition(distance, k)[k])
                found = sorted((distance[i], vec) for i in near for vec in ids[i].tolist() if vec != query)[:k]
                out["query_id"] += [query] * len(found)
                out["score"] += [d for d, _ in found]
                out["vec_id"] += [v for _, v in found]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["tree", "leaf", "part", "lot"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
