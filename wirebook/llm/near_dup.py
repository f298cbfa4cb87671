"""Near-duplicate classes by improved consistent weighted sampling.

A text is a bag of five-word shingles, each weighing its count times its
inverse document frequency. Consistent weighted sampling draws shingles so that
two texts agree in a draw with the probability of their weighted Jaccard
similarity. Draws are banded; texts that agree in a band are compared exactly,
and the links give classes.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import durable, free_name, kept, release, ship, slices, strings

SHINGLE, LEAST = 5, 0.8
#: A pair of similarity 0.8 agrees in at least one of so many bands but for a chance of 0.00003, in two but for 0.0004.
BANDS, DRAWS = 20, 4
#: What remains mixed in a band is dealt out by the keys of the bands so many further.
ALSO = (1, 2, 4, 7)
#: Document frequencies up to this share of the documents weigh 1; at all documents a shingle weighs COMMON_WEIGHT.
RARE, COMMON_WEIGHT = 0.005, 0.35
#: Bytes that a word takes about; only the size of a counting table follows from it.
WORD_BYTES = 6
TABLE = 1 << 14
#: Shingles that are drawn from at once.
RUN = 512
#: Bits of each of a text's two bitmaps, of the shingles that weigh 1 and of the others.
BITS = 256
#: Places that are counted together in one row.
BLOCK = 256
#: Leading shingles before a leading one that are kept with it.
BEFORE = 4
#: Places in which the shingles of the texts that stay mixed are counted.
PLACES = 1 << 20
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts one after another, and where each text's end, with a leading 0.

    Words are lowered and lose punctuation at their edges; what is left empty
    is no word. A text of one to four words has one shingle, one without words
    none.
    """
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    ends = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(coded.dictionary, EDGE, "")
    own = pd.util.hash_array(bare.to_numpy(zero_copy_only=False), categorize=False) if len(bare) else np.zeros(0, np.uint64)
    there = np.asarray(pc.greater(pc.utf8_length(bare), 0))
    at = np.asarray(coded.indices)
    ends = np.concatenate([[0], np.cumsum(there[at])])[ends] if len(at) else np.zeros(len(texts) + 1, np.int64)
    hashes = own[at[there[at]]] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(ends)
    with np.errstate(over="ignore"):
        n = len(hashes)
        rolled = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, n)):
            rolled[: n - k] = rolled[: n - k] * _A + hashes[k:]
        rolled = _mixed(rolled)
        starts = np.ones(n, bool)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        for doc in short:
            whole = np.uint64(counts[doc])
            for x in hashes[ends[doc] : ends[doc + 1]]:
                whole = whole * _A + x
            rolled[ends[doc]] = _mixed(np.array([whole]))[0]
        # The last words of a text start no shingle, but a short text's first does.
        for k in range(1, SHINGLE):
            last = ends[1:] - k
            starts[last[(counts >= k) & ((counts >= SHINGLE) | (last > ends[:-1]))]] = False
    kept = np.concatenate([[0], np.cumsum(starts)])[ends]
    return rolled[starts], kept


def _shingles_of(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``shingles`` of runs of texts."""
    for batch in batches:
        texts = strings(batch.column(column))
        for begin, end in slices(texts):
            yield shingles(texts.slice(begin, end - begin))
    release()


@dataclasses.dataclass(frozen=True)
class Weights:
    """Weights of the shingles above RARE; all others weigh 1."""

    shingles: np.ndarray
    weights: np.ndarray

    def of(self, found: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.ones(len(found))
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        return np.where(self.shingles[at] == found, self.weights[at], 1.0)

    def bag(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, counts = np.unique(hashes, return_counts=True)
        return found, counts * self.of(found)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kept("near_dup", (), _made_tables)


def _made_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random variables of the draws: r and ln c of Gamma(2, 1), beta uniform.

    A shingle's come from three rows that different bits of its hash choose,
    the same in every worker.
    """
    draw, shape = np.random.default_rng(11), (TABLE, BANDS * DRAWS)
    return draw.gamma(2, 1, shape).astype(np.float32), np.log(draw.gamma(2, 1, shape)).astype(np.float32), draw.random(shape, np.float32)


def draws(found: np.ndarray, weights: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle and the t of each draw of a bag that isn't empty.

    With w a weight, t = floor(ln w / r + beta) and ln y = r (t - beta), the
    draw is the shingle of the least ln a = ln c - ln y - r, together with t.
    Most shingles weigh 1, and their t is 0. ``room`` is worked in, so many
    shingles at once as it has.
    """
    r_of, c_of, beta_of = _tables()
    logs = np.log(weights).astype(np.float32)
    rows = [((found >> np.uint64(bits)) & np.uint64(TABLE - 1)).astype(np.int64) for bits in (0, 14, 28)]
    best, first = np.full(BANDS * DRAWS, np.inf, np.float32), np.zeros(BANDS * DRAWS, np.int64)
    for at in range(0, len(found), room.shape[1]):
        some = slice(at, at + room.shape[1])
        r, c, a = room[:, : len(found[some])]
        for table, of, to in zip((r_of, c_of, beta_of), rows, (r, c, a), strict=True):
            np.take(table, of[some], axis=0, out=to, mode="clip")  # into room as it is; no number is beyond the table
        other = np.flatnonzero(logs[some])
        if len(other):
            own, beta = r[other], a[other]
            t = np.floor(logs[some][other][:, None] / own + beta)
            others = c[other] - own * (t - beta) - own
        a *= r
        a += c
        a -= r
        if len(other):
            a[other] = others
        least = a.min(axis=0)
        better = least < best
        best = np.minimum(least, best)
        row, column = np.divmod(np.flatnonzero(a == best), a.shape[1])
        new = np.flatnonzero(better[column])[::-1]  # of equal ones the first stays
        first[column[new]] = at + row[new]
    r_of, beta_of = [table[of[first], np.arange(len(first))] for table, of in ((r_of, rows[0]), (beta_of, rows[2]))]
    return found[first], np.floor(logs[first] / r_of + beta_of)


def bands(bags: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One key for each band of every bag, none of which is empty, as rows."""
    room = np.empty((3, RUN, BANDS * DRAWS), np.float32)
    told = [draws(found, weights, room) for found, weights in bags]
    drawn = np.array([d for d, _ in told], np.uint64).reshape(-1, BANDS, DRAWS)
    level = np.array([t for _, t in told], np.float32).reshape(-1, BANDS, DRAWS)
    with np.errstate(over="ignore"):
        drawn = _mixed(drawn * _A + level.astype(np.int64).astype(np.uint64))
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(DRAWS):
            keys = _mixed(keys * _A + drawn[:, :, k])
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two bags, or the plain one of their sets where that is larger.

    Weights make many slightly different copies of one text less similar to
    each other than their words are: what they share is frequent.
    """
    (x, u), (y, v) = a, b
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    both = y[at] == x if len(y) else np.zeros(len(x), bool)
    least = np.minimum(u[both], v[at[both]]).sum()
    total, united = u.sum() + v.sum() - least, len(x) + len(y) - both.sum()
    return max(float(least / total), float(both.sum() / united)) if united else 0.0


def _of_each_text(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The shingles of a run of texts, each once for each text that has it."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new]


def _place_of(hashes: np.ndarray, places: int) -> np.ndarray:
    return (hashes & np.uint64(places - 1)).astype(np.int64)


def crowded(texts: DataFrame, text_col: str, places: int, above: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of a table to which more than so many shingles fall, repeats counted, and how many do."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block of places and task."""
        counts = np.zeros(places, np.int64)
        for hashes, _ in _shingles_of(batches, 0):
            counts += np.bincount(_place_of(hashes, places), minlength=places)
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(some), 1 << 10):
            own = some[at : at + (1 << 10)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([blocks[k].tobytes() for k in own], pa.binary())], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The crowded places of the blocks that a task has."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                held[block] = held[block] + own if block in held else own
        for block, counts in held.items():
            at = np.flatnonzero(counts > above)
            yield pa.RecordBatch.from_arrays([pa.array((block * BLOCK + at).astype(np.int32)), pa.array(counts[at])], ["place", "n"])

    blocks = texts.select(text_col).mapInArrow(placed, "block int, counts binary").repartition("block")
    rows = blocks.mapInArrow(added, "place int, n bigint").collect()
    return np.array([r["place"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def common_weights(texts: DataFrame, text_col: str) -> Weights:
    """Weights of shingles by the share of the documents that have them, counted over all documents.

    First all shingles are counted in a table of fewer places than there are
    shingles; one above RARE has a place that is above RARE too. Only shingles
    of such places are then counted by themselves. They are at most as many as
    RARE allows of a text's mean number of shingles, and those that share their places.
    """
    total, size = texts.filter(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    if not total:
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    least = max(RARE * total, 1)  # what one document has is not common
    # On average a place then holds an eighth of what makes a shingle common.
    places = 1 << int(np.clip(np.ceil(np.log2(max(1, 8 * size / (WORD_BYTES * total) / RARE))), 16, 24))
    full = np.zeros(places, bool)
    full[crowded(texts, text_col, places, least)[0]] = True

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few rows for each shingle of a full place and task."""
        held, size = [], 0

        def told() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

        for hashes, ends in _shingles_of(batches, 0):
            there = full[_place_of(hashes, places)]
            held.append(_of_each_text(hashes[there], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[there]))
            size += len(held[-1])
            if size >= 1 << 21:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    rows = texts.select(text_col).mapInArrow(counted, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    found, df = np.array([r["s"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.float64)
    order = np.argsort(found)
    idf = np.log(total / df) / np.log(1 / RARE)
    return Weights(found[order], np.maximum(COMMON_WEIGHT, idf)[order])


def connected(links: DataFrame) -> DataFrame:
    """``node, least``: for every end of a link ``a, b`` the least node that links lead to.

    Each round every node takes the least of itself and its neighbours, and
    links then join what was taken; at least half of the nodes that still have
    links go each round.
    """
    links = durable(links.select("a", "b").distinct(), "links")
    names = durable(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("least", F.col("node")), "names")
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = durable(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")), "taken")
        names = durable(names.join(taken.withColumnRenamed("a", "least"), "least", "left").select("node", F.coalesce("to", "least").alias("least")), "names")
        moved = links.join(taken.select("a", F.col("to").alias("x")), "a").join(taken.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = durable(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return names


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, class_id, class_key`` for every row: its class, named by its least doc_id.

    Two different texts are linked if they agree in bands and are 0.8 similar
    or more; linked texts, and rows of equal texts, are one class. A bucket's
    texts are first compared with its least one only. Where a bucket then still
    holds several classes, its texts are dealt out once more by their key in
    another band, and compared with the least, the greatest and the next of
    those that agree there too. Of the texts of buckets that are mixed even then, all pairs of
    two classes that can be similar enough are compared (``possible_pairs``), so that no link is left out.
    Copies, which are of one class by then, are not paired. ``class_key`` is the text key that the class's least row has.

    Equal texts without a word are one class, and no other text links to them.
    A null text is a class of its own with its doc_id (null keys). The least
    doc_id of a class is the least that is not null. Repeated rows stay, each
    with its class; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    texts = rows.filter(F.col("text").isNotNull())
    weights = common_weights(texts, "text")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for hashes, ends in _shingles_of([batch], 2):
                keys.append(bands(weights.bag(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a))
                counts.append(BANDS * (np.diff(ends) > 0))
            offsets = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
            of_each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([k.ravel() for k in keys]) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), of_each], ["node", "doc_id", "keys"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketched = texts.select("node", "doc_id", "text").mapInArrow(drawn, f"node binary, doc_id {id_type}, keys array<bigint>")
    nodes = durable(sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "nodes")
    placed = nodes.select("node", "keys", F.posexplode("keys").alias("band", "key"))
    others = [F.element_at("keys", (F.col("band") + step) % BANDS + 1).alias(f"key{step}") for step in ALSO]
    placed = placed.select("node", "band", "key", *others)
    leaders = placed.groupBy("band", "key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader != last")
    members = durable(placed.join(leaders.select("band", "key", "leader"), ["band", "key"]), "members")

    first = durable(members.filter("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    some = texts.join(wanted.select(F.col("node").alias("n"), F.col("doc_id").alias("d")), (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("node") == F.col("n"))).select("node", "text")
    bodies = durable(some.dropDuplicates(["node"]), "bodies")
    links = durable(_verified(first, bodies, weights), "links")
    classes = connected(links)
    class_of = F.coalesce("least", "node").alias("c")
    apart = durable(members.join(classes, "node", "left").select("band", "key", "node", class_of, *[f"key{step}" for step in ALSO]), "apart")
    mixed = apart.groupBy("band", "key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("band", "key")
    again = F.inline(F.array(*[F.struct(F.lit(step).alias("step"), F.col(f"key{step}").alias("other")) for step in ALSO]))
    agree = ["band", "key", "step", "other"]
    open_ones = durable(apart.join(mixed, ["band", "key"]).select("band", "key", "node", "c", again), "open")
    ends = open_ones.groupBy(*agree).agg(F.min(F.struct("node", "c")).alias("lo"), F.max(F.struct("node", "c")).alias("hi"), F.min("c").alias("x"), F.max("c").alias("y"))
    near = open_ones.join(ends.filter("x != y"), agree)
    met = [near.filter(f"c != {end}.c").select(F.least("node", f"{end}.node").alias("a"), F.greatest("node", f"{end}.node").alias("b")) for end in ("lo", "hi")]
    beside = Window.partitionBy(*agree).orderBy("node")
    chain = near.withColumns({"before": F.lag("node").over(beside), "c_before": F.lag("c").over(beside)}).filter("c != c_before")
    met.append(chain.select(F.col("before").alias("a"), F.col("node").alias("b")))
    second = durable(functools.reduce(DataFrame.union, met).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = durable(_verified(second, bodies, weights), "links")
    if not more.isEmpty():
        links = links.union(more)
        classes = connected(links)
    # What is still mixed: every pair that can be similar enough, and that wasn't compared.
    placed_in = durable(open_ones.select("band", "key", "node").distinct().join(classes, "node", "left").select("band", "key", "node", class_of), "apart")
    still = placed_in.groupBy("band", "key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("band", "key")
    rest = durable(placed_in.join(still, ["band", "key"]).select("node", "c").distinct(), "rest")
    if not rest.isEmpty():
        left = possible_pairs(rest, bodies, weights).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
        last = durable(_verified(durable(left, "pairs"), bodies, weights), "links")
        classes = connected(links.union(last)) if not last.isEmpty() else classes

    named = nodes.join(classes, "node", "left").select("node", "doc_id", F.coalesce("least", "node").alias("c"))
    least = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m")).select("c", F.col("m.doc_id").alias("class_id"), F.col("m.node").alias("class_key"))
    told = named.join(least, "c").select("node", "class_id", "class_key")
    joined = rows.select("doc_id", "node").join(told, "node", "left")
    return joined.select("doc_id", F.col("node").alias("text_key"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key")


@dataclasses.dataclass(frozen=True)
class Crowd:
    """How crowded the places are to which shingles fall: the binary logarithm of their counts, 0 where they are few."""

    level: np.ndarray

    def of(self, found: np.ndarray) -> np.ndarray:
        return self.level[_place_of(found, len(self.level))]


def leading(found: np.ndarray, weights: np.ndarray, own: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """So many places of a bag's shingles, rarest first, that the others weigh
    and count less than LEAST of it, and what the shingles weigh from each on.

    ``weights`` are with counts; ``own``, those of the shingles, and ``crowd``
    give the order, which is the same for all bags.
    """
    order = np.lexsort((found, crowd, -own))
    behind = np.cumsum(weights[order][::-1])[::-1]
    many = max(int((behind >= LEAST * (1 - 1e-9) * weights.sum()).sum()), int(np.floor(len(found) * (1 - LEAST) + 1e-9)) + 1)
    return order[:many], behind[:many]


def bitmaps(found: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Two bitmaps of a set, of shingles that weigh 1 and of the others, as BITS / 64 numbers each.

    A bit tells whether the shingles that fall to it are odd in number, so two
    sets differ in at least as many shingles as their bitmaps do in bits.
    """
    at = ((found >> np.uint64(40)) & np.uint64(BITS - 1)).astype(np.int64) + BITS * (own < 1)
    return np.packbits(np.bincount(at, minlength=2 * BITS).astype(np.uint8) & 1).view(np.int64)


def possible_pairs(nodes: DataFrame, bodies: DataFrame, weights: Weights) -> DataFrame:
    """``a, b`` of all pairs of ``nodes`` (node, c) of two classes that can be LEAST similar.

    Of two bags that together count or weigh so much, LEAST / (1 + LEAST) of it
    must be in both, and no more than (1 - LEAST) / (1 + LEAST) may be in one
    only. What both have is at most what either has from their first shared
    shingle on, and what one has alone is at least what their bitmaps tell. A
    shingle is not their first if both have one of the few before it too.
    Shingles are in order of their rarity, so frequent ones are behind.
    """
    size = nodes.join(bodies, "node").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    level = np.zeros(PLACES, np.int8)
    place, n = crowded(nodes.join(bodies, "node").select("text"), "text", PLACES, max(4, 4 * size / WORD_BYTES / PLACES))
    level[place] = np.log2(n).astype(np.int8)
    crowd, lightest = Crowd(level), float(weights.weights.min(initial=1.0))
    words = 2 * BITS // 64

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hashes, ends in _shingles_of([batch], 2):
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    found, weight = weights.bag(hashes[a:b])
                    own = weights.of(found)
                    at, behind = leading(found, weight, own, crowd.of(found))
                    lead = found[at].view(np.int64)
                    before = [lead[max(0, k - BEFORE) : k] for k in range(len(lead))]
                    out.append((lead, behind, len(found) - np.arange(len(at)), float(weight.sum()), len(found), bitmaps(found, own), before))
            of = pa.array(np.repeat(np.arange(len(out)), [len(o[0]) for o in out]))
            each = [pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0), t) for k, t in ((0, pa.int64()), (1, pa.float64()), (2, pa.int64()))]
            rows = [batch.column("node"), batch.column("c"), pa.array([o[3] for o in out], pa.float64()), pa.array([o[4] for o in out], pa.int64())]
            rows += [pa.array([o[5][k] for o in out], pa.int64()) for k in range(words)]
            each.append(pa.array([x for o in out for x in o[6]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*each, *[r.take(of) for r in rows]], ["s", "rw", "rn", "before", "node", "c", "w", "n", *[f"b{k}" for k in range(words)]])

    ddl = "s bigint, rw double, rn bigint, before array<bigint>, node binary, c binary, w double, n bigint" + "".join(f", b{k} bigint" for k in range(words))
    led = durable(nodes.join(bodies, "node").select("node", "c", "text").mapInArrow(leads, ddl), "leading")
    mixed = led.groupBy("s").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("s")
    led = led.join(mixed, "s")
    other = led.select("s", *[F.col(c).alias(f"{c}2") for c in led.columns if c != "s"])
    differ = [functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}2"))) for k in half]) for half in (range(words // 2), range(words // 2, words))]
    can = lambda total, shared, alone: (shared >= LEAST / (1 + LEAST) * (1 - 1e-9) * total) & (alone <= (1 - LEAST) / (1 + LEAST) * (1 + 1e-9) * total)
    counted = can(F.col("n") + F.col("n2"), F.least("rn", "rn2"), differ[0] + differ[1])
    weighed = can(F.col("w") + F.col("w2"), F.least("rw", "rw2"), differ[0] + F.lit(lightest) * differ[1])
    pairs = led.join(other, "s").filter("node < node2 AND c != c2").filter(counted | weighed).filter(~F.arrays_overlap("before", "before2"))
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, weights: Weights) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                bags = {}
                for name, column in ((a, "ta"), (b, "tb")):
                    fresh = [k for k, key in enumerate(name) if key not in known and key not in bags]
                    hashes, ends = shingles(strings(batch.column(column).take(pa.array(fresh, pa.int64()))))
                    for i, k in enumerate(fresh):
                        bags[name[k]] = weights.bag(hashes[ends[i] : ends[i + 1]])
                known = {key: known[key] if key in known else bags[key] for key in {*a, *b}}  # the last slice's: a leader's pairs follow each other
                alike = np.array([similarity(known[x], known[y]) >= LEAST for x, y in zip(a, b, strict=True)], bool)
                yield batch.select(["a", "b"]).filter(pa.array(alike))
        release()

    with_b = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each class one row, that of the least doc_id.

    Null texts all stay. Of repeated rows with the least id and its text any
    one stays. Columns are those of ``docs``.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).filter(F.col("text_key").isNotNull())
    keep = durable(found.groupBy("class_key").agg(F.min("class_id").alias("class_id")), "keep")
    k, d = free_name(docs, "_key"), free_name(docs, "_id")
    keyed = docs.withColumn(k, F.unhex(F.md5(F.col(f"`{text_col}`"))))
    told = keep.select(F.col("class_key").alias(k), F.col("class_id").alias(d))
    kept = keyed.filter(F.col(k).isNotNull()).join(told, k).filter(F.col(d).eqNullSafe(F.col(f"`{id_col}`"))).dropDuplicates([k]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter(F.col(f"`{text_col}`").isNull()))
