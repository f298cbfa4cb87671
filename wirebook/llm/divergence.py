"""Divergence of sources: how far the smoothed term frequencies of the sources of a language lie apart.

Single-pass in-memory indexing: every task counts the postings of its documents
in memory until a block is full, and then spills it as a run, sorted by term and
cut into slices by hash shard. In each shard a heap merges the runs' slices into
the frequencies of each term. The distance of two sources is that of their
frequencies of an unseen term, once for each term, plus corrections for the
terms that either has; those are summed up while the merged postings stream by.
"""

from __future__ import annotations

import bisect
import dataclasses
import heapq
import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import durable, release, ship, strings


@dataclasses.dataclass(frozen=True)
class Limits:
    """Bytes of text that are split at once, of postings that a task holds, and postings of a slice; postings that a
    merge holds before it takes what is complete; input splits whose postings meet in one shard, on average; sources of
    a tile of the table of pairs, and bytes of tiles that a task holds."""

    text_bytes: int = 2 << 20
    block_bytes: int = 16 << 20
    slice: int = 512
    merged: int = 100_000
    splits: int = 1
    tile: int = 256
    tile_bytes: int = 32 << 20


LIMITS = Limits()
#: Smoothing: a frequency is 1 + floor(SCALE * (count + PRIOR) / (all counts + PRIOR * terms)).
SCALE, PRIOR = 1_000_000_000, 5

RUN_DDL = "shard int, lang string, source string, first string, term array<string>, tf array<bigint>, df array<bigint>"
TERM_DDL = "key bigint, lang string, term string, sources array<string>, counts array<bigint>"

_BYTES = np.arange(256)
#: Letters of ASCII and all bytes beyond it make terms; only A to Z are lowered.
_OF_TERM = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def terms(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one after another in ``data``, and the text that each is from."""
    inside = _OF_TERM[data]
    before = np.concatenate([[False], inside[:-1]])
    begins_text = ends[:-1][ends[:-1] < len(data)]
    before[begins_text] = False
    begins = np.flatnonzero(inside & ~before)
    kept = _LOWERED[data[inside]]
    # A term's letters stand together, so they begin where the letters before it end.
    letters = np.concatenate([np.cumsum(inside)[begins] - 1, [len(kept)]]) if len(begins) else np.zeros(1, np.int64)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(letters.astype(np.int32)), pa.py_buffer(kept))
    return words, np.searchsorted(ends, begins, "right") - 1


def _runs_of_texts(offsets: np.ndarray, data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds) of runs of texts; a long text comes alone, in pieces that end where no term goes on."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        at, stop = int(offsets[begin]), int(offsets[end])
        if stop - at <= most:
            yield begin, data[at:stop], offsets[begin : end + 1] - at
        else:
            while at < stop:
                cut = min(at + most, stop)
                while cut < stop and _OF_TERM[data[cut]]:
                    cut += 1
                yield begin, data[at:cut], np.array([0, cut - at])
                at = cut
        begin = end


def _per_document(offsets: np.ndarray, data: np.ndarray, most: int) -> Iterator[pa.Table]:
    """``doc, term, tf`` of runs of documents, each document and term once."""
    held: list[pa.Table] = []
    last = -1
    for first, some, ends in _runs_of_texts(offsets, data, most):
        words, of_text = terms(some, ends)
        coded = words.dictionary_encode()
        pairs, tf = np.unique(of_text * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_counts=True)
        doc, code = np.divmod(pairs, max(1, len(coded.dictionary)))
        table = pa.table({"doc": pa.array(first + doc), "term": coded.dictionary.take(pa.array(code)), "tf": pa.array(tf.astype(np.int64))})
        if held and first != last:
            yield _summed(held)
            held = []
        held.append(table)
        last = first
    if held:
        yield _summed(held)


def _summed(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    return pa.concat_tables(tables).group_by(["doc", "term"], use_threads=False).aggregate([("tf", "sum")]).rename_columns(["doc", "term", "tf"])


def _compacted(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
    return whole.rename_columns(["group", "term", "tf", "df"])


def _spilled(block: pa.Table, groups: list[tuple[str, str]], shards: int, slice_: int) -> Iterator[pa.RecordBatch]:
    """A block's postings as a term-sorted run, in slices of one group and shard; a term's shard follows from its hash."""
    coded = block["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    term = rank[np.asarray(coded.indices)]
    of_word = np.fromiter((zlib.crc32(w.encode()) % shards for w in words.to_pylist()), np.int64, len(words))
    place = of_word[term] * len(groups) + np.asarray(block["group"])
    by = np.lexsort((term, place))
    place, term = place[by], term[by]
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    cuts = np.unique(np.concatenate([np.arange(a, b, slice_) for a, b in itertools.pairwise(bounds)] + [[len(place)]])).astype(np.int32)
    shard, group = np.divmod(place[cuts[:-1]], len(groups))
    lists = [pa.ListArray.from_arrays(pa.array(cuts), c) for c in (words.take(pa.array(term)), *(pa.array(np.asarray(block[name])[by]) for name in ("tf", "df")))]
    rows = pa.RecordBatch.from_arrays([
        pa.array(shard.astype(np.int32)), pa.array([groups[g][0] for g in group], pa.string()), pa.array([groups[g][1] for g in group], pa.string()),
        words.take(pa.array(term[cuts[:-1]])), *lists,
    ], ["shard", "lang", "source", "first", "term", "tf", "df"])
    for k in range(0, rows.num_rows, 1024):
        yield rows.slice(k, 1024)


def runs(docs: DataFrame, shards: int, limits: Limits = LIMITS) -> DataFrame:
    """Term-sorted runs of ``lang, source, text``. A document also counts for the empty term of its group, with no occurrence."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        number: dict[tuple[str, str], int] = {}
        size = 0
        for batch in batches:
            lang, source, text = (strings(batch.column(k)).cast(pa.string()) for k in range(3))
            group = np.array([number.setdefault(g, len(number)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int32)
            none = pa.array(np.zeros(len(np.unique(group)), np.int64))
            held.append(pa.table([pa.array(np.unique(group)), pa.array([""] * len(none), pa.string()), none, none], ["group", "term", "tf", "df"]))
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for counted in _per_document(offsets, data, limits.text_bytes):
                df = pa.array(np.ones(counted.num_rows, np.int64))
                held.append(_compacted([pa.table([pa.array(group[np.asarray(counted["doc"])]), counted["term"], counted["tf"], df], ["group", "term", "tf", "df"])]))
                size += held[-1].nbytes
                if size > limits.block_bytes:
                    held = [_compacted(held)]
                    size = held[0].nbytes
                    if size > limits.block_bytes // 2:
                        yield from _spilled(held[0], list(number), shards, limits.slice)
                        held, size = [], 0
        if held:
            yield from _spilled(_compacted(held), list(number), shards, limits.slice)
        held = []
        release()

    return docs.mapInArrow(index, RUN_DDL)


class Slice(NamedTuple):
    lang: str
    source: str
    term: pa.Array
    tf: pa.Array
    df: pa.Array

    def begin(self) -> tuple[str, str]:
        return self.lang, self.term[0].as_py()

    def cut(self, bound: tuple[str, str] | None) -> tuple[Slice, Slice]:
        """What is below the bound, and the rest."""
        n = len(self.term)
        if bound is not None and self.lang >= bound[0]:
            n = bisect.bisect_left(range(n), bound[1], key=lambda k: self.term[k].as_py()) if self.lang == bound[0] else 0
        return self._replace(term=self.term[:n], tf=self.tf[:n], df=self.df[:n]), self._replace(term=self.term[n:], tf=self.tf[n:], df=self.df[n:])


class Merge:
    """A heap of sorted slices, by their first terms that were not taken yet."""

    def __init__(self, least_docs: int):
        self.least_docs, self.heap, self.number, self.held = least_docs, [], 0, 0

    def add(self, postings: Slice) -> None:
        self._push(postings)
        self.held += len(postings.term)

    def _push(self, postings: Slice) -> None:
        heapq.heappush(self.heap, (postings.begin(), self.number, postings))
        self.number += 1

    def take(self, bound: tuple[str, str] | None) -> Iterator[tuple]:
        """``lang, term, sources, counts`` of the kept terms below ``bound``: no slice that comes later has more of them."""
        parts: dict[str, list[Slice]] = {}
        while self.heap and (bound is None or self.heap[0][0] < bound):
            below, rest = heapq.heappop(self.heap)[2].cut(bound)
            parts.setdefault(below.lang, []).append(below)
            self.held -= len(below.term)
            if len(rest.term):
                self._push(rest)
        for lang, slices in parts.items():
            coded = pa.concat_arrays([s.term for s in slices]).dictionary_encode()
            code = np.asarray(coded.indices)
            docs = np.bincount(code, np.concatenate([np.asarray(s.df) for s in slices]), len(coded.dictionary))
            enough = (docs >= self.least_docs) | np.asarray(pc.equal(coded.dictionary, ""))
            at = np.flatnonzero(enough[code])
            sources = [s.source for s in slices]
            source = np.repeat(np.arange(len(slices)), [len(s.term) for s in slices])[at]
            tf = np.concatenate([np.asarray(s.tf) for s in slices])[at]
            found: dict[str, dict[str, int]] = {}
            for term, k, n in zip(coded.dictionary.take(pa.array(code[at])).to_pylist(), source.tolist(), tf.tolist(), strict=True):
                counts = found.setdefault(term, {})
                counts[sources[k]] = counts.get(sources[k], 0) + n
            for term, counts in found.items():
                yield lang, term, list(counts), list(counts.values())


def merged(spilled: DataFrame, shards: int, least_docs: int, limits: Limits = LIMITS) -> DataFrame:
    """``key, lang, term, sources, counts`` of every term that enough documents of its language have.

    The row of the empty term has every source of the language.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = itertools.count(TaskContext.get().partitionId() << 40)
        heap, shard, most = Merge(least_docs), None, limits.merged
        for batch in batches:
            for k, (number, lang, source, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if number != shard:
                    yield from _terms(heap.take(None), keys)
                    shard = number
                if heap.held > most:
                    # Slices come in the order of their first terms: what is before this one's is complete.
                    yield from _terms(heap.take((lang, first)), keys)
                    # Slices that are mostly open are not cut again before as many have come.
                    most = max(limits.merged, 2 * heap.held)
                heap.add(Slice(lang, source, *(batch.column(c)[k].values for c in range(4, 7))))
        yield from _terms(heap.take(None), keys)
        release()

    ordered = spilled.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    return ordered.mapInArrow(merge, TERM_DDL)


def _terms(found: Iterator[tuple], keys: Iterator[int]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
    while rows := [(next(keys), *row) for row in itertools.islice(found, 10_000)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "lang", "term", "sources", "counts"])


def smoothed(count: Column, all_counts: Column, vocabulary: Column) -> Column:
    """The frequency of a term, in exact arithmetic."""
    above = F.lit(SCALE).cast("decimal(12,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", above, (all_counts + vocabulary * PRIOR).cast("decimal(20,0)")) + 1


def _sizes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, at, n, v, base) of every group, numbered in each language, and (lang, n_lang, v)."""
    exploded = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    groups = exploded.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = durable(found.groupBy("lang").agg(
        F.count_if(F.col("term") != "").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n_lang"),
    ), "languages")
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("v") > 0, smoothed(F.lit(0).cast("bigint"), F.col("n"), F.col("v"))).otherwise(F.lit(0).cast("bigint"))
    return durable(groups.join(langs, "lang").select("lang", "source", at.alias("at"), "n", "v", base.alias("base")), "groups"), langs


class Tile:
    """Sums of corrections for the pairs of sources of two blocks, over the terms that either of a pair has."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray):
        self.bases = (rows, columns)
        self.apart = np.abs(rows[:, None] - columns[None, :])
        self.sums = np.zeros((len(rows), len(columns)), np.int64)

    def add(self, p: tuple[np.ndarray, np.ndarray], has: tuple[np.ndarray, np.ndarray]) -> None:
        """Terms x sources of both blocks: frequencies, and whether the source has the term."""
        for a in range(len(self.bases[0])):
            own = has[0][:, a]
            self.sums[a] += np.abs(p[0][own, a : a + 1] - p[1][own]).sum(axis=0) - own.sum() * self.apart[a]
        for b in range(len(self.bases[1])):
            own = has[1][:, b]
            change = np.abs(p[1][own, b : b + 1] - self.bases[0]) - self.apart[:, b]
            self.sums[:, b] += np.where(has[0][own], 0, change).sum(axis=0)


def corrections(postings: DataFrame, groups: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``lang, a, b, value`` for pairs a < b of source numbers; ``postings`` are (key, lang, at, p)."""
    block = lambda at: F.call_function("div", at, F.lit(limits.tile)).cast("int")
    blocks = groups.groupBy("lang", block(F.col("at")).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "base"))), lambda g: g["base"]).alias("bases"))
    blocks = durable(blocks, "blocks")
    tiles = groups.groupBy("lang").agg((block(F.max("at")) + 1).alias("tiles"))
    own = block(F.col("at"))
    # A posting goes to every tile of its block's row and column.
    dealt = postings.join(tiles, "lang").select(
        "key", "lang", "at", "p", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))).alias("t"),
    )
    per_term = dealt.groupBy("key", "lang", "t.i", "t.j").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("postings"))
    sided = per_term.join(blocks.select("lang", F.col("block").alias("i"), F.col("bases").alias("rows")), ["lang", "i"]).join(
        blocks.select("lang", F.col("block").alias("j"), F.col("bases").alias("columns")), ["lang", "j"]
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], Tile] = {}
        for batch in batches:
            places = pa.table([batch.column(0), batch.column(1), batch.column(2)], ["lang", "i", "j"]).to_pylist()
            of_place: dict[tuple[str, int, int], list[int]] = {}
            for k, place in enumerate(places):
                of_place.setdefault((place["lang"], place["i"], place["j"]), []).append(k)
            for place, every in of_place.items():
                if place not in held:
                    if sum(t.sums.nbytes + t.apart.nbytes for t in held.values()) > limits.tile_bytes:
                        yield _partial(held, limits.tile)
                        held = {}
                    held[place] = Tile(*(np.asarray(batch.column(c)[every[0]].values) for c in (4, 5)))
                tile = held[place]
                step = max(1, (1 << 19) // len(tile.bases[1]))
                for at in range(0, len(every), step):
                    some = batch.column(3).take(pa.array(every[at : at + step]))
                    row = np.repeat(np.arange(len(some)), np.diff(np.asarray(some.offsets)))
                    number, p = (np.asarray(some.flatten().field(c)) for c in (0, 1))
                    sides, has = [], []
                    for own_block, bases in zip(place[1:], tile.bases, strict=True):
                        here = number // limits.tile == own_block
                        dense, with_term = np.tile(bases, (len(some), 1)), np.zeros((len(some), len(bases)), bool)
                        dense[row[here], number[here] % limits.tile] = p[here]
                        with_term[row[here], number[here] % limits.tile] = True
                        sides.append(dense)
                        has.append(with_term)
                    tile.add(tuple(sides), tuple(has))
        yield _partial(held, limits.tile)
        release()

    found = sided.select("lang", "i", "j", "postings", "rows", "columns").mapInArrow(stream, "lang string, a int, b int, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _partial(tiles: dict[tuple[str, int, int], Tile], size: int) -> pa.RecordBatch:
    langs, left, right, values = [], [], [], []
    for (lang, i, j), tile in tiles.items():
        a, b = np.indices(tile.sums.shape)
        a, b = a + i * size, b + j * size
        once = a < b
        langs += [lang] * int(once.sum())
        left.append(a[once])
        right.append(b[once])
        values.append(tile.sums[once])
    numbers = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (left, right, values)]
    return pa.RecordBatch.from_arrays([
        pa.array(langs, pa.string()), pa.array(numbers[0].astype(np.int32)), pa.array(numbers[1].astype(np.int32)), pa.array(numbers[2].astype(np.int64)),
    ], ["lang", "a", "b", "value"])


def audit(
    docs: DataFrame, *, least_docs: int = 30, top_terms: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    limits: Limits = LIMITS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` has for each group, a source of a language, every other
    source and the distance of their frequencies, summed over the language's
    kept terms: those that ``least_docs`` of its documents have. Part ``term``
    has the ``top_terms`` terms by which the group most exceeds its language.
    Greater values come first, ties in byte order of the item.

    A null language, source or text is an empty one; it is a group like others.
    Equal rows are documents of their own. A group without terms has pairs,
    with value 0 where its language keeps no term. Columns besides the three
    are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    splits = plain.select(F.spark_partition_id().alias("split")).distinct().count()
    shards = max(1, splits // limits.splits)
    found = durable(merged(durable(runs(plain, shards, limits), "runs"), shards, least_docs, limits), "terms")
    groups, langs = _sizes(found)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    each = found.where("term != ''").select("key", "lang", "term", total.alias("total"), F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    counted = each.select("key", "lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    placed = counted.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("count"), F.col("n"), F.col("v")))

    exceeding = placed.join(langs.select("lang", "n_lang"), "lang").withColumn("q", smoothed(F.col("total"), F.col("n_lang"), F.col("v"))).where("count > 0 AND p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = exceeding.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    side = lambda n: groups.select("lang", *[F.col(c).alias(f"{c}_{n}") for c in ("source", "at", "base")])
    # Every pair of a language's sources is asked for: the result itself.
    pairs = side("a").join(groups.select("lang", "v", *[F.col(c).alias(f"{c}_b") for c in ("source", "at", "base")]), "lang").where("at_a < at_b")
    changed = corrections(placed.select("key", "lang", "at", "p"), groups, limits).select("lang", F.col("a").alias("at_a"), F.col("b").alias("at_b"), "value")
    distance = F.col("v") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("value", F.lit(0))
    both = pairs.join(changed, ["lang", "at_a", "at_b"], "left").select("lang", distance.alias("value"), F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")),
    )).alias("s"))
    by_pair = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    return by_pair.unionByName(by_term)
