"""Packing of tokenized documents into sequences of a fixed length by swap-based local search.

Documents longer than a sequence are cut from behind, so that all pieces but the
first are full ones. Pieces below the full length are dealt out to chunks and
put into bins by best fit. Then a bin after the other, the fullest first, is
improved from all emptier ones: a piece moves over, one is exchanged for a
longer one, one for two, or two for one, as long as the sum of squared fills
increases; so the emptiest bins run dry. The least filled bins of all chunks
meet again in fewer chunks, until there is one.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm import byte_bpe
from wirebook.llm.common import durable, kept, ship, slices, strings

#: Pieces of a chunk on average, and bins that a chunk hands on to the next level.
CHUNK, HANDED_ON = 50_000, 64
#: Emptier bins that are looked through for two pieces in exchange for one.
LOOKED_THROUGH = 64
#: How byte-level tokenizers split a text, a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    """Ids of whole texts as the tokenizers library has them for a tokenizer file.

    Where the file is a byte-level BPE whose ids follow the order of its merges,
    they are ranks, and the faster matcher of ``byte_bpe`` finds the same ids;
    tests compare both. Texts that hold one of the added tokens, and tokenizers
    of another kind, go through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranked = _by_ranks(spec)

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.ranked.leaf(text), np.uint32)


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a visible Latin-1 byte as its character, and number the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


def _by_ranks(spec: dict) -> byte_bpe.Bpe | None:
    model, splits = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if spec["normalizer"] or not plain or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get("".join(m)) for m in merges]
    added = {t["content"] for t in spec["added_tokens"]}
    byte = _byte_of_character()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    if None in ids or ids != sorted(ids) or len(set(ids)) < len(ids) or len(ranks) != 256 + len(ids) or min(ids, default=256) < 256:
        return None
    return byte_bpe.Bpe.of_ranks(ranks, BYTE_LEVEL)


def encoder(path: str) -> TextEncoder:
    return kept("packing", (path,), lambda: TextEncoder(path))


# Packing of lengths

def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, longest pieces first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = rooms >> lengths[i]
        if fitting:
            room = lengths[i] + (fitting & -fitting).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = size, len(bins)
            bins.append([])
        bins[bin_].append(i)
        if room > lengths[i]:
            with_room[room - lengths[i]].append(bin_)
            rooms |= 1 << (room - lengths[i])
    return bins


class Swaps:
    """The local search over the bins that are not full."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.open = sorted((b for b, n in enumerate(self.fill) if n < size), key=lambda b: self.fill[b])
        self.where = {i: b for b in self.open for i in bins[b]}
        self.of_length: dict[int, set[int]] = defaultdict(set)
        self.have = 0  # a bit for each length that a bin of the pool holds
        for b in self.open:
            for i in bins[b]:
                self._offer(i)

    def _offer(self, i: int) -> None:
        self.of_length[self.lengths[i]].add(i)
        self.have |= 1 << self.lengths[i]

    def _withdraw(self, i: int) -> None:
        held = self.of_length[self.lengths[i]]
        held.discard(i)
        if not held:
            self.have &= ~(1 << self.lengths[i])

    def _take(self, target: int, i: int) -> None:
        """A piece of the pool goes to the target."""
        donor = self.where.pop(i)
        self._withdraw(i)
        self.bins[donor].remove(i)
        self.fill[donor] -= self.lengths[i]
        self.bins[target].append(i)
        self.fill[target] += self.lengths[i]

    def _give(self, target: int, i: int, donor: int) -> None:
        self.bins[target].remove(i)
        self.fill[target] -= self.lengths[i]
        self.bins[donor].append(i)
        self.fill[donor] += self.lengths[i]
        self.where[i] = donor
        self._offer(i)

    def _longest(self, low: int, high: int) -> int:
        """The longest length of the pool from ``low`` to ``high``, or 0."""
        found = (self.have & ((1 << (high + 1)) - 1)) >> low
        return low + found.bit_length() - 1 if found else 0

    def _some(self, length: int) -> int:
        return next(iter(self.of_length[length]))

    def move(self, target: int, room: int) -> bool:
        length = self._longest(1, room)
        if length:
            self._take(target, self._some(length))
        return bool(length)

    def exchange(self, target: int, room: int) -> bool:
        """One or two pieces for a longer one: the exchange that fills most."""
        own = {self.lengths[i]: i for i in self.bins[target]}
        given = [((i,), n) for n, i in own.items()]
        twice = {self.lengths[i]: i for i in self.bins[target] if own[self.lengths[i]] != i}
        given += [((i, j), n + m) for (n, i), (m, j) in itertools.combinations(own.items(), 2) if n + m < self.size]
        given += [((i, own[n]), 2 * n) for n, i in twice.items() if 2 * n < self.size]
        best = max(((self._longest(n + 1, min(n + room, self.size)) - n, pieces) for pieces, n in given), default=(0, ()))
        if best[0] <= 0:
            return False
        taken = self._some(sum(self.lengths[i] for i in best[1]) + best[0])
        donor = self.where[taken]
        self._take(target, taken)
        for i in best[1]:
            self._give(target, i, donor)
        return True

    def two_for_one(self, target: int, room: int, donors: list[int]) -> bool:
        own = {self.lengths[i]: i for i in self.bins[target]}
        for donor in donors:
            for i, j in itertools.combinations(self.bins[donor][:16], 2):
                both = self.lengths[i] + self.lengths[j]
                fitting = [n for n in own if n < both <= n + room]
                if fitting:
                    given = own[min(fitting)]
                    self._take(target, i)
                    self._take(target, j)
                    self._give(target, given, donor)
                    return True
        return False

    def run(self) -> list[list[int]]:
        # Every step fills the target further and empties a bin that holds no more than it.
        fullest = [(-self.fill[b], b) for b in self.open]
        heapq.heapify(fullest)
        waiting = dict.fromkeys(self.open)
        while fullest:
            fill, target = heapq.heappop(fullest)
            if -fill != self.fill[target]:  # it gave pieces away since
                if self.bins[target]:
                    heapq.heappush(fullest, (-self.fill[target], target))
                else:
                    del waiting[target]
                continue
            del waiting[target]
            for i in self.bins[target]:
                self._withdraw(i)
                del self.where[i]
            while (room := self.size - self.fill[target]) and (
                self.move(target, room) or self.exchange(target, room)
                or self.two_for_one(target, room, list(itertools.islice(waiting, LOOKED_THROUGH)))
            ):
                pass
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; no bin holds more than ``size``."""
    return Swaps(best_fit(lengths, size), lengths, size).run()


# The operator

def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, piece, start, length, ids``: every whole text encoded, closed by the end id, and cut from behind.

    ``key`` is unique. ``ids`` are little-endian unsigned 32-bit integers.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"key bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = strings(batch.column(1)).cast(pa.string())
            for begin, end in slices(texts):
                row, piece, start, length, raw = [], [], [], [], []
                for k, text in enumerate(texts.slice(begin, end - begin).to_pylist()):
                    own = np.append(encoder(tokenizer).encode(text), np.uint32(end_id)).astype("<u4")
                    first = len(own) % size or size
                    starts = [0, *range(first, len(own), size)]
                    row += [begin + k] * len(starts)
                    piece += range(len(starts))
                    start += starts
                    length += [first, *[size] * (len(starts) - 1)]
                    raw += [own[a : a + n].tobytes() for a, n in zip(starts, length[-len(starts) :], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(key, key + len(row))), batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()),
                ], ["key", "doc_id", "piece", "start", "length", "ids"])
                key += len(row)

    return rows.mapInArrow(cut, ddl)


def assign(lengths: DataFrame, size: int, *, chunk: int = CHUNK) -> DataFrame:
    """``key, sequence_id, offset`` of every row of ``key`` (unique), ``length`` (1 to ``size``).

    A sequence is named by the least key in it.
    """
    ship(lengths.sparkSession)

    def packed(last: bool):
        def pack(held: pd.DataFrame) -> pd.DataFrame:
            held = held.sort_values("key")
            keys, lengths = held["key"].tolist(), held["length"].tolist()
            bins = pack_lengths(lengths, size)
            fill = [sum(lengths[i] for i in b) for b in bins]
            emptiest = set() if last else set(sorted((b for b, n in enumerate(fill) if n < size), key=lambda b: fill[b])[:HANDED_ON])
            out = []
            for b, members in enumerate(bins):
                at, name = 0, min(keys[i] for i in members)
                for i in members:
                    out.append((keys[i], lengths[i], name, at, b in emptiest))
                    at += lengths[i]
            return pd.DataFrame(out, columns=["key", "length", "sequence_id", "offset", "handed_on"])

        return pack

    ddl = "key bigint, length bigint, sequence_id bigint, offset bigint, handed_on boolean"
    todo, done = lengths.select("key", "length"), None
    while True:
        chunks = max(1, -(-todo.count() // chunk))
        dealt = todo.groupBy(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"))
        level = durable(dealt.applyInPandas(packed(chunks == 1), ddl), "packed")
        settled = level.where("NOT handed_on").select("key", "sequence_id", "offset")
        done = settled if done is None else done.unionAll(settled)
        if chunks == 1:
            return done
        todo = level.where("handed_on").select("key", "length")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: all documents packed into sequences of ``size`` tokens at most.

    A null or empty text is its end id alone; equal rows are packed each for
    itself, null ids too. Only documents longer than a sequence are cut, into
    full pieces and a first one that may be shorter. Columns besides the two
    are not read, and no documents give no rows. Sequences have any numbers;
    offsets of a sequence leave no gap. Pieces of one length can stand for each
    other: which of them goes where is not defined.
    """
    cut = durable(pieces(docs, tokenizer, end_id, size, id_col=id_col, text_col=text_col), "pieces")
    placed = assign(cut.where(F.col("length") < size), size)
    whole = cut.where(F.col("length") == size).select("*", F.col("key").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    packed = cut.where(F.col("length") < size).join(placed, "key").unionByName(whole)
    return packed.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
