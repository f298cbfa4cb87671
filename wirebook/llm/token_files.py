"""Token ids in files: every document a zstandard frame of its own under one shared dictionary.

A token file is a folder of Parquet tables, so any file system that Spark
writes to can hold it and a lost task leaves nothing half written:

* ``segments``: a run of documents in ascending order of their id. ``blob``
  holds their frames one after another, ``ends`` (the offset index) where each
  frame ends, ``n_tokens`` the number of ids of each, ``start_in_part`` the
  ids of the part before the segment. ``dictionary`` is the hash of the shared
  dictionary, ``width`` the bytes of an id.
* ``parts``: for each part the ids of all parts before it.
* ``dictionary``: the dictionary and its hash.

A short document is read from one segment: its frame is cut out by the offset
index and decompressed alone.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.llm.common import ship, strings

SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 4096
SAMPLE_DOCS = 2000
SAMPLE_PIECE = 4096
SAMPLE_PIECES_OF_A_DOC = 8
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Words that a worker remembers; beyond this many it starts anew.
REMEMBERED_WORDS = 1_000_000

SEGMENT_SCHEMA = (
    "part int, segment int, start_in_part bigint, doc_ids array<bigint>, n_tokens array<bigint>, ends array<bigint>, "
    "blob binary, dictionary string, width int"
)


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its words one after another. It lowers case itself, so
    ASCII letters may be lowered first; a run of ``.`` and ``,`` between an
    ASCII letter and white space is a piece of its own for it, so it may be
    cut off. Texts with ``<|`` could name a special token, which it looks for
    before lowering: they are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.count, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def _room(array: np.ndarray, needed: int) -> np.ndarray:
        return array if needed <= len(array) else np.concatenate([array, np.zeros(max(needed - len(array), len(array)), array.dtype)])

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(count.sum())
            self.pool = self._room(self.pool, self.used + total)
            self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self.begin, self.count = self._room(self.begin, self.known + len(some)), self._room(self.count, self.known + len(some))
            self.begin[self.known : self.known + len(some)] = self.used + np.cumsum(count) - count
            self.count[self.known : self.known + len(some)] = count
            self.place.update(zip(some, range(self.known, self.known + len(some)), strict=True))
            self.known, self.used = self.known + len(some), self.used + total

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if self.known > REMEMBERED_WORDS:
            self.forget()
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, "", texts)
        cut = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,]+)(\s|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(cut)
        of_doc = np.diff(np.asarray(words.offsets))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.place]
        self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        place = place[np.asarray(coded.indices)]
        count = self.count[place]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.begin[place] - (ends - count), count) + np.arange(total)]
        doc_ends = np.concatenate([[0], ends])[np.cumsum(of_doc)]
        ids = np.split(flat, doc_ends[:-1]) if len(of_doc) else []
        for k in np.flatnonzero(np.asarray(special)):
            ids[k] = self.whole(texts[k].as_py())
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from at most SAMPLE_DOCS documents, those with the smallest hashes of their ids.

    Each gives at most SAMPLE_PIECES_OF_A_DOC evenly spread pieces of
    SAMPLE_PIECE bytes, so the driver gets 64 MB at most, whatever the corpus;
    rows that share an id give as many as one of them.
    Of too few samples no dictionary can be trained; then a plain byte table
    that holds every id once serves as the shared content.
    """
    key = F.xxhash64(id_col)
    ids = docs.select(id_col).dropna().orderBy(key, id_col).limit(SAMPLE_DOCS)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, doc, place = [], [], []
            for own, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(strings(batch.column(1))), strict=True):
                raw = np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()
                n = math.ceil(len(raw) / SAMPLE_PIECE)
                for at, k in enumerate(range(0, n, max(1, math.ceil(n / SAMPLE_PIECES_OF_A_DOC)))):
                    out.append(raw[k * SAMPLE_PIECE : (k + 1) * SAMPLE_PIECE])
                    doc.append(own)
                    place.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(out, pa.binary())], ["doc", "place", "piece"])

    chosen = docs.join(F.broadcast(ids.distinct()), id_col, "left_semi").select(F.col(id_col).cast("bigint"), text_col)
    # However many rows share an id, one piece of each place comes, put together before the shuffle.
    bounded = chosen.mapInArrow(pieces, "doc bigint, place int, piece binary").groupBy("doc", "place").agg(F.min("piece").alias("piece"))
    samples = sorted(bytes(r.piece) for r in bounded.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return np.arange(1 << 14, dtype=f"<u{width}").tobytes()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, *, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text and write the token file ``path``.

    Documents are dealt out by ranges of their id and sorted inside a range; a
    null id comes first, equal ids follow each other in any order, each with
    its own ids. A null text is an empty one: it has the end id alone. Columns
    besides the two are not read. No documents give an empty file. ``width``
    is 2 for vocabularies below 65,536 ids, else 4.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    content = train_dictionary(docs, "doc_id", "text", tokenizer, end_id, width)
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, content)], "dictionary string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content)).compress
        segment, before = 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames])
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": segment, "start_in_part": before, "doc_ids": ids, "n_tokens": counts, "ends": ends.tolist(), "blob": b"".join(frames), "dictionary": name, "width": width}],
                ROW,
            )

        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(strings(batch.column(1))), strict=True):
                frame = squeeze(np.append(tokens, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                ids.append(doc)
                counts.append(len(tokens) + 1)
                frames.append(frame)
                held += len(frame)
                if held >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield row()
                    segment, before = segment + 1, before + sum(counts)
                    ids, counts, frames, held = [], [], [], 0
        if ids:
            yield row()

    # Rows that share an id, as null ids do, may fill several ranges: the text's hash tells them apart.
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(pack, SEGMENT_SCHEMA).write.parquet(f"{path}/segments")
    # One row for each part: as many as shuffle partitions, whatever the corpus.
    own = F.max(F.struct("segment", (F.col("start_in_part") + F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")))
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments").groupBy("part").agg(own.alias("last")).select("part", "last.n").orderBy("part").collect()
    start, parts = 0, []
    for r in rows:
        parts.append((r["part"], start))
        start += r["n"]
    spark.createDataFrame(parts, "part int, start bigint").coalesce(1).write.parquet(f"{path}/parts")


ROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("blob", pa.binary()), ("dictionary", pa.string()), ("width", pa.int32()),
])


def _content(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["dictionary"]:
        raise ValueError(f"the dictionary of {path} is not the one it was written with")
    return content


def read_token_files(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ids as little-endian unsigned 32-bit integers, start the ids of all documents before.

    With ``doc_id`` only that document is decompressed. A file written with
    another dictionary than the folder's is refused.
    """
    ship(spark)
    content = _content(spark, path)
    name = hashlib.sha256(content).hexdigest()
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompress
        for batch in batches:
            for k in range(batch.num_rows):
                # A column at a time: the blob is never copied.
                ids, counts, ends = (batch.column(c)[k].values for c in ("doc_ids", "n_tokens", "ends"))
                if batch.column("dictionary")[k].as_py() != name:
                    raise ValueError("a segment names another dictionary")
                blob, width = memoryview(batch.column("blob")[k].as_buffer()), batch.column("width")[k].as_py()
                counts, ends = np.asarray(counts), np.asarray(ends)
                starts = batch.column("start")[k].as_py() + np.cumsum(counts) - counts
                wanted = range(len(ends)) if doc_id is None else [i for i, d in enumerate(ids.to_pylist()) if d == doc_id]
                for at in range(0, len(wanted), 512):
                    some = list(wanted[at : at + 512])
                    raw = [np.frombuffer(expand(blob[ends[i - 1] if i else 0 : ends[i]]), f"<u{width}").astype("<u4").tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some, pa.int64())), pa.array(starts[some], pa.int64()), pa.array(counts[some], pa.int64()), pa.array(raw, pa.binary())], schema=out)

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    if doc_id is not None:
        segments = segments.filter(F.array_contains("doc_ids", doc_id))
    parts = F.broadcast(spark.read.schema("part int, start bigint").parquet(f"{path}/parts"))
    placed = segments.join(parts, "part").withColumn("start", F.col("start") + F.col("start_in_part"))
    return placed.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
