"""Byte-level BPE of whole texts as a tree reduction.

An element is a stretch of text with its ids. Two neighbours are joined by
encoding a window around their seam anew. The window grows to the left and to
the right, doubling, until it begins and ends where the splitting pattern
always ends a match: between a character that is not white space and one that
is. No alternative of the pattern has white space after another character, and
none looks back, so such a place ends a match whatever stands around it: ids
outside of the window can not change. Without such a place in a side the
window takes in that side wholly. So the join is exact and associative, and
the tree's shape can't change the ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.common import kept, release, ship, slices, strings

#: Characters of a leaf, and the window that is tried first.
LEAF = 8192
WINDOW = 64
#: A longer run of white space is cut off as the match that it is: the library's matcher runs out of stack in one.
LONG_RUN = 100_000
# The White_Space property, fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLACE = re.compile(f"[^{SPACE}][{SPACE}]")
RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self._load({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Bpe:
        bpe = cls.__new__(cls)
        bpe._load(ranks, pattern)
        return bpe

    def _load(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def leaf(self, text: str) -> array:
        """A long run of white space before another character leaves its last character to the next match."""
        at, out = 0, array("I")
        for run in RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            out.extend(self.coder.encode_ordinary(text[at : run.start()]))
            out.extend(self.coder._encode_single_piece(text[run.start() : end]))
            at = end
        out.extend(self.coder.encode_ordinary(text[at:] if at else text))
        return out

    def join(self, left: tuple[str, array], right: tuple[str, array]) -> tuple[str, array]:
        (a, a_ids), (b, b_ids) = left, right
        begin, width = 0, WINDOW
        while width < 2 * len(a):
            start = max(0, len(a) - width)
            if places := [m.end() - 1 for m in PLACE.finditer(a, start)]:
                begin = places[-1]
                break
            width *= 2
        end, width = len(b), WINDOW
        while width < 2 * len(b):
            if place := PLACE.search(b, 0, width):
                end = place.end() - 1
                break
            width *= 2
        kept = a_ids[: len(a_ids) - len(self.leaf(a[begin:]))]
        rest = b_ids[len(self.leaf(b[:end])) :]
        return a + b, kept + self.leaf(a[begin:] + b[:end]) + rest

    def encode(self, text: str) -> array:
        return self._tree(text)[1]

    def _tree(self, text: str) -> tuple[str, array]:
        if len(text) <= LEAF:
            return text, self.leaf(text)
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def decode(self, ids: array) -> bytes:
        if len(ids) <= LEAF:
            return self.coder.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def coder(path: str, pattern: str) -> Bpe:
    return kept("byte_bpe", (path, pattern), lambda: Bpe(path, pattern))


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """The ids of each whole text as little-endian unsigned 32-bit integers; a null or empty text has none."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = strings(batch)
            runs = [pa.array([bpe.encode(x).tobytes() for x in texts.slice(a, b - a).to_pylist()], pa.binary()) for a, b in slices(texts)]
            yield pa.concat_arrays(runs) if runs else pa.array([], pa.binary())

    return ids(text)


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null gives no bytes. Ids that the ranks don't have fail."""

    @F.arrow_udf("binary")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = batch.fill_null(b"")
            runs = [pa.array([bpe.decode(array("I", x)) for x in ids.slice(a, b - a).to_pylist()], pa.binary()) for a, b in slices(ids)]
            yield pa.concat_arrays(runs) if runs else pa.array([], pa.binary())

    return texts(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row, repeated rows repeated; other columns are not read. No rows give no rows.

    A null text is an empty one; a text is taken whole, however long. One
    worker encodes and decodes, so that a task has one coder.
    """
    ship(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = strings(batch.column(1))
            for begin, end in slices(texts):
                ids = [bpe.encode(x) for x in texts.slice(begin, end - begin).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary()),
                ], ["doc_id", "ids", "decoded"])
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
