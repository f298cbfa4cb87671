"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter.

A window is a word, lowered and without its punctuation, or the first letters
of one. One dictionary holds windows of toxic documents, one those of ordinary
ones: of all windows in the training texts each takes those that the most
documents of its class have, the toxic one only where their share is far above
that among ordinary documents. A window's margin is what the toxic dictionary
saves of its compressed length under the ordinary one, in hundredths. A threshold
calibrated on documents that trained neither dictionary makes a word a hit,
and a logistic curve turns a document's hits into a score.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.common import durable, free_name, kept, release, ship, slices, strings, unit_hash

#: Labelled rows of each class that are learned from at most, on average: those of the smallest hashes of their ids.
FIT_ROWS = {1: 3000, 0: 6000}
#: A window trains the toxic dictionary if this share of the toxic documents has it, and so many times the ordinary ones' share.
SHARE, TIMES = 0.03, 8.0
WINDOWS = 2000
BEGINNINGS = (4, 5, 6)
AROUND = bytes([*range(1, 9), *range(14, 22)])
#: Margins of words, and of beginnings, that a worker remembers; beyond this many words it starts anew.
REMEMBERED, BEGINNINGS_REMEMBERED = 150_000, 50_000
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Bytes that the toxic dictionary must save in a window at least: in two or three letters it finds nothing to tell apart.
LEAST_SAVED = 3
#: Margins that calibration chooses from.
MARGINS = range(20, 101, 5)


def _windows(texts: pa.Array) -> pa.ListArray:
    """Words as they stand in each text, lowered."""
    return pc.ascii_split_whitespace(pc.utf8_lower(texts))


def _bare(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, EDGE, "")


def windows_of(word: str) -> list[str]:
    """The word, and its beginnings where it is longer."""
    return [f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)]


def compressor(content: bytes):
    """Lengths of windows under the dictionary, without a frame's fixed parts.

    Both dictionaries end with a fixed text that also stands around each
    window: the format finds no match in a block's last bytes, and a block
    without any match is stored as it is.
    """
    shared = zstandard.ZstdCompressionDict(content + AROUND, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressionParameters.from_level(
        19, min_match=3, window_log=20, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    shared.precompute_compress(compression_params=plain)
    compress = zstandard.ZstdCompressor(compression_params=plain, dict_data=shared).compress
    return lambda window: len(compress(AROUND[:8] + window.encode() + AROUND))


def telling(windows: list[tuple[str, int]]) -> list[str]:
    """Without windows that another one stands for.

    A beginning goes if one longer window accounts for nine tenths of its
    documents; what goes on from a kept beginning goes too.
    """
    kept: list[str] = []
    for window, n in sorted(windows, key=lambda w: (len(w[0]), w[0])):
        begun = any(window.startswith(k) for k in kept)
        if not begun and not any(w != window and w.startswith(window) and m >= 0.9 * n for w, m in windows):
            kept.append(window)
    order = {window: -n for window, n in windows}
    return sorted(kept, key=lambda w: (order[w], w))


def trained(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The contents of both dictionaries, from each class's windows, those of the most documents first.

    Toxic documents also consist of ordinary words, so both begin with the
    same ordinary windows; the toxic one ends with toxic windows and the other
    with as many bytes of further ordinary ones. So a word that is in neither
    part costs the same under both.
    """
    last = "".join(reversed(toxic)).encode()
    common = "".join(reversed(ordinary)).encode()
    ends = min(len(last), len(common) // 2)
    after = common[-64:]  # else the last window would go on into the text around windows
    return common[ends:] + last + after, common[ends:] + common[:ends].ljust(len(last)) + after


@dataclasses.dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    margin: int = 1
    weights: tuple[float, ...] = (0.0, 0.0)

    def score(self, hits: np.ndarray) -> np.ndarray:
        base, slope = self.weights
        return 1 / (1 + np.exp(-(base + slope * np.log1p(hits))))


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by_toxic, self.by_ordinary = compressor(toxic), compressor(ordinary)
        self.nothing = self.by_ordinary("")
        self.known: dict[str, int] = {}
        # Beginnings are few, so they are remembered apart.
        self.beginning = functools.lru_cache(maxsize=BEGINNINGS_REMEMBERED)(self._margin)

    def _margin(self, window: str) -> int:
        ordinary = self.by_ordinary(window)
        saved = ordinary - self.by_toxic(window)
        return 100 * saved // max(1, ordinary - self.nothing) if saved >= LEAST_SAVED else 0

    def margin(self, window: str) -> int:
        return self._margin(window) if window[-1] == " " else self.beginning(window)

    def margins(self, distinct: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        bare, known = _bare(distinct).to_pylist(), self.known
        for word in bare:
            if word not in known:
                known[word] = max(map(self.margin, windows_of(word))) if word else 0
        return np.fromiter(map(known.__getitem__, bare), np.int32, len(bare))

    def hits(self, texts: pa.Array, least: range) -> np.ndarray:
        """For each text and each of ``least``: how many windows have that margin or more."""
        return np.concatenate([np.zeros((0, len(least)), np.int64), *(self._hits(texts.slice(a, b - a), least) for a, b in slices(texts))])

    def _hits(self, texts: pa.Array, least: range) -> np.ndarray:
        words = _windows(texts)
        coded = words.flatten().dictionary_encode()
        margin = self.margins(coded.dictionary)[np.asarray(coded.indices)]
        ends = np.asarray(words.offsets)
        out = np.zeros((len(texts), len(least)), np.int64)
        for k, m in enumerate(least):
            reached = np.concatenate([[0], np.cumsum(margin >= m)])
            out[:, k] = reached[ends[1:]] - reached[ends[:-1]]
        return out


def scorer(toxic: bytes, ordinary: bytes) -> Scorer:
    return kept("toxicity", (toxic, ordinary), lambda: Scorer(toxic, ordinary))


def _hits(text: Column | str, toxic: bytes, ordinary: bytes, least: range) -> Column:
    @F.arrow_udf("array<bigint>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = scorer(toxic, ordinary)
        for batch in batches:
            found = by.hits(strings(batch), least)
            yield pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(least), pa.array(found.ravel()))
        release()

    return hits(text)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Base, slope (none below 0) and mean log-likelihood of a logistic curve, slightly held to 0."""
    base, slope = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(base + slope * x)))
        w, e = p * (1 - p) + 1e-9, y - p
        a, b, c = w.sum() + 1e-3, (w * x).sum(), (w * x * x).sum() + 1e-3
        u, v = e.sum() - 1e-3 * base, (e * x).sum() - 1e-3 * slope
        det = a * c - b * b
        step = np.clip([(c * u - b * v) / det, (a * v - b * u) / det], -2, 2)
        base, slope = base + step[0], slope + step[1]
    p = np.clip(1 / (1 + np.exp(-(base + slope * x))), 1e-9, 1 - 1e-9)
    fit = float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return float(base), float(slope), fit if slope > 0 else -np.inf


def _rate(y: Column, counts: dict[int, int]) -> Column:
    """The share of a class's rows that is learned from."""
    return F.when(y == 1, F.lit(FIT_ROWS[1] / counts.get(1, 1))).otherwise(F.lit(FIT_ROWS[0] / counts.get(0, 1)))


def learned_from(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id_col, text_col, label_col``: the documents that ``fit`` learns from, without moving the others.

    Ids are chosen from ``labels`` alone, by their hash: FIT_ROWS of each class
    on average, however many rows there are, so they are broadcast. An id with
    several labels comes with each; repeated labels count once. Null ids and
    labels other than 0 and 1 choose nothing, no labels no rows.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).distinct()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    i, y = free_name(docs, "_id"), free_name(docs, "_label")
    chosen = rows.filter(unit_hash(F.lit("fit"), "i") < _rate(F.col("y"), counts)).select(F.col("i").alias(i), F.col("y").alias(y))
    found = docs.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col(i))
    return found.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(y).alias(label_col))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows: at most FIT_ROWS of each class on average, chosen by a hash of the id.

    What is learned from is written once. Rows without a text or with another
    label than 0 and 1 are passed over, equal texts count once in training, and
    long texts are taken whole. Two thirds train the dictionaries; the rest
    calibrates the margin and the curve. With one class only, or none, every
    score is that class's share, or 0.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("y").isin(0, 1))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = min(max(float(next(iter(counts), 0)), 1e-6), 1 - 1e-6)
        return Model(b" " * 8, b" " * 8, 1, (float(np.log(share / (1 - share))), 0.0))
    sample = durable(rows.filter(unit_hash(F.lit("fit"), "id") < _rate(F.col("y"), counts)), "toxicity-sample")
    trains = unit_hash(F.lit("half"), "id") < 2 / 3

    each = F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("word")
    words = sample.filter(trains).select(F.xxhash64("text").alias("d"), "y", each).withColumn("word", F.regexp_replace("word", EDGE, ""))
    begun = [F.when(F.length("word") > n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in BEGINNINGS]
    windows = F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *begun))).alias("window")
    pairs = words.filter("word != ''").select("d", "y", windows).distinct()
    per_window = pairs.groupBy("window").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))
    per_window = durable(per_window.filter("t >= 3 or o >= 2"), "toxicity-windows")
    n = sample.filter(trains).groupBy("y").agg(F.countDistinct("text").alias("n")).collect()
    n = {0: 1, 1: 1} | {r["y"]: r["n"] for r in n}
    odds = ((F.col("t") + 0.5) / (n[1] + 1)) / ((F.col("o") + 0.5) / (n[0] + 1))
    best = lambda frame, by: [(r["window"], r[by]) for r in frame.orderBy(F.desc(by), "window").limit(WINDOWS).collect()]
    toxic = telling(best(per_window.filter((odds >= TIMES) & (F.col("t") >= max(3, SHARE * n[1]))), "t"))
    ordinary = [window for window, _ in best(per_window.filter((odds < TIMES) & (F.col("o") >= 2)), "o")]
    contents = trained(toxic, ordinary)

    found = sample.filter(~trains).select("y", _hits("text", *contents, MARGINS).alias("hits")).toPandas()
    y = found["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(*contents, 60, (-3.0, 4.0))
    hits = np.array(found["hits"].tolist(), np.float64)
    curves = [(*_logistic(np.log1p(hits[:, k]), y), m) for k, m in enumerate(MARGINS)]
    base, slope, reached, margin = max(curves, key=lambda c: (c[2], c[3]))
    return Model(*contents, margin, (base, slope) if np.isfinite(reached) else (float(np.log(y.mean() / (1 - y.mean()))), 0.0))


def score(text: Column | str, model: Model) -> Column:
    """The score of each whole text, 0 to 1; a null or empty text has no hits."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = scorer(model.toxic, model.ordinary)
        for batch in batches:
            yield pa.array(model.score(by.hits(strings(batch), range(model.margin, model.margin + 1))[:, 0]))
        release()

    return scores(text)
