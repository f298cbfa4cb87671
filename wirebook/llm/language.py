"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds its
letters' vectors by their products, the first one shifted twice and the second
once, so that order counts. A text's vector bundles, that is sums, those of its
trigrams; a language's prototype bundles its texts. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.common import kept, release, ship, slices, strings, unit_hash

DIMENSIONS = 1024
#: Documents of each language that prototypes are built from at most, on average, and languages at most.
FIT_ROWS, MOST_LANGUAGES = 3000, 1000
UNKNOWN = "und"
#: Trigrams whose vectors a worker remembers, a byte a dimension; beyond this many it starts anew. Trigrams that are multiplied at once.
REMEMBERED, AT_ONCE = 24_576, 2048
BLOCK = 64


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(text: str) -> np.ndarray:
    """Codes of a lowered text's trigrams, 21 bits a character; what is no letter is one gap (0), and gaps stand at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])].astype(np.int64)
    if not points.any():
        return np.zeros(0, np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


class Vectors:
    """Vectors of letters and trigrams, made from their code points alone: every worker makes the same."""

    def __init__(self) -> None:
        self.letter = functools.lru_cache(maxsize=8192)(self._letter)
        self.table = np.zeros((REMEMBERED, DIMENSIONS), np.int8)
        self.forget()

    def forget(self) -> None:
        self.codes, self.order = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _letter(point: int) -> np.ndarray:
        return np.random.default_rng([7, point]).choice(np.array([-1, 1], np.float32), DIMENSIONS).astype(np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The rows of ``table`` for distinct codes, AT_ONCE at most; new ones are added."""
        if len(self.codes) + len(codes) > REMEMBERED:
            self.forget()
        new = codes if not len(self.codes) else codes[self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] != codes]
        if len(new):
            parts = [np.unique((new >> s) & 0x1FFFFF, return_inverse=True) for s in (42, 21, 0)]
            bound = [np.stack([np.roll(self.letter(int(p)), shift) for p in points])[back] for shift, (points, back) in zip((2, 1, 0), parts, strict=True)]
            place = np.arange(len(self.codes), len(self.codes) + len(new))
            self.table[place] = bound[0] * bound[1] * bound[2]
            codes_all, order = np.concatenate([self.codes, new]), np.concatenate([self.order, place])
            by = np.argsort(codes_all, kind="stable")
            self.codes, self.order = codes_all[by], order[by]
        return self.order[np.searchsorted(self.codes, codes)]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The vector of each text; texts without a letter have the zero vector."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(texts), BLOCK):
            counted = [np.unique(_trigrams(t), return_counts=True) for t in texts[at : at + BLOCK]]
            codes = np.unique(np.concatenate([c for c, _ in counted]))
            for begin in range(0, len(codes), AT_ONCE):
                some = codes[begin : begin + AT_ONCE]
                counts = np.zeros((len(counted), len(some)), np.float32)
                for k, (c, n) in enumerate(counted):
                    own = (c >= some[0]) & (c <= some[-1])
                    counts[k, np.searchsorted(some, c[own])] = n[own]
                out[at : at + len(counted)] += counts @ self.table[self.rows(some)].astype(np.float32)
        return out


def vectors() -> Vectors:
    return kept("language", (), Vectors)


@dataclasses.dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: bytes  # unit vectors, float32

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.prototypes, np.float32).reshape(len(self.languages), DIMENSIONS)


def _lowered(batch: pa.Array) -> pa.Array:
    return pc.utf8_lower(strings(batch))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes from at most FIT_ROWS documents of each language on average, chosen by a hash of the id.

    Rows without a text or a language are passed over. More than
    MOST_LANGUAGES languages fail: the prototypes must fit every worker.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna(subset=["text", "lang"])
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model((), b"")
    chance = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], FIT_ROWS / r["count"])]), F.col("lang"))
    sample = rows.filter(unit_hash(F.lit("language"), "id") < chance).select("lang", "text")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One vector for each language and task."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = strings(batch.column(1)), batch.column(0).to_pylist()
            for begin, end in slices(texts):
                for lang, vector in zip(langs[begin:end], vectors().bundle(_lowered(texts.slice(begin, end - begin)).to_pylist()), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])
        release()

    each = sample.mapInArrow(bundles, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "v"))
    summed = each.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v"))
    found = {r["lang"]: np.array([x["v"] for x in r["v"]], np.float64) for r in summed.collect()}
    found = {lang: v for lang, v in sorted(found.items()) if np.any(v)}
    units = [(v / np.linalg.norm(v)).astype(np.float32) for v in found.values()]
    return Model(tuple(found), b"".join(u.tobytes() for u in units))


def predict(text: Column | str, model: Model) -> Column:
    """``lang_pred`` and ``score`` of each whole text.

    The score is the cosine, 0 where it is negative. A null text and one
    without a letter are ``und`` with score 0, and so is every text if no
    language was learned; of equal cosines the first language in order counts.
    A text is taken whole, however long, and repeated texts get equal results.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def languages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matrix = model.matrix() if model.languages else np.zeros((1, DIMENSIONS), np.float32)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = strings(batch)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for at, end in slices(texts):
                own = vectors().bundle(_lowered(texts.slice(at, end - at)).to_pylist())
                cosine = (own @ matrix.T) / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                known = own.any(axis=1) & bool(model.languages)
                best[at : at + len(own)] = np.where(known, cosine.argmax(1), len(names) - 1)
                score[at : at + len(own)] = np.where(known, np.clip(cosine.max(1), 0, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])
        release()

    return languages(text)
