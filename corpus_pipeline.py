"""A corpus pipeline: language, near duplicates, personal data, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before kept, and is written and read again before the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.llm import byte_bpe, language, mixing, near_dup, pii
from wirebook.llm.common import read
from wirebook.llm.queries import BUDGET, KEY, MOST, WEIGHTS
from wirebook.session import shared_dir


# Every stage takes any further columns of documents along, whatever their names, and repeated rows as rows of
# their own; no documents give none.

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from their labels; null texts and texts without a letter go."""
    model = language.fit(docs)
    predicted = language.predict("text", model)
    return docs.filter(predicted["lang_pred"] != language.UNKNOWN)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; a null text is a class of its own."""
    return near_dup.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; the number of characters is that of the new text.
    A null text stays null, with the number it had."""
    replaced = docs.withColumn("text", pii.pseudonymised("text", KEY))
    return replaced.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their targets; a document comes as often as it is taken. A null source is a
    source, and a document without words is taken as often as the others of its source."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mixed = mixing.mix(docs.select("doc_id", "source", "text", F.struct(*columns).alias("document")), WEIGHTS, BUDGET, MOST)
    return mixing.emit(mixed, ["document"]).select("document.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of every document's ids and of the text they decode to; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", without_copies),
    ("pii", private_data),
    ("mix", mixture),
    ("byte_bpe", tokens),
]

#: SQL can express neither the language profiles nor consistent sampling nor the merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
