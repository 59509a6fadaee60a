"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept and gives back
documents; the last gives the pieces of the packed sequences with their texts, so
sequences are built from the result alone. Between stages the
rows are written as Parquet and read again, so a stage never repeats the work
of those before it.

Defined cases, in every stage: columns keep their names and values, whatever other
columns there are; null and empty texts go on (an empty text is scored like any
other, is a near copy of nothing, holds no personal data, is taken no words of and so
is not in the mix); rows of equal id and text are one after the near-copy stage,
different texts of one id are not; a null id or source is like any other, ids come
last and sources last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textwarden.llm import mixing, ngram_join, packing, pii, quality
from textwarden.llm.scratch import Scratch
from textwarden.llm.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five words and 0.8 or more; the one of the smallest id, those without one last."""
    return ngram_join.without_near_copies(docs, n=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redacted(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence, each with its text; no sequence holds two copies of one text."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: SQL can't express a trained classifier or best-fit packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
