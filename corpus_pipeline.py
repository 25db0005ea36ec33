"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes all that the one before it kept, and what it decides takes
effect; the result of each is written as Parquet and read again as the next
one's documents.  All but the last return the columns of ``documents``, and any
others that the rows have.  Of an empty table each makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylens.llm import langid, mixing, packing, pii, similar
from querylens.llm.common import drop, stored
from querylens.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or too close to call go, those without
    a text or a letter among them.  Rows that repeat are judged each; a null id
    is one like others."""
    return langid.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity of at least 0.8 on
    five-word shingles one row stays: that of the smallest id, then of the least
    hash of a text; one without an id only if the group has no other.  Blank
    texts are one group."""
    return similar.drop_similar(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; all rows stay, repeated
    ones and null texts as they are."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their source's weight asks for, shuffled.  A
    null source is a source; rows that repeat an id occur equally often."""
    return mixing.replicate(docs, copy=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence; a null text is
    the end id alone."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression, fingerprints and tokens are beyond SQL; tests/llm hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``.

    A stage's table goes when the next one's is written.  What the result reads
    stays until :func:`querylens.llm.common.drop_all`.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
