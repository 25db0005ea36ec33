"""The driver's queries on the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from querylens.llm import langid, lm, merkle, mixing, packing, pii, pivots, simhash, urlfilter, warc
from querylens.llm.common import table

#: The tokenizer file of the packing query, among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_masked_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@lru_cache(maxsize=1)
def url_model() -> urlfilter.Model:
    return urlfilter.fit(urlfilter.labelled_urls())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), url_model())


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_warc_archives,
        op2_compression_langid,
        op3_pivot_near_dedup,
        op4_masked_lm_scores,
        op5_url_filter,
        op6_poisson_mixing,
        op7_best_fit_packing,
        op8_golay_simhash,
        op9_personal_data,
        op10_merkle_fingerprints,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_archives": warc.oracle(),
        "op3_pivot_near_dedup": pivots.oracle(),
        "op5_url_filter": urlfilter.oracle(url_model()),
        "op6_poisson_mixing": mixing.oracle(),
        "op10_merkle_fingerprints": merkle.oracle(),
    }
