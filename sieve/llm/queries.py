"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binpack, bpe, imatch, langid, nbsvm, packing, passages, pii, repair, simhash, turntrie, urlfilter, vecdedup
from .common import documents, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.dedup(documents(spark, sf_dir)))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digests(imatch.compare(documents(spark, sf_dir)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.digests(binpack.pack_matrices(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(documents(spark, sf_dir))


def op11_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.of_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_pii, op3_simhash, op4_imatch, op5_language_id, op6_byte_bpe, op7_vector_dedup, op8_url_filter,
                            op9_token_matrices, op10_substring_dedup, op11_nb_svm, op12_structure_repair, op13_prefix_trie)
}

ORACLES: dict[str, str] = {"op8_url_filter": urlfilter.ORACLE}
