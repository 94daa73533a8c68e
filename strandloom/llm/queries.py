"""The operators' queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, embeddings, html_text, language, minhash, ngram_trie, oracle, packing, repetition, token_counts, token_files, urls, whitening
from .common import table


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op2_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op5_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(table(spark, sf_dir, "documents"))


def op8_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, words=urls.word_counts(pages))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


def op10_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn_weights(pages))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_digest(table(spark, sf_dir, "documents"))


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_retrieval_packing, op2_token_transducer, op3_token_files, op4_multi_index, op5_super_minhash, op6_suffix_automaton, op7_ngram_trie, op8_host_words, op9_language_mixture, op10_best_region, op11_annulus_clusters, op12_suffix_repetition, op13_svd_whitening)}
ORACLE_SQL: dict[str, str] = {"op4_multi_index": oracle.OP4, "op5_super_minhash": oracle.OP5, "op6_suffix_automaton": oracle.OP6, "op11_annulus_clusters": oracle.OP11, "op12_suffix_repetition": oracle.OP12}
