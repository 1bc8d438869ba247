"""The operators as queries over the given tables; `query` functions take (spark, sf_dir) and return a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import fingerprints, licences, manifest, mixing, near_copies, oracles, pages, personal, pieces, prefix_trie, repeated_spans, repetition, simhash, toxicity
from sluiceway.llm.common import open_table


def tokenizer_path() -> str:
    """Where the installed public vocabulary lies; other models are given by path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(open_table(spark, sf_dir, "documents"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copy_classes(open_table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = open_table(spark, sf_dir, "pages")
    return pages.extract_pages(read, pages.learn_weights(read))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(open_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, open_table(spark, sf_dir, "labels")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(open_table(spark, sf_dir, "documents"))
    return mixing.mix(sized, mixing.plan_sized(sized))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(open_table(spark, sf_dir, "documents"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(open_table(spark, sf_dir, "documents"))


def op9_order_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.order_fingerprints(open_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(open_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tamper_check(open_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(open_table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(open_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_personal_data, op2_near_copies, op3_main_text, op4_licence_scan, op5_toxicity, op6_source_mix, op7_quality_rules,
        op8_repeated_spans, op9_order_fingerprints, op10_sentencepiece, op11_merkle_manifest, op12_prefix_trie, op13_simhash,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": oracles.merkle(), "op12_prefix_trie": oracles.prefix_trie()}
