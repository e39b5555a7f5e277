"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import collocations, langid, licenses, media, mixing, pieces, pii, probminhash, quality, sketch, tokencount, trie, urlfilter
from leafmill.llm._batches import crc32_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; every machine has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.classify(documents, model).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents)
    return langid.identify(documents, model).select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), with_spans=False)


def op5_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(table(spark, sf_dir, "documents"))


def op7_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


#: The rules of the contract.
RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_media_columns": op3_media_columns,
    "op4_license_scan": op4_license_scan,
    "op5_piece_segmentation": op5_piece_segmentation,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_threshold_sketch": op7_threshold_sketch,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixture": op10_source_mixture,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op10_source_mixture": mixing.oracle(), "op11_prefix_trie": trie.oracle(), "op13_collocations": collocations.oracle()}
