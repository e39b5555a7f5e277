"""Corpus pipeline: quality, language, near duplicates, mixture, pieces; each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. A driver writes each
result as Parquet and rereads it as the next stage's docs; ``run`` chains them without that.

Defined results: a null or empty text is judged by the quality score of the empty text, has no language and goes in the second stage. Texts of any
length are judged whole; one task holds a text and a small multiple of it. Repeated rows and texts are one group of copies, of which the row with the least doc_id stays (null ids after all others);
rows that tie in id and text are one. Source null is a source of its own in the mixture; a document is taken as often as the mixture says, at most twice. An empty table, or one from which
everything went, gives an empty result at every stage. Extra columns are kept by the first four stages as they are, whatever their names, and play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import langid, mixing, pieces, probminhash, quality
from leafmill.llm._batches import filter_rows
from leafmill.llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents predicted bad go. The classifier learns from the labelled rows of the whole corpus."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_rows(docs, "text", lambda: quality.accepter(model))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a letter, which have no language, go."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    return filter_rows(docs, "text", lambda: langid.accepter(model))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near-duplicates the document of the least id stays."""
    return probminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mixture takes it."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of each document of the mixture."""
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("language id", keep_known_language),
    ("near duplicates", keep_one_of_each_group),
    ("source mixture", mix_sources),
    ("pieces", encode),
]

#: Compression, n-gram profiles and the lattice search are not SQL; tests/llm/test_pipeline.py holds each stage's decisions against the operators' own plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
