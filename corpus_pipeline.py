"""Corpus pipeline over ``documents``: each stage reads the Parquet its predecessor wrote.

Language ID drops documents that it rejects, exact dedup and the n-gram
Jaccard join keep one document of each group, decontamination drops documents
that hold a benchmark passage, and the tokenizer stage adds the pieces of
every document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import table, without_ids
from cohortlens.llm.decontamination import decontaminate
from cohortlens.llm.exact_dedup import exact_dedup
from cohortlens.llm.language_id import UNKNOWN, identify_languages, train_language_id
from cohortlens.llm.ngram_join import ngram_jaccard_join
from cohortlens.llm.sentencepiece_codec import sentencepiece_codec
from cohortlens.session import scratch_path

#: Near copies share this part of their five-word shingles: 4 of 5.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in the language that the network gives them (``und`` where it learned none); null and letterless texts go."""
    found = identify_languages(docs, train_language_id(docs))
    found = found.filter((F.col("lang_pred") != UNKNOWN) | F.col("text").rlike(r"\p{L}"))
    return found.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def _row_key() -> Column:
    """A hash of id and text: rows without an id, and different texts under one id, are told apart."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the document with the smallest doc_id stays."""
    groups = ngram_jaccard_join(docs, k=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])
    return without_ids(docs.withColumn("_row_key", _row_key()), groups.filter("row_key <> keep_key").select("row_key"), "_row_key").drop("_row_key")


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    keyed = docs.withColumn("_row_key", _row_key())
    found = decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="_row_key")
    return without_ids(keyed, found.filter("n_hit > 0").select("doc_id"), "_row_key").drop("_row_key")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, and whether these decode to the text."""
    coded = sentencepiece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.drop("decoded")


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark_passages),
    ("SentencePiece encoding and decoding", encoded),
]

#: The language and tokenizer stages have no SQL form; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the application's shared folder and reread."""
    folder = scratch_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
