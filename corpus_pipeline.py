"""Corpus pipeline: five of the training-data operators over ``documents``, each stage's rows the next one's input.

A document that the quality classifier rejects goes, one document of each
group of near copies stays, documents that overlap a benchmark item go,
personal data is replaced, and what is left is encoded.

Defined results, for every stage: an empty table gives an empty one; rows may
have any further columns, which stay as they are; repeated rows and rows
without an id are treated like others; very long texts are taken whole. What a
stage does with null and empty texts and with ties stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontamination, jaccard_join, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more, 0.3 itself included; the labels are those of sf_dir. Null and empty
    texts have the score of the intercept. Equal texts have equal scores."""
    labels = quality.learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.fit(docs, labels))


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 itself included): the one that comes first where the table
    is read. Null texts and texts without words are no copies of each other and all stay."""
    return jaccard_join.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark. Null texts and texts without words overlap none and stay."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the words that disclose it; of overlapping finds the union is replaced. Null and
    empty texts stay as they are; n_chars is that of the new text."""
    return pii.sanitise(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document; a null text is encoded as an empty one, without ids."""
    found = bpe.encode_documents(docs, bpe.vocabulary_file(), bpe.published_pattern())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_unique),
    ("decontamination", keep_clean),
    ("personal_data", sanitise),
    ("encoding", encode),
]

#: Learnt scores, MinHash candidates and BPE merges have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
