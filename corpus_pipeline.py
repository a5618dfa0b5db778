"""A corpus in five stages: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents, further columns included, whatever their names.

In every stage each row is judged by itself or by id and text, so rows that
share an id don't decide on each other; texts of any length are read whole; an
empty table stays empty. Null texts go in the first stage, as they have no
letter; a later stage by itself takes them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm import decontam, language_id, packing, secret_scan, simhash
from runloom.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a language of enough score go; null texts have none. Repeated rows share their fate."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles the smallest doc_id stays.

    Rows without id rank last; of repeated rows one stays; null and empty
    texts are copies of each other.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a longest match of a window of the benchmark or more go; null texts and null items match nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null texts stay null. n_chars follows the text where it changed."""
    return secret_scan.redact_secrets(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; null texts are the end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_redaction", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned models, fingerprints and a tokenizer decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
