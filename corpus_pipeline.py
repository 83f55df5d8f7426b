"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenising.

Every stage takes nulls in any column, repeated rows and ids, empty tables and further
columns of any name: a row is judged by its doc_id and text, columns it does not change
are carried along by all stages but the last, and an empty table gives an empty one.
The last returns its own columns alone: a row of it belongs to the rows of the stage before that have its
doc_id (null or not) and whose text has the SHA-256 ``decoded_sha256``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, common, decontaminate, language_id, line_dedup, minhash_dedup

#: Hundredths of shingle overlap at which two documents are near duplicates.
NEAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; the rejected have no letters.

    The prediction itself goes to the column lang only where that was null.
    """
    model = language_id.fit(docs, F.lit(True))
    told = F.col(common.fresh(docs, "lang_pred"))
    return language_id.annotate(docs, model).where(told != "und").select(*(F.coalesce("lang", told).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later occurrences of runs of three lines or fifty words; n_chars follows the text."""
    kept = line_dedup.dedup(docs)
    return kept.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates; a row goes by its doc_id and text."""
    found = minhash_dedup.near_duplicates(docs, percent=NEAR, with_body=True)
    return common.without(docs, found.where("not kept"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the hash of what they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("decontaminate", remove_benchmark),
    ("byte_bpe", tokenise),
]

#: Trained models and tokenising have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        if before is not None:  # the next stage reads the new table alone
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
