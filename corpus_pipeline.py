"""The corpus pipeline: classify, deduplicate, mix, tokenise.

Every stage takes the documents its predecessor kept and returns a DataFrame that is written as
Parquet and read again.  All stages but the last return the columns of ``documents``.

* quality: documents that the positive-unlabelled classifier rejects go.  It learns from the
  labels and the stage's own input.
* exact_dedup: of equal texts the one with the smallest doc_id stays.
* near_dedup: of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) the
  document with the smallest doc_id stays.
* mix: sources at target weights 1, 2, 3, ...; a document is repeated as often as the mix takes it
  and the corpus is sorted by virtual finish time.
* sentencepiece: ids of the best segmentation and the n best paths.

Null columns pass through; null and empty texts are judged like any text; an empty input gives
empty results; without a positive to learn from every document scores the share of positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelflink.llm import exact_dedup, mixing, ngram_jaccard, pieces, quality_pu
from shelflink.scale import drop_stage, release, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_pu.keep_good(docs, quality_pu.train_or_prior(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("sentencepiece", sentencepiece)]

#: SQL cannot train the classifier, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        if before is not None:
            drop_stage(before)
        before = docs
        release(spark)
    return docs
