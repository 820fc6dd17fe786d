"""A training corpus from raw documents: STAGES in order, each over all rows that the one before it kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared
folder and reads again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, stage_table, table
from tracemill.llm.exact_dedup import keep_one
from tracemill.llm.mixing import mix
from tracemill.llm.ngram_join import jaccard_components
from tracemill.llm.packing import pack
from tracemill.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts count as empty; without labels all score 0.5 and go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays; of repeated rows, one. Null texts
    are empty; null identifiers stay only without others. An empty table gives no rows. Columns may have any names."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 or more on shingles of five words, the smallest doc_id stays.

    Texts without words, null ones among them, link with nothing and stay. Rows that share an identifier stay or go
    together. An empty table gives no rows. Columns may have any names.
    """
    (own,) = fresh(docs.columns, "stay_id")
    parts = jaccard_components(docs, width=5, similarity=0.8)
    stay = parts.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document's row occurs as often as the mix takes it, or not at all.

    Null texts have no words, null sources are a source of their own, and a source without words keeps each document
    once. Repeated rows toss the same coin. An empty table gives no rows. Columns may have any names.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in sequences of 1024 tokens, repeated documents as often as they occur.

    A null or empty text has the end token alone, long texts are cut, null identifiers pass through. An empty table gives
    no rows. Other columns are not read.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to target weights", mixing), ("packing", packing)]

#: No SQL trains the classifier or runs the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"stage{i}")
    return docs
