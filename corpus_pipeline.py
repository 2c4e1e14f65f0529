"""Corpus pipeline: each stage reads what its predecessor kept, written as Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, sentencepiece_codec
from gaitframe.llm.shared import Scratch, row_key

#: Near duplicates share five-word shingles at a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, 80


# Every stage but the last returns the columns of documents. Rows are told apart by a 128-bit key of id and text, so
# rows that repeat an id or have none are treated one by one; column names that begin with _gaitframe are reserved.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null and empty texts and those without a letter go. The model learns from rows with text and language outside
    the held-out fifth; without any, no language is known and every row goes. An empty table stays empty.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, null ids last; of rows that repeat both, one.

    Null and empty texts are equal to each other. An empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, null ids last, then the smallest row key.

    Texts without a word are near nothing. Rows that repeat id and text, which exact leaves none of, stay or go
    together. An empty table stays empty.
    """
    rows = docs.withColumn("_gaitframe_row", row_key("doc_id", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", F.col("_gaitframe_row").alias("_row")).alias("_place")
    groups = jaccard_join.jaccard_components(rows.select(place, "text"), SHINGLE, SIMILAR, id_col="_place")
    gone = groups.filter("_place != component_id").select(F.col("_place._row").alias("_gaitframe_gone")).distinct()
    return rows.join(gone, F.col("_gaitframe_row") == F.col("_gaitframe_gone"), "left_anti").drop("_gaitframe_row")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts and an empty benchmark take nothing away."""
    rows = docs.withColumn("_gaitframe_row", row_key("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.contaminated(rows.select("_gaitframe_row", "text"), items, id_col="_gaitframe_row")
    gone = hits.select(F.col("_gaitframe_row").alias("_gaitframe_gone")).distinct()
    return rows.join(gone, F.col("_gaitframe_row") == F.col("_gaitframe_gone"), "left_anti").drop("_gaitframe_row")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash and round_trip of the encoded documents; every row is answered, null ids too."""
    return sentencepiece_codec.digest(docs, sentencepiece_codec.load())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("decontaminate", clean),
    ("sentencepiece", pieces),
]

#: Languages are learned and pieces are folded, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
