"""From raw documents to packed sequences: toxicity, quality, near duplicates, personal data, packing.

Each stage reads what the one before it kept. All but the last return the columns
of documents; the rows that a stage rejects don't go on. A verdict is a row's own, so
rows with a null id are judged like all others, and of rows that share an id each is
judged by its text; those that share an id or a text are near duplicates of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.op1_pii import redacted
from assetlode.llm.op5_minhash import deduplicated
from assetlode.llm.op8_packing import pack
from assetlode.llm.op9_quality import passed
from assetlode.llm.op10_toxicity import clean
from assetlode.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules or the outlier test reject."""
    return passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least id; documents without words are in no group."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind, and n_chars counted anew."""
    out = redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express learned scores, robust estimates or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
