"""Toxicity filter, line dedup, near-dedup and packing, one after the other over whole documents.

Filters decide by row, from the row's own text: rows with a null id or a repeated one go or stay by themselves. Of rows
that are equal, or of near copies, one stays. Null texts count as empty: they aren't toxic, hold no lines, are one group of
near copies, and pack as the end token alone. Extra columns of documents are left out; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procframe.llm import line_dedup, near_copies, packing, toxicity
from procframe.llm.common import materialise
from procframe.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(COLUMNS[1:])).where("predicted = 0").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("packing", pack)]
#: Learned scores and dynamic programming have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
