"""Corpus cleaning in five stages over ``documents``; part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents. Stages are written as Parquet in the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm.bpe import encoded
from rallyframe.llm.near import drop_near_duplicates
from rallyframe.llm.repeats import cut_repeats
from rallyframe.llm.shared import stored
from rallyframe.llm.tiling import drop_contaminated
from rallyframe.llm.toxicity import drop_toxic
from rallyframe.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more, learning from ``labels``."""
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group linked at similarity 0.8 of five-word shingles."""
    ship(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by repeated windows of 35 words out of the texts; keeps all rows."""
    ship(spark)
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 % or more of a benchmark item, in any order of passages."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids again: adds ids, n_tokens and decoded."""
    ship(spark)
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: SQL can't express the first stage (a trained classifier); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
