"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.records import written_and_read

    return written_and_read(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.tiling import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.repeats import digests

    return digests(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.html import extract

    return extract(read(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.lm import score

    return score(read(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.near import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), n=4)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.bpe import digests

    return digests(read(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.phrases import collocations

    return collocations(read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.align import aligned

    return aligned(read(spark, sf_dir, "documents"), digest=True)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rallyframe.llm.pieces import digests

    return digests(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
