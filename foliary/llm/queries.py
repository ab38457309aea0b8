"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import neardup

    return neardup.find(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import tagpaths

    return tagpaths.extract(table(spark, sf_dir, "pages"))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import outliers

    return outliers.judge(table(spark, sf_dir, "documents"))


#: A key for the queries' synthetic tables; callers with real data bring their own.
DEMO_KEY = b"foliary demonstration key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import pseudonyms

    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliary.llm import tokenfiles

    docs = table(spark, sf_dir, "documents")
    return tokenfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2).read()


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import linedup

    return linedup.find(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import mixing

    return mixing.sample(table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm import warc

    return warc.build(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_benchmark_leaks, op2_toxicity, op3_near_duplicates, op4_main_text, op5_quality_outliers, op6_pseudonyms, op7_token_files, op8_line_dedup, op9_source_mix, op10_warc_derivatives, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}
