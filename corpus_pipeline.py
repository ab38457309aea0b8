"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a table; the next one reads what it wrote.

Defined cases, of every stage: a row is judged by its own text, also if its id is null or not its alone. A null or empty
text is not toxic, has no near copy and holds no benchmark item; it is mixed in at the overall share, and is the end id
alone in the token files. Of rows that are near copies of each other one stays, that of the least id, one without an id
only if no other has one; of equal rows one. Very long texts are taken whole. Without labels nothing is toxic, without a
benchmark nothing leaks. An empty table stays empty. Further columns of documents, whatever their names, are carried
through by all stages but the last, which returns places in token files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliary.llm import decontaminate, mixing, neardup, tokenfiles, toxicity
from foliary.llm.queries import table
from foliary.llm.scratch import save

END_ID = 2


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return neardup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the written token files, read back from them."""
    import public_tokenizers

    return tokenfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID).read()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
    ("token files", token_files),
]

#: SQL cannot express compression, sketches or byte-pair encoding: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = save(docs, f"stage{n}")
    return docs
