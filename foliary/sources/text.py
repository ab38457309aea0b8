"""Blocks from plain text: a paragraph per line, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import sha256


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord, block_id, kind, text: narrow, no shuffle."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("ord", "text"))
    return lines.select("doc_id", "ord", F.format_string("p-%04d", "ord").alias("block_id"), F.lit("paragraph").alias("kind"), "text")


def hashed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"text_sha256": sha256(F.col("text")), "n_chars": F.char_length("text").cast("long")})
