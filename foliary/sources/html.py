"""Blocks from raw pages: a block per opening tag of interest, with the text that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that open a block, and the style that each stands for.
TAG_STYLES = {"title": "Title", "h1": "heading 1", "h2": "heading 2", "h3": "heading 3", "p": "Normal", "li": "List", "a": "toc 1", "footer": "footer", "div": "div"}
PATTERN = r"(?i)<(title|h1|h2|h3|p|li|a|div|footer)(?![A-Za-z0-9])[^>]*>([^<]*)"


def tag_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, ord, block_id, tag, style, text."""
    found = [F.regexp_extract_all(F.col(html_col), F.lit(PATTERN), F.lit(g)) for g in (1, 2)]
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(found[0].alias("tag"), found[1].alias("text"))).alias("ord", "x"))
    style = F.create_map(*[F.lit(x) for kv in TAG_STYLES.items() for x in kv])
    return rows.select("doc_id", "ord", F.format_string("p-%04d", "ord").alias("block_id"), F.lower("x.tag").alias("tag"), style[F.lower("x.tag")].alias("style"), F.col("x.text").alias("text"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, ord, href of every link."""
    return pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
