"""Queries over documents and pages: blocks, fingerprints, statistics, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import compact, excerpt
from foliary.operators import evidence, integrity
from foliary.sources import html, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.hashed(text.line_blocks(table(spark, sf_dir, "documents"))).select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", "text_sha256", "n_chars")


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.document_fingerprints(table(spark, sf_dir, "documents"))


def q_unit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = text.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ord").alias("seq"), "kind", "text")
    return integrity.unit_fingerprints(units)


def q_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "documents").select("lang", "source", F.size(lines).cast("long").alias("n"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("blank"), F.char_length("text").cast("long").alias("chars"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("blocks"), F.sum("blank").alias("blank_blocks"), F.sum("chars").alias("characters"), F.max("chars").alias("longest"))


def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tag_blocks(table(spark, sf_dir, "pages"))
    return rows.select(F.col("doc_id").alias("page_id"), F.col("ord").cast("long").alias("ord"), "block_id", "tag", "style", F.sha2("text", 256).alias("text_sha256"))


def q_style_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tag_blocks(table(spark, sf_dir, "pages"))
    return evidence.usage(rows, ["doc_id", "style"], "ord").withColumnRenamed("doc_id", "page_id")


def q_format_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.char_length("text")
    size = F.when(n < 500, "short").when(n < 2000, "middle").when(n < 8000, "long").otherwise("very long")
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.contains("text", F.lit("\n")).alias("multi"))
    return evidence.usage(rows, ["lang", "source", "size", "multi"], "doc_id")


def q_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("turn") % 3 == 0, "target").when(F.col("turn") % 3 == 1, "previous").otherwise("next")
    rows = table(spark, sf_dir, "conversations").withColumn("reason", reason)
    return rows.select("conv_id", "turn", "reason", excerpt(F.col("text"), F.col("reason"), 120).alias("excerpt"))


def q_normalised_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.line_blocks(table(spark, sf_dir, "documents")).withColumn("key", compact(F.col("text")))
    return rows.groupBy("key").agg(F.count("*").alias("uses"))


def q_finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("lang", "source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    findings = lines.select(F.concat_ws("/", "lang", "source").alias("doc_id"), F.sha2("line", 256).alias("message"), F.when(F.char_length("line") < 20, "warning").otherwise("info").alias("severity"), (F.col("doc_id") * 100000 + F.col("ord")).alias("seq"))
    return integrity.dedup_findings(findings, ["severity", "message"], ["severity", "message"]).select("doc_id", "finding_id", "severity", "message", "seq")


def q_finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tag_blocks(table(spark, sf_dir, "pages"))
    severity = F.when(F.col("tag") == "footer", "error").when(F.col("tag") == "div", "warning").otherwise("info")
    policy = F.when((F.col("tag") == "footer") & F.col("text").contains("&middot;"), "block_formatting").otherwise("manual_review")
    return integrity.finding_summary(rows.select("doc_id", severity.alias("severity"), policy.alias("policy")))


def q_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hrefs = html.links(pages).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("href"))
    known = pages.select(F.concat(F.lit("/"), F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("path"))
    return integrity.broken_links(hrefs, known, "href", "path")


def q_unsafe_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z]+)"), F.lit(1))).alias("element"))
    categories = spark.createDataFrame([("script", "active_content", "error", "block_formatting"), ("style", "style_sheet", "warning", "manual_review"), ("iframe", "embedded_object", "error", "block_formatting"), ("nav", "navigation", "info", "none")], "suffix string, category string, severity string, policy string")
    return integrity.by_suffix(rows, categories, "element").groupBy("doc_id", "category", "severity", "policy").agg(F.count("*").alias("uses"))


def q_identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # some ids and some texts differ, so that there are added, removed and changed rows
    left = docs.select(F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2("text", 256).alias("digest"))
    right = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return integrity.identity_diff(left, right, "doc_id", "digest")


QUERIES = [q_blocks, q_fingerprint, q_unit_fingerprint, q_doc_stats, q_page_blocks, q_style_usage, q_format_clusters, q_excerpt, q_normalised_markers, q_finding_dedup, q_finding_summary, q_broken_links, q_unsafe_elements, q_identity_diff]

_LINES = "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents"
_TAGS = r"""SELECT page_id, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS ord FROM (
  SELECT page_id, place, lower(regexp_extract(piece, '^([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, CASE WHEN contains(piece, '>') THEN substr(piece, strpos(piece, '>') + 1) END AS text
  FROM (SELECT page_id, unnest(string_split(html, '<')) AS piece, generate_subscripts(string_split(html, '<'), 1) AS place FROM pages) WHERE place > 1) WHERE text IS NOT NULL AND tag IN ('title', 'h1', 'h2', 'h3', 'p', 'li', 'a', 'div', 'footer')"""
_STYLE = "CASE tag WHEN 'title' THEN 'Title' WHEN 'h1' THEN 'heading 1' WHEN 'h2' THEN 'heading 2' WHEN 'h3' THEN 'heading 3' WHEN 'p' THEN 'Normal' WHEN 'li' THEN 'List' WHEN 'a' THEN 'toc 1' ELSE tag END"
_PRINT = """'[' || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
  lambda x: '{"kind":"paragraph","text":' || to_json(x) || '}'), ',') || ']'"""

ORACLES = {
    "q_blocks": f"SELECT doc_id, CAST(ord AS BIGINT) AS ord, printf('p-%04d', ord) AS block_id, sha256(line) AS text_sha256, CAST(length(line) AS BIGINT) AS n_chars FROM ({_LINES})",
    "q_fingerprint": f"SELECT doc_id, sha256({_PRINT}) AS fingerprint, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS unit_count, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS total_chars FROM documents",
    "q_unit_fingerprint": f"""SELECT doc_id, sha256('[' || string_agg('{{"kind":"paragraph","text":' || to_json(line) || '}}', ',' ORDER BY ord) || ']') AS fingerprint, count(*) AS unit_count, CAST(sum(length(line)) AS BIGINT) AS total_chars FROM ({_LINES}) WHERE line <> '' GROUP BY doc_id""",
    "q_doc_stats": "SELECT lang, source, count(*) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS blocks, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = ''))) AS BIGINT) AS blank_blocks, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang, source",
    "q_page_blocks": f"SELECT page_id, CAST(ord AS BIGINT) AS ord, printf('p-%04d', ord) AS block_id, tag, {_STYLE} AS style, sha256(text) AS text_sha256 FROM ({_TAGS})",
    "q_style_usage": f"SELECT page_id, {_STYLE} AS style, count(*) AS uses, array_to_string(list_slice(list(ord ORDER BY ord), 1, 5), ',') AS first_indexes FROM ({_TAGS}) GROUP BY page_id, 2",
    "q_format_clusters": "SELECT lang, source, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'middle' WHEN length(text) < 8000 THEN 'long' ELSE 'very long' END AS size, contains(text, chr(10)) AS multi, count(*) AS uses, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') AS first_indexes FROM documents GROUP BY ALL",
    "q_excerpt": r"""SELECT conv_id, turn, reason, CASE WHEN length(t) <= 120 THEN t WHEN reason = 'previous' THEN '…' || right(t, 119) WHEN reason = 'target' THEN substr(t, 1, 80) || '…' || right(t, 39) ELSE substr(t, 1, 119) || '…' END AS excerpt
      FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'previous' ELSE 'next' END AS reason, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""",
    "q_finding_dedup": f"""SELECT doc_id, printf('unsupported-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY severity, message)) AS finding_id, severity, message, seq
      FROM (SELECT lang || '/' || source AS doc_id, CASE WHEN length(line) < 20 THEN 'warning' ELSE 'info' END AS severity, sha256(line) AS message, min(doc_id * 100000 + ord) AS seq FROM ({_LINES}) AS l GROUP BY 1, 2, 3)""",
    "q_finding_summary": f"""SELECT page_id AS doc_id, count(*) AS objects, count(*) FILTER (tag = 'footer') AS errors, count(*) FILTER (tag = 'div') AS warnings, count(*) FILTER (tag NOT IN ('footer', 'div')) AS infos,
      NOT bool_or(tag = 'footer' AND contains(text, '&middot;')) AS safe FROM ({_TAGS}) GROUP BY page_id""",
    "q_broken_links": """SELECT doc_id, ord, href FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, CAST(generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS BIGINT) AS ord FROM pages)
      WHERE href NOT IN (SELECT '/' || regexp_extract(html, '<title>([^ <]*)', 1) FROM pages)""",
    "q_unsafe_elements": """SELECT doc_id, category, severity, policy, count(*) AS uses FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<([a-z]+)', 1)) AS element FROM pages)
      JOIN (VALUES ('script', 'active_content', 'error', 'block_formatting'), ('style', 'style_sheet', 'warning', 'manual_review'), ('iframe', 'embedded_object', 'error', 'block_formatting'), ('nav', 'navigation', 'info', 'none')) AS c(suffix, category, severity, policy)
      ON ends_with(element, suffix) GROUP BY ALL""",
    "q_identity_diff": """SELECT doc_id, a AS left_digest, b AS right_digest, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, sha256(text) AS a FROM documents) FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS b FROM documents) USING (doc_id) WHERE a IS DISTINCT FROM b""",
}
