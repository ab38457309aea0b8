"""Queries of the structural classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import classify
from foliary.plans.documents import _STYLE, _TAGS, table
from foliary.sources import html


def abstract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as documents: a user's events are a document's blocks, their types what the blocks would do."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    event = F.when(kind == "signup", "mark").when(kind == "purchase", "abs").when(kind == "view", "head").when((kind == "error") & (F.col("k") % 5 == 0), "cover")
    mark = F.element_at(F.array(*map(F.lit, ("toc", "references", "appendix", "abstract_en"))), F.col("k") % 4 + 1)
    target = F.when(kind == "signup", mark).when(kind == "purchase", F.when(F.col("k") % 2 == 0, "abstract_en").otherwise("abstract_zh"))
    level = F.when(kind == "view", F.col("k") % 4 + 1)
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.concat(F.lit("e-"), "event_id").alias("block_id"), event.alias("event"), target.alias("target"), level.alias("level"), (F.col("k") % 7 == 0).alias("tail"), (F.col("k") % 3 == 0).alias("blocks_cover"))


def q_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.regions(abstract_events(spark, sf_dir)).select("doc_id", "ord", "region_before", "region", "section_id")


def q_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.regions(abstract_events(spark, sf_dir)).select("doc_id", "ord", "parent_id", F.col("level_jump").alias("level_jump"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html.tag_blocks(table(spark, sf_dir, "pages")).withColumnRenamed("style", "style_name")
    return classify.classify(blocks.select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", "style_name", "text"))


def q_role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("doc_id", "ord", "role", "scope", "reason", "confidence", "review", "region", "parent_id")


def q_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).groupBy("role", "scope", "review").agg(F.count("*").alias("blocks"), F.count_distinct("doc_id").alias("documents"))


def q_scope_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 4 > 0, F.floor(F.col("event_id") / 1000)).alias("section_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("scope"), F.col("event_id").alias("ord"), (F.col("event_id") % 9 == 0).alias("review"))
    return classify.scope_position(rows).select("doc_id", "ord", F.col("position").cast("long").alias("position"))


def q_review_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("block_id"), F.when(F.col("l_linenumber") > 1, F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") / 2).cast("int"))).alias("container_id"), (F.col("l_returnflag") == "R").alias("review"))
    return classify.review_roots(items).select("doc_id", "block_id")


QUERIES = [q_regions, q_parents, q_role_map, q_role_counts, q_scope_position, q_review_roots]

_EVENTS = """e AS (SELECT user_id AS doc_id, event_id AS ord, 'e-' || event_id AS block_id, k % 7 = 0 AS tail, k % 3 = 0 AS held,
    CASE event_type WHEN 'signup' THEN 'mark' WHEN 'purchase' THEN 'abs' WHEN 'view' THEN 'head' WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'cover' END END AS event,
    CASE event_type WHEN 'signup' THEN ['toc', 'references', 'appendix', 'abstract_en'][k % 4 + 1] WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'abstract_en' ELSE 'abstract_zh' END END AS target,
    CASE event_type WHEN 'view' THEN k % 4 + 1 END AS level FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
  a AS (SELECT *, event IN ('mark', 'abs', 'head') AND NOT (tail AND coalesce(last_value(CASE WHEN event IN ('mark', 'abs', 'head') AND NOT tail THEN CASE WHEN event = 'mark' AND target = 'toc' THEN 1 ELSE 0 END END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS live FROM e),
  b AS (SELECT *, last_value(CASE WHEN live THEN event END IGNORE NULLS) OVER w AS now, last_value(CASE WHEN live AND event <> 'head' THEN target END IGNORE NULLS) OVER w AS sect FROM a
    WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, CASE WHEN now IS NULL THEN 'preamble' WHEN now <> 'head' THEN sect WHEN sect = 'appendix' THEN 'appendix' ELSE 'body' END AS base FROM b),
  d AS (SELECT *, max(CASE WHEN event = 'cover' AND base IN ('preamble', 'cover') AND NOT held THEN 1 ELSE 0 END) OVER w AS seen FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  f AS (SELECT *, CASE WHEN base = 'preamble' AND seen = 1 THEN 'cover' ELSE base END AS region, coalesce(event = 'cover' AND base IN ('preamble', 'cover') AND (NOT held OR base = 'cover' OR seen = 1), false) AS is_cover FROM d),
  g AS (SELECT *, lag(region, 1, 'preamble') OVER (PARTITION BY doc_id ORDER BY ord) AS region_before FROM f),
  h AS (SELECT *, coalesce(live, false) AS lv, coalesce(live AND (event = 'mark' OR (event = 'abs' AND target <> region_before)), false) OR is_cover AS anchor FROM g),
  i AS (SELECT *, coalesce(lv AND event = 'head' AND region <> 'appendix', false) AS clears FROM h),
  j AS (SELECT *, nullif(last_value(CASE WHEN anchor THEN block_id WHEN clears THEN '' END IGNORE NULLS) OVER w, '') AS section_id, sum(CASE WHEN anchor THEN 1 ELSE 0 END) OVER w AS epoch FROM i
    WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_PARENTS = (
    "k AS (SELECT *, "
    + ", ".join(f"last_value(CASE WHEN lv AND event = 'head' AND level < {n} THEN block_id END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN lv AND event = 'head' AND level < {n} THEN level END IGNORE NULLS) OVER w AS l{n}" for n in (2, 3, 4, 5))
    + " FROM j WINDOW w AS (PARTITION BY doc_id, epoch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "m AS (SELECT *, lv AND coalesce(event = 'head', false) AS heading FROM k)"
)
_ROLES = rf"""t AS (SELECT page_id AS doc_id, ord, printf('p-%04d', ord) AS block_id, {_STYLE} AS style, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS x FROM ({_TAGS})),
  u AS (SELECT *, style LIKE 'heading _' AND x <> '' AS styled, length(x) > 100 OR regexp_matches(x, '[。！？；;!?]') AS odd,
    CASE WHEN length(x) <= 100 AND NOT regexp_matches(x, '[。！？；;!?]') THEN len(string_split(nullif(regexp_extract(x, '^(\d+(?:\.\d+){{0,3}})(?:[、.]?\s+)\S', 1), ''), '.')) END AS num FROM t),
  v AS (SELECT *, CASE WHEN styled THEN CAST(style[9:9] AS INTEGER) END AS lvl FROM u),
  y AS (SELECT *, coalesce(styled AND NOT odd AND coalesce(num = lvl, true), false) AS opens FROM v),
  z AS (SELECT *, coalesce(bool_or(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside,
    last_value(CASE WHEN opens THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM y),
  r AS (SELECT *, CASE WHEN style = 'toc 1' THEN 'toc_style' WHEN x = '' THEN 'empty_paragraph' WHEN styled THEN 'heading_style' || CASE WHEN coalesce(num <> lvl, false) THEN '+heading_level_conflict' ELSE '' END || CASE WHEN odd THEN '+heading_looks_like_sentence' ELSE '' END
    WHEN num IS NOT NULL THEN 'numbering_only_candidate' WHEN inside THEN 'section_context' ELSE 'insufficient_structure_evidence' END AS reason FROM z),
  s AS (SELECT doc_id, ord, CASE reason WHEN 'toc_style' THEN 'table_of_contents' WHEN 'empty_paragraph' THEN 'unknown' WHEN 'numbering_only_candidate' THEN 'heading_' || num WHEN 'section_context' THEN 'body' WHEN 'insufficient_structure_evidence' THEN 'unknown' ELSE 'heading_' || lvl END AS role,
    CASE reason WHEN 'toc_style' THEN 'toc_entry' WHEN 'empty_paragraph' THEN NULL WHEN 'numbering_only_candidate' THEN 'heading_' || num WHEN 'section_context' THEN 'body' WHEN 'insufficient_structure_evidence' THEN NULL ELSE 'heading_' || lvl END AS scope, reason,
    CAST(CASE reason WHEN 'toc_style' THEN 0.95 WHEN 'empty_paragraph' THEN 0 WHEN 'numbering_only_candidate' THEN 0.6 WHEN 'section_context' THEN 0.9 WHEN 'insufficient_structure_evidence' THEN 0 WHEN 'heading_style' THEN 0.95 ELSE 0.55 END AS DOUBLE) AS confidence,
    reason NOT IN ('toc_style', 'empty_paragraph', 'section_context', 'heading_style') AS review, CASE WHEN inside OR opens THEN 'body' ELSE 'preamble' END AS region, CASE WHEN opens AND lvl = 1 THEN NULL ELSE above END AS parent_id FROM r)"""

ORACLES = {
    "q_regions": f"WITH {_EVENTS} SELECT doc_id, ord, region_before, region, section_id FROM j",
    "q_parents": f"""WITH {_EVENTS}, {_PARENTS} SELECT doc_id, ord, CASE WHEN heading THEN coalesce(CASE level WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 END, section_id) WHEN section_id = block_id THEN NULL ELSE coalesce(p5, section_id) END AS parent_id,
      heading AND level > coalesce(CASE level WHEN 2 THEN l2 WHEN 3 THEN l3 WHEN 4 THEN l4 END, 0) + 1 AS level_jump FROM m""",
    "q_role_map": f"WITH {_ROLES} SELECT * FROM s",
    "q_role_counts": f"WITH {_ROLES} SELECT role, scope, review, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM s GROUP BY role, scope, review",
    "q_scope_position": """SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, section_id, scope ORDER BY ord) - 1 AS position FROM (SELECT user_id AS doc_id, CASE WHEN event_id % 4 > 0 THEN event_id // 1000 END AS section_id, event_type AS scope, event_id AS ord FROM events WHERE event_type <> 'error' AND event_id % 9 <> 0)""",
    "q_review_roots": """SELECT l_orderkey AS doc_id, l_orderkey || '-' || l_linenumber AS block_id FROM lineitem AS l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem AS p WHERE p.l_orderkey = l.l_orderkey AND p.l_returnflag = 'R' AND l.l_linenumber > 1 AND p.l_linenumber = l.l_linenumber // 2)""",
}
