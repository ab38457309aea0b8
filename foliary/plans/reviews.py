"""Queries of review plans, proposals, adjudication, evaluation, jobs and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import evaluate, jobs, review
from foliary.plans.conformance import _OBS, checks
from foliary.plans.documents import table
from foliary.plans.structure import _ROLES, decisions
from foliary.sources import docx


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("ord"), F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")).alias("text"), (F.col("role") == "user").alias("styled"), F.when(F.col("turn") > 3, F.lit(1).cast("long")).alias("parent_ord"))


def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.context_window(_turns(spark, sf_dir), "conv_id")
    return rows.select("conv_id", "ord", "context_ord", F.col("score").cast("long").alias("score"), "reason")


def q_context_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    rows = review.context_excerpts(review.context_window(turns, "conv_id"), turns, "conv_id", 60)
    return rows.select("conv_id", "ord", "context_ord", "reason", "excerpt", "truncated")


def q_review_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_type")
    rows = e.select("event_id", F.when(k == "view", "paragraph").when(k == "click", "table").when(k == "error", "image").otherwise("table_cell").alias("kind"), (F.col("event_id") % 13 == 0).alias("unsupported"), F.when(F.col("event_id") % 17 == 0, "  ").otherwise(F.col("props")).alias("text"))
    return review.review_plan(rows).groupBy("kind", F.coalesce("skip_reason", F.lit("packet")).alias("outcome")).agg(F.count("*").alias("targets"))


def q_proposal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    listed = lambda *x: F.array(*map(F.lit, x))
    packets = e.select(F.col("event_id").alias("packet_id"), F.col("user_id").alias("target"), F.col("event_type").alias("text_sha256"), listed("body", "cover", "heading_1").alias("allowed_roles"), listed("body", "cover_title", "heading_1").alias("allowed_scopes"), listed("a", "b").alias("context_ids"))
    k = F.col("k")
    proposals = e.select(
        F.col("event_id").alias("packet_id"), F.when(k % 11 == 0, -1).otherwise(F.col("user_id")).alias("target"), F.when(k % 13 == 0, "old").otherwise(F.col("event_type")).alias("text_sha256"), (k % 7 == 0).alias("abstained"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "table").when(k % 5 == 2, "cover").otherwise("body").alias("role"), F.when(k % 3 == 0, "body").when(k % 3 == 1, "equation").alias("scope"),
        F.when(k % 2 == 0, listed("a")).otherwise(listed("a", "c")).alias("evidence_ids"),
    )
    rows = review.proposal_violations(proposals, packets)
    return rows.groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count("*").alias("proposals"), F.sum("packet_id").alias("ids"))


def q_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    calls = e.select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("k").alias("input_tokens"), (F.col("k") % 10).alias("output_tokens"), F.when(F.col("k") % 2 == 0, F.col("k") * 2).alias("total_tokens"), (F.col("event_id") % 1000).alias("elapsed_ms"), F.when(F.col("user_id") % 3 > 0, F.col("k") * 5).alias("cost"))
    return review.run_totals(calls, ["user_id"])


def _systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two predictors of quality over documents: one looks at signs, the other at length."""
    d = table(spark, sf_dir, "documents")
    signs = F.regexp_count("text", F.lit("[#*$%&|]")) * 20 > F.char_length("text")
    shout = F.col("text").rlike("[A-Z]{3}!!")
    rules = d.select("doc_id", F.when(signs | shout, "body").when(F.char_length("text") < 60, F.lit(None)).otherwise("list_item").alias("rules_role"), F.lit(None).cast("string").alias("rules_scope"))
    n = F.char_length("text")
    model = d.where("doc_id % 10 <> 3").select("doc_id", F.when(signs, "body").when(n % 17 == 0, "cover").otherwise("list_item").alias("model_role"), F.when(n % 2 == 0, "body").alias("model_scope"), (F.lit(0.5) + (n % 50) / F.lit(100.0)).alias("confidence"), (n % 19 == 0).alias("abstained"))
    return rules, model


def q_adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.adjudicate(*_systems(spark, sf_dir), ["doc_id"], 0.8)
    return rows.select("doc_id", "outcome", F.array_join("reasons", ",").alias("reasons"), "selected_role", "selected_scope")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "list_item").otherwise("body").alias("expected_role"), F.when(F.col("toxic") == 0, "body").alias("expected_scope"))


def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both predictors are read and joined once; a row then speaks for all three systems
    rows = review.adjudicate(*_systems(spark, sf_dir), ["doc_id"], 0.8, given=True)
    g = lambda c: F.col(f"given.{c}")
    say = lambda system, role, scope, abstained: F.struct(F.lit(system).alias("system"), role.alias("role"), scope.alias("scope"), abstained.alias("abstained"))
    model = F.when(g("proposed"), say("model_proposal", g("model_role"), g("model_scope"), g("abstained")))
    all_ = F.array(say("rules_only", g("rules_role"), g("rules_scope"), g("rules_role").isNull()), model, say("hybrid", F.col("selected_role"), F.col("selected_scope"), F.col("outcome") != "auto_accept"))
    made = rows.select("doc_id", F.explode(F.array_compact(all_)).alias("x")).select("doc_id", "x.*")
    return evaluate.evaluate(_gold(spark, sf_dir), made, ["doc_id"], ["rules_only", "model_proposal", "hybrid"])


def q_gold_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.format_string("p-%04d", "doc_id").alias("block_id"), F.sha2("text", 256).alias("text_sha256"), (F.char_length("text") < 100).alias("short"))
    made = evaluate.gold_template(d.where("not short"), d.where("short"))
    known = _gold(spark, sf_dir).select("doc_id", "expected_role")
    return made.join(known, "doc_id", "left").select("doc_id", "block_id", "text_sha256", "origin", F.when(F.col("expected_role").isNull(), F.col("status")).otherwise("confirmed").alias("status"))


def q_gold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(_gold(spark, sf_dir), "doc_id", "left")
    counts = d.groupBy("lang", "source").agg(F.count("*").alias("targets"), F.count("expected_role").alias("confirmed"))
    return counts.withColumn("status", evaluate.status(F.col("confirmed"), F.col("targets")))


def q_diagnosis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions(spark, sf_dir)
    made = checks(spark, sf_dir).select((F.col("l_orderkey") % 250).alias("doc_id"), "status")
    return jobs.diagnosis(found, made).select("doc_id", "blocks", "review_count", "status_counts")


def q_review_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "figure").otherwise("sections").alias("trigger"))
    return jobs.review_guide(facts).select("doc_id", "category")


def q_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when((k == "error") & (F.col("event_id") % 100 == 0), "failed").when(k == "view", "analyzed").when(k == "click", "formatted").when(k == "purchase", "validated").otherwise("created").alias("event"))
    return jobs.job_states(e)


def q_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.concat(F.lit("a/"), "event_id").alias("path"), F.sha2("props", 256).alias("sha256"))
    return jobs.latest_artifacts(e)


def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("in/"), "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, ".pdf").otherwise(".docx")).alias("path"), F.when(F.col("o_orderkey") % 8 == 0, 0).otherwise((F.col("o_totalprice") * 150).cast("long")).alias("length"))
    return jobs.intake(files).select("path", "name", "accepted", "reject_code")


def q_docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages built from all documents with their whole texts, written nowhere: scanned, classified and fingerprinted."""
    packages = docx.synthetic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    blocks = docx.blocks(packages)
    return blocks.groupBy("doc_id").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "table_cell").alias("cells"), F.max("style_name").alias("style_name"))


def q_docx_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = docx.synthetic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docx.package_report(packages).groupBy("error").agg(F.count("*").alias("packages"), F.min("parts").alias("parts"))


QUERIES = [q_context_window, q_context_excerpts, q_review_plan, q_proposal_validation, q_run_totals, q_adjudicate, q_evaluate, q_gold_template, q_gold_status, q_diagnosis_summary, q_review_guide, q_job_states, q_artifacts, q_intake, q_docx_scan, q_docx_limits]

_TURNS = "t AS (SELECT conv_id, turn AS ord, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text, role = 'user' AS styled, CASE WHEN turn > 3 THEN 1 END AS parent FROM conversations)"
_CONTEXT = f"""{_TURNS}, n AS (SELECT a.conv_id, a.ord, b.ord AS context_ord, 60 - 10 * abs(a.ord - b.ord) + CASE WHEN b.styled THEN 15 ELSE 0 END AS score, CASE WHEN b.ord < a.ord THEN 'previous' ELSE 'next' END AS reason, abs(a.ord - b.ord) AS dist, 2 * abs(a.ord - b.ord) + CASE WHEN b.ord > a.ord THEN 1 ELSE 0 END AS seq
    FROM t AS a JOIN t AS b ON a.conv_id = b.conv_id AND a.ord <> b.ord AND abs(a.ord - b.ord) <= 2 AND trim(b.text) <> ''
    UNION ALL SELECT a.conv_id, a.ord, b.ord, 80, 'parent_heading', abs(a.ord - b.ord), 0 FROM t AS a JOIN t AS b ON a.conv_id = b.conv_id AND b.ord = a.parent AND a.ord <> b.ord AND trim(b.text) <> ''),
  u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, ord, context_ord ORDER BY score DESC, seq) AS best FROM n), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, ord ORDER BY score DESC, dist, seq) AS rank FROM u WHERE best = 1)"""
_SIGNS = "len(regexp_extract_all(text, '[#*$%&|]')) * 20 > length(text)"
_RULES = f"r AS (SELECT doc_id, CASE WHEN {_SIGNS} OR regexp_matches(text, '[A-Z]{{3}}!!') THEN 'body' WHEN length(text) < 60 THEN NULL ELSE 'list_item' END AS rr FROM documents)"
_MODEL = f"""m AS (SELECT doc_id, CASE WHEN {_SIGNS} THEN 'body' WHEN length(text) % 17 = 0 THEN 'cover' ELSE 'list_item' END AS mr, CASE WHEN length(text) % 2 = 0 THEN 'body' END AS ms0, CAST(0.5 AS DOUBLE) + (length(text) % 50) / CAST(100 AS DOUBLE) AS conf, length(text) % 19 = 0 AS abst FROM documents WHERE doc_id % 10 <> 3)"""
_JUDGED = f"""{_RULES}, {_MODEL}, j AS (SELECT r.doc_id, rr, mr, ms0, conf, abst, m.doc_id IS NOT NULL AS made, CASE WHEN rr IS NOT NULL THEN 'body' END AS rs, coalesce(ms0, CASE WHEN mr <> 'cover' THEN 'body' END) AS ms FROM r LEFT JOIN m USING (doc_id)),
  x AS (SELECT *, list_filter([CASE WHEN rs IS NOT NULL THEN 'rules_scope_derived_from_unique_role_scope' END, CASE WHEN NOT made THEN 'model_proposal_missing' END, CASE WHEN made AND ms0 IS NULL AND ms IS NOT NULL THEN 'model_scope_derived_from_unique_role_scope' END, CASE WHEN made AND abst THEN 'model_abstained' END,
    CASE WHEN made AND conf < 0.8 THEN 'model_confidence_below_threshold' END, CASE WHEN made AND rr IS NULL THEN 'rules_role_unresolved' END, CASE WHEN made AND rr IS DISTINCT FROM mr THEN 'role_disagreement' END, CASE WHEN made AND (rs IS NULL OR ms IS NULL) THEN 'scope_unresolved' END, CASE WHEN made AND rs <> ms THEN 'scope_disagreement' END], lambda z: z IS NOT NULL) AS why FROM j),
  y AS (SELECT *, made AND NOT abst AND conf >= 0.8 AND rr IS NOT NULL AND rr IS NOT DISTINCT FROM mr AND rs IS NOT NULL AND ms IS NOT NULL AND rs = ms AS ok FROM x)"""

ORACLES = {
    "q_context_window": f"WITH {_CONTEXT} SELECT conv_id, ord, context_ord, score, reason FROM v WHERE rank <= 2",
    "q_context_excerpts": rf"""WITH {_CONTEXT}, w AS (SELECT v.conv_id, v.ord, v.context_ord, v.reason, trim(regexp_replace(t.text, '\s+', ' ', 'g')) AS s FROM v JOIN t ON t.conv_id = v.conv_id AND t.ord = v.context_ord WHERE rank <= 2)
      SELECT conv_id, ord, context_ord, reason, CASE WHEN length(s) <= 60 THEN s WHEN reason = 'previous' THEN '…' || right(s, 59) ELSE substr(s, 1, 59) || '…' END AS excerpt, length(s) > 60 AS truncated FROM w""",
    "q_review_plan": "SELECT kind, CASE WHEN event_id % 13 = 0 THEN 'unsupported_object' WHEN kind = 'image' THEN 'unsupported_kind' WHEN event_id % 17 = 0 THEN 'no_text_evidence' ELSE 'packet' END AS outcome, count(*) AS targets FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'paragraph' WHEN 'click' THEN 'table' WHEN 'error' THEN 'image' ELSE 'table_cell' END AS kind FROM events) GROUP BY ALL",
    "q_proposal_validation": """SELECT CASE WHEN k % 11 = 0 THEN 'other_packet' WHEN k % 13 = 0 THEN 'stale_text_hash' WHEN k % 7 = 0 THEN 'valid' WHEN k % 5 = 0 THEN 'role_omitted' WHEN k % 5 = 1 THEN 'role_not_allowed' WHEN k % 3 = 1 THEN 'scope_not_allowed'
      WHEN k % 3 = 0 AND k % 5 = 2 THEN 'scope_incompatible' WHEN k % 2 = 1 THEN 'evidence_outside_context' ELSE 'valid' END AS violation, count(*) AS proposals, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""",
    "q_run_totals": """SELECT user_id, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN bool_and(event_type <> 'error') THEN 'completed' WHEN bool_and(event_type = 'error') THEN 'failed' ELSE 'partial' END AS status, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k % 10) AS BIGINT) AS output_tokens,
      CAST(sum(CASE WHEN k % 2 = 0 THEN k * 2 ELSE k + k % 10 END) AS BIGINT) AS total_tokens, CAST(sum(event_id % 1000) AS BIGINT) AS elapsed_ms, CASE WHEN user_id % 3 > 0 THEN CAST(sum(k * 5) AS BIGINT) END AS cost FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""",
    "q_adjudicate": f"WITH {_JUDGED} SELECT doc_id, CASE WHEN ok THEN 'auto_accept' ELSE 'manual_review' END AS outcome, array_to_string(CASE WHEN ok THEN list_append(why, 'rules_and_model_agree') ELSE why END, ',') AS reasons, CASE WHEN ok THEN mr END AS selected_role, CASE WHEN ok THEN ms END AS selected_scope FROM y",
    "q_evaluate": f"""WITH {_JUDGED}, p AS (SELECT 'rules_only' AS system, doc_id, rr AS role, rs AS scope, rr IS NULL AS silent FROM r LEFT JOIN (SELECT doc_id, rs FROM j) USING (doc_id) UNION ALL SELECT 'model_proposal', doc_id, mr, ms0, abst FROM m UNION ALL SELECT 'hybrid', doc_id, mr, ms, NOT ok FROM y),
      g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'list_item' ELSE 'body' END AS er, CASE WHEN toxic = 0 THEN 'body' END AS es FROM labels), s AS (SELECT DISTINCT system FROM p),
      c AS (SELECT s.system, er, es, role, scope, coalesce(silent, true) OR role IS NULL AS q FROM g CROSS JOIN s LEFT JOIN p ON p.system = s.system AND p.doc_id = g.doc_id),
      f AS (SELECT system, count(*) AS evaluated, count(*) FILTER (NOT q) AS predicted, count(*) FILTER (NOT q AND role = er) AS correct_role, count(*) FILTER (NOT q AND es IS NOT NULL) AS scope_evaluated, count(*) FILTER (NOT q AND es IS NOT NULL AND coalesce(scope = es, false)) AS correct_scope, count(*) FILTER (q) AS abstained,
        count(*) FILTER (NOT q AND role = 'unknown') AS "unknown", count(*) FILTER (q OR role <> er OR (es IS NOT NULL AND coalesce(scope <> es, true))) AS disagreements FROM c GROUP BY system)
      SELECT *, CAST(predicted AS DOUBLE) / evaluated AS coverage, CAST(correct_role AS DOUBLE) / evaluated AS accuracy, CAST(correct_role AS DOUBLE) / nullif(predicted, 0) AS precision, CAST(correct_role AS DOUBLE) / evaluated AS recall, CAST(correct_scope AS DOUBLE) / nullif(scope_evaluated, 0) AS scope_accuracy,
      CASE WHEN correct_role > 0 THEN 2 * (CAST(correct_role AS DOUBLE) / predicted) * (CAST(correct_role AS DOUBLE) / evaluated) / (CAST(correct_role AS DOUBLE) / predicted + CAST(correct_role AS DOUBLE) / evaluated) END AS f1 FROM f""",
    "q_gold_template": "SELECT d.doc_id, printf('p-%04d', d.doc_id) AS block_id, sha256(text) AS text_sha256, CASE WHEN length(text) < 100 THEN 'skipped' ELSE 'packet' END AS origin, CASE WHEN l.doc_id IS NULL THEN 'unassessed' ELSE 'confirmed' END AS status FROM documents AS d LEFT JOIN labels AS l USING (doc_id)",
    "q_gold_status": "SELECT lang, source, count(*) AS targets, count(l.doc_id) AS confirmed, CASE WHEN count(l.doc_id) = 0 THEN 'no_confirmed_labels' WHEN count(l.doc_id) = count(*) THEN 'complete_gold_set' ELSE 'partial_gold_set' END AS status FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id GROUP BY lang, source",
    "q_diagnosis_summary": f"""WITH {_ROLES}, {_OBS}, b AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (review) AS review_count FROM s GROUP BY doc_id), n AS (SELECT l_orderkey % 250 AS doc_id, status, count(*) AS n FROM c GROUP BY 1, 2),
      p AS (SELECT doc_id, string_agg(status || '=' || n, ';' ORDER BY status) AS status_counts FROM n GROUP BY doc_id) SELECT b.doc_id, blocks, review_count, status_counts FROM b LEFT JOIN p ON p.doc_id = b.doc_id""",
    "q_review_guide": """SELECT DISTINCT doc_id, category FROM (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'R' THEN 'table_pagination' WHEN 'A' THEN 'figure_pagination' ELSE 'section_page_numbering' END AS category FROM lineitem UNION ALL SELECT l_orderkey, 'final_layout' FROM lineitem)""",
    "q_job_states": """WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 100 = 0 THEN 'failed' WHEN event_type = 'view' THEN 'analyzed' WHEN event_type = 'click' THEN 'formatted' WHEN event_type = 'purchase' THEN 'validated' ELSE 'created' END AS event FROM events),
      l AS (SELECT job_id, arg_max(event, seq) AS event, max(seq) AS seq, bool_or(event = 'failed') AS bad FROM e GROUP BY job_id) SELECT job_id, CASE WHEN bad THEN 'failed' WHEN event = 'validated' THEN 'completed' WHEN event IN ('analyzed', 'formatted') THEN 'awaiting_confirmation' ELSE 'analyzing' END AS state, seq FROM l""",
    "q_artifacts": "SELECT user_id AS job_id, event_type AS kind, 'a/' || arg_max(event_id, event_id) AS path, sha256(arg_max(props, event_id)) AS sha256 FROM events GROUP BY 1, 2",
    "q_intake": """SELECT path, path[4:] AS name, code IS NULL AS accepted, code AS reject_code FROM (SELECT 'in/' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '.pdf' ELSE '.docx' END AS path,
      CASE WHEN o_orderkey % 9 = 0 THEN 'unsupported_extension' WHEN o_orderkey % 8 = 0 THEN 'empty_upload' WHEN trunc(o_totalprice * 150) > 52428800 THEN 'upload_too_large' END AS code FROM orders)""",
}
