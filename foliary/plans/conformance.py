"""Queries of the rule engine, evidence profiling and formatting plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import evidence, format_plan, integrity, jobs, rules
from foliary.plans.documents import table

#: Rows that Spark and the oracle both read: the text of a relation with its columns.
RULES = """(VALUES ('r-size', 'run.size_pt', 12.0, 'pt', 'gte', 0.0, 'confirmed', 'numeric_compare'), ('r-before', 'paragraph.space_before_pt', 4.0, 'pt', 'lte', 0.5, 'confirmed', 'numeric_compare'),
  ('r-after', 'paragraph.space_after_pt', 2.0, 'pt', 'eq', 0.25, 'confirmed', 'exact_equal'), ('r-width', 'page.width_mm', 210.0, 'mm', 'eq', 0.1, 'provisional', 'numeric_compare'),
  ('r-left', 'paragraph.left_indent_pt', 5.0, 'mm', 'eq', 0.0, 'confirmed', 'numeric_compare'), ('r-right', 'paragraph.right_indent_pt', 5.0, 'pt', 'eq', 0.0, 'confirmed', 'pixel_compare'),
  ('r-none', 'table.top_pt', 1.5, 'pt', 'eq', 0.0, 'confirmed', 'exact_equal')) AS r(rule_id, property_path, expected_num, unit, comparison, tolerance, status, validator)"""
EVIDENCE = """(VALUES ('t1', 0, 'template_observation', '0.5pt'), ('t1', 1, 'school_comment', '1pt'), ('t2', 0, 'template_observation', '0.5pt'), ('t3', 0, 'school_comment', '1pt'), ('t3', 1, 'written_spec', '2pt'),
  ('t4', 0, 'template_observation', '0.5pt'), ('t4', 1, 'template_observation', '2pt'), ('t5', 0, NULL, NULL), ('t6', 0, 'written_spec', '1pt'), ('t6', 1, 'school_comment', '1pt')) AS e(target, pos, source_type, value)"""
CASES = """(VALUES ('North College', 'undergraduate', 'Arts', '2026'), ('South College', 'undergraduate', 'Arts', '2026'), ('North College', 'master', 'Arts', '2026'), ('North College', 'undergraduate', 'North College Law', '2026'),
  ('North College', 'undergraduate', 'Arts', '2025'), ('North College', 'undergraduate', NULL, '2026'), (NULL, NULL, NULL, NULL), (' North College ', 'undergraduate', ' Arts ', '2026')) AS c(school, education_level, college, cohort)"""
CONTRACTS = """(VALUES ('c1', 'run.size_pt', 'number', 'pt', 12.0, 'eq', 0.0, 'confirmed', true, true), ('c2', 'run.size_pt', 'number', 'mm', 12.0, 'eq', 0.0, 'provisional', false, false),
  ('c3', 'run.bold', 'text', NULL, NULL, 'eq', 0.0, 'provisional', false, false), ('c4', 'run.font_latin', 'text', NULL, NULL, 'gte', 0.5, 'provisional', false, true), ('c5', 'page.width_mm', 'number', 'mm', 210.0, 'eq', -1.0, 'confirmed', false, false),
  ('c6', 'paragraph.line_spacing', 'line_spacing', NULL, 1.5, 'eq', 0.0, 'confirmed', true, false)) AS c(rule_id, property_path, kind, unit, num, comparison, tolerance, status, confirmed, auto_fixable)"""
COVERAGE = "(VALUES ('i1', 'encoded', 'c1,c2', ''), ('i2', 'partial', 'c3', 'later'), ('i3', 'deferred', '', 'later'), ('i4', 'encoded', 'c4,c9', 'later'), ('i5', 'encoded', 'c1', '')) AS v(item, state, ids, waits)"
BORDERS = """(VALUES (1, 0, 'cell', 0, 'top', 'single', 12), (1, 0, 'cell', 0, 'bottom', 'single', 8), (1, 0, 'cell', 1, 'bottom', 'single', 12), (1, 1, 'cell', 0, 'left', 'single', 4), (1, 1, 'table', NULL, 'top', 'single', 4),
  (2, 0, 'cell', 0, 'top', 'nil', 0), (2, 0, 'cell', 1, 'bottom', 'none', 0), (2, 1, 'table', NULL, 'top', 'single', 12), (2, 1, 'table', NULL, 'insideH', 'single', 8), (2, 1, 'style', NULL, 'bottom', 'single', 12), (2, 1, 'cell', 0, 'top', 'nil', 0),
  (3, 0, 'cell', 0, 'top', 'single', 12), (3, 0, 'cell', 0, 'top', 'single', 8), (3, 0, 'cell', 0, 'bottom', 'single', 8), (3, 0, 'cell', 2, 'bottom', 'single', 12), (3, 1, 'cell', 0, 'top', 'single', 12)) AS b(doc_id, table_index, scope, row_index, edge, line_style, size)"""
LAYERS = """(VALUES (1, 0, 'size_pt', 0, 'defaults', '10', 'doc_defaults'), (1, 0, 'size_pt', 1, 'style', '12', 'paragraph_style:Base'), (1, 0, 'size_pt', 2, 'style', '14', 'paragraph_style:Derived'), (1, 1, 'size_pt', 2, 'style', '14', 'paragraph_style:Derived'),
  (1, 1, 'size_pt', 9, 'direct', '15', 'direct_run'), (1, 0, 'bold', 1, 'style', 'true', 'paragraph_style:Base'), (1, 0, 'bold', 2, 'style', 'true', 'paragraph_style:Child'), (1, 1, 'bold', 1, 'style', 'true', 'paragraph_style:Base'),
  (1, 1, 'bold', 9, 'direct', 'true', 'direct_run'), (1, 2, 'bold', 1, 'style', 'true', 'paragraph_style:Base'), (1, 2, 'bold', 9, 'direct', 'false', 'direct_run'), (1, 3, 'bold', 1, 'style', 'true', 'paragraph_style:Base'), (1, 3, 'bold', 2, 'style', 'false', 'paragraph_style:Child'),
  (1, 4, 'italic', 0, 'defaults', 'true', 'doc_defaults'), (1, 4, 'italic', 2, 'style', 'true', 'character_style:Emphasis'), (1, 5, 'font_latin', 1, 'style', NULL, 'theme')) AS l(doc_id, para, prop, layer, level, value, source)"""
STYLES = """(VALUES (1, 'A', 'paragraph', NULL), (1, 'B', 'paragraph', 'A'), (1, 'C', 'paragraph', 'B'), (1, 'X', 'paragraph', 'Y'), (1, 'Y', 'paragraph', 'X'), (1, 'M', 'paragraph', 'gone'), (1, 'T', 'character', 'A'), (2, 'S', 'paragraph', 'S')) AS s(doc_id, style_id, style_type, based_on)"""


def _rules(spark: SparkSession) -> DataFrame:
    expected = rules.value("number", num=F.col("expected_num"))
    rows = spark.sql(f"SELECT * FROM {RULES}").withColumn("expected", expected.withField("unit", F.col("unit")))
    return rows.select("property_path", "rule_id", "expected", "comparison", F.col("tolerance").cast("double").alias("tolerance"), "status", "validator")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    number = lambda c, unit, ok: F.struct(F.when(ok, rules.value("number", num=c, unit=unit)).alias("actual"), ok.alias("supported"), F.when(~ok, "actual_value_hidden").alias("reason"))
    yes = F.col("l_quantity").isNotNull()
    paths = {
        "run.size_pt": number(F.col("l_quantity"), "pt", yes), "paragraph.space_before_pt": number(F.col("l_discount") * 100, "pt", F.col("l_returnflag") != "N"), "paragraph.space_after_pt": number(F.col("l_tax") * 50, "pt", yes),
        "page.width_mm": number(F.col("l_extendedprice"), "mm", yes), "paragraph.left_indent_pt": number(F.col("l_quantity"), "pt", yes), "paragraph.right_indent_pt": number(F.col("l_quantity"), "pt", yes),
    }
    rows = F.array(*[F.struct(F.lit(p).alias("property_path"), x.alias("o")) for p, x in paths.items()])
    return items.select("l_orderkey", "l_linenumber", F.explode(rows).alias("x")).select("x.property_path", "l_orderkey", "l_linenumber", "x.o.*")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check(_observations(spark, sf_dir), _rules(spark), ["property_path"])


def q_rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir).groupBy("rule_id", "status", F.col("check_reason").alias("reason")).agg(F.count("*").alias("checks"))


def q_rule_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    expected = rules.value("number", num=F.lit(50.0), unit="count")
    rule = F.struct(F.lit("confirmed").alias("status"), expected.alias("expected"), F.lit("gte").alias("comparison"), F.lit(5.0).alias("tolerance"), F.lit("numeric_compare").alias("validator"))
    observed = F.struct(F.when(k.isNotNull(), rules.value("number", num=k, unit="count")).alias("actual"), k.isNotNull().alias("supported"), F.lit(None).cast("string").alias("reason"))
    rows = table(spark, sf_dir, "events").select("event_type", rule.alias("rule"), observed.alias("observed")).withColumn("o", rules.outcome())
    return rows.groupBy("event_type", F.col("o.status").alias("status"), F.col("o.reason").alias("reason")).agg(F.count("*").alias("checks"))


def q_unapplied_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unapplied(_rules(spark), checks(spark, sf_dir)).select("rule_id", "property_path")


def q_evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.select_evidence(spark.sql(f"SELECT * FROM {EVIDENCE}"))


def q_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {CONTRACTS}").withColumns({"num": F.col("num").cast("double"), "tolerance": F.col("tolerance").cast("double")})
    return rules.contract_violations(rows)


def q_profile_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    cover = spark.sql(f"SELECT * FROM {COVERAGE}").select("item", "state", listed("ids").alias("rule_ids"), listed("waits").alias("deferred"))
    return rules.profile_integrity(spark.sql(f"SELECT rule_id FROM {CONTRACTS}"), cover)


def q_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.applicability(spark.sql(f"SELECT * FROM {CASES}"), "North College", "undergraduate", "2026", ["Law"])


def q_issue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir).select((F.col("l_orderkey") % 20).alias("doc_id"), "rule_id", "status", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return jobs.top_issues(rows, ["doc_id"], "seq").select("doc_id", "rule_id", "status", "seq", F.col("rank").cast("long").alias("rank"), "issues", "truncated")


def q_rule_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.rule_rechecks(checks(spark, sf_dir))


def q_delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    facts = o.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("content_preserved"), (F.col("o_orderkey") % 7 > 0).alias("report_matches"), (F.col("o_totalprice") > 1000).alias("package_safe"), (F.col("o_custkey") % 5).alias("unit_count"), (~F.col("o_orderpriority").startswith("1")).alias("rechecks_passed"))
    return integrity.delivery_gate(facts).groupBy("content_preserved", "report_matches", "deliverable").agg(F.count("*").alias("documents"))


def q_border_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    cells = items.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_index"), (F.col("l_linenumber") - 1).alias("row_index"), F.lit(0).alias("cell_index"), F.when(F.col("l_returnflag") == "A", 12).otherwise(0).alias("eighths"))
    return format_plan.border_operations(format_plan.desired_borders(cells), cells.withColumn("edge", F.lit("top")).groupBy("doc_id", "table_index", "row_index", "cell_index", "edge").agg(F.max("eighths").alias("eighths")))


def q_table_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.table_patterns(spark.sql(f"SELECT * FROM {BORDERS}"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", "table_index", listed("top").alias("top"), listed("header").alias("header"), listed("bottom").alias("bottom"), "vertical", "pattern", "confidence")


def q_border_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.border_tally(spark.sql(f"SELECT *, 'auto' AS color FROM {BORDERS}"))


def q_style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cascade(spark.sql(f"SELECT * FROM {LAYERS}"))


def q_style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.style_chains(spark.sql(f"SELECT * FROM {STYLES}"))


def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.functions import text as t

    k = F.col("p_size").cast("double")
    mode = F.when(F.col("p_partkey") % 3 == 0, "auto").when(F.col("p_partkey") % 3 == 1, "exact")
    return table(spark, sf_dir, "part").select("p_partkey", t.twips_to_pt(k).alias("pt"), t.twips_to_mm(k).alias("mm"), t.hundredths(k).alias("chars"), t.line_spacing(k, mode).alias("lines"), t.eighths_to_pt(k).alias("border_pt"), t.half_points(k).alias("size_pt"))


def q_section_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sections = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("section"), (F.col("p_size") * 500).alias("width"), F.lit(16838).alias("height"), F.when(F.col("p_size") > 10, F.col("p_size") * 30).alias("top"), F.col("p_size").alias("bottom"), F.lit(1440).alias("left"), F.lit(None).cast("int").alias("right"))
    rows = rules.section_observations(sections)
    return rows.groupBy("property_path", "supported").agg(F.count("*").alias("sections"), F.max("actual.num").alias("most"), F.min("actual.num").alias("least"))


QUERIES = [q_rule_checks, q_rule_props_json, q_unapplied_rules, q_evidence_select, q_contract_violations, q_profile_integrity, q_applicability, q_issue_topk, q_rule_recheck, q_delivery_gate, q_border_plan, q_table_pattern, q_border_tally, q_style_cascade, q_style_chain, q_units, q_section_observations]

_OBS = """o AS (SELECT l_orderkey, l_linenumber, unnest(['run.size_pt', 'paragraph.space_before_pt', 'paragraph.space_after_pt', 'page.width_mm', 'paragraph.left_indent_pt', 'paragraph.right_indent_pt']) AS property_path,
    unnest([l_quantity, CASE WHEN l_returnflag <> 'N' THEN l_discount * 100 END, l_tax * 50, l_extendedprice, l_quantity, l_quantity]) AS num FROM lineitem),
  k AS (SELECT l_orderkey, l_linenumber, rule_id, property_path, r.status AS rs, num, CAST(expected_num AS DOUBLE) AS e, CAST(tolerance AS DOUBLE) AS tol, comparison, validator, unit, CASE WHEN property_path LIKE '%_mm' THEN 'mm' ELSE 'pt' END AS ou FROM o JOIN """ + RULES + """ USING (property_path)),
  c AS (SELECT l_orderkey, l_linenumber, rule_id, CASE WHEN rs <> 'confirmed' THEN 'evidence_insufficient' WHEN num IS NULL OR ou <> unit OR validator = 'pixel_compare' THEN 'not_evaluated'
      WHEN CASE comparison WHEN 'eq' THEN abs(e - num) <= tol WHEN 'gte' THEN num >= e - tol ELSE num <= e + tol END THEN 'pass' ELSE 'fail' END AS status,
    CASE WHEN rs <> 'confirmed' THEN 'rule_requires_human_confirmation' WHEN num IS NULL THEN 'actual_value_hidden' WHEN ou <> unit THEN 'incompatible_value_kind_or_unit' WHEN validator = 'pixel_compare' THEN 'validator_not_implemented'
      WHEN CASE comparison WHEN 'eq' THEN abs(e - num) <= tol WHEN 'gte' THEN num >= e - tol ELSE num <= e + tol END THEN 'value_matches' ELSE 'value_differs' END AS reason FROM k)"""

_SPEC = "CASE WHEN property_path IN ('run.size_pt', 'page.width_mm') THEN 'number' WHEN property_path = 'run.bold' THEN 'boolean' WHEN property_path = 'run.font_latin' THEN 'text' ELSE 'line_spacing' END"
_NAMED = "n AS (SELECT item, unnest(string_split(ids, ',')) AS rule_id FROM " + COVERAGE + " WHERE ids <> '')"
ORACLES = {
    "q_rule_checks": f"WITH {_OBS} SELECT rule_id, status, reason, count(*) AS checks FROM c GROUP BY ALL",
    "q_rule_props_json": "SELECT event_type, CASE WHEN k IS NULL THEN 'not_evaluated' WHEN k >= 45 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN k IS NULL THEN 'actual_value_unresolved' WHEN k >= 45 THEN 'value_matches' ELSE 'value_differs' END AS reason, count(*) AS checks FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY ALL",
    "q_unapplied_rules": f"WITH {_OBS} SELECT rule_id, property_path FROM {RULES} WHERE rule_id NOT IN (SELECT rule_id FROM c)",
    "q_evidence_select": f"""WITH e AS (SELECT *, CASE WHEN source_type IN ('school_comment', 'written_spec') THEN 2 WHEN source_type IS NULL THEN 0 ELSE 1 END AS rank FROM {EVIDENCE}), b AS (SELECT *, max(rank) OVER (PARTITION BY target) AS best FROM e),
      g AS (SELECT target, max(best) AS best, count(DISTINCT value) FILTER (rank = best) AS n, arg_min(value, pos) FILTER (rank = best) AS v, arg_min(source_type, pos) FILTER (rank = best) AS s, count(source_type) AS alternatives FROM b GROUP BY target)
      SELECT target, CASE WHEN best > 0 AND n = 1 THEN 'provisional' ELSE 'needs_review' END AS status, CASE WHEN best > 0 AND n = 1 THEN v END AS selected, CASE WHEN best > 0 AND n = 1 THEN s END AS selected_source, alternatives,
      CASE WHEN best = 0 THEN 'no_evidence' WHEN n > 1 THEN 'conflicting_equal_authority_evidence' WHEN best = 2 THEN 'explicit_requirement' ELSE 'template_observation' END AS reason FROM g""",
    "q_contract_violations": f"""WITH c AS (SELECT *, {_SPEC} AS want FROM {CONTRACTS}) SELECT rule_id, 'wrong_kind' AS violation FROM c WHERE kind <> want UNION ALL SELECT rule_id, 'wrong_unit' FROM c WHERE want = 'number' AND unit IS DISTINCT FROM CASE WHEN property_path LIKE '%_mm' THEN 'mm' ELSE 'pt' END
      UNION ALL SELECT rule_id, 'negative_tolerance' FROM c WHERE tolerance < 0 UNION ALL SELECT rule_id, 'inexact_comparison' FROM c WHERE kind IN ('text', 'boolean') AND (comparison <> 'eq' OR tolerance <> 0)
      UNION ALL SELECT rule_id, 'missing_confirmation' FROM c WHERE status = 'confirmed' AND NOT confirmed UNION ALL SELECT rule_id, 'fix_without_confirmation' FROM c WHERE auto_fixable AND status <> 'confirmed'""",
    "q_profile_integrity": f"""WITH {_NAMED}, r AS (SELECT rule_id FROM {CONTRACTS}) SELECT 'rule_without_coverage' AS problem, rule_id AS item FROM r WHERE rule_id NOT IN (SELECT rule_id FROM n) UNION ALL SELECT 'coverage_of_unknown_rule', rule_id FROM n WHERE rule_id NOT IN (SELECT rule_id FROM r)
      UNION ALL SELECT 'rule_covered_twice', rule_id FROM n GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_rule_id', rule_id FROM r GROUP BY rule_id HAVING count(*) > 1
      UNION ALL SELECT 'inconsistent_state', item FROM {COVERAGE} WHERE NOT CASE state WHEN 'encoded' THEN ids <> '' AND waits = '' WHEN 'partial' THEN ids <> '' AND waits <> '' ELSE ids = '' AND waits <> '' END""",
    "q_applicability": f"""WITH c AS (SELECT *, trim(CASE WHEN starts_with(trim(coalesce(college, '')), 'North College') THEN substr(trim(college), 14) ELSE coalesce(college, '') END) AS col FROM {CASES}),
      d AS (SELECT *, CASE WHEN trim(school) <> 'North College' THEN 'different_school' WHEN education_level <> 'undergraduate' THEN 'unsupported_education_level' WHEN col = 'Law' THEN 'excluded_college' WHEN cohort <> '2026' THEN 'cohort_not_confirmed'
        WHEN school IS NULL OR education_level IS NULL OR col = '' OR cohort IS NULL THEN 'missing_applicability_information' ELSE 'confirmed_single_template_scope' END AS reason FROM c)
      SELECT school, education_level, college, cohort, CASE reason WHEN 'confirmed_single_template_scope' THEN 'applicable' WHEN 'cohort_not_confirmed' THEN 'needs_review' WHEN 'missing_applicability_information' THEN 'needs_review' ELSE 'not_applicable' END AS status, reason FROM d""",
    "q_issue_topk": f"""WITH {_OBS}, i AS (SELECT l_orderkey % 20 AS doc_id, rule_id, status, l_orderkey * 10 + l_linenumber AS seq FROM c WHERE status IN ('fail', 'evidence_insufficient')),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'fail' THEN 0 ELSE 1 END, rule_id, seq) AS rank, count(*) OVER (PARTITION BY doc_id) AS issues FROM i) SELECT *, issues > 100 AS truncated FROM n WHERE rank <= 100""",
    "q_rule_recheck": f"WITH {_OBS} SELECT rule_id, count(*) AS results, count(*) FILTER (status = 'pass') AS passes, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status NOT IN ('pass', 'fail')) AS unresolved, bool_and(status = 'pass') AS passed FROM c GROUP BY rule_id",
    "q_delivery_gate": "SELECT content_preserved, report_matches, content_preserved AND report_matches AND safe AND units > 0 AND ok AS deliverable, count(*) AS documents FROM (SELECT o_orderstatus <> 'P' AS content_preserved, o_orderkey % 7 > 0 AS report_matches, o_totalprice > 1000 AS safe, o_custkey % 5 AS units, o_orderpriority NOT LIKE '1%' AS ok FROM orders) GROUP BY ALL",
    "q_border_plan": """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS row_index, max(CASE WHEN l_returnflag = 'A' THEN 12 ELSE 0 END) AS have, max(max(l_linenumber) - 1) OVER (PARTITION BY l_orderkey) AS final FROM lineitem GROUP BY 1, 2),
      d AS (SELECT doc_id, row_index, have, unnest(['top', 'bottom', 'left', 'right']) AS edge, unnest([CASE row_index WHEN 0 THEN 12 ELSE 0 END, CASE WHEN row_index = final THEN 12 WHEN row_index = 0 THEN 8 ELSE 0 END, 0, 0]) AS want FROM c WHERE final >= 1)
      SELECT doc_id, 0 AS table_index, row_index, 0 AS cell_index, edge, CASE WHEN edge = 'top' THEN have END AS from_eighths, want AS to_eighths FROM d WHERE coalesce(CASE WHEN edge = 'top' THEN have END, 0) <> want""",
    "q_table_pattern": f"""WITH b AS (SELECT *, max(CASE WHEN scope = 'cell' THEN row_index END) OVER (PARTITION BY doc_id, table_index) AS final, size > 0 AND line_style NOT IN ('nil', 'none') AS ink, CASE scope WHEN 'cell' THEN 1 WHEN 'table' THEN 2 ELSE 3 END AS rank FROM {BORDERS}),
      e AS (SELECT doc_id, table_index, rank, size / 8.0 AS w, unnest(list_filter([CASE WHEN edge = 'top' AND (scope <> 'cell' OR row_index = 0) THEN 'top' END, CASE WHEN (scope <> 'cell' AND edge = 'insideH') OR (scope = 'cell' AND ((row_index = 0 AND edge = 'bottom') OR (row_index = 1 AND edge = 'top'))) THEN 'header' END, CASE WHEN edge = 'bottom' AND (scope <> 'cell' OR row_index = final) THEN 'bottom' END], lambda x: x IS NOT NULL)) AS part FROM b WHERE ink),
      m AS (SELECT *, min(rank) OVER (PARTITION BY doc_id, table_index, part) AS best FROM e),
      p AS (SELECT doc_id, table_index, coalesce(list_sort(list(DISTINCT w) FILTER (part = 'top' AND rank = best)), []) AS t, coalesce(list_sort(list(DISTINCT w) FILTER (part = 'header' AND rank = best)), []) AS h, coalesce(list_sort(list(DISTINCT w) FILTER (part = 'bottom' AND rank = best)), []) AS f FROM m GROUP BY 1, 2),
      v AS (SELECT doc_id, table_index, bool_or(ink AND edge IN ('left', 'right', 'start', 'end', 'insideV')) AS vertical, bool_or(ink) AS inked FROM b GROUP BY 1, 2),
      j AS (SELECT v.doc_id, v.table_index, coalesce(t, []) AS t, coalesce(h, []) AS h, coalesce(f, []) AS f, vertical, inked FROM v LEFT JOIN p ON p.doc_id = v.doc_id AND p.table_index = v.table_index)
      SELECT doc_id, table_index, array_to_string(list_transform(t, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') AS top, array_to_string(list_transform(h, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') AS header, array_to_string(list_transform(f, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') AS bottom, vertical,
      CASE WHEN len(t) > 0 AND len(h) > 0 AND len(f) > 0 AND NOT vertical THEN 'three_line' WHEN vertical THEN 'grid' WHEN NOT inked THEN 'borderless' ELSE 'mixed' END AS pattern,
      CAST(CASE WHEN len(t) = 1 AND len(h) = 1 AND len(f) = 1 AND NOT vertical THEN 0.95 WHEN len(t) > 0 AND len(h) > 0 AND len(f) > 0 AND NOT vertical THEN 0.75 WHEN vertical THEN 0.9 WHEN NOT inked THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM j""",
    "q_border_tally": f"SELECT doc_id, table_index, edge, line_style, size, 'auto' AS color, count(*) AS uses FROM {BORDERS} GROUP BY ALL",
    "q_style_cascade": f"""WITH l AS (SELECT *, prop IN ('bold', 'italic') AS toggle FROM {LAYERS}) SELECT doc_id, para, prop, CASE WHEN bool_or(toggle) THEN coalesce(max(value) FILTER (level = 'direct'), CASE WHEN (count(*) FILTER (level = 'style' AND value = 'true') % 2 = 1) <> coalesce(bool_or(level = 'defaults' AND value = 'true'), false) THEN 'true' ELSE 'false' END)
      ELSE arg_max(value, layer) FILTER (value IS NOT NULL) END AS value, arg_max(source, layer) FILTER (value IS NOT NULL AND NOT (toggle AND level = 'style' AND value = 'false')) AS source FROM l GROUP BY doc_id, para, prop""",
    "q_style_chain": f"""WITH RECURSIVE s AS (SELECT * FROM {STYLES}), c AS (SELECT doc_id, style_id, 0 AS depth, style_id AS ancestor, style_type, based_on, [style_id] AS met, CAST(NULL AS VARCHAR) AS warning FROM s
      UNION ALL SELECT c.doc_id, c.style_id, c.depth + 1, c.based_on, c.style_type, s.based_on, list_append(c.met, c.based_on), CASE WHEN list_contains(c.met, c.based_on) THEN 'cycle' WHEN s.style_id IS NULL THEN 'missing' WHEN s.style_type <> c.style_type THEN 'wrong_type' END
      FROM c LEFT JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.based_on WHERE c.based_on IS NOT NULL AND c.warning IS NULL) SELECT doc_id, style_id, depth, ancestor, warning FROM c""",
    "q_units": "SELECT p_partkey, k / 20.0 AS pt, k * CAST(25.4 AS DOUBLE) / CAST(1440 AS DOUBLE) AS mm, k / CAST(100 AS DOUBLE) AS chars, CASE p_partkey % 3 WHEN 0 THEN k / CAST(240 AS DOUBLE) WHEN 1 THEN k / CAST(20 AS DOUBLE) END AS lines, k / CAST(8 AS DOUBLE) AS border_pt, k / CAST(2 AS DOUBLE) AS size_pt FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS k FROM part)",
    "q_section_observations": """SELECT property_path, v IS NOT NULL AS supported, count(*) AS sections, max(v * CAST(25.4 AS DOUBLE) / CAST(1440 AS DOUBLE)) AS most, min(v * CAST(25.4 AS DOUBLE) / CAST(1440 AS DOUBLE)) AS least
      FROM (SELECT unnest(['page.width_mm', 'page.height_mm', 'page.margin_top_mm', 'page.margin_bottom_mm', 'page.margin_left_mm', 'page.margin_right_mm']) AS property_path, unnest([CAST(p_size * 500 AS DOUBLE), 16838, CASE WHEN p_size > 10 THEN p_size * 30 END, p_size, 1440, NULL]) AS v FROM part) GROUP BY 1, 2""",
}
