"""Rules, evidence, reviews, evaluation, packages, streams: value fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as t
from foliary.operators import evaluate, evidence, format_plan, integrity, jobs, review, rules
from foliary.sources import docx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def outcome(spark, expected, actual, comparison="eq", tolerance=0.0, status="confirmed", validator="numeric_compare", reason=None):
    rule = F.struct(F.lit(status).alias("status"), expected.alias("expected"), F.lit(comparison).alias("comparison"), F.lit(tolerance).alias("tolerance"), F.lit(validator).alias("validator"))
    none = rules.value("number", num=F.lit(0.0))
    seen = F.struct((actual if actual is not None else F.when(F.lit(False), none)).alias("actual"), F.lit(actual is not None).alias("supported"), F.lit(reason).cast("string").alias("reason"))
    return tuple(spark.range(1).select(rule.alias("rule"), seen.alias("observed")).select(rules.outcome().alias("o")).first()["o"])


def pt(x, unit="pt"):
    return rules.value("number", num=F.lit(float(x)), unit=unit)


@pytest.mark.parametrize("expected", [-7.25, 0.0, 40.0])
@pytest.mark.parametrize("tolerance", [0.0, 0.5])
def test_numbers_at_the_edges_of_the_tolerance(spark, expected, tolerance):
    for gap in (-1e9, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, float("inf")):
        holds = {"eq": abs(gap) <= tolerance, "gte": gap >= -tolerance, "lte": gap <= tolerance}
        for comparison, want in holds.items():
            assert outcome(spark, pt(expected), pt(expected + gap), comparison, tolerance)[0] == ("pass" if want else "fail"), (gap, comparison)


def test_typed_values_and_uncertainty(spark):
    flag = lambda x: rules.value("boolean", flag=F.lit(x))
    line = lambda n, mode: rules.value("line_spacing", num=F.lit(float(n)), mode=F.lit(mode))
    assert outcome(spark, flag(True), flag(False))[0] == "fail"
    assert outcome(spark, rules.value("text", txt=F.lit("Arial")), rules.value("text", txt=F.lit("Arial")), validator="exact_equal") == ("pass", "value_matches")
    assert outcome(spark, line(20, "exact"), line(20, "at_least")) == ("fail", "line_spacing_mode_differs")
    assert outcome(spark, line(1.5, "multiple"), line(1.5, "multiple"))[0] == "pass"
    assert outcome(spark, pt(1), pt(1), status="provisional")[0] == "evidence_insufficient"
    assert outcome(spark, pt(1), None) == ("not_evaluated", "actual_value_unresolved")
    assert outcome(spark, pt(1), pt(1), validator="other") == ("not_evaluated", "validator_not_implemented")
    assert outcome(spark, pt(1, "mm"), pt(1)) == ("not_evaluated", "incompatible_value_kind_or_unit")


def test_units(spark):
    n = lambda x: F.lit(float(x))
    assert one(spark, t.twips_to_pt(n(400))) == 20 and one(spark, t.twips_to_mm(n(1440))) == 25.4 and one(spark, t.hundredths(n(200))) == 2
    assert one(spark, t.line_spacing(n(360), F.lit("auto"))) == 1.5 and one(spark, t.line_spacing(n(400), F.lit("exact"))) == 20
    assert one(spark, t.line_spacing(n(400), F.lit(None))) is None


def test_text_functions(spark):
    assert one(spark, t.compact(F.lit(" Ａ\u3000bß\u00a0C "))) == "abssc"
    assert one(spark, t.normalised(F.lit("\u3000ｘ １\u2003"))) == "x 1"
    assert one(spark, t.protected(F.lit("e\u0301\r\na\rb"))) == "é\na\nb"
    assert one(spark, t.number_level(F.lit("1.2 Title"))) == 2 and one(spark, t.number_level(F.lit("1.2.3Title"))) == 3
    assert one(spark, t.number_level(F.lit("第一章 绪论"))) == 1 and one(spark, t.number_level(F.lit("1 a. b; c"))) is None
    assert one(spark, t.excerpt(F.lit("abcdefghij" * 4), "previous", 10)) == "…bcdefghij"
    assert one(spark, t.excerpt(F.lit("abcdefghij" * 4), "next", 10)) == "abcdefghi…"


def test_adapters(spark):
    sections = spark.createDataFrame([(1, 0, 11906, 10000, None, 1440, 0, 0)], "doc_id long, section int, width int, height int, top int, bottom int, left int, right int")
    got = {r["property_path"]: r for r in rules.section_observations(sections).collect()}
    assert abs(got["page.width_mm"]["actual"]["num"] - 210) < 0.1 and not got["page.margin_top_mm"]["supported"]
    tables = spark.createDataFrame([(1, 0, "three_line", [1.5], [1.0, 0.5], [1.5], False), (1, 1, "mixed", [1.5], [1.0], [1.5], False)], "doc_id long, table_index int, pattern string, top array<double>, header array<double>, bottom array<double>, vertical boolean")
    got = {(r["table_index"], r["property_path"]): r["supported"] for r in rules.table_observations(tables).collect()}
    assert got[0, "table.top_pt"] and not got[0, "table.header_separator_pt"] and not got[1, "table.top_pt"]
    paras = spark.createDataFrame([(1, "p", 24, 240, None, 400, 200, 360, "auto", "center", True)], "doc_id long, block_id string, size_half int, before int, after int, first_line int, first_line_chars int, line_value int, line_rule string, alignment string, bold boolean")
    got = {r["property_path"]: r for r in rules.paragraph_observations(paras).collect()}
    assert got["run.size_pt"]["actual"]["num"] == 12 and got["paragraph.line_spacing"]["actual"]["num"] == 1.5
    assert got["paragraph.first_line_indent_pt"]["reason"] == "character_indent_takes_precedence" and not got["paragraph.space_after_pt"]["supported"]


def test_adjudication(spark):
    packets = spark.createDataFrame([(i, "list_item", "body") for i in range(4)], "id int, rules_role string, rules_scope string")
    made = spark.createDataFrame([(0, "list_item", None, 0.95, False), (1, "list_item", None, 0.6, False), (2, "heading_4", None, 0.99, False)], "id int, model_role string, model_scope string, confidence double, abstained boolean")
    got = {r["id"]: r for r in review.adjudicate(packets, made, ["id"]).collect()}
    assert got[0]["outcome"] == "auto_accept" and got[0]["selected_scope"] == "body"
    assert "model_confidence_below_threshold" in got[1]["reasons"] and "role_disagreement" in got[2]["reasons"]
    assert got[3]["outcome"] == "manual_review" and got[3]["reasons"] == ["model_proposal_missing"]
    with pytest.raises(ValueError):
        review.adjudicate(packets, made, ["id"], 1.5)


def test_evaluation_without_labels_is_null(spark):
    gold = spark.createDataFrame([("b", "list_item", "body")], "id string, expected_role string, expected_scope string")
    made = spark.createDataFrame([("rules", "b", "body", "body", False), ("model", "b", "list_item", "body", False), ("mute", "b", None, None, True)], "system string, id string, role string, scope string, abstained boolean")
    got = {r["system"]: r for r in evaluate.evaluate(gold, made, ["id"]).collect()}
    assert (got["rules"]["accuracy"], got["model"]["accuracy"], got["model"]["scope_accuracy"]) == (0.0, 1.0, 1.0)
    assert got["mute"]["precision"] is None and got["mute"]["f1"] is None and got["rules"]["f1"] is None
    bad = evaluate.gold_violations(spark.createDataFrame([("confirmed", "x", None, None, None), ("unassessed", "x", None, None, None), ("unassessed", None, None, None, None)], "status string, expected_role string, expected_scope string, reviewer string, rationale string"))
    assert sorted(r["violation"] for r in bad.collect()) == ["incomplete_confirmation", "unassessed_with_label"]


def test_style_cascade_and_chains(spark):
    styles = spark.createDataFrame([(1, "A", "paragraph", None), (1, "B", "paragraph", "A"), (1, "X", "paragraph", "X")], "doc_id long, style_id string, style_type string, based_on string")
    got = {(r["style_id"], r["depth"]): (r["ancestor"], r["warning"]) for r in evidence.style_chains(styles).collect()}
    assert got["B", 1] == ("A", None) and got["X", 1] == ("X", "cycle")


def test_format_plan(spark):
    tables = spark.createDataFrame([(1, "abbreviation_table", False, 2), (2, "table", False, 2), (3, "abbreviation_table", False, 2)], "doc_id long, role string, review boolean, n_rows int")
    approved = spark.createDataFrame([("a",), ("b",)], "rule_id string")
    blocked = spark.createDataFrame([(3, "block_formatting")], "doc_id long, policy string")
    assert [r["doc_id"] for r in format_plan.eligible(tables, approved, ["a", "b"], blocked).collect()] == [1]
    with pytest.raises(ValueError, match="incomplete_rule_group"):
        format_plan.eligible(tables, approved, ["a"], blocked)
    cells = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0)], "doc_id long, table_index int, row_index int, cell_index int")
    want = {(r["row_index"], r["edge"]): r["eighths"] for r in format_plan.desired_borders(cells).collect()}
    assert want[0, "top"] == 12 and want[0, "bottom"] == 8 and want[1, "top"] == 0 and want[1, "bottom"] == 12 and want[0, "left"] == 0
    none = cells.limit(0).selectExpr("*", "'' as edge", "0 as eighths")
    assert format_plan.border_operations(format_plan.desired_borders(cells), none).count() == 3


def packages(spark, *contents):
    return spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(contents)], "doc_id string, content binary")


def test_docx_blocks_and_classification(spark):
    from foliary.operators import classify

    got = docx.blocks(packages(spark, docx.build([("1 Intro", "Heading1"), ("Some body text here", None), ("1.1 Part", "Heading2")], [["a", "b"]])))
    rows = got.orderBy("ord").collect()
    assert [r["kind"] for r in rows] == ["paragraph", "paragraph", "paragraph", "table", "table_cell", "table_cell"]
    assert rows[0]["style_name"] == "heading 1" and rows[4]["block_id"] == "tbl-0000-r000-c000"
    d = {r["block_id"]: r for r in classify.classify(got).collect()}
    assert d["p-0000"]["role"] == "heading_1" and d["p-0001"]["parent_id"] == "p-0000" and d["tbl-0000-r000-c001"]["parent_id"] == "tbl-0000"


def test_docx_rejections(spark):
    import io
    import zipfile

    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    bad = [b"", b"not a zip", None, packed(["a.xml"]), packed([*docx.REQUIRED, "../x"]), packed([*docx.REQUIRED, "word/A.xml", "word/a.xml"]), docx.build([("x", None)], body="<!DOCTYPE x>")]
    got = {r["doc_id"]: r["error"] for r in docx.scan(packages(spark, *bad), "blocks").collect()}
    assert [got[f"d{i}"] for i in range(7)] == ["invalid_zip", "invalid_zip", "invalid_zip", "not_a_docx_package", "unsafe_part_name", "duplicate_part", "forbidden_xml_declaration"]


def test_docx_findings_toc_fields_and_fingerprints(spark):
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    toc = f'<w:p>{field("begin")}<w:r><w:instrText>TOC \\o</w:instrText></w:r></w:p><w:p><w:r><w:t>1 One</w:t></w:r>{field("begin")}{field("end")}</w:p><w:p>{field("end")}</w:p><w:p><w:r><w:t>after</w:t></w:r></w:p><w:p><w:ins/></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>'
    rels = f'<Relationships xmlns="{docx.REL[1:-1]}"><Relationship Id="a" Type="http://x/chart" Target="charts/c.xml"/><Relationship Id="b" Type="http://x/hyperlink" Target="http://y" TargetMode="External"/><Relationship Id="c" Type="http://x/image" Target="../../evil"/></Relationships>'
    p = packages(spark, docx.build([("a", None)], body=toc, parts={"word/_rels/document.xml.rels": rels, "word/vbaProject.bin": "m", "word/media/i.png": "png", "word/header1.xml": f'<w:hdr xmlns:w="{docx.W[1:-1]}"><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>'}), docx.build([("a", "Heading1")]), docx.build([("b", None)]), docx.build([("a", None)]))
    inside = {r["block_id"]: r["in_toc_field"] for r in docx.blocks(p).where("doc_id = 'd0'").collect()}
    assert [inside[f"p-{i:04d}"] for i in range(5)] == [False, True, True, True, False]
    found = {r["category"] for r in docx.findings(p).collect()}
    assert found == {"tracked_changes", "chart", "broken_relationship", "external_relationship", "unsafe_relationship_target", "macro"}
    prints = {r["doc_id"]: (r["fingerprint"], r["unit_count"]) for r in integrity.unit_fingerprints(docx.fingerprint_units(p)).collect()}
    assert prints["d1"] == prints["d3"] != prints["d2"] and prints["d0"][1] >= 5
    assert docx.scan(p, "sections").where("section = 0").first()["width"] == 11906
    assert docx.package_report(p).where("macros").count() == 1
    assert docx.scan(p, "fields").where("error is null").count() == 1 and docx.scan(p, "stories").where("kind = 'header'").count() == 1


def test_intake_stream(spark, tmp_path):
    from foliary.streaming import intake

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx.build([("a", None)]))
    (tmp_path / "in/b.pdf").write_bytes(b"x")
    intake.record(intake.uploads(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {r["name"]: r["reject_code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.docx": None, "b.pdf": "unsupported_extension"}


def test_fingerprint_follows_text_only(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "a\nb"), (3, "a\nc"), (4, None), (5, 'q"\\\x1f')], "doc_id long, text string")
    got = {r["doc_id"]: r for r in integrity.document_fingerprints(docs).collect()}
    import hashlib
    import json

    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] and got[4]["unit_count"] == 0
    want = json.dumps([{"kind": "paragraph", "text": 'q"\\\x1f'}], ensure_ascii=False, separators=(",", ":"))
    assert got[5]["fingerprint"] == hashlib.sha256(want.encode()).hexdigest()


def test_jobs(spark):
    rows = [("u", i, "r2" if i % 2 else "r1", "fail" if i > 150 else "evidence_insufficient") for i in range(200)]
    got = jobs.top_issues(spark.createDataFrame(rows, "doc_id string, seq int, rule_id string, status string"), ["doc_id"], "seq").collect()
    assert len(got) == 100 and all(r["truncated"] and r["issues"] == 200 for r in got)
    assert [r["seq"] for r in got if r["rank"] == 1] == [152]
