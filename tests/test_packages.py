"""Effective formats, findings, table evidence, profiles, runs, rewriting, sinks and settings: value fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foliary import __main__, reports, settings, sinks
from foliary.operators import format_plan, formats, integrity, review, rewrite, runner
from foliary.sources import docx, profiles
from tests.conftest import SF
from tests.test_operators import packages

W = docx.W[1:-1]


def styles(inner: str) -> dict[str, str]:
    return {"word/styles.xml": f'<w:styles xmlns:w="{W}">{inner}</w:styles>'}


def style(name: str, based_on: str | None = None, kind: str = "paragraph", ppr: str = "", rpr: str = "", more: str = "") -> str:
    based = f'<w:basedOn w:val="{based_on}"/>' if based_on else ""
    return f'<w:style w:type="{kind}" w:styleId="{name}" {more}><w:name w:val="{name}"/>{based}<w:pPr>{ppr}</w:pPr><w:rPr>{rpr}</w:rPr></w:style>'


def para(style_id: str | None = None, ppr: str = "", runs: str = "<w:r><w:t>x</w:t></w:r>") -> str:
    own = f'<w:pStyle w:val="{style_id}"/>' if style_id else ""
    return f"<w:p><w:pPr>{own}{ppr}</w:pPr>{runs}</w:p>"


def run(rpr: str = "", text: str = "x") -> str:
    return f"<w:r><w:rPr>{rpr}</w:rPr><w:t>{text}</w:t></w:r>"


def test_effective_formats(spark):
    sheet = (
        '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/><w:rFonts w:asciiTheme="minorHAnsi"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="60"/></w:pPr></w:pPrDefault></w:docDefaults>'
        + style("Normal", more='w:default="1"', ppr='<w:jc w:val="both"/>')
        + style("A", "Normal", rpr='<w:b/><w:rFonts w:ascii="Plain"/>', ppr='<w:ind w:firstLine="400"/>')
        + style("B", "A", rpr='<w:b/><w:sz w:val="28"/>', ppr='<w:ind w:hanging="200"/>')
        + style("E", kind="character", rpr='<w:i w:val="no"/><w:b/>')
        + style("X", "Y")
        + style("Y", "X")
    )
    body = [
        para("A"),  # 0
        para("B", '<w:ind w:firstLineChars="200"/>', run('<w:rStyle w:val="E"/>') + run("", " ") + run('<w:b w:val="off"/>') + f"<w:del>{run()}</w:del>" + run('<w:rStyle w:val="E"/>')),  # 1
        para(), para("X"), para("gone"), para("E"), para(None, '<w:spacing w:beforeLines="50" w:before="100"/>', ""),
    ]
    found = formats.Formats(packages(spark, docx.build([], body="".join(body), parts=styles(sheet))))
    p = {(r["para"], r["prop"]): (r["value"], r["source"], r["unresolved"]) for r in found.paragraph_formats().collect()}
    assert p[0, "alignment"] == ("both", "paragraph_style:Normal", None) and p[0, "space_after_twips"] == ("60", "doc_defaults", None)
    assert p[0, "first_line_indent_twips"] == ("400", "paragraph_style:A", None)
    assert p[1, "first_line_indent_twips"] == (None, None, "hanging_indent_not_resolved") and p[1, "first_line_indent_chars"] == ("200", "direct_paragraph", None)
    assert p[2, "alignment"][1] == "paragraph_style:Normal" and p[6, "space_before_twips"] == (None, None, "line_based_or_auto_spacing")
    r = {(x["para"], x["run"], x["prop"]): (x["value"], x["source"], x["unresolved"]) for x in found.run_formats().collect()}
    assert r[0, 0, "bold"] == ("true", "paragraph_style:A", None) and r[0, 0, "font_latin"] == ("Plain", "paragraph_style:A", None)
    assert r[1, 0, "bold"] == ("true", "character_style:E", None) and r[1, 0, "italic"] == ("false", "spec_default", None)  # B inverts A, E inverts B
    assert r[1, 2, "bold"] == ("false", "direct_run", None) and r[1, 2, "size_pt"] == ("14.0", "paragraph_style:B", None)
    assert r[2, 0, "font_latin"] == (None, None, "theme_font_not_resolved") and not any(k[1] in (1, 3) for k in r if k[0] == 1)
    groups = found.run_groups().where("para = 1").orderBy("run_group").collect()
    assert [(g["char_style"], g["uses"], g["first_indexes"]) for g in groups] == [("E", 2, "0,4"), (None, 1, "2")]
    assert {(w["para"], w["warning"]) for w in found.warnings().collect()} == {(3, "cycle"), (4, "missing"), (5, "wrong_type")}
    seen = {(o["para"], o["property_path"]): o for o in found.observations().collect()}
    assert seen[0, "run.size_pt"]["actual"]["num"] == 10 and seen[0, "run.bold"]["actual"]["flag"] and seen[0, "paragraph.first_line_indent_pt"]["actual"]["num"] == 20
    assert seen[1, "run.bold"]["reason"] == "explicit_run_group_required" and seen[6, "run.bold"]["reason"] == "explicit_run_group_required"
    assert seen[1, "paragraph.first_line_indent_pt"]["reason"] == "hanging_indent_not_resolved" and seen[1, "paragraph.first_line_indent_chars"]["actual"]["num"] == 2
    assert seen[3, "paragraph.space_after_pt"]["reason"] == "incomplete_style_resolution" and not seen[3, "paragraph.space_after_pt"]["supported"]


def test_long_style_chain(spark):
    sheet = style("S0", rpr='<w:sz w:val="50"/>') + "".join(style(f"S{i}", f"S{i - 1}", rpr="<w:b/>") for i in range(1, 41))
    found = formats.Formats(packages(spark, docx.build([], body=para("S40"), parts=styles(sheet))))
    got = {r["prop"]: r["value"] for r in found.run_formats().collect()}
    assert got["size_pt"] == "25.0" and got["bold"] == "false" and found.warnings().count() == 0


def test_table_evidence(spark):
    edge = lambda e, size, kind="single": f'<w:{e} w:val="{kind}" w:sz="{size}"/>'
    cell = lambda b="": f"<w:tc><w:tcPr><w:tcBorders>{b}</w:tcBorders></w:tcPr><w:p/></w:tc>"
    three = f"<w:tbl><w:tblPr/><w:tblGrid><w:gridCol w:w='100'/><w:gridCol w:w='250'/></w:tblGrid><w:tr><w:trPr><w:tblHeader/></w:trPr>{cell(edge('top', 12) + edge('bottom', 8))}{cell()}</w:tr><w:tr>{cell()}</w:tr><w:tr>{cell(edge('bottom', 12))}</w:tr></w:tbl>"
    open_ = f"<w:tbl><w:tblPr><w:tblBorders>{edge('bottom', 12)}</w:tblBorders></w:tblPr><w:tr>{cell(edge('top', 12))}</w:tr><w:tr>{cell(edge('top', 8))}</w:tr><w:tr>{cell()}</w:tr></w:tbl>"
    none = f"<w:tbl><w:tr>{cell()}</w:tr></w:tbl>"
    styled = f"<w:tbl><w:tblPr><w:tblStyle w:val='Grid'/></w:tblPr><w:tr>{cell()}</w:tr></w:tbl>"
    sheet = f'<w:style w:type="table" w:styleId="Grid"><w:name w:val="Grid"/><w:tblPr><w:tblBorders>{edge("insideV", 4)}</w:tblBorders></w:tblPr></w:style>'
    got = formats.table_evidence(packages(spark, docx.build([], body=three + open_ + none + styled, parts=styles(sheet)))).orderBy("table_index").collect()
    assert [(r["pattern"], r["confidence"]) for r in got] == [("three_line", 0.95), ("three_line", 0.95), ("borderless", 0.85), ("grid", 0.9)]
    assert (got[0]["n_rows"], got[0]["n_columns"], got[0]["header_rows"], got[0]["grid"]) == (3, 2, [0], [100, 250]) and got[1]["bottom"] == [1.5]


def test_type_declarations_are_refused_in_any_encoding(spark):
    evil = f'<?xml version="1.0" encoding="utf-16"?><!DOCTYPE w:document [<!ENTITY e "expanded">]><w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>&e;</w:t></w:r></w:p></w:body></w:document>'
    for coded in (evil.encode("utf-16"), evil.encode("utf-16-le"), evil.replace("utf-16", "utf-8").encode()):
        p = packages(spark, docx.build([("x", None)], parts={"word/document.xml": coded}))
        assert [r["error"] for r in docx.scan(p, "blocks").collect()] == ["forbidden_xml_declaration"]
    plain = evil[evil.index("<w:document") :].replace("&e;", "ok")
    p = packages(spark, docx.build([], parts={"word/document.xml": ('<?xml version="1.0" encoding="utf-16"?>' + plain).encode("utf-16")}))
    assert docx.blocks(p).first()["text"] == "ok"


def test_findings_of_parts_and_relationships(spark):
    rel = lambda n, kind, target: f'<Relationship Id="r{n}" Type="http://x/{kind}" Target="{target}" TargetMode="External"/>'
    rels = f'<Relationships xmlns="{docx.REL[1:-1]}">{rel(1, "hyperlink", "http://y")}{rel(2, "attachedTemplate", "http://z")}{rel(3, "oleObject", "http://o")}{rel(1, "hyperlink", "http://y")}</Relationships>'
    parts = {"word/_rels/document.xml.rels": rels, "word/activeX/a.bin": "x", "word/embeddings/e.bin": "x", "customXml/item1.xml": "<a/>", "_xmlsignatures/s.sigs": "x"}
    p = packages(spark, docx.build([("a", None)], body='<w:p xmlns:v="urn:schemas-microsoft-com:vml"><v:textbox/></w:p>', parts=parts), docx.build([("b", None)]))
    got = sorted((r["category"], r["severity"], r["policy"], r["uses"]) for r in docx.findings(p).collect())
    assert got == sorted([
        ("active_x", "error", "block_formatting", 1), ("custom_xml", "info", "report_only", 1), ("digital_signature", "warning", "manual_review", 1), ("embedded_package", "error", "block_formatting", 1),
        ("external_relationship", "error", "block_formatting", 1), ("external_relationship", "error", "block_formatting", 1), ("external_relationship", "warning", "manual_review", 1), ("ole_object", "error", "block_formatting", 1), ("text_box", "warning", "manual_review", 1),
    ])
    summary = integrity.finding_summary(docx.findings(p)).collect()
    assert len(summary) == 1 and not summary[0]["safe"]


def test_signals_sections_fields_and_flags(spark):
    mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    nested = "<w:tbl><w:tr><w:tc><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/></w:tc></w:tr></w:tbl>"
    body = f'<w:sdt/><w:p>{mark("end")}{mark("begin")}</w:p>{nested}<w:p><w:hyperlink/><w:fldSimple w:instr=" PAGE "/></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:rPr><w:b w:val="no"/></w:rPr><w:t>n</w:t></w:r></w:p><w:sectPr><w:footerReference w:type="first"/><w:headerReference/></w:sectPr>'
    p = packages(spark, docx.build([], body=body))
    assert {r["warning"] for r in docx.scan(p, "signals").collect()} == {"unrepresented_body_wrappers", "unbalanced_field_end", "unclosed_complex_field", "nested_tables_not_classified"}
    assert docx.scan(p, "sections").first()["references"] == ["footer:first", "header:default"] and docx.scan(p, "fields").first()["simple"]
    rows = {r["block_id"]: r for r in docx.blocks(p).collect()}
    assert rows["p-0001"]["has_hyperlink"] and (rows["p-0002"]["num_id"], rows["p-0002"]["num_level"], rows["p-0002"]["bold"]) == (7, 1, False)


def test_fingerprints_agree_on_control_characters(spark):
    text = "a\x0bb\x0fc\x1fd\n\x08e"
    whole = integrity.document_fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    units = [(1, i, "paragraph", t) for i, t in enumerate(text.split("\n"))]
    parted = integrity.unit_fingerprints(spark.createDataFrame(units, "doc_id long, seq int, kind string, text string")).first()
    assert whole["fingerprint"] == parted["fingerprint"]


def test_normalised_markers_by_brute_force(spark):
    import unicodedata
    from collections import Counter

    from foliary.plans import documents

    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        for line in (r["text"] or "").split("\n"):
            want["".join(unicodedata.normalize("NFKC", line).split()).casefold()] += 1
    got = {r["key"]: r["uses"] for r in documents.q_normalised_markers(spark, SF).collect()}
    assert got == dict(want)


def test_rewriting_keeps_the_content(spark):
    p = packages(spark, docx.build([("before", None)], [["h", "i"], ["1", "2"], ["3", "4"]], parts={"word/media/i.png": "png"}), docx.build([("no table", None)]))
    cells = docx.blocks(p).where("kind = 'table_cell'").select("doc_id", F.lit(0).alias("table_index"), F.substring("block_id", 11, 3).cast("int").alias("row_index"), F.substring("block_id", 16, 3).cast("int").alias("cell_index"))
    have = docx.scan(p, "borders").where("scope = 'cell'").select("doc_id", "table_index", "row_index", "cell_index", "edge", F.col("size").alias("eighths"))
    steps = format_plan.border_operations(format_plan.desired_borders(cells), have)
    made = rewrite.rewrite(p, steps)
    done = rewrite.accepted(p, made).collect()
    assert [(r["doc_id"], r["accepted"]) for r in done] == [("d0", True)]
    after = spark.createDataFrame([(r["doc_id"], r["content"]) for r in done], "doc_id string, content binary")
    assert formats.table_evidence(after).first()["pattern"] == "three_line" and docx.scan(after, "parts").count() == docx.scan(p.where("doc_id = 'd0'"), "parts").count()
    again = docx.scan(after, "borders").where("scope = 'cell'").select("doc_id", "table_index", "row_index", "cell_index", "edge", F.col("size").alias("eighths"))
    assert format_plan.border_operations(format_plan.desired_borders(cells), again).count() == 0
    other = spark.createDataFrame([("d0", bytes(docx.build([("changed", None)])), None)], "doc_id string, content binary, error string")
    assert not rewrite.accepted(p, other).first()["accepted"]
    gone = steps.withColumn("row_index", F.lit(99))
    assert {r["error"] for r in rewrite.rewrite(p, gone).collect()} == {"table_changed"}


class Flaky:
    """A provider that fails as the packet's target says."""

    def __init__(self):
        self.calls = {}

    def review(self, packet):
        n = self.calls[packet["packet_id"]] = self.calls.get(packet["packet_id"], 0) + 1
        if packet["target"] == "limited" and n == 1:
            raise runner.http_error(429)
        if packet["target"] == "down":
            raise runner.http_error(503, "no")
        if packet["target"] == "refused":
            raise runner.http_error(400)
        if packet["target"] == "junk":
            return runner.parsed("[1]")
        return {**runner.parsed('{"role": "body", "scope": "body", "confidence": 0.9}'), "input_tokens": 10, "output_tokens": 2, "cost": runner.cost(10, 2, 1.0, 3.0)}


def test_runner_retries_and_gates(spark):
    p = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(("fine", "limited", "down", "refused", "junk"))], "packet_id string, target string")
    got = {r["target"]: r for r in runner.run(p, Flaky).collect()}
    assert {t: (r["ok"], r["code"], r["attempts"]) for t, r in got.items()} == {"fine": (True, None, 1), "limited": (True, None, 2), "down": (False, "provider_server_error", 2), "refused": (False, "provider_rejected", 1), "junk": (False, "invalid_model_output", 1)}
    assert got["fine"]["cost"] == pytest.approx(16e-6) and runner.cost(1, 1, None, 1) is None
    on = settings.load({"FOLIARY_MODEL_MODE": "ambiguous_only", "FOLIARY_MODEL": "m", "FOLIARY_MODEL_KEY": "secret"})
    settings.model_gate(on, "hybrid", True)
    assert "secret" not in repr(on)
    for found, mode, sure, code in ((settings.load({}), "hybrid", True, "ai_disabled"), (on, "prompt_only", True, "ai_mode_mismatch"), (on, "hybrid", False, "cloud_send_not_confirmed"), (settings.load({"FOLIARY_MODEL_MODE": "prompt_only"}), "prompt_only", True, "ai_not_configured")):
        with pytest.raises(ValueError, match=code):
            settings.model_gate(found, mode, sure)
    with pytest.raises(ValueError, match="invalid_settings: max_retries"):
        settings.load({"FOLIARY_MAX_RETRIES": "4"})
    made = spark.createDataFrame([(1, "plan", "h", "f", "hybrid"), (1, "run", "h", "old", "hybrid"), (2, "plan", "h", "f", "hybrid")], "doc_id int, kind string, input_sha256 string, content_fingerprint string, mode string")
    want = spark.createDataFrame([(1, "h", "f", "hybrid")], "doc_id int, input_sha256 string, content_fingerprint string, mode string")
    assert sorted(str(r["violation"]) for r in runner.gates(made, want).collect()) == ["None", "stale_run_fingerprint", "unknown_input"]


def test_packets_and_counts(spark):
    rows = [(1, 0, "b0", "paragraph", "some text", "h0", "body", "body", False), (1, 1, "b1", "table", "a", "h1", None, None, False), (1, 2, "b2", "paragraph", " ", "h2", None, None, False)]
    targets = spark.createDataFrame(rows, "doc_id int, ord int, block_id string, kind string, text string, text_sha256 string, role string, scope string, unsupported boolean")
    near = spark.createDataFrame([(1, 0, 1, "b1", "next", "a", False)], "doc_id int, ord int, context_ord long, context_id string, reason string, excerpt string, truncated boolean")
    made = review.packets(targets, near, "hybrid")
    got = {r["packet_id"]: r for r in made.collect()}
    assert set(got) == {"hybrid-b0", "hybrid-b1"} and got["hybrid-b0"]["context_ids"] == ["b0", "b1"] and got["hybrid-b0"]["rules_role"] == "body"
    assert set(got["hybrid-b1"]["allowed_roles"]) == {"table", "abbreviation_table", "unknown"} and "table" not in got["hybrid-b0"]["allowed_roles"]
    total = review.plan_totals(targets, made).first()
    assert (total["candidates"], total["packets"], total["skipped"], total["context_characters"]) == (3, 2, 1, 1)
    judged = spark.createDataFrame([("auto_accept", ["rules_and_model_agree"]), ("manual_review", ["model_abstained"])], "outcome string, reasons array<string>")
    assert review.adjudication_counts(judged).first().asDict() == {"targets": 2, "auto_accept": 1, "manual_review": 1}
    assert "| model_abstained | 1 |" in reports.adjudication(judged)


def profile(root, **changes):
    source = {"type": "written_spec", "document": "guide", "evidence": "12 pt", "locator": "s1", "document_sha256": "a" * 64}
    rule = {"schema_version": "2.0", "id": "r1", "profile_id": "p", "scope": "body", "target": {"text_part": "whole", "paragraph_position": "first", "metadata_field": None}, "property_path": "run.size_pt", "expected_value": {"kind": "number", "value": 12.0, "unit": "pt"}, "comparison": "eq", "tolerance": 0.0, "status": "confirmed", "confidence": 1.0, "source": source, "validator": "numeric_compare", "implementation": "x"}
    rule |= changes.get("rule", {})
    manifest = {"profile_id": "p", "version": "1.0.0", "name": "Profile", "template_document": "guide", "template_sha256": "a" * 64, "rule_files": ["rules.json"], "evidence_file": "evidence.json", "coverage_file": "coverage.json", "template_samples": [{"kind": "paragraph", "index": 0, "scope": "body"}]} | changes.get("manifest", {})
    files = {"manifest.json": manifest, "rules.json": changes.get("rules", [rule]), "evidence.json": [source], "coverage.json": changes.get("coverage", [{"inventory_id": "i1", "state": "encoded", "rule_ids": ["r1"], "deferred_requirements": []}])}
    for name, value in files.items():
        (root / name).write_text(json.dumps(value))
    return str(root)


def test_profiles(spark, tmp_path):
    found = profiles.load(spark, profile(tmp_path))
    rule = found.for_checks().first()
    assert rule["rule_id"] == "r1" and rule["paragraph_position"] == "first" and rule["expected"]["num"] == 12.0
    bad = {
        "rule_of_another_profile": {"rule": {"profile_id": "q"}}, "rule_without_its_evidence": {"rule": {"source": {"type": "written_spec", "document": "guide", "evidence": "13 pt", "locator": "s1", "document_sha256": "a" * 64}}},
        "rule_without_coverage": {"coverage": [{"inventory_id": "i1", "state": "deferred", "rule_ids": [], "deferred_requirements": ["x"]}]}, "inconsistent_state": {"coverage": [{"inventory_id": "i1", "state": "partial", "rule_ids": ["r1"], "deferred_requirements": []}]},
        "unsafe_profile_reference": {"manifest": {"evidence_file": "../evidence.json"}}, "evidence_of_another_document": {"manifest": {"template_sha256": "b" * 64}},
    }
    for code, changes in bad.items():
        with pytest.raises(profiles.ProfileError, match=code):
            profiles.load(spark, profile(tmp_path, **changes))
    (tmp_path / "big.json").write_text(" " * 1_000_001)
    with pytest.raises(profiles.ProfileError, match="file_too_large"):
        profiles.read_json(spark, str(tmp_path / "big.json"), "a string", "corrections")


def test_samples(spark):
    from foliary.plans.packages import located_rules

    found = formats.Formats(packages(spark, docx.build([], body=para(None, "", run('<w:sz w:val="24"/>')) + para())))
    seen = found.observations().select(F.lit("paragraph").alias("kind"), F.col("para").alias("index"), "property_path", "actual", "supported", "reason")
    places = found.paragraphs().select(F.lit("paragraph").alias("kind"), F.col("para").alias("index"))
    samples = spark.createDataFrame([("paragraph", 0, "body"), ("paragraph", 1, "heading_1")], "kind string, index int, scope string")
    got = {(r["rule_id"], r["index"]): (r["status"], r["check_reason"]) for r in formats.sample_checks(samples, located_rules(spark), seen, places).collect()}
    assert got == {("l-size", 0): ("pass", "value_matches"), ("l-align", 1): ("not_evaluated", "actual_value_unresolved")}
    with pytest.raises(ValueError, match="sample_index_out_of_range"):
        formats.sample_checks(samples.withColumn("index", F.lit(9)), located_rules(spark), seen, places)


def test_statistics_reports_and_overrides(spark):
    from foliary.operators import classify, jobs

    parts = {"word/comments.xml": f'<w:comments xmlns:w="{W}"><w:comment><w:p><w:r><w:t>c</w:t></w:r></w:p></w:comment></w:comments>', "word/media/i.png": "x"}
    p = packages(spark, docx.build([("a", "Heading1"), ("", None)], [["b", "c"]], parts=parts), b"no package")
    conflicts = spark.createDataFrame([("d0", "t", "conflicting_equal_authority_evidence")], "doc_id string, target string, reason string")
    got = {r["doc_id"]: r for r in formats.evidence_report(p, conflicts).collect()}
    assert (got["d0"]["paragraphs"], got["d0"]["empty_paragraphs"], got["d0"]["cells"], got["d0"]["characters"], got["d0"]["comments"], got["d0"]["media"]) == (2, 1, 2, 3, 1, 1)
    assert got["d0"]["patterns"][0]["pattern"] == "borderless" and got["d0"]["conflicts"] == ["t:conflicting_equal_authority_evidence"] and got["d1"]["error"] == "invalid_zip" and got["d1"]["paragraphs"] is None
    blocks = docx.blocks(p)
    given = spark.createDataFrame([("h", "p-0001", "body", "body")], "input_sha256 string, block_id string, role string, scope string")
    assert {r["block_id"]: r["role"] for r in classify.classify(classify.with_overrides(blocks, given, "h")).collect()}["p-0001"] == "body"
    with pytest.raises(ValueError, match="stale_overrides"):
        classify.with_overrides(blocks, given, "other")
    asked = spark.createDataFrame([("j", "r", 1, "x"), ("j", "r", 2, "y"), ("j", "s", 3, "z")], "job_id string, request string, seq int, result string")
    assert sorted((r["seq"], r["result"], r["repeated"]) for r in jobs.results_once(asked).collect()) == [(1, "x", False), (2, "x", True), (3, "z", False)]
    checks = spark.createDataFrame([("d0", i, "r", "fail") for i in range(3)], "doc_id string, seq int, rule_id string, status string")
    found = jobs.diagnosis(classify.classify(blocks), checks, jobs.top_issues(checks, ["doc_id"], "seq", 2)).first()
    assert len(found["top_issues"]) == 2 and found["issues"] == 3 and found["truncated"] and found["status_counts"] == "fail=3"


def test_sinks_and_reports(spark, tmp_path):
    sinks.write_json(tmp_path / "a/b.json", {"z": 1, "a": [2, "é"]})
    assert (tmp_path / "a/b.json").read_bytes() == '{\n  "a": [\n    2,\n    "é"\n  ],\n  "z": 1\n}\n'.encode() and [p.name for p in (tmp_path / "a").iterdir()] == ["b.json"]
    for path, root, code in (("x", tmp_path / "a", "output_outside_root"), (tmp_path / "a/b.json", tmp_path, "output_exists"), (tmp_path / "a/in", tmp_path, "output_overwrites_input")):
        with pytest.raises(ValueError, match=code):
            sinks.contained(path, root, [tmp_path / "a/in"], fresh=True)
    tables = {"t": spark.range(3)}
    sinks.write_json(tmp_path / "schemas.json", sinks.schemas(tables))
    assert sinks.stale(tables, tmp_path / "schemas.json") == [] and sinks.stale({"t": spark.range(1).selectExpr("cast(id as int) id")}, tmp_path / "schemas.json") == ["t"]
    sinks.write_table(spark.range(3), f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(spark.range(3), f"file://{tmp_path}/t")
    text = reports.table(spark.createDataFrame([("a|b<", 1.5), (None, 2.0)], "name string, x double"))
    assert text.split("\n") == ["| name | x |", "| --- | --- |", "|  | 2 |", "| a\\|b&lt; | 1.5 |"] and "1 of 3 rows" in reports.table(spark.range(3), 1)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("FOLIARY_DATA_DIR", str(tmp_path / "out"))
    for folder, text in (("in", "a"), ("same", "a"), ("other", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.docx").write_bytes(docx.build([(text, "Heading1")]))
    call = lambda *x: __main__.main([str(y) for y in x])
    assert call("analyze", tmp_path / "in", "--out", tmp_path / "out/a") == 0 and "# Analysis" in (tmp_path / "out/a/analysis_summary.md").read_text()
    assert call("compare", tmp_path / "in", tmp_path / "same", "--out", tmp_path / "out/c") == 0
    assert call("compare", tmp_path / "in", tmp_path / "other", "--out", tmp_path / "out/c") == 4
    assert call("classify", tmp_path / "in", "--out", tmp_path / "elsewhere") == 2 and "output_outside_root" in capsys.readouterr().err
    assert call("nonsense") == 2 and call("inspect", tmp_path / "missing", "--out", tmp_path / "out/i") == 3
