"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from foliary.llm import queries
from foliary.llm.scratch import save
from tests.conftest import SF
from tests.llm.test_operators import near_brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = save(stage(spark, docs, SF), "test")
        assert after.columns == docs.columns and after.count() <= docs.count()
        kept.append((docs, after))
        docs = after
    before, after = ([tuple(r) for r in x.select("doc_id", "text").collect()] for x in kept[1])
    assert {i for i, _ in after} == {i for i, (_, c) in near_brute(before).items() if i == c}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in kept[2][1].collect() for b in bench)
    tokens = corpus_pipeline.token_files(spark, docs, SF)
    assert {r["doc_id"] for r in tokens.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), "test-run")
    want = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(want) and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(i, t, "en", "s", 1, "x", 1.0, 2.0) for i, t in [(None, "no id but some words here"), (None, item), (1, None), (2, ""), (3, "equal rows of a text"), (3, "equal rows of a text"), (4, f"before {item} after"), (4, "a clean row that shares its id"), (5, "word " * 50000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string, kept double, predicted double")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = save(stage(spark, docs, SF), "odd")
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        left[name] = sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in kept.collect())
        docs = kept
    assert (0, item[:20]) not in left["decontamination"] and not any(t.startswith("before") for _, t in left["decontamination"])
    assert (0, "no id but some words") in left["decontamination"] and (4, "a clean row that sha") in left["decontamination"] and left["near-duplicates"].count((3, "equal rows of a text")) == 1
    assert corpus_pipeline.token_files(spark, docs, SF).count() == docs.count()


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
