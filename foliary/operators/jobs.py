"""Job records, intake and diagnosis summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 50 << 20
ISSUES = 100


def intake(files: DataFrame, ending: str = ".docx", most: int = MOST_BYTES) -> DataFrame:
    """Adds name, accepted, reject_code to files (path, length)."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    code = F.when(~F.lower(name).endswith(ending), "unsupported_extension").when(F.col("length") == 0, "empty_upload").when(F.col("length") > most, "upload_too_large")
    return files.withColumns({"name": name, "reject_code": code}).withColumn("accepted", F.col("reject_code").isNull())


def top_issues(checks: DataFrame, partition: list[str], seq: str, most: int = ISSUES) -> DataFrame:
    """The first ``most`` issues (failures first, then by rule), with the number of all and whether any are left out."""
    issues = checks.where(F.col("status").isin("fail", "evidence_insufficient"))
    order = [F.when(F.col("status") == "fail", 0).otherwise(1), "rule_id", seq]
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    total = issues.groupBy(*partition).agg(F.count("*").alias("issues"))
    return issues.withColumn("rank", rank).where(F.col("rank") <= most).join(total, partition).withColumn("truncated", F.col("issues") > most)


def diagnosis(decisions: DataFrame, checks: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """A row per document: roles and statuses counted, what needs review, and the first issues that ``top_issues`` gives."""
    tally = lambda df, c: df.groupBy("doc_id", c).count().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", c, "count"))), ";").alias(f"{c}_counts"))
    base = decisions.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("review").alias("review_count"))
    out = base.join(tally(decisions, "role"), "doc_id", "left").join(tally(checks, "status"), "doc_id", "left")
    if issues is None:
        return out
    first = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "status"))).alias("top_issues"), F.max("issues").alias("issues"), F.max("truncated").alias("truncated"))
    return out.join(first, "doc_id", "left")


def results_once(requests: DataFrame) -> DataFrame:
    """Requests (job_id, request, seq, result) with the result of the first equal one, and whether a request repeats it."""
    first = requests.groupBy("job_id", "request").agg(F.min_by("result", "seq").alias("_result"), F.min("seq").alias("_first"))
    rows = requests.join(first, ["job_id", "request"])
    return rows.select("job_id", "request", "seq", F.col("_result").alias("result"), (F.col("seq") > F.col("_first")).alias("repeated"))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """One artifact per job and kind: the last that was written."""
    return artifacts.groupBy("job_id", "kind").agg(F.max_by(F.struct("path", "sha256"), "seq").alias("x")).select("job_id", "kind", "x.*")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job from its events (job_id, seq, event): a failure ends it, a finished validation completes it."""
    last = events.groupBy("job_id").agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"), F.bool_or(F.col("event") == "failed").alias("_failed"))
    state = F.when(F.col("_failed"), "failed").when(F.col("event") == "validated", "completed").when(F.col("event").isin("analyzed", "formatted"), "awaiting_confirmation").otherwise("analyzing")
    return last.select("job_id", state.alias("state"), "seq")


#: What a reader still has to look at by hand: category, what triggers it, advice.
GUIDE = [
    ("final_layout", "always", "Open the finished document and page through it."),
    ("toc_and_fields", "table_of_contents", "Update the table of contents and all fields."),
    ("figure_pagination", "figure", "Check that figures stand with their captions."),
    ("figure_pagination", "figure_caption", "Check that figures stand with their captions."),
    ("table_pagination", "table", "Check how tables break across pages."),
    ("section_page_numbering", "sections", "Check page numbers section by section."),
    ("unsupported_objects", "unsupported", "Look at objects that were left as they are."),
]


def review_guide(facts: DataFrame) -> DataFrame:
    """Guide items (doc_id, category, advice) for facts (doc_id, trigger); every document gets those for always."""
    guide = facts.sparkSession.createDataFrame(GUIDE, "category string, trigger string, advice string")
    every = facts.select("doc_id").distinct().withColumn("trigger", F.lit("always"))
    return facts.select("doc_id", "trigger").unionByName(every).join(guide, "trigger").select("doc_id", "category", "advice").distinct()
