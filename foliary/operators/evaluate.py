"""Scoring systems against confirmed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def evaluate(gold: DataFrame, predictions: DataFrame, key: list[str], systems: list[str] | None = None) -> DataFrame:
    """Metrics per system from confirmed gold (key, expected_role, expected_scope) and predictions (system, key, role, scope, abstained).

    A missing prediction counts as an abstention of every system that made any, or of those that are named (which spares
    reading the predictions for their names); ratios without a denominator are null.
    """
    # each gold row is repeated once for every system, of which there are a few; no pair of rows is formed beyond that
    if systems:
        asked = gold.withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    else:
        names = predictions.agg(F.sort_array(F.collect_set("system")).alias("names"))
        asked = gold.join(F.broadcast(names)).withColumn("system", F.explode("names")).drop("names")
    rows = asked.join(predictions, ["system", *key], "left")
    silent = F.col("role").isNull() | F.coalesce("abstained", F.lit(True))
    right = ~silent & F.coalesce(F.col("role") == F.col("expected_role"), F.lit(False))
    scoped = ~silent & F.col("expected_scope").isNotNull()
    in_scope = scoped & F.coalesce(F.col("scope") == F.col("expected_scope"), F.lit(False))
    n = F.count_if
    out = rows.groupBy("system").agg(
        F.count("*").alias("evaluated"), n(~silent).alias("predicted"), n(right).alias("correct_role"), n(scoped).alias("scope_evaluated"), n(in_scope).alias("correct_scope"), n(silent).alias("abstained"),
        n(~silent & (F.col("role") == "unknown")).alias("unknown"), n(silent | ~right | (scoped & ~in_scope)).alias("disagreements"),
    )
    out = out.withColumns({"coverage": ratio(F.col("predicted"), F.col("evaluated")), "accuracy": ratio(F.col("correct_role"), F.col("evaluated")), "precision": ratio(F.col("correct_role"), F.col("predicted")), "recall": ratio(F.col("correct_role"), F.col("evaluated")), "scope_accuracy": ratio(F.col("correct_scope"), F.col("scope_evaluated"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both))


def status(confirmed: Column, targets: Column) -> Column:
    return F.when(confirmed == 0, "no_confirmed_labels").when(confirmed == targets, "complete_gold_set").otherwise("partial_gold_set")


def gold_template(packets: DataFrame, skipped: DataFrame) -> DataFrame:
    """Unassessed annotations for all targets of a plan, by hash and without text."""
    a = packets.select("doc_id", "block_id", "text_sha256", F.lit("packet").alias("origin"))
    b = skipped.select("doc_id", "block_id", "text_sha256", F.lit("skipped").alias("origin"))
    return a.unionByName(b).withColumn("status", F.lit("unassessed"))


def gold_violations(gold: DataFrame) -> DataFrame:
    """Annotations that break the contract: confirmed needs role, reviewer and rationale; unassessed must have none."""
    some = F.col("expected_role").isNotNull() | F.col("expected_scope").isNotNull() | F.col("reviewer").isNotNull() | F.col("rationale").isNotNull()
    whole = F.col("expected_role").isNotNull() & F.col("reviewer").isNotNull() & F.col("rationale").isNotNull()
    return gold.withColumn("violation", F.when((F.col("status") == "confirmed") & ~whole, "incomplete_confirmation").when((F.col("status") == "unassessed") & some, "unassessed_with_label")).where("violation is not null")
