"""Fingerprints, findings and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.text import protected, sha256


def _escape(json: Column) -> Column:
    """Control characters as lower-case escapes, as the canonical form has them; most texts have none."""
    plain = json
    for code in [*range(0x0A, 0x10), *range(0x1A, 0x20)]:
        upper, lower = f"\\u{code:04X}", f"\\u{code:04x}"
        if upper != lower:
            json = F.replace(json, F.lit(upper), F.lit(lower))
    return F.when(plain.rlike(r"\\u00[01]"), json).otherwise(plain)


def unit_json(kind: Column, text: Column) -> Column:
    return F.to_json(F.struct(kind.alias("kind"), text.alias("text")))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, unit_count, total_chars of texts whose units are their non-empty lines.

    A row holds a whole document, so nothing is exploded and nothing shuffled.
    """
    units = F.filter(F.split(protected(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1), lambda x: x != "")
    coded = F.transform("_units", lambda x: unit_json(F.lit("paragraph"), x))
    canonical = F.concat(F.lit("["), F.array_join(coded, ","), F.lit("]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), units.alias("_units")).withColumn("_json", canonical)
    chars = F.aggregate("_units", F.lit(0).cast("long"), lambda s, x: s + F.char_length(x))
    return rows.select("doc_id", sha256(_escape(F.col("_json"))).alias("fingerprint"), F.size("_units").cast("long").alias("unit_count"), chars.alias("total_chars"))


def unit_fingerprints(units: DataFrame) -> DataFrame:
    """The same of a table of units (doc_id, seq, kind, text, and part_name or sha256 where the kind has them)."""
    rows = units.withColumn("_text", protected(F.coalesce("text", F.lit("")))).where("kind = 'media' or _text <> ''")
    fields = [F.col("kind"), *(F.col(c) for c in ("part_name",) if c in units.columns)]
    text = F.to_json(F.struct(*fields, F.col("_text").alias("text")))
    coded = F.when(F.col("kind") == "media", F.to_json(F.struct(*fields, F.col("sha256")))).otherwise(text) if "sha256" in units.columns else text
    grouped = rows.withColumn("_json", coded).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "_json"))).alias("_all"), F.count("*").alias("unit_count"), F.sum(F.when(F.col("kind") != "media", F.char_length("_text")).otherwise(0)).alias("total_chars"))
    canonical = F.concat(F.lit("["), F.array_join("_all._json", ","), F.lit("]"))
    return grouped.select("doc_id", sha256(_escape(canonical)).alias("fingerprint"), "unit_count", "total_chars")


def identity_diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that only one side has, or that differ: empty for identical content."""
    a, b = left.select(key, F.col(digest).alias("left_digest")), right.select(key, F.col(digest).alias("right_digest"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("left_digest").isNull(), "added").when(F.col("right_digest").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).withColumn("change", change)


def dedup_findings(findings: DataFrame, key: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """The first of equal findings by ``seq``, ordered and numbered within the document: ``finding_id``."""
    rest = [c for c in findings.columns if c not in ("doc_id", *key)]
    # combined before the shuffle, unlike a rank
    first = findings.groupBy("doc_id", *key).agg(F.min_by(F.struct(*rest), seq).alias("_x")).select("doc_id", *key, "_x.*").select(*findings.columns)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return first.withColumn("finding_id", F.format_string("unsupported-%04d", number))


def finding_summary(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("doc_id").agg(F.count("*").alias("objects"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), (~F.bool_or(F.col("policy") == "block_formatting")).alias("safe"))


def by_suffix(rows: DataFrame, categories: DataFrame, column: str) -> DataFrame:
    """Rows joined with the categories (suffix, ..) that end their ``column``; the categories are a few fixed rows."""
    return rows.join(categories, F.col(column).endswith(F.col("suffix")))


def broken_links(links: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    return links.join(targets.select(F.col(target).alias(link)).distinct(), link, "left_anti")


def rule_rechecks(checks: DataFrame) -> DataFrame:
    """Per rule: how many results, and whether there are some and all pass."""
    n = lambda c: F.count_if(c)
    return checks.groupBy("rule_id").agg(F.count("*").alias("results"), n(F.col("status") == "pass").alias("passes"), n(F.col("status") == "fail").alias("fails"), n(~F.col("status").isin("pass", "fail")).alias("unresolved")).withColumn("passed", (F.col("results") > 0) & (F.col("passes") == F.col("results")))


def delivery_gate(facts: DataFrame) -> DataFrame:
    """Adds ``deliverable``: content and report agree, the package is safe and not empty, and all rechecks passed."""
    return facts.withColumn("deliverable", F.col("content_preserved") & F.col("report_matches") & F.col("package_safe") & (F.col("unit_count") > 0) & F.col("rechecks_passed"))
