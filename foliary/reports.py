"""Markdown reports of summaries, which are a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a table that a report shows; the number of all is given.
SHOWN = 200


def _cell(value: object) -> str:
    text = "" if value is None else f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")


def table(rows: DataFrame, shown: int = SHOWN) -> str:
    """The first rows by all columns as a Markdown table, and how many there are if not all are shown."""
    some = rows.orderBy(*[c for c, t in rows.dtypes if not t.startswith("map")]).limit(shown + 1).collect()
    lines = ["| " + " | ".join(map(_cell, rows.columns)) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(_cell(r[c]) for c in rows.columns) + " |" for r in some[:shown]]
    if len(some) > shown:
        lines.append(f"\n{shown} of {rows.count()} rows.")
    return "\n".join(lines)


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A title and a section for each table or text."""
    parts = [f"# {title}"]
    for name, what in sections.items():
        parts.append(f"## {name}\n\n{what if isinstance(what, str) else table(what)}")
    return "\n\n".join(parts) + "\n"


def analysis(summary: DataFrame, findings: DataFrame) -> str:
    """Statistics of documents and what a formatter has to leave alone."""
    grouped = findings.groupBy("category", "severity", "policy").count()
    safe = findings.where("policy = 'block_formatting'").isEmpty()
    return report("Analysis", {"Documents": summary, "Findings": grouped, "Formatting": "Nothing found stands against it." if safe else "Blocked by the findings above."})


def evaluation(metrics: DataFrame, status: str) -> str:
    return report("Evaluation", {"Status": status, "Systems": metrics})


def adjudication(decisions: DataFrame) -> str:
    from foliary.operators.review import adjudication_counts

    reasons = decisions.selectExpr("explode(reasons) as reason").groupBy("reason").count()
    return report("Adjudication", {"Outcomes": adjudication_counts(decisions), "Reasons": reasons})


def structure(decisions: DataFrame, checks: DataFrame) -> str:
    return report("Structure", {"Roles": decisions.groupBy("role", "scope", "review").count(), "Checks": checks.groupBy("status").count()})
