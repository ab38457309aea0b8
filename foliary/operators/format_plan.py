"""Formatting plans: which tables may be rewritten, and which borders they should have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths that the four confirmed rules ask for, in points.
TOP = BOTTOM = 1.5
HEADER = 1.0


def eligible(tables: DataFrame, approved: DataFrame, required: list[str], findings: DataFrame) -> DataFrame:
    """Unambiguous abbreviation tables in documents without blocking findings, if exactly the required rules are approved."""
    wanted = tables.sparkSession.createDataFrame([(r,) for r in required], "rule_id string")
    given = approved.select("rule_id")
    if not (wanted.exceptAll(given).isEmpty() and given.exceptAll(wanted).isEmpty()):
        raise ValueError("incomplete_rule_group")
    blocked = findings.where("policy = 'block_formatting'").select("doc_id").distinct()
    return tables.where("role = 'abbreviation_table' and not review and n_rows >= 2").join(blocked, "doc_id", "left_anti")


def desired_borders(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, cell_index, edge, eighths) for every cell: rules above, below the header and at the end."""
    last = cells.groupBy("doc_id", "table_index").agg(F.max("row_index").alias("_last"))
    rows = cells.select("doc_id", "table_index", "row_index", "cell_index").distinct().join(last, ["doc_id", "table_index"])
    row = F.col("row_index")
    top = F.when(row == 0, F.lit(TOP)).otherwise(0.0)
    bottom = F.when(row == F.col("_last"), F.lit(BOTTOM)).when(row == 0, F.lit(HEADER)).otherwise(0.0)
    edges = F.array(*[F.struct(F.lit(e).alias("edge"), F.bround(w * 8).cast("int").alias("eighths")) for e, w in (("top", top), ("bottom", bottom), *((e, F.lit(0.0)) for e in ("left", "right", "start", "end", "insideV")))])
    return rows.where("_last >= 1").select("doc_id", "table_index", "row_index", "cell_index", F.explode(edges).alias("x")).select("doc_id", "table_index", "row_index", "cell_index", "x.*")


def border_operations(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """The borders to change: desired ones that are not observed as they should be; an absent border counts as 0."""
    key = ["doc_id", "table_index", "row_index", "cell_index", "edge"]
    have = observed.select(*key, F.col("eighths").alias("now"))
    return desired.join(have, key, "left").where(F.coalesce("now", F.lit(0)) != F.col("eighths")).select(*key, F.col("now").alias("from_eighths"), F.col("eighths").alias("to_eighths"))
