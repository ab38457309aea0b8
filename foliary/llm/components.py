"""Connected components of a link table by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import save


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b). Every node hands its larger (or smaller) neighbours the least node it knows."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id that ``links`` (a, b: long) names: comp is the least id reachable.

    Null ends and loops link nothing. Each round is written to the shared folder, so lineage stays short; the number of
    rounds grows with the logarithm of the longest chain.
    """
    links = save(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        links = save(_star(_star(links, True), False), "links")
        # at rest every node but the least of its component has the one link to that least node, and rounds change nothing
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return tops.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
