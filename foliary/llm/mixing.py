"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. Raking scales the cells' token weights to the targets of each
source, then of each language, then of each topic, over and over, until all three sets of marginals agree with their
targets to TOLERANCE. No cell can give more tokens than it has, so the rounds are bounded: a cell's fitted tokens are its
weight or all of its tokens, whichever is less, and the other cells of a value make up for it. A cell's calibrated rate
is its fitted tokens over its own tokens. A document is sampled if its reproducible uniform number, of id and seed, is
below its cell's rate: no row depends on another, and a task that is run anew draws the same documents.

Targets are for ``share`` of all tokens. A value whose target is more than all of its tokens gives all of them, and the
other values of its dimension the rest, in their proportions. Where the three targets contradict each other the rounds
end after ROUNDS. What falls short of its target is named in a warning, and ``marginals`` has all of them in a table.

All statistics are aggregated before they are shuffled. The number of cells is checked: up to LOCAL_CELLS of them are
raked in memory, more stay in tables throughout. Both ways take the same steps.

Defined cases: null sources, languages and topics are values of their own, also in a table of targets; targets are shares
by value, scaled to 1 over the values that occur, and a value without a target keeps its own share; documents without
words weigh nothing and are sampled at the overall share; documents with the same id share a fate; an empty table gives
no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import hash01, save

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 200
TOLERANCE = 1e-4
#: Up to so many cells the rounds are a loop in the driver's memory; beyond it they stay in tables, a job a round.
LOCAL_CELLS = 1 << 16
#: Default targets: shares of tokens to this power, which lifts small sources and holds back large ones.
POWER = 0.7
SHARE = 0.5
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form, for tables without a topic of their own."""
    marks = F.length(F.regexp_replace(text, r"[^#*$%&|<>]", ""))
    size = F.length(text)
    return (
        F.when(text.isNull() | (size == 0), "empty")
        .when(text.rlike(r"(?i)licen[sc]ed? |copyright"), "legal")
        .when(text.rlike(r"\S@\S+\.|https?://|\+[0-9]|[0-9]{6}"), "contact")
        .when(50 * marks > size, "symbols")
        .when(size < 1000, "note")
        .otherwise("prose")
    )


def default_targets(cells: DataFrame, name: str, power: float = POWER) -> DataFrame:
    return cells.groupBy(name).agg(F.sum("tokens").alias("t")).select(name, F.pow(F.col("t").cast("double"), power).alias("target"))


def goals(cells: DataFrame, targets: dict[str, DataFrame], share: float) -> dict[str, DataFrame]:
    """(value, own, asked, goal) by dimension: the tokens that a value has, was to give, and can give with the others making up for it."""
    out: dict[str, DataFrame] = {}
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("own")).where("own > 0")
        if d in targets:
            named = targets[d].select(F.coalesce(F.col(d).cast("string"), F.lit(_NULL)).alias(d), F.col("target").cast("double").alias("target")).groupBy(d).agg(F.sum("target").alias("target"))
            own = own.join(named, d, "left")
        else:
            own = own.withColumn("target", F.lit(None).cast("double"))
        given = own.agg(F.sum("target"), F.sum(F.when(F.col("target").isNull(), F.col("own"))), F.sum("own")).first()
        total = float(given[2] or 0)
        free = (given[1] or 0) / (total or 1)
        asked = share * F.when(F.col("target").isNull(), F.col("own").cast("double")).otherwise(F.col("target") / F.lit(given[0] or 1.0) * F.lit((1 - free) * total))
        rows = save(own.select(d, "own", asked.alias("asked")), f"asked-{d}")
        scale = 1.0
        while True:  # a value gives all that it has, or so many times what it was asked for; ends when no more values are full
            full = F.col("asked") * scale >= F.col("own")
            spent = rows.agg(F.sum(F.when(full, F.col("own"))).alias("full"), F.sum(F.when(~full, F.col("asked"))).alias("open")).first()
            new = (share * total - float(spent["full"] or 0)) / float(spent["open"]) if spent["open"] else scale
            if new <= scale * (1 + 1e-12):
                break
            scale = new
        out[d] = rows.withColumn("goal", F.least(F.col("own").cast("double"), F.col("asked") * scale))
    return out


def rake(cells: DataFrame, wanted: dict[str, DataFrame], share: float) -> DataFrame:
    """``cells`` (DIMENSIONS, tokens) with ``fitted``, the raked tokens, none of more than the cell has; wanted as ``goals`` makes it."""
    if cells.limit(LOCAL_CELLS + 1).count() <= LOCAL_CELLS:
        return _rake_here(cells, wanted, share)
    cells = cells.withColumn("weight", F.col("tokens") * F.lit(float(share)))
    fitted = F.least(F.col("weight"), F.col("tokens").cast("double"))
    for _ in range(ROUNDS):
        for n, d in enumerate(DIMENSIONS):
            now = cells.groupBy(d).agg(F.sum(fitted).alias("now")).join(wanted[d].select(d, "goal"), d)
            factor = now.select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            cells = cells.join(factor, d, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).withColumnRenamed("factor", f"factor_{d}")
            if n == len(DIMENSIONS) - 1:
                cells = save(cells, "raked")
        gap = cells.agg(*[F.max(F.when(F.col("tokens") > 0, F.abs(F.coalesce(f"factor_{d}", F.lit(1.0)) - 1))) for d in DIMENSIONS]).first()
        cells = cells.drop(*[f"factor_{d}" for d in DIMENSIONS])
        if max(g or 0.0 for g in gap) <= TOLERANCE:
            break
    return cells.withColumn("fitted", fitted).drop("weight")


def _rake_here(cells: DataFrame, wanted: dict[str, DataFrame], share: float) -> DataFrame:
    """The rounds over cells whose number has been checked."""
    rows = cells.orderBy(*DIMENSIONS).collect()
    most = np.array([r["tokens"] for r in rows], dtype=float)
    weight, heavy = share * most, most > 0
    places = []
    for d in DIMENSIONS:
        values = {r[d]: r["goal"] for r in wanted[d].collect()}
        names = {v: i for i, v in enumerate(sorted({r[d] for r in rows}))}
        places.append((np.array([names[r[d]] for r in rows], dtype=np.int64), np.array([values.get(v, 0.0) for v in names])))
    for _ in range(ROUNDS):
        gap = 0.0
        for at, goal in places:
            now = np.bincount(at, np.minimum(weight, most), len(goal)).astype(float)
            factor = np.divide(goal, now, out=np.zeros_like(now), where=now > 0)[at]
            weight = weight * factor
            gap = max(gap, float(np.abs(factor - 1)[heavy].max(initial=0.0)))
        if gap <= TOLERANCE:
            break
    made = [(*(r[d] for d in DIMENSIONS), r["tokens"], float(f)) for r, f in zip(rows, np.minimum(weight, most), strict=True)]
    return cells.sparkSession.createDataFrame(made, cells.select(*DIMENSIONS, "tokens").withColumn("fitted", F.lit(0.0)).schema)


def marginals(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, own, asked, goal, fitted: tokens of every value, from raked cells."""
    out = None
    for d in DIMENSIONS:
        rows = cells.groupBy(d).agg(F.sum("fitted").alias("fitted")).join(wanted[d], d)
        rows = rows.select(F.lit(d).alias("dimension"), F.when(F.col(d) != _NULL, F.col(d)).alias("value"), "own", "asked", "goal", "fitted")
        out = rows if out is None else out.unionByName(rows)
    return out


def _warn(table: DataFrame, wanted: str) -> None:
    """Name the values that fall furthest short of what is wanted or exceed it."""
    total = table.where(F.col("dimension") == DIMENSIONS[0]).agg(F.sum("fitted")).first()[0] or 0.0
    off = F.col("fitted") - F.col(wanted)
    worst = table.where(F.abs(off) > 10 * TOLERANCE * F.lit(max(total, 1.0))).orderBy(F.abs(off).desc(), "dimension", "value").limit(10).collect()
    if worst:
        named = "; ".join(f"{r['dimension']} {r['value']!r}: {r['fitted']:.0f} of {r[wanted]:.0f} wanted, {r['own']} there are" for r in worst)
        warnings.warn(f"the targets cannot be met in full, furthest off in tokens: {named}", stacklevel=3)


def rates(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``rate``: fitted over own tokens, the share itself where there are none."""
    return cells.withColumn("rate", F.when(F.col("tokens") > 0, F.round(F.least(F.col("fitted") / F.col("tokens"), F.lit(1.0)), 9)).otherwise(F.lit(float(share))))


_NULL = "\x00null"


def _cell(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> list[Column]:
    text = F.col(text_col).cast("string")
    values = (F.col(source_col), F.col(lang_col), F.col(topic_col) if topic_col else topic_of(text))
    named = zip(values, DIMENSIONS, strict=True)
    return [*(F.coalesce(c.cast("string"), F.lit(_NULL)).alias(d) for c, d in named), tokens(text).alias("tokens")]


def cell_rates(rows: DataFrame, targets: dict[str, DataFrame] | None, share: float) -> DataFrame:
    """DIMENSIONS and the calibrated rate of each cell of the rows (DIMENSIONS, tokens)."""
    cells = save(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = goals(cells, targets if targets is not None else {d: default_targets(cells, d) for d in DIMENSIONS}, share)
    raked = save(rates(rake(cells, wanted, share), share), "rates")
    _warn(marginals(raked, wanted), "asked" if targets is not None else "goal")
    return raked.select(*DIMENSIONS, "rate")


def _drawn(doc_id: Column, seed: str) -> Column:
    return hash01(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))) < F.col("rate")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, rate, kept of every row."""
    rows = save(docs.select(F.col(id_col).alias("doc_id"), *_cell(docs, text_col, source_col, lang_col, topic_col)), "mix-rows")
    drawn = rows.join(cell_rates(rows, targets, share), list(DIMENSIONS)).withColumn("kept", _drawn(F.col("doc_id"), seed))
    clear = [F.when(F.col(d) != _NULL, F.col(d)).alias(d) for d in DIMENSIONS]
    return drawn.select("doc_id", *clear, "tokens", "rate", "kept")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with the columns of ``docs``."""
    cell = _cell(docs, text_col, source_col, lang_col, topic_col)
    fitted = cell_rates(docs.select(*cell), targets, share)
    keys = [F.col(f"cell.{d}") == F.col(f"fit.{d}") for d in DIMENSIONS]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*cell).alias("cell"))
    drawn = rows.join(fitted.select(F.struct(*DIMENSIONS).alias("fit"), "rate"), keys)
    return drawn.where(_drawn(F.col("row").getField(id_col), seed)).select("row.*")
