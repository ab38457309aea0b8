"""Quality rules: base counts of every text, and robust multivariate outliers per language and source.

``measure`` counts in whole texts. ``judge`` turns the counts into a vector of variance-stabilised shares, estimates
centre and scatter of each group by the minimum covariance determinant (MCD), and rejects a document whose Mahalanobis
distance from its group is over a chi-squared cutoff.

The MCD is found by concentration steps over all rows from three starts: medians and median absolute deviations, the
sign covariance around the medians, and the classical estimate. A step takes the share ``COVER`` of a group's rows that
lie nearest, and estimates anew from them; steps go on until no determinant falls any more, and of a group's three
results the one of the least determinant stands. A step is one aggregation to a bounded number of distance bins a group,
and the starts come from bins of values, so that no group, however large, comes together in one task. Vectors are rounded
to 1 / GRID and summed as integers, so results do not depend on the order of rows. A variance below the least
spread of the features, in any direction, counts as that spread.

A group's estimate is drawn towards that of its language, and that towards the estimate over all rows, by PRIOR
equivalent rows and with the gap between their centres added to the scatter: there is no least size of a group, and a
source of few rows with matter of its own kind is not rejected for it. The distance of a short text is discounted by the
sampling noise of its shares.

Defined cases: a null or empty text has zero counts and fails the base rule; null languages and null sources are groups
of their own; repeated rows count as often as they stand there; an empty table gives no rows; a few rows in all are
judged with the widest spread, so that hardly any is rejected; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import save
from foliary.llm.textkernel import Words, batches_by_chars, codepoints, ngram_hashes

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
#: Share of rows that the estimate rests on; steps end when no log determinant falls by more than SETTLED.
COVER = 0.75
SETTLED = 1e-3
MOST_STEPS = 40
#: Rows that the estimate of the language, or over all, counts as.
PRIOR = 60
GRID = 1024
#: Bins of distances and of values: by logarithm, and by inverse hyperbolic sine.
BINS_PER_E = 32
VALUE_BINS = 64
#: Tail of the chi-squared distribution beyond which a document is an outlier.
TAIL = 1e-3
#: Words at which a document's own sampling noise is as large as the spread between documents.
HALF_WORDS = 50
#: Name, the least standard deviation that counts as spread, and the share itself.
FEATURES = ("word_length", "symbols", "dup_lines", "repeat_words", "upper", "marks")
LEAST_SPREAD = np.array([0.06, 0.12, 0.18, 0.14, 0.10, 0.12])
BATCH_CHARS = 1 << 19

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks")
_KNOWN = 0x3000
_UPPER = np.array([chr(c).isupper() for c in range(_KNOWN)])
_LETTER = np.array([chr(c).isalpha() for c in range(_KNOWN)])
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], dtype=np.uint32)
_MARKS = np.array([ord(c) for c in "!?;:\"()[]{}=+_~^/\\@`"], dtype=np.uint32)


def counts(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text, a row per text."""
    out = [np.zeros((0, len(COUNTS)), dtype=np.int64)]
    for some in batches_by_chars(texts, BATCH_CHARS):
        points, offsets = codepoints(texts[some])
        words = Words(points, offsets)
        known = np.minimum(points, _KNOWN - 1)

        def per_text(flags: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return total[offsets[1:]] - total[offsets[:-1]]

        rows = np.zeros((len(offsets) - 1, len(COUNTS)), dtype=np.int64)
        rows[:, 0] = np.diff(words.range)
        rows[:, 1] = per_text(~words.blank)
        rows[:, 2] = per_text(np.isin(points, _SYMBOLS))
        rows[:, 6], rows[:, 7] = per_text(_UPPER[known] & (points < _KNOWN)), per_text(_LETTER[known] | (points >= _KNOWN))
        rows[:, 8] = per_text(np.isin(points, _MARKS))
        breaks = np.flatnonzero(points == 10)
        starts = np.union1d(offsets[:-1], breaks + 1)
        starts = starts[starts < len(points)]
        ends = np.minimum(np.append(starts[1:], len(points)), len(points))
        ends = ends - (points[ends - 1] == 10) * (ends > starts) if len(starts) else ends
        filled = np.concatenate(([0], np.cumsum(~words.blank, dtype=np.int64)))
        has_word = filled[ends] > filled[starts]
        starts, ends = starts[has_word], ends[has_word]
        lines = words.slices.hash(starts, ends)
        line_range = np.searchsorted(starts, offsets)
        grams = ngram_hashes(words.hash, 3)
        for i, ((a, b), (c, d)) in enumerate(zip(zip(words.range[:-1].tolist(), words.range[1:].tolist(), strict=True), zip(line_range[:-1].tolist(), line_range[1:].tolist(), strict=True), strict=True)):
            rows[i, 3] = d - c
            if d - c > 1:
                rows[i, 4] = d - c - len(np.unique(lines[c:d]))
            if b - a > 3:
                _, inverse, times = np.unique(grams[a : b - 2], return_inverse=True, return_counts=True)
                twice = times[inverse] > 1
                covered = np.zeros(b - a, dtype=bool)
                for k in range(3):
                    covered[k : k + len(twice)] |= twice
                rows[i, 5] = covered.sum()
        out.append(rows)
    return np.concatenate(out)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and COUNTS of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    parts = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_letters"), share("n_marks", "n_words")]
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


D = len(FEATURES)
_PAIRS = list(combinations_with_replacement(range(D), 2))
_NUMBERS = [f"c{i}" for i in range(D)] + [f"p{i}_{j}" for i, j in _PAIRS]
#: c: centre, p: scatter.
_PARAMS = "g string, start string, rows long, logdet double, " + ", ".join(f"{c} double" for c in _NUMBERS)


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _floored(scatter: np.ndarray) -> np.ndarray:
    """The scatter with no variance, in any direction, below the features' least spread: a few rows span no more than a plane."""
    values, axes = np.linalg.eigh(scatter / np.outer(LEAST_SPREAD, LEAST_SPREAD))
    return (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(LEAST_SPREAD, LEAST_SPREAD)


def _row(g: str, start: str, rows: int, centre: np.ndarray, scatter: np.ndarray) -> list:
    scatter = _floored(scatter)
    return [g, start, rows, float(np.linalg.slogdet(scatter)[1]), *centre, *(scatter[i, j] for i, j in _PAIRS)]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _PARAMS.split(", ")])


def _square(numbers: dict) -> np.ndarray:
    out = np.zeros((D, D))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = numbers[f"p{i}_{j}"]
    return out


def _moments(sums: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    n = int(sums["n"].sum())
    centre = np.array([sums[f"s{i}"].sum() for i in range(D)]) / n / GRID
    scatter = np.zeros((D, D))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = sums[f"s{i}_{j}"].sum() / n / GRID**2 - centre[i] * centre[j]
    return n, centre, scatter


def _from_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations, from counts of binned values."""
    centre, spread = np.zeros(D), np.zeros(D)
    for j, part in pdf.groupby("j"):
        x, n = np.sinh(part["bin"].to_numpy() / VALUE_BINS), part["n"].to_numpy()
        middle = lambda v, w: v[(o := np.argsort(v, kind="stable"))][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)]
        centre[j] = middle(x, n)
        spread[j] = 1.4826 * middle(np.abs(x - centre[j]), n)
    return _frame([_row(pdf["g"].iloc[0], "median", int(pdf.loc[pdf["j"] == 0, "n"].sum()), centre, np.diag(spread**2))])


def _classical(pdf: pd.DataFrame) -> pd.DataFrame:
    return _frame([_row(pdf["g"].iloc[0], "mean", *_moments(pdf))])


def _by_sign(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sign covariance, in units of the deviations around the medians."""
    first = pdf.iloc[0]
    spread = np.sqrt(np.array([first[f"p{i}_{i}"] for i in range(D)]))
    n, _, signs = _moments(pdf.assign(**{f"s{i}": 0 for i in range(D)}))
    return _frame([_row(first["g"], "sign", n, np.array([first[f"c{i}"] for i in range(D)]), signs * D * np.outer(spread, spread))])


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the nearest bins of a group that hold the share COVER of its rows."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    last = int(np.searchsorted(np.cumsum(n), COVER * n.sum()))
    _, centre, scatter = _moments(pdf.iloc[: last + 1])
    return _frame([_row(pdf["g"].iloc[0], pdf["start"].iloc[0], int(n.sum()), centre, scatter)])


def _widened(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scatter of the nearest rows, which is tighter than the cloud's, widened so that their edge lies at its quantile."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    last = int(np.searchsorted(np.cumsum(n), COVER * n.sum()))
    share = min(np.cumsum(n)[last] / n.sum(), 0.999)
    edge = np.exp((pdf["bin"].iloc[last] + 0.5) / BINS_PER_E)
    first = pdf.iloc[0]
    return _frame([_row(first["g"], first["start"], int(n.sum()), np.array([first[f"c{i}"] for i in range(D)]), _square(first) * max(1.0, edge / chi2_quantile(share, D)))])


def _precision(numbers: dict) -> np.ndarray:
    return np.linalg.inv(_square(numbers))


def _distance() -> Column:
    """The squared distance of x from c by the precision q."""
    gap = [F.col(f"x{i}") / GRID - F.col(f"c{i}") for i in range(D)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"q{i}_{j}") * gap[i] * gap[j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _inverted(params: DataFrame) -> DataFrame:
    """Parameters with the precision (q) beside the scatter."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inverse = [_precision(r) for r in pdf.to_dict("records")]
            yield pdf.assign(**{f"q{i}_{j}": [m[i, j] for m in inverse] for i, j in _PAIRS})

    return params.mapInPandas(add, ", ".join(f"{c} {t}" for c, t in params.dtypes) + ", " + ", ".join(f"q{i}_{j} double" for i, j in _PAIRS))


def estimate(rows: DataFrame) -> DataFrame:
    """The MCD parameters of each g, from rows (g, x0, ...)."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.round(F.asinh(F.col(f"x{i}") / GRID) * VALUE_BINS).cast("int").alias("bin")) for i in range(D)]))
    tally = rows.select("g", values.alias("v")).groupBy("g", "v.j", "v.bin").agg(F.count("*").alias("n"))
    medians = save(tally.groupBy("g").applyInPandas(_from_bins, _PARAMS), "mcd-median")
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    sums = [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(D)), *products]
    means = rows.groupBy("g").agg(*sums).groupBy("g").applyInPandas(_classical, _PARAMS)
    # unit vectors from the medians, in deviations, on the grid: their products are summed as integers too
    gap = [(F.col(f"x{i}") / GRID - F.col(f"c{i}")) / F.sqrt(f"p{i}_{i}") for i in range(D)]
    length = F.sqrt(sum((x * x for x in gap), F.lit(1e-12)))
    unit = rows.join(medians, "g").select("g", *[F.round(x / length * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(gap)])
    signs = unit.groupBy("g").agg(F.count("*").alias("n"), *products).join(medians, "g").groupBy("g").applyInPandas(_by_sign, _PARAMS)
    params = save(medians.unionByName(means).unionByName(signs), "mcd")

    bins = F.floor(F.log(_distance() + F.lit(1e-6)) * BINS_PER_E).cast("int").alias("bin")
    active, done = params, None
    for _ in range(MOST_STEPS):
        near = rows.join(_inverted(active), "g").select("g", "start", bins, *[f"x{i}" for i in range(D)])
        made = save(near.groupBy("g", "start", "bin").agg(*sums).groupBy("g", "start").applyInPandas(_concentrate, _PARAMS), "mcd")
        if done is not None:  # the first step leaves the start behind, whatever its determinant
            before = active.select("g", "start", F.col("logdet").alias("before"))
            settled = made.join(before, ["g", "start"]).where(F.col("logdet") >= F.col("before") - SETTLED).select("g", "start")
            done = done.unionByName(made.join(settled, ["g", "start"], "left_semi"))
            made = save(made.join(settled, ["g", "start"], "left_anti"), "mcd")
            if made.isEmpty():
                break
        else:
            done = made.limit(0)
        active = made
    else:
        done = done.unionByName(active)
    best = save(done.groupBy("g").agg(F.min_by(F.struct("start", "rows", "logdet", *_NUMBERS), F.struct("logdet", "start")).alias("x")).select("g", "x.*"), "mcd-best")
    edges = rows.join(_inverted(best), "g").select("g", "start", bins, *_NUMBERS).groupBy("g", "start", "bin", *_NUMBERS).agg(F.count("*").alias("n"))
    return save(edges.groupBy("g").applyInPandas(_widened, _PARAMS), "mcd-wide")


def _blended(own: dict, above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of a group, drawn towards those above it by PRIOR rows."""
    centre, scatter = np.array([own[f"c{i}"] for i in range(D)]), _square(own)
    weight = own["rows"] / (own["rows"] + PRIOR)
    if above is None:
        return centre, weight * scatter + (1 - weight) * np.diag((4 * LEAST_SPREAD) ** 2)
    gap = centre - above[0]
    return weight * centre + (1 - weight) * above[0], weight * scatter + (1 - weight) * (above[1] + np.outer(gap, gap))


def blend(groups: DataFrame, params: DataFrame) -> DataFrame:
    """(g0, rows, c, p) of each group of (g0, g1, g2), with its own parameters drawn towards its language's and the overall ones."""
    nested = F.struct("rows", *_NUMBERS)
    for i in range(3):
        groups = groups.join(params.select(F.col("g").alias(f"g{i}"), nested.alias(f"own{i}")), f"g{i}")
    flat = groups.select("g0", *[F.col(f"own{i}.{c}").alias(f"{c}_of{i}") for i in range(3) for c in ("rows", *_NUMBERS)])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                above = None
                for i in (2, 1, 0):
                    own = {c: r[f"{c}_of{i}"] for c in ("rows", *_NUMBERS)}
                    above = _blended(own, above)
                out.append([r["g0"], r["rows_of0"], *above[0], *(above[1][i, j] for i, j in _PAIRS)])
            yield pd.DataFrame(out, columns=["g0", "rows", *_NUMBERS])

    return flat.mapInPandas(made, "g0 string, rows long, " + ", ".join(f"{c} double" for c in _NUMBERS))


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, group_rows."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    lang, source = part(F.col("lang")), part(F.col("source"))
    levels = [F.concat(F.lit("s"), lang, F.lit("\x1f"), source), F.concat(F.lit("l"), lang), F.lit("a")]
    rows = measure(docs, **columns).withColumn("base_failed", failed)
    rows = save(rows.select("*", *_vector(), *[x.alias(f"g{i}") for i, x in enumerate(levels)]), "counts")
    sound = rows.where("not base_failed")
    spread = sound.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *[f"x{i}" for i in range(D)])
    used = save(_inverted(blend(sound.select("g0", "g1", "g2").distinct(), estimate(spread))), "mcd-used").withColumnRenamed("rows", "group_rows")
    judged = rows.join(used, "g0", "left")
    discounted = F.round(_distance() * F.col("n_words") / (F.col("n_words") + HALF_WORDS), 6)
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), discounted))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - TAIL, D))
    return judged.select("doc_id", *[c for c in COUNTS if c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", kept.alias("kept"), "distance", "group_rows")
