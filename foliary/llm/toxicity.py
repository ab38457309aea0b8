"""Toxicity by compression distance: windows of a text under an ordinary and a toxic zstandard dictionary.

Training, on a bounded sample of labelled rows, whose whole texts are read on the executors; the driver gets counts,
spans, pieces for the ordinary dictionary and the features of each row. Both dictionaries are trained by zstandard: the
ordinary one on pieces of ordinary texts, the toxic one on the stretches of toxic texts that are toxic rather than
ordinary matter, each as often as texts hold it. Such a stretch is covered by character sequences that toxic texts hold
LIFT times as often as ordinary ones. Under the toxic label a window is compressed with the toxic dictionary before the
ordinary one, so that ordinary matter costs the same under both, and a window's gain, the bytes that the toxic dictionary
saves, is nearly always 0 in ordinary text. Stretches that gain in ordinary training texts too are dropped, and the
dictionary is trained anew. A logistic model on the gains of a document's windows is fitted last; its threshold is 0.5.

Every whole text is scored, in windows of WINDOW words that do not overlap. Labels, languages, sources and ids are no
inputs of a score.

Defined cases: a null or empty text has no windows and scores as a text without gains; without toxic or without
ordinary labelled texts, the training share of toxic rows (0 without any) is every text's score; a null id is
scored and never trains, as it joins with no label; repeated rows are scored alike; of labels with the same id, one row
per label counts; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import scratch
from foliary.llm.worker import task

WINDOW = 4
#: Lengths of the character sequences that are counted, in bytes; the least is what the compressor matches.
SEQUENCES = (5, 6, 7, 8)
#: How many times more often toxic texts must hold a sequence, and the share of toxic texts that must.
LIFT = 5
LEAST_SHARE = 0.02
TOXIC_BYTES = 16 << 10
#: Stretches that stand in one training sample of the toxic dictionary, and how often one stretch counts at most.
JOINED, REPEATED = 20, 500
ORDINARY_BYTES = 60 << 10
#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 4000
#: Pieces of ordinary texts that the ordinary dictionary is trained on: about so many, so long, and of so many bytes at most.
PIECES, PIECE_BYTES, PIECES_BYTES = 60000, 1024, 32 << 20
#: Longer words are taken in overlapping stretches of so many bytes, so that a span is never longer.
WORD_BYTES = 40
#: Sequences that a task counts before it hands them on.
COUNTED = 1 << 16
FOLDS = 5


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _stretches(word: bytes) -> Iterator[bytes]:
    """The word between spaces, in stretches that together hold each of its sequences."""
    x, size, longest = b" " + word + b" ", WORD_BYTES + 2, max(SEQUENCES)
    for i in range(0, max(1, len(x) - longest + 1), size - longest + 1):
        yield x[i : i + size]


def _all_stretches(text: str) -> set[bytes]:
    return {x for w in set(words_of(text)) for x in _stretches(w)}


def _sequences(stretches: set[bytes], n: int) -> set[bytes]:
    return {x[i : i + n] for x in stretches for i in range(len(x) - n + 1)}


def _spans(text: str, surplus: frozenset[bytes]) -> set[bytes]:
    """The longest spans of the text's words that sequences with a surplus cover."""
    spans: set[bytes] = set()
    for x in _all_stretches(text):
        start, end = 0, -1
        for i in range(len(x)):
            long = max((n for n in SEQUENCES if i + n <= len(x) and x[i : i + n] in surplus), default=0)
            if not long:
                continue
            if i > end:
                if end > 0:
                    spans.add(x[start:end])
                start = i
            end = max(end, i + long)
        if end > 0:
            spans.add(x[start:end])
    return spans


def toxic_dictionary(spans: dict[bytes, int]) -> bytes:
    """The dictionary that zstandard trains on the spans, each as often as it counts."""
    import zstandard as zs

    # mixed, so that a sample holds different spans
    samples = [x for _, x in sorted((zlib.crc32(x + b"%d" % k), x) for x, n in spans.items() for k in range(min(n, REPEATED)))]
    joined = [b"\n".join(samples[i : i + JOINED]) for i in range(0, len(samples), JOINED)]
    try:
        return zs.train_dictionary(TOXIC_BYTES, joined, k=24, d=6, steps=1, level=3).as_bytes()
    except zs.ZstdError:  # too little to train on: the matter itself is the dictionary
        return b"\n".join(sorted(spans, key=lambda x: (spans[x], x)))[-TOXIC_BYTES:]


class Gains:
    """The gains of a text's windows: bytes under the ordinary dictionary less bytes under the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        # a few bytes that both dictionaries hold stand before each window, so that short ones are compressed at all
        self.lead = ordinary[-64:]
        params = zs.ZstdCompressionParameters(window_log=14, hash_log=17, chain_log=17, search_log=4, min_match=5, target_length=32, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
        self.pair = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress for d in (ordinary, toxic + ordinary)]

    def __call__(self, text: str | None) -> list[int]:
        plain, toxic = self.pair
        lead = self.lead
        return [len(plain(x)) - len(toxic(x)) for x in (lead + w for w in windows(text))]


def features(gains: list[int]) -> list[float]:
    """The two greatest gains, the sum of those of 2 bytes or more, their rate among the windows, the number of windows, the sum's rate."""
    top = sorted(gains, reverse=True)[:2] + [0, 0]
    some = [g for g in gains if g >= 2]
    return [min(top[0], 12), min(max(top[1], 0), 12), math.log1p(sum(some)), 10 * len(some) / (len(gains) + 10), math.log1p(len(gains)) / 4, sum(some) / (len(gains) + 10)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]

    def scorer(self):
        if not self.toxic:
            return lambda text: self.weights[0]
        gains, w = Gains(self.ordinary, self.toxic), self.weights

        def score(text: str | None) -> float:
            z = w[0] + sum(a * b for a, b in zip(w[1:], features(gains(text)), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _pieces(text: str) -> list[bytes]:
    return [w[i : i + PIECE_BYTES] for w in windows(text, 64) for i in range(0, len(w), PIECE_BYTES)]


def _each(sample: DataFrame, schema: str, f: Callable[[Iterator[tuple[int, int, str]]], Iterator[list[tuple]]]) -> DataFrame:
    """The rows that ``f`` makes of each task's (id, y, text)."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        for made in f(row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("id", "y", "text")), strict=True)):
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], list(names))

    return sample.select("id", "y", "text").mapInArrow(task(rows), schema)


def _sizes(texts):
    for _, y, t in texts:
        pieces = [] if y else _pieces(t)
        yield [(y, 1, len(pieces), sum(map(len, pieces)))]


def _counts(texts):
    counts: dict[bytes, list[int]] = {}
    for _, y, t in texts:
        stretches = _all_stretches(t)
        for size in SEQUENCES:  # one length at a time, as a long text has very many of each
            for x in _sequences(stretches, size):
                counts.setdefault(x, [0, 0])[y] += 1
            if len(counts) > COUNTED:
                yield [(x, *n) for x, n in counts.items()]
                counts = {}
    yield [(x, *n) for x, n in counts.items()]


def train(sample: DataFrame) -> Model:
    """Both dictionaries and the calibration, from the whole texts of labelled rows (id, y, text)."""
    import zstandard as zs

    sizes = {r["y"]: r for r in _each(sample, "y long, texts long, pieces long, bytes long", _sizes).groupBy("y").agg(F.sum("texts").alias("texts"), F.sum("pieces").alias("pieces"), F.sum("bytes").alias("bytes")).collect()}
    n_toxic, n_ordinary = (sizes[y]["texts"] if y in sizes else 0 for y in (1, 0))
    unknown = Model(b"", b"", [n_toxic / max(1, n_toxic + n_ordinary)])
    if not n_toxic or not n_ordinary:
        return unknown
    toxic, ordinary = sample.where("y = 1"), sample.where("y = 0")

    counts = _each(sample, "x binary, ordinary long, toxic long", _counts).groupBy("x").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    gain = F.col("toxic") / F.lit(float(n_toxic)) - F.lit(float(LIFT)) * (F.col("ordinary") + 0.5) / F.lit(float(n_ordinary))
    surplus = frozenset(bytes(r["x"]) for r in counts.where((F.col("toxic") >= max(3, LEAST_SHARE * n_toxic)) & (gain > 0)).select("x").collect())

    def spans_of(texts):
        found: Counter = Counter()
        for _, _, t in texts:
            found.update(_spans(t, surplus))
        yield list(found.items())

    spans = {bytes(r["x"]): r["n"] for r in _each(toxic, "x binary, n long", spans_of).groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect()} if surplus else {}
    if not spans:
        return unknown

    step = max(1, sizes[0]["pieces"] // PIECES, -(-sizes[0]["bytes"] // PIECES_BYTES))

    def pieces_of(texts):
        for i, _, t in texts:
            yield [(i, k, x) for k, x in enumerate(_pieces(t)) if zlib.crc32(x + b"%d %d" % (i, k)) % step == 0]

    pieces = [bytes(r["x"]) for r in _each(ordinary, "id long, k long, x binary", pieces_of).orderBy("id", "k", "x").collect()]
    try:
        base = zs.train_dictionary(ORDINARY_BYTES + 4096, pieces, k=256, d=8, steps=1, level=3).as_bytes()[-ORDINARY_BYTES:]
    except zs.ZstdError:  # too little to train on: the matter itself is the dictionary
        base = b"".join(pieces)[-ORDINARY_BYTES:]

    def tally(texts: DataFrame, found_in: Callable[[str], set[int]]) -> Counter:
        def rows(texts):
            n: Counter = Counter()
            for _, _, t in texts:
                n.update(found_in(t))
            yield list(n.items())

        return Counter({r["n"]: r["texts"] for r in _each(texts, "n long, texts long", rows).groupBy("n").agg(F.sum("texts").alias("texts")).collect()})

    content, least = toxic_dictionary(spans), min(SEQUENCES)
    for _ in range(2):
        names = list(spans)
        where: dict[bytes, set[int]] = {}
        for n, x in enumerate(names):
            for i in range(len(x) - least + 1):
                where.setdefault(x[i : i + least], set()).add(n)
        kept: list[Gains] = []  # a task's own

        def gaining(t: str, content: bytes = content, where: dict[bytes, set[int]] = where, kept: list[Gains] = kept) -> set[int]:
            if not kept:
                kept.append(Gains(base, content))
            return {n for g, w in zip(kept[0](t), windows(t), strict=True) if g >= 2 for i in range(len(w) - least + 1) for n in where.get(w[i : i + least], ())}

        blamed = tally(ordinary, gaining)
        gone = {names[n] for n, c in blamed.items() if LIFT * c / n_ordinary > spans[names[n]] / n_toxic}
        # a span that shares its sequences with a commoner one is not to blame for it
        gone = {x for x in gone if not any(x != y and x in y and y not in gone for y in names)}
        if not gone or len(gone) == len(spans):
            break
        spans = {x: n for x, n in spans.items() if x not in gone}
        content = toxic_dictionary(spans)

    def features_of(texts):
        gains = Gains(base, content)
        for _, y, t in texts:
            yield [(y, *features(gains(t)))]

    rows = np.array([tuple(r) for r in _each(sample, "y long, a double, b double, c double, d double, e double, f double", features_of).orderBy("y", "a", "b", "c", "d", "e", "f").collect()], dtype=float)
    return Model(base, content, _logistic(rows[:, 1:], rows[:, 0]))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most SAMPLE_ROWS labelled rows of each label, those of the least hash, out of the training folds."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    marked = marked.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0)
    rank = F.xxhash64(F.col("id"), F.lit("sample"))
    picked = None
    for y in (1, 0):
        some = marked.where(F.col("y") == y).orderBy(rank, "id").limit(SAMPLE_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return train(scratch.save(texts.join(F.broadcast(picked), "id").select("id", F.col("y").cast("long").alias("y"), "text"), "labelled"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([of(t) for t in batch["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(task(rows), "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic: a row is judged by its own text, also if its id is null or not its alone."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < 0.5 for t in batch[text_col].to_pylist()], pa.bool_()))

    return docs.mapInArrow(task(rows), docs.schema)
