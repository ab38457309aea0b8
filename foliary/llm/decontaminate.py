"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Every document is cut into overlapping passages of PASSAGE words; each is a query against the inverted index of the
items, and all items that score at least THRESHOLD of the score they would give themselves are retrieved. Weights are
divided by the item's own score, so one threshold serves all. Retrieval is block-max WAND over a batch of passages:

1. Terms are parted into essential and other ones, the others being so common that they cannot carry an item to half the
   threshold. A passage has no pivot, and is left out, if its essential terms' upper bounds do not reach the rest in any
   of at most GROUPS groups of blocks; the bounds of all passages of a document are summed at once.
2. For a passage that is left, upper bounds of blocks of items are summed over its terms; only blocks that can reach the
   threshold are opened, and only their postings are scored.

Both tests are bounds, so nothing above the threshold is lost. A retrieved item counts as a leak if, around the passage,
the document holds at least OVERLAP of the n-grams of its question and of its answer, or at least WHOLE of those of both
together, since an answer of a word or two may have been changed. Every retrieved pair of passage and item is verified,
the best first, until one holds. Words are compared in lower case without punctuation; in scripts without spaces, every
character is a word.

The index is built from shards of the items of bounded size, each broadcast in turn, so a large benchmark costs more
passes rather than more memory. Document frequencies and the mean length are those of all items, so scores and what is
retrieved do not depend on the shards.

Defined cases: null or empty texts and items hold no words and match nothing; an item without an answer is judged by its
question alone, one without a question by its answer; items of the same text are each reported; a row per document row and item, with the
best passage that is verified (the first of equals); a null doc_id is reported as null; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import save
from foliary.llm.textkernel import batches_by_chars, folded_words, ngram_hashes
from foliary.llm.worker import task

STRIDE = 64
#: Two strides, which ``pivots`` relies on.
PASSAGE = 2 * STRIDE
#: Longer items are indexed in parts of so many words, each of which fits into a passage.
PART = 64
THRESHOLD = 0.6
GRAM = 3
OVERLAP = 0.6
WHOLE = 0.75
K1, B = 1.2, 0.75
BLOCK = 4
GROUPS = 64
#: Word hits whose bounds are summed at a time.
HITS = 1 << 14
SHARD_CHARS = 16 << 20
BATCH_CHARS = 1 << 19

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that comes as one text: its last sentence is the answer if others precede it."""
    parts = [p for p in _SENTENCE.split(text or "") if any(c.isalnum() for c in p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def _grams(words: np.ndarray) -> np.ndarray:
    """The words' distinct n-grams, shorter ones if there are few words."""
    return np.unique(ngram_hashes(words, min(GRAM, len(words)))) if len(words) else words


def _parts(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in even parts of at most PART."""
    return np.array_split(words, -(-len(words) // PART)) if len(words) else []


class ItemIndex:
    """Postings of the items' parts, sorted by part, in blocks of BLOCK parts with their greatest weight.

    ``corpus`` has the number of parts, their mean length and the frequency of each term if these items are only a shard of all.
    """

    def __init__(self, items: list[tuple[int | None, str, str]], corpus: tuple[int, float, dict[int, int]] | None = None):
        self.ids = [i for i, _, _ in items]
        words = folded_words([q for _, q, _ in items] + [a for _, _, a in items])
        of = [words.hash[a:b] for a, b in zip(words.range[:-1], words.range[1:], strict=True)]
        self.questions, self.answers = of[: len(items)], of[len(items) :]
        parts, self.item_of = [], []
        for n, (q, a) in enumerate(zip(self.questions, self.answers, strict=True)):
            for piece in _parts(np.concatenate((q, a))):
                parts.append(piece)
                self.item_of.append(n)
        self.item_of = np.array(self.item_of, dtype=np.int64)
        self.vocabulary, term = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        key, tf = np.unique(term * max(1, len(parts)) + part, return_counts=True)
        self.post_term, self.post_part = np.divmod(key, max(1, len(parts)))
        n, lengths = len(parts), np.array([len(p) for p in parts], dtype=float)
        df = np.bincount(self.post_term, minlength=len(self.vocabulary))
        total, mean, seen = corpus or (n, lengths.mean() if n else 1.0, None)
        often = df if seen is None else np.array([seen[t] for t in self.vocabulary.tolist()], dtype=np.int64)
        idf = np.log1p((total - often + 0.5) / (often + 0.5))
        weight = idf[self.post_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.post_part] / mean))
        self.weight = weight / np.bincount(self.post_part, weight, n)[self.post_part]
        self.ptr = np.searchsorted(self.post_term, np.arange(len(self.vocabulary) + 1))
        block = self.post_term * (n // BLOCK + 1) + self.post_part // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
        self.block_weight = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.block_id = self.post_part[starts] // BLOCK
        self.block_ptr = np.searchsorted(self.post_term[starts], np.arange(len(self.vocabulary) + 1))
        self.blocks = n // BLOCK + 1
        self.bound = np.zeros((len(self.vocabulary), min(GROUPS, self.blocks)), dtype=np.float32)
        np.maximum.at(self.bound, (self.post_term[starts], self.block_id % self.bound.shape[1]), self.block_weight.astype(np.float32))
        # the commonest terms, as long as no item gets half the threshold from them
        order = np.argsort(-df, kind="stable")
        low, high = 0, len(order)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._share(order[:mid], n) <= THRESHOLD / 2 else (low, mid - 1)
        self.essential = np.ones(len(order), dtype=bool)
        self.essential[order[:low]] = False
        self.needed = THRESHOLD - self._share(order[:low], n) - 1e-4
        self.grams = [(_grams(q), _grams(a), _grams(np.concatenate((q, a)))) for q, a in zip(self.questions, self.answers, strict=True)]

    def _share(self, terms: np.ndarray, n: int) -> float:
        if not len(terms):
            return 0.0
        among = np.zeros(len(self.vocabulary), dtype=bool)
        among[terms] = True
        chosen = among[self.post_term]
        return float(np.bincount(self.post_part[chosen], self.weight[chosen], n).max())

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words that no item holds."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts that score THRESHOLD at least for a passage of these distinct terms, and their scores."""
        spans = lambda ptr: np.concatenate([np.arange(ptr[t], ptr[t + 1]) for t in terms])
        blocks = spans(self.block_ptr)
        bound = np.bincount(self.block_id[blocks], self.block_weight[blocks], self.blocks)
        opened = bound >= THRESHOLD - 1e-9
        if not opened.any():
            return np.zeros(0, np.int64), np.zeros(0)
        posts = spans(self.ptr)
        posts = posts[opened[self.post_part[posts] // BLOCK]]
        parts, inverse = np.unique(self.post_part[posts], return_inverse=True)
        scores = np.bincount(inverse, self.weight[posts])
        found = scores >= THRESHOLD - 1e-9
        return parts[found], scores[found]

    def pivots(self, hit: np.ndarray, terms: np.ndarray, n: int) -> list[int]:
        """First words of the passages that may reach the threshold, by the bounds of their essential terms."""
        strides = hit // STRIDE
        first = np.flatnonzero(np.concatenate(([True], strides[1:] != strides[:-1])))
        mass = np.zeros((len(first), self.bound.shape[1]), dtype=np.float32)
        ends = np.append(first[1:], len(hit))
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, first[at] + HITS, side="right")))
            mass[at:to] = np.add.reduceat(self.bound[terms[hit[first[at] : ends[to - 1]]]], first[at:to] - first[at], axis=0)
            at = to
        present = strides[first]
        joins = present[1:] == present[:-1] + 1
        follows, leads = np.append(joins, False), np.append(True, ~joins)
        last = max(0, -(-n // STRIDE) - PASSAGE // STRIDE)
        with_next = mass.copy()
        with_next[follows] += mass[1:][follows[:-1]]
        # a passage whose first stride has no hits still holds this one's
        found = np.concatenate((present[with_next.max(axis=1) >= self.needed], present[leads & (mass.max(axis=1) >= self.needed)] - 1))
        return (np.unique(np.clip(found, 0, last)) * STRIDE).tolist()

    def retrieved(self, terms: np.ndarray) -> dict[int, dict[int, float]]:
        """By item, the first words of all passages of a document that score THRESHOLD at least, and their scores."""
        found: dict[int, dict[int, float]] = {}
        hit = np.flatnonzero((terms >= 0) & self.essential[terms]) if len(self.vocabulary) else ()
        if not len(hit):
            return found
        for s in self.pivots(hit, terms, len(terms)):
            inside = np.unique(terms[s : s + PASSAGE])
            for part, score in zip(*self.retrieve(inside[inside >= 0]), strict=True):
                at = found.setdefault(int(self.item_of[part]), {})
                at[s] = max(at.get(s, 0.0), float(score))
        return found

    def leaks(self, words: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of a document."""
        grams: dict[int, np.ndarray] = {}
        for item, scores in sorted(self.retrieved(terms).items()):
            size = len(self.questions[item]), len(self.answers[item])
            reach = max(PASSAGE, sum(size))

            def overlaps(start: int, end: int, item: int = item, size: tuple[int, int] = size) -> list[float]:
                out = []
                for own, length in zip(self.grams[item], (*size, sum(size)), strict=True):
                    n = min(GRAM, length)
                    if n and n not in grams:
                        grams[n] = ngram_hashes(words, n)
                    out.append(float(np.isin(own, grams[n][start : max(start, end - n + 1)]).mean()) if n else 1.0)
                return out

            leaks = lambda x: min(x[:2]) >= OVERLAP or x[2] >= WHOLE
            if len(scores) > 2 and not leaks(overlaps(0, len(words))):  # no part of a document holds more than all of it
                continue
            for s, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
                near = overlaps(max(0, s - reach), min(len(words), s + PASSAGE + reach))
                if leaks(near):
                    yield item, score, near[0], near[1], s
                    break


def _search(docs: DataFrame, index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, ids, out = batch["text"].to_pylist(), batch["id"].to_pylist(), []
            done = 0
            for some in batches_by_chars(texts, BATCH_CHARS):
                words = folded_words(texts[some])
                terms = index.terms(words.hash)
                for i, (a, b) in enumerate(zip(words.range[:-1].tolist(), words.range[1:].tolist(), strict=True)):
                    if b > a:
                        out += [(ids[done + i], index.ids[item], *rest) for item, *rest in index.leaks(words.hash[a:b], terms[a:b])]
                done += len(words.range) - 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return docs.mapInArrow(task(rows), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")


def _both(item: tuple[str | None, str | None], one_text: bool) -> tuple[str, str]:
    return split_item(item[0]) if one_text else (item[0] or "", item[1] or "")


def _statistics(bench: DataFrame, one_text: bool) -> tuple[int, float, DataFrame]:
    """Number and mean length of all items' parts, and (term, df) of their terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, int] = {}
            n = words = 0
            for item in zip(batch["q"].to_pylist(), batch["a"].to_pylist(), strict=True):
                both = folded_words(list(_both(item, one_text)))
                for part in _parts(both.hash):
                    n, words = n + 1, words + len(part)
                    for term in np.unique(part).astype(np.int64).tolist():
                        counts[term] = counts.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.int64()), pa.array([n, *counts.values()], pa.int64()), pa.array([words, *[0] * len(counts)], pa.int64())], ["term", "df", "words"])

    made = save(bench.select("q", "a").mapInArrow(task(rows), "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "item-terms")
    all_ = made.where("term is null").first()
    parts, words = (all_["df"] or 0, all_["words"] or 0) if all_ else (0, 0)
    return parts, words / parts if parts else 1.0, made.where("term is not null").select("term", "df")


def _indexes(items: DataFrame, item_col: str, item_text_col: str | None, question_col: str, answer_col: str) -> Iterator[ItemIndex]:
    """Indexes of shards of the items, each of SHARD_CHARS characters or so."""
    one_text = item_text_col is not None
    parts = [F.col(item_text_col).cast("string").alias("q"), F.lit(None).cast("string").alias("a")] if one_text else [F.col(question_col).cast("string").alias("q"), F.col(answer_col).cast("string").alias("a")]
    bench = items.select(F.col(item_col).cast("long").alias("item"), *parts)
    size = bench.agg(F.sum(F.coalesce(F.length("q"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0)))).first()[0] or 0
    shards = size // SHARD_CHARS + 1
    stats = _statistics(bench, one_text) if shards > 1 else None
    for k in range(shards):
        shard = bench.where(F.pmod(F.xxhash64("item", "q", "a"), F.lit(shards)) == k).orderBy("item", "q", "a").collect()
        made = [(r["item"], *_both((r["q"], r["a"]), one_text)) for r in shard]
        corpus = None
        if stats:
            words = folded_words([x for _, q, a in made for x in (q, a)])
            own = items.sparkSession.createDataFrame([(t,) for t in np.unique(words.hash).astype(np.int64).tolist()], "term long")
            corpus = stats[0], stats[1], {r["term"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in stats[2].join(own, "term").collect()}
        yield ItemIndex(made, corpus)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str | None = "text", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of every leak.

    Items come as questions and answers or, with ``item_text_col``, as one text that ``split_item`` parts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _indexes(items, item_col, item_text_col, question_col, answer_col):
        found = _search(texts, index)
        out = found if out is None else out.unionByName(found)
    return out


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str | None = "text", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """The rows without a leak: a row is judged by its own text, also if its id is null or not its alone."""
    for index in _indexes(items, item_col, item_text_col, question_col, answer_col):
        docs = _without(docs, index, text_col)
    return docs


def _without(docs: DataFrame, index: ItemIndex, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, clean = batch[text_col].to_pylist(), []
            for some in batches_by_chars(texts, BATCH_CHARS):
                words = folded_words(texts[some])
                terms = index.terms(words.hash)
                clean += [next(index.leaks(words.hash[a:b], terms[a:b]), None) is None for a, b in zip(words.range[:-1].tolist(), words.range[1:].tolist(), strict=True)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(task(rows), docs.schema)
