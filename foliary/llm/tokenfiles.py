"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write`` deals the documents out by ranges of ``doc_id``; each partition encodes its documents in ascending order
and streams three files into a shared folder:

* ``part-NNNNN-MMM.bin``  the token ids of its documents in a row, little-endian unsigned 16 or 32 bit;
* ``part-NNNNN-MMM.idx``  unsigned 64-bit offsets into it, one more than documents;
* ``part-NNNNN-MMM.doc``  the documents' ids, signed 64 bit (``NULL_ID`` for a null id).

A partition of over PART_TOKENS tokens goes on in further files, numbered MMM. ``manifest`` gives every part its base, the
prefix sum of the token counts of the parts before it, so that a document's global start is base + local offset. ``read``
maps the files into memory, or reads ranges of them where the store is not a local one, and returns a row per document.

Defined cases: a null or empty text is the end id alone; documents with equal ids stand side by side, ordered by a
hash of the text; null ids come first; an empty table makes no files and no rows; further columns are ignored. A file
is written under a name of the task attempt and renamed when whole, so that a lost or repeated task leaves no half file.
A special token's string inside a text is what the tokenizer file makes of it (its default).
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import worker
from foliary.llm.scratch import fresh, open_fs, save
from foliary.llm.textkernel import Slices, batches_by_chars, codepoints

NULL_ID = -(1 << 63)
#: Characters encoded at a time, and pretokens kept by a worker before it starts anew: both bound a worker's memory.
BATCH_CHARS = 1 << 17
#: Tokens after which a file ends with the batch of documents, and tokens that are read back at a time.
PART_TOKENS = 1 << 28
READ_TOKENS = 1 << 23
CACHE_MOST = 1 << 19
#: Code points from here on are left to the tokenizer's own splitter.
PLAIN_BELOW = 0x250
LETTER, NUMBER, SPACE, OTHER = range(4)


def _classes() -> np.ndarray:
    space = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
    kinds = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if c in space else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN_BELOW)], dtype=np.int8)


def pretoken_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where byte-level BPE's splitter begins a piece; all code points are below ``PLAIN_BELOW``.

    A piece is a run of letters, digits or other signs with one space before it at most; of a run of white space,
    the last character stands alone (or before the next piece, if a space); an apostrophe takes s, t, m, d, re, ve, ll.
    """
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    last = first[1:]
    first = first[:-1]
    before = np.concatenate(([OTHER], kind[:-1]))
    after = np.concatenate((kind[1:], [OTHER]))
    space_before = np.concatenate(([False], points[:-1] == 32)) & ~first
    blank = kind == SPACE
    starts = np.where(blank, first | (before != SPACE) | (~last & (after != SPACE)), first | ((before != kind) & ~space_before))
    marks = np.flatnonzero((points == 39) & starts & ~last)
    if len(marks):
        border = np.searchsorted(offsets, marks, side="right")
        end = offsets[border]
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, n - 1)]
        takes = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        pair = (marks + 2 < end) & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
        takes = np.where(pair, 2, takes)
        marks, takes, end = marks[takes > 0], takes[takes > 0], end[takes > 0]
        starts[marks + 1] = False
        rest = marks + 1 + takes
        rest = rest[rest < end]
        starts[rest[kind[rest] == LETTER]] = True
    return starts


def byte_signs() -> dict[int, str]:
    """Byte-level BPE's sign for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    free = iter(range(256, 512))
    return {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(free)) for b in range(256)}


class Encoder:
    """Encodes texts with a tokenizer file; each distinct piece of text is encoded by the library once per worker.

    The pieces' ids stand in ``flat``; ``keys`` and ``slot_of`` are an open-addressed table from a piece's hash to its
    place, and ``second`` has another hash of it: a piece that shares one hash with another is not taken for it. Both are bounded by ``CACHE_MOST`` pieces, after which they start anew. A tokenizer that isn't byte-level BPE
    gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.classes = _classes()
        self.clear()

    def clear(self, least: int = 0) -> None:
        """Start anew, with room for ``least`` pieces at once, as one text may hold more than CACHE_MOST."""
        self.known = 0
        slots = 4 * max(CACHE_MOST, 1 << least.bit_length())
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.slot_of = np.zeros(slots, dtype=np.int32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.second = np.zeros(1 << 16, dtype=np.uint64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 where it isn't known."""
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        there = self.keys[at]
        slot = np.where(there == hashes, self.slot_of[at], -1)
        open_ = np.flatnonzero((there != hashes) & (there != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            there = self.keys[at[open_]]
            hit = there == hashes[open_]
            slot[open_[hit]] = self.slot_of[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return slot

    def _learn(self, hashes: np.ndarray, second: np.ndarray, pieces: list[str]) -> None:
        tokenize, signs, mask = self.model.tokenize, self.signs, len(self.keys) - 1
        coded = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(signs))] for p in pieces]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        k, n, total = self.known, len(coded), int(lengths.sum())
        while k + n > len(self.begin):
            self.begin, self.length, self.second = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length, self.second))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + total] = [i for ids in coded for i in ids]
        self.begin[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.length[k : k + n] = lengths
        self.second[k : k + n] = second
        self.used, self.known = self.used + total, k + n
        for i, h in enumerate(hashes.tolist(), k):
            at = h & mask
            while self.keys[at]:
                at = (at + 1) & mask
            self.keys[at], self.slot_of[at] = h, i

    def _plain(self, texts: list[str], points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(points):
            return [np.zeros(0, np.uint32) for _ in texts]
        start = np.flatnonzero(pretoken_starts(points, offsets, self.classes))
        end = np.append(start[1:], len(points))
        hashes = Slices(points).hash(start, end) | np.uint64(1)
        second = Slices(points, 1).hash(start, end)
        slot = self._find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            joined = "".join(texts)
            unique, at = np.unique(hashes[new], return_index=True)
            if self.known + len(unique) > CACHE_MOST:
                unique, at = np.unique(hashes, return_index=True)
                self.clear(len(unique))
                new = np.arange(len(hashes))
            at = new[at]
            self._learn(unique, second[at], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            slot[new] = self._find(hashes[new])
        if (self.second[slot] != second).any():  # two pieces of one hash: the library decides
            return [np.asarray(x, dtype=np.uint32) for x in self.whole(texts)]
        length = self.length[slot]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.begin[slot] - ends + length, length) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t if isinstance(t, str) else "" for t in texts]
        if not self.by_piece:
            return [np.asarray(x, dtype=np.uint32) for x in self.whole(texts)]
        points, offsets = codepoints(texts)
        plain = [True] * len(texts)
        if len(points) and int(points.max()) >= PLAIN_BELOW:
            odd = np.concatenate(([0], np.cumsum(points >= PLAIN_BELOW)))
            plain = (odd[offsets[1:]] == odd[offsets[:-1]]).tolist()
        for i, t in enumerate(texts):
            if plain[i] and any(s in t for s in self.specials):
                plain[i] = False
        if all(plain):
            return self._plain(texts, points, offsets)
        out: list = [None] * len(texts)
        some = [i for i, p in enumerate(plain) if p]
        mine = [texts[i] for i in some]
        for i, ids in zip(some, self._plain(mine, *codepoints(mine)), strict=True):
            out[i] = ids
        rest = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = np.asarray(ids, dtype=np.uint32)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder; it goes when the files are read back or another operator's task begins."""
    return worker.keep("token files", path, lambda: Encoder(path))


@dataclass(frozen=True)
class TokenFiles:
    """A written set of token files."""

    spark: SparkSession
    folder: str
    dtype: str
    parts: DataFrame

    @property
    def manifest(self) -> DataFrame:
        """part, piece, n_docs, n_tokens, base. A row per file; its prefix sum runs over those few rows."""
        before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
        return self.parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, part, piece, read back from the files."""
        folder, dtype = self.folder, self.dtype

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = open_fs(folder)
            for batch in batches:
                for part, piece, base in zip(*(batch[c].to_pylist() for c in ("part", "piece", "base")), strict=True):
                    yield from _read_part(files, _stem(root, part, piece), dtype, part, piece, base)

        manifest = self.manifest.select("part", "piece", "base")
        return manifest.repartition(max(1, self.parts.count()), "part", "piece").mapInArrow(worker.task(rows), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, piece int")


def _stem(root: str, part: int, piece: int) -> str:
    return f"{root}/part-{part:05d}-{piece:03d}"


def _ranges(files: pafs.FileSystem, path: str, kind: str) -> tuple[int, Callable[[int, int], np.ndarray]]:
    """How many numbers a file holds, and a function that reads those of a range."""
    size = files.get_file_info(path).size // np.dtype(kind).itemsize
    if isinstance(files, pafs.LocalFileSystem):
        mapped = np.memmap(path, dtype=kind, mode="r") if size else np.zeros(0, kind)
        return size, lambda a, b: mapped[a:b]
    file, width = files.open_input_file(path), np.dtype(kind).itemsize
    return size, lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), dtype=kind)


def _read_part(files: pafs.FileSystem, stem: str, dtype: str, part: int, piece: int, base: int) -> Iterator[pa.RecordBatch]:
    _, ids = _ranges(files, stem + ".bin", dtype)
    _, index = _ranges(files, stem + ".idx", "<u8")
    n, docs = _ranges(files, stem + ".doc", "<i8")
    for at in range(0, n, 8192):
        some = range(at, min(at + 8192, n))
        offsets = np.array(index(some.start, some.stop + 1), dtype=np.int64)
        crc, i = [], 0
        while i < len(some):  # as many documents as READ_TOKENS hold, one at least
            to = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_TOKENS, side="right")) - 1)
            held = ids(int(offsets[i]), int(offsets[to]))
            crc += [zlib.crc32(held[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]].astype("<u4").tobytes()) for k in range(i, to)]
            i = to
        part_ids = np.array(docs(some.start, some.stop))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part_ids, mask=part_ids == NULL_ID),
                pa.array(offsets[:-1] + base),
                pa.array(np.diff(offsets)),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(some), part, np.int32)),
                pa.array(np.full(len(some), piece, np.int32)),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32", "part", "piece"],
        )


class _Part:
    """The three files of a part while it is written."""

    def __init__(self, files: pafs.FileSystem, stem: str, mark: str):
        self.files, self.stem, self.mark = files, stem, mark
        self.outs = {s: files.open_output_stream(stem + s + mark) for s in (".bin", ".idx", ".doc")}
        self.outs[".idx"].write(np.zeros(1, "<u8").tobytes())
        self.docs = self.tokens = 0

    def add(self, ids: list[int | None], coded: list[np.ndarray], end_id: int, dtype: str) -> None:
        for x in coded:
            self.outs[".bin"].write(np.append(x, end_id).astype(dtype).tobytes())
        lengths = np.array([len(x) + 1 for x in coded], dtype=np.int64)
        self.outs[".idx"].write((self.tokens + np.cumsum(lengths)).astype("<u8").tobytes())
        self.outs[".doc"].write(np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes())
        self.docs, self.tokens = self.docs + len(coded), self.tokens + int(lengths.sum())

    def finish(self) -> None:
        for s, f in self.outs.items():
            f.close()
            self.files.move(self.stem + s + self.mark, self.stem + s)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text and write the files; ``folder`` must be one that all executors share."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or fresh(spark, "tokens")
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = open_fs(folder)
        number, mark = task.partitionId(), f".{task.taskAttemptId()}.tmp"
        enc, part, pieces = encoder(tokenizer_path), None, 0
        done: list[tuple[int, int, int, int]] = []

        def close(part: _Part) -> None:
            part.finish()
            done.append((number, pieces, part.docs, part.tokens))

        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            for some in batches_by_chars(texts, BATCH_CHARS):
                part = part or _Part(files, _stem(root, number, pieces), mark)
                part.add(ids[some], enc.encode(texts[some]), end_id, dtype)
                if part.tokens >= PART_TOKENS:
                    close(part)
                    part, pieces = None, pieces + 1
        if part:
            close(part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "piece", "n_docs", "n_tokens"])

    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("id"), tie).sortWithinPartitions("id", tie)
    return TokenFiles(spark, folder, dtype, save(dealt.mapInArrow(worker.task(encode, "token files"), "part int, piece int, n_docs long, n_tokens long"), "token-parts"))
