"""Near-duplicate lines by a segment-partition edit join.

Lines are what line feeds part a text into; a line without a word is no line. Two different lines are linked if their
edit distance is at most the tolerance of the shorter one: an edit for every PER_EDIT of its code points, EDITS at most. So
a line of fewer than PER_EDIT code points is linked with equal ones only.

Each line is split into even segments, one more than its tolerance, and indexed by them. If two lines are within the
tolerance, some segment of the shorter one stands in the longer one, and only a few start positions can hold it (the
multi-match-aware rule), so a line probes each length from its own down to its tolerance less at those positions. Keys
are hashes of (length, segment number, characters). Lines that meet in a key are compared by character counts, which
bound the edit distance; those with a partner left are verified there on their whole texts with banded bit-parallel edit
distance, many pairs at a time.

No table of pairs is made. A pair counts in the first key that it shares, and a key hands on a number of links for each
line, and for each line one other line of its group at most, from which components follow. Equal lines are one class, known by
a 128-bit hash. A key's group is compared in blocks of at most CELL rows: a larger group is passed on as it stands,
counted, and dealt into a grid of blocks, so that no task holds a whole group; its narrow rows are copied once for every
CELL / 2 rows of the group.

Defined cases: a null or empty text has no lines; equal lines anywhere are one class; a line is kept if it is the first
of its component, by doc_id (null last) and line number, and rows repeated with the same id keep or lose a line
together; line numbers count all lines from 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.components import components
from foliary.llm.scratch import id_bitmap, save
from foliary.llm.textkernel import Slices, U, batches_by_chars, codepoints, is_blank, mix

EDITS = 2
#: Code points of the shorter line for every edit.
PER_EDIT = 10
CELL = 1024
BATCH_CHARS = 1 << 19
#: Lines that a task remembers, to emit a repeated one once.
SEEN = 1 << 19
BITMAP_WORDS = 1 << 18
#: Rows, characters and pairs that a task compares at a time.
ROWS, CHARS, PAIRS = 1 << 15, 1 << 21, 1 << 14

_BUCKET = (U(1) << (U(8) * (mix(np.arange(0x110000, dtype=U)) % U(8)))).astype(U)


class Lines:
    """The lines of a batch: text number, line number, start, end, hash."""

    def __init__(self, texts: list[str | None]):
        self.points, offsets = codepoints(texts)
        n = len(self.points)
        breaks = np.flatnonzero(self.points == 10)
        sizes = np.diff(offsets)
        starts = np.sort(np.concatenate((offsets[:-1][sizes > 0], breaks + 1)))
        # the place after a text's last line feed is the next text's start or holds an empty line
        starts = np.unique(starts[starts < n])
        ends = np.append(starts[1:], n)
        ends = ends - ((ends > starts) & (self.points[np.maximum(ends - 1, 0)] == 10)) if n else ends
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        first = np.searchsorted(self.text, self.text, side="left")
        self.number = np.arange(len(starts)) - first
        filled = np.concatenate(([0], np.cumsum(~is_blank(self.points))))
        keep = filled[ends] > filled[starts]
        self.text, self.number, self.start, self.end = self.text[keep], self.number[keep], starts[keep], ends[keep]
        self.slices = Slices(self.points)
        self.hash = self.slices.hash(self.start, self.end).astype(np.int64)

    def ids(self, rows: np.ndarray | slice = slice(None)) -> pa.Array:
        """128 bits for each line: the hash and one of other character codes."""
        start, end = self.start[rows], self.end[rows]
        low = Slices(self.points, 1).hash(start, end)
        return _binary(np.column_stack((self.hash[rows].view(U), low)).astype(">u8"))

    def counts(self) -> np.ndarray:
        """Character counts in 8 buckets, packed so that the difference of two lines is the packed difference."""
        return _counts(self.points, self.start, self.end)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a value."""
    n, size = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _counts(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BUCKET[points], dtype=U)))
    return total[end] - total[start]


def tolerance(length: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    return np.minimum(length // per_edit, edits)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the edits + 1 even segments of lines of these lengths."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((start, size))
        start = start + size
    return out


def shifts(i: int, shorter: int, edits: int) -> range:
    """Where segment i of a line can stand in one that is ``shorter`` characters longer."""
    return range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)


#: A row's code: length of the indexed lines, block side, segment number, how much longer the line is, and whether it probes.
def _code(length: np.ndarray, i: int, shorter: int, probe: int) -> np.ndarray:
    return length.astype(np.int64) << 16 | i << 4 | shorter << 1 | probe


def keys(lines: Lines, which: np.ndarray, edits: int, per_edit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, keys, codes) by which lines are indexed and probe."""
    start, end = lines.start[which], lines.end[which]
    size = end - start
    for shorter in range(edits + 1):
        allowed = tolerance(size - shorter, edits, per_edit)
        for own in range(max(1, shorter), edits + 1):
            rows = np.flatnonzero(allowed == own)
            length = size[rows] - shorter
            for i, (p, long) in enumerate(segments(length, own)):
                for shift in shifts(i, shorter, own):
                    at = p + shift
                    fits = (at >= 0) & (at + long <= size[rows])
                    r, n = rows[fits], length[fits]
                    s = start[r] + at[fits]
                    key = mix(lines.slices.hash(s, s + long[fits]) ^ mix(n.astype(U) * U(64) + U(i))).astype(np.int64)
                    yield which[r], key, _code(n, i, shorter, int(shorter > 0 or shift != 0))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, done = batch["text"].to_pylist(), 0
        for some in batches_by_chars(texts, BATCH_CHARS):
            found = Lines(texts[some])
            ids = batch["id"].take(pa.array(found.text + done))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.number.astype(np.int64)), found.ids()], ["doc_id", "line_no", "line"])
            done += some.stop - some.start


def _new(found: Lines, seen: set[int], least: int) -> np.ndarray:
    """The lines that this task sees for the first time and that edits can link."""
    long = np.flatnonzero(found.end - found.start >= least)
    _, first = np.unique(found.hash[long], return_index=True)
    fresh = [i for i, h in zip(long[first].tolist(), found.hash[long[first]].tolist(), strict=True) if h not in seen]
    if len(seen) > SEEN:
        seen.clear()
    seen.update(found.hash[fresh].tolist())
    return np.array(sorted(fresh), dtype=np.int64)


def _entries(batches: Iterator[pa.RecordBatch], edits: int, per_edit: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        texts = batch["text"].to_pylist()
        for some in batches_by_chars(texts, BATCH_CHARS):
            found = Lines(texts[some])
            which = _new(found, seen, per_edit)
            counts = found.counts().astype(np.int64) if len(which) else None
            for rows, key, code in keys(found, which, edits, per_edit) if len(which) else ():
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found.hash[rows]), pa.array(counts[rows]), pa.array(code)], _ENTRY)


_ENTRY = ["cell", "line", "counts", "code"]
_ENTRY_SCHEMA = ", ".join(f"{c} long" for c in _ENTRY)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of absolute differences of the buckets' character counts."""
    d, total = x - y, np.zeros(len(x), dtype=np.int64)
    for _ in range(8):
        digit = ((d & U(255)).astype(np.int64) ^ 128) - 128
        total += np.abs(digit)
        d = (d - digit.astype(np.int64).view(U)) >> U(8)
    return total


def _run_ends(cell: np.ndarray) -> np.ndarray:
    """For each place, the end of its run of equal cells."""
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    return np.repeat(ends, np.diff(np.concatenate(([0], ends))))


def _couples(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs of equal cells, in as many steps as the longest run has places."""
    last, rows, k = _run_ends(cell), np.arange(len(cell)), 1
    while len(rows := rows[rows + k < last[rows]]):
        yield rows, rows + k
        k += 1


def _may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of codes of which one at least is an indexed line's, and which this block compares."""
    side_a, side_b = (a >> 8) & 3, (b >> 8) & 3
    return ((a & b & 1) == 0) & ((side_a == 0) | (side_a != side_b))


def _meet(rows: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    """Which rows (cell, line, counts, code), sorted by cell, have a partner that character counts do not part."""
    cell, line, counts, code = rows[0], rows[1], rows[2].view(U), rows[3]
    most = 2 * tolerance(code >> 16, edits, per_edit)
    hit = np.zeros(len(cell), dtype=bool)
    for a, b in _couples(cell):
        fit = (line[a] != line[b]) & _may_meet(code[a], code[b])
        a, b = a[fit], b[fit]
        near = _apart(counts[a], counts[b]) <= most[a]
        hit[a[near]] = hit[b[near]] = True
    return hit


def _too_large(cell: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rows in groups of over CELL rows or CHARS characters."""
    size = _run_ends(cell) - np.searchsorted(cell, cell)
    return (size > CELL) | (size * (code >> 16) > CHARS)


def _candidates(batches: Iterator[pa.RecordBatch], edits: int, per_edit: int, defer: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition that have a partner; with ``defer`` also all rows of groups that are too large."""

    def made(rows: np.ndarray, deferred: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(np.full(rows.shape[1], deferred))], [*_ENTRY, "deferred"])

    def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if defer and (large := _too_large(rows[0], rows[3])).any():
            yield made(rows[:, large], True)
            rows = rows[:, ~large]
        if (hit := _meet(rows, edits, per_edit)).any():
            yield made(rows[:, hit], False)

    rest, passing = np.zeros((len(_ENTRY), 0), dtype=np.int64), None
    for batch in batches:
        table = np.stack([batch[c].to_numpy() for c in _ENTRY])
        if passing is not None:  # a large group goes on
            at = np.searchsorted(table[0] != passing, True)
            yield made(table[:, :at], True)
            table, passing = table[:, at:], passing if at == table.shape[1] else None
        rest = np.concatenate((rest, table), axis=1)
        if rest.shape[1] > ROWS:
            last = int(np.searchsorted(rest[0], rest[0][-1]))
            yield from compared(rest[:, :last])
            rest = rest[:, last:]
            if defer and _too_large(rest[0], rest[3]).any():
                yield made(rest, True)
                rest, passing = rest[:, :0], rest[0][0]
    yield from compared(rest)


def distances(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distances, where at most ``edits``, else ``edits + 1``."""
    points, offsets = codepoints(x for p in pairs for x in sorted(p, key=len))
    size = np.diff(offsets)
    return _distances(points, offsets[:-1:2], size[::2], offsets[1:-1:2], size[1::2], edits)


def _stripped(slices: Slices, x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slices without the beginning and the end that they have in common, which take no part in their distance."""

    def common(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = equal(mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    k = common(np.minimum(m, n), lambda c: slices.hash(x, x + c) == slices.hash(y, y + c))
    x, m, y, n = x + k, m - k, y + k, n - k
    k = common(np.minimum(m, n), lambda c: slices.hash(x + m - c, x + m) == slices.hash(y + n - c, y + n))
    return x, m - k, y, n - k


def _distances(points: np.ndarray, start_x: np.ndarray, m: np.ndarray, start_y: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    """Banded bit-parallel edit distances of slices of ``points``, x no longer than y, all pairs at a time.

    Bit 63 of a word is the row ``edits`` below the diagonal, lower bits the rows above it. A column's matches within
    the band give the zero diagonal steps; the distance is followed down the band's last diagonal until the pattern
    ends, then along its last row.
    """
    if not len(m):
        return np.zeros(0, np.int64)
    long, most = int(n.max()), max(0, len(points) - 1)
    points = points if len(points) else np.zeros(1, np.uint32)
    at = np.arange(long + 2 * edits + 1)[:, None] - edits
    a = np.where((at >= 0) & (at < m), points[np.clip(start_x + at, 0, most)] + np.uint32(1), np.uint32(0))
    at = np.arange(long)[:, None]
    b = np.where(at < n, points[np.minimum(start_y + at, most)] + np.uint32(1), np.uint32(0xFFFFFFFF))
    vp = np.full(len(m), U((0xFFFFFFFFFFFFFFFF << (63 - edits)) & 0xFFFFFFFFFFFFFFFF), dtype=U)
    vn = np.zeros(len(m), dtype=U)
    dist = np.minimum(m, edits).astype(np.int64)
    for j in range(long):
        if j % 64 == 0 and (dist > 3 * edits).all():  # neighbours in the band differ by 1, and no column's least value falls
            break
        match = np.zeros(len(m), dtype=U)
        for k in range(2 * edits + 1):
            match |= (a[j + k] == b[j]).astype(U) << U(63 - 2 * edits + k)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        live = j < n
        down = j < m - edits
        dist += np.where(down, 1 - (d0 >> U(63)).astype(np.int64), 0)
        # how far the pattern's last row has moved up in the band
        up = np.clip(j - (m - edits) + 1, 0, 63).astype(U)
        bit = U(63) - up
        dist += np.where(live & ~down, ((hp >> bit) & U(1)).astype(np.int64) - ((hn >> bit) & U(1)).astype(np.int64), 0)
        step = d0 >> U(1)
        vp = np.where(live, hn | ~(step | hp), vp)
        vn = np.where(live, step & hp, vn)
    return np.minimum(dist, edits + 1)


class Cells:
    """The links among candidate lines (code, 128-bit id, text) of whole cells, each counted in its first common key."""

    def __init__(self, cell: np.ndarray, code: np.ndarray, ids: np.ndarray, texts: list[str], edits: int, per_edit: int):
        side = (code >> 8) & 3
        order = np.lexsort((code, side, ids[:, 1], ids[:, 0], cell))
        cell, code, side, ids = cell[order], code[order], side[order], ids[order]
        first = np.ones(len(cell), dtype=bool)
        first[1:] = (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1]).any(axis=1) | (side[1:] != side[:-1])
        self.cell, self.code, self.ids, self.edits = cell[first], code[first], ids[first], edits
        self.points, offsets = codepoints(texts[i] for i in order[first].tolist())
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.counts = _counts(self.points, offsets[:-1], offsets[1:])
        self.own = tolerance(self.code >> 16, edits, per_edit)
        self._slices()
        self.links = np.zeros(len(self.cell), dtype=np.int64)
        self.label = np.arange(len(self.cell))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for x, y in self._pairs():
            found.append((x, y))
            held += len(x)
            if held > PAIRS:
                self._verify(found)
                found, held = [], 0
        self._verify(found)

    def _slices(self) -> None:
        """Hashes of each line's segments as an indexed line, and of all places where they may stand in a probing one."""
        self.slices = slices = Slices(self.points)
        n = self.code >> 16
        longer = (self.code >> 1) & 7
        blank = lambda: np.zeros(len(n), dtype=U)
        self.segment = [blank() for _ in range(self.edits)]
        self.standing = [[blank() for _ in range(2 * self.edits + 1)] for _ in range(self.edits)]
        for own in range(1, self.edits + 1):
            for shorter in range(own + 1):
                rows = np.flatnonzero((self.own == own) & (longer == shorter))
                for i, (p, long) in enumerate(segments(n[rows], own)[: self.edits]):
                    for k, shift in enumerate(shifts(i, shorter, own)):
                        fits = (p + shift >= 0) & (p + shift + long <= self.size[rows])
                        r = rows[fits]
                        s = self.start[r] + (p + shift)[fits]
                        self.standing[i][k][r] = slices.hash(s, s + long[fits]) | U(1)
                    if shorter == 0:
                        s = self.start[rows] + p
                        self.segment[i][rows] = slices.hash(s, s + long) | U(1)

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        high, low = self.ids[:, 0], self.ids[:, 1]
        return (high[a] < high[b]) | ((high[a] == high[b]) & (low[a] < low[b]))

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexed, probing) lines that this cell is the first to bring together; of equally long ones the lesser id is indexed."""
        probe = self.code & 1
        for a, b in _couples(self.cell):
            fit = _may_meet(self.code[a], self.code[b])
            a, b = a[fit], b[fit]
            swap = (probe[a] == 1) | ((probe[b] == 0) & self._less(b, a))
            x, y = np.where(swap, b, a), np.where(swap, a, b)
            fit = ((self.size[x] < self.size[y]) | self._less(x, y)) & (_apart(self.counts[x], self.counts[y]) <= 2 * self.own[x])
            x, y = x[fit], y[fit]
            before = np.zeros(len(x), dtype=bool)
            for i, (mine, places) in enumerate(zip(self.segment, self.standing, strict=True)):
                later = i < (self.code[x] >> 4) & 15
                for there in places:
                    before |= later & (there[y] == mine[x])
            if not before.all():
                yield x[~before], y[~before]

    def _verify(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not found:
            return
        x, y = (np.concatenate(part) for part in zip(*found, strict=True))
        places = _stripped(self.slices, self.start[x], self.size[x], self.start[y], self.size[y])
        order = np.argsort(places[3], kind="stable")
        x, y, at, near = x[order], y[order], 0, []
        places = [p[order] for p in places]
        while at < len(x):
            longest = int(places[3][min(at + PAIRS, len(x)) - 1])
            some = slice(at, at + min(PAIRS, max(1, CHARS // (longest + 64))))
            near.append(_distances(self.points, *(p[some] for p in places), self.edits) <= self.own[x[some]])
            at = some.stop
        linked = np.concatenate(near)
        x, y = x[linked], y[linked]
        np.add.at(self.links, x, 1)
        np.add.at(self.links, y, 1)
        while (self.label[x] != self.label[y]).any():
            least = np.minimum(self.label[x], self.label[y])
            for end in (x, y):
                np.minimum.at(self.label, self.label[end], least)
                np.minimum.at(self.label, end, least)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def rows(self) -> pa.RecordBatch:
        """(a, null, links) for each linked line, and (a, b, null) for lines to be put in one component."""
        linked = np.flatnonzero(self.links)
        joined = np.flatnonzero(self.label != np.arange(len(self.label)))
        a = _binary(self.ids[np.concatenate((linked, joined))].astype(">u8"))
        b = pa.concat_arrays([pa.nulls(len(linked), pa.binary()), _binary(self.ids[self.label[joined]].astype(">u8"))])
        return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.array(self.links[linked], pa.int64()), pa.nulls(len(joined), pa.int64())])], ["a", "b", "n"])


def _verify(batches: Iterator[pa.RecordBatch], edits: int, per_edit: int) -> Iterator[pa.RecordBatch]:
    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        ids = np.frombuffer(b"".join(t["id"].to_pylist()), dtype=">u8").reshape(-1, 2).astype(U)
        yield Cells(t["cell"].to_numpy(), t["code"].to_numpy(), ids, t["text"].to_pylist(), edits, per_edit).rows()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch["cell"].to_numpy()
        volume = np.cumsum((batch["code"].to_numpy() >> 16) + 64)
        ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], False)) + 1  # whole groups end there
        if held and held[-1]["cell"][held[-1].num_rows - 1].as_py() != cell[0]:
            ends = np.concatenate(([0], ends))
        at = 0
        for end in ends.tolist():
            if size + (volume[end - 1] if end else 0) - (volume[at - 1] if at else 0) > CHARS and (held or end > at):
                yield from compared([*held, batch.slice(at, end - at)] if end > at else held)
                held, size, at = [], 0, end
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += volume[-1] - (volume[at - 1] if at else 0)
    if held:
        yield from compared(held)


def _grid(rows: DataFrame) -> DataFrame:
    """Deferred groups dealt into blocks: every two blocks, and each block with itself, meet in a cell of their own."""
    rows = save(rows.groupBy("cell", "line").agg(F.min("counts").alias("counts"), F.min("code").alias("code")), "line-grid")
    length = F.shiftright("code", 16)
    half = F.greatest(F.least(F.lit(CELL // 2), F.floor(F.lit(CHARS // 2) / F.col("length"))), F.lit(1))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"), F.max(length).alias("length")).select("cell", F.ceil(F.col("size") / half).cast("long").alias("blocks"))
    rows = rows.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("line"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cell = lambda k: F.xxhash64("cell", F.least("mine", k), F.greatest("mine", k))
    side = lambda k: F.when(F.col("mine") == k, 0).when(F.col("mine") < k, 1).otherwise(2) * 256
    at = F.transform(every, lambda k: F.struct(cell(k).alias("cell"), (F.col("code") + side(k)).alias("code")))
    return rows.select("line", "counts", F.explode(at).alias("at")).select("at.cell", "line", "counts", "at.code")


def links(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(a, null, n): so many different lines are linked with line a, in parts; (a, b, null): lines of one component. docs has (id, text)."""
    compare = partial(_candidates, edits=edits, per_edit=per_edit)
    entries = docs.mapInArrow(partial(_entries, edits=edits, per_edit=per_edit), _ENTRY_SCHEMA)
    dealt = entries.repartition("cell").sortWithinPartitions("cell")
    met = save(dealt.mapInArrow(partial(compare, defer=True), f"{_ENTRY_SCHEMA}, deferred boolean"), "line-candidates")
    hits, deferred = met.where("not deferred").select("cell", "line", "code"), met.where("deferred").select(*_ENTRY)
    if not deferred.isEmpty():
        again = _grid(deferred).repartition("cell").sortWithinPartitions("cell")
        hits = hits.unionByName(again.mapInArrow(partial(compare, defer=False), f"{_ENTRY_SCHEMA}, deferred boolean").select("cell", "line", "code"))
    hits = save(hits.distinct(), "line-hits")
    wanted = hits.select("line").distinct()
    bits = id_bitmap(wanted, "line", BITMAP_WORDS)
    bitmap = np.zeros(BITMAP_WORDS, dtype=U)
    bitmap[list(bits)] = np.array(list(bits.values()), dtype=np.int64).view(U)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bitmap was filled by Spark's xxhash64 of the line, so the same hash looks a line up
        seen: set[int] = set()
        for batch in batches:
            whole = batch["text"].to_pylist()
            for some in batches_by_chars(whole, BATCH_CHARS):
                found = Lines(whole[some])
                which = _new(found, seen, per_edit)
                h = xxhash64_long(found.hash[which])
                words = np.frombuffer(shared.value, dtype=U)
                may = ((words[(h >> 6) % BITMAP_WORDS] >> (h & 63).astype(U)) & U(1)).astype(bool)
                which = which[may]
                out = [found.points[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in zip(found.start[which].tolist(), found.end[which].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found.hash[which]), found.ids(which), pa.array(out, pa.string())], ["line", "id", "text"])

    known = docs.mapInArrow(texts, "line long, id binary, text string").join(wanted, "line", "left_semi").dropDuplicates(["id"])
    rows = hits.join(save(known, "line-texts"), "line").select("cell", "code", "id", "text").repartition("cell").sortWithinPartitions("cell")
    return save(rows.mapInArrow(partial(_verify, edits=edits, per_edit=per_edit), "a binary, b binary, n long"), "line-links")


def xxhash64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long, for many at a time."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << U(k)) | (x >> U(64 - k))
    h = np.full(len(values), U((seed + 0x27D4EB2F165667C5 + 8) & 0xFFFFFFFFFFFFFFFF), dtype=U)
    h ^= turn(values.view(U) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> U(33)
    h *= p2
    h ^= h >> U(29)
    h *= p3
    h ^= h >> U(32)
    return h.view(np.int64)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, line_no, class_doc, class_line, n_links, kept of every line.

    ``class_doc`` and ``class_line`` are the place of the first line of its component, and ``n_links`` says with how many
    different lines it is linked itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = save(rows.mapInArrow(_lines, "doc_id long, line_no long, line binary"), "lines")
    found = links(rows, edits, per_edit)
    comp = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "line")
    degree = found.where("b is null").groupBy(F.col("a").alias("line")).agg(F.sum("n").alias("n_links"))
    # everything but the last join is by line, not by row
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    first = save(lines.groupBy("line").agg(F.min(place).alias("first")), "first-places")
    linked = save(first.join(comp.join(degree, "line"), "line"), "linked-lines")
    tops = save(linked.groupBy("comp").agg(F.min("first").alias("top")), "line-components")
    linked = linked.join(tops, "comp").select("line", "n_links", "top")
    known = save(first.join(linked, "line", "left").select("line", F.coalesce("top", "first").alias("top"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-classes")
    out = lines.join(known, "line")
    return out.select("doc_id", "line_no", F.col("top.doc_id").alias("class_doc"), F.col("top.line_no").alias("class_line"), "n_links", (place == F.col("top")).alias("kept"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The documents with only their kept lines, and the lines without a word between them gone."""
    kept = find(docs, id_col, text_col, **limits).where("kept").select(F.col("doc_id").alias("id"), "line_no").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    numbered = own.select("id", "text", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    numbered = numbered.withColumn("line_no", F.col("line_no").cast("long")).alias("l")
    joined = numbered.join(kept.alias("k"), F.col("l.id").eqNullSafe(F.col("k.id")) & (F.col("l.line_no") == F.col("k.line_no")), "left_semi")
    texts = joined.groupBy("id", "text").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    texts = texts.select("id", "text", F.array_join("lines.line", "\n").alias("short"))
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("new.id")) & (F.col(f"row.{text_col}") == F.col("new.text"))
    found = whole.join(texts.alias("new"), same, "left")
    columns = [F.coalesce("new.short", F.lit("")).alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns]
    return found.select(*columns)
