"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles (A-Z lowered; words are what white space, U+0020 and U+0009-U+000D,
separates). Documents with equal sets form a class, and one of them stands for it. The classes then go through
independent trees: the root deals them out by the one shingle of their set that is least in the tree's order, and a node that is still large branches
again by minwise values at two positions that the node's own path chooses. Small nodes are compared exhaustively: a
sketch of minwise values passes pairs that may be similar, and full sets decide. After the first tree, and again at the
end, linked classes become components; a node whose members are all of one component already has nothing to add and is
left out, which is what keeps large groups of near copies linear.

A node of over BLOCK members at the last depth is compared in two passes. Its members are first dealt into blocks, each
with a few hubs of the node, and linked; what is then of the node's largest component is dealt into blocks again, and
every other member meets every block, so that no pair of different components is left out and no task grows with the
node.

Two sets of similarity 0.85 meet in a given small root node with probability 0.85; over 8 trees all miss with probability
3e-7. Where every node must branch to the last depth a tree brings them together with probability 0.83, and all miss with
probability 1e-6.

Defined cases: a text that is null or has no words has the empty set and is linked with nothing; with fewer words than a
shingle takes, the whole sequence is its one shingle; for ``find`` a null id is linked with nothing, has a null component
and is kept, and rows with the same id are one node, all kept if the node is; ``keep_one`` judges every row by its own
text, also if its id is null or not its alone, and of equal rows keeps one; further columns are ignored by ``find`` and
carried through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.components import components
from foliary.llm.scratch import id_bitmap, save
from foliary.llm.textkernel import U, Words, ascii_lower, batches_by_chars, codepoints, mix, ngram_hashes
from foliary.llm.worker import task

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES = 8
BRANCHES = 2
DEPTH = 2
#: Members of a node that does not branch any more; of the last depth's nodes, how many one task compares, and hubs of a larger one.
NODE = 1024
BLOCK = 2048
HUBS = 4
#: Minwise values of 16 bits in a sketch; an estimate below SKETCH_LEAST is over four deviations from 0.85.
LANES = 256
SKETCH_LEAST = 0.75
BATCH_CHARS = 1 << 19
#: Shingles that are hashed in all lanes at a time.
CHUNK = 1 << 12
BITMAP_WORDS = 1 << 17
#: Full sets that are handed on at a time.
SETS = 1024

_SEEDS = mix(np.arange(1, LANES + 1, dtype=U) * U(0x632BE59BD9B4E019))
_XOR = (_SEEDS >> U(32)).astype(np.uint32)[:, None]
_MUL = (_SEEDS.astype(np.uint32) | np.uint32(1))[:, None]


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for some in batches_by_chars(texts, BATCH_CHARS):
        points, offsets = codepoints(texts[some])
        words = Words(ascii_lower(points), offsets)
        grams = ngram_hashes(words.hash, k)
        for a, b in zip(words.range[:-1].tolist(), words.range[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield ngram_hashes(words.hash[a:b], b - a)
            else:
                yield np.zeros(0, dtype=U)


def minwise(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LANES minwise values of a set that isn't empty, and the shingles of the first TREES: the trees' roots.

    A root is the whole shingle, as the least values of long texts are so small that unrelated ones would often agree.
    """
    low = (shingles ^ (shingles >> U(32))).astype(np.uint32)
    best = roots = None
    for at in range(0, len(low), CHUNK):
        x = low[None, at : at + CHUNK] ^ _XOR
        x *= _MUL
        least, own = x.min(axis=1), shingles[at + x[:TREES].argmin(axis=1)]
        roots = own if best is None else np.where(least[:TREES] < best[:TREES], own, roots)
        best = least if best is None else np.minimum(best, least)
    return best, roots


def sketch(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint32(16))).astype(np.uint16)


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that identify a set, whatever its order."""
    return tuple(int(mix(x).sum(dtype=U).astype(np.int64)) for x in (shingles, shingles ^ U(0x5851F42D4C957F2D)))


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, low, high, roots, sig = [], [], [], [], []
        for s in shingle_sets(batch["text"].to_pylist(), k):
            n.append(len(s))
            x, y = _sums(s)
            low.append(x)
            high.append(y)
            values, own = minwise(s) if len(s) else (None, None)
            roots.append(None if own is None else own.tobytes())
            sig.append(None if values is None else sketch(values).tobytes())
        columns = [batch["id"], *(pa.array(x, pa.int64()) for x in (n, low, high)), pa.array(roots, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "low", "high", "roots", "sig"])


def _full(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    sets = list(shingle_sets(batch["text"].to_pylist(), k))
    order = [(len(s), _sums(s)[0]) for s in sets]
    columns = [batch["id"], pa.array([n for n, _ in order], pa.int64()), pa.array([low for _, low in order], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "low", "shingles"])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``key`` of a partition that is sorted by it, a group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1][key][held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _sides(g: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(g[c].to_numpy() for c in ("id", "comp", "n", "side"))


def _near(sigs: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Members after ``i`` that may be similar to it, of another component and, in a split node, of a side to meet."""
    j = np.arange(i + 1, len(comp))
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    j = j[(comp[j] != comp[i]) & (100 * small >= percent * large) & ((side[j] != side[i]) | (side[i] == 0))]
    return j[(sigs[j] == sigs[i]).sum(axis=1) >= SKETCH_LEAST * LANES] if len(j) else j


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of a cell that have a member they may be similar to."""
    out, names = [], ("cell", "id", "side", "comp", "n")
    for g in groups(batches, "cell"):
        ids, comp, n, side = _sides(g)
        sigs = np.frombuffer(b"".join(g["sig"].to_pylist()), dtype=np.uint16).reshape(len(ids), LANES)
        hit = np.zeros(len(ids), dtype=bool)
        for i in range(len(ids) - 1):
            j = _near(sigs, comp, n, side, i, percent)
            if len(j):
                hit[i] = hit[j] = True
        if hit.any():
            cell = g["cell"][0].as_py()
            out += [(cell, *row) for row in zip(*(x[hit].tolist() for x in (ids, side, comp, n)), strict=True)]
        if len(out) > 8192:
            yield _rows(out, names)
            out = []
    if out:
        yield _rows(out, names)


def _rows(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a cell, confirmed on full sets; none between members that are linked already."""
    out: list[tuple[int, int]] = []
    for g in groups(batches, "cell"):
        ids, comp, n, side = _sides(g)
        comp = comp.copy()
        sets = [np.frombuffer(s, dtype=U) for s in g["shingles"].to_pylist()]
        sigs = np.stack([sketch(minwise(s)[0]) for s in sets])
        for i in range(len(ids) - 1):
            for j in _near(sigs, comp, n, side, i, percent).tolist():
                if comp[i] == comp[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    out.append((int(ids[i]), int(ids[j])))
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
        if len(out) > 8192:
            yield _rows(out, ("a", "b"))
            out = []
    if out:
        yield _rows(out, ("a", "b"))


def _root(tree: int) -> Column:
    return F.xxhash64(F.lit(tree), F.substring("roots", 8 * tree + 1, 8))


def _branch(number: int) -> Column:
    """A child of the node, by the minwise value at a position that the node's path chooses."""
    position = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(LANES)).cast("int")
    return F.xxhash64("node", position, F.substring(F.col("sig"), position * 2 + 1, F.lit(2)))


class ChosenPath:
    """The join's state: texts (id, text), sketches (id, sig), classes (id, n, roots), and the components found so far."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, classes: DataFrame, percent: int, k: int, unique: bool):
        self.texts, self.percent, self.k, self.unique = texts, percent, k, unique
        self.sketches, self.classes = sketches, classes
        self.comp: DataFrame | None = None

    def members(self, *columns: str) -> DataFrame:
        rows = self.classes.select("id", "n", *columns)
        if self.comp is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(self.comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def contract(self, links: DataFrame) -> None:
        """Components of the links so far: what was linked before is a star already."""
        if links.isEmpty():
            return
        if self.comp is not None:
            links = links.unionByName(self.comp.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        self.comp = save(components(links), "components")

    @staticmethod
    def alive(rows: DataFrame) -> DataFrame:
        """The rows in nodes with members of two components at least, with the node's size and hubs."""
        hubs = [F.min_by("id", F.xxhash64("id", "node", F.lit(h))).alias(f"hub{h}") for h in range(HUBS)]
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), *hubs)
        return rows.join(nodes.where("c0 <> c1").drop("c0", "c1"), "node")

    def compare(self, cells: DataFrame) -> DataFrame:
        """Links among the rows (cell, id, comp, n, side) of each cell."""
        rows = cells.select("cell", "id", "comp", "n", "side").join(self.sketches, "id")
        dealt = rows.repartition("cell").sortWithinPartitions("cell", "side", "id")
        hits = save(dealt.mapInArrow(task(partial(_candidates, percent=self.percent)), "cell long, id long, side long, comp long, n long"), "candidates")
        wanted = id_bitmap(hits, "id", BITMAP_WORDS)
        rows = hits.join(self._sets(hits, wanted).select("id", "shingles"), "id")
        dealt = rows.repartition("cell").sortWithinPartitions("cell", "side", "id")
        return save(dealt.mapInArrow(task(partial(_confirm, percent=self.percent)), "a long, b long"), "found")

    def _sets(self, hits: DataFrame, wanted: dict[int, int]) -> DataFrame:
        """Full sets of the documents in ``hits``: the bitmap spares most texts the shuffle, the join decides."""
        bitmap = np.zeros(BITMAP_WORDS, dtype=U)
        bitmap[list(wanted)] = np.array(list(wanted.values()), dtype=np.int64).view(U)
        shared = self.classes.sparkSession.sparkContext.broadcast(bitmap.tobytes())

        k = self.k

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(shared.value, dtype=U)
            for batch in batches:
                h = batch["h"].to_numpy()
                may = (words[(h >> 6) % BITMAP_WORDS] >> (h & 63).astype(U)) & U(1)
                mine = batch.filter(pa.array(may.astype(bool)))
                for at in range(0, mine.num_rows, SETS):
                    yield _full(mine.slice(at, SETS), k)

        ids = hits.select("id").distinct()
        rows = self.texts.withColumn("h", F.xxhash64("id")).mapInArrow(task(some), "id long, n long, low long, shingles binary")
        rows = rows.join(ids, "id", "left_semi")
        return rows if self.unique else rows.groupBy("id").agg(F.max(F.struct("n", "low", "shingles")).alias("best")).select("id", "best.shingles")

    def search(self, trees: range) -> None:
        """Grow the trees, compare their nodes and contract what they link."""
        rows = self.members("roots").select("id", "comp", "n", F.explode(F.array(*[_root(t) for t in trees])).alias("node"))
        cells, large = None, None
        for depth in range(DEPTH + 1):
            rows = save(self.alive(rows), f"nodes{depth}")
            most = NODE if depth < DEPTH else max(NODE, BLOCK)
            small = rows.where(F.col("size") <= most).select(F.col("node").alias("cell"), "id", "comp", "n", F.lit(0).cast("long").alias("side"))
            cells = small if cells is None else cells.unionByName(small)
            rows = rows.where(F.col("size") > most)
            if rows.isEmpty():
                break
            if depth == DEPTH:
                large = rows
                break
            grown = rows.select("node", "id", "comp", "n").join(self.sketches, "id")
            rows = grown.select("id", "comp", "n", F.explode(F.array(*[_branch(b) for b in range(BRANCHES)])).alias("node")).distinct()
        if large is not None:
            cells = cells.unionByName(self._by_hubs(large).select(*cells.columns))
        self.contract(self.compare(cells))
        if large is not None:
            self._rest(large.select("node", "id", "n"))

    @staticmethod
    def _by_hubs(rows: DataFrame) -> DataFrame:
        """Blocks of a large node's members, each with the node's hubs."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        mine = F.pmod(F.xxhash64("id", F.lit("block")), blocks)
        hub = F.expr(" or ".join(f"id = hub{h}" for h in range(HUBS)))
        at = F.when(hub, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(mine))
        return rows.withColumn("block", F.explode(at)).withColumn("cell", F.xxhash64("node", "block", F.lit("hubs"))).withColumn("side", F.lit(0).cast("long")).drop("block")

    def _rest(self, rows: DataFrame) -> None:
        """What the hubs left apart in large nodes: every member outside the largest component meets every block."""
        rows = rows.join(self.members().select("id", "comp"), "id")
        by_comp = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
        most = by_comp.groupBy("node").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("m"), F.sum("c").alias("size"))
        rows = rows.join(most.where("m < size"), "node")
        if rows.isEmpty():
            return
        m_blocks, r_blocks = F.ceil(F.col("m") / BLOCK), F.ceil((F.col("size") - F.col("m")) / BLOCK)
        h = F.xxhash64("id", F.lit("rest"))
        major = F.col("comp") == F.col("top")
        pair = lambda x, y, kind, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(kind).alias("kind"), side.cast("long").alias("side"))
        zero, one, two = F.lit(0), F.lit(1), F.lit(2)
        upto = lambda n: F.sequence(zero.cast("long"), n.cast("long") - 1)
        mine_m, mine_r = F.pmod(h, m_blocks), F.pmod(h, r_blocks)
        of_major = F.transform(upto(r_blocks), lambda y: pair(mine_m, y, "m", one))
        of_rest = F.concat(
            F.transform(upto(m_blocks), lambda x: pair(x, mine_r, "m", two)),
            F.transform(upto(r_blocks), lambda y: pair(F.least(mine_r, y), F.greatest(mine_r, y), "r", F.when(y == mine_r, zero).when(mine_r < y, one).otherwise(two))),
        )
        cells = rows.withColumn("at", F.explode(F.when(major, of_major).otherwise(of_rest)))
        cells = cells.withColumn("cell", F.xxhash64("node", "at.x", "at.y", "at.kind")).withColumn("side", F.col("at.side")).drop("at")
        self.contract(self.compare(cells))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = save(texts.mapInArrow(task(partial(_sketches, k=k)), "id long, n long, low long, high long, roots binary, sig binary"), "sketches")
    sets = measured.where("id is not null and n > 0")
    unique = sets.groupBy("id").count().where("count > 1").isEmpty()
    if not unique:  # of rows with one id, the one with the largest set stands for it
        sets = save(sets.groupBy("id").agg(F.max(F.struct("n", "low", "high", "roots", "sig")).alias("x")).select("id", "x.*"), "one-by-id")
    classes = sets.groupBy("n", "low", "high").agg(F.min(F.struct("id", "roots")).alias("one"))
    classes = save(classes.select(F.col("one.id").alias("id"), "n", "low", "high", "one.roots"), "classes")
    join = ChosenPath(texts.where("id is not null"), sets.select("id", "sig"), classes.select("id", "n", "roots"), percent, k, unique)
    join.search(range(1))
    join.search(range(1, TREES))
    reps = join.members().select("id", "comp").join(classes.select("id", "n", "low", "high"), "id")
    linked = sets.select("id", "n", "low", "high").join(reps.select("n", "low", "high", "comp"), ["n", "low", "high"])
    linked = linked.select("id", F.col("comp").alias("component_id"))
    rows = measured.select("id", "n").join(linked, "id", "left")
    rows = rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find_: Callable[..., DataFrame] = find) -> DataFrame:
    """One row of each group of near copies, that of the least id, one without an id only if no other has one."""
    own = F.col(id_col).cast("long")
    odd = docs.groupBy(own.alias("odd")).count().where("odd is null or count > 1").select("odd", F.lit(True).alias("is_odd"))
    if odd.isEmpty():
        gone = find_(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
        return docs.join(gone, id_col, "left_anti")
    # rows that no id tells apart are known by a hash of id and text, below all ids
    text = F.col(f"row.{text_col}").cast("string")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), own.alias("id")).join(save(odd, "odd-ids"), F.col("id").eqNullSafe(F.col("odd")), "left")
    hashed = F.xxhash64("id", text).bitwiseOR(F.lit(-(1 << 63)))
    keyed = keyed.select("row", "id", F.when(F.col("is_odd"), hashed).otherwise(F.col("id")).alias("key"), F.coalesce("is_odd", F.lit(False)).alias("is_odd"))
    found = save(find_(keyed.select("key", text.alias("text")), "key", "text").select(F.col("doc_id").alias("key"), "component_id", (F.col("n_shingles") > 0).alias("filled")).distinct(), "near-groups")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = keyed.select("id", "key").distinct().join(found, "key").groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first.key").alias("key"))
    kept = keyed.join(save(first.join(found.select("key", "filled"), "key"), "near-first"), "key")
    same = kept.where("is_odd and filled").dropDuplicates(["key"])
    return kept.where("not (is_odd and filled)").unionByName(same).select("row.*")
