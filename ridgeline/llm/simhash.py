"""SimHash near-duplicates through pivot distance tables.

Every text gets a fingerprint, and every distinct fingerprint a row of a table: its Hamming distances to
reference fingerprints (pivots). As |d(x, p) - d(y, p)| <= d(x, y) for each pivot p, a pair whose coordinates
differ by more than the radius anywhere is no link. The pivots are rows of the Walsh-Hadamard matrix,
which are all 32 bits apart, so that coordinates are uncorrelated and tell as much as they can.

1. The first coordinates deal the table out: each is cut in the middle, and a row of the lower cell whose coordinate is
   within the radius of the upper one is there too. Pairs within the radius meet in the cell of the greater
   of their coordinates, in all coordinates at once, so no link is lost, however many coordinates are used.
2. Over-full cells are cut further, by the next pivots; what is still over-full after the last pivot, by pairs of blocks.
3. A task cuts its cells by the pivots that are left, in its memory, so that rows in both halves are not shuffled. Cells
   that no pivot cuts small enough for a task to compare go by pairs of blocks too.
4. Within a cell, pairs are discarded by the maximum difference of all coordinates; survivors are verified on the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpoint, connected_components, mixed, packed_checkpoint, parts_of, prepare, whole_runs

SEED = 42
#: Fingerprints that may be dealt into one cell; fuller cells are cut further. Those of a cell that a task compares when no pivot is left.
CELL, COMPARED = 1 << 17, 1 << 14
#: Fingerprints of a cell that a task compares at once; it cuts fuller ones while there are pivots. Rows of cells that it cuts at once, about.
LEAF, WALKED = 512, 1 << 16
#: Pivots that cut a table at first, at least. Times that a cut may multiply the rows of a task's cell; a dense ball is no smaller after more.
LEAST, WORTH = 6, 1.75
#: Rows 1 to 24 of the Walsh-Hadamard matrix of order 64.
PIVOTS = np.array([sum((j & i).bit_count() % 2 << i for i in range(64)) for j in range(1, 25)], dtype=np.uint64)
#: Where coordinates are cut: random ones lie about 32, all even or all odd.
MIDDLE = 33
#: Parts in which the rows of one group are named.
SALTS = 16
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of the ASCII-lower-cased text; fewer words: of the whole sequence."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([_hash(b" ".join(words))], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(_hash, shingles), dtype=np.uint64, count=len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The word whose bits are those set in over half the hashes; no hash: zero."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[start : start + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        for at in range(0, len(bits), 255):
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority_bits(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs, one row per row of docs; null text counts as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def coordinates(fps: np.ndarray) -> np.ndarray:
    """[n, pivots] distances of the fingerprints to the pivots."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def pivot_table(prints: DataFrame) -> DataFrame:
    """(cell, fp, far): a row for each fingerprint with its distances to all pivots, one byte each; all in one cell so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0)).astype(np.int64)
            yield _rows(np.zeros(len(fps), dtype=np.uint64), fps, coordinates(fps))

    return prints.select("fp").mapInArrow(run, _TABLE)


_TABLE = "cell long, fp long, far binary"


def _rows(cell: np.ndarray, fps: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(fps) + 1, dtype=np.int32) * len(PIVOTS)
    packed = pa.Array.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(far))])
    return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps), packed], names=["cell", "fp", "far"])


def _read(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, fps = (np.asarray(t.column(c)).astype(np.int64) for c in ("cell", "fp"))
    return cell.view(np.uint64), fps, np.frombuffer(b"".join(t.column("far").to_pylist()), dtype=np.int8).reshape(-1, len(PIVOTS))


def middle(pivot: int, radius: int) -> int:
    """Where the coordinate is cut. By an odd radius even fingerprints have more rows in both halves, or odd ones if cut one higher: both in turn."""
    return MIDDLE + radius % 2 * (pivot % 2)


def fullest(radius: int) -> float:
    """Share of random fingerprints in the fuller half of a cut, the mean of two in turn: it settles how many pivots cut at once."""
    share = 1.0
    for cut in (middle(0, radius), middle(1, radius)):
        share *= max(sum(math.comb(64, c) for c in range(cut)), sum(math.comb(64, c) for c in range(max(0, cut - radius), 65))) / 2**64
    return math.sqrt(share)


def cells(cell: np.ndarray, far: np.ndarray, pivots: range, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each row in each finer cell that it belongs to, by the given pivots' coordinates."""
    row = np.arange(len(cell))
    for p in pivots:
        c = far[row, p]
        upper = c >= middle(p, radius)
        both = np.flatnonzero(~upper & (c >= middle(p, radius) - radius))
        row, upper, cell = np.concatenate([row, row[both]]), np.concatenate([upper, np.ones(len(both), dtype=bool)]), np.concatenate([cell, cell[both]])
        cell = mixed(cell * np.uint64(0x9E3779B97F4A7C15) + upper.astype(np.uint64) + np.uint64(1))
    return row, cell


def _deal(table: DataFrame, pivots: range, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, fps, far = _read(b)
            row, finer = cells(cell, far, pivots, radius)
            for lo in range(0, len(row), 50_000):
                some = row[lo : lo + 50_000]
                yield _rows(finer[lo : lo + 50_000], fps[some], far[some])

    return table.select("cell", "fp", "far").mapInArrow(run, _TABLE)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a spanning forest of least weight (Boruvka)."""
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(weight, kind="stable")
    u, v, left, taken = u[order], v[order], np.arange(len(a)), []
    low = np.arange(int(inverse.max()) + 1 if len(inverse) else 0)
    while True:
        x, y = low[u[left]], low[v[left]]
        between = x != y
        left, x, y = left[between], x[between], y[between]
        if not len(left):
            return np.sort(order[np.unique(np.concatenate(taken))]) if taken else np.empty(0, dtype=np.int64)
        least = np.full(len(low), len(order))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        roots = np.flatnonzero(least < len(order))
        edge = least[roots]
        taken.append(edge)
        # Each group goes over its least link; of two that choose the same one, the smaller stays.
        p, q = low[u[edge]], low[v[edge]]
        to = np.where(p == roots, q, p)
        up = np.arange(len(low))
        up[roots] = to
        up[roots[(up[to] == roots) & (roots < to)]] = roots[(up[to] == roots) & (roots < to)]
        while not np.array_equal(up, up[up]):
            up = up[up]
        low = up[low]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, of the nearest."""
    kept = spanning(a, b, np.bitwise_count(a ^ b))
    return a[kept], b[kept]


def task_links(cell: np.ndarray, fps: np.ndarray, far: np.ndarray, radius: int, pivots: range, rest: list | None = None, compared: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """cell_links() of the cells after those of more than LEAF rows are cut by the given pivots, one after another.

    What was cut is taken depth first, about WALKED rows at once. Cells of more than `compared` rows after the last pivot
    are not compared but put into rest, if there is one: (row, cell, size).
    """
    held = [(np.arange(len(cell)), cell, pivots)]
    while held:
        row, cell, left = held.pop()
        _, at, size = np.unique(cell, return_inverse=True, return_counts=True)
        most = LEAF if left else len(row) if rest is None else compared
        full = size[at] > most
        few = row[~full]
        yield cell_links(cell[~full], fps[few], far[few], radius)
        row, cell, at = row[full], cell[full], at[full]
        if not len(row):
            continue
        if not left:
            rest.append((row, cell, size[at]))
            continue
        finer, cut = cells(cell, far[row], left[:1], radius)
        worth = (np.bincount(at[finer], minlength=len(size)) <= WORTH * size)[at[finer]]
        cut = np.where(worth, cut, cell[finer])
        kept = np.flatnonzero(worth | (np.arange(len(finer)) < len(row)))
        kept = kept[np.argsort(cut[kept], kind="stable")]
        row, cell = row[finer[kept]], cut[kept]
        border = np.flatnonzero(np.concatenate([cell[1:] != cell[:-1], [True]])) + 1
        border = np.unique(border[np.searchsorted(border, np.append(np.arange(WALKED, len(cell), WALKED), len(cell)))])
        held += [(row[lo:hi], cell[lo:hi], left[1:]) for lo, hi in zip([0, *border[:-1]], border, strict=True)]


def cell_links(cell: np.ndarray, fps: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each cell."""
    order = np.lexsort((far[:, -1], cell))
    cell, fps, far = cell[order], fps[order].view(np.uint64), np.ascontiguousarray(far[order].T)
    a, b, held, at = [], [], 0, np.arange(len(cell))
    for k in range(1, len(cell)):
        # Rows of a cell lie by the last coordinate: who is too far from the k-th row on is so from all after it.
        at = at[at + k < len(cell)]
        at = at[(cell[at] == cell[at + k]) & (far[-1, at + k] - far[-1, at] <= radius)]
        if not len(at):
            break
        i = at
        for c in far[:-1]:
            i = i[np.abs(c[i] - c[i + k]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= radius]
        a.append(fps[i])
        b.append(fps[i + k])
        held += len(i)
        if held > 1_000_000:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of at most `radius` differing bits that join the same fingerprints as all of them do. prints: distinct rows (fp).

    A cell of a task holds at most CELL fingerprints (a pair of blocks 2 * COMPARED, about), and only a
    spanning forest of its links leaves the task, never all pairs. Every fingerprint is in about as many cells as
    LEAST pivots give it while the table has up to a million; each further pivot serves about 1.5 times as many.
    """
    parts, compared = parts_of(prints), min(CELL, COMPARED)

    def linked(table: DataFrame, pivots: range, last: bool = False) -> DataFrame:
        """(a, b, null, null, null), and unless last (a, null, cell, n, far) of cells that are to go by blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_runs(batches, 1, 2 * compared):
                cell, fps, far = _read(t)
                rest = None if last else []
                for a, b in task_links(cell, fps, far, radius, pivots, rest, compared):
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, pa.nulls(len(a), pa.binary())], names=["a", "b", "cell", "n", "far"])
                for row, of, n in rest or ():
                    for lo in range(0, len(row), 50_000):
                        some = row[lo : lo + 50_000]
                        table = _rows(of[lo : lo + 50_000], fps[some], far[some])
                        yield pa.RecordBatch.from_arrays([table.column(1), pa.nulls(len(some), pa.int64()), table.column(0), pa.array(n[lo : lo + 50_000]), table.column(2)], names=["a", "b", "cell", "n", "far"])

        return table.select("cell", "fp", "far").repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, cell long, n long, far binary")

    def by_blocks(full: DataFrame) -> DataFrame:
        blocks = full.withColumn("k", F.ceil(F.col("n") / F.lit(compared))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")))
        pairs = blocks.withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
        cell = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
        return linked(pairs.withColumn("cell", cell), range(0), True).select("a", "b")

    rest, n, last = pivot_table(prints), prints.count(), len(PIVOTS) - 1
    cut, found, full = 0, None, None
    step = min(last, max(LEAST, math.ceil(math.log(max(1, n / CELL)) / -math.log(fullest(radius)))))
    while True:
        dealt = _deal(rest, range(cut, cut + step), radius)
        cut, step = cut + step, 1
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        met = packed_checkpoint(dealt.join(sizes, "cell"))
        some = linked(met.where(F.col("n") <= CELL), range(cut, last))
        found = some if found is None else found.union(some)
        rest = met.where(F.col("n") > CELL)
        if rest.isEmpty():
            break
        if cut == last:
            full = rest.select("cell", "fp", "n", "far")
            break
    found = checkpoint(found)
    left = found.where("b IS NULL").select("cell", F.col("a").alias("fp"), "n", "far")
    if not left.isEmpty():
        full = left if full is None else full.union(left)
    found = found.where("b IS NOT NULL").select("a", "b")
    return (found if full is None else found.union(by_blocks(full))).distinct()


def groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links.

    Rows with one fingerprint are one node of the graph, so groups of copies of any size cost one row.
    A null doc_id takes part, but is never a component_id unless all of the group are null. Null and
    empty texts have fingerprint zero. Repeated rows give repeated result rows; an empty table gives none.
    """
    prints = checkpoint(fingerprints(docs, width))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(distinct.select("fp"), radius))
    # Groups are named in SALTS parts, so that no group's fingerprints are one task's.
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    low = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = named.join(low, ["component", "salt"]).select("fp", "component_id")
    alone = distinct.join(parts, distinct.fp == parts.node, "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(linked.union(alone), "fp").select("doc_id", "fp", "component_id")


def hex_of(column: str):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
