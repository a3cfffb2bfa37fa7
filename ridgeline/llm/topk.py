"""Exact top-k inner products by columnar branch and bound.

Candidates lie in vertical layout, one row of the array for each dimension. Inner products are
accumulated block by block of dimensions, those with most of the queries' mass first. After each
block the best a pair can still reach is its partial sum plus the product of the remaining norms
(Cauchy-Schwarz); pairs that cannot reach their query's k-th score are dropped, and the survivors
compacted.

Queries and candidates are packed, a block of queries or a tile of candidates to a row, and each task takes
some tiles against some blocks. A block knows from the start what its own rows reach among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpoint, chunks, longs, prepare

#: Queries in a block, candidates in a tile, dimensions accumulated at once.
BLOCK, TILE, DIMENSIONS = 1024, 4096, 8
#: Share of surviving pairs below which they are compacted.
SPARSE = 0.25


def usable(column: str) -> Column:
    """True for arrays without null, NaN or infinite components."""
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Best:
    """The k best (score, smaller id) of each query so far; least: what a pair must reach to matter."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.q, self.s, self.v = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(queries, -np.inf) if least is None else least.copy()

    def add(self, q: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        q, s, v = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.v, v)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.s, self.v = q[keep], s[keep], v[keep]
        last = np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.s[last])


def scan(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Adds the rows of vectors (int64, [n, d]) to best; gives the number of pairs left after the last block."""
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if big < 2**53 else np.int64
    order = np.argsort(-np.square(queries.astype(np.float64)).sum(axis=0), kind="stable")
    q, c = queries[:, order].astype(kind), np.ascontiguousarray(vectors[:, order].T).astype(kind)
    edges = list(range(0, q.shape[1], DIMENSIONS))
    part, pairs = np.zeros((len(q), c.shape[1]), dtype=kind), None
    q_rest, c_rest = np.square(q.astype(np.float64)).sum(axis=1), np.square(c.astype(np.float64)).sum(axis=0)
    for lo in edges:
        block = slice(lo, lo + DIMENSIONS)
        q_rest = np.maximum(q_rest - np.square(q[:, block].astype(np.float64)).sum(axis=1), 0)
        c_rest = np.maximum(c_rest - np.square(c[block].astype(np.float64)).sum(axis=0), 0)
        q_norm, c_norm = np.sqrt(q_rest) * (1 + 1e-9) + 1e-6, np.sqrt(c_rest) * (1 + 1e-9) + 1e-6
        if pairs is None:
            part += q[:, block] @ c[block]
            alive = part + q_norm[:, None] * c_norm[None, :] >= best.least[:, None]
            if alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                sums = part[pairs]
        else:
            a, b = pairs
            sums = sums + (q.T[block][:, a] * c[block][:, b]).sum(axis=0)
            alive = sums + q_norm[a] * c_norm[b] >= best.least[a]
            pairs, sums = (a[alive], b[alive]), sums[alive]
    if pairs is None:
        pairs = np.nonzero(part >= best.least[:, None])
        sums = part[pairs]
    best.add(pairs[0], sums.astype(np.int64), ids[pairs[1]])
    return len(sums)


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    """Arrays as rows, padded with zeros to the longest."""
    v = v.combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    lengths, flat = np.asarray(v.value_lengths()).astype(np.int64), np.asarray(v.flatten()).astype(np.int64)
    out = np.zeros((len(lengths), lengths.max(initial=0)), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _rows(data: pa.BinaryScalar, n: int) -> np.ndarray:
    flat = np.frombuffer(data.as_buffer(), np.int64)
    return flat.reshape(n, len(flat) // n)


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, vectors): some rows of a part at a time."""
    for t in chunks(batches):
        for at in range(0, t.num_rows, TILE):
            ids, m = longs(t.column("vec_id")[at : at + TILE]), _matrix(t.column("v")[at : at + TILE])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, m)], names=["ids", "vectors"])


_ASKED = "block long, q_ids binary, times binary, queries binary, least binary"


def _blocks(k: int):
    """Blocks of queries (vec_id, times, v), and what each query's k + 1 best among the block's rows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for t in chunks(batches):
            for at in range(0, t.num_rows, BLOCK):
                ids, times, m = longs(t.column("vec_id")[at : at + BLOCK]), longs(t.column("times")[at : at + BLOCK]), _matrix(t.column("v")[at : at + BLOCK])
                best = Best(len(ids), k + 1)
                scan(m, m, ids, best)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, times, m, best.least))], names=["block", "q_ids", "times", "queries", "least"])
                number += BLOCK

    return run


_FOUND = "q long, query_id long, times long, own long, vec_id long, score long"


def _against(k: int):
    """The k + 1 best of each query among a task's tiles, its own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            for block, q_ids, times, queries, least, ids, vectors in zip(*(b.column(c) for c in ("block", "q_ids", "times", "queries", "least", "ids", "vectors")), strict=True):
                number = block.as_py()
                if number not in known:
                    q_ids, times = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, times))
                    known[number] = q_ids, times, _rows(queries, len(q_ids)), Best(len(q_ids), k + 1, np.frombuffer(least.as_buffer()))
                queries, best = known[number][2:]
                tile_ids = np.frombuffer(ids.as_buffer(), np.int64)
                tile = _rows(vectors, len(tile_ids))
                width = max(queries.shape[1], tile.shape[1])
                scan(_wide(queries, width), _wide(tile, width), tile_ids, best)
        for number, (q_ids, times, queries, best) in known.items():
            own = np.square(queries).sum(axis=1)
            columns = (number + best.q, q_ids[best.q], times[best.q], own[best.q], best.v, best.s)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def search(rows: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` its k best other rows, by exact integer scores.

    Components become floor(scale * x), which must fit 63 bits, as must the scores. Rows whose vec_id or vector is null, or
    whose vector has null or non-finite components, take no part. A missing component of a shorter
    vector counts as 0. Rows that repeat a vec_id are rows like any other: each is a query of its own (equal rows have
    equal results), and its candidates are all rows but itself. Without queries, or other rows, the result is empty.

    All pairs of a query block and a tile are tasks' rows: that is the stated query set against all rows.
    """
    prepare(rows.sparkSession)
    vectors = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")
    )
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    blocks = checkpoint(asked.mapInArrow(_blocks(k), _ASKED))
    found = vectors.mapInArrow(_tiles, "ids binary, vectors binary").crossJoin(blocks).mapInArrow(_against(k), _FOUND)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # The query's own row, or one that looks alike, leaves the list.
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("n"))).over(Window.partitionBy("q"))
    ranked = best.withColumn("gone", F.coalesce(own, F.lit(k + 2))).where("n <> gone").withColumn("rank", F.col("n") - (F.col("gone") < F.col("n")).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
