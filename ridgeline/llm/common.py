"""What the corpus operators share: shared-folder checkpoints, Arrow batches, components of a graph."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch, as documents can be long; bytes of text handled at once by a task that gathers batches.
ARROW_BYTES, CHUNK = 4 << 20, 4 << 20
#: Edges of a graph that one task walks.
FEW = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and takes the checkpoint folder that the cluster names; without one, as in tests, a folder in the warehouse, which is shared too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder, so that no lost executor takes the rows with it."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_checkpoint(df: DataFrame) -> DataFrame:
    """checkpoint() of rows in compressed Arrow batches, for tables of many narrow rows."""
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column(0):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return checkpoint(df.mapInArrow(pack, "rows binary")).mapInArrow(unpack, schema)


def let_go(spark: SparkSession) -> None:
    """Has the driver forget plans that nothing holds any more, upon which Spark removes the files of their shuffles; for the few places between large shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, df: DataFrame) -> str:
    """The name, underscored until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives a Python worker's freed memory back to the system, as workers outlive their tasks beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim keeps it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], size: int = 0) -> Iterator[pa.Table]:
    """Batches put together to about `size` bytes (CHUNK if 0)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= (size or CHUNK):
            t, held, n = pa.Table.from_batches(held), [], 0
            yield t
            del b, t
            release()
    if held:
        t, held = pa.Table.from_batches(held), []
        yield t
        del t
        release()


def longs(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy()).astype(np.int64)


def batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 100_000) -> Iterator[pa.Table]:
    """Sorted batches, put together to about `rows` rows and cut where the first `keys` columns (long) change, so that no run is split."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        other = np.flatnonzero(np.any([(c := longs(t.column(i))) != c[-1] for i in range(keys)], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """whole_runs() of columns that are all long."""
    for t in whole_runs(batches, keys):
        yield [longs(c) for c in t.columns]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and the smallest node that each reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        m, new = np.minimum(low[u], low[v]), low.copy()
        np.minimum.at(new, low[u], m)
        np.minimum.at(new, low[v], m)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Up to FEW edges are walked in one task, which holds 16 MB of them. More alternate large and small stars
    (Kiveris et al. 2014). Each star is a minimum per node, which is combined before its shuffle, and a join
    that adaptive execution splits where a node is hot. Edges never become more numerous, and none are
    gathered on the driver.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            yield batch(list(least_of(longs(t.column(0)), longs(t.column(1)))), ["node", "component"])

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = checkpoint(now), None
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(walk, "node long, component long")
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = checkpoint(star(star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
