"""SimHash near-duplicates, held to an exact least similarity of their sets of word shingles.

Texts of one shingle set are one node, with the SimHash fingerprint of that set (each shingle once, so that a
repeated line does not settle the bits). Candidate pairs become links only by their whole sets:

1. Fingerprints of few differing bits meet in the pivot tables of simhash.py, which lose none.
2. Pairs of similarity 0.8 differ in about 10 bits, too many for any loss-free search over fingerprints. Under any one
   order of all shingles, two such sets share a shingle among the first n - ceil(0.8 n) + 1 of each (prefix filter), so
   they meet in the bucket of the first shingle they share. Shingles found frequent stand last in the order; which these
   are bears on the time alone. Small buckets give all their pairs, fuller ones neighbours by node.
3. Fuller buckets whose nodes are not yet one group are compared by fingerprint, dealt by pairs of blocks, in parts:
   the nearest pairs, as many as could join the groups there; of each two groups still apart, some nearest pairs; all
   pairs between groups still apart. Pairs that can't reach 0.8 by their profiles (how many shingles fall into each of
   PROFILE classes bounds what two sets can share) are none of these. Two long texts share hundreds of buckets, so
   buckets are dealt by their least node, which like ones have in common, and a task names a pair once for all of its
   buckets; pairs that an earlier part has verified are not verified again.

So pairs of similarity 0.8 or more are all in one group, and no group is held by less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import simhash
from ridgeline.llm.common import checkpoint, connected_components, let_go, prepare
from ridgeline.llm.simhash import majority_bits, shingle_hashes, spanning
from ridgeline.llm.common import chunks as _chunks, longs as _long, sorted_runs as _sorted_runs, whole_runs

#: Shingles that stand last in the order, and how often a chunk of input must have one to name it.
FREQUENT, OFTEN = 1 << 16, 4
#: Nodes of a bucket of which all pairs are candidates at once; of fuller ones so many neighbours are.
SMALL, NEXT = 8, 3
#: Nodes of a block of a fuller bucket.
BLOCK = 1024
#: Rows of buckets of one least node that go to one task, about; pairs that a task holds before it names them.
DEALT, HELD = 8 * BLOCK, 1 << 20
#: Classes of shingles in a profile. Most differing bits of pairs that a fuller bucket is compared by first, and pairs of each two groups next.
PROFILE, BITS, EACH = 128, 10, 16
#: Ways in which the nodes of a group are dealt where the group gets a name, and the pairs of a text where they are checked.
SALTS = 16
#: Bits of the filter of candidate texts.
FILTER = 1 << 26


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def node_of(shingles: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def alike(overlap: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b shingles with so many in common have similarity 0.8 or more."""
    return 9 * overlap >= 4 * (a + b)


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set: by hash, and after all others the frequent ones, by count."""
    n = len(shingles)
    size = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        hit = frequent[at] == shingles
        if hit[:size].any():
            late, weight = shingles[hit], counts[at[hit]]
            shingles = np.concatenate([shingles[~hit], late[np.lexsort((late, weight))]])
    return shingles[:size]


def _may_be(a, b, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether pairs of rows can be alike if the shingle at their places is the first they share."""
    return alike(np.minimum(n[a] - pos[a], n[b] - pos[b]), n[a], n[b])


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs, the lesser node first."""
    x, y = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (a, b))
    return np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, node, n, pos): candidate pairs (null, a, b), and the rows of fuller buckets."""
    for token, node, n, pos in _sorted_runs(batches, 1):
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n, pos = (c[fresh] for c in (token, node, n, pos))
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        size = np.repeat(np.diff(start), np.diff(start))
        token, node, n, pos, size = (c[size > 1] for c in (token, node, n, pos, size))
        if not len(token):
            continue
        a, b = [], []
        at = np.arange(len(token))
        for k in range(1, SMALL):
            at = at[at + k < len(token)]
            at = at[token[at] == token[at + k]]
            i = at if k <= NEXT else at[size[at] <= SMALL]
            i = i[_may_be(i, i + k, n, pos)]
            a.append(node[i])
            b.append(node[i + k])
        found, full = _pairs(a, b), size > SMALL
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), none], names=["token", "node", "n", "pos"])
        yield pa.RecordBatch.from_arrays([pa.array(c[full]) for c in (token, node, n, pos)], names=["token", "node", "n", "pos"])


def profile(shingles: np.ndarray) -> bytes:
    """Shingles in each class by their hash; empty, so no bound, for sets too large for it."""
    return np.bincount((shingles >> np.uint64(11)).astype(np.int64) % PROFILE, minlength=PROFILE).astype(np.uint16).tobytes() if len(shingles) < 1 << 16 else b""


def _nearest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs are among the EACH nearest of the two groups x and y."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((far, y, x))
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])[: len(x)]
    start = np.flatnonzero(new)
    return order[np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))) < EACH]


def _blocks(part: int):
    """Of sorted (first, way, k, lo, hi, token, block, node, n, pos, component, fp, profile): candidate pairs between groups, each once for
    all buckets that are dealt together (to HELD pairs). Part 0 is a spanning forest of the nearest up to BITS bits of each bucket, 1 EACH pairs
    of every two groups, 2 all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, 5):
            *dealt, token, block, node, n, pos, component, fp = (_long(t.column(k)) for k in range(12))
            lo, hi = dealt[-2:]
            fp = fp.view(np.uint64)
            raw = t.column("profile").to_pylist()
            bounded = np.array([len(x) > 0 for x in raw])
            classes = np.frombuffer(b"".join(x or bytes(2 * PROFILE) for x in raw), dtype=np.uint16).reshape(-1, PROFILE)
            new = np.any([c[1:] != c[:-1] for c in (*dealt, token)], axis=0)
            start = np.flatnonzero(np.concatenate([[True], new, [True]]))
            found, held = [_pairs([], [])], 0
            for s, e in zip(start[:-1], start[1:], strict=True):
                of = np.arange(s, e)
                left, right = of[block[s:e] == lo[s]], of[block[s:e] == hi[s]]
                a, b = [left[:0]], [left[:0]]
                for i in left:
                    j = right[right > i] if lo[s] == hi[s] else right
                    j = j[(component[j] != component[i]) & _may_be(np.full(len(j), i), j, n, pos)]
                    if part == 0:
                        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= BITS]
                    most = np.minimum(classes[j], classes[i]).sum(axis=1, dtype=np.int64)
                    j = j[alike(most, n[i], n[j]) | ~bounded[j] | ~bounded[i]]
                    a.append(np.full(len(j), i))
                    b.append(j)
                a, b = np.concatenate(a), np.concatenate(b)
                if part < 2:
                    kept = (spanning, _nearest)[part](component[a], component[b], np.bitwise_count(fp[a] ^ fp[b]))
                    a, b = a[kept], b[kept]
                found.append(_pairs([node[a]], [node[b]]))
                held += len(a)
                if held > HELD:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    if (held := len(found[0])) > HELD // 2:
                        yield _named(found[0])
                        found, held = [_pairs([], [])], 0
            yield _named(np.unique(np.concatenate(found), axis=0))

    return run


def _named(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have similarity 0.8 or more. pairs are distinct and checkpointed; named: (node, version) of one text each."""
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bit = F.col("version").bitwiseAND(F.lit(FILTER - 1))
    words = nodes.join(named, "node").groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((version & {FILTER - 1}) & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(FILTER // 64, dtype=np.int64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            bits = _long(t.column("version")) & (FILTER - 1)
            t = t.filter(pa.array(held.value[bits >> 6] >> (bits & 63) & 1 == 1))
            found = {node_of(shingle_set(x, width)): x for x in set(t.column("text").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([zlib.compress((x or "").encode(), 1) for x in found.values()], pa.binary())], names=["node", "packed"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for of, node, packed in zip(*(batch.column(c).to_pylist() for c in ("of", "node", "packed")), strict=True):
                s = shingle_set(zlib.decompress(packed).decode(), width)
                if node == of:
                    key, mine = of, s
                    continue
                assert key == of
                if alike(len(np.intersect1d(mine, s, assume_unique=True)), len(mine), len(s)):
                    a.append(of)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # The text of a node goes to its pairs' lesser nodes, whose own text comes first there; a node of many pairs is dealt SALTS ways.
    whole = _source(docs).mapInArrow(texts, "node long, packed binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    dealt = pairs.withColumn("way", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    to = dealt.select(F.col("b").alias("node"), F.col("a").alias("of"), "way").union(dealt.select("a", "a", "way").distinct())
    dealt = whole.join(to, "node").select("of", "way", "node", "packed").repartition(parts, "of", "way").sortWithinPartitions("of", "way", F.col("node") != F.col("of"))
    return checkpoint(dealt.mapInArrow(check, "a long, b long"))


def _salted(of: DataFrame, names: DataFrame) -> DataFrame:
    """of (node, component, ...) with the columns of names (component, ...) or null; a hot group is dealt SALTS ways, and null components by node."""
    way = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    each = names.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return of.withColumn("way", F.when(F.col("component").isNull(), F.xxhash64("node")).otherwise(way)).join(each, ["component", "way"], "left").drop("way")


def joined(of: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of the groups `of` after more links (a, b); component is the smallest node reachable.

    Links meet as pairs of groups, so groups that stand aren't walked again.
    """
    if of is None:
        return checkpoint(connected_components(links))
    first, second = (of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
    between = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    found = checkpoint(connected_components(between))
    new = found.join(of.select("node"), "node", "left_anti")
    moved = _salted(of, found.select(F.col("node").alias("component"), F.col("component").alias("to")))
    return checkpoint(moved.select("node", F.coalesce("to", "component").alias("component")).union(new))


def near_prints(named: DataFrame, radius: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes by fingerprints of at most `radius` differing bits: as few as join all that these join. named: (node, fp)."""
    prints = checkpoint(named.groupBy("fp").agg(F.min("node").alias("first")))
    same = named.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first, second = (prints.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c)) for c in ("a", "b"))
    met = simhash.links(prints.select("fp"), radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.union(met.join(first, "fp_a").join(second, "fp_b").select(F.least("a", "b"), F.greatest("a", "b")))


def groups(docs: DataFrame, width: int, radius: int = 3) -> DataFrame:
    """(doc_id, version, component_id) for each row of docs; component_id is the smallest doc_id reachable over links.

    Links are pairs of similarity 0.8 or more; those whose fingerprints differ in at most `radius` bits are found by these.

    version is the hash of the text. A null doc_id takes part, but is never a component_id unless all of
    the group are null. Null and empty texts have the empty set and are alike.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in filter(len, _chunks(batches)):
            sets = [shingle_set(x, width) for x in t.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            prints = np.array([majority_bits(s) for s in sets], dtype=np.uint64).view(np.int64)
            count = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("version").combine_chunks(), pa.array(nodes, pa.int64()), count, pa.array(map(profile, sets), pa.binary()), pa.array(prints)], names=["doc_id", "version", "node", "count", "profile", "fp"])
            once = list(dict(zip(nodes, sets, strict=True)).values())
            token, count = np.unique(np.concatenate(once), return_counts=True)
            token, count = token[count >= OFTEN].view(np.int64), count[count >= OFTEN].astype(np.int64)
            none = pa.nulls(len(token), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(token), pa.array(count), pa.nulls(len(token), pa.binary()), none], names=["doc_id", "version", "node", "count", "profile", "fp"])

    told = checkpoint(_source(docs).mapInArrow(facts, "doc_id long, version long, node long, count long, profile binary, fp long"))
    rows = told.where("count IS NULL").select("doc_id", "version", "node")
    named = checkpoint(told.where("count IS NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("version").alias("version"), F.min("fp").alias("fp")))
    profiles = told.where("count IS NULL").select("node", "profile", "fp")
    top = told.where("count IS NOT NULL").groupBy("node").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    token, count = (np.asarray(c.to_numpy()).astype(np.int64) for c in top.columns)
    order = np.argsort(token.view(np.uint64))
    last = spark.sparkContext.broadcast((token.view(np.uint64)[order], count[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in filter(len, _chunks(batches)):
            found = {node_of(s): s for s in (shingle_set(x, width) for x in set(t.column("text").to_pylist()))}
            first = [prefix(s, *last.value) for s in found.values()]
            size = np.array([len(p) for p in first], dtype=np.int64)
            of = np.repeat(np.arange(len(first)), size)
            n = np.array([len(s) for s in found.values()], dtype=np.int64)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            token, node = np.concatenate(first).view(np.int64), np.array(list(found), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node[of]), pa.array(n[of].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "node", "n", "pos"])

    met = checkpoint(
        _source(docs)
        .mapInArrow(prefixes, "token long, node long, n int, pos int")
        .repartition(parts, "token")
        .sortWithinPartitions("token", "node")
        .mapInArrow(_buckets, "token long, node long, n long, pos long")
    )
    small = met.where("token IS NULL").select(F.col("node").alias("a"), F.col("n").alias("b"))
    asked = checkpoint(near_prints(named.select("node", "fp"), radius).union(small).distinct())
    of = joined(None, verified(asked, docs, named, width))
    for part in range(3):
        let_go(spark)
        full = met.where("token IS NOT NULL").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = full.groupBy("token").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("k"), F.count("*").alias("size"), F.min("node").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        open_ = checkpoint(open_.select("token", "k", "size", "first"))
        ways = open_.groupBy("first", "k").agg(F.ceil(F.sum("size") / F.lit(DEALT) / F.col("k")).alias("ways"))
        open_ = open_.join(ways, ["first", "k"]).select("token", "first", "k", F.expr("pmod(xxhash64(token), ways)").alias("way"))
        rest = checkpoint(full.join(open_, "token"))
        if rest.isEmpty():
            break
        shown = profiles.join(rest.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("profile").alias("profile"), F.min("fp").alias("fp"))
        dealt = rest.join(shown, "node").withColumn("block", F.expr("pmod(xxhash64(node), k)")).withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
        dealt = dealt.select("first", "way", "k", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "token", "block", "node", "n", "pos", "component", "fp", "profile")
        cell = ["first", "way", "k", "lo", "hi"]
        between = dealt.repartition(parts, *cell).sortWithinPartitions(*cell, "token").mapInArrow(_blocks(part), "a long, b long")
        between = checkpoint(between.distinct().join(asked, ["a", "b"], "left_anti"))
        of, asked = joined(of, verified(between, docs, named, width)), asked.union(between)
    every = named.join(of, "node", "left")
    low = every.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("low"))
    told = _salted(every, low).select("node", F.coalesce("low", "least").alias("component_id"))
    return rows.join(told, "node").select("doc_id", "version", "component_id")


def one_of_each(docs: DataFrame, width: int, radius: int = 3) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the least of their group.

    A row that repeats another in doc_id and text goes; rows without a doc_id cannot be named and stay.
    """
    kept = groups(docs, width, radius).where("doc_id = component_id").select("doc_id", F.col("version").alias("__version")).distinct()
    marked = docs.where("doc_id IS NOT NULL").withColumn("__version", F.xxhash64(F.col("text").cast("string")))
    return marked.join(kept, ["doc_id", "__version"], "left_semi").dropDuplicates(["doc_id", "__version", "text"]).select(*docs.columns).union(docs.where("doc_id IS NULL"))
