"""Benchmark decontamination by greedy string tiling.

Texts and test items meet where they share a run of SHORTEST words (a seed, found by Karp-Rabin hashes
of all such runs): a filter of all items' seeds leaves of each text its fragments that any item may share, and an
equi-join on seeds brings fragments and items together. Then the longest run of words that is unmarked on both sides
becomes a tile and its words are marked, again and again, until no run of SHORTEST words is left; its length is
searched with Karp-Rabin hashes of all unmarked runs of a length. As tiles may lie in any order, a reordered passage is
covered as well as a plain copy. An item is leaked if its tiles cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpoint, fresh, mixed, packed_checkpoint, prepare
from ridgeline.llm.substrings import Runs
from ridgeline.llm.urls import bloom, may_hold

#: Words of the shortest tile, the share of an item's words that makes a leak.
SHORTEST, COVERED = 5, 0.5
#: Items from which a seed is common: common seeds bring nothing together as long as an item cannot leak by them alone.
COMMON = 8
#: Leaked documents that are dropped by a broadcast of their keys; more are by a shuffle.
FEW = 1_000_000
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of ASCII letters and digits and of anything beyond ASCII; null: none."""
    return text.encode().translate(_BYTES).split() if text else []


def _seeds(words: list[bytes]) -> np.ndarray:
    """Karp-Rabin hashes of all runs of SHORTEST words, each from the one before in the sense of one multiply and add a word."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(max(0, len(h) - SHORTEST + 1), dtype=np.uint64)
    for i in range(SHORTEST):
        out = out * _BASE + h[i : i + len(out)]
    return out


def _free_runs(free: np.ndarray) -> np.ndarray:
    """How many unmarked words there are from each place on."""
    at = np.arange(len(free))
    ends = np.where(free, len(free), at)
    return np.minimum.accumulate(ends[::-1])[::-1] - at


def tiles(doc: list[bytes], item: list[bytes], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first, then by start. An empty word matches nothing."""
    code = {w: i for i, w in enumerate(dict.fromkeys(item)) if w}
    b = np.array([code.get(w, -1) for w in item], dtype=np.int64)
    a = np.array([code.get(w, -1) for w in doc], dtype=np.int64)
    runs = [Runs(mixed(c.astype(np.uint64) + np.uint64(1))) for c in (a, b)]
    free, found = [a >= 0, b >= 0], []
    longest = min(len(a), len(b))

    def common(n: int, left: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        at, to = (np.flatnonzero(x >= n) for x in left)
        h, g = (r(x, n) for r, x in zip(runs, (at, to), strict=True))
        hit = np.isin(h, g)
        return at[hit], h[hit], to, g

    while longest >= shortest:
        left = [_free_runs(x) for x in free]
        low, high = shortest - 1, min(longest, *(int(x.max(initial=0)) for x in left))
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(common(n, left)[0]) else (low, n - 1)
        if low < shortest:
            break
        at, h, to, g = common(low, left)
        places: dict[int, list[int]] = {}
        for i, x in zip(to.tolist(), g.tolist(), strict=True):
            places.setdefault(x, []).append(i)
        end = 0
        for d, x in zip(at.tolist(), h.tolist(), strict=True):
            if not places:
                break
            if d < end or x not in places:
                continue
            places[x] = [i for i in places[x] if free[1][i : i + low].all()]
            for i in places[x]:
                if np.array_equal(a[d : d + low], b[i : i + low]):
                    found.append((d, i, low))
                    free[0][d : d + low] = free[1][i : i + low] = False
                    end = d + low
                    break
            if not places[x]:
                del places[x]
        longest = low - 1
    return found


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item) of each distinct seed of each item."""
    for b in batches:
        found = [(h, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in np.unique(_seeds(words_of(t))).view(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["seed", "item"])


def _telling(covered: float):
    """(seed, item) of the seeds of which a text must have one to leak the item: all but the most common, as far as these cover too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text, common in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = _seeds(words_of(text)).view(np.int64)
                under, rest = np.zeros(len(h) + SHORTEST - 1, dtype=bool), set(h.tolist())
                for c in sorted(common, key=lambda c: (-c["n"], c["seed"])):
                    more = under.copy()
                    for at in np.flatnonzero(h == c["seed"]):
                        more[at : at + SHORTEST] = True
                    if more.sum() >= covered * len(more):
                        break
                    under = more
                    rest.discard(c["seed"])
                out += [(s, item) for s in rest]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["seed", "item"])

    return run


def _fragments(sent):
    """(doc_id, version, seeds, starts, words) of texts with seeds that the filter holds: the runs of words under these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, version, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                h = _seeds(words).view(np.int64)
                hit = np.flatnonzero(may_hold(sent.value, h))
                if len(hit):
                    first = np.concatenate([[True], hit[1:] > hit[:-1] + SHORTEST])
                    starts, ends = hit[first], hit[np.concatenate([first[1:], [True]])] + SHORTEST
                    out.append((doc, version, np.unique(h[hit]).tolist(), starts.tolist(), [b" ".join(words[s:e]) for s, e in zip(starts, ends, strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "version", "seeds", "starts", "words"])

    return run


SCHEMA = "doc_id long, version long, item_id long, n_words long, n_covered long, coverage double, tiles array<struct<doc_start:long,item_start:long,length:long>>"


def _tiled(covered: float):
    """Tiles of pairs (doc_id, version, starts, words, item_id, text) that cover enough of the item."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_start", "item_start", "length")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, version, starts, fragments, item_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                item, words, at = words_of(text), [], []
                seeds = _seeds(item)
                for start, fragment in zip(starts, fragments, strict=True):
                    more = fragment.split()
                    words += [*more, b""]
                    at += range(start, start + len(more) + 1)
                there = np.zeros(len(item), dtype=bool)
                for i in np.flatnonzero(np.isin(seeds, _seeds(words))):
                    there[i : i + SHORTEST] = True
                if there.sum() < covered * len(item):
                    continue
                found = tiles(words, item)
                n = sum(x[2] for x in found)
                if n >= covered * len(item):
                    out.append((doc, version, item_id, len(item), n, n / len(item), [{"doc_start": at[d], "item_start": i, "length": n} for d, i, n in found]))
            kinds = [*[pa.int64()] * 5, pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "version", "item_id", "n_words", "n_covered", "coverage", "tiles"])

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, covered: float) -> DataFrame:
    prepare(docs.sparkSession)
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = checkpoint(own.withColumn("item", F.monotonically_increasing_id()))
    seeds = checkpoint(items.select("item", "text").mapInArrow(_item_seeds, "seed long, item long"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom(seeds.select("seed").distinct(), F.col("seed")))
    common = seeds.join(seeds.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "seed").groupBy("item").agg(F.collect_list(F.struct("n", "seed")).alias("common"))
    telling = items.join(common, "item", "left").select("item", "text", F.coalesce("common", F.array().cast("array<struct<n:bigint,seed:bigint>>")).alias("common")).mapInArrow(_telling(covered), "seed long, item long")

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    met = packed_checkpoint(rows.mapInArrow(_fragments(sent), "doc_id long, version long, seeds array<long>, starts array<long>, words array<binary>"))
    met = met.withColumn("met", F.monotonically_increasing_id())
    pairs = met.select("met", F.explode("seeds").alias("seed")).join(telling, "seed").select("met", "item").distinct()
    both = met.drop("seeds").join(pairs, "met").join(items, "item")
    return both.select("doc_id", "version", "starts", "words", "item_id", "text").mapInArrow(_tiled(covered), SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, coverage, tiles): a row for each row of docs and item of which at least `covered` of the words lie under tiles.

    n_words are the item's words, n_covered those under tiles. Items of under SHORTEST words, and null or
    empty texts, match nothing. Items that repeat an id and text count once, others of one id
    each. Rows that repeat a document are judged each, also without a doc_id. Empty tables give none.
    """
    return _leaks(docs, benchmark, covered).drop("version")


def without_leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of docs, all columns, in which no item is leaked."""
    bad, version = checkpoint(_leaks(docs, benchmark, covered).select("doc_id", "version").distinct()), fresh("version", docs)
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    marked = docs.withColumn(version, F.xxhash64(F.col("text").cast("string")))
    return marked.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (marked[version] == bad["version"]), "left_anti").select(*docs.columns)
