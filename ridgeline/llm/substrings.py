"""Substring dedup by compaction of a de Bruijn graph of word k-mers.

Each window of `window` words is a k-mer, and an edge from its first k-1 words to its last k-1. An edge is
kept with its neighbours in the text (the edges one word before and after) and its source coordinates.
Two neighbouring edges belong to one nonbranching path if in all occurrences the first goes on to the second
and the second comes from the first; the ends of a document count as branches. So all occurrences of
a path are parallel, and its earliest is a run of consecutive coordinates.

1. Pruning. A window can only repeat if its minimizer (its short k-mer of least hash) does: minimizers
   meet in one shuffle, and edges are made where they stand at two places or more.
2. Edges meet by minimizer. Degrees are aggregated over an edge's occurrences (its one neighbour on either
   side, or a branch), and paths compact inside their minimizer's bucket to segments.
3. Segments of repeated edges are joined to the segments they go on to, and joined runs at
   consecutive source coordinates are paths. Later occurrences of a path's first edge are joined to the path.
4. Each later occurrence of a path is verified word by word against the text at the path's source coordinates.

A hot minimizer or edge costs each chunk of input one row: occurrences after the chunk's first are verified
and told in the chunk itself. Edges of minimizers that are hot in spite of that are dealt out by
their own hash. Equal hashes of different windows only make more work: what is removed has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import batch, checkpoint, chunks, fresh, let_go, longs, mixed, packed_checkpoint, parts_of, prepare, sorted_runs, whole_runs

WINDOW, MINIMIZER = 20, 6
#: Bytes of text handled at once by a task.
CHUNK = 4 << 20
#: Occurrences from which a minimizer is hot, and how many minimizers can be so (the hottest).
HOT, HOTTEST = 4096, 1 << 16
#: In place of a neighbouring edge: the text ends, or occurrences go on differently.
END, BRANCH = 0, 1
ASK, ALIVE, TOLD, SEGMENT, LATER = range(5)
_MIX = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Words are runs without ASCII white space; null: none."""
    return text.encode().split() if text else []


class Runs:
    """Hashes of any run of items: sums of item hashes times powers of an odd number, taken back to the run's start."""

    def __init__(self, h: np.ndarray, base: int = _MIX):
        def powers(b: int) -> np.ndarray:
            out = np.full(len(h) + 1, b & (2**64 - 1), dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.back = powers(pow(base, -1, 2**64))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(h * powers(base)[:-1])])

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The leftmost place of the least of each w neighbouring values, by doubling."""
    at, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        size += step
    return at


class Texts:
    """A chunk's words: their places in the chunk's own vocabulary (equal if and only if the words are) and the hashes of runs."""

    def __init__(self, texts: list[str | None], window: int, k: int):
        split, vocabulary = [words_of(t) for t in texts], {}
        sizes = np.array([len(t) for t in split], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.words = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in split for w in t), dtype=np.int32, count=int(self.starts[-1]))
        hashes = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary)))
        self.of, self.window = np.repeat(np.arange(len(split), dtype=np.int32), sizes), window
        del split, vocabulary
        self.runs = Runs(hashes[self.words])
        n = len(self.words)
        self.short = self.runs(np.arange(max(0, n - k + 1)), k)
        self.low = _least(self.short, window - k + 1) if n >= window else np.empty(0, dtype=np.int64)

    def edges(self, begin: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin there, as signed longs other than END and BRANCH."""
        h = self.runs(np.clip(begin, 0, len(self.words) - self.window), self.window)
        return np.where(h < 2, h + np.uint64(2), h).view(np.int64)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, number of windows, minimizer) of each run of a text's neighbouring windows with one minimizer."""
        if not len(self.low):
            return (np.empty(0, dtype=np.int64),) * 3
        first = np.flatnonzero(self.of[: len(self.low)] == self.of[self.window - 1 :])
        low = self.low[first]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (first[1:] != first[:-1] + 1)])) if len(first) else first
        return first[new], np.diff(np.concatenate([new, [len(first)]])), self.short[low[new]].view(np.int64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows that begin at a and b have the same words."""
        out = np.ones(len(a), dtype=bool)
        for j in range(self.window):
            out &= self.words[a + j] == self.words[b + j]
        return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.empty(0, dtype=bool)


def _sole(values: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The one value of each run, or BRANCH; lead: where runs begin."""
    low, high = np.minimum.reduceat(values, lead), np.maximum.reduceat(values, lead)
    return np.where(low == high, low, BRANCH)


def _later(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a row of a run (new where one begins) stands at a place after the run's first; equal places are no repeats."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[lead]) | (at != at[lead])


def _by(doc: np.ndarray) -> np.ndarray:
    """A key that deals rows out by document."""
    return mixed(doc.view(np.uint64)).view(np.int64)


def _asks(window: int, k: int):
    """Rows (key, doc, v, packed) of a chunk's minimizers: the first place of each asks, by key; others are alive as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK):
            doc, v = longs(t.column("doc_id")), longs(t.column("v"))
            texts = Texts(t.column("text").to_pylist(), window, k)
            begin, n, key = texts.minimizers()
            order = np.argsort(key, kind="stable")
            begin, n, key = begin[order], n[order], key[order]
            row = texts.of[begin]
            new = _starts(key)
            count = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))[np.cumsum(new) - 1] if len(key) else n
            at = begin - texts.starts[row]
            packed = at << 32 | np.where(new, np.minimum(count, (1 << 22) - 1) << 10 | n << 3 | ASK, n << 3 | ALIVE)
            yield batch([np.where(new, key, _by(doc[row])), doc[row], v[row], packed], ["key", "doc_id", "v", "packed"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, doc, v, packed): minimizers at two places or more, and (null, key, count) of hot ones."""
    plain = ~np.int64(((1 << 22) - 1) << 10 | 7)
    for key, doc, v, packed in sorted_runs(batches, 1):
        told = packed & 7 == ALIVE
        yield batch([doc[told], v[told], packed[told]], ["doc_id", "v", "packed"])
        key, doc, v, packed = (c[~told] for c in (key, doc, v, packed))
        if not len(key):
            continue
        new = _starts(key)
        total = np.add.reduceat(packed >> 10 & ((1 << 22) - 1), np.flatnonzero(new))
        alive = total[np.cumsum(new) - 1] > 1
        yield batch([doc[alive], v[alive], packed[alive] & plain | ALIVE], ["doc_id", "v", "packed"])
        hot = total >= HOT
        yield batch([pa.nulls(int(hot.sum()), pa.int64()), key[new][hot], total[hot]], ["doc_id", "v", "packed"])


def _edges(window: int, k: int, spans: str, version: str, hot: np.ndarray):
    """Rows (key, doc, v, packed, edges) of alive places: runs of edges with the neighbours before and after, or (without edges) told repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "v", "packed", "edges"]
        for t in chunks(batches, CHUNK):
            t = t.filter(pc.greater(pc.fill_null(pc.list_value_length(t.column(spans)), 0), 0))
            if not t.num_rows:
                continue
            doc, v = longs(t.column("doc_id")), longs(t.column(version))
            once = np.unique(np.stack([doc, v]), axis=1, return_index=True)[1]
            t, doc, v = t.take(pa.array(once)), doc[once], v[once]
            texts = Texts(t.column("text").to_pylist(), window, k)
            packed = [np.array(p, dtype=np.int64) for p in t.column(spans).to_pylist()]
            row = np.repeat(np.arange(len(packed)), [len(p) for p in packed])
            packed = np.concatenate(packed)
            n = packed >> 3 & 127
            begin = np.unique(np.repeat(texts.starts[row] + (packed >> 32), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            row = texts.of[begin]
            at = begin - texts.starts[row]
            edge = texts.edges(begin)
            before = np.where(at == 0, END, texts.edges(begin - 1))
            after = np.where(begin + window == texts.starts[row + 1], END, texts.edges(begin + 1))

            order = np.lexsort((v[row], at, doc[row], edge))
            new = _starts(edge[order])
            lead = np.flatnonzero(new)
            group = np.empty(len(order), dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            came, goes = _sole(before[order], lead)[group], _sole(after[order], lead)[group]
            later = np.empty(len(order), dtype=bool)
            later[order] = _later(new, doc[row][order], at[order])
            some = np.flatnonzero(later)
            later[some] = texts.same(begin[some], begin[order[lead]][group[some]])

            mine = begin[later]
            cut = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1] + 1) | (texts.of[mine[1:]] != texts.of[mine[:-1]])])) if len(mine) else mine
            size, where = np.diff(np.concatenate([cut, [len(mine)]])), row[later][cut]
            yield batch([_by(doc[where]), doc[where], v[where], at[later][cut] << 32 | size, pa.nulls(len(cut), pa.binary())], names)

            begin, row, at, edge, came, goes = (c[~later] for c in (begin, row, at, edge, came, goes))
            key = texts.short[texts.low[begin]].view(np.int64)
            key = np.where(np.isin(key, hot), edge, key)
            joined = (begin[1:] == begin[:-1] + 1) & (row[1:] == row[:-1]) & (key[1:] == key[:-1]) & (goes[:-1] == edge[1:]) & (came[1:] == edge[:-1])
            cut = np.flatnonzero(np.concatenate([[True], ~joined]))
            size = np.diff(np.concatenate([cut, [len(edge)]]))
            ends = np.cumsum(size + 2)
            flat = np.empty(int(ends[-1]), dtype=np.int64)
            flat[np.arange(len(edge)) + 1 + 2 * np.repeat(np.arange(len(cut)), size)] = edge
            flat[ends - size - 2], flat[ends - 1] = came[cut], goes[cut + size - 1]
            offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            out = batch([key[cut], doc[row[cut]], v[row[cut]], at[cut] << 32 | size, column], names)
            for lo in range(0, len(cut), 50_000):
                yield out.slice(lo, 50_000)

    return run


_SEGMENTS = ["kind", "head", "came", "tail", "goes", "doc_id", "v", "packed"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, doc, v, packed, edges): told repeats, segments at their earliest place, and later places of segments by first edge."""
    for t in whole_runs(batches, 1, 50_000):
        told = t.filter(pc.is_null(t.column("edges")))
        none = np.zeros(told.num_rows, dtype=np.int64)
        yield batch([none + TOLD, none, none, none, none, *(longs(told.column(c)) for c in ("doc_id", "v", "packed"))], _SEGMENTS)
        t = t.filter(pc.is_valid(t.column("edges"))).combine_chunks()
        if not t.num_rows:
            continue
        n = longs(t.column("packed")) & 0xFFFFFFFF
        flat = np.frombuffer(b"".join(x.as_buffer() for c in t.column("edges").chunks for x in c), dtype=np.int64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        here = np.arange(len(row)) + 1 + 2 * row
        edge, before, after = flat[here], flat[here - 1], flat[here + 1]
        doc, v, at = longs(t.column("doc_id"))[row], longs(t.column("v"))[row], (longs(t.column("packed")) >> 32)[row] + step
        order = np.lexsort((v, at, doc, edge))
        new = _starts(edge[order])
        lead = np.flatnonzero(new)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        came, goes = _sole(before[order], lead)[group], _sole(after[order], lead)[group]
        later = np.empty(len(order), dtype=bool)
        later[order] = _later(new, doc[order], at[order])
        repeated = (np.bincount(group, weights=later) > 0)[group]
        first = np.zeros(len(order), dtype=bool)
        first[order[lead]] = True
        kind = np.where(later, LATER, np.where(first & repeated, SEGMENT, 0))
        joined = (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & repeated[1:] & repeated[:-1] & (goes[:-1] == edge[1:]) & (came[1:] == edge[:-1])
        cut = np.flatnonzero(np.concatenate([[True], ~joined]))
        size = np.diff(np.concatenate([cut, [len(edge)]]))
        last = cut + size - 1
        keep = kind[cut] != 0
        cut, last, size = cut[keep], last[keep], size[keep]
        yield batch([kind[cut], edge[cut], came[cut], edge[last], goes[last], doc[cut], v[cut], at[cut] << 32 | size], _SEGMENTS)


def _paths(segments: DataFrame) -> DataFrame:
    """(head, n, doc0, v0, at0): whole nonbranching paths from segments, by first edge and source coordinates."""
    segments = segments.withColumn("at", F.shiftright("packed", 32))
    before = segments.where(~F.col("goes").isin(END, BRANCH)).select(F.col("tail").alias("came"), F.col("goes").alias("head"), F.lit(0).alias("new"))
    joined = segments.join(before, ["came", "head"], "left")
    # The segments of a path lie one after the other in their earliest document: a new path begins where none goes on.
    run = F.sum(F.coalesce("new", F.lit(1))).over(Window.partitionBy("doc_id", "v").orderBy("at"))
    size = F.sum(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n")
    paths = joined.withColumn("run", run).groupBy("doc_id", "v", "run").agg(F.min_by("head", "at").alias("head"), size, F.min("at").alias("at0"))
    return paths.select("head", "n", F.col("doc_id").alias("doc0"), F.col("v").alias("v0"), "at0")


_SPELLED = "doc0 long, v0 long, at0 long, n long, doc_id long, v long, at long, words binary"


def _spell(asked: str, version: str):
    """The words of the asked spans, as they stand in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, v, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", version, "text", asked)), strict=True):
                if spans:
                    words = words_of(text)
                    out = [(s["doc0"], s["v0"], s["at0"], s["n"], doc, v, s["at"], b" ".join(words[s["at"] : s["at"] + s["words"]])) for s in spans]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:-1]), pa.array([x[-1] for x in out], pa.binary())], names=[x.split()[0] for x in _SPELLED.split(", ")])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spelled occurrences, sorted by path and place: those whose words stand at an earlier place of the path."""
    path, known = None, {}
    for b in batches:
        out = []
        for doc0, v0, at0, n, doc, v, at, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if path != (doc0, v0, at0):
                path, known = (doc0, v0, at0), {}
            if known.setdefault(words, (doc, at)) < (doc, at):
                out.append((doc, v, at << 32 | n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["doc_id", "v", "packed"])


def kept_words(words: list[bytes], spans: np.ndarray, window: int) -> list[bytes]:
    """The words outside all windows of spans (start and number of windows, packed)."""
    if not len(spans):
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, spans >> 32, 1)
    np.add.at(step, (spans >> 32) + (spans & 0xFFFFFFFF) + window - 1, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def repeats(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names come with it: a version of the document, and the spans of its repeated windows.

    The version tells different texts of one doc_id apart; it is 0 throughout where no doc_id repeats.
    """
    prepare(docs.sparkSession)
    if not k <= window <= 100:
        raise ValueError("window must have k to 100 words")
    parts = parts_of(docs)
    version, spans = fresh("version", docs), fresh("spans", docs)
    single = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = docs.withColumn(version, F.lit(0).cast("long") if single else F.xxhash64("text"))
    named = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(version).alias("v"), "text")

    def with_(told: DataFrame) -> DataFrame:
        # All columns of rows, rows without spans leaving in Python: so the texts' shuffle is the same one for each join.
        return rows.join(told.select("doc_id", F.col("v").alias(version), F.col("spans").alias(spans)), ["doc_id", version], "left")

    asks = named.mapInArrow(_asks(window, k), "key long, doc_id long, v long, packed long").repartition(parts, "key").sortWithinPartitions("key")
    met = asks.mapInArrow(_met, "doc_id long, v long, packed long")
    alive = checkpoint(met.groupBy("doc_id", "v").agg(F.collect_set("packed").alias("spans")))
    hot = alive.where("doc_id IS NULL").orderBy(F.desc(F.col("spans")[0]), "v").limit(HOTTEST).select("v").collect()
    del asks, met
    let_go(docs.sparkSession)
    made = with_(alive.where("doc_id IS NOT NULL")).mapInArrow(
        _edges(window, k, spans, version, np.array([r.v for r in hot], dtype=np.int64)), "key long, doc_id long, v long, packed long, edges binary"
    )
    found = packed_checkpoint(made.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_segments, ", ".join(f"{c} long" for c in _SEGMENTS)))
    del made, alive
    let_go(docs.sparkSession)

    paths = packed_checkpoint(_paths(found.where(F.col("kind") == SEGMENT)))
    at = F.shiftright("packed", 32).alias("at")
    later = found.where(F.col("kind") == LATER).select("head", "doc_id", "v", at).join(paths, "head")
    places = later.unionByName(paths.select("*", F.col("doc0").alias("doc_id"), F.col("v0").alias("v"), F.col("at0").alias("at")))
    span = F.struct("at", "n", (F.col("n") + window - 1).alias("words"), "doc0", "v0", "at0")
    asked = packed_checkpoint(places.groupBy("doc_id", "v").agg(F.collect_set(span).alias("spans")))
    del later, places
    let_go(docs.sparkSession)
    path = ["doc0", "v0", "at0"]
    spelled = with_(asked).mapInArrow(_spell(spans, version), _SPELLED).repartition(parts, *path).sortWithinPartitions(*path, "doc_id", "at")
    told = found.where(F.col("kind") == TOLD).select("doc_id", "v", "packed").union(spelled.mapInArrow(_verified, "doc_id long, v long, packed long"))
    # No checkpoint between the last two joins: they read the same shuffle of the texts.
    return with_(told.groupBy("doc_id", "v").agg(F.collect_set("packed").alias("spans"))), version, spans


def dedup(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): a row for each row of docs, kept being its words outside repeated windows, spaced once.

    A window is a repeat if its words also start earlier: in a smaller doc_id, or earlier in the same
    document. Rows with a null doc_id have no place in that order: they stay whole and make nothing a
    repeat. Rows that repeat a doc_id are at one place, so neither makes the other a repeat. Null and
    empty texts, and those under `window` words, stay as they are. An empty table gives none.
    """
    marked, _, spans = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(x) for x in b.column("text").to_pylist()]
            kept = [kept_words(w, np.array(s or (), dtype=np.int64), window) for w, s in zip(words, b.column(spans).to_pylist(), strict=True)]
            counts, left = [len(w) for w in words], [len(x) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array([n - m for n, m in zip(counts, left, strict=True)], pa.int64()), pa.array([b" ".join(x).decode() for x in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """The rows of docs, all columns, their text being what dedup() keeps and n_chars, if there, its length.

    Texts without repeats stay as they are, to the byte. Rows of which nothing is left go.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marked, _, spans = repeats(docs, window, k)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            texts, found = t.column("text").to_pylist(), t.column(spans).to_pylist()
            keep = [True] * len(texts)
            for i, s in enumerate(found):
                if s:
                    texts[i] = b" ".join(kept_words(words_of(texts[i]), np.array(s, dtype=np.int64), window)).decode()
                    keep[i] = bool(texts[i])
            t = t.set_column(t.column_names.index("text"), "text", pa.array(texts, pa.string())).select(columns)
            if "n_chars" in t.column_names:
                at = t.column_names.index("n_chars")
                n = [old if not s else len(x) for x, s, old in zip(texts, found, t.column("n_chars").to_pylist(), strict=True)]
                t = t.set_column(at, "n_chars", pa.array(n, t.schema.field(at).type))
            yield from t.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    return marked.mapInArrow(run, docs.schema)
