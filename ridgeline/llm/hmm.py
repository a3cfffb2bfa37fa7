"""Language-model scores by a hidden Markov model over words, trained by Baum-Welch on the whole corpus.

The states emit symbols: the most frequent words are symbols of their own, all others share the symbol
of their ending. A word of such a class has its own share of it, P(word | class) = (c + 1) / (N + V + 1)
over the class's training tokens N and words V, the one left over being any unseen word. So the model is
a distribution over texts, and the scaled forward recursion gives a text's exact likelihood.

Texts become blocks of bounded size with a vocabulary of their own. Counts travel by (word, block), not
by token, and go back only to blocks whose words others have too. Each Baum-Welch round adds up
expected counts over all partitions; these have the size of the model, not of the corpus, and are whole
multiples of 2**-16, so that their sum doesn't depend on its order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpoint, prepare

STATES, TOP, CLASSES, ENDING, ROUNDS, SEED = 6, 2048, 512, 3, 5, 7
#: Bytes of text in a block, tokens in one group of texts that are walked side by side.
BLOCK, GROUP = 16 << 20, 300_000
#: Tokens of one text that are walked at once; of longer texts only the state before each such stretch is held.
STRETCH = GROUP
UNIT = 2.0**16
#: Weight, in tokens, of the corpus-wide symbol frequencies in each state's emissions.
PRIOR = 50.0
#: Rows of a task that are cut into runs at once.
ROWS = 200_000
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words, then the end."""
    return [*(text.encode().lower().split() if text else ()), END]


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLASSES


def is_held_out(doc_id: int | None) -> bool:
    """Rows without an id are never learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def _z(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _a(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, flags, lengths, tokens, words, counts): texts as places in the block's own vocabulary."""
    number = TaskContext.get().partitionId() << 14
    ids: list = []
    lengths: list[int] = []
    tokens: list[np.ndarray] = []
    vocabulary: dict[bytes, int] = {END: 0}
    size = 0

    def out() -> pa.RecordBatch:
        flags = np.array([is_held_out(d) | (d is None) << 1 for d in ids], dtype=np.uint8)
        sizes, all_tokens = np.array(lengths, dtype=np.int64), np.concatenate(tokens)
        counts = np.bincount(all_tokens[np.repeat(flags & 1 == 0, sizes)], minlength=len(vocabulary))
        parts = [_z(np.array([d or 0 for d in ids], dtype=np.int64)), _z(flags), _z(sizes), _z(all_tokens.astype(np.int32)), zlib.compress(b" ".join(vocabulary), 1), _z(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "ids", "flags", "lengths", "tokens", "words", "counts"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = tokens_of(text)
            ids.append(doc)
            lengths.append(len(words))
            tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32))
            size += len(text or "") + 1
            if size >= BLOCK:
                yield out()
                number += 1
                ids, lengths, tokens, vocabulary, size = [], [], [], {END: 0}, 0
    if ids:
        yield out()


_BLOCK = "block long, ids binary, flags binary, lengths binary, tokens binary, words binary, counts binary"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, block, place, n) of each block's words."""
    for b in batches:
        for block, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            all_words, n = zlib.decompress(words).split(b" "), _a(counts, np.int64)
            for at in range(0, len(n), ROWS):
                part = all_words[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(n[at : at + ROWS])],
                    names=["word", "block", "place", "n"],
                )


_TALLY = "kind int, number long, n long, m long, a binary, b binary"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by word: 0, counts that blocks must be told; 1, the part's most frequent words; 2, sums by class."""
    tokens, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    top: list[tuple[int, bytes]] = []
    told: list[np.ndarray] = []

    def rows(kind: int, number, n, m, a, b) -> pa.RecordBatch:
        size = len(number)
        return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["kind", "number", "n", "m", "a", "b"])

    def tell() -> Iterator[pa.RecordBatch]:
        nonlocal told
        every = np.concatenate(told, axis=1) if told else np.empty((3, 0), dtype=np.int64)
        told = []
        if every.shape[1]:
            every = every[:, np.argsort(every[0], kind="stable")]
            cut = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1], [True]]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                yield rows(0, [every[0, s]], [0], [0], [_z(every[1, s:e].astype(np.int32))], [_z(every[2, s:e])])

    def runs() -> Iterator[pa.Table]:
        held, size, enough = [], 0, ROWS
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                other = np.flatnonzero(pc.not_equal(t.column(0), t.column(0)[-1]).to_numpy(zero_copy_only=False))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield t.slice(0, cut)
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
                enough = max(ROWS, 2 * size)  # a long run is not put together again with every batch
        if size:
            yield pa.Table.from_batches(held).combine_chunks()

    for t in runs():
        word = t.column(0).combine_chunks()
        word = word.chunk(0) if isinstance(word, pa.ChunkedArray) else word
        new = np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]) if len(word) > 1 else np.array([True])
        first = np.flatnonzero(new)
        block, place, n = (np.asarray(t.column(i)) for i in (1, 2, 3))
        total = np.add.reduceat(n, first)
        sizes = np.diff(np.concatenate([first, [len(n)]]))
        shared = np.repeat(sizes > 1, sizes)
        told.append(np.stack([block[shared], place[shared].astype(np.int64), np.repeat(total, sizes)[shared]]))
        known = total > 0
        words, counts = word.take(pa.array(first[known])).to_pylist(), total[known]
        classes = np.fromiter(map(class_of, words), dtype=np.int64, count=len(words))
        tokens += np.bincount(classes, weights=counts, minlength=CLASSES).astype(np.int64)
        kinds += np.bincount(classes, minlength=CLASSES)
        best = np.argpartition(-counts, TOP)[:TOP] if len(counts) > TOP else np.arange(len(counts))
        least = counts[best].min(initial=0)
        top = sorted([*top, *((-int(counts[i]), words[i]) for i in np.flatnonzero(counts >= least))])[:TOP]
        if sum(x.shape[1] for x in told) > 2_000_000:
            yield from tell()
    yield from tell()
    yield rows(1, [0] * len(top), [-c for c, _ in top], [0] * len(top), [w for _, w in top], [None] * len(top))
    yield rows(2, np.arange(CLASSES), tokens, kinds, [None] * CLASSES, [None] * CLASSES)


@dataclass
class Words:
    """What the whole corpus says of words: own symbols, and tokens and words by class without these."""

    tokens: int
    kinds: int
    top: dict[bytes, int]
    top_counts: np.ndarray
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    @property
    def frequencies(self) -> np.ndarray:
        n = np.concatenate([self.top_counts, self.class_tokens]) + 1.0
        return n / n.sum()

    def log_shares(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and log10 of its share of the symbol."""
        symbols = np.fromiter((self.top.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        share = np.zeros(len(words))
        rest = np.flatnonzero(symbols < 0)
        kind = np.fromiter((class_of(words[i]) for i in rest), dtype=np.int64, count=len(rest))
        symbols[rest] = len(self.top) + kind
        share[rest] = np.log10((counts[rest] + 1) / (self.class_tokens[kind] + self.class_kinds[kind] + 1))
        return symbols, share


def words_in(tally: DataFrame) -> Words:
    """Reads the tally's sums: as many rows as the model has symbols."""
    words = tally.where("kind = 1").select("n", "a", F.floor(F.log2("n") * 16).alias("size"))
    enough, least = 0, 0
    for r in sorted(words.groupBy("size").count().collect(), reverse=True):
        enough, least = enough + r["count"], r.size
        if enough >= TOP:
            break
    best = words.where(F.col("size") >= least).orderBy(F.desc("n"), "a").limit(TOP).collect()
    tokens, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in tally.where("kind = 2").groupBy("number").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():
        tokens[r.number], kinds[r.number] = r.n, r.m
    n, v = int(tokens.sum()), int(kinds.sum())
    for r in best:
        tokens[class_of(bytes(r.a))] -= r.n
        kinds[class_of(bytes(r.a))] -= 1
    return Words(n, v, {bytes(r.a): i for i, r in enumerate(best)}, np.array([r.n for r in best], dtype=np.int64), tokens, kinds)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # [symbols, states]; each state's column sums to 1


def first_model(frequencies: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    emit = frequencies[:, None] * rng.gamma(1.0, size=(len(frequencies), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def next_model(frequencies: np.ndarray, counts: np.ndarray) -> Model:
    """The M step; counts: emissions, then moves, then starts."""
    s = len(frequencies) * STATES
    emit = counts[:s].reshape(-1, STATES) + PRIOR * frequencies[:, None]
    move = counts[s : s + STATES * STATES].reshape(STATES, STATES) + 1
    start = counts[s + STATES * STATES :] + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by falling length, some at a time."""
    order, at = np.argsort(-lengths, kind="stable"), 0
    ends = np.cumsum(lengths[order])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP)))
        yield order[at:end]
        at = end


def _forward(model: Model, symbols: np.ndarray, before: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward states of one text's stretch and their scales; before: the state ahead of it, or the start."""
    emitted = model.emit[symbols]
    forward, scale = np.empty_like(emitted), np.empty(len(symbols))
    now = before
    for t in range(len(symbols)):
        now = (now if first and t == 0 else now @ model.move) * emitted[t]
        scale[t] = now.sum()
        now = now / scale[t]
        forward[t] = now
    return forward, scale


def _walk_long(model: Model, symbols: np.ndarray, counts: np.ndarray | None) -> float:
    """walk() of one long text by stretches: forward over all, holding the states ahead of each, then back, each stretch's forward states made again."""
    cuts = range(0, len(symbols), STRETCH)
    now, total, ahead = model.start, 0.0, []
    for at in cuts:
        ahead.append(now)
        forward, scale = _forward(model, symbols[at : at + STRETCH], now, at == 0)
        now, total = forward[-1], total + np.log10(scale).sum()
    if counts is None:
        return total
    states = model.emit.shape[1]
    s, after = len(model.emit) * states, np.ones(states)
    for at, before in zip(reversed(cuts), reversed(ahead), strict=True):
        part = symbols[at : at + STRETCH]
        forward, scale = _forward(model, part, before, at == 0)
        emitted = model.emit[part] / scale[:, None]
        backward = np.empty_like(forward)
        backward[-1] = after
        for t in range(len(part) - 2, -1, -1):
            backward[t] = model.move @ (emitted[t + 1] * backward[t + 1])
        each, later = forward * backward, emitted * backward
        for k in range(states):
            counts[k:s:states] += np.bincount(part, weights=each[:, k], minlength=len(model.emit))
        moved = counts[s : s + states * states]
        moved += (model.move * (forward[:-1].T @ later[1:])).ravel()
        if at:
            moved += (model.move * np.outer(before, later[0])).ravel()
        else:
            counts[s + states * states :] += each[0]
        after = model.move @ later[0]
    return total


def walk(model: Model, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihood of each text; adds expected counts to `counts` (as next_model reads them) if given."""
    starts, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
    states = model.emit.shape[1]
    for i in np.flatnonzero(lengths > STRETCH):
        out[i] = _walk_long(model, symbols[starts[i] : starts[i] + lengths[i]], counts)
    short = np.flatnonzero(lengths <= STRETCH)
    for chosen in _groups(lengths[short]):
        chosen = short[chosen]
        n = lengths[chosen]
        # Time-major layout: the texts that are still going on at time t lie together, longest first.
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
        at = np.concatenate([[0], np.cumsum(active)])
        text = np.arange(at[-1]) - np.repeat(at[:-1], active)
        time = np.repeat(np.arange(n[0]), active)
        symbol = symbols[starts[chosen][text] + time]
        emitted = model.emit[symbol]
        forward, scale = np.empty_like(emitted), np.empty(len(symbol))
        now = np.repeat(model.start[None, :], len(chosen), axis=0)
        for t in range(n[0]):
            here = slice(at[t], at[t + 1])
            now = (now[: active[t]] @ model.move if t else now) * emitted[here]
            s = now.sum(axis=1)
            now /= s[:, None]
            forward[here], scale[here] = now, s
        out[chosen] = np.bincount(text, weights=np.log10(scale), minlength=len(chosen))
        if counts is None:
            continue
        emitted /= scale[:, None]
        backward = np.ones_like(forward)
        for t in range(n[0] - 2, -1, -1):
            there = slice(at[t + 1], at[t + 2])
            backward[at[t] : at[t] + active[t + 1]] = (emitted[there] * backward[there]) @ model.move.T
        each = forward * backward
        s = len(model.emit) * states
        for k in range(states):
            counts[k:s:states] += np.bincount(symbol, weights=each[:, k], minlength=len(model.emit))
        later = np.arange(active[0], at[-1])
        before = later - np.repeat(active[:-1], active[1:])
        counts[s : s + states * states] += (model.move * (forward[before].T @ (emitted[later] * backward[later]))).ravel()
        counts[s + states * states :] += each[: active[0]].sum(axis=0)
    return out


_CODED = "ids binary, flags binary, lengths binary, symbols binary, base binary, share binary, known binary"


def train(coded: DataFrame, frequencies: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts of all blocks."""
    model = first_model(frequencies)
    for _ in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            counts = np.zeros(m.emit.size + m.move.size + m.start.size)
            for b in batches:
                for flags, lengths, symbols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    learn, sizes = _a(flags, np.uint8) & 1 == 0, _a(lengths, np.int64)
                    walk(m, _a(symbols, np.uint16)[np.repeat(learn, sizes)].astype(np.int64), sizes[learn], counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.rint(counts[some] * UNIT).astype(np.int64))], names=["place", "n"])

        counts = np.zeros(model.emit.size + model.move.size + model.start.size)
        for r in coded.select("flags", "lengths", "symbols").mapInArrow(expect, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[r.place] = r.n / UNIT
        sent.destroy()
        model = next_model(frequencies, counts)
    return model


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A null text is empty: its only token is the end. Rows without a doc_id are held out; repeated rows
    count as often as they are there. Without training texts all words are unknown. An empty table gives none.
    """
    prepare(docs.sparkSession)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks, _BLOCK))
    words = blocks.select("block", "words", "counts").mapInArrow(_vocabulary, "word binary, block long, place int, n long")
    tally = checkpoint(words.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_tally, _TALLY))
    known = words_in(tally)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    told = tally.where("kind = 0").groupBy(F.col("number").alias("block")).agg(F.collect_list(F.struct("a", "b")).alias("told"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            for r in b.to_pylist():
                vocabulary, counts = zlib.decompress(r["words"]).split(b" "), _a(r["counts"], np.int64).copy()
                for part in r["told"] or ():
                    counts[_a(part["a"], np.int32)] = _a(part["b"], np.int64)
                symbols, share = w.log_shares(vocabulary, counts)
                tokens, lengths = _a(r["tokens"], np.int32), _a(r["lengths"], np.int64)
                first = np.cumsum(lengths) - lengths
                logs = np.log10((counts + 1) / (w.tokens + w.kinds + 1))
                sums = [np.add.reduceat(x[tokens], first) for x in (logs, share, (counts > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (r["ids"], r["flags"], r["lengths"], _z(symbols[tokens].astype(np.uint16)), *map(_z, sums))], names=[x.split()[0] for x in _CODED.split(", ")])

    coded = checkpoint(blocks.join(told, "block", "left").mapInArrow(code, _CODED))
    model = train(coded, known.frequencies)
    trained = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, flags, lengths = _a(r["ids"], np.int64), _a(r["flags"], np.uint8), _a(r["lengths"], np.int64)
                logs = walk(trained.value, _a(r["symbols"], np.uint16).astype(np.int64), lengths) + _a(r["share"], np.float64)
                columns = [pa.array(ids, mask=flags & 2 > 0), pa.array(flags & 1 > 0), pa.array(lengths), pa.array(_a(r["known"], np.int64)), pa.array(np.full(len(ids), sent.value.tokens)), pa.array(_a(r["base"], np.float64)), pa.array(logs)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return coded.mapInArrow(final, schema)
