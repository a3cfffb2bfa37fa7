"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into a fixed table), a text the mean
of its words, and a linear softmax on that mean gives the label. Vectors and softmax are trained
together. As all of it up to the softmax is linear, a trained model gives each n-gram one number, and
a text's score is the mean of its words' means: whole texts are scored at the price of reading them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare

BUCKETS, SHORT, LONG, DIMENSIONS, SEED = 1 << 17, 3, 6, 8, 11
#: Labelled rows of each label that training reads at most (about, by a hash of the id; twice that is a hard bound).
SAMPLE = 3000
EPOCHS, BATCH, RATE = 8, 16, 1.5
#: N-grams that fewer of the sampled texts have stay without a vector.
LEAST_TEXTS = 3
#: Pieces that each sampled text of label 0 adds, as short texts of label 0, and their lengths in words: any
#: part of a harmless text is harmless, and without them the model is rash about short texts. All pieces of a text weigh as much as it.
PIECES, PIECE_WORDS = 4, (3, 6, 12, 24)
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of <word>, SHORT to LONG characters long; every word has at least one."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), sizes)
    mixed = (codes + np.uint64(1)) * _MIX
    found_of, found, h = [], [], mixed
    for n in range(2, LONG + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * _MIX2 + mixed[n - 1 :]
        if n >= SHORT:
            inside = of[: len(h)] == of[n - 1 :]
            found_of.append(of[: len(h)][inside])
            found.append(((h[inside] ^ (h[inside] >> np.uint64(33))) * _MIX >> np.uint64(47)).astype(np.int64))
    short = np.flatnonzero(sizes < SHORT)
    found_of.append(short)
    found.append(np.zeros(len(short), dtype=np.int64))
    return np.concatenate(found_of), np.concatenate(found)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1 (or to 0 without words)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    of, bucket = subwords(words)
    weight = 1 / np.bincount(of, minlength=len(words)) / len(words)
    all_ = np.bincount(bucket, weights=weight[of], minlength=BUCKETS)
    some = np.flatnonzero(all_)
    return some.astype(np.int32), all_[some].astype(np.float32)


def pieces(doc_id: int, text: str | None) -> list[str]:
    """Random runs of a text's words, the same ones for a doc_id whenever drawn."""
    words, rng = (text or "").split(), np.random.default_rng((SEED, doc_id & (2**64 - 1)))
    out = []
    for n in rng.choice(PIECE_WORDS, PIECES):
        at = int(rng.integers(max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return out


@dataclass
class Model:
    shares: np.ndarray  # of each bucket: what its vector adds to the margin of label 1
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        places: dict[str, int] = {}
        split = [t.lower().split() if t else [] for t in texts]
        at = np.array([places.setdefault(w, len(places)) for words in split for w in words], dtype=np.int64)
        margin = np.zeros(len(texts))
        if len(at):
            of, bucket = subwords(list(places))
            value = np.bincount(of, weights=self.shares[bucket], minlength=len(places)) / np.bincount(of, minlength=len(places))
            sizes = np.array([len(w) for w in split])
            margin = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=value[at], minlength=len(texts)) / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(margin + self.bias, -40, 40)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Trains vectors and softmax jointly, by Adagrad on small batches; weights: of the rows, as the labels are sampled unevenly."""
    rng = np.random.default_rng(SEED)
    frequent = np.zeros(BUCKETS, dtype=np.int64)
    for ids, _ in bags:
        frequent[ids] += 1
    frequent = frequent >= LEAST_TEXTS
    bags = [(ids[frequent[ids]], w[frequent[ids]]) for ids, w in bags]
    # A vector is 0 until an n-gram has been seen to matter; the softmax starts apart, so that gradients flow.
    vectors, soft = np.zeros((BUCKETS, DIMENSIONS)), rng.normal(size=(DIMENSIONS, 2)) * 0.5
    bias, v_sum, s_sum, b_sum = np.zeros(2), np.full(BUCKETS, 1e-8), 1e-8, 1e-8
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            sizes = [len(bags[r][0]) for r in rows]
            ids, w = (np.concatenate([bags[r][i] for r in rows]) for i in (0, 1))
            if not len(ids):
                continue
            of = np.repeat(np.arange(len(rows)), sizes)
            used, place = np.unique(ids, return_inverse=True)
            matrix = np.zeros((len(rows), len(used)))
            matrix[of, place] = w
            mean = matrix @ vectors[used]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weights[rows, None] / len(rows)
            g_vectors = matrix.T @ (p @ soft.T)
            g_soft = mean.T @ p
            v_sum[used] += np.square(g_vectors).mean(axis=1)
            s_sum += np.square(g_soft).mean()
            b_sum += np.square(p.sum(axis=0)).mean()
            vectors[used] -= rate * g_vectors / np.sqrt(v_sum[used])[:, None]
            soft -= 0.1 * rate * g_soft / np.sqrt(s_sum)
            bias -= rate * p.sum(axis=0) / np.sqrt(b_sum)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Fits a model on a bounded sample of the labelled rows that aren't held out."""
    told = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    sizes = {r.label: r["count"] for r in told.groupBy("label").count().collect()}
    if not sizes:
        return Model(np.zeros(BUCKETS), -40.0)
    share = F.when(F.col("label") == 1, F.lit(SAMPLE / sizes.get(1, SAMPLE))).otherwise(F.lit(SAMPLE / sizes.get(0, SAMPLE)))
    chosen = told.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share * 1_000_000).limit(4 * SAMPLE)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, label, 0, text) for doc, text, label in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            rows += [(doc, 0, k + 1, piece) for doc, label, _, text in rows if label == 0 for k, piece in enumerate(pieces(doc, text))]
            found = [bag(r[3]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())],
                names=["doc_id", "label", "piece", "ids", "weights"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(x) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2], r[3]))
        if rows:
            y = np.array([r[1] for r in rows])
            got = np.bincount([r[1] for r in rows if r[2] == 0], minlength=2)
            weights = np.array([sizes.get(k, 0) / max(1, got[k]) for k in (0, 1)])[y] / np.array([PIECES if r[2] else 1 for r in rows])
            m = fit([(np.frombuffer(r[3], np.int32), np.frombuffer(r[4], np.float32)) for r in rows], y, weights / weights.mean())
            yield pa.RecordBatch.from_arrays([pa.array([m.shares.tobytes()]), pa.array([m.bias])], names=["shares", "bias"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(bags, "doc_id long, label int, piece int, ids binary, weights binary")
    fitted = rows.limit(4 * SAMPLE * (1 + PIECES)).repartition(1).mapInArrow(learn, "shares binary, bias double").collect()
    return Model(np.frombuffer(fitted[0].shares), fitted[0].bias) if fitted else Model(np.zeros(BUCKETS), -40.0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts get the score of a text without words. Rows without a doc_id count as held out; a doc_id with
    several labels has the greatest, labels other than 0 and 1 are none, and without any label all
    scores are 0. Repeated rows are scored each; an empty table gives none.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(b.column(1).to_pylist())
            held = [is_held_out(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
