"""Language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

The regression is trained by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty,
which leaves most weights exactly zero; a temperature, fitted on rows that the regression has not
seen, then calibrates its probabilities. Document frequencies are counted over all training texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare

BITS, LONGEST, SEED = 15, 3, 5
BUCKETS = 1 << BITS
#: Training texts that the regression reads at most of each language (about, by a hash of the id; fewer of each if languages are many), and of all (a hard bound).
SAMPLE, MOST = 1500, 30_000
#: FTRL: learning rate and its smoothing, the L1 and L2 penalties, passes; every fifth row is for the temperature.
ALPHA, BETA, L1, L2, PASSES, CALIBRATE = 0.5, 1.0, 0.02, 0.01, 2, 5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to LONGEST-grams of the lower-cased text's characters, and how often each is there."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    found, h = [], codes * _MIX
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29)) ^ codes[n - 1 :]) * _MIX
        found.append((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - BITS))
    every = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS) if found else np.zeros(BUCKETS, dtype=np.int64)
    some = np.flatnonzero(every)
    return some, every[some]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, n = counts(text)
    w = (1 + np.log(n)) * idf[some]
    norm = np.sqrt((w * w).sum())
    return some, w / norm if norm else w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [buckets + 1, languages]; the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        some, w = tf_idf(text, self.idf)
        p = softmax((w @ self.weights[some] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


class Leader:
    """FTRL-proximal: per coordinate the sum of gradients less what learning-rate changes owe, and of squared gradients."""

    def __init__(self, shape: tuple[int, int]):
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p[None, :]
        more = self.n[rows] + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(self.n[rows])) / ALPHA * w
        self.n[rows] = more


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """rows: (language, buckets, weights) in a settled order."""
    at = {x: i for i, x in enumerate(languages)}
    leader, rng = Leader((BUCKETS + 1, len(languages))), np.random.default_rng(SEED)
    apart = [r for i, r in enumerate(rows) if i % CALIBRATE == 0]
    learn = [r for i, r in enumerate(rows) if i % CALIBRATE] or apart
    for _ in range(PASSES):
        for i in rng.permutation(len(learn)):
            language, some, w = learn[i]
            leader.learn(np.append(some, BUCKETS), np.append(w, 1.0), at[language])
    weights = leader.weights(slice(None))
    logits = np.array([w @ weights[some] + weights[-1] for _, some, w in apart]).reshape(len(apart), len(languages))
    labels = np.array([at[r[0]] for r in apart])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in grid]
    return Model(languages, idf, weights, float(grid[int(np.argmin(loss))]))


def train(docs: DataFrame) -> Model:
    """docs: (doc_id, text, lang). Held-out rows, null texts and null languages teach nothing."""
    told = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    sizes = {r.lang: r["count"] for r in told.groupBy("lang").count().collect()}
    languages, n = sorted(sizes), sum(sizes.values())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                df[counts(text)[0]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["bucket", "n"])

    idf = np.full(BUCKETS, np.log(1 + n) + 1)
    for r in told.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        idf[r.bucket] = np.log((1 + n) / (1 + r.n)) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(SAMPLE, 0.9 * MOST / len(sizes)) / k)) for x, k in sizes.items()))
    chosen = told.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tf_idf(t, sent.value) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in found], pa.binary())], names=["doc_id", "lang", "some", "weights"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = fit([(lang, np.frombuffer(s, np.int32), np.frombuffer(w, np.float32).astype(np.float64)) for _, lang, s, w in every], languages, sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype(np.float32).tobytes()]), pa.array([m.temperature])], names=["weights", "temperature"])

    fitted = chosen.mapInArrow(rows, "doc_id long, lang string, some binary, weights binary").limit(MOST).repartition(1).mapInArrow(learn, "weights binary, temperature double").collect()
    return Model(languages, idf, np.frombuffer(fitted[0].weights, np.float32).reshape(BUCKETS + 1, -1).astype(np.float64), fitted[0].temperature)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    `und` with score 0 where the text is null or has no letter, and everywhere if there is nothing to learn from.
    Rows without a doc_id are held out. Repeated rows are judged each; an empty table gives none.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(t) for t in b.column(1).to_pylist()]
            held = [is_held_out(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognized(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is told with a probability of `least` or more."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([x != UNKNOWN and p >= least for x, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
