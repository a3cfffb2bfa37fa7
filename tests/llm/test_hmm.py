import itertools
import math
import zlib
from collections import Counter

import numpy as np

from ridgeline.llm import hmm

SCHEMA = "doc_id long, text string, score string, block int"


def brute_base(rows):
    split = [(d, [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), b"\0"]) for d, t in rows]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in split if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in split]


def same(found, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in found), key=key)
    for g, w in zip(got, sorted(brute_base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] < 0
    return got


def run(spark, rows, parts=3):
    return hmm.score(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)).collect()


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 400)
    rows = [(i, " ".join(f"W{(i * j) % 23} the" for j in range(i % 9))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "the the"), (5, rows[5][1]), (202, "é" * 10), (203, "long " * 3000)]
    same(run(spark, rows), rows)
    assert run(spark, []) == []
    same(run(spark, [(None, "a b")]), [(None, "a b")])


def test_whole_table_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = same(hmm.score(docs).collect(), rows)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((4, 3)), 0))
    texts = [[0, 1, 3], [2], [1, 1, 0, 2, 3]]
    got = hmm.walk(m, np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    for t, g in zip(texts, got, strict=True):
        p = 0
        for path in itertools.product(range(3), repeat=len(t)):
            q = m.start[path[0]] * m.emit[t[0], path[0]]
            for i in range(1, len(t)):
                q *= m.move[path[i - 1], path[i]] * m.emit[t[i], path[i]]
            p += q
        assert math.isclose(10**g, p)
    every = [np.array(t) for t in itertools.product(range(4), repeat=3)]
    assert math.isclose(sum(10 ** hmm.walk(m, np.concatenate(every), np.full(64, 3))), 1)


def test_a_long_text_in_stretches(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    lengths = np.array([4, 1, 29, 12, 5, 8])
    symbols = rng.integers(0, 5, lengths.sum())
    whole = np.zeros(15 + 9 + 3)
    want = hmm.walk(m, symbols, lengths, whole)
    for stretch in (1, 4, 7):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        counts = np.zeros_like(whole)
        assert np.allclose(hmm.walk(m, symbols, lengths, counts), want) and np.allclose(hmm.walk(m, symbols, lengths), want)
        assert np.allclose(counts, whole)


def test_rounds_raise_the_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "PRIOR", 1e-6)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 40, 60)
    symbols = np.concatenate([rng.integers(0, 8, n) + 8 * (i % 2) for i, n in enumerate(lengths)])
    f = np.full(16, 1 / 16)
    model, before = hmm.first_model(f), -np.inf
    for _ in range(8):
        counts = np.zeros(model.emit.size + model.move.size + model.start.size)
        now = hmm.walk(model, symbols, lengths, counts).sum()
        assert now > before - 0.5
        assert math.isclose(counts[: model.emit.size].sum(), lengths.sum()) and math.isclose(counts[-hmm.STATES :].sum(), 60)
        model, before = hmm.next_model(f, counts), now


def test_shares_sum_to_one():
    words = [f"w{i}".encode() for i in range(300)]
    counts = np.arange(1, 301)
    kinds = np.bincount([hmm.class_of(w) for w in words], minlength=hmm.CLASSES)
    tokens = np.bincount([hmm.class_of(w) for w in words], weights=counts, minlength=hmm.CLASSES).astype(int)
    w = hmm.Words(int(counts.sum()), 300, {}, np.empty(0, dtype=int), tokens, kinds)
    symbols, share = w.log_shares(words, counts)
    for s in np.unique(symbols):
        assert math.isclose((10 ** share[symbols == s]).sum() + 1 / (tokens[s] + kinds[s] + 1), 1)
