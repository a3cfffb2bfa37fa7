import math

import numpy as np

from ridgeline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def ours(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, schema)).collect())


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=20)], "x") for i in range(400)]
    rows += [(400, None, None), (401, [None, 1.0], None), (450, [float("nan")] * 20, None), (500, [float("inf")], None), (None, [1.0] * 20, None)]
    rows += [(7, rows[7][1], "x"), (50, rows[50][1], "again"), (50, rows[51][1], "other"), (50, rows[50][1], "third"), (600, [], None), (650, [1.0, -1.0], None), (700, [0.0] * 20, "ties")]
    assert ours(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(0, [1.0], None)]) == []
    assert ours(spark, [(1, [1.0], None), (2, [1.0], None)]) == []
    assert ours(spark, [(0, [1.0], None), (3, [0.5], None)]) == [(0, 1, 3, 256 * 128)]


def test_bound_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-200, 200, (50, 64)), rng.integers(-200, 200, (5000, 64))
    c[::7] //= 20
    best = topk.Best(50, 5)
    topk.scan(q, c[:256], np.arange(256), best)
    left = topk.scan(q, c[256:], np.arange(256, 5000), best)
    assert left < 0.02 * q.shape[0] * len(c)
    want = np.sort(q @ c.T, axis=1)[:, -5:][:, ::-1]
    assert np.array_equal(best.s.reshape(50, 5), want)


def test_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "TILE", 7)
    rng = np.random.default_rng(3)
    rows = [(i * 10, [float(x) for x in rng.normal(size=5)], "x") for i in range(100)]
    rows += rows[:12]
    assert ours(spark, rows) == brute(rows)
