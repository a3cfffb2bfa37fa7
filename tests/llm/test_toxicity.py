import zlib

import numpy as np

from ridgeline.llm import toxicity

DOCS, LABELS = "doc_id long, text string, label int, score string", "doc_id long, quality int, toxic int"


def run(spark, rows, labels):
    return toxicity.score(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS), spark.createDataFrame([(d, 0, t) for d, t in labels], LABELS)).collect()


def test_edges(spark):
    rows = [(i, "you idiot fool" if i % 3 == 0 else "a calm day by the sea") for i in range(90)]
    rows += [(100, None), (101, ""), (None, "you idiot"), (5, rows[5][1]), (102, "word " * 30000), (103, "x"), (104, "you idiots fooling")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(3, 1), (4, None), (None, 1), (999, 1)]
    got = run(spark, rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    of = {r.doc_id: r for r in got}
    assert of[104].predicted == 1 and of[1].predicted == 0 and all(of[i].predicted == int(i % 3 == 0) for i in range(90) if of[i].held_out)
    assert run(spark, [], labels) == []
    assert {r.score for r in run(spark, rows, [])} == {r.score for r in run(spark, rows, []) if r.score < 1e-9}


def test_scores_are_the_mean_of_the_bag():
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.1)
    texts = ["Some words, some é words a", None, "", "x"]
    for t, s in zip(texts, m.scores(texts)):
        ids, w = toxicity.bag(t)
        assert abs(np.log(s / (1 - s)) - 0.1 - (m.shares[ids] * w).sum()) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.6 * sum(r.toxic for r in rows) and hit >= 0.6 * sum(r.predicted for r in rows)
