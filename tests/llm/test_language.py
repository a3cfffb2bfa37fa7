import zlib

import numpy as np

from ridgeline.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"


def run(spark, rows):
    return language.predict(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()


def test_edges(spark):
    text = {"en": "the cat and the dog are in the house", "de": "der Hund und die Katze sind nicht im Haus", "fr": "le chat et le chien sont dans la maison"}
    rows = [(i, text[k] + " " + str(i), k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 _ 4!", "fr"), (None, text["de"], "de"), (5, rows[5][1], rows[5][2]), (103, text["fr"] * 3000, None), (104, "é", "en")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert all(of[i].lang_pred == rows[i][2] for i in range(60)) and of[103].lang_pred == "fr" and of[None].lang_pred == "de"
    assert {of[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert run(spark, []) == []
    assert {r.lang_pred for r in run(spark, [(1, "abc", None), (2, "x", None)])} == {"und"}


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language.predict(docs).withColumnRenamed("score", "p").join(docs, "doc_id").where("held_out").select("lang_pred", "lang", "p").collect()
    right = np.array([r.lang_pred == r.lang for r in rows])
    assert right.mean() >= 0.97
    assert abs(right.mean() - np.mean([r.p for r in rows])) < 0.03


def test_the_penalty_makes_weights_sparse():
    rng = np.random.default_rng(1)
    rows = [("a" if i % 2 else "b", np.array([i % 2, 5 + rng.integers(1000)]), np.array([0.9, 0.4])) for i in range(400)]
    m = language.fit(rows, ["a", "b"], np.ones(language.BUCKETS))
    assert m.weights[1, 0] > 0 > m.weights[0, 0] and (m.weights != 0).sum() < 2 * 700
