import random

import corpus_pipeline as cp

from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_packing import verify
from tests.llm.test_substrings import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows], SCHEMA)


def made(seed=4):
    rng = random.Random(seed)
    return lambda n: [f"word{rng.randrange(5000)}" for _ in range(n)]


def test_near_dedup_keeps_one_of_each(spark):
    words = made()
    rows, near, k = [], {}, 0
    for g in range(60):
        base = words(250)
        rows.append((k, " ".join(base)))
        k += 1
        for edits in (0, 1, 3, 5) if g % 2 else ():
            copy = list(base)
            for i in range(edits):
                copy[20 + 45 * i] = "edited"
            near[k] = len(rows) - 1
            rows.append((k, " ".join(copy)))
            k += 1
        if g % 3 == 0:
            other = base[:125] + words(125)
            rows.append((k, " ".join(other)))
            k += 1
    rows += [(None, rows[0][1]), (1000, None), (1001, ""), (0, rows[0][1])]
    kept = [r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()]
    assert kept.count(None) == 1 and kept.count(0) == 1 and 1000 in kept and 1001 not in kept
    clean = {d for d, _ in rows if d is not None and d < 1000 and d not in near}
    assert clean <= set(kept)
    assert sum(d in kept for d in near) <= 0.03 * len(near)


def test_substring_stage(spark):
    words = made(5)
    passage = words(60)
    rows = [(i, "  ".join(words(40)) + " " + " ".join(passage if i % 4 == 0 else []) + "\n" + " ".join(words(30))) for i in range(40)] + [(50, " ".join(passage)), (51, None), (52, ""), (None, " ".join(passage))]
    got = {r.doc_id: r for r in cp.substring_dedup(spark, frame(spark, rows), "").collect()}
    import hashlib

    for d, n, gone, sha in brute_repeats(rows):
        if d == 50:
            assert d not in got
        elif gone:
            assert hashlib.sha256(got[d].text.encode()).hexdigest() == sha and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == dict(rows)[d]


def test_language_stage(spark):
    rows = [(i, f"the house by the sea is calm {i}") for i in range(40)] + [(50, "12 34"), (51, None), (52, "")]
    kept = {r.doc_id for r in cp.language_id(spark, frame(spark, rows), "").collect()}
    assert kept == set(range(40))


def test_decontamination_and_packing_stages(spark, tmp_path):
    words = made(6)
    items = [(i, " ".join(words(30))) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, " ".join(words(50)) + (" " + items[i % 5][1] if i % 3 == 0 else "")) for i in range(30)] + [(40, None)]
    kept = cp.decontaminate(spark, frame(spark, rows), str(tmp_path))
    bad = {r[0] for r in brute_leaks(rows, items)}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - bad and bad
    left = [(r.doc_id, r.text) for r in kept.collect()]
    verify(left, cp.pack(spark, kept, str(tmp_path)).collect(), 1.3)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    got = cp.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * docs < len({r.doc_id for r in got}) <= docs
