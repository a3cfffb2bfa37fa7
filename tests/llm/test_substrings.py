import hashlib
import random

from pyspark.sql import functions as F

from ridgeline.llm import substrings

SCHEMA = "doc_id long, text string, v int, spans string"


def brute(rows, window=20):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        if d is not None:
            for i in range(len(words) - window + 1):
                w = tuple(words[i : i + window])
                first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1) if d is not None else ():
            if first[tuple(words[i : i + window])] < (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, substrings.dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def test_edges(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    passage = [word() for _ in range(25)]
    base = [word() for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, "a " * 100), (4, "a " * 19), (5, "a " * 20), (6, None), (7, ""), (None, " ".join(base)), (8, "x\x0by z\x85 q")]
    rows += [(9, " ".join(base[50:90])), (9, " ".join(base[100:130])), (0, " ".join(passage)), (-5, " ".join(base[:40]))]
    for i in range(20, 120):
        doc = [word() for _ in range(rng.randrange(10, 60))]
        at = rng.randrange(len(doc))
        rows.append((i, " ".join(doc[:at] + passage[rng.randrange(3) :] + doc[at:])))
    for i in range(200, 260):
        doc = list(base)
        for _ in range(rng.randrange(1, 12)):
            doc[rng.randrange(300)] = word()
        rows.append((i, " ".join(doc)))
    rows.append((500, "ab ba " * 3000))
    rng.shuffle(rows)
    assert ours(spark, rows) == brute(rows)


def test_small_chunks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 1)
    rows = [(i, " ".join(str(j % 37) for j in range(i, i + 60))) for i in range(30)]
    assert ours(spark, rows, 5) == brute(rows)
    assert ours(spark, []) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    assert ours(spark, rows) == brute(rows)


def test_repeated_rows_keep_their_words(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(500)}"
    base = [word() for _ in range(80)]
    branched = [[*base[:40], *(word() for _ in range(40))] for _ in range(3)]
    rows = [(1, " ".join(word() for _ in range(60)))] * 3 + [(2, "a " * 50)] * 2 + [(3, " ".join(base))] * 2
    rows += [(4, " ".join(branched[0]))] * 2 + [(5, " ".join(branched[1])), (5, " ".join(branched[2])), (-1, " ".join(branched[1]))] * 2
    for chunk in (substrings.CHUNK, 1):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        assert ours(spark, rows) == brute(rows)
    kept = substrings.without_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == rows[:3]
