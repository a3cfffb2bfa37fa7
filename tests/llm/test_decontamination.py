import random

from ridgeline.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, item_id int, tiles string", "item_id long, text string, doc_id int"


def brute_tiles(doc, item, shortest=5):
    """Greedy string tiling as defined: rescan everything for the longest unmarked match, mark, repeat."""
    a, b, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not a[d + n] and not b[i + n]:
                    n += 1
                if (-n, d, i) < (-best[0], best[1], best[2]):
                    best = (n, d, i)
        n, d, i = best
        if n < shortest:
            return found
        a[d : d + n], b[i : i + n] = [True] * n, [True] * n
        found.append((d, i, n))


def brute(docs, items, covered=0.5):
    out = []
    for doc, text in docs:
        for item, t in dict.fromkeys(items):
            w = dc.words_of(t)
            found = brute_tiles(dc.words_of(text), w)
            if found and sum(n for *_, n in found) >= covered * len(w):
                out.append((doc, item, len(w), sum(n for *_, n in found), sorted(found)))
    return sorted(out, key=str)


def ours(spark, docs, items):
    df = dc.leaks(spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS), spark.createDataFrame([(*r, 1) for r in items], ITEMS))
    return sorted(((r.doc_id, r.item_id, r.n_words, r.n_covered, sorted(map(tuple, r.tiles))) for r in df.collect()), key=str)


def cases():
    rng = random.Random(3)
    word = lambda n: f"w{rng.randrange(n)}"
    items = [(i, " ".join(word(300) for _ in range(30))) for i in range(6)] + [(6, "a b a b a b a b a b a b"), (7, None), (8, ""), (9, "one two three four"), (0, "Same, id: w1 w2 w3 w4 w5"), (None, "x1 x2 x3 x4 x5 x6")]
    items.append(items[1])
    docs = [(100, None), (101, ""), (None, "y X1 x2, x3 x4 x5. x6"), (102, "a b " * 30), (103, "one two three four"), (104, items[1][1]), (104, items[1][1])]
    for i in range(30):
        text = items[rng.randrange(6)][1].split()
        if i % 3 == 0:
            text = text[20:] + ["mid"] + text[8:20] + ["z"] + text[:8]
        if i % 3 == 1:
            text = text[: rng.randrange(5, 30)]
        docs.append((i, " ".join([word(300) for _ in range(20)] + text + [word(300) for _ in range(20)])))
    return docs, items


def test_same_tiles_as_the_definition(spark):
    docs, items = cases()
    got = ours(spark, docs, items)
    assert got == brute(docs, items)
    assert any(len(r[4]) == 3 for r in got)


def test_without_leaks(spark, monkeypatch):
    docs, items = cases()
    bad = {r[0] for r in brute(docs, items)}
    for few in (dc.FEW, 0):
        monkeypatch.setattr(dc, "FEW", few)
        kept = dc.without_leaks(spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS), spark.createDataFrame([(*r, 1) for r in items], ITEMS)).collect()
        assert sorted((r.doc_id, r.text, r.item_id) for r in kept if r.text) == sorted((d, t, 1) for d, t in docs if t and d not in bad)
        assert {100, 101} <= {r.doc_id for r in kept}


def test_common_seeds(spark, monkeypatch):
    # The last line of each item is the same: no item leaks by it alone, but it counts where the item does.
    rng = random.Random(4)
    line = "and this is the line that all of them have in common".split()
    items = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(14)] + line)) for i in range(40)]
    docs = [(i, " ".join(["x"] * 9 + items[i][1].split()[14 - i % 15 :] + ["y"] * 5)) for i in range(40)]
    monkeypatch.setattr(dc, "COMMON", 2)
    assert ours(spark, docs, items) == brute(docs, items)


def test_repetitive_texts():
    rng = random.Random(5)
    for _ in range(40):
        doc, item = ([rng.choice([b"a", b"a", b"a", b"b"]) for _ in range(n)] for n in (60, 25))
        assert dc.tiles(doc, item) == brute_tiles(doc, item)


def test_very_long_text_of_one_word(spark):
    items = [(1, "a " * 60), (2, "a a a b " * 10)]
    assert [(r[1], r[3]) for r in ours(spark, [(7, "a " * 500_000)], items)] == [(1, 60)]


def test_empty(spark):
    docs, items = cases()
    assert ours(spark, [], items) == [] and ours(spark, docs, []) == []
