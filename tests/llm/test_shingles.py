import itertools
import random

import corpus_pipeline as cp
import numpy as np
import pytest
from ridgeline.llm import shingles, simhash

from tests.llm.test_pipeline import frame, made


def sets_of(rows, width=5):
    out = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(rows):
    """The least doc_id of each row's group."""
    sets = sets_of(rows)
    low = list(range(len(rows)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            low[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def ours(spark, rows):
    return sorted(((r.doc_id, r.component_id) for r in shingles.groups(frame(spark, rows).repartition(3), 5).collect()), key=str)


def near(rng, words, base, edits):
    out = list(base)
    for at in rng.sample(range(len(base)), edits):
        out[at] = words(1)[0]
    return out


def test_pairs_at_the_threshold_all_meet(spark):
    rng, words, rows = random.Random(7), made(7), []
    for g in range(150):
        base = words(150)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near(rng, words, base, rng.choice((2, 3, 4)))))]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "One"), (903, "one"), (904, "one two"), (1, rows[1][1])]
    want = brute(rows)
    assert len({c for _, c in want}) < len(rows) - 60
    assert ours(spark, rows) == want


@pytest.mark.parametrize("block", [1024, 4])
def test_full_buckets_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng, words = random.Random(8), made(8)
    base = words(120)
    rows = [(i, " ".join(near(rng, words, base, rng.choice((1, 2, 3, 4))))) for i in range(90)]
    line = words(12)
    rows += [(200 + i, " ".join(line + words(6))) for i in range(40)]
    rng.shuffle(rows)
    assert ours(spark, rows) == brute(rows)


def test_empty(spark):
    assert ours(spark, []) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    assert ours(spark, rows) == brute(rows)
    kept = cp.near_dedup(spark, frame(spark, rows), "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c in brute(rows)}


def test_a_repeated_line_makes_no_duplicate(spark):
    words = made(9)
    line = words(8)
    rows = [(i, " ".join(line * 40 + words(60))) for i in range(4)]
    assert [r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").orderBy("doc_id").collect()] == [0, 1, 2, 3]


def test_groups_joined_by_more_links(spark):
    rng = np.random.default_rng(4)
    parts = [[(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2))] for n in (25, 0, 12, 9)]
    of, every = None, []
    for part in parts:
        every += part
        of = shingles.joined(of, spark.createDataFrame(part, "a long, b long"))
        of_node = {x: x for e in every for x in e}
        for _ in range(60):
            for a, b in every:
                of_node[a] = of_node[b] = min(of_node[a], of_node[b])
        linked = {x for a, b in every if a != b for x in (a, b)}
        got = [tuple(r) for r in of.collect()]
        assert len(got) == len(dict(got)) and dict(got) == {x: of_node[x] for x in linked}


def test_fingerprints_join_near_copies(spark, monkeypatch):
    """Without any bucket of shingles, pairs of at most 3 bits and similarity 0.8 are still found, by their fingerprints."""

    def no_buckets(batches):
        for _ in batches:
            pass
        return iter(())

    monkeypatch.setattr(shingles, "_buckets", no_buckets)
    rng, words, rows = random.Random(11), made(11), []
    for g in range(40):
        base = words(600)
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(near(rng, words, base, 1))), (3 * g + 2, " ".join(near(rng, words, base, 60)))]
    sets = [shingles.shingle_set(t, 5) for _, t in rows]
    prints = [simhash.majority_bits(s) for s in sets]
    low = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and shingles.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
            low = [low[a] if x == low[b] else x for x in low]
    want = {d: min(e for (e, _), y in zip(rows, low, strict=True) if y == x) for (d, _), x in zip(rows, low, strict=True)}
    assert 80 <= len(set(want.values())) < 100
    assert dict(ours(spark, rows)) == want


def test_pairs_of_a_full_bucket_follow_its_nodes(spark, monkeypatch):
    rng, words = random.Random(12), made(12)
    base = words(150)
    rows = [(i, " ".join(near(rng, words, base, rng.choice((1, 2, 3, 4))))) for i in range(400)]
    asked, verify = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *rest: asked.append(pairs.distinct().count()) or verify(pairs, *rest))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    assert ours(spark, rows) == brute(rows)
    assert len(asked) >= 1 and sum(asked) <= 12 * len(rows), asked
    print("jobs", len(tracker.getJobIdsForGroup()) - before)


@pytest.mark.parametrize("dealt, held", [(shingles.BLOCK * 8, 1 << 20), (16, 8)])
def test_a_pair_of_many_buckets_is_named_and_verified_once(spark, monkeypatch, dealt, held):
    """Long texts of similarity about 0.7 share scores of full buckets: their pairs must not come once for each of these."""
    monkeypatch.setattr(shingles, "DEALT", dealt, raising=False)
    monkeypatch.setattr(shingles, "HELD", held, raising=False)
    rng, words, rows = random.Random(13), made(13), []
    for g in range(3):
        base = words(400)
        rows += [(20 * g + i, " ".join(near(rng, words, base, rng.choice((5, 6, 7))))) for i in range(14)]
    named, asked = spark.sparkContext.accumulator(0), []
    blocks, verify = shingles._blocks, shingles.verified

    def counted(part):
        run = blocks(part)

        def each(batches):
            for b in run(batches):
                named.add(b.num_rows)
                yield b

        return each

    monkeypatch.setattr(shingles, "_blocks", counted)
    monkeypatch.setattr(shingles, "verified", lambda pairs, *rest: asked.append({tuple(r) for r in pairs.collect()}) or verify(pairs, *rest))
    assert ours(spark, rows) == brute(rows)
    every = set().union(*asked)
    assert len(every) > 200 and sum(map(len, asked)) == len(every)
    if held > len(every):
        assert named.value <= 8 * len(every), (named.value, len(every))
