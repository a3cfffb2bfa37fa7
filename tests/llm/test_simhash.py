import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import simhash

SCHEMA = "doc_id long, text string"


def brute(rows):
    def fp(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    prints = [fp(t) for _, t in rows]
    low = list(range(len(rows)))
    changed = True
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    members = {}
    for i, c in enumerate(low):
        members.setdefault(c, []).append(rows[i][0])
    least = {c: min((x for x in m if x is not None), default=None) for c, m in members.items()}
    return sorted(((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, low)), key=str)


def ours(spark, rows, schema=SCHEMA):
    found = simhash.groups(spark.createDataFrame(rows, schema)).select("doc_id", simhash.hex_of("fp").alias("f"), "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def test_edges(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (3, " ".join(words)), (9, " ".join([*words[:150], "x", *words[151:]])), (8, " ".join([*words[:299], "y"])), (1, None), (2, ""), (4, "One"), (6, "one"), (7, "a\x0bb"), (10, "a b"), (11, "a b"), (None, "one"), (12, "ÀÉ x y z"), (13, "àé x y z"), (14, "z " * 20000)]
    assert ours(spark, rows) == brute(rows)


def test_empty(spark):
    assert ours(spark, []) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ours(spark, rows) == brute(rows)


def clusters():
    import random

    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(20):
            prints.append(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    # A dense ball, which pivots hardly tell apart.
    prints += [prints[0] ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(7) for j in range(i) for k in range(j)]
    return sorted(set(prints))


def check_links(spark, prints, radius):
    from ridgeline.llm.common import connected_components

    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), radius)
    got = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in connected_components(found).collect()}
    want = {p: {p} for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius and want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    for a, b in itertools.combinations(prints, 2):
        assert (want[a] is want[b]) == (got.get(a, a) == got.get(b, b))


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_one_cell(spark, radius):
    check_links(spark, clusters(), radius)


def test_full_cells_are_cut_by_further_pivots(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 60)
    check_links(spark, clusters(), 2)


def test_full_cells_after_the_last_pivot_go_by_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(simhash, "PIVOTS", simhash.PIVOTS[:4])
    check_links(spark, clusters(), 2)


@pytest.mark.parametrize("radius", [2, 3])
def test_cells_that_no_pivot_cuts_go_by_pairs_of_blocks(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "COMPARED", 16)
    monkeypatch.setattr(simhash, "PIVOTS", simhash.PIVOTS[:4])
    kept, keep = [], simhash.checkpoint
    monkeypatch.setattr(simhash, "checkpoint", lambda df: kept.append(keep(df)) or kept[-1])
    check_links(spark, clusters(), radius)
    assert kept[0].where("b IS NULL").count() > 100


def test_coordinates_bound_the_distance():
    x = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    far = simhash.coordinates(x.view(np.int64)).astype(int)
    assert far.tolist() == [[(int(a) ^ int(p)).bit_count() for p in simhash.PIVOTS] for a in x]
    assert {(int(a) ^ int(b)).bit_count() for a, b in itertools.combinations(simhash.PIVOTS, 2)} == {32}
    for i, j in itertools.combinations(range(50), 2):
        assert abs(far[i] - far[j]).max() <= (int(x[i]) ^ int(x[j])).bit_count()


def test_extra_columns(spark):
    rows = [(1, "a b c d", "x", 5), (2, "a b c d", "y", 6)]
    assert [r[2] for r in ours(spark, rows, "doc_id long, text string, fp string, component_id int")] == [1, 1]


def test_rows_dealt_follow_the_fingerprints(spark, monkeypatch):
    dealt, keep = [], simhash.packed_checkpoint
    monkeypatch.setattr(simhash, "packed_checkpoint", lambda df: dealt.append(keep(df)) or dealt[-1])
    for n in (8_000, 40_000):
        dealt.clear()
        prints = np.random.default_rng(n).integers(-(2**63), 2**63, n, dtype=np.int64)
        simhash.links(spark.createDataFrame([(int(p),) for p in prints], "fp long"), 2)
        assert sum(df.count() for df in dealt) <= 4 * n


@pytest.mark.parametrize("radius", [2, 3])
def test_rows_dealt_grow_with_the_table(spark, monkeypatch, radius):
    """Cells that pass a bound at some size of the table must not be dealt again and again."""
    dealt, keep = [], simhash.packed_checkpoint
    monkeypatch.setattr(simhash, "packed_checkpoint", lambda df: dealt.append(keep(df)) or dealt[-1])
    rows = []
    for n in (30_000, 150_000):
        dealt.clear()
        simhash.links(spark.range(n).select(F.xxhash64("id").alias("fp")), radius)
        rows.append(sum(df.count() for df in dealt))
    assert rows[1] <= 5.5 * rows[0] and rows[1] <= 5 * 150_000, rows


def test_a_dense_ball_is_no_more_rows_after_cuts(monkeypatch):
    """Cuts that leave a ball in both halves are skipped: its pairs are compared once, not once for each cell."""
    ball = np.unique(np.array([0x9A3C5571E2B4D6F8 ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], dtype=np.uint64))
    far, seen, compare = simhash.coordinates(ball.view(np.int64)), [], simhash.cell_links
    monkeypatch.setattr(simhash, "cell_links", lambda cell, *rest: seen.append(len(cell)) or compare(cell, *rest))
    found = [np.column_stack(x) for x in simhash.task_links(np.zeros(len(ball), dtype=np.uint64), ball.view(np.int64), far, 3, range(23))]
    a, b = np.concatenate(found).T
    assert len(simhash.spanning(a, b, np.bitwise_count(a ^ b))) == len(ball) - 1
    assert sum(seen) <= 60 * len(ball), sum(seen) / len(ball)


def test_cells_are_cut_in_a_task(monkeypatch):
    prints = np.array(clusters(), dtype=np.uint64)
    found = []
    for leaf in (simhash.LEAF, 30, 5):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        far = simhash.coordinates(prints.view(np.int64))
        links = [np.column_stack(x) for x in simhash.task_links(np.zeros(len(prints), dtype=np.uint64), prints.view(np.int64), far, 2, range(23))]
        a, b = np.concatenate(links).T
        assert (np.bitwise_count(a ^ b) <= 2).all()
        kept = simhash.spanning(a, b, np.bitwise_count(a ^ b))
        found.append((len(kept), int(np.bitwise_count(a ^ b)[kept].sum())))
    assert len(set(found)) == 1


def test_a_large_graph_is_walked_by_stars(spark, monkeypatch):
    from ridgeline.llm import common

    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))], "a long, b long")
    one = sorted(map(tuple, common.connected_components(edges).collect()))
    monkeypatch.setattr(common, "FEW", 0)
    assert one == sorted(map(tuple, common.connected_components(edges).collect()))


def test_few_links_are_walked_in_few_jobs(spark):
    from ridgeline.llm.common import connected_components

    context = spark.sparkContext
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    context.setJobGroup("walk", "a long path")
    try:
        assert {r.component for r in connected_components(path).collect()} == {0}
        assert len(context.statusTracker().getJobIdsForGroup("walk")) <= 12
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
