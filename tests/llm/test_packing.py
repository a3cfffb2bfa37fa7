import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def verify(rows, found, waste):
    own = Tokenizer.from_file(PATH)
    want, total = defaultdict(int), 0
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            want[doc, k, start, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(places) <= waste * -(-total // 1024) + 1


def ours(spark, rows):
    return packing.pack(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, members string"), PATH).collect()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x <|endoftext|> y"), (5, "word " * 5000), (6, " lead\n\n  two  spaces \n x\t y's '  's é z "), (7, "tok " * 1023), (8, "tok " * 1022), (9, "日本語 🙂" * 300)]
    verify(rows, ours(spark, rows), 1.5)
    assert ours(spark, []) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    verify(rows, packing.pack(docs.repartition(3), PATH).collect(), 1.02)


@pytest.mark.parametrize("long", [False, True])
def test_rounds(spark, monkeypatch, long):
    monkeypatch.setattr(packing, "MERGE", 20)
    rng = random.Random(1)
    rows = [(i, "tok " * (700 if long else rng.randrange(1, 900))) for i in range(300)]
    verify(rows, ours(spark, rows), 1.5 if long else 1.12)


def test_best_fit():
    p = packing.Packer(10)
    p.add([(6, [b"a"]), (5, [b"b"]), (4, [b"c"]), (5, [b"d"]), (3, [b"e"])])
    assert sorted(size for size, _ in p.take(10)) == [3, 10, 10]


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \n\t\r", "\u3000", "a", "日", "!", "1 ", "a\n\n"])
def test_long_runs(spark, unit):
    encode, own = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for n in (packing.STRETCH - 1, packing.STRETCH, 200_000):
        for text in (unit * (n // len(unit)), "x" + unit * (n // len(unit)) + "y"):
            assert list(array("I", encode(text))) == own.encode(text, add_special_tokens=False).ids


def test_long_runs_through_the_operator(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 300_000 + "end"), (3, "plain words")]
    verify(rows, ours(spark, rows), 1.5)
