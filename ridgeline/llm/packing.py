"""Best-fit packing of tokenized documents by hierarchical residual packing.

Tasks pack their own pieces by best fit, emit bins that are nearly full, and pass underfull bins on
as items of their own. Rounds of merging tasks pack these again, each task a bounded number, until
one task holds what is left. A bin is one row that carries its pieces, so it moves and is lost and
recomputed as a whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from struct import iter_unpack, pack as packed

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm.common import checkpoint, prepare

LENGTH, END = 1024, 2
#: White space at a stretch that the fast encoder's backtracking expression still takes, by far; beyond, the file's own library encodes the text.
STRETCH = 10_000
#: Tokens that may be left over in a bin that is emitted early; pieces packed at once; bins in one merging task.
NEARLY, BUFFER, MERGE = 8, 20_000, 50_000
#: doc_id is there; doc_id, piece, start, length, crc32 of the ids.
_MEMBER = "<?qiqiI"


class Encoder:
    """Ids of the tokenizer file at `path` (byte-level BPE), as little-endian 32-bit words, no special tokens added.

    The file's vocabulary, whose ids are its merge ranks, drives a faster encoder of the same ids. Texts in
    which a special token is spelled out go to the file's own library, which gives that token's id, and so do
    texts with STRETCH white-space characters at a stretch.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special, self.whole = tuple(special), Tokenizer.from_file(path)
        self.blank = re.compile(rf"\s{{{STRETCH}}}")
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) >= STRETCH and self.blank.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()


def pieces_of(length: int, most: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than `most`."""
    first = (length - 1) % most + 1
    return [(0, first), *((s, most) for s in range(first, length, most))]


class Packer:
    """Best fit of items (size, members), kept by residual; the residuals in use are the bits of one integer."""

    def __init__(self, most: int):
        self.most, self.open, self.used = most, [[] for _ in range(most + 1)], 0

    def _put(self, room: int, members: list[bytes]) -> None:
        self.open[room].append(members)
        self.used |= 1 << room

    def add(self, items: list[tuple[int, list[bytes]]]) -> None:
        """Largest first, each to the fullest bin that has room."""
        for size, members in sorted(items, key=lambda x: (-x[0], x[1])):
            if fits := self.used >> size:
                room = size + (fits & -fits).bit_length() - 1
                found = self.open[room].pop()
                if not self.open[room]:
                    self.used ^= 1 << room
                found += members
                self._put(room - size, found)
            else:
                self._put(self.most - size, list(members))

    def take(self, left: int) -> Iterator[tuple[int, list[bytes]]]:
        """Removes the bins with at most `left` tokens of room: (size, members)."""
        for room in range(left + 1):
            for members in self.open[room]:
                yield self.most - room, members
            self.open[room] = []
            self.used &= ~(1 << room)


_BIN = "done boolean, sequence_id long, size int, members binary"


def _bins(found: list[tuple[bool, int, list[bytes]]], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.bool_()), pa.array(range(first, first + len(found)), pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([b"".join(f[2]) for f in found], pa.binary())],
        names=["done", "sequence_id", "size", "members"],
    )


def _packed(most: int, turn: int, close: bool, items: Iterator[list[tuple[int, list[bytes]]]]) -> Iterator[pa.RecordBatch]:
    """Packs lists of items; nearly full bins go out as done, the others at the end (as done if close)."""
    packer, number = Packer(most), turn << 58 | TaskContext.get().partitionId() << 34
    for some in items:
        packer.add(some)
        out = [(True, size, members) for size, members in packer.take(NEARLY if not close else 0)]
        yield _bins(out, number)
        number += len(out)
    out = [(close or size >= most - NEARLY, size, members) for size, members in packer.take(most)]
    yield _bins(out, number)


def pack(docs: DataFrame, tokenizer: str, most: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A document is its ids and `end`; a null text is empty, so it is `end` alone. Null doc_ids and
    repeated rows are documents like any other. Ties of size are settled by the pieces' own bytes. An empty table gives no pieces.

    Bins that cannot be merged any further (a round leaves over nine tenths of them) are closed
    as they are; each merging task has seen an even share of all sizes by then.
    """
    prepare(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(tokenizer), array("I", [end]).tobytes()

        def items() -> Iterator[list[tuple[int, list[bytes]]]]:
            held: list[tuple[int, list[bytes]]] = []
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + last
                    for k, (start, n) in enumerate(pieces_of(len(ids) // 4, most)):
                        held.append((n, [packed(_MEMBER, doc is not None, doc or 0, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))]))
                    if len(held) >= BUFFER:
                        yield held
                        held = []
            yield held

        yield from _packed(most, 0, False, items())

    def merged(turn: int, close: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(size, [m]) for b in batches for size, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield from _packed(most, turn, close, iter([held]))

        return run

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                offset = 0
                for there, doc, piece, start, n, crc in iter_unpack(_MEMBER, members):
                    out.append((doc if there else None, piece, start, n, crc, number, offset))
                    offset += n
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    bins = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, _BIN))
    done, turn = bins.where("done"), 0
    under = bins.where("not done")
    left = under.count()
    while left:
        turn += 1
        tasks = -(-left // MERGE)
        now = checkpoint(under.select("size", "members").repartition(tasks).mapInArrow(merged(turn, tasks == 1), _BIN))
        done, under = done.union(now.where("done")), now.where("not done")
        before, left = left, under.count()
        if left > 0.9 * before:
            done, left = done.union(under), 0
    return done.select("sequence_id", "members").mapInArrow(opened, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
