"""URL rules: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is a host and the start of a path, written together (`example.org/en/1`). A page's candidate
keys are each suffix of its host with each start of its path that is as long as some rule's path.
Keys that the filter may hold go on to an equi-join with the rules, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare

#: 32 bytes each: at most 8 MB go to the executors. Longer lists only make more false positives, which the join removes.
MOST_BLOCKS = 1 << 18
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)


def host_of(url: Column) -> Column:
    """ASCII-lower-cased host; empty without `://` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its block, and one bit in each of the block's eight words."""
    h = hashes.view(np.uint64)
    bits = ((h[:, None] & np.uint64(0xFFFFFFFF)) * _SALTS[None, :] & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), np.uint32(1) << bits.astype(np.uint32)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bits = places(hashes, len(words))
    return (words[block] & bits == bits).all(axis=1)


def bloom(keys: DataFrame, hashes: Column | None = None) -> np.ndarray:
    """[blocks, 8] words of the filter of the column `key`, or of given hashes; parts are built where the keys are, and joined by bit_or."""
    blocks = min(MOST_BLOCKS, max(1, -(-keys.count() // 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, bits = places(np.asarray(b.column(0)).astype(np.int64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(bits[:, i].astype(np.int64)) for i in range(8))], names=["block", *(f"w{i}" for i in range(8))])

    parts = keys.select((F.xxhash64("key") if hashes is None else hashes).alias("h")).mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    out = np.zeros((blocks, 8), dtype=np.uint32)
    for r in parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toLocalIterator():
        out[r.block] = [r[i + 1] for i in range(8)]
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages, repeated and null ones too.

    rules: (rule, verdict), rule being a host and a path's start. The longest fitting rule wins, and of a
    repeated rule the smaller verdict (allow before block). A url that is null or has no `://` has
    an empty host and path, so that no rule fits. Pages without a rule get `default`.
    """
    prepare(pages.sparkSession)
    listed = rules.where(F.col("rule").isNotNull()).groupBy(F.col("rule").alias("key")).agg(F.min("verdict").alias("found"))
    words = pages.sparkSession.sparkContext.broadcast(bloom(listed))
    lengths = sorted(r[0] for r in listed.select(F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1))).distinct().collect())

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *kept, keys, hashes = b.columns
            hit = may_hold(words.value, np.asarray(hashes.flatten()).astype(np.int64))
            row = np.repeat(np.arange(len(keys)), np.asarray(keys.value_lengths()))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(keys)))])
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), keys.flatten().filter(pa.array(hit)))], names=["page_id", "url", "host", "path", "keys"])

    at = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))
    at = at.withColumn("keys", keys).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    at = at.mapInArrow(possible, "page_id long, url string, host string, path string, keys array<string>")
    some = F.size("keys") > 0
    # Verdicts depend on the url alone: each distinct one is joined once, so that copies of a url cost nothing here.
    fits = at.where(some).select("url", F.explode("keys").alias("key")).distinct().join(listed, "key")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), "key", "found")).alias("m")).select("url", F.col("m.key").alias("rule"), F.col("m.found").alias("found"))
    hit = at.where(some).join(best, "url", "left")
    rest = at.where(~some).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return hit.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict")).union(rest)
