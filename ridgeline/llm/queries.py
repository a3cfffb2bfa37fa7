"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, hmm, language, licenses, packing, simhash, substrings, topk, toxicity, urls
from ridgeline.llm.common import prepare, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 3-word-shingle fingerprint and its group at 2 or fewer differing bits."""
    prepare(spark)
    found = simhash.groups(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which at least half the words lie under tiles."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    return language.predict(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 20-word windows."""
    found = substrings.dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# The rules of op7.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and hidden-Markov-model log likelihoods."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_topk": op3_topk,
    "op4_licenses": op4_licenses,
    "op5_language": op5_language,
    "op6_substrings": op6_substrings,
    "op7_urls": op7_urls,
    "op8_toxicity": op8_toxicity,
    "op9_hmm": op9_hmm,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op3_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.n AS q, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.n <> c.n
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    "op6_substrings": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), w AS (
            SELECT r, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
            FROM d, unnest(range(1, len(ws) - 18)) AS t(i)
            WHERE doc_id IS NOT NULL
        ), f AS (
            SELECT r, i, rank() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w
        ), g AS (
            SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM f WHERE n > 1
        ), t AS (
            SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
        ), k AS (
            SELECT t.r, count(g.p) AS gone, string_agg(t.word, ' ' ORDER BY t.p) FILTER (WHERE g.p IS NULL) AS kept
            FROM t LEFT JOIN g ON t.r = g.r AND t.p = g.p GROUP BY t.r
        )
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r)
    """,
    "op7_urls": """
        WITH rules(rule, verdict) AS (
            VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
        ), r AS (
            SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM rules
        ), u AS (
            SELECT row_number() OVER () AS n, page_id, url,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), a AS (
            SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), b AS (
            SELECT a.n, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
            FROM a JOIN r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p)
            GROUP BY a.n
        )
        SELECT a.page_id, a.host, a.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM a LEFT JOIN b USING (n)
    """,
}
