import math
import random
import re

import pytest

from ridgeline.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int"


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def ours(spark, rows):
    return licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()


def test_base_and_notices(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "CC-BY cc by CC  BY-NC 4.0"), (4, None), (5, ""), (6, "mit der license mit license-mit LICENSE"), (None, "MIT License"), (7, "MIT License"), (7, "MIT License"),
        (8, "cc byé ccé by apache\u00a0license apache\x7flicense"), (9, "w " * 50000 + "Licensed under CC BY-NC 4.0."), (10, "nothing of the kind, version 3"), (11, "This work is licensed under the gnu lesser general public license, version 3"),
    ]
    got = {(r.doc_id, i): r for i, r in enumerate(ours(spark, rows))}
    assert len(got) == len(rows)
    for (doc, i), r in got.items():
        assert doc == rows[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(rows[i][1]), rows[i]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = [r.labels.split(",") for r in ours(spark, rows)]
    assert "apache-2.0" in labels[0] and "gpl-3.0" in labels[1] and labels[3] == [""] and "cc-by-nc-4.0" in labels[10] and labels[11] == [""] and "lgpl-3.0" in labels[12]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(d.text)


def test_empty(spark):
    assert ours(spark, []) == []


def every_start(texts, df_of):
    """Labels and scores by trying each template at each start of each text."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    out = []
    for text, words in zip(texts, split):
        labels, best = set(filter(None, base(text)[4].split(","))), 1.0 if base(text)[1] else 0.0
        for label, (template, phrases) in licenses.TEMPLATES.items():
            t = template.split()
            weight = [math.log((1 + len(texts)) / (1 + df_of(w))) + 1 for w in t]
            for start in range(-len(t), len(words) + 1):
                span = words[max(0, start - 2) : max(0, start + len(t) + 2)]
                if all(any(span[i : i + len(p.split())] == p.split() for i in range(len(span))) for p in phrases):
                    share = sum(x for i, (w, x) in enumerate(zip(t, weight)) if w in words[max(0, start + i - 2) : max(0, start + i + 3)]) / sum(weight)
                    if share >= 0.7:
                        labels.add(label)
                        best = max(best, share)
        out.append((",".join(sorted(labels)), round(min(1.0, best), 9)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_template_at_every_start(spark, seed):
    rng = random.Random(seed)
    texts = ["", "mit license", "license " * 300 + "version 2 0 apache"]
    for template, _ in licenses.TEMPLATES.values():
        for damage in (0.0, 0.05, 0.15, 0.3, 0.4):
            t = [w if rng.random() >= damage else rng.choice(["zebra", "the", "license", ""]) for w in template.split()]
            at = rng.randrange(len(t))
            t[at:at] = ["word"] * rng.randrange(4)
            filler = [rng.choice(["software", "of", "copy", "zebra", "alpha", "permission", "gnu"]) for _ in range(rng.randrange(30))]
            texts.append(" ".join(filler + t * rng.randrange(1, 3) + filler[::-1]))
    words = [set(re.findall(r"[a-z0-9]+", t.lower())) for t in texts]
    want = every_start(texts, lambda w: sum(w in x for x in words))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in ours(spark, list(enumerate(texts)))}
    assert [got[i] for i in range(len(texts))] == want
    assert len({label for labels, _ in want for label in labels.split(",")}) > len(licenses.TEMPLATES)


def test_very_long_texts(spark):
    text = "license version 2 gnu " * 100_000
    (r,) = ours(spark, [(1, text)])
    assert r.n_words == 400_000 and r.n_base == 0
