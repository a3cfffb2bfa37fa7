"""License scans by a positional index of licence templates.

The index has, for each word of the templates, its postings: template and position. Of a file's words that a
template has too, the ones of highest IDF (over the whole corpus) are looked up, just so many that an
occurrence of the template must have two of them in place. Each occurrence of such a word proposes a start; starts
on which two words agree, give or take words put in or left out, are intersected, aligned, and scored by
the share of the template's IDF mass in place. A label counts only if its mandatory key phrases stand there too.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public wording of licences and of the notices they ask for, as words, with mandatory phrases, by label.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU_NOTICE = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
)
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS + " "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted", "free of charge", "without restriction"],
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["with or without fee", "hereby granted"],
    ),
    "bsd-2-text": (_BSD_TERMS + " " + _BSD_END, ["source and binary forms", "retain the above copyright notice"]),
    "bsd-3-text": (
        _BSD_TERMS + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END,
        ["source and binary forms", "endorse or promote products"],
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ["must not be misrepresented", "altered source versions"],
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software", "public domain"],
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["apache license", "in compliance with the license"],
    ),
    "gpl-2.0-header": (_GNU_NOTICE.format("general public license", 2), ["gnu general public license", "version 2 of the license"]),
    "gpl-3.0-header": (_GNU_NOTICE.format("general public license", 3), ["gnu general public license", "version 3 of the license"]),
    "lgpl-2.1-header": (_GNU_NOTICE.format("lesser general public license", "2 1"), ["gnu lesser general public license", "version 2 1 of the license"]),
    "agpl-3.0-header": (_GNU_NOTICE.format("affero general public license", 3), ["gnu affero general public license", "version 3 of the license"]),
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ["mozilla public license", "2 0"],
    ),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    "lgpl-3.0": ("this work is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    "agpl-3.0": ("this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license", "version 3"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0", ["cc0 1 0"]),
}

#: Words that must agree on a start, the shift that words put in or left out may cause, the least score.
AGREE, SHIFT, LEAST = 2, 2, 0.7

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII; null: none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _phrases(words: list[bytes], phrase: list[bytes], at: list[int]) -> list[int]:
    return [i for i in at if words[i : i + len(phrase)] == phrase]


class Template:
    """A template's words, their postings by word, its IDF mass and mandatory phrases."""

    def __init__(self, label: str, text: str, phrases: list[str], idf):
        self.label, self.words, self.phrases = label, text.encode().split(), [p.encode().split() for p in phrases]
        self.weight = {w: idf(w) for w in set(self.words)}
        self.mass = sum(self.weight[w] for w in self.words)
        self.postings: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.postings[w].append(i)
        self.must = {w for p in self.phrases for w in p}
        self.anchor = max(self.must, key=lambda w: (idf(w), w))

    def highest(self, there: set[bytes]) -> tuple[list[bytes], int]:
        """The words of highest IDF of the template that a text has, and how many of them any start of score LEAST has in place.

        What a start lacks is at most 1 - LEAST of the mass; so of chosen words whose mass is more than that
        even without the AGREE - 1 heaviest, AGREE are in place. If all the text's words do not come to that, it is one, or
        there is no such start.
        """
        chosen, masses = [], []
        for w in sorted(there & self.weight.keys(), key=lambda w: (-self.weight[w], w)):
            chosen.append(w)
            masses.append(self.weight[w] * len(self.postings[w]))
            if sum(sorted(masses)[: 1 - AGREE]) > (1 - LEAST) * self.mass * (1 + 1e-9):
                return chosen, AGREE
        return (chosen, 1) if sum(masses) >= LEAST * self.mass * (1 - 1e-9) else ([], 1)

    def starts(self, at: dict[bytes, list[int]], chosen: list[bytes], agree: int) -> list[int]:
        """Starts at which so many chosen words have an occurrence in place, give or take SHIFT."""
        shifts = np.arange(-SHIFT, SHIFT + 1)
        each = [np.unique((np.array(at[w])[:, None, None] - np.array(self.postings[w])[None, :, None] + shifts).ravel()) for w in chosen]
        start, n = np.unique(np.concatenate(each or [shifts[:0]]), return_counts=True)
        return start[n >= agree].tolist()

    def share(self, words: list[bytes], start: int) -> float:
        """The share of the mass that stands in place from there on, 0 without all mandatory phrases."""
        span = words[max(0, start - SHIFT) : max(0, start + len(self.words) + SHIFT)]
        if not all(_phrases(span, p, range(len(span))) for p in self.phrases):
            return 0.0
        return sum(self.weight[w] for i, w in enumerate(self.words) if w in words[max(0, start + i - SHIFT) : max(0, start + i + SHIFT + 1)]) / self.mass


class Index:
    def __init__(self, df: dict[bytes, int], docs: int, templates: dict, base: dict):
        idf = lambda w: math.log((1 + docs) / (1 + df.get(w, 0))) + 1
        self.base = [(label, p.encode().split()) for p, label in base.items()]
        self.templates = [Template(label, text, phrases, idf) for label, (text, phrases) in templates.items()]
        self.keys = frozenset({t.anchor for t in self.templates} | {p[0] for _, p in self.base})

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        if self.keys.isdisjoint(words):
            return 0, None, None, [], [], 0.0
        there = set(words)
        candidates = [(t, *t.highest(there)) for t in self.templates if t.must <= there]
        needed = {w for _, chosen, _ in candidates for w in chosen} | {p[0] for _, p in self.base}
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in needed:
                at[w].append(i)
        starts, base, labels, score = [], set(), set(), 0.0
        for label, phrase in self.base:
            if found := _phrases(words, phrase, at.get(phrase[0], [])):
                starts += found
                base.add(label)
                score = 1.0
        for t, chosen, agree in candidates:
            share = max((t.share(words, s) for s in t.starts(at, chosen, agree)), default=0.0)
            if share >= LEAST:
                labels.add(t.label)
                score = max(score, share)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | labels), min(1.0, score)


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many texts of the whole corpus each word of the (fixed, short) vocabulary stands; the number of texts."""
    words = sorted(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, dict.fromkeys(words, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in words), None], pa.string()), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in found}
    return {w.encode(): n for w, n in df.items() if w is not None}, df.get(None, 0)


def scan(docs: DataFrame, templates: dict = TEMPLATES, base: dict = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    score is the highest share of a template's IDF mass found in place among the accepted labels (SHIFT words
    more or less before it are no matter), 1 where a base phrase stands, else 0. Null and empty texts have no words and no labels; null doc_ids and
    repeated rows are scanned like any other; an empty table gives none.
    """
    prepare(docs.sparkSession)
    vocabulary = {w for t, _ in templates.values() for w in t.encode().split()}
    df, n = frequencies(docs, vocabulary)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, templates, base)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                count, first, last, some, labels, score = index.scan(words)
                out.append((len(words), count, first, last, ",".join(some), ",".join(labels), score))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
