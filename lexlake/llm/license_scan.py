"""Licence scan by a positional rare-token index.

Templates are short phrases and whole licence texts or notices. The document
frequencies of their words are counted over all files. A phrase is indexed under
its rarest words; a text under all its words with their positions. A file looks
up its own highest-IDF licence words only: a hit at file position p for template
position q votes for the start p - q. Where enough different words agree on a
start, the template is verified: its words must cover enough of it there, and
the mandatory key phrase must stand word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import short_batches, with_fields

#: Phrases whose places are reported, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further mandatory key phrases and their labels.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1": "bsl-1",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2": "apache-2",
}
#: Index words kept of a template, the rarest first.
INDEX_WORDS = 2

#: Fixed values: (label, mandatory key phrase, text) of whole licences and notices.
TEXTS = [
    ("mit", "permission is hereby granted free of charge", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", "redistribution and use in source and binary forms", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("apache-2", "licensed under the apache license version 2 0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("gpl-2", "either version 2 of the license", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details."""),
    ("gpl-3", "either version 3 of the license", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details."""),
    ("mpl", "mozilla public license", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "free and unencumbered software released into the public domain", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", "without any express or implied warranty", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
        it freely, subject to the following restrictions"""),
]
#: Highest-IDF words that a file and a text share and that the file looks up in the
#: texts' index, for each text that it can hold.
FILE_WORDS = 32
#: Different words of these that must agree on a start, within so many words.
LEAST_VOTES, SLACK = 8, 8
#: Share of a text's IDF that a file must hold in the text's place.
LEAST_COVER = 0.8

PLACES = "n_words long, places array<struct<start:bigint,end:bigint,label:string,base:boolean>>, score double"

#: A-Z to a-z; every other ASCII byte that is no digit or letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool
    anchors: tuple[int, ...] = ()


def templates(idf: dict[bytes, float] | None = None) -> list[Template]:
    """The phrases with the positions of their INDEX_WORDS rarest words."""
    out = []
    for phrases, base in ((BASE_PHRASES, True), (MORE_PHRASES, False)):
        for phrase, label in phrases.items():
            words = tuple(phrase.encode().split())
            ranked = sorted(range(len(words)), key=lambda i: (-(idf or {}).get(words[i], math.inf), i))
            out.append(Template(words, label, base, tuple(ranked[:INDEX_WORDS])))
    return out


@dataclass
class Licence:
    words: list[bytes]
    label: str
    key: list[bytes]
    weights: dict[bytes, float]


class TextIndex:
    """Words of the texts with their positions: word → (template, position) arrays."""

    def __init__(self, idf: dict[bytes, float]) -> None:
        self.idf, self.licences, held = idf, [], defaultdict(list)
        for label, key, text in TEXTS:
            words = words_of(text)
            weights: dict[bytes, float] = defaultdict(float)
            for q, w in enumerate(words):
                weights[w] += idf[w]
                held[w].append((len(self.licences), q))
            self.licences.append(Licence(words, label, words_of(key), dict(weights)))
        self.postings = {w: np.array(at, dtype=np.int64).T for w, at in held.items()}
        #: Word → its share of each text's IDF; what a file lacks of a text can't be covered.
        self.shares = {w: np.array([one.weights.get(w, 0.0) / max(sum(one.weights.values()), 1e-300) for one in self.licences]) for w in held}

    def starts(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) where enough of the rarest words of a text agree."""
        present = self.postings.keys() & set(words)
        if len(present) < LEAST_VOTES:
            return []
        # Rounding apart, a text whose words the file lacks can't be covered; most files end here.
        possible = np.sum([self.shares[w] for w in present], axis=0) >= LEAST_COVER - 1e-9
        if not possible.any():
            return []
        # Each text is looked up by its own rarest words, so that long ones leave room for short ones.
        by_rarity = sorted(present, key=lambda w: (-self.idf[w], w))
        asked = {t: [w for w in by_rarity if w in self.licences[t].weights][:FILE_WORDS] for t in np.flatnonzero(possible).tolist()}
        at: dict[bytes, list[int]] = {w: [] for mine in asked.values() for w in mine}
        for p, w in enumerate(words):
            if w in at:
                at[w].append(p)
        votes = []
        for t, mine in asked.items():
            for w in mine:
                template, q = self.postings[w]
                bucket = (np.array(at[w])[:, None] - q[None, template == t] + (1 << 20)) // SLACK  # starts may lie before the file
                votes.append(np.unique(bucket * len(self.licences) + t))
        bucket, n = np.unique(np.concatenate(votes), return_counts=True)
        # A start may be split between two neighbouring buckets.
        after = np.searchsorted(bucket, bucket + len(self.licences))
        follows = (after < len(bucket)) & (bucket[np.minimum(after, len(bucket) - 1)] == bucket + len(self.licences))
        both = n + np.where(follows, n[np.minimum(after, len(bucket) - 1)], 0)
        return [(int(b % len(self.licences)), int(b // len(self.licences)) * SLACK - (1 << 20)) for b in bucket[both >= LEAST_VOTES]]

    def covered(self, words: list[bytes], template: int, start: int) -> bool:
        """The text is there: enough of its weight, and its key phrase."""
        one = self.licences[template]
        window = words[max(0, start - SLACK) : max(0, start + len(one.words) + 2 * SLACK)]
        have, want = Counter(window), Counter(one.words)
        total = sum(one.weights.values())
        cover = sum(self.idf[w] * min(n, have[w]) for w, n in want.items())
        if cover < LEAST_COVER * total:
            return False
        return any(window[i : i + len(one.key)] == one.key for i in range(len(window) - len(one.key) + 1))

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of the texts in a file, each place once."""
        found: list[tuple[int, int, str]] = []
        for template, start in sorted(self.starts(words), key=lambda x: (x[0], x[1])):
            if self.covered(words, template, start):
                one = self.licences[template]
                place = (max(0, start), min(len(words), start + len(one.words)), one.label)
                if not (found and found[-1][2] == one.label and place[0] - found[-1][0] < len(one.words) // 2):
                    found.append(place)
        return sorted(found)


def licence_idf(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """IDF over all files of the templates' words: as many as these have.

    Rows are files: repeated ones and null or empty texts (without words) count in
    their number. In an empty table every word has IDF 0, as has one that all
    files hold.
    """
    vocabulary = {w for t in templates() for w in t.words} | {w for _, _, text in TEXTS for w in words_of(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    df[w] += 1
        yield pa.record_batch([pa.array(df.keys(), pa.binary()), pa.array(df.values(), pa.int64())], names=["word", "df"])

    n = docs.count()
    found = docs.select(text_col).mapInArrow(count, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {bytes(r["word"]): r["df"] for r in found}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def scan(words: list[bytes], known: list[Template], postings: dict[bytes, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(start, template) of every place where a template stands."""
    votes: dict[tuple[int, int], int] = defaultdict(int)
    for p in [i for i, w in enumerate(words) if w in postings]:
        for t, q in postings[words[p]]:
            if p >= q:
                votes[p - q, t] += 1
    return sorted((s, t) for (s, t), n in votes.items() if n == len(known[t].anchors) and tuple(words[s : s + len(known[t].words)]) == known[t].words)


def scan_licences(docs: DataFrame, idf: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (array of start, end, label, base in words),
    score (share of the file's licence-word IDF that its verified places cover).

    Null and empty texts have no words, no places and score 0. Places come by
    start, end, label; different templates may share a place, and each counts; a
    text counts once where several starts fit it, the first. Each row is scanned
    from its whole text alone; repeated rows repeat; an empty table stays empty;
    other columns are ignored.
    """
    short_batches(docs.sparkSession)
    known = templates(idf)
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for t, template in enumerate(known):
        for q in template.anchors:
            postings[template.words[q]].append((t, q))
    postings, index = dict(postings), TextIndex(idf)
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
    schema = with_fields(docs.select(id_col).schema, PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places, scores = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = [(start, start + len(known[t].words), known[t].label, known[t].base) for start, t in scan(words, known, postings)]
                found += [(*place, False) for place in index.places(words)]
                n.append(len(words))
                places.append([{"start": a, "end": b, "label": label, "base": base} for a, b, label, base in sorted(found)])
                covered = {i for a, b, _, _ in found for i in range(a, b)}
                rare = sum(idf[w] for w in words if w in idf) if found else 0.0
                scores.append(min(1.0, sum(idf[words[i]] for i in covered if words[i] in idf) / rare) if rare > 0 else float(bool(found)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(scores, pa.float64())], names=[id_col, "n_words", "places", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
