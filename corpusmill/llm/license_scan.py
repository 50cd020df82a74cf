"""License scans by a positional index of rare words.

The index covers a fixed collection of templates. A word's IDF is taken over the collection;
for each template the index keeps the positions of its words of highest IDF. Of a file, only
words that the index knows are looked up, the rarest first: each occurrence of one at position
i, with a posting at position j of a template, puts the template at i - j, and the places that
remain when the places of all of a template's rare words are intersected are candidates. At a
candidate the template's key phrase is compared word by word; without it there is no match.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.arrow import map_texts
from corpusmill.sources.tables import read_table


class Template(NamedTuple):
    """Words whose presence means ``label``: all of ``key``, and ``share`` by weight of ``text``, which holds it."""

    label: str
    key: str
    text: str = ""
    base: bool = False
    share: float = 0.5


#: The words of public licence texts and notices, as ``words`` gives them.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
BSD_LAST = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
BSD_NAMES = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
LESSER = """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation
either version 2 1 of the license or at your option any later version"""
AFFERO = """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation
either version 3 of the license or at your option any later version"""
MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""
BOOST = """distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
the origin of this software must not be misrepresented you must not claim that you wrote the original software
altered source versions must be plainly marked as such and must not be misrepresented as being the original software
this notice may not be removed or altered from any source distribution"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""

RESERVED = """copyright all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"""

TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge", MIT),
    Template("isc", "permission to use copy modify and or distribute this software", ISC),
    Template("bsd", "redistribution and use in source and binary forms", BSD),
    Template("bsd", "neither the name of the copyright holder", BSD_NAMES),
    Template("bsd", "provided by the copyright holders and contributors as is", BSD_LAST),
    Template("apache-2", "you may not use this file except in compliance with the license", APACHE),
    Template("gpl", "under the terms of the gnu general public license", GPL),
    Template("lgpl", "under the terms of the gnu lesser general public license", LESSER),
    Template("agpl", "under the terms of the gnu affero general public license", AFFERO),
    Template("mpl", "subject to the terms of the mozilla public license", MPL),
    Template("boost", "under the boost software license", BOOST),
    Template("zlib", "permission is granted to anyone to use this software for any purpose", ZLIB),
    Template("unlicense", "unencumbered software released into the public domain", UNLICENSE),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("boost", "boost software license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc0", "creative commons zero"),
    Template("proprietary", "all rights reserved", RESERVED),
)

#: Words that, up to two words before a phrase that stands alone, take its meaning back.
DENIED = frozenset((b"no", b"non", b"not", b"without"))

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (A-Z lower-cased) and all characters from U+0080 on."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Entry(NamedTuple):
    template: Template
    text: list[bytes]
    key: list[bytes]
    at: int  # where the key phrase stands in the text
    rare: list[tuple[bytes, int]]  # words of the key phrase of highest IDF, and where they stand in the text
    weights: list[float]  # IDF by position of the text


class Index:
    """Postings of the rare words of ``templates``; ``rare`` words of each key phrase are looked up."""

    def __init__(self, templates: Iterable[Template], rare: int = 3):
        whole = [(t, words(t.text or t.key), words(t.key)) for t in templates]
        df = Counter(w for _, text, _ in whole for w in set(text))
        idf = {w: math.log(1 + len(whole) / n) for w, n in df.items()}
        self.entries, self.postings = [], defaultdict(list)
        for n, (t, text, key) in enumerate(whole):
            at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            order = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[:rare]
            found = [(key[i], at + i) for i in order]
            self.entries.append(_Entry(t, text, key, at, found, [idf[w] for w in text]))
            for w, j in found:
                self.postings[w].append((n, j))
        self.idf = {w: idf[w] for w in self.postings}
        self.known = frozenset(self.postings)

    def places(self, file: list[bytes]) -> list[tuple[int, int]]:
        """(template, start of its key phrase) of each candidate whose key phrase is verified."""
        known = self.known.intersection(file)
        if not known:
            return []
        where = defaultdict(list)
        for i, w in enumerate(file):
            if w in known:
                where[w].append(i)
        met: dict[int, set[int]] = {}
        seen: Counter = Counter()
        for w in sorted(known, key=lambda w: (-self.idf[w], w)):
            for n, j in self.postings[w]:
                here = {i - j for i in where[w]}
                met[n] = here if n not in met else met[n] & here
                seen[n] += 1
        out = []
        for n, starts in met.items():
            e = self.entries[n]
            if seen[n] == len(e.rare):
                out += [(n, s + e.at) for s in sorted(starts) if s + e.at >= 0 and file[s + e.at : s + e.at + len(e.key)] == e.key]
        return out

    def share(self, n: int, start: int, file: list[bytes], slack: int = 2) -> float:
        """The part, by IDF, of the template's words that stand in ``file`` within ``slack`` of their place."""
        e = self.entries[n]
        first, got = start - e.at, 0.0
        for j, w in enumerate(e.text):
            i = first + j
            if w in file[max(0, i - slack) : max(0, i + slack + 1)]:
                got += e.weights[j]
        return got / sum(e.weights)


@lru_cache(maxsize=4)
def _index(templates: tuple[Template, ...], rare: int) -> Index:
    return Index(templates, rare)


def scan(texts: Iterable[str | None], templates: tuple[Template, ...], rare: int) -> dict[str, list]:
    """One list for each result column."""
    index, rows = _index(templates, rare), []
    for text in texts:
        file = words(text)
        base, labels, score, starts = set(), set(), 0.0, []
        found = index.places(file)
        spans = [(s, s + len(index.entries[n].key), index.entries[n].template.label) for n, s in found]
        for (n, start), (_, end, _) in zip(found, spans, strict=True):
            t = index.entries[n].template
            share = index.share(n, start, file) if t.text else 1.0
            if t.base:
                base.add(t.label)
                starts.append(start)
            elif not t.text and (DENIED.intersection(file[max(0, start - 2) : start]) or any(a <= start and end <= b and b - a > end - start and other != t.label for a, b, other in spans)):
                continue  # denied, or part of another licence's longer phrase
            if t.base or share >= t.share:
                labels.add(t.label)
                score = max(score, share)
        rows.append((len(file), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(score, 1.0)))
    return dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), map(list, zip(*rows, strict=True)), strict=True))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rare: int = 3) -> DataFrame:
    """Look for license notices in the whole text of every row of ``docs``.

    Returns doc_id, n_words, n_base (places of base phrases, overlapping ones too), first_word
    and last_word (smallest and largest start of these, null without any), base_labels, labels
    (comma-joined, sorted, empty without any) and score (the best template's share, 0 to 1). A phrase that stands for a licence without
    more of its text counts neither within a longer phrase of another licence nor shortly behind a word of DENIED; base phrases always count.
    A null text counts as empty: no words, no labels, score 0. Each row is judged by itself;
    an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(rows, "text", lambda texts: scan(texts, templates, rare), schema)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op4_license_scan": op4_license_scan}
SQL: dict[str, str] = {}
