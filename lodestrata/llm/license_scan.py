"""Licence scan with a positional index of rare words.

Base phrases are found exactly.  The method adds labels of its own: each template's words of highest
IDF (over the templates) are looked up in a positional index, their postings are intersected by
relative position, and a template that enough of them agree on is verified by its mandatory key
phrases near that place.  Each template has rare words of its own, as many as make the vote lossless:
a template that stands in place with part COVER is always voted for, whatever else the text holds.

Defined results: null and empty texts have no words, no place and no label; score is the largest
part of a template found in place, at least 0.5 where a base phrase stands; ties between labels are
kept, as labels are a sorted set; repeated rows are scanned one by one, texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestrata.llm.common import map_text

# Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Short and long notices of public licences, and the phrases without which they do not count.
TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ("you may not use this file except in compliance with the license", "on an as is basis"),
    ),
    Template(
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistributions of source code must retain the above copyright notice", "neither the name of", "without specific prior written permission"),
    ),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ("redistributions in binary form must reproduce the above copyright notice", "provided with the distribution this software is provided by"),
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        ("gnu general public license", "version 3 of the license", "in the hope that it will be useful"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ("with or without fee is hereby granted", "the author disclaims all warranties"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ("permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"),
    ),
]

#: Part of a template's words that must stand in place for a label.
COVER = 0.6
#: Words by which a key phrase may stand off its place.
SLACK = 4

# a-z, 0-9 and bytes of 0x80 and above stay; all other bytes separate words
_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_WORD).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which a phrase stands in words joined, preceded and followed by spaces."""
    out, at, words, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


class Index:
    def __init__(self, templates: list[Template] = TEMPLATES):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        self.keys = [[(f" {k} ".encode(), _offset(t.text.split(), k.split())) for k in t.keys] for t in templates]
        self.needed = [frozenset(w for k in t.keys for w in k.encode().split()) for t in templates]
        holders = Counter(w for ws in self.words for w in set(ws))
        self.idf = {w: math.log(len(templates) / n) for w, n in holders.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes: list[int] = []  # of a template's looked-up places, those that agree at part COVER at least
        for i, ws in enumerate(self.words):
            off = max(n for n in range(len(ws)) if (len(ws) - n) / len(ws) >= COVER)  # words that may be out of place
            places = Counter(ws)
            looked: set[bytes] = set()
            for w in sorted(places, key=lambda w: (-self.idf[w], w)):
                if sum(places[x] for x in looked) > off:
                    break
                looked.add(w)
            self.votes.append(sum(places[x] for x in looked) - off)
            for p, w in enumerate(ws):
                if w in looked:
                    self.postings[w].append((i, p))

    def scan(self, words: list[bytes], joined: bytes) -> dict[str, float]:
        """label -> part of its best template found in place."""
        there = self.idf.keys() & set(words)
        possible = {i for i, need in enumerate(self.needed) if need <= there}
        if not possible:
            return {}
        rare = {w: own for w in there & self.postings.keys() if (own := [x for x in self.postings[w] if x[0] in possible])}
        votes: Counter[tuple[int, int]] = Counter()
        for at, w in enumerate(words):
            if w in rare:
                for i, p in rare[w]:
                    votes[i, at - p] += 1
        found: dict[str, float] = {}
        stands: dict[bytes, list[int]] = {}
        for (i, start), n in votes.items():
            if n < self.votes[i]:
                continue
            own = self.words[i]
            part = sum(0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(own)) / len(own)
            label = self.templates[i].label
            if part < COVER or part <= found.get(label, 0):
                continue
            for key, offset in self.keys[i]:
                if key not in stands:
                    stands[key] = places(joined, key)
                if not any(abs(x - start - offset) <= SLACK for x in stands[key]):
                    break
            else:
                found[label] = part
        return found


def _offset(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


_BASE = [(f" {p} ".encode(), label) for p, label in BASE]


def scan_text(text: str | None, index: Index) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = words_of(text) if text else []
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in _BASE:
        if at := places(joined, phrase):
            starts += at
            base.add(label)
    found = index.scan(words, joined)
    score = max([*found.values(), 0.5 if base else 0.0])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def factory():
        index = Index(templates)
        return lambda text: scan_text(text, index)

    return map_text(docs, [id_col], text_col, factory, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
