"""License scans by patience alignment of texts with license templates.

Words that occur once in the template and once in a window of the text are matched; the longest increasing subsequence of
their places is the set of anchors; equal words right before and after an anchor belong to it, and the gaps between
anchors are aligned in the same way. Coverage is the share of the template's words that were matched.

Each template has phrases that tell it from its siblings (name, version); without all of them, word for word, it is not found,
whatever its coverage. So windows lie around the places of its first phrase, as long as the template on both sides, and
no other place of the text can hold it. In short templates nothing may be inserted either. Some texts begin like a sibling
that goes on; phrases that only the sibling has exclude them.

License tags (`SPDX-License-Identifier:` and `License:` lines) are read as expressions: every identifier in them is found, whether a template
knows it or not, as `<identifier>-tag` with coverage 1; what stands behind WITH is an exception, no license.

A template of the caller's own has no such phrases: alignment starts where SEED_WORDS of its words stand together in the text, once for each
stretch that an alignment has not matched already.

Cases: a null or empty text has no license, nor has one that names a family without the version. Ties in coverage go to the longer
template and then to the first name. Very long texts are read whole. Null identifiers and repeated rows are returned as they
came; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table

# Notices and opening paragraphs of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "under CC0 1.0",
    "Artistic-2.0": "Licensed under the Artistic License, Version 2.0",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "ISC-line": "Released under the ISC License",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
}
for _name, _version in (("Lesser", "2.1"), ("Lesser", "3"), ("Affero", "3"), ("", "2")):
    _id = f"{_name[:1]}GPL-{_version if '.' in _version else _version + '.0'}"
    TEMPLATES[_id] = f"This work is licensed under the GNU {_name} General Public License, version {_version}"
    TEMPLATES[_id + "-notice"] = TEMPLATES["GPL-3.0-notice"].replace("GNU", f"GNU {_name}").replace("version 3", f"version {_version}")
for _kind, _name in {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    for _version, _port in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_kind}-{_version}"] = f"Licensed under CC {_kind} {_version}"
        TEMPLATES[f"CC-{_kind}-{_version}-name"] = f"licensed under a Creative Commons Attribution{_name} {_version} {_port} License"
# The titles of whole license texts.
for _id, _title in {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Apache-2.0": "Apache License Version 2.0, January 2004", "Artistic-2.0": "The Artistic License 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "CC0-1.0": "CC0 1.0 Universal", "EPL-2.0": "Eclipse Public License - v 2.0", "EUPL-1.2": "EUROPEAN UNION PUBLIC LICENCE v. 1.2",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions", "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions", "OFL-1.1": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
}.items():
    TEMPLATES[f"{_id}-title"] = _title
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
TEMPLATES["MIT-0"] = TEMPLATES["MIT-text"].partition(", subject to")[0]

#: What has to stand in the text word for word. The first phrase is the one that is looked for.
PHRASES = {
    "0BSD": ["and/or distribute this software", "fee is hereby granted"],
    "Apache-2.0": ["Apache License", "2.0"],
    "Apache-2.0-notice": ["Apache License", "2.0"],
    "Artistic-2.0": ["Artistic License", "2.0"],
    "BSD-2-Clause": ["forms, with or without modification", "Redistributions in binary form"],
    "BSD-2-Clause-line": ["BSD 2-Clause"],
    "BSD-3-Clause": ["neither the name of", "with or without modification"],
    "BSD-3-Clause-line": ["BSD 3-Clause"],
    "BSL-1.0": ["Boost Software License", "1.0"],
    "CC0-1.0": ["CC0 1.0"],
    "EPL-1.0": ["Eclipse Public License", "1.0"],
    "EPL-2.0": ["Eclipse Public License", "2.0"],
    "ISC": ["and/or distribute this software", "granted, provided that the above"],
    "ISC-line": ["ISC License"],
    "MIT": ["MIT License"],
    "MIT-0": ["obtaining a copy of this software"],
    "MIT-text": ["obtaining a copy of this software", "permission notice shall be included"],
    "MPL-1.1": ["Mozilla Public License", "1.1"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "MPL-2.0-line": ["Mozilla Public License", "2.0"],
    "Unlicense": ["unencumbered software", "public domain"],
    "Zlib": ["alter it and redistribute it freely"],
}
for _id in TEMPLATES:
    if _id.endswith("-title"):
        PHRASES[_id] = [TEMPLATES[_id]]
    elif "GPL" in _id:
        _name = {"L": "Lesser", "A": "Affero"}.get(_id[0], "")
        PHRASES[_id] = [f"GNU {_name} General Public License", ("version " if "notice" in _id else "") + _id.split("-")[1]]
    elif _id.startswith("CC-"):
        PHRASES[_id] = [" ".join(TEMPLATES[_id].split()[2 if "name" not in _id else 3 :][: 3 if "name" not in _id else 4])]
#: What excludes a license when it stands in its place or within FOLLOWING words after it.
UNLESS = {
    "0BSD": ["granted, provided that"],
    "BSD-2-Clause": ["neither the name of", "all advertising materials"],
    "BSD-3-Clause": ["all advertising materials"],
    "MIT-0": ["subject to the following conditions"],
}
FOLLOWING = 40
#: Templates of so many words allow no insertion.
SHORT = 20
#: Words that have to stand together where the alignment with a template without phrases starts.
SEED_WORDS = 3
# What a license tag begins with, an identifier, and what joins identifiers.
_TAG = re.compile(r"(?:SPDX-License-Identifier|^[ \t#*/-]*License)[ \t]*:[ \t]*([A-Za-z0-9.+\-() \t]+)", re.IGNORECASE | re.MULTILINE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9+]")
_VERSIONED = re.compile(r"-\d|^(?:0BSD|MIT|ISC|Zlib|Unlicense|PSF|X11|NCSA|WTFPL|Beerware|BSD|curl)\b", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
LEAST_COVERAGE = 0.8


_VERSION = re.compile(r"v(\d[\d.]*)")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Words in one spelling (license, version 2 for v2.0) and the place in the text's words of each."""
    words, places = [], []
    for k, w in enumerate(_WORD.findall(text.lower())):
        if w[0] == "v" and (w == "v" or _VERSION.fullmatch(w)):
            words.append("version")
            places.append(k)
            w = w[1:]
        if w:
            words.append(w[:-2] if w.endswith(".0") and w[:-2].isdigit() else w.replace("licence", "license"))
            places.append(k)
    return words, places


def places_of(phrase: list[str], words: list[str]) -> list[int]:
    return [k for k, w in enumerate(words) if w == phrase[0] and words[k : k + len(phrase)] == phrase]


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence, by patience piles."""
    tops, piles, back = [], [], []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        tops[p : p + 1], piles[p : p + 1] = [v], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, both increasing: the ends that agree, the anchors, and what lies between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [both[k] for k in increasing([y for _, y in both])]
        x, y = a0, b0
        for ax, ay in anchors:
            todo.append((x, ax, y, ay))
            out.append((ax, ay))
            x, y = ax + 1, ay + 1
        if anchors:
            todo.append((x, a1, y, b1))
    return sorted(out)


class Scanner:
    """Templates as words, and the scan of one text. A template without phrases is told by its words alone."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = [(name, words_of(text)[0]) for name, text in sorted(templates.items())]
        #: Of each word that a first phrase begins with: (template, place in it, phrase).
        self.seeds: dict[str, list[tuple[int, int, list[str]]]] = {}
        self.phrases = [[words_of(p)[0] for p in PHRASES.get(name, ()) if templates[name] == TEMPLATES.get(name)] for name, _ in self.templates]
        self.unless = [[words_of(p)[0] for p in UNLESS.get(name, ())] if own else [] for (name, _), own in zip(self.templates, self.phrases)]
        for n, ((_, template), phrases) in enumerate(zip(self.templates, self.phrases)):
            together = min(SEED_WORDS, len(template))
            for seed in phrases[:1] or [list(g) for g in dict.fromkeys(zip(*(template[j:] for j in range(together))))]:
                for at in places_of(seed, template):
                    self.seeds.setdefault(seed[0], []).append((n, at, seed))
        #: Tags belong to the library's own templates.
        self.own = templates is TEMPLATES or templates == TEMPLATES

    def match(self, n: int, at: int, k: int, words: list[str]) -> list[tuple[int, int]]:
        """Matched places of template n and the text, when the template's place at is the text's place k; none without the phrases."""
        template = self.templates[n][1]
        low = max(0, k - len(template))
        left = align(template[:at][::-1], words[low:k][::-1])
        right = align(template[at:], words[k : k + len(template) + 1])
        before = [(at - 1 - x, k - 1 - y) for x, y in left]
        after = [(at + x, k + y) for x, y in right]
        if len(template) <= SHORT:
            before, after = (unbroken(pairs, (at, k)) for pairs in (before, after))
        pairs = before[::-1] + after
        place = dict(pairs)
        for phrase in self.phrases[n]:
            if not any(all(place.get(t + i, -1) == place.get(t, -2) + i for i in range(len(phrase))) for t in places_of(phrase, template)):
                return []
        stretch = words[pairs[0][1] : pairs[-1][1] + FOLLOWING] if pairs else []
        return [] if any(places_of(phrase, stretch) for phrase in self.unless[n]) else pairs

    @staticmethod
    def tags(text: str) -> list[tuple[str, int, int]]:
        """(identifier, first character, after the last) of the identifiers in a text's license tags, each once, in order."""
        found: dict[str, tuple[int, int]] = {}
        for tag in _TAG.finditer(text):
            exception = False
            for m in _IDENTIFIER.finditer(text, *tag.span(1)):
                joins = m[0].upper()
                if joins in ("AND", "OR", "WITH"):
                    exception = joins == "WITH"
                    continue
                if not exception:
                    if not _VERSIONED.search(m[0]):
                        break  # prose
                    found.setdefault(m[0].rstrip("."), m.span())
                exception = False
        return [(name, *span) for name, span in found.items()]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of every template that is covered enough, best first."""
        if not text:
            return []
        tags = self._tagged(text) if self.own else []
        words, places = words_of(text)
        if self.seeds.keys().isdisjoint(words):
            return tags
        seen: dict[int, set[tuple[int, int]]] = {}
        best: dict[int, tuple[float, int, int]] = {}
        for k, w in enumerate(words):
            for n, at, seed in self.seeds.get(w, ()):
                if words[k : k + len(seed)] != seed or (n in best and best[n][0] == 1):
                    continue
                if (at, k) in seen.get(n, ()):
                    continue
                pairs = self.match(n, at, k, words)
                seen[n] = set(pairs)
                coverage = len(pairs) / len(self.templates[n][1])
                if pairs and coverage >= self.least and coverage > best.get(n, (0,))[0]:
                    best[n] = (coverage, places[pairs[0][1]], places[pairs[-1][1]])
        found = sorted(best, key=lambda n: (-best[n][0], -len(self.templates[n][1]), n))
        named = [(self.templates[n][0], *best[n]) for n in found]
        return sorted([*named, *tags], key=lambda f: -f[1])

    def _tagged(self, text: str) -> list[tuple[str, float, int, int]]:
        """The identifiers of a text's tags as scan() returns them."""
        count = lambda end: sum(1 for _ in _WORD.finditer(text, 0, end))
        return [(f"{name}-tag", 1.0, count(first), max(count(first), count(after) - 1)) for name, first, after in self.tags(text)]


def unbroken(pairs: list[tuple[int, int]], start: tuple[int, int]) -> list[tuple[int, int]]:
    """The pairs, in their order away from start, up to the first one before which the text has more words than the template."""
    out = []
    for x, y in pairs:
        if abs(y - start[1]) > abs(x - start[0]):
            break
        out.append((x, y))
        start = x, y
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """(id, license, coverage, first_word, last_word, licenses) of every row; the best license, or null and coverage 0."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"license": (T.StringType(), pa.string()), "coverage": (T.DoubleType(), pa.float64()), "first_word": (T.LongType(), pa.int64()), "last_word": (T.LongType(), pa.int64()), "licenses": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *(T.StructField(n, k) for n, (k, _) in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = scanner.scan(text.as_py())
                name, coverage, first, last = found[0] if found else (None, 0.0, None, None)
                rows.append((name, coverage, first, last, [x[0] for x in found]))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds.values()))], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.concat_ws(",", "licenses"))
