"""License scans by conditional compression.

A block of text that speaks of a licence is compressed alone and with each
licence template as a raw zstandard dictionary, and the templates are ranked by
what they save. In that order each is confirmed by its exact wording: enough of
its words in order, and no difference in words that tell licences apart. What a
template has confirmed, later ones don't get.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.chunks import held

_GNU = (("GPL-3.0", "General Public", "3"), ("GPL-2.0", "General Public", "2"), ("LGPL-3.0", "Lesser General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-2.0", "Library General Public", "2"), ("AGPL-3.0", "Affero General Public", "3"))
_GNU_SHORT = (("GPL-3.0", "GPL", "3"), ("GPL-2.0", "GPL", "2"), ("LGPL-3.0", "LGPL", "3"), ("LGPL-2.1", "LGPL", "2.1"), ("AGPL-3.0", "AGPL", "3"))
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_SPDX_NAMES = (
    "Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MPL-2.0", "ISC", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0",
    *(f"CC-{kind}-{version}" for kind, _ in _CC for version in ("4.0", "3.0")),
)
#: Usual wordings of licence notices, several a licence: short forms, headers, grants and headings of full texts. Numerals of lists and names of holders are left out.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    *((name, f"This work is licensed under the GNU {kind} License, version {version}.") for name, kind, version in _GNU),
    *((name, f"Licensed under the GNU {short} version {version}.") for name, short, version in _GNU_SHORT),
    *((name, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.") for name, kind, version in _GNU),
    *((name, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License version {version} as published by the Free Software Foundation.") for name, kind, version in _GNU),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", _BSD + " Neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by"),
    ("BSD-2-Clause", _BSD + " This software is provided by"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 Definitions"),
    *((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.") for kind, _ in _CC for version in ("4.0", "3.0")),
    *((f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {long} {version} {where} License.") for kind, long in _CC for version, where in (("4.0", "International"), ("3.0", "Unported"))),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is and the author disclaims all warranties"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX_NAMES),
)
_SHORT = (*((f"GPL-{v}.0", f"GPL{v}") for v in ("3", "2")), ("LGPL-3.0", "LGPL3"), ("LGPL-2.1", "LGPL2.1"), ("AGPL-3.0", "AGPL3"))
#: Short forms that count only in their place: `line` alone on a line, `field` as the value of a field named license, `grant` anywhere.
SHORT: tuple[tuple[str, str, str], ...] = (
    *((name, f"Licensed under {short.replace('GPL', 'GPLv')}", "grant") for name, short in _SHORT), ("Apache-2.0", "Licensed under Apache 2.0", "grant"), ("MIT", "MIT licensed", "line"),
    ("MIT", "MIT License", "line"), ("MIT", "The MIT License", "line"), ("ISC", "ISC License", "line"), ("BSD-3-Clause", "BSD 3-Clause License", "line"), ("BSD-2-Clause", "BSD 2-Clause License", "line"), ("Apache-2.0", "Apache License 2.0", "line"),
    ("Apache-2.0", "Apache License, Version 2.0", "line"), ("BSL-1.0", "Boost Software License 1.0", "line"), ("0BSD", "BSD Zero Clause License", "line"), ("Zlib", "zlib License", "line"), ("Unlicense", "The Unlicense", "line"),
    *((name, f"license: {name}", "field") for name in _SPDX_NAMES),
)
#: Words that take a notice back if one of them stands shortly before it or within it.
_NOT = frozenset("not never neither nor no isn wasn aren cannot without".split())
#: Words of a block that are compressed at once, and how near a heading stands to the notice that it heads.
MOST_WORDS, NEAR = 2048, 40
_TRIGGER = re.compile(r"licen[cs]e|copyright|redistribut|permission\W+(?:is|to)\b|l?gpl|unencumbered|public\W+domain|\bcc\W*(?:0|by)\b|spdx", re.I)
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([\w.+() \t-]+)", re.I)
_SPDX_ID = re.compile(r"(\bWITH\s+)?(?!(?:AND|OR|WITH)\b)([\w.-]+\w)(\+?)")
#: Words that differ without telling licences apart, and other spellings of words.
_COMMON = frozenset("a all an and any are as at by file for in international into is it its license licensed of on or program public released software that the this to under unported use version with work".split())
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "v": "version", "gplv": "gpl", "lgplv": "lgpl", "agplv": "agpl"}
_CLOSE = re.compile(r'[.;!)\]"\'”’]*')


def _plain(word: str) -> str:
    """A word as it is compared: in small letters, 2 for 2.0, one spelling."""
    word = word.lower()
    return _SAME.get(word, word.removesuffix(".0"))


def words(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text)]


def _back(text: str, at: int, reach: int) -> int:
    """Where the last `reach` words before a place begin."""
    size = 12 * reach
    while True:
        start = max(0, at - size)
        places = [m.start() for m in _WORD.finditer(text, start, at)]
        if len(places) > reach or start == 0:  # the first of them may be the tail of a word
            return places[-reach] if len(places) > reach else 0
        size *= 2


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Places (start, end) of the parts of a text that speak of licences: `reach` words on either side, across line feeds; parts that touch are one."""
    found: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        ahead = deque((w.end() for w in islice(_WORD.finditer(text, m.end()), reach)), 1)
        end = ahead[0] if ahead else m.end()
        if found and m.start() <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
            continue
        start = _back(text, m.start(), reach)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
    return found


class LicenseScanner:
    """Ranks the templates for a block by the bytes they save, and confirms the places that have their wording.

    Words tell licences apart if they are digits or of a licence's name, or if
    templates of two licences that share half of their words differ in them
    (_COMMON never does): a template's own must be there, others not come in
    between. An SPDX expression is read name by name. least_same is the share of
    the template's words that must be there in order, all in short forms, which
    count only in their place. A notice that is taken back by a word shortly
    before it is none. Savings only rank: none is asked for.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least_same: float = 0.8, short: tuple[tuple[str, str, str], ...] = SHORT):
        self.where = [None] * len(templates) + [w for _, _, w in short]
        self.templates = templates = (*templates, *((name, t) for name, t, _ in short))
        self.least_same = least_same
        self.plain = zstandard.ZstdCompressor(level=9)
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(self._bytes(words(t)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.wanted = [words(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.wanted]
        self.need = [len(w) if k else math.ceil(least_same * len(w) - 1e-9) for w, k in zip(self.wanted, self.where)]
        self.reach = max((self.sizes(len(w))[-1] for w in self.wanted), default=1)
        named = [set(words(name)) for name, _ in templates]
        every = set().union(*named)
        numbers = {w for want in self.wanted for w in want if w[0].isdigit()}
        self.must, self.barred = [], []
        for (name, _), own, want in zip(templates, named, self.wanted):
            must, barred = {w for w in want if w[0].isdigit() or w in own}, {w for w in every if not w[0].isdigit()} - _COMMON
            if must & numbers:
                barred |= numbers
            for (other, _), theirs in zip(templates, self.wanted):
                if other != name and 2 * min(len(want), len(theirs)) >= max(len(want), len(theirs)):
                    ops = difflib.SequenceMatcher(None, want, theirs, autojunk=False).get_opcodes()
                    if 2 * sum(o[2] - o[1] for o in ops if o[0] == "equal") >= max(len(want), len(theirs)):
                        must |= {w for kind, a, b, _, _ in ops if kind != "equal" for w in want[a:b]} - _COMMON
                        barred |= {w for kind, _, _, a, b in ops if kind != "equal" for w in theirs[a:b]} - _COMMON
            self.must.append(must)
            self.barred.append(barred - set(want))
        self.spdx = {tuple(w[3:]): i for i, w in enumerate(self.wanted) if w[:3] == ["spdx", "license", "identifier"]}

    @staticmethod
    def _bytes(own: list[str]) -> bytes:
        return (" ".join(own) + " ").encode()

    def savings(self, block: str) -> list[tuple[float, int]]:
        """(share saved, template) of all templates, as `ranked` orders them."""
        return self.ranked(words(block), range(len(self.templates)))

    def ranked(self, own: list[str], templates: Iterable[int]) -> list[tuple[float, int]]:
        """(share of the compressed size that a template saves, template), the most saved first; of equal ones the shorter template, then the earlier."""
        data = self._bytes(own)
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(self.given[i].compress(data)) / alone, i) for i in templates), key=lambda x: (-x[0], len(self.wanted[x[1]]), x[1]))

    @staticmethod
    def sizes(n: int) -> tuple[int, int, int]:
        """Words to look at for a template of n words: as many, then with room for words put in between."""
        return n, n + n // 4 + 2, 2 * n + 8

    def confirm(self, own: list[str], template: int) -> tuple[int, int, str, str] | None:
        """If own begins with the template's wording: its words that are there, the end, its words that lack and the words put in between."""
        want = self.wanted[template]
        ops = difflib.SequenceMatcher(None, want, own, autojunk=False).get_opcodes()
        equal = [o for o in ops if o[0] == "equal"]
        same = sum(o[2] - o[1] for o in equal)
        if same < self.need[template] or equal[0][3] > 0:
            return None
        end = equal[-1][4]
        lack = [w for kind, a, b, _, _ in ops if kind != "equal" for w in want[a:b]]
        extra = [w for kind, _, _, c, d in ops if kind != "equal" and d <= end for w in own[c:d]]
        if self.must[template].intersection(lack) or self.barred[template].intersection(extra) or not _TRIGGER.search(" ".join(own[:end])):
            return None
        return same, end, " ".join(lack), " ".join(extra)

    def identifiers(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, template) of each licence of the SPDX expressions, the first from the tag on."""
        for m in _SPDX.finditer(text, start, end):
            at = m.start()
            for k in _SPDX_ID.finditer(text, m.start(1), m.end(1)):
                i = self.spdx.get(tuple(words(re.sub(r"-(?:only|or-later)$", "", k[2], flags=re.I))))
                if i is not None and not k[1]:
                    yield at, k.end(), i
                at = k.end()

    def places(self, own: list[str], template: int) -> Iterator[tuple[int, int, str, str]]:
        """All places of a template in a row of words, from left to right."""
        want, need, must, count = self.wanted[template], self.need[template], self.must[template], self.counts[template]
        opening, at = set(want[: len(want) - need + 1]), 0
        while at < len(own):
            hit = None
            if own[at] in opening:
                most = own[at : at + self.sizes(len(want))[-1]]
                if must.issubset(most) and (Counter(most) & count).total() >= need:
                    for n in self.sizes(len(want)):
                        found = self.confirm(most[:n], template)
                        if found and (hit is None or found[0] > hit[0]):
                            hit = found
                        if hit and hit[0] == len(want):
                            break
            if hit:
                yield at, at + hit[1], hit[2], hit[3]
            at += hit[1] if hit else 1

    def in_place(self, text: str, spots: list[tuple[int, int]], first: int, last: int, template: int) -> bool:
        """Whether a short form stands where it counts; other templates do anywhere."""
        where, start, end = self.where[template], spots[first][0], spots[last - 1][1]
        if where == "line":
            before, behind = text[text.rfind("\n", 0, start) + 1 : start], text[end : text.find("\n", end) if "\n" in text[end : end + 400] else end + 400]
            return not _WORD.search(before) and not _WORD.search(behind)
        if where == "field":
            between = text[spots[first][1] : spots[first + 1][0]]
            return ("=" in between or ":" in between) and "\n" not in between
        return True

    def scan_block(self, text: str, start: int, end: int) -> list[tuple[str, float, int, str, str, int, int, int]]:
        """The confirmed places of a block: licence, share saved, template, words lacking and put in, start, end, and the template's rank.

        A block of more than MOST_WORDS words is ranked piece by piece, with as
        many words beyond as a template may take; a place is of the piece that
        it begins in. Templates whose telling words aren't all there, or too few
        of whose words are, can't be confirmed and aren't compressed.
        """
        found = list(_WORD.finditer(text, start, end))
        words_of, spots = [_plain(m.group()) for m in found], [(m.start(), m.end()) for m in found]
        tagged, tags = set(self.spdx.values()), {}
        for a, b, i in self.identifiers(text, start, end):
            tags.setdefault(i, []).append((a, b))
        kept: list[tuple] = []
        for lo in range(0, len(words_of), MOST_WORDS):
            own = words_of[lo : lo + MOST_WORDS + self.reach]
            there, count = set(own), Counter(own)
            here = range(spots[lo][0], spots[min(lo + MOST_WORDS, len(spots)) - 1][1])
            able = [i for i, must in enumerate(self.must) if i not in tagged and must <= there and sum(min(n, count[w]) for w, n in self.counts[i].items()) >= self.need[i]]
            able += [i for i, places in tags.items() if any(a in here for a, _ in places)]
            for rank, (share, i) in enumerate(self.ranked(own, able)):
                if i in tagged:
                    places = [(a, b, "", "") for a, b in tags[i] if a in here]
                else:
                    places = [(spots[lo + a][0], spots[lo + b - 1][1], lack, extra) for a, b, lack, extra in self.places(own, i) if a < MOST_WORDS and self.in_place(text, spots[lo:], a, b, i) and not self.denied(own, a, extra)]
                kept += [(a, b, (self.templates[i][0], share, i, lack, extra), rank) for a, b, lack, extra in places if all(b <= c or d <= a for c, d, *_ in kept)]
        kept.sort(key=lambda x: x[:2])
        alone = [x for x, y in zip(kept, [*kept[1:], None]) if not (y and self.where[x[2][2]] == "line" and y[2][0] == x[2][0] and len(_WORD.findall(text, x[1], y[0])) <= NEAR)]
        return [(*hit, a, _CLOSE.match(text, b).end(), rank) for a, b, hit, rank in alone]

    @staticmethod
    def denied(own: list[str], first: int, extra: str) -> bool:
        """Whether a word takes the notice back."""
        return not _NOT.isdisjoint(own[max(0, first - 3) : first]) or not _NOT.isdisjoint(extra.split())

    def scan(self, text: str) -> list[tuple[str, float, int, str, str, int, int, int]]:
        """All confirmed notices of a text with their places."""
        return [hit for start, end in blocks(text, self.reach) for hit in self.scan_block(text, start, end)]


def license_blocks(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each notice whose licence is confirmed: id, start and end (characters), license, saved, rank, lacking, inserted, block.

    Null and empty texts give no rows, a null id is kept, repeated rows repeat
    theirs; other columns of docs aren't read. No shuffle, and every text is
    scanned whole, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held(("licenses", templates), lambda: LicenseScanner(templates))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, share, _, lack, extra, start, end, rank in scanner.scan(text or ""):
                    out.append((doc_id, start, end, name, share, rank, lack, extra, text[start:end]))
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=[id_column, "start", "end", "license", "saved", "rank", "lacking", "inserted", "block"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, start long, end long, license string, saved double, rank int, lacking string, inserted string, block string")


def license_digest(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_blocks and its licences, sorted and joined by commas."""
    found = license_blocks(docs.select("doc_id", "text"), templates)
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    ids = docs.select("doc_id").distinct()
    return ids.join(counts, ids.doc_id.eqNullSafe(counts.doc_id), "left").select(ids.doc_id, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("licenses", F.lit("")).alias("licenses"))

