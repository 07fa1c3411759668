"""Licence scans: blocks of text against licence templates by the Dice coefficient of their word bigrams.

A block is a line, or a run of lines between blank ones. Texts and templates are
normalised alike: lower case, and only letters and digits count, as words. With
sets A and B of word bigrams the coefficient is 2 |A & B| / (|A| + |B|). For it
to reach t, sizes must lie within a factor of (2 - t) / t of each other, which
leaves few templates for a block; most blocks share no bigram with any.

Notices also stand inside longer lines, or run over several paragraphs. So each
window of a whole text that has as many words as a template is compared with
it too, at a stricter coefficient (WITHIN percent). A window whose middle lies in
a window of another licence that shares more bigrams with its own template goes:
the two-clause BSD text isn't found in the three-clause one.

A block, or a window with the word before it, that says "not licensed" or the
like (NEGATED) matches nothing. Tags ``SPDX-License-Identifier: ...`` name their
licences: each known name of such a line counts, with a coefficient of 1;
"-only", "-or-later" and "+" are taken off.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, doc_texts

# Licence notices as their publishers word them, titles of full texts, and paragraphs that no other licence here has.
TEMPLATES = {
    "agpl-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ],
    "bsd-2-clause": [
        "Licensed under the BSD 2-Clause License.",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsl-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International Public License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    ],
    "cc0-1.0": [
        "Creative Commons Legal Code CC0 1.0 Universal",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "epl-2.0": [
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
THRESHOLD = 0.8
#: Least Dice coefficient of a window inside a text, in percent.
WITHIN = 90
#: Words of a text that are looked at together; pieces overlap by the longest template.
PIECE = 1 << 16
#: Word bigrams that say that something isn't licensed.
NEGATED = [(a, b) for a in ("not", "never", "t", "longer") for b in ("licensed", "released", "available")]
# Tags, the names in one, and what is taken off a name; SQL reads them, too.
TAG, NAME, LATER = r"(?i)SPDX-License-Identifier:([^\n]*)", r"[a-z0-9+]+(?:[.-][a-z0-9+]+)*", r"(?:-only|-or-later|\+)$"
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def bigrams(text: str) -> set[tuple[str, str]]:
    """The word bigrams of a text."""
    found = _WORD.findall(text.lower())
    return set(zip(found, found[1:], strict=False))


class Matcher:
    """Templates by size and by bigram."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, b) for name in sorted(templates) for text in templates[name] if (b := bigrams(text))]
        self.lengths = [len(_WORD.findall(text.lower())) for name in sorted(templates) for text in templates[name] if bigrams(text)]
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for k, (_, found) in enumerate(self.templates):
            for b in found:
                self.by_bigram.setdefault(b, []).append(k)
        low, high = min(len(b) for _, b in self.templates), max(len(b) for _, b in self.templates)
        self.least, self.most = low * threshold / (2 - threshold), high * (2 - threshold) / threshold

    def of(self, block: str) -> Iterator[tuple[str, float]]:
        """Licences and coefficients of a block."""
        found = _WORD.findall(block.lower())
        if not self.least <= len(found) - 1 and self.least > 1:
            return
        pairs = set(zip(found, found[1:], strict=False))
        if not pairs.isdisjoint(NEGATED):
            return
        n = len(pairs)
        if not self.least <= n <= self.most:
            return
        shared: dict[int, int] = {}
        for pair in self.by_bigram.keys() & pairs:
            for k in self.by_bigram[pair]:
                shared[k] = shared.get(k, 0) + 1
        for k, common in shared.items():
            name, template = self.templates[k]
            t, m = self.threshold, len(template)
            if m * t <= n * (2 - t) and n * t <= m * (2 - t) and 2 * common >= t * (n + m):
                yield name, 2 * common / (n + m)

    def windows(self, words: list[str], percent: int, before: str = "") -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of windows that reach ``percent``: template, and for each window its first word, bigrams shared and coefficient. ``before`` is the word before the first."""
        pairs = set(zip(words, words[1:], strict=False))
        shared: dict[int, int] = {}
        for pair in self.by_bigram.keys() & pairs:
            for k in self.by_bigram[pair]:
                shared[k] = shared.get(k, 0) + 1
        # a window's own bigrams are at least those that it shares
        fit = [k for k, c in shared.items() if self.lengths[k] <= len(words) and 200 * c >= percent * (c + len(self.templates[k][1]))]
        if not fit:
            return
        ids = {pair: i for i, pair in enumerate(pairs)}
        codes = np.array([ids[pair] for pair in zip(words, words[1:], strict=False)])
        order = np.argsort(codes, kind="stable")
        last = np.full(len(codes), -1)  # where a bigram stood last
        again = codes[order][1:] == codes[order][:-1]
        last[order[1:][again]] = order[:-1][again]
        # denials up to each place, the bigram with the word before the window being the one before it
        denials = np.cumsum([0, (before, words[0]) in NEGATED, *np.isin(codes, [ids[pair] for pair in NEGATED if pair in ids])])

        def distinct(places: np.ndarray, size: int) -> np.ndarray:
            """Of these places the first of their bigram in each window of ``size`` bigrams, counted by its start."""
            edges = np.bincount(np.maximum(last[places], places - size) + 1, minlength=len(codes) + 1)
            return np.cumsum(edges - np.bincount(places + 1, minlength=len(codes) + 1))[: len(codes) - size + 1]

        for k in fit:
            template = self.templates[k][1]
            known = np.zeros(len(pairs), bool)
            known[[ids[pair] for pair in template & pairs]] = True
            size = self.lengths[k] - 1
            common, n = distinct(np.flatnonzero(known[codes]), size), distinct(np.arange(len(codes)), size)
            starts = np.flatnonzero((200 * common >= percent * (n + len(template))) & (denials[size + 1 :] == denials[: -size - 1]))
            if len(starts):
                yield k, starts, common[starts], 2 * common[starts] / (n[starts] + len(template))

    def within(self, text: str, percent: int = WITHIN) -> dict[str, float]:
        """Licences of a text's windows, each with its best coefficient."""
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        source, overlap, at = (m[0] for m in _WORD.finditer(text.lower())), max(self.lengths) - 1, 0
        words, before = list(islice(source, PIECE + overlap)), ""
        while words:
            for k, starts, common, dice in self.windows(words, percent, before):
                own = starts < PIECE
                found.setdefault(k, []).append((starts[own] + at, common[own], dice[own]))
            words, before, at = words[PIECE:], words[min(PIECE, len(words)) - 1], at + PIECE
            words += islice(source, PIECE)
        hits = {k: [np.concatenate(x) for x in zip(*parts, strict=True)] for k, parts in found.items()}
        best: dict[str, float] = {}
        for k, (starts, common, dice) in hits.items():
            name, middle = self.templates[k][0], starts + self.lengths[k] // 2
            stays = np.ones(len(starts), bool)
            for other, (begin, more, _) in hits.items():
                if self.templates[other][0] != name:
                    first, last = np.searchsorted(begin, middle - self.lengths[other], "right"), np.searchsorted(begin, middle, "right")
                    some = np.flatnonzero(first < last)
                    most = np.maximum.reduceat(np.append(more, 0), np.stack([first[some], last[some]], 1).ravel())[::2] if len(some) else more[:0]
                    stays[some[most > common[some]]] = False
            if stays.any():
                best[name] = max(best.get(name, 0.0), float(dice[stays].max()))
        return best


def tagged(text: str, known: Container[str]) -> set[str]:
    """The known names in tags of a text."""
    return {name for line in re.findall(TAG, text) for found in re.findall(NAME, line.lower()) if (name := re.sub(LATER, "", found)) in known}


def blocks(text: str) -> Iterator[str]:
    """The lines of a text, and its runs of two or more lines between blank ones."""
    lines = text.split("\n")
    yield from lines
    if len(lines) > 1:
        for run in _BLANK.split(text):
            if "\n" in run.strip("\n"):
                yield run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, license (the best; ties by name; null if none), dice, n_matches and licenses (all found, sorted).

    Found are the licences of blocks, of windows and of tags that name a licence
    of ``templates``. n_matches counts blocks that match some template, so it is 0
    where a notice stands inside a block only. Null and empty texts match nothing; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates or TEMPLATES, threshold)
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                best, n = matcher.within(text) | dict.fromkeys(tagged(text, templates or TEMPLATES), 1.0), 0
                for block in blocks(text):
                    hits = list(matcher.of(block))
                    n += bool(hits)
                    for name, dice in hits:
                        best[name] = max(best.get(name, 0.0), dice)
                top = min(best, key=lambda x: (-best[x], x)) if best else None
                rows.append((top, best.get(top), n, sorted(best)))
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "license", "dice", "n_matches", "licenses"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, license string, dice double, n_matches long, licenses array<string>")
