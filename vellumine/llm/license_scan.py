"""License scans: runs of words of a text compared to licence templates by the Dice coefficient over word bigrams.

Every run of words of the whole text counts, across lines and sentences. Of runs that share a word only the best counts:
the highest coefficient, then the longest template, the shortest run, the earliest, the template listed first. The
coefficient of sets of a and b bigrams is at most 2 min(a, b) / (a + b), so a template is only compared with runs of a
size near its own. A run whose first or last bigram is not the template's, or comes again within it, never ranks above
the run without it, so the others are left out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from .common import arrow_rows, bounded_batches

LEAST = 0.8

#: Licences whose identifier tag is a template of its own. Left out are those whose other versions' tags come to LEAST too.
TAGGED = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 EPL-2.0 Artistic-2.0".split()

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Notices, grants and, of the short licences, whole texts, one entry per wording: name, text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", _BSD_GRANT),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_REST}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_REST}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    *((name, f"License-Identifier: {name}") for name in TAGGED),
)

_WORDS = re.compile(r"[^\W_]+")
FOUND = "doc_id {id}, license string, dice double, start long, end long, n_segments long, licenses array<string>"


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Bigrams of the normalised text: lower case, letters and digits only. A single word gives none."""
    words = _WORDS.findall(text.lower())
    return frozenset(zip(words, words[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def _ranked(candidates: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Candidates (dice, template's bigrams, first word, word after the last, template) that share no word, best first."""
    out, taken = [], bytearray(max((c[3] for c in candidates), default=0))
    for c in sorted(candidates, key=lambda c: (-c[0], -c[1], c[3] - c[2], c[2], c[4])):
        if taken.find(1, c[2], c[3]) < 0:
            taken[c[2] : c[3]] = b"\1" * (c[3] - c[2])
            out.append(c)
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, bigrams(text)) for name, text in templates]
        # Sizes m with 2 min(m, n) / (m + n) >= least, by the same division as the coefficient's; the least of them is
        # also the number of bigrams that a run must share, and the largest that of its distinct ones.
        fits = lambda n: [m for m in range(1, int(2 * n / least) + 1) if 2 * min(m, n) / (m + n) >= least]
        self.sizes = [(min(f), max(f)) if f else (1, 0) for f in (fits(len(b)) for _, b in self.templates)]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.holders.setdefault(g, []).append(i)
        self.needed = re.compile("|".join(sorted({re.escape(w) for _, b in self.templates for w in self._needed(b)})))

    def _needed(self, grams: frozenset) -> set[str]:
        """Words of which every close enough segment holds at least one.

        At least least / (2 - least) of a template's bigrams must be shared, so words whose bigrams are more than the
        rest cannot all be missing. Longer words come first, being rarer.
        """
        missing, chosen, covered = len(grams) * (1 - self.least / (2 - self.least)) + 1e-9, set(), set()
        for word in sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w)):
            if len(covered) > missing:
                break
            chosen.add(word)
            covered |= {g for g in grams if word in g}
        return chosen

    def matches(self, text: str) -> list[tuple[float, str, int, int]]:
        """(dice, name, start, end) of the runs of words at or above the least coefficient, best first; none share a word."""
        if not self.needed.search(text.lower()):
            return []
        spans = [m.span() for m in _WORDS.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        grams, hits = list(zip(words, words[1:])), {}
        for k, g in enumerate(grams):
            for i in self.holders.get(g, ()):
                hits.setdefault(i, []).append(k)
        found = [c for i, at in hits.items() if len(at) >= self.sizes[i][0] for c in self._runs(grams, at, i)]
        return [(score, self.templates[i][0], spans[a][0], spans[b - 1][1]) for score, _, a, b, i in _ranked(found)]

    def _runs(self, grams: list, at: list[int], i: int):
        """Runs of words close enough to template i, whose bigrams stand at ``at``."""
        template, (fewest, most) = self.templates[i][1], self.sizes[i]
        if len({grams[k] for k in at}) < fewest:
            return
        for first in at:
            seen, shared = set(), 0
            for k in range(first, len(grams)):
                g = grams[k]
                if g in seen:
                    if g == grams[first]:
                        break
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if g in template:
                    shared += 1
                    score = 2 * shared / (len(seen) + len(template))
                    if score >= self.least:
                        yield score, len(template), first, k + 2, i

    def best(self, text: str | None) -> tuple:
        """(license, dice, start, end, segments that match, sorted names); of equal coefficients the earliest segment."""
        found = self.matches(text or "")
        if not found:
            return None, 0.0, None, None, 0, []
        score, name, a, b = min(found, key=lambda f: (-f[0], f[2]))
        return name, score, a, b, len(found), sorted({f[1] for f in found})


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the best licence, its coefficient and span, and all licences found.

    Null and empty texts and texts without a match get a null licence and 0; of templates that tie the one listed first
    wins; repeated rows each give a row; an empty table none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def make():
        scanner = Scanner(templates, least)
        return lambda doc_id, text: [(doc_id, *scanner.best(text))]

    schema = FOUND.format(id=docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", "text").mapInArrow(arrow_rows(make, schema), schema)


def brute(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> Mapping[tuple[int, int], tuple[float, str]]:
    """Every run of words against every template, without bounds; for tests."""
    spans = [m.span() for m in _WORDS.finditer(text or "")]
    words = [(text or "")[a:b].lower() for a, b in spans]
    grams, wanted, found = list(zip(words, words[1:])), [bigrams(t) for _, t in templates], []
    for a in range(len(grams)):
        for b in range(a + 1, len(words)):
            piece = frozenset(grams[a:b])
            for i, t in enumerate(wanted):
                if (score := dice(piece, t)) >= least:
                    found.append((score, len(t), a, b + 1, i))
    return {(spans[a][0], spans[b - 1][1]): (score, templates[i][0]) for score, _, a, b, i in _ranked(found)}
