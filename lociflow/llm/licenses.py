"""License notices in texts: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Texts and templates are compared as words without case and marks. A fingerprint is the hash of K words that is the
smallest of its winnowing window, so any shared run of K + WINDOW - 1 words shares one. Short templates are looked up by
the word that names the license instead, and no notice counts without its naming words. An inverted index from
fingerprints to places in templates gives diagonals; each hit outside the notices found so far is a candidate, which a
local alignment within a band around its diagonal turns into matched words, coverage of the template and a span of the
text. Templates are a fixed small list, so the index goes to every executor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW, BAND = 3, 4, 8
VERSION = re.compile(r"^v?([0-9]+)(?:\.0)*$")
WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")

# Notices by license name, public wordings.
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
)
BSD_LISTS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_TERMS = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version"
)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", MIT_GRANT),
    (
        "MIT",
        MIT_GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", GNU_TERMS.format(what="program", kind="General Public License", version="3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", GNU_TERMS.format(what="program", kind="General Public License", version="2")),
    ("LGPL-2.1", GNU_TERMS.format(what="library", kind="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", GNU_TERMS.format(what="library", kind="Lesser General Public License", version="3")),
    ("AGPL-3.0", GNU_TERMS.format(what="program", kind="Affero General Public License", version="3")),
    ("BSD", BSD_CONDITIONS),
    ("BSD-2-Clause", f"{BSD_CONDITIONS}: {BSD_LISTS} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_CONDITIONS}: {BSD_LISTS} {BSD_NAMES} {BSD_WARRANTY}"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions",
    ),
    ("all-rights-reserved", "All rights reserved"),
)

#: The words that tell a license from others of similar notices: those that a template has must be among its matched words.
#: The first one is looked up everywhere for templates of under ANCHORED words.
NAMING = {
    "Apache-2.0": ("apache", "2"),
    "MIT": ("mit",),
    "GPL-3.0": ("gnu", "general", "public", "3"),
    "GPL-2.0": ("gnu", "general", "public", "2"),
    "LGPL-2.1": ("lesser", "gnu", "general", "public", "2.1"),
    "LGPL-3.0": ("lesser", "gnu", "general", "public", "3"),
    "AGPL-3.0": ("affero", "gnu", "general", "public", "3"),
    "BSD-3-Clause": ("neither", "endorse"),
    "MPL-2.0": ("mozilla", "2"),
    "CC-BY-NC-4.0": ("by-nc", "4"),
    "CC-BY-SA-4.0": ("by-sa", "attribution-sharealike", "creative", "commons", "4"),
    "CC-BY-4.0": ("attribution", "creative", "commons", "4"),
    "CC0-1.0": ("waived",),
    "all-rights-reserved": ("reserved", "all", "rights"),
}
#: Words within a notice that make it another license's, unless the template has them.
FOREIGN = frozenset("lesser library affero noncommercial non-commercial sharealike share-alike noderivatives noderivs".split())
ANCHORED = 16
#: Codes of words that no template has, and of words that a notice has taken.
OTHER, MASKED = -1, -2


def word_spans(text: str) -> tuple[list[str], np.ndarray]:
    """Lower-cased words, version numbers without v and .0, and their (start, stop) in code points."""
    found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    found = [(VERSION.sub(r"\1", w), a, b) if w[-1] in "0123456789" else (w, a, b) for w, a, b in found]
    return [f[0] for f in found], np.array([f[1:] for f in found], np.int64).reshape(-1, 2)


def gram_hashes(words: list[str]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(max(0, len(h) - K + 1), np.uint64)
    for i in range(K):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return out * np.uint64(0xBF58476D1CE4E5B9) if len(out) else out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every window, the rightmost of equal ones."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - grams[::-1].argmin()]) if len(grams) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(1))


def aligned(template: np.ndarray, words: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """(i, j) with template[i] == words[j] of the best local alignment with words[i + shift + d], |d| <= BAND.

    A match counts 2, a mismatch or gap -1. A row of the band is computed at once; a run of gaps along it is a running
    maximum of score + place.
    """
    width = 2 * BAND + 1
    column = np.arange(width)
    at = np.arange(len(template))[:, None] + (shift - BAND) + column
    inside = (at >= 0) & (at < len(words))
    equal = inside & (words[np.clip(at, 0, len(words) - 1)] == template[:, None])
    gain = np.where(equal, 2, -1)
    score = np.zeros((len(template) + 1, width + 1), np.int64)
    for i, above in enumerate(score[:-1]):
        here = np.maximum(np.maximum(above[:-1] + gain[i], above[1:] - 1), 0) * inside[i]
        score[i + 1, :-1] = (np.maximum.accumulate(here + column) - column) * inside[i]
    i, c = np.unravel_index(score[:, :-1].argmax(), (len(score), width))
    pairs = []
    while i > 0 and score[i, c] > 0:
        if score[i, c] == score[i - 1, c] + gain[i - 1, c]:
            i -= 1
            if equal[i, c]:
                pairs.append((int(i), int(at[i, c])))
        elif score[i, c] == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return pairs[::-1]


class Templates:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.words = [word_spans(text)[0] for _, text in templates]
        self.naming = [[w for w in NAMING.get(name, ()) if w in words] for name, words in zip(self.names, self.words, strict=True)]
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if self.naming[t] and len(words) < ANCHORED:  # too short for a fingerprint to be left where words are changed
                for i in (i for i, w in enumerate(words) if w == self.naming[t][0]):
                    self.anchors.setdefault(self.naming[t][0], []).append((t, i))
        anchored = {t for some in self.anchors.values() for t, _ in some}
        self.codes = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.coded = [np.array([self.codes[w] for w in words], np.int64) for words in self.words]
        self.bags = [np.unique(codes, return_counts=True) for codes in self.coded]
        rows = []
        for t, words in enumerate(self.words):
            grams = gram_hashes(words) if t not in anchored else []
            rows += [(int(grams[i]), t, int(i)) for i in range(len(grams))]  # every place, so that any fingerprint of a text finds it
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.at = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)
        short = [r[0] for r in rows if len(self.words[r[1]]) < 2 * (K + WINDOW - 1)]  # with a changed word, windows may skip these, so they are looked up everywhere
        self.short = np.array(short, np.uint64)

    def notices(self, t: int, words: list[str], codes: np.ndarray, hits: list[tuple[int, int]], least: float) -> list[list[tuple[int, int]]]:
        """Alignments of template t, from hits (diagonal, place). Each one's matched words are masked for the next ones,
        and a hit that none covers is aligned again, so notices may follow each other within the band."""
        template, rest, found = self.coded[t], codes.copy(), []
        kinds, wanted = self.bags[t]
        for d, place in sorted(set(hits)):
            tried: list[int] = []  # masked for this hit alone, as the words may be another notice's
            while rest[place] != MASKED:
                near = np.bincount(rest[max(0, d - BAND) : max(0, d + len(template) + BAND)] + 2, minlength=len(self.codes) + 2)[2:]
                if np.minimum(wanted, near[kinds]).sum() < least * len(template):
                    break
                pairs = aligned(template, rest, d)
                if not pairs or len(pairs) / len(template) < least:
                    break
                named = {self.words[t][i] for i, _ in pairs}.issuperset(self.naming[t])
                if named and FOREIGN.isdisjoint(set(words[pairs[0][1] : pairs[-1][1] + 1]).difference(self.words[t])):
                    found.append(pairs)
                else:
                    tried += [j for _, j in pairs]
                rest[[j for _, j in pairs]] = MASKED
            rest[tried] = codes[tried]
        return found

    def scan(self, text: str | None, least: float) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, stop) of the notices, by start; of overlapping ones that with most matched words."""
        words, spans = word_spans(text) if text else ([], np.empty((0, 2), np.int64))
        grams = gram_hashes(words)
        places = winnowed(grams)
        if len(self.short):
            places = np.union1d(places, np.flatnonzero(np.isin(grams, self.short)))
        lo, hi = np.searchsorted(self.keys, grams[places]), np.searchsorted(self.keys, grams[places], "right")
        hits: dict[int, list[int]] = {}
        for p in np.flatnonzero(hi > lo):
            for t, i in self.at[lo[p] : hi[p]]:
                hits.setdefault(int(t), []).append((int(places[p]) - int(i), int(places[p])))
        for p, w in enumerate(words):
            for t, i in self.anchors.get(w, ()):
                hits.setdefault(t, []).append((p - i, p))
        codes = np.fromiter((self.codes.get(w, OTHER) for w in words), np.int64, len(words)) if hits else None
        found = [(len(f), len(f) / len(self.words[t]), f[0][1], f[-1][1], t) for t, some in hits.items() for f in self.notices(t, words, codes, some, least)]
        taken, used = [], np.zeros(len(words), bool)
        for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            if not used[f[2] : f[3] + 1].any():
                taken.append(f)
                used[f[2] : f[3] + 1] = True
        return [(self.names[t], cover, int(spans[a, 0]), int(spans[b, 1])) for _, cover, a, b, t in sorted(taken, key=lambda f: f[2])]


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_coverage: float = 0.7, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_notices, licenses, coverage, spans) for every row of docs.

    licenses are the distinct names in order, joined by commas; coverage is the largest share of a template that is
    matched; spans are name:start:end in code points, the end exclusive. Null, empty and plain texts have none and
    coverage 0. Rows that repeat an id, or have a null one, are scanned each for itself. An empty table gives an empty
    one; other columns don't matter.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Templates(templates)
        for batch in batches:
            found = [index.scan(t, least_coverage) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_notices": [len(f) for f in found],
                "licenses": [",".join(sorted({x[0] for x in f})) for f in found],
                "coverage": [max((x[1] for x in f), default=0.0) for f in found],
                "spans": [",".join(f"{x[0]}:{x[2]}:{x[3]}" for x in f) for f in found],
            })

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(work, "doc_id long, n_notices int, licenses string, coverage double, spans string")
