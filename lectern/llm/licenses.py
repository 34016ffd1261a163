"""License scans: MinHash bands of overlapping text windows retrieve templates, containment decides.

Words are runs of letters or digits in lower case, so punctuation does not matter.  Templates are
sorted into classes by length; a class is searched with windows of twice to four times that
length, each half covered by the next, so any copy lies wholly in one of its windows.  A window of
``w`` words that holds 80 % of a template's 5-word shingles is at least 1 in 12 similar to it; 128
bands of one value each then agree in at least one band with a probability above 0.9999.  What a
band retrieves is verified by exact containment.  A window without any shingle of a template can
agree in no band and is not signed.

Defined cases: a text that is null, empty or shorter than five words has no match; copies of one
template in a text are separate rows; repeated rows are scanned alike; other columns are not read;
an empty table gives no rows.  Templates need at least five words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import GOLDEN, WordHasher, byte_slices, mix, windows

SHINGLE = 5
CONTAINED = 0.8
BANDS = 128
LEAST_WINDOW = 16

# License notices and texts to look for.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
}


def token_classes() -> np.ndarray:
    """Letters (all bytes of non-ASCII characters among them) and digits are words; all else separates."""
    classes = np.zeros(256, np.uint8)
    classes[65:91] = classes[97:123] = classes[128:] = 1
    classes[48:58] = 2
    return classes


class TemplateIndex:
    """Band tables and exact shingle sets of templates, by class of length."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.hasher = WordHasher(lower=True, classes=token_classes())
        self.factors = mix((np.arange(bands, dtype=np.uint64) + np.uint64(101)) * np.uint64(GOLDEN)) | np.uint64(1)
        self.names = list(templates)
        hashes, first = self.hasher(pa.array([templates[n] for n in self.names], pa.string()))
        self.sets, classes = [], {}
        for number, (low, high) in enumerate(zip(first[:-1], first[1:])):
            if high - low < SHINGLE:
                raise ValueError(f"template {self.names[number]} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(windows(hashes[low:high], SHINGLE)))
            size = LEAST_WINDOW
            while size < 2 * (high - low):
                size *= 2
            classes.setdefault(size, []).append(number)
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        # By window size: for each band the template's least values, with the template's number.
        self.classes = {size: (numbers, np.array([self.sign(self.sets[n]) for n in numbers])) for size, numbers in sorted(classes.items())}

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        return (self.factors[:, None] * shingles[None, :]).min(axis=1)

    def known(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.every):
            return np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.every, shingles), len(self.every) - 1)
        return self.every[at] == shingles

    def find(self, shingles: np.ndarray, known: np.ndarray, contained: float):
        """``template, first word, last word, containment`` of the copies in one text."""
        hits = np.flatnonzero(known)
        for size, (numbers, tables) in self.classes.items():
            width, step = size - SHINGLE + 1, size // 2
            best: dict[int, list] = {}
            # Windows that start at a multiple of half a window and hold a known shingle.
            wanted = {s for hit in (hits // step).tolist() for s in (hit, hit - 1) if s >= 0}
            for start in sorted(wanted):
                part = shingles[start * step : start * step + width]
                agree = (tables == self.sign(part)[None, :]).any(axis=1)
                for number in np.array(numbers)[agree].tolist():
                    own = np.isin(part, self.sets[number])
                    share = len(np.unique(part[own])) / len(self.sets[number])
                    if share >= contained:
                        places = np.flatnonzero(own) + start * step
                        best.setdefault(number, []).append((int(places[0]), int(places[-1]) + SHINGLE - 1, share))
            for number, found in best.items():
                kept: list = []
                for first, last, share in found:
                    if kept and first <= kept[-1][1]:
                        kept[-1] = (min(first, kept[-1][0]), max(last, kept[-1][1]), max(share, kept[-1][2]))
                    else:
                        kept.append((first, last, share))
                yield from ((number, *k) for k in kept)


FOUND = "doc_id long, license string, first_word long, last_word long, containment double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, bands: int = BANDS) -> DataFrame:
    """One row per copy of a template in a text; words are counted from 0."""
    templates = TEMPLATES if templates is None else templates

    def look(batches):
        index = TemplateIndex(templates, bands)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                hashes, first = index.hasher(part.column("text"))
                shingles = windows(hashes, SHINGLE)
                known, rows = index.known(shingles), []
                some = np.concatenate([[0], np.cumsum(known)])
                for doc, low, high in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    high = max(low, high - SHINGLE + 1)
                    if high > low and some[high] > some[low]:
                        rows.extend((doc, index.names[n], a, b, s) for n, a, b, s in index.find(shingles[low:high], known[low:high], contained))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(look, FOUND)
