"""Operator 6 - licence scanning: a trained paragraph classifier, confirmed by template comparison.

1. *Training paragraphs*: variants of the templates of every licence family (other versions, names, years, case, dropped
   words, ordinary words around) and, as the class *unknown*, paragraphs of the corpus that hold no licence word, plus
   ordinary sentences about licences.  Corpus paragraphs are a sample of at most ``MAX_UNKNOWN`` from about as many documents,
   chosen by hash: the only bounded sample of the operator.
2. *Classifier*: hashed word 1- to 3-grams, Spark's multinomial logistic regression.
3. *Calibration*: on paragraphs held out of the fit, a temperature makes the probabilities honest (least log loss), and the
   least probability is chosen at which no more than ``FALSE_SHARE`` of the accepted paragraphs are wrong; below it a
   paragraph is of the class unknown.
4. *Confirmation*: a predicted family stands only if one of its templates is found in the words judged: the longest common
   subsequence of words covers ``COVER`` of the template and holds the template's words that name the family (``NAMING``).  A notice of
   ``SHORT`` words or fewer must stand alone too: behind a claim of copyright, or with no sentence running on.

Paragraphs end at empty lines.  A notice may fill a paragraph, wrapped at any width, or one line of it, or stand anywhere in a long one, beside
another notice too.  So every line is judged, and every paragraph in overlapping windows of ``WINDOWS`` words; sums of weights along the text make all
of them cost about as much as one pass.  Of finds that overlap the one that matches most words of a template stays: the Affero notice holds all words of the plain one.
Every whole text is judged where it is read; nothing is shuffled.

Defined results: null and empty texts have no paragraphs; repeated rows are judged each; with an empty table the classifier
learns from its own examples alone; lines and paragraphs have no limit; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean
from . import textops as T

BITS = 14
GRAMS = (1, 2, 3)
MAX_UNKNOWN = 2_000
MAX_PARAGRAPH = 2_000  # bytes of a training paragraph; classified paragraphs have no limit
VARIANTS = 60
FALSE_SHARE = 0.005
COVER = 0.75
BELOW = COVER - 1e-6  # the share reported at most where nothing is confirmed
SHORT = 3  # notices of so few words are ordinary speech too: they must stand alone
WINDOWS = (12, 24, 64)  # words; windows start every half of that
SECOND = 0.1  # probability from which a further family of a window is compared with its templates
SEED = 5
UNKNOWN = "unknown"

# Short notices of licence families, in the words in which they are commonly written.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program", "Released under the GNU AGPL, version 3", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details"),
    "apache": ("Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "See the License for the specific language governing permissions and limitations under the License"),
    "artistic": ("Licensed under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0", "This is free software; you can redistribute it and/or modify it under the same terms as Perl itself", "Released under the Perl Artistic License"),
    "boost": ("Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD license", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal", "Dedicated to the public domain under CC0", "SPDX-License-Identifier: CC0-1.0"),
    "cddl": ("Licensed under the Common Development and Distribution License, Version 1.0", "SPDX-License-Identifier: CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License", "Released under the CDDL, version 1.1"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0", "Released under the EPL 1.0"),
    "eupl": ("Licensed under the EUPL, Version 1.2", "Licensed under the European Union Public Licence, version 1.2", "SPDX-License-Identifier: EUPL-1.2"),
    "gfdl": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "Licensed under the GNU Free Documentation License", "SPDX-License-Identifier: GFDL-1.3-or-later"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "Released under the GNU GPL, version 2", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program", "Licensed under the GPL, version 3", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "SPDX-License-Identifier: ISC", "provided that the above copyright notice and this permission notice appear in all copies", "Licensed under the ISC license", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "You should have received a copy of the GNU Lesser General Public License along with this library", "Released under the GNU LGPL, version 2.1", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "Released under the MPL 2.0"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: OFL-1.1", "Released under the SIL Open Font License"),
    "proprietary": ("All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "This software is proprietary and confidential", "No part of this publication may be reproduced without the prior written permission of the publisher"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "SPDX-License-Identifier: Unlicense"),
    "wtfpl": ("Do What The Fuck You Want To Public License", "Released under the WTFPL, version 2", "SPDX-License-Identifier: WTFPL", "Licensed under the WTFPL"),
    "zlib": ("Released under the zlib license", "SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
}

# The words by which a family is named.  A template that holds some of them is found only with all of these.
NAMING: dict[str, tuple[str, ...]] = {
    "agpl": ("affero", "agpl"), "apache": ("apache",), "artistic": ("artistic", "perl"), "boost": ("boost", "bsl"), "bsd": ("bsd",), "cc-by": ("cc", "by", "commons", "attribution"), "cc-by-nc": ("cc", "nc", "commons", "noncommercial"),
    "cc-by-sa": ("cc", "sa", "commons", "sharealike"), "cc0": ("universal", "waived", "domain"), "cddl": ("cddl", "development"), "epl": ("eclipse", "epl"), "eupl": ("eupl", "european"), "gfdl": ("gfdl", "documentation"), "gpl": ("gpl", "general"), "isc": ("isc",), "lgpl": ("lesser", "lgpl"),
    "mit": ("mit",), "mpl": ("mozilla", "mpl"), "ofl": ("ofl", "font"), "proprietary": ("proprietary", "unauthorized", "prohibited"), "unlicense": ("unlicense", "unencumbered"), "wtfpl": ("fuck", "wtfpl"), "zlib": ("zlib", "misrepresented"),
}

# Sentences with licence words that grant nothing.
ORDINARY = (
    "The driver showed a valid license to the officer", "He lost his fishing license last year", "A license is required to sell alcohol in this city", "The copyright office moved to another building",
    "She was granted permission to leave early", "The company released a new version of the software", "Apache helicopters were seen over the city", "The students of MIT built a new robot",
    "The public domain of the kings was sold", "The source code is available on request", "The mozilla foundation published its report", "This work took three years to finish",
    "All rights and duties pass to the heirs", "The terms of the contract were not met", "General public opinion changed in version two of the story", "You may not use this door after eight",
    "All rights reserved seats were sold out", "The program is distributed to the guests before the concert", "The eclipse was seen by the general public", "A boost to the local economy came with the new law", "The artistic director left under the terms of the contract",
)

_LICENCE_WORD = "(?i)licen[sc]e|licen[sc]ed|copyright|spdx|rights reserved|public domain|creative commons|free software|permission"
_SEPARATOR = re.compile(rb"[^a-z0-9\x80-\xff]+")
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = False
_GAP[97:123] = False
_GAP[128:] = False


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits; every word with a digit is ``0``."""
    return [b"0" if re.search(rb"[0-9]", w) else w for w in _SEPARATOR.split(text.lower()) if w]


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of the texts of a block (start, end, text), and for each n the hashed n-grams with the word each starts at."""
    low = T.lower(buf)
    s, e, doc = T.spans(_GAP[low], offs)
    h = T.span_hash(low, s, e)
    digit = np.concatenate(([0], np.cumsum((low >= 48) & (low <= 57))))
    h[digit[e] > digit[s]] = np.uint64(0x30)  # numbers are alike
    out = []
    for k in GRAMS:
        w, first = T.windows(h, doc, k) if k > 1 else (T.mix(h + np.uint64(1)), np.arange(len(h)))
        out.append(((w & np.uint64((1 << BITS) - 1)).astype(np.int64), first))
    return s, e, doc, out


def _one(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return np.concatenate([ids for ids, _ in grams(b, np.array([0, len(b)]))[3]])


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & at.get(w, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


_WORDS = {f: [(w, {x for x in w if x.decode() in NAMING[f]}) for w in (normal_words(t.encode()) for t in ts)] for f, ts in TEMPLATES.items()}
_ENDS = re.compile(rb"[ \t]*(?:$|[^a-z \t]|(?:and|by|except|for|in|to|under|unless|worldwide)\b)")
_CLAIM = re.compile(rb"copyright|\(c\)|\xc2\xa9", re.I)


def stands_alone(text: bytes, first: int, end: int) -> bool:
    """Whether the words from ``first`` to ``end`` may be a notice of their own: a claim of copyright goes before, or no sentence runs on behind."""
    return bool(_CLAIM.search(text[max(0, first - 80) : first]) or _ENDS.match(text[end : end + 24]))


def _matched(t: list[bytes], part: list[bytes]) -> list[int]:
    """Places in ``part`` of a longest common subsequence with ``t``."""
    size = [[0] * (len(part) + 1) for _ in range(len(t) + 1)]
    for i in range(len(t) - 1, -1, -1):
        for j in range(len(part) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if t[i] == part[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while size[i][j]:
        if t[i] == part[j]:
            out.append(j)
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def confirmed(family: str, words: list[bytes]) -> tuple[float, int, int, int]:
    """The largest share of a template of the family that the words hold in order, within a stretch of at most twice its length; and the matched
    words' number, first place and place after the last.  The words that name the family must be among them."""
    best = (0.0, 0, 0, len(words))
    for t, naming in _WORDS[family]:
        if not naming.issubset(words):
            continue
        span = 2 * len(t)
        held = set(t)
        for at in range(0, max(1, len(words) - len(t)), max(1, len(t))):  # stretches overlap by a template's length
            part = words[at : at + span]
            if len(held.intersection(part)) * 2 >= len(held):
                n = common_subsequence(t, part)
                if n >= COVER * len(t) and (n, n / len(t)) > (best[1], best[0]):
                    places = _matched(t, part)
                    if naming.issubset(part[k] for k in places):
                        best = (n / len(t), n, at + places[0], at + places[-1] + 1)
                elif best[1] == 0:
                    best = (min(max(best[0], n / len(t)), BELOW), 0, 0, len(words))
    return best


# --- training -------------------------------------------------------------------------------------------------


def examples(corpus: list[str], seed: int = SEED) -> list[tuple[str, str]]:
    """``(paragraph, family)``: variants of the templates, ordinary sentences, and corpus paragraphs as unknown."""
    r = random.Random(seed)
    filler = sorted({w for p in corpus[:200] for w in p.split()[:8]}) or ["the", "and", "of", "to", "value"]
    some = lambda k: " ".join(r.choice(filler) for _ in range(k))

    def vary(text: str, naming: tuple[str, ...] = ()) -> str:
        words = text.split()
        if len(words) > 6:
            words = [w for w in words if r.random() > 0.06 or w.lower().strip(",.;") in naming]
        out = " ".join(words)
        out = re.sub(r"\d(\.\d)?", lambda m: r.choice([m.group(), "1.0", "2", "3.0", "4.0"]), out)
        if r.random() < 0.3:
            out = f"Copyright (c) {r.randint(1990, 2029)} {some(2).title()}. {out}"
        if r.random() < 0.4:
            out = f"{some(r.randint(1, 12))} {out}" if r.random() < 0.5 else f"{out} {some(r.randint(1, 12))}"
        return r.choice([out, out, out + ".", out.upper(), "# " + out, "// " + out])

    rows = [(vary(t, NAMING[f]), f) for f, ts in sorted(TEMPLATES.items()) for t in ts for _ in range(VARIANTS)]
    rows += [(vary(t), UNKNOWN) for t in ORDINARY for _ in range(VARIANTS // 2)]
    rows += [(p, UNKNOWN) for p in corpus]
    return rows


@dataclass
class Classifier:
    families: list[str]  # unknown is the last
    weights: np.ndarray  # n-gram x family
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def logits(self, n_words: int, held: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the windows of words i to j - 1: sums of the weights of the n-grams inside, scaled by their number as in training."""
        out, count = np.zeros((len(i), len(self.families))), np.zeros(len(i), np.int64)
        for k, (ids, first) in zip(GRAMS, held, strict=True):
            up = np.zeros((n_words + 1, len(self.families)))
            up[first + 1] = self.weights[ids]
            np.cumsum(up, axis=0, out=up)
            end = np.maximum(j - k + 1, i)
            out += up[end] - up[i]
            count += end - i
        return out / np.sqrt(np.maximum(count, 1))[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(spark: SparkSession, rows: list[tuple[str, str]], seed: int = SEED) -> Classifier:
    """Fit and calibrate on labelled paragraphs; a quarter of them is held out for the calibration."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = sorted(set(rows))
    random.Random(seed).shuffle(rows)
    families = [*sorted({f for _, f in rows} - {UNKNOWN}), UNKNOWN]
    number = {f: float(k) for k, f in enumerate(families)}

    def vector(text: str):
        ids, k = np.unique(_one(text), return_counts=True)
        return Vectors.sparse(1 << BITS, ids.tolist(), (k / np.sqrt(max(1, k.sum()))).tolist())

    held, fitted = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    data = spark.createDataFrame([(number[f], vector(t)) for t, f in fitted], ["label", "features"]).coalesce(2)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, standardization=False).fit(data)
    out = Classifier(families, np.ascontiguousarray(model.coefficientMatrix.toArray().T.astype(np.float32)), model.interceptVector.toArray())

    y = np.array([int(number[f]) for _, f in held])
    whole = lambda n, g: out.logits(n, g, np.array([0]), np.array([n]))[0]
    logits = np.array([whole(len(g[0]), g[3]) for g in (grams(b, np.array([0, len(b)])) for b in (np.frombuffer(t.encode(), np.uint8) for t, _ in held))])
    grid = np.geomspace(0.25, 8, 41)
    loss = []
    for out.temperature in grid.tolist():
        loss.append(-np.log(np.maximum(out.probabilities(logits)[np.arange(len(y)), y], 1e-300)).mean())
    out.temperature = float(grid[int(np.argmin(loss))])
    p = out.probabilities(logits)
    best, top = p[:, :-1].argmax(1), p[:, :-1].max(1)
    order = np.argsort(-top)
    wrong = np.cumsum(best[order] != y[order])
    good = np.flatnonzero(wrong <= FALSE_SHARE * np.arange(1, len(order) + 1))
    out.least = float(min(0.9, max(0.5, top[order][good[-1]]))) if len(good) else 0.9
    return out


def default_classifier(docs: DataFrame, text: str = "text") -> Classifier:
    """A classifier for this corpus: its unknown class is learnt from paragraphs of the corpus."""
    body = F.col(text).cast("string")
    every = max(1, docs.count() // MAX_UNKNOWN)  # about MAX_UNKNOWN documents by the hash of their text, of however many
    some = docs.select(body.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    lines = some.select(F.explode(F.split("t", "\n")).alias("p")).where((F.length(F.trim("p")) > 0) & (F.octet_length("p") <= MAX_PARAGRAPH) & ~F.col("p").rlike(_LICENCE_WORD))
    rows = lines.orderBy(F.xxhash64("p"), "p").limit(MAX_UNKNOWN).collect()
    return train(docs.sparkSession, examples([r["p"] for r in rows]))


# --- the operator ---------------------------------------------------------------------------------------------


def _windows(buf: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges (first, after the last) of all lines and of the windows of all paragraphs, each range once, and the first word of every
    paragraph."""
    breaks = np.concatenate(([0], np.cumsum(buf == 0x0A)))[s]
    step = np.diff(breaks)
    other = doc[1:] != doc[:-1]
    edges = lambda new: np.flatnonzero(np.concatenate(([True], new)))
    lines, paragraphs = edges((step > 0) | other), edges((step > 1) | other)
    pairs = [np.stack((lines, np.append(lines[1:], len(s))))]
    begin, end = paragraphs, np.append(paragraphs[1:], len(s))
    for width in WINDOWS:
        half = width // 2
        n = np.maximum(1, -(-(end - begin - half) // half))  # windows until the end is reached
        at = np.repeat(begin, n) + half * (np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n))
        pairs.append(np.stack((at, np.minimum(at + width, np.repeat(end, n)))))
    i, j = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return i, j, paragraphs


def block_findings(classifier: Classifier, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, str, float, float]]]:
    """Paragraphs per text, and ``(text, start, end, family, probability, cover)`` of the places that a licence claims, the best one of
    those that overlap."""
    s, e, doc, held = grams(buf, offs)
    if not len(s):
        return np.zeros(len(offs) - 1, np.int64), []
    i, j, paragraphs = _windows(buf, s, doc)
    p = classifier.probabilities(classifier.logits(len(s), held, i, j))
    raw = buf.tobytes()
    found: dict[int, list[tuple]] = {}
    for k in np.flatnonzero(1 - p[:, -1] >= classifier.least).tolist():
        first, top = int(i[k]), int(p[k, :-1].argmax())
        words = normal_words(raw[s[first] : e[j[k] - 1]])
        for f in {top, *np.flatnonzero(p[k, :-1] >= SECOND).tolist()}:
            cover, n, a, z = confirmed(classifier.families[f], words)
            if 0 < n <= SHORT and not stands_alone(raw, int(s[first + a]), int(e[first + z - 1])):
                cover, n, a, z = BELOW, 0, 0, len(words)
            if f == top or cover >= COVER:
                found.setdefault(int(doc[first]), []).append((-n, -cover, -float(p[k, f]), classifier.families[f], int(s[first + a]), int(e[first + z - 1])))
    out = []
    for d, places in found.items():
        kept: list[tuple] = []
        for x in sorted(places):
            if all(x[5] <= y[4] or x[4] >= y[5] for y in kept):
                kept.append(x)
        out += [(d, a, z, family, -prob, -cover) for _, cover, prob, family, a, z in kept]
    return np.bincount(doc[paragraphs], minlength=len(offs) - 1), sorted(out)


def scan_licences(docs: DataFrame, classifier: Classifier | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, n_unconfirmed, families, findings`` of every row.  ``families``: the distinct confirmed families in
    order; ``findings``: confirmed ``(start, end, family, probability, cover)`` with byte offsets."""
    classifier = classifier or default_classifier(docs, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in T.blocks(batch.column(1)):
                n = j - i
                paragraphs, found = block_findings(classifier, buf, offs)
                held, doubt = [[] for _ in range(n)], np.zeros(n, np.int64)
                for d, a, z, family, p, cover in found:
                    if cover >= COVER:
                        held[d].append({"start": a - int(offs[d]), "end": z - int(offs[d]), "family": family, "probability": p, "cover": cover})
                    else:
                        doubt[d] += 1
                names = [sorted({x["family"] for x in h}) for h in held]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(paragraphs), pa.array(doubt), pa.array(names, pa.list_(pa.string())), pa.array(held, pa.list_(item))], names=["doc_id", "n_paragraphs", "n_unconfirmed", "families", "findings"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean.batches(run), f"doc_id {kind}, n_paragraphs long, n_unconfirmed long, families array<string>, findings array<struct<start:bigint,end:bigint,family:string,probability:double,cover:double>>")
