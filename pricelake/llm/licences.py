"""Licence scans: a trained paragraph classifier names the licence family, a comparison with its templates confirms it."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Notices by licence family (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is available under the Apache 2.0 license. SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT). This project is licensed under the terms of the MIT license. SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GNU GPL version 2. Released under the GPL v3. SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. Released under the LGPL. SPDX-License-Identifier: LGPL-2.1",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation. Released under the AGPL. SPDX-License-Identifier: AGPL-3.0",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/. SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Licensed under the ISC License. SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "Public-Domain": (
        "Released into the public domain under CC0 1.0. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}

#: Sentences with licence words that grant nothing (fixed values).
OTHER = (
    "She renewed her driving license at the town hall last week.", "The restaurant lost its liquor license after the inspection.", "A fishing license costs ten dollars and is valid for a year.",
    "The warranty of the device covers two years of normal use.", "The university public library opens at nine.", "Creative work needs common sense and attribution of sources.",
    "Please read the terms and conditions before you sign.", "The software version 2.0 was distributed to all members.", "The general public is free to visit the foundation.",
    "The apache helicopter landed near the base.", "He studied at MIT and works in software now.", "The following conditions are met only in summer.",
)

UNKNOWN = "unknown"
CLASSES = (UNKNOWN, *TEMPLATES)
#: The class of a notice that is a licence's, but of none of the families.
OTHER_LICENCE = len(CLASSES)
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"[^\n]*[^\s][^\n]*")
_SENTENCE = re.compile(r"\S.*?(?:[.!?;:](?=\s)|$)", re.S)


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences of each line that isn't blank: what is classified at a time, however long the line is."""
    return [(line.start() + s.start(), line.start() + s.end()) for line in _LINE.finditer(text) for s in _SENTENCE.finditer(line[0])]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def similarity(words: list[str], family: str) -> float:
    """The share of a paragraph's word pairs that one of the family's templates has."""
    own = set(zip(words, words[1:]))
    return max((len(own & t) / len(own) for t in _template_pairs(family)), default=0.0) if own else 0.0


def _template_pairs(family: str) -> list[set[tuple[str, str]]]:
    if family not in _pairs:
        _pairs[family] = [set(zip(w, w[1:])) for w in map(words_of, TEMPLATES.get(family, ()))]
    return _pairs[family]


_pairs: dict[str, list[set[tuple[str, str]]]] = {}


@dataclass
class LicenceModel:
    """Weights of words and word pairs, and how probabilities are calibrated."""

    vocabulary: dict[str, int]
    pair_keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def features(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, feature) of each known word and pair, once, and how many words and pairs each unit has at all."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        ids = np.fromiter((i for u in units for i in map(self.vocabulary.get, u, repeat(-1))), np.int64, int(n.sum()))
        unit = np.repeat(np.arange(len(units)), n)
        known = np.flatnonzero(ids >= 0)
        two = known[:-1][(known[1:] == known[:-1] + 1) & (unit[known[1:]] == unit[known[:-1]])] if len(known) > 1 else known[:0]
        key = ids[two] * len(self.vocabulary) + ids[two + 1]
        k = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        hit = self.pair_keys[k] == key if len(self.pair_keys) else np.zeros(0, bool)
        size = len(self.vocabulary) + len(self.pair_keys)
        once = np.unique(np.concatenate([unit[known] * size + ids[known], unit[two[hit]] * size + len(self.vocabulary) + k[hit]]))
        return once // max(1, size), once % max(1, size), np.maximum(1, 2 * n - 1)

    def logits(self, units: list[list[str]]) -> np.ndarray:
        unit, feature, total = self.features(units)
        order = np.argsort(unit, kind="stable")
        z = np.zeros((len(units), len(CLASSES)))
        if len(order):
            rows, first = np.unique(unit[order], return_index=True)
            z[rows] = np.add.reduceat(self.weights[feature[order]], first, axis=0) / np.sqrt(total[rows])[:, None]
        return z + self.bias

    def probabilities(self, units: list[list[str]]) -> np.ndarray:
        return _softmax(self.logits(units) / self.temperature)

    def families(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The class of each unit and its probability.

        A family from the threshold on; OTHER where that much speaks for some
        licence but not for one of the families; else UNKNOWN.
        """
        p = self.probabilities(units)
        best = p.argmax(axis=1)
        sure, some = p.max(axis=1), 1 - p[:, 0]
        found = np.where(sure >= self.threshold, best, np.where((best > 0) & (some >= self.threshold), OTHER_LICENCE, 0))
        return found, np.where(found == OTHER_LICENCE, some, p[np.arange(len(p)), np.minimum(found, len(CLASSES) - 1)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(ordinary: list[str], variants: int = 60) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Word lists, classes, and which are held out: templates, their sentences, stretches and edited forms; ordinary paragraphs and look-alikes as unknown.

    All that comes from a family's last template is held out, if it has
    several, and every fifth unknown example: calibration never sees an edit of
    a template that was trained on.
    """
    draw, units, labels, held = random.Random(7), [], [], []
    filler = sorted({w for t in ordinary[:200] for w in words_of(t)}) or ["holder"]
    every = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})

    def add(words: list[str], family: str, out: bool | None = None) -> None:
        if words:
            units.append(words)
            labels.append(CLASSES.index(family))
            held.append(len(units) % 5 == 4 if out is None else out)

    for family, templates in TEMPLATES.items():
        for t in templates:
            out = len(templates) > 1 and t == templates[-1]
            parts = [words_of(t)] + [w for m in _SENTENCE.finditer(t) if len(w := words_of(m[0])) > 3]
            for _ in range(variants):
                w = list(draw.choice(parts))
                if len(w) > 10 and draw.random() < 0.6:
                    at = draw.randrange(len(w) - 8)
                    w = w[at : at + draw.randint(8, 30)]
                w = [x for x in w if draw.random() > 0.05]
                for _ in range(draw.randrange(3)):
                    w.insert(draw.randrange(len(w) + 1), draw.choice(filler))
                if draw.random() < 0.2:
                    w = ["copyright", "c", str(draw.randint(1990, 2030)), draw.choice(filler), *w]
                add(w, family, out)
            for p in parts:
                add(p, family, out)
    for t in ordinary:
        add(words_of(t), UNKNOWN)
    for w in every:  # one or two words alone say nothing
        add([w], UNKNOWN)
        add([w, draw.choice(filler)], UNKNOWN)
    for _ in range(variants // 3):
        for t in OTHER:
            add([x for x in words_of(t) if draw.random() > 0.05], UNKNOWN)
        for _ in range(12):  # licence words in no order, among ordinary ones
            add([draw.choice(every if draw.random() < 0.4 else filler) for _ in range(draw.randint(4, 30))], UNKNOWN)
    return units, np.array(labels), np.array(held)


def fit(ordinary: list[str], rounds: int = 120, rate: float = 0.4, ridge: float = 1e-4) -> LicenceModel:
    """Multinomial logistic regression on all examples; temperature and threshold from one without the held-out ones.

    ``ordinary`` are paragraphs without a licence.  The temperature makes the
    held-out probabilities fit best; the threshold is the least of 0.5 to 0.95
    at which no more than one in a thousand held-out unknown paragraphs gets a
    family.
    """
    ordinary = [t for t in ordinary if all(similarity(words_of(t), f) < 0.3 for f in TEMPLATES)]
    units, labels, held = examples(ordinary)
    first = _trained(units, labels, ~held, rounds, rate, ridge)
    z, own = first.logits([units[i] for i in np.flatnonzero(held)]), labels[held]
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(own)), own], 1e-12)).mean() for t in np.geomspace(0.25, 4, 33)}
    m = _trained(units, labels, np.ones(len(units), bool), rounds, rate, ridge)
    m.temperature = float(min(loss, key=loss.get))
    p = _softmax(z / m.temperature)[own == 0]
    wrong = lambda t: ((p.argmax(axis=1) > 0) & (p.max(axis=1) >= t)).mean() if len(p) else 0.0
    m.threshold = next((t for t in np.arange(0.5, 0.95, 0.05) if wrong(t) <= 0.001), 0.95)
    return m


def _trained(units: list[list[str]], labels: np.ndarray, used: np.ndarray, rounds: int, rate: float, ridge: float) -> LicenceModel:
    """Weights by Adam on the ``used`` examples; the vocabulary is theirs too."""
    units, labels = [u for u, k in zip(units, used) if k], labels[used]
    vocabulary: dict[str, int] = {}
    for u, y in zip(units, labels):
        if y:
            for w in u:
                vocabulary.setdefault(w, len(vocabulary))
    known = [[vocabulary[w] for w in u if w in vocabulary] if y else [] for u, y in zip(units, labels)]
    keys = sorted({a * len(vocabulary) + b for u in known for a, b in zip(u, u[1:])})
    k = len(CLASSES)
    m = LicenceModel(vocabulary, np.array(keys, np.int64), np.zeros((len(vocabulary) + len(keys), k)), np.zeros(k))
    unit, feature, total = m.features(units)
    y = np.eye(k)[labels]
    scale = (1 / np.sqrt(total))[unit][:, None]
    by_unit, by_feature = np.argsort(unit, kind="stable"), np.argsort(feature, kind="stable")
    u_rows, u_first = np.unique(unit[by_unit], return_index=True)
    f_rows, f_first = np.unique(feature[by_feature], return_index=True)
    moments = [np.zeros_like(m.weights), np.zeros_like(m.weights), np.zeros(k), np.zeros(k)]
    for step in range(1, rounds + 1):
        z = np.zeros((len(units), k))
        z[u_rows] = np.add.reduceat((m.weights[feature] * scale)[by_unit], u_first, axis=0)
        g = (_softmax(z + m.bias) - y) / len(units)
        gw = ridge * m.weights
        gw[f_rows] += np.add.reduceat((g[unit] * scale)[by_feature], f_first, axis=0)
        for at, (w, d) in enumerate(((m.weights, gw), (m.bias, g.sum(axis=0)))):
            moments[2 * at] = 0.9 * moments[2 * at] + 0.1 * d
            moments[2 * at + 1] = 0.99 * moments[2 * at + 1] + 0.01 * d * d
            w -= rate * (moments[2 * at] / (1 - 0.9**step)) / (np.sqrt(moments[2 * at + 1] / (1 - 0.99**step)) + 1e-8)
    return m


def ordinary_sample(docs: DataFrame, documents: int = 200, text_col: str = "text") -> list[str]:
    """Paragraphs of at most so many documents, chosen by a hash of the text: the classifier's ordinary paragraphs.

    This bounded sample is all that reaches the driver, 4,000 paragraphs at
    most; the scan itself reads everything.
    """
    picked = docs.select(docs[text_col].alias("text")).where("text is not null").orderBy(F.xxhash64("text", F.lit(11))).limit(documents)
    out = [text[lo:hi] for (text,) in picked.toLocalIterator() for lo, hi in paragraphs(text)]
    return sorted(out)[:: max(1, -(-len(out) // 4000))]


_SCHEMA = "doc_id bigint, start bigint, end bigint, family string, probability double, similarity double, confirmed boolean, passage string"


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, family, probability, similarity, confirmed, passage: one row for each licence notice found.

    Each sentence of the whole text is classified; neighbours of one family
    make one notice, whose probability is the largest.  A licence of none of
    the families is a notice of family `unknown`.  `similarity` is the share of
    the notice's word pairs that a template of the family has (of any family
    for `unknown`), and `confirmed` whether it is ``least`` or more and the
    family is known.  Other sentences give no row.  `start` and `end` are
    characters of the text.

    Rows are scanned where they are read; nothing is shuffled.  Null, empty
    and wordless texts give no row; very long texts are scanned whole, sentence
    by sentence; repeated rows are scanned each and a null
    id stays null; other columns are ignored, an empty table gives an empty
    result.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                spans = paragraphs(text)
                if not spans:
                    continue
                units = [words_of(text[lo:hi]) for lo, hi in spans]
                family, p = model.families(units)
                for first, end in _runs(family):
                    known = family[first] < OTHER_LICENCE
                    name = CLASSES[family[first]] if known else UNKNOWN
                    lo, hi = spans[first][0], spans[end - 1][1]
                    words = [w for u in units[first:end] for w in u]
                    sim = similarity(words, name) if known else max(similarity(words, f) for f in TEMPLATES)
                    out.append((doc, lo, hi, name, float(p[first:end].max()), sim, bool(known and sim >= least), text[lo:hi]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def _runs(family: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each stretch of one family that isn't unknown."""
    cuts = np.flatnonzero(np.diff(family, prepend=-1, append=-1))
    return ((int(a), int(b)) for a, b in zip(cuts, cuts[1:]) if family[a])
