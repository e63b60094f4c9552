"""Licence statements in documents: a trained paragraph classifier, confirmed by comparison with templates.

Sparse word one- and two-grams go through multinomial logistic regression over the licence families, ``unknown`` (a statement
of rights of no known family) and ``none``. It learns from the templates and seeded variations and fragments of them, from
invented and other licences as ``unknown``, and from a bounded sample of the corpus's own lines as ``none``. A first fit leaves
whole templates out; the temperature that suits them best calibrates the probabilities of the final fit over all.

Every line is judged by the classifier alone. Neighbouring lines that may belong to a statement, with no blank line nor end of a
sentence between them, are one wrapped paragraph and judged together. A known family must also resemble one of its templates (the
share of two-grams in common, of the shorter of both); what is likely a statement but confirmed for no family is ``unknown``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, pieces

_TOKEN = re.compile(r"[a-z0-9]+|\n|[.!?](?=[ \t\r]*(?:\n|\Z))")

#: The usual short notices of each family.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the AGPL v3 license.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0", "License: Apache 2.0",
    ],
    "bsd": [
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-2-Clause",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Released under the Boost Software License 1.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Text available under the Creative Commons Attribution license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "Released under CC0."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "License: GPLv3",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Released under the ISC License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "License: LGPL v3"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT", "License: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
}
#: Statements of rights that name no family above.
OTHER_STATEMENTS = [
    "All rights reserved.", "Copyright the author. All rights reserved.", "Copyright 2021 Jane Doe", "Copyright (c) 2015-2020 The Example Project Authors.", "Use of this work is governed by the license agreement of its owner.",
    "Released under a proprietary license.", "No part of this publication may be reproduced without prior written permission.", "Licensed for personal use only.", "Unauthorized copying of this file is strictly prohibited.",
    "Licensed under the European Union Public Licence, version 1.2.", "License: EUPL-1.2", "SPDX-License-Identifier: CDDL-1.0", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Do what you want to public license.", "Distributed under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Zlib", "The contents of this file are subject to the terms of the Common Development and Distribution License.",
]
#: How the families are called.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public", "AGPL v3", "GNU AGPL version 3"], "apache-2.0": ["Apache", "Apache 2.0", "Apache version 2.0"], "bsd": ["BSD", "BSD 3-clause", "2-clause BSD", "BSD-style"], "bsl-1.0": ["Boost Software", "Boost"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"], "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"], "cc0": ["CC0", "CC0 1.0 public domain"],
    "epl-2.0": ["Eclipse Public", "EPL 2.0"], "gpl": ["GNU General Public", "GNU GPL version 3", "GPL v2", "GNU GPL"], "isc": ["ISC"], "lgpl": ["GNU Lesser General Public", "LGPL v2.1", "GNU LGPL version 3"], "mit": ["MIT", "Expat MIT"], "mpl-2.0": ["Mozilla Public", "MPL 2.0"], "unlicense": ["Unlicense"],
}
#: Parts of invented licence names, for statements of families that nobody knows.
INVENTED = (["Example", "Open", "Widget", "Harbour", "Meadow", "Northern", "Quartz", "Lantern", "Common", "Granite"], ["Community", "Foundation", "Data", "Works", "Public", "Software", "Content", "Research"])
#: What statements say of a licence, known or not.
FORMS = ["Licensed under the {} License.", "Released under the {} License, version 2.", "This work may be used under the terms of the {} License.", "This work is licensed under {}", "Distributed under the {} license", "License: {}", "SPDX-License-Identifier: {}"]
#: A sampled line with one of these words may be a statement and doesn't teach ``none``.
CUES = {"license", "licence", "licensed", "licenced", "copyright", "rights", "permission", "spdx", "redistribution", "copyleft", "gpl", "cc0"}


def words_of(text: str) -> list[str]:
    return [w for w in _TOKEN.findall(text.lower()) if w.isalnum()]


def lines_of(text: str | None) -> list[tuple[int, list[str], bool]]:
    """(line, words, whether a sentence ends there) of the lines with a word of ASCII letters or digits."""
    out, line, words, ended = [], 0, [], False
    for t in _TOKEN.findall((text or "").lower()):
        if t == "\n":
            if words:
                out.append((line, words, ended))
            line, words, ended = line + 1, [], False
        elif t in ".!?":
            ended = True
        else:
            words.append(t)
    return [*out, (line, words, ended)] if words else out


#: A line of more than ``WINDOW`` words is also read in windows of so many, every ``STEP`` words.
WINDOW, STEP = 12, 4


class Classifier:
    """Weights of known one- and two-grams by class; everything else in a paragraph counts only through its length."""

    def __init__(self, families: list[str], texts: list[list[str]], templates: dict[str, list[list[str]]]):
        self.classes = [*families, "unknown", "none"]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        n = len(self.vocabulary)
        self.pairs = np.unique([self.vocabulary[a] * n + self.vocabulary[b] for t in texts for a, b in zip(t, t[1:])])
        self.w = np.zeros((n + len(self.pairs) + 1, len(self.classes)))  # the last row is the intercept
        self.temperature = 1.0
        self.templates = {f: [set(zip(t, t[1:])) or {tuple(t)} for t in templates[f]] for f in families}

    def bags(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, gram, weight): each known gram once, weighted so that a paragraph's grams, known or not, have length 1."""
        get, size, n = self.vocabulary.get, len(self.w), len(self.vocabulary)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.array([get(w, -1) for t in texts for w in t], np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        one = ids >= 0
        both = np.flatnonzero(one[:-1] & one[1:] & (doc[:-1] == doc[1:])) if len(ids) else np.zeros(0, np.int64)
        pair = ids[both] * n + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[at] == pair
        keys = np.unique(np.concatenate([doc[one] * size + ids[one], doc[both[known]] * size + n + at[known]]))
        doc = keys // size
        return doc, keys % size, 1 / np.sqrt(np.maximum(2 * lengths - 1, 1))[doc]

    def logits(self, doc: np.ndarray, gram: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(self.w[-1], (n, 1))
        if len(doc):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[first]] += np.add.reduceat(self.w[gram] * x[:, None], first, axis=0)
        return out

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        return _softmax(self.logits(*self.bags(texts), len(texts)) / self.temperature)

    def fit(self, doc: np.ndarray, gram: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.2, l2: float = 1e-5) -> None:
        """Adam; rows of weight 0 are left out."""
        self.w[:] = 0
        target, weight = np.eye(len(self.classes))[y], weight / weight.sum()
        m, s = np.zeros_like(self.w), np.zeros_like(self.w)
        by = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.diff(gram[by], prepend=-1))
        for step in range(1, rounds + 1):
            g = (_softmax(self.logits(doc, gram, x, len(y))) - target) * weight[:, None]
            grad = l2 * self.w
            grad[gram[by][first]] += np.add.reduceat((g[doc] * x[:, None])[by], first, axis=0)
            grad[-1] += g.sum(axis=0)
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            self.w = self.w - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, doc: np.ndarray, gram: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least loss on rows of positive weight."""
        raw, weight = self.logits(doc, gram, x, len(y)), weight / weight.sum()
        loss = {t: -(weight * np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12))).sum() for t in np.geomspace(0.25, 8, 41)}
        self.temperature = float(min(loss, key=loss.get))

    def resemblance(self, family: str, words: list[str]) -> float:
        own = set(zip(words, words[1:])) or {tuple(words)}
        return max(len(own & g) / min(len(own), len(g)) for g in self.templates[family])

    def known(self, words: list[str]) -> list[bool]:
        """Whether each two words in a row stand so in any statement that was learnt."""
        n, ids = len(self.vocabulary), [self.vocabulary.get(w, -1) for w in words]
        pairs = np.array([a * n + b if a >= 0 and b >= 0 else -1 for a, b in zip(ids, ids[1:])], np.int64)
        return np.isin(pairs, self.pairs).tolist()

    def nones(self, texts: list[list[str]]) -> np.ndarray:
        """The probability that each is no statement."""
        parts = [self.probabilities(texts[a : a + 50_000])[:, -1] for a in range(0, len(texts), 50_000)]
        return np.concatenate([np.zeros(0), *parts])

    def inside(self, lines: list[tuple], sure: float, hint: float) -> list[tuple]:
        """Statements inside lines whose other words drown them, as lines cut to a statement's words.

        A run of windows that each hint at one gives its best window, without the words at its ends that make it less certain. As a long
        line is tried many times, three quarters of the word pairs in what is left, and two at least, have to be of statements.
        """
        windows = [(x, x[2][at : at + WINDOW]) for x in lines for at in range(0, len(x[2]) - WINDOW + STEP, STEP)]
        none = self.nones([w for _, w in windows])
        runs: list[list[int]] = []
        for k in np.flatnonzero(1 - none >= hint).tolist():
            if runs and runs[-1][-1] == k - 1 and windows[k][0] is windows[k - 1][0]:
                runs[-1].append(k)
            else:
                runs.append([k])
        out = []
        for run in runs:
            x, words = windows[min(run, key=lambda k: none[k])]
            known = self.known(words)
            cuts = [words[a:b] for a in range(len(words) - 2) for b in range(a + 3, len(words) + 1) if sum(known[a : b - 1]) >= max(2, 0.75 * (b - 1 - a))]
            if not cuts:
                continue
            p, _, words = min((p, len(c), c) for p, c in zip(self.nones(cuts).tolist(), cuts))
            if 1 - p >= sure:
                out.append((x[0], x[1], words, True))
        return out

    def statements(self, texts: list[str | None], least: float, resemblance: float, suspect: float, sure: float = 0.6, hint: float = 0.05) -> list[list[tuple[int, str, float, float]]]:
        """(first line, family or unknown, probability of the family or of a statement, resemblance) of each text's statements."""
        lines = [(k, *x) for k, t in enumerate(texts) for x in lines_of(t)]
        out: list = [[] for _ in texts]
        if not lines:
            return out
        none = self.nones([x[2] for x in lines])
        groups: list[list[tuple]] = []
        last: tuple | None = None
        for k in np.flatnonzero(1 - none >= suspect).tolist():
            x = lines[k]
            if last is not None and last[0] == x[0] and last[1] + 1 == x[1] and not last[3]:
                groups[-1].append(x)
            else:
                groups.append([x])
            last = x
        told = self._judged(groups, out, least, resemblance)
        long = [x for x in lines if len(x[2]) > WINDOW and (x[0], x[1]) not in told]
        self._judged([[x] for x in self.inside(long, sure, hint)], out, least, resemblance)
        return [sorted(x) for x in out]

    def _judged(self, groups: list[list[tuple]], out: list, least: float, resemblance: float) -> set[tuple[int, int]]:
        """Adds the statements among groups of lines to those of their texts; returns the lines that they take up."""
        told: set[tuple[int, int]] = set()
        if not groups:
            return told
        whole = [[w for x in g for w in x[2]] for g in groups]
        for g, words, p in zip(groups, whole, self.probabilities(whole)):
            if 1 - p[-1] < least:
                continue
            best = int(p[:-1].argmax())
            name, like = self.classes[best], 0.0
            if name != "unknown":
                like = self.resemblance(name, words)
            known = name != "unknown" and p[best] >= least * (1 - p[-1]) and like >= resemblance
            out[g[0][0]].append((g[0][1], name, float(p[best]), like) if known else (g[0][1], "unknown", float(1 - p[-1]), like))
            told |= {(x[0], x[1]) for x in g}
        return told


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _varied(words: list[str], rng: np.random.Generator, filler: list[list[str]]) -> list[str]:
    """Words lost, a fragment, or other words around."""
    if len(words) > 12 and rng.random() < 0.5:
        n = int(rng.integers(8, len(words) + 1))
        at = int(rng.integers(0, len(words) - n + 1))
        words = words[at : at + n]
    words = [w for w in words if rng.random() > 0.06] or words
    if rng.random() < 0.2:
        words = [w.replace("licens", "licenc") for w in words]
    if filler and rng.random() < 0.4:
        more = filler[int(rng.integers(len(filler)))][: int(rng.integers(2, 12))]
        words = [*more, *words] if rng.random() < 0.5 else [*words, *more]
    return words


def _sampled_lines(docs: DataFrame, id_col: str, text_col: str, sample_rows: int, max_lines: int) -> list[list[str]]:
    """Whole lines without a cue word, of at most ``sample_rows`` documents; ``max_lines`` of them by their hash, each once."""
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(F.col(text_col).alias("text"))

    def run(it):
        for (texts,) in batches(it, "text"):
            lines = {" ".join(w) for t in texts for _, w, _ in lines_of(t) if CUES.isdisjoint(w)}
            yield pa.record_batch([pa.array(sorted(lines), pa.string())], names=["line"])

    found = rows.mapInArrow(run, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(max_lines)
    return [r[0].split(" ") for r in found.collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2_000, max_lines: int = 10_000, variations: int = 60, none_weight: float = 4.0, seed: int = 11) -> Classifier:
    """A classifier learnt from the templates and at most ``max_lines`` distinct whole lines of at most ``sample_rows`` documents.

    Documents and lines are chosen by hashes; lines with a cue word teach nothing. An empty table leaves ``none`` to its prior.
    """
    plain = _sampled_lines(docs, id_col, text_col, sample_rows, max_lines)
    rng, families = np.random.default_rng(seed), sorted(TEMPLATES)
    sources = {f: [words_of(t) for t in [*(x.format(n) for n in NAMES[f] for x in FORMS), *TEMPLATES[f]]] for f in families}
    names = [f"{a} {b}" for a in INVENTED[0] for b in INVENTED[1]]
    sources["unknown"] = [words_of(t) for t in [*(FORMS[k % len(FORMS)].format(n) for k, n in enumerate(names)), *OTHER_STATEMENTS]]
    rows: list[tuple[list[str], int, bool]] = []
    for k, (name, base) in enumerate(sources.items()):
        for i in range(max(variations, 4 * len(base))):
            t = base[i % len(base)]
            rows.append((t if i < len(base) else _varied(t, rng, plain), k, i % len(base) == len(base) - 1 or name == "unknown" and i % 4 == 3))
        rows += [(t[a : a + 12], k, False) for t in base if len(t) > 20 for a in range(0, len(t) - 8, 6)]  # lines of long notices
    rows += [(t, len(sources), i % 4 == 3) for i, t in enumerate(plain)]
    texts, y, apart = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = Classifier(families, [t for base in sources.values() for t in base], sources)
    bags = out.bags(texts)

    def weights(on):
        # statements are rare: none weighs several times as much as all their classes together
        each = np.where(on, 1 / np.maximum(np.bincount(y[on], minlength=len(sources) + 1), 1)[y], 0.0)
        return np.where(y == len(sources), each * len(sources) * none_weight, each)

    out.fit(*bags, y, weights(~apart))
    out.calibrate(*bags, y, weights(apart))
    out.fit(*bags, y, weights(np.ones(len(y), bool)))
    return out


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, resemblance: float = 0.5, suspect: float = 0.2) -> DataFrame:
    """(id, family, line, probability, resemblance) of every statement found; a document without one has one row with nulls.

    ``line`` is the statement's first, from 0. Lines that are a statement with probability ``suspect`` take part in wrapped
    paragraphs; a paragraph needs ``least``. Lines that no such paragraph takes up are read in windows too, so a statement is found in
    prose of any length; the first of equally good windows, cuts and families counts. Statements are those of English notices. A null
    or empty text has no statement; rows that repeat are scanned each; texts are
    read whole, of any length; ids may have any type and other columns any names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(it):
        c = sent.value
        for b in it:
            texts, rows = b.column("text").to_pylist(), []
            for lo, hi in pieces(texts):
                for k, found in enumerate(c.statements(texts[lo:hi], least, resemblance, suspect), lo):
                    rows += [(k, name, line, p, like) for line, name, p, like in found] or [(k, None, None, None, None)]
            at, *cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=["id", "family", "line", "probability", "resemblance"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, family string, line long, probability double, resemblance double")
