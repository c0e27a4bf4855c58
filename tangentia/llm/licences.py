"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph's word n-grams feed a sparse multinomial logistic regression whose
classes are licence families and *unknown*.  What is compared with templates comes to it in two ways:

* around a *name* of a family (the longest at its place, so that ``cc by nc sa`` names nobody): the words around must share half of the pairs of a template;
* where a paragraph shares half of its runs of five words, or of a template's, with a template that has no name in it
  (the permissions, conditions and warranties that some licences consist of): of all such templates, those of
  other licences among them, the nearest counts.

A family is found if the classifier ranks it first there, with a probability of at least the threshold.  That is calibrated on
paragraphs of families that the model was not trained on, whole families left out in turn, and on other prose.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, SEED = 1 << 14, 3
#: Words on each side of a name that are read with it.
AROUND = 8
#: Least share of the word pairs, or for templates without a name of the runs of ``RUN`` words, of the shorter side that a paragraph and a template have in common.
LEAST_OVERLAP, RUN = 0.5, 5
#: Calibration lets the classifier alone pass at most these shares of other paragraphs, and it and the templates of texts of families that were left out, each in one of ``FOLDS`` parts.
MOST_FALSE, MOST_TAKEN, FOLDS = 0.003, 0.02, 4

#: Public licence notices, by family.  Short forms name the family in a line.
TEMPLATES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "under the Apache License, Version 2.0",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "under the MIT License",
        "This project is MIT licensed.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "under the BSD 3-Clause License",
        "under the BSD 2-Clause License",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the GNU General Public License, version 3",
        "under the GNU General Public License, version 2",
        "under the GPL version 3",
        "the GPLv2",
        "the GPLv3",
        "GPLv3 license",
        "GPL v2",
        "GPL v3",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "under the GNU Lesser General Public License, version 3",
        "under the LGPL version 2.1",
        "the LGPLv3",
        "LGPL v2.1",
        "LGPL v3",
    ],
    "AGPL": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "under the GNU Affero General Public License, version 3",
        "under the AGPL version 3",
        "the AGPLv3",
        "AGPL v3",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "under the Mozilla Public License 2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "under CC BY 4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "under CC BY-SA 4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "under CC BY-NC 4.0",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "under CC BY-ND 4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "under CC0 1.0 Universal Public Domain Dedication",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "under the ISC License",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "under the zlib License",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "under the Boost Software License, Version 1.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "under the Eclipse Public License 2.0",
    ],
    "EUPL": [
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
        "under the European Union Public Licence, version 1.2",
    ],
    "Artistic": [
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
        "under the Artistic License 2.0",
    ],
}
#: Names of the families as words; the last are of licences that are no family here, some of which hold another's name.
NAMES = {
    "Apache-2.0": ["apache license", "apache licence", "apache software license", "apache public license", "apache 2.0"],
    "MIT": ["mit license", "mit licence", "mit licensed", "mit/x11 license"],
    "BSD": ["bsd license", "bsd licence", "bsd licensed", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd"],
    "GPL": ["gnu general public license", "gnu general public licence", "gpl", "gplv2", "gplv3", "gplv2+", "gplv3+", "gpl2", "gpl3"],
    "LGPL": ["gnu lesser general public license", "gnu lesser general public licence", "gnu library general public license", "lesser gpl", "lgpl", "lgplv2", "lgplv2.1", "lgplv3", "lgplv2.1+", "lgplv3+"],
    "AGPL": ["gnu affero general public license", "gnu affero general public licence", "affero gpl", "agpl", "agplv3", "agplv3+"],
    "MPL-2.0": ["mozilla public license", "mozilla public licence", "mpl 2.0", "mplv2", "mplv2.0"],
    "CC-BY": ["creative commons attribution", "cc by"],
    "CC-BY-SA": ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"],
    "CC-BY-NC": ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"],
    "CC-BY-ND": ["creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives", "cc by nd"],
    "CC0": ["cc0", "creative commons zero"],
    "Unlicense": ["unlicense"],
    "ISC": ["isc license", "isc licence", "isc licensed"],
    "Zlib": ["zlib license", "zlib licence", "zlib libpng license"],
    "BSL-1.0": ["boost software license", "boost software licence"],
    "EPL": ["eclipse public license", "eclipse public licence"],
    "EUPL": ["european union public licence", "european union public license", "eupl"],
    "Artistic": ["artistic license", "artistic licence"],
    "": [
        "cc by nc sa", "cc by nc nd", "creative commons attribution noncommercial sharealike", "creative commons attribution noncommercial share alike",
        "creative commons attribution non commercial share alike", "creative commons attribution non commercial sharealike",
        "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "creative commons attribution non commercial no derivatives",
        "zero clause bsd", "bsd zero clause", "gnu free documentation license", "server side public license", "elastic license",
        "common development and distribution license", "business source license",
    ],
}
#: Public notices without a name, of licences that are no family here but have wording in common with one.
RELATIVES = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
]
_LEADS = ("Licensed", "Released", "Distributed", "Published", "This work is licensed", "This project is released", "Available", "The code is licensed", "Content is available", "All files are")
_NEAR_MISSES = (
    "All rights reserved.", "See the license file for details.", "You must accept the terms of service before use.",
    "He lost his driving license in May.", "The software is sold under a commercial license.", "A license is required to fish here.",
    "Copyright 2020 by the authors.", "Permission to land was granted.", "Use of this site is subject to our privacy policy.",
    "The general public was free to attend the foundation.", "Conditions may apply; version 2.0 follows.",
    "This work was done under the direction of the author.", "No warranty is given for the goods.",
)
#: SPDX identifiers, by family; the longest beginning counts.
SPDX = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "bsd-": "BSD", "0bsd": "BSD", "gpl-": "GPL", "lgpl-": "LGPL", "agpl-": "AGPL",
    "mpl-2.0": "MPL-2.0", "cc-by-": "CC-BY", "cc-by-sa-": "CC-BY-SA", "cc-by-nc-": "CC-BY-NC", "cc-by-nd-": "CC-BY-ND", "cc0-": "CC0",
    "unlicense": "Unlicense", "isc": "ISC", "zlib": "Zlib", "bsl-1.0": "BSL-1.0", "epl-": "EPL", "eupl-": "EUPL", "artistic-": "Artistic",
}
#: Names after ``License:`` that are no SPDX identifiers, without a version.
NAMED = {
    "apache": "Apache-2.0", "bsd": "BSD", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL", "mpl": "MPL-2.0", "cc-by": "CC-BY", "cc-by-sa": "CC-BY-SA",
    "cc-by-nc": "CC-BY-NC", "cc-by-nd": "CC-BY-ND", "cc0": "CC0", "bsl": "BSL-1.0", "epl": "EPL", "eupl": "EUPL", "artistic": "Artistic",
}
_TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*(.*)", re.I)
_DECLARED = re.compile(r"\blicen[cs]e\s*[:=][ \t]*[\"'(]?(?:the[ \t]+)?([a-z0-9][a-z0-9.\-]*)(?![\w:/])", re.I)
_VERSION = re.compile(r"[-_]?v?[0-9][0-9.]*(?:-only|-or-later)?$|-$")
_IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.\-]*", re.I)
_WORD = re.compile(r"[a-z0-9][a-z0-9.+]*[a-z0-9+]|[a-z0-9]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str]) -> list[str]:
    """Words and pairs of words."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def _runs(words: list[str]) -> list[tuple[str, ...]]:
    """Runs of ``RUN`` words by position; the whole where it is shorter."""
    return [tuple(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1))] if words else []


def _ids(grams: list[str]) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh32_intdigest(g) & (BUCKETS - 1) for g in grams], dtype=np.int64))


def named(words: list[str]) -> list[tuple[str, int, int]]:
    """(family, begin, end) of the names in a list of words; of names that lie in one another the longest, and none of licences that are no family."""
    found = []
    for i, w in enumerate(words):
        for phrase, family in _BY_FIRST.get(w, ()):  # longest first
            if words[i : i + len(phrase)] == phrase:
                found.append((family, i, i + len(phrase)))
                break
    out, end = [], 0
    for family, a, z in sorted(found, key=lambda x: (x[1], -x[2])):
        if z > end:  # not within the one before
            out.append((family, a, z))
            end = z
    return [x for x in out if x[0]]


def _by_first() -> dict[str, list[tuple[list[str], str]]]:
    out: dict[str, list[tuple[list[str], str]]] = {}
    for family, names in NAMES.items():
        for name in names:
            phrase = words_of(name)
            out.setdefault(phrase[0], []).append((phrase, family))
    return {w: sorted(x, key=lambda y: -len(y[0])) for w, x in out.items()}


_BY_FIRST = _by_first()


def around(words: list[str], a: int, z: int) -> list[str]:
    """A name with the words around it."""
    return words[max(0, a - AROUND) : z + AROUND]


@dataclass
class Model:
    families: list[str]  # the last is unknown
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, list[str]]
    #: Word pairs of the templates with a name, by family.
    grams: dict[str, list[frozenset[tuple[str, str]]]] = field(init=False)

    def __post_init__(self) -> None:
        self.grams = {}
        #: Family ('' of relatives), and runs of words, of each template without a name; templates that have a run.
        self.bodies: list[tuple[str, frozenset]] = []
        self.index: dict[tuple[str, ...], list[int]] = {}
        every = [(f, t) for f, ts in self.templates.items() for t in ts] + [("", t) for t in RELATIVES]
        for family, text in every:
            words = words_of(text)
            if any(f == family for f, _, _ in named(words)):
                self.grams.setdefault(family, []).append(frozenset(_pairs(words)))
                continue
            runs = frozenset(_runs(words))
            for r in runs:
                self.index.setdefault(r, []).append(len(self.bodies))
            self.bodies.append((family, runs))

    def probabilities(self, words: list[str]) -> np.ndarray:
        ids = _ids(ngrams(words))
        z = (self.weights[ids].sum(axis=0) / max(1.0, len(ids)) ** 0.5 + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def prose_of(rng: random.Random, k: int) -> list[str]:
    """Words that are none."""
    syllables = "an be cor de el fi gra ho in jo ka lu mo na or pe qui ra se ti un ve wa zen ing tion der que ent the of and".split()
    return ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3)))) for _ in range(k)]


def _example(rng: random.Random, text: str) -> list[str]:
    """A template as it may stand in a paragraph, with lost and foreign words."""
    if len(text.split()) <= 8 and not text.startswith("This "):
        if rng.random() < 0.4:
            return text.split()
        if not text.startswith("under "):
            text = f"under {rng.choice(('', 'the ')) if not text.startswith('the ') else ''}{text}"
        if rng.random() < 0.8:
            text = f"{rng.choice(_LEADS)} {text}{rng.choice(('.', '', '. All rights reserved.'))}"
        words = text.removeprefix("under ").split() if rng.random() < 0.2 else text.split()
    else:
        words = [w for w in text.split() if rng.random() > 0.06]
    return words


def _piece(rng: random.Random, family: str, words: list[str]) -> list[str]:
    """The part of an example that is compared: around a name if it has one, else the whole, or most of it."""
    if rng.random() < 0.6:
        words = prose_of(rng, rng.choice((0, 4, 15))) + words + prose_of(rng, rng.choice((0, 6, 30)))
    own = words_of(" ".join(words))
    names = [x for x in named(own) if x[0] == family]
    if names:
        _, a, z = rng.choice(names)
        return around(own, a, z)
    cut = rng.randrange(len(own) // 2 + 1) if len(own) > 20 and rng.random() < 0.3 else 0
    return own[cut:] if rng.random() < 0.5 else own[: len(own) - cut]


def _examples(rng: random.Random, n: int, templates: dict[str, list[str]]) -> list[tuple[list[str], str]]:
    """Pieces made from the templates by rule, and others that are no family's.

    Those are prose, near misses, notices of other licences, and the templates' own words out of their order, as texts
    of other licences have them.
    """
    out = []
    every = [(f, t) for f, ts in templates.items() for t in ts]
    bag = [w for _, t in every for w in words_of(t)]
    for _ in range(n):
        family, text = rng.choice(every)
        out.append((_piece(rng, family, _example(rng, text)), family))
        miss = prose_of(rng, rng.randint(2, 40))
        if rng.random() < 0.35:
            miss = rng.choice(_NEAR_MISSES).split() + miss[: rng.randint(0, 12)]
        elif rng.random() < 0.15:
            miss = rng.choices(bag, k=rng.randint(4, 40))
        elif rng.random() < 0.15:
            miss = _example(rng, rng.choice(RELATIVES))
        elif rng.random() < 0.4:
            miss += rng.choice(_LEADS).split() + ["under"] + prose_of(rng, rng.randint(1, 4))
        out.append((words_of(" ".join(miss)), "unknown"))
    return out


def _regression(data: list[tuple[np.ndarray, int]], families: int, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by stochastic gradient descent."""
    w, b = np.zeros((BUCKETS, families)), np.zeros(families)
    for r in range(rounds):
        for ids, y in data:
            scale = max(1.0, len(ids)) ** 0.5
            z = w[ids].sum(axis=0) / scale + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate / (1 + r)
            w[ids] -= step * p / scale
            b -= step * 0.1 * p
    return w, b


def _trained(n: int, rounds: int, rate: float, templates: dict[str, list[str]]) -> tuple[Model, np.ndarray]:
    """A model without a threshold, and the highest probability of a family that it gives to each of other paragraphs it wasn't trained on."""
    rng = random.Random(SEED)
    families = [*templates, "unknown"]
    data = [(_ids(ngrams(words)), families.index(f)) for words, f in _examples(rng, n, templates) if words]
    cut = len(data) * 4 // 5
    w, b = _regression(data[:cut], len(families), rounds, rate)
    z = np.stack([w[ids].sum(axis=0) / max(1.0, len(ids)) ** 0.5 + b for ids, _ in data[cut:]])
    y = np.array([k for _, k in data[cut:]])

    def soft(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.5, 10, 31), key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean())
    other = soft(temperature)[y == len(families) - 1, :-1].max(axis=1)
    return Model(families, w, b, float(temperature), 0.0, templates), other


def _left_out(n: int, rounds: int, rate: float, templates: dict[str, list[str]]) -> np.ndarray:
    """Probabilities with which texts of families are taken for others by models that don't know them; 0 where none is found."""
    names, rng, out = list(templates), random.Random(SEED + 1), []
    for fold in range(min(FOLDS, len(names) // 2)):
        gone = names[fold::FOLDS]
        model, _ = _trained(n, rounds, rate, {f: t for f, t in templates.items() if f not in gone})
        for family in gone:
            for text in templates[family]:
                for _ in range(4):
                    words = prose_of(rng, 6) + _example(rng, text) + prose_of(rng, 6)
                    out.append(max((p for _, p in findings(words_of(" ".join(words)), model)), default=0.0))
    return np.array(out)


def train(n: int = 16000, rounds: int = 5, rate: float = 0.7, templates: dict[str, list[str]] | None = None) -> Model:
    templates = TEMPLATES if templates is None else templates
    model, other = _trained(n, rounds, rate, templates)
    taken = _left_out(max(n // 8, 200), rounds, rate, templates)
    model.threshold = max(float(np.quantile(x, 1 - most)) for x, most in ((other, MOST_FALSE), (taken, MOST_TAKEN)) if len(x))
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def overlap(own: set[tuple[str, str]], family: str, model: Model) -> float:
    """Largest share of the word pairs ``own`` that they have in common with a named template of the family, of the smaller of both."""
    best = 0.0
    for grams in model.grams.get(family, ()):
        if own and grams:
            best = max(best, len(own & grams) / min(len(own), len(grams)))
    return best


def paragraphs(text: str) -> Iterator[tuple[str, list[str]]]:
    """Lines, and runs of lines between blank ones where they are more than one, with their words."""
    for block in re.split(r"\n[^\S\n]*\n", text):
        lines = [line for line in block.split("\n") if line.strip()]
        words = [words_of(line) for line in lines]
        yield from zip(lines, words, strict=True)
        if len(lines) > 1:
            yield " ".join(lines), [w for of in words for w in of]


def pieces(words: list[str], model: Model) -> Iterator[tuple[str, list[str]]]:
    """(family, words) of all parts of a paragraph that templates confirm, for the classifier to judge."""
    for family, a, z in named(words):
        piece = around(words, a, z)
        if overlap(_pairs(piece), family, model) >= LEAST_OVERLAP:
            yield family, piece
    if len(words) < RUN:
        return
    index = model.index
    hits = [(i, r) for i, r in enumerate(zip(*[words[k:] for k in range(RUN)], strict=False)) if r in index]
    if not hits:
        return
    counts: dict[int, set] = {}
    spans: dict[int, tuple[int, int]] = {}
    for i, r in hits:
        for k in index[r]:
            counts.setdefault(k, set()).add(r)
            spans[k] = (spans[k][0] if k in spans else i, i + RUN)
    own = len(set(_runs(words)))
    found = []
    for k, hit in counts.items():
        size = len(model.bodies[k][1])
        if len(hit) >= LEAST_OVERLAP * min(own, size):
            found.append((len(hit) / (own + size - len(hit)), k, *spans[k]))
    for share, k, a, z in found:
        # of templates that lie over one another, the one most like the paragraph counts
        if model.bodies[k][0] and not any(s > share and b < z and a < e for s, _, b, e in found):
            yield model.bodies[k][0], words[a:z]


def findings(words: list[str], model: Model) -> Iterator[tuple[str, float]]:
    """(family, probability) of the parts of a paragraph that templates confirm and the classifier predicts."""
    for family, piece in pieces(words, model):
        p = model.probabilities(piece)[:-1]
        k = int(p.argmax())
        if model.families[k] == family and p[k] >= model.threshold:
            yield family, float(p[k])


def tagged(paragraph: str) -> set[str]:
    """Families of the SPDX expressions in a paragraph; identifiers of other licences give none."""
    found = set()
    for expression in _TAGGED.findall(paragraph):
        exception = open_ = False
        for x in re.findall(r"[()]|[^\s()]+", expression):
            word = x.lower()
            if word in ("or", "and", "with", "(", ")"):
                exception, open_ = word == "with", False
                continue
            if open_:  # an expression ends where two words follow each other
                break
            open_ = True
            name = _IDENTIFIER.match(word)
            if name is None:
                break
            begin = max((b for b in SPDX if name[0] == b or (b[-1] == "-" and name[0].startswith(b))), key=len, default="")
            if begin and not exception:
                found.add(SPDX[begin])
    return found


def declared(paragraph: str) -> set[str]:
    """Families named right after ``License:``, by SPDX identifier or short name; other names give none."""
    found = set()
    for name in _DECLARED.findall(paragraph):
        name = name.lower().rstrip(".")
        bare = _VERSION.sub("", name)
        family = SPDX.get(name) or NAMED.get(bare) or SPDX.get(bare)
        begin = max((b for b in SPDX if b[-1] == "-" and name.startswith(b)), key=len, default="")
        if family or begin:
            found.add(family or SPDX[begin])
    return found


def scan(text: str | None, model: Model) -> tuple[list[str], int, int, float]:
    """Families found (sorted), paragraphs read, paragraphs confirmed, highest probability among them."""
    found, read, hits, best = set(), 0, 0, 0.0
    tags = _TAGGED.search(text or "") is not None
    names = _DECLARED.search(text or "") is not None
    for paragraph, words in paragraphs(text or ""):
        read += 1
        told = dict.fromkeys((tagged(paragraph) if tags else set()) | (declared(paragraph) if names else set()), 1.0)
        for family, p in findings(words, model):
            told[family] = max(told.get(family, 0.0), p)
        found |= set(told)
        hits += bool(told)
        best = max([best, *told.values()])
    return sorted(found), read, hits, best


def scan_licences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``(doc_id, families, n_paragraphs, n_confirmed, score)``, one row for each row of ``documents``.

    ``families`` are the confirmed licence families, sorted and comma-joined, empty
    if there is none or the text is null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("struct<families: string, n_paragraphs: bigint, n_confirmed: bigint, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan(t, shared.value) for t in batch]
            yield pd.DataFrame(
                [(",".join(r[0]), *r[1:]) for r in rows], columns=["families", "n_paragraphs", "n_confirmed", "score"]
            )

    return documents.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("x")).select("doc_id", "x.*")
