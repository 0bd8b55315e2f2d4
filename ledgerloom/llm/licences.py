"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line. Its features are the words and word pairs that it holds (each once), its
classes the licence families and `unknown`. The multinomial logistic regression learns on the driver
from the templates below, from parts and noisy copies of them, and from a bounded sample of the
table's own paragraphs, which are unknown unless they resemble a template; a temperature set on
what was not learnt from calibrates its probabilities. A paragraph without any anchor is unknown
without a look at its weights: the anchors are words of the templates chosen so that all other n-grams
together cannot bring a family over `unknown`, so that loses nothing. How often words occur in the sample
only decides which of them are spared.

A prediction is confirmed where the paragraph's words and those of one of the family's templates are
alike enough, it has all the NAMES that the template has and at least half of the words that
tell it from those of the other families (a template without any needs all its words), and no template of another family whose telling words it has is more
alike. So a notice of a licence that the templates do not know is not confirmed as one that is worded like it. Scoring is a narrow map over the rows: nothing is shuffled, so no key can be hot.

Defined cases: rows without an id teach nothing, and equal texts teach once. Null and empty texts have no paragraphs worth a row. Repeated rows give repeated
answers, null ids stay null. Without ordinary paragraphs to learn from (an empty table) there are no
rows either. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"
#: The usual notices of each family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0"),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT"),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-only"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication.",
        "This is free and unencumbered software released into the public domain."),
    "proprietary": (
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is the confidential and proprietary information of the company and may not be reproduced without prior written permission."),
}
#: Sentences with the same words that are no notices.
ORDINARY = (
    "He renewed his driving license at the public office.", "The general asked for permission to use the road.", "A copy of the work is on file.",
    "The software was slow and the source of the error is unknown.", "They distribute bread free of charge to any person in need.",
    "The terms of the contract were met in any form.", "MIT and other universities published the new version of the program.",
    "The public domain is a matter of law.", "All people have rights and conditions apply.", "The license fee rose by 2.0 percent.",
    "Copyright is explained in the second chapter.", "Version 3 of the library is better than version 2.1.", "Apache helicopters flew over the base.",
    "Mozilla released a new browser.", "The commons are open to the public.", "Warranty claims must be sent in writing.",
)
#: Words that name a licence or its owner. A paragraph without those of a template does not confirm it.
NAMES = {"apache", "mit", "gnu", "lesser", "lgpl", "affero", "agpl", "gpl", "bsd", "mozilla", "mpl", "creative", "cc", "cc0", "by", "nc", "sa",
         "attribution", "sharealike", "noncommercial"}
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
FAMILIES = (UNKNOWN, *TEMPLATES)


def _words(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / max(1, len(a | b))


@dataclass
class Model:
    vocabulary: list[str]
    weights: np.ndarray  # a row for each n-gram and the constant last, a column for each of FAMILIES
    anchors: list[str] | None  # a paragraph without any of them is unknown; None where the constant alone gives a family
    temperature: float


def _variants(words: list[str], rng: np.random.Generator, filler: list[list[str]]) -> list[list[str]]:
    """The words, and noisy copies: parts, drops, other words around."""
    out = [words]
    for _ in range(12):
        own = [w for w in words if rng.random() > 0.12]
        if len(own) > 12 and rng.random() < 0.5:
            cut = int(rng.integers(8, len(own)))
            own = own[:cut] if rng.random() < 0.5 else own[-cut:]
        if filler and rng.random() < 0.5:
            other = filler[int(rng.integers(len(filler)))][:6]
            own = other + own if rng.random() < 0.5 else own + other
        out.append(own)
    return out


def _anchors(vocabulary: list[str], weights: np.ndarray, often: dict[str, int]) -> list[str] | None:
    """Words without which no paragraph can be of a family, whatever else it holds.

    The words that occur most often are spared first, while for every family the constant and all its gains over
    `unknown` from n-grams of spared words alone stay below zero. A pair with one anchor has that anchor.
    """
    gains = np.maximum(weights[:-1, 1:] - weights[:-1, :1], 0.0)
    total = weights[-1, 1:] - weights[-1, 0] + 1e-6  # more than sums in another order can differ
    if (total >= 0).any():
        return None
    row, pairs, spared = {g: i for i, g in enumerate(vocabulary)}, {}, set()
    for g in vocabulary:
        if " " in g:
            for w in set(g.split(" ")):
                pairs.setdefault(w, []).append(g)
    words = [g for g in vocabulary if " " not in g]
    for w in sorted(words, key=lambda w: (-often.get(w, 0), w)):
        own = [w, *(g for g in pairs.get(w, ()) if all(x == w or x in spared for x in g.split(" ")))]
        after = total + gains[[row[g] for g in own]].sum(axis=0)
        if (after < 0).all():
            total = after
            spared.add(w)
    return [w for w in words if w not in spared]


def fit(paragraphs: list[str], steps: int = 200, rate: float = 4.0, ridge: float = 1e-4, seed: int = 11) -> Model:
    """From ordinary paragraphs of the table and the templates."""
    rng = np.random.default_rng(seed)
    templates = [(f, _words(t)) for f, texts in TEMPLATES.items() for t in texts]
    ordinary = [w for w in map(_words, paragraphs) if w and max(_alike(set(w), set(t)) for _, t in templates) < 0.4]
    ordinary += [_words(t) for t in ORDINARY]
    vocabulary = sorted(set().union(*(_grams(w) for _, w in templates)))
    place = {g: i for i, g in enumerate(vocabulary)}
    samples = [(FAMILIES.index(f), v) for f, w in templates for v in _variants(w, rng, ordinary)] + [(0, w) for w in ordinary] + [(0, []) for _ in range(20)]
    x, y = np.zeros((len(samples), len(vocabulary) + 1)), np.array([k for k, _ in samples])
    for row, (_, words) in enumerate(samples):
        x[row, [place[g] for g in _grams(words) if g in place]] = 1
    x[:, -1] = 1
    order = rng.permutation(len(x))
    held, learnt = order[:len(x) // 5], order[len(x) // 5:]
    weights, truth = np.zeros((x.shape[1], len(FAMILIES))), np.eye(len(FAMILIES))[y]
    share = truth[learnt].sum(axis=0) + 1
    balance = (1 / share)[y[learnt]]
    balance /= balance.sum()
    for _ in range(steps):
        z = x[learnt] @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= rate * (x[learnt].T @ ((p - truth[learnt]) * balance[:, None]) + ridge * weights)

    def loss(t: float) -> float:
        z = x[held] @ weights / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[held]]).mean())

    temperature = min((0.05 * 1.15**i for i in range(40)), key=loss)
    often = {}
    for words in ordinary[:-len(ORDINARY)]:
        for w in set(words):
            often[w] = often.get(w, 0) + 1
    anchors = _anchors(vocabulary, weights, often)
    return Model(vocabulary, weights, anchors, temperature)


def learn(docs: DataFrame, most: int = 400, each: int = 4, longest: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The model with about `each` paragraphs of each of about `most` documents, chosen by hashes of id and text and of
    the paragraph. One of more than `longest` characters teaches nothing."""
    known = docs.filter(F.col(id_col).isNotNull())
    few = known.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, known.count()))))
    lines = few.select(text_col).distinct().select(F.split(F.col(text_col), "\n").alias("all")).select(F.size("all").alias("of"), F.explode("all").alias("p"))
    lines = lines.filter((F.pmod(F.xxhash64("p"), F.col("of")) < each) & (F.length("p") <= longest))
    return fit(sorted(r["p"] for r in lines.collect()))


def _telling() -> list[tuple[str, set[str], set[str]]]:
    """Family, words, and words that no other family's templates have, of each template."""
    own = {f: set().union(*(_words(t) for t in texts)) for f, texts in TEMPLATES.items()}
    others = {f: set().union(*(w for g, w in own.items() if g != f)) for f in own}
    return [(f, set(_words(t)), set(_words(t)) - others[f]) for f, texts in TEMPLATES.items() for t in texts]


def _constant(value, kind: str) -> Column:
    """One literal for a list or a map, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _prefixed(words: list[str]) -> str:
    """A pattern for any of the words that shares their common beginnings, so that a reader tries few branches."""
    ends, rest = "" in words, {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    if not rest:
        return ""
    inner = "|".join(re.escape(first) + _prefixed(tails) for first, tails in sorted(rest.items()))
    return f"(?:{inner})?" if ends else f"(?:{inner})"


def _holds(anchors: list[str]) -> str:
    """A pattern that every lower-case text with one of these tokens has. A token that ends in a dot and digits may
    run into letters, and the token of those letters begins after a digit; no other token touches one."""
    kinds = {}
    for w in anchors:
        kinds.setdefault((w[0].isdigit(), "." in w), []).append(w)
    return "|".join(f"(?<![a-z{'0-9' if digit else ''}]){_prefixed(some)}(?![0-9{'' if dotted else 'a-z'}])" for (digit, dotted), some in sorted(kinds.items()))


def _reals(values) -> list[float]:
    return [float(v) for v in values]


def paragraphs(docs: DataFrame, model: Model, least: float = 0.5, alike: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (number of the line from 0), family, probability, similarity, confirmed of every paragraph
    that the classifier gives to a licence family with at least that probability."""
    # A text, then a line, without the letters of any anchor has no anchor.
    gated = model.anchors is not None
    hint = (_holds(model.anchors) or "(?!)") if gated else ""
    lines = docs.filter(F.lower(text_col).rlike(hint)).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line"))
    words = lines.filter(F.lower("line").rlike(hint)).select("doc_id", "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(f"({_TOKEN})"), 1).alias("words"))
    marked = words.filter(F.arrays_overlap("words", _constant(model.anchors, "array<string>"))) if gated else words
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    known = marked.select("doc_id", "paragraph", "words", F.array_intersect(F.concat("words", pairs), _constant(model.vocabulary, "array<string>")).alias("known"))
    table = _constant({g: _reals(w / model.temperature) for g, w in zip(model.vocabulary, model.weights)}, "map<string,array<double>>")
    logits = F.aggregate("known", _constant(_reals(model.weights[-1] / model.temperature), "array<double>"), lambda total, gram: F.zip_with(total, F.element_at(table, gram), lambda a, b: a + b))
    # As the one row of a generator the sums are worked out once, not again in each expression that uses them.
    scored = known.select("doc_id", "paragraph", "words", F.explode(F.array(logits)).alias("logits")).withColumn("top", F.array_max("logits"))
    mass = F.aggregate("logits", F.lit(0.0), lambda total, z: total + F.exp(z - F.col("top")))
    best = scored.select("doc_id", "paragraph", "words", F.element_at(_constant(FAMILIES, "array<string>"), F.array_position("logits", F.col("top")).cast("int")).alias("family"), (1 / mass).alias("probability"))
    found = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    shapes = _constant([{"family": f, "words": sorted(w), "telling": sorted(t or w), "least": (len(t) + 1) // 2 if t else len(w), "names": sorted(w & NAMES)} for f, w, t in _telling()],
                       "array<struct<family:string,words:array<string>,telling:array<string>,least:int,names:array<string>>>")

    def likeness(t):
        return F.size(F.array_intersect("words", t["words"])) / F.size(F.array_union("words", t["words"]))

    def told(t):
        return (F.size(F.array_except(t["names"], "words")) == 0) & (F.size(F.array_intersect("words", t["telling"])) >= t["least"])

    def most(kept):
        return F.coalesce(F.array_max(F.transform(F.filter(shapes, kept), likeness)), F.lit(0.0))
    own, other = (lambda t: t["family"] == F.col("family")), (lambda t: (t["family"] != F.col("family")) & told(t))
    sure = most(lambda t: own(t) & told(t))
    return found.withColumn("similarity", most(own)).select("doc_id", "paragraph", "family", "probability", "similarity",
                                                            ((sure >= alike) & (sure >= most(other))).alias("confirmed"))
