"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A text's paragraphs (blocks between blank lines) are cut at line breaks and sentence ends; each
piece is a bag of hashed word unigrams and bigrams. A sparse logistic regression gives each
piece a margin, and neighbouring pieces of a wrapped sentence that look like licence text are
one statement again, scored as a whole. The margin is calibrated (Platt scaling on templates
and sentences kept out of the fit); a statement below the limit is of the unknown class. For the
rest a multinomial regression on the same features names the family, and the prediction is
confirmed if the statement holds enough of the word pairs, in order, of a template of that family
and no other family's template holds more.

Training sees the templates below, varied at random with a fixed seed, sentences with licence
words that are no licences, and a bounded sample of ordinary sentences. Scoring uses built-in
functions inside the row: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re
import textwrap
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

BUCKETS = 4096  # a power of two
SAMPLE_DOCS = 200  # documents whose sentences train the other class
MAX_SENTENCES = 3000
LIMIT = 0.5  # of a statement's probability
FRAGMENT = 0.2  # of a piece's, to be joined to a statement
CONFIRM = 0.6

# Sentences of public licences and statements by which they are named. Of families
# with three or more the last is kept out of the fit that is calibrated.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache License, Version 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This project is licensed under the MIT License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license.",
        "This project is licensed under the BSD 3-Clause License.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "This project is licensed under the ISC License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL, version 2 or later.",
        "This program is licensed under the GNU General Public License.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the GNU Lesser General Public License, version 2.1.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the GNU Affero General Public License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License, Version 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Released under the Eclipse Public License 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Released under the Boost Software License 1.0.",
        "This library is licensed under the Boost Software License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License.",
        "Available under a Creative Commons Attribution 4.0 License (CC BY 4.0).",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under a Creative Commons Attribution-NonCommercial 4.0 License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Available under a Creative Commons Attribution-NoDerivatives 4.0 License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Available under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Available under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Released under CC0 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "All-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author, all rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Copyright 2019 the authors. All rights reserved.",
    ],
}
# Sentences with words of licences that are none. Every fifth is kept out like templates.
OTHER = [
    "The driver must show a license at the desk.",
    "This version of the story was released in the public library.",
    "The general public is free to use the work room.",
    "They work under the terms of the new contract.",
    "The source of the river and the form of the valley.",
    "Permission to enter was granted by the person at the gate.",
    "All rights of way are kept by the town.",
    "A copy of the file is at the foundation.",
    "Her driving license was renewed for ten years.",
    "The bar lost its liquor license after the fire.",
    "Copyright law changed a great deal in the last century.",
    "The court held that the copyright had expired.",
    "He wrote a book on patents and the public domain.",
    "Students may not use this room without permission of the teacher.",
    "The software is slow and has no warranty for the disk.",
    "A fishing license costs ten euros at the office.",
    "The committee reserved all seats in the first row.",
    "Human rights are universal and belong to all people.",
    "You can modify the recipe and use less sugar.",
    "The library is open to the public on Sundays.",
    "Version 2.0 of the program was slower than the first.",
    "Under the general rule, members are not liable for debts.",
    "The company sells licenses for its database by the core.",
    "We compare the MIT and Stanford programs in biology.",
    "The Apache helicopter was built for the army.",
    "Creative people in the commons shared their work.",
    "The goods are provided as they are seen in the shop.",
    "Distribution of the leaflets was forbidden by the police.",
    "The following conditions hold for every compact set.",
    "The authors thank the copyright office for its help.",
    "A table reserved for the free press stood by the door.",
    "The Mozilla browser shows the page in a new form.",
    "The new version of the contract was published in May.",
    "Nobody may sell tickets without the written consent of the club.",
    "The GNU is a large antelope of the African plains.",
    "An eclipse was seen by the general public on Tuesday.",
    "The charge is free of any doubt, the person said.",
    "Any person obtaining a ticket must keep a copy of it.",
    "The work was supported by a grant of the foundation.",
    "Figures are reproduced with permission of the museum.",
]
_SENTENCE = "(?<=[.!?])[ \\t-\\r]+|\\n"
_BLANK = "\\n[ \\t\\x0B\\f\\r]*\\n"
_BREAK = "\u001e"  # a piece of its own between paragraphs
_WORD = "[\\p{L}\\p{N}]"
_END = "[.!?][\"')\\]]*[ \\t-\\r]*$"


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", paragraph.lower()) if w]


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(_SENTENCE, text) if words_of(s)]


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def buckets_of(words: list[str]) -> list[int]:
    """The hashed unigrams and bigrams, as the Spark expression counts them (from 0)."""
    h = [_hash(w) for w in words]
    return [x & (BUCKETS - 1) for x in h] + [((a >> 20) ^ (b >> 40)) & (BUCKETS - 1) for a, b in zip(h, h[1:])]


def pairs_of(words: list[str]) -> list[int]:
    """Codes (signed 64-bit) of the distinct pairs of words that follow each other."""
    h = [_hash(w) for w in words]
    codes = {((a << 1) & (1 << 64) - 1) ^ b for a, b in zip(h, h[1:])}
    return sorted(c - (1 << 64) if c >> 63 else c for c in codes)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    any_weights: tuple[float, ...]
    any_bias: float
    slope: float  # of the calibrated margin
    offset: float
    family_weights: tuple[tuple[float, ...], ...]
    family_bias: tuple[float, ...]


class _Rows:
    """Bags of buckets in flat form; a row is divided by the root of its length."""

    def __init__(self, rows: list[list[str]]):
        found = [buckets_of(w) for w in rows]
        lengths = np.array([len(f) for f in found])
        self.n = len(found)
        self.bucket = np.array([b for f in found for b in f], np.int64)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.scale = 1 / np.sqrt(np.maximum(1, lengths))

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[self.bucket, k], self.n) * self.scale for k in range(w.shape[1])], 1)

    def gradient(self, e: np.ndarray) -> np.ndarray:
        e = e * self.scale[:, None]
        return np.stack([np.bincount(self.bucket, e[self.row, k], BUCKETS) for k in range(e.shape[1])], 1)


def _descend(rows: _Rows, y: np.ndarray, steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by full gradients with momentum; weights, biases."""
    w, b = np.zeros((BUCKETS, y.shape[1])), np.zeros(y.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = rows.margins(w) + b
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - y) / rows.n
        vw = 0.9 * vw - rate * (rows.gradient(e) + decay * w)
        vb = 0.9 * vb - rate * e.sum(0)
        w += vw
        b += vb
    return w, b


def _varied(sentence: str, filler: list[str], rng: np.random.Generator, times: int) -> list[list[str]]:
    """A template's sentence with words left out or put around it, and its wrapped lines."""
    own, made = words_of(sentence), []
    for i in range(times):
        words = [w for w in own if len(own) < 8 or rng.random() > 0.15 * rng.random()]
        before = list(rng.choice(filler, rng.integers(0, 4))) if i % 3 == 1 else []
        after = list(rng.choice(filler, rng.integers(0, 8))) if i % 4 == 1 else []
        made.append(before + words + after)
    for width in (60, 72, 80):
        lines = textwrap.wrap(sentence, width)
        made += [words_of(x) for x in lines if len(lines) > 1 and len(words_of(x)) > 3]
    return made


def _margin(rows: _Rows, some: np.ndarray) -> tuple[np.ndarray, float]:
    w, b = _descend(rows, np.stack([1 - some, some], 1).astype(float))
    return w[:, 1] - w[:, 0], float(b[1] - b[0])


def fit(ordinary: list[str], seed: int = 5) -> Model:
    """Fits both regressions on varied templates, other sentences and ordinary ones."""
    rng = np.random.default_rng(seed)
    families = tuple(TEMPLATES)
    filler = [w for p in ordinary for w in words_of(p)] or ["the", "of", "and"]
    texts, labels, kept_out = [], [], []
    for k, family in enumerate(families):
        for i, template in enumerate(TEMPLATES[family]):
            for sentence in sentences_of(template):
                made = _varied(sentence, filler, rng, 20)
                texts += made
                labels += [k] * len(made)
                kept_out += [len(TEMPLATES[family]) > 2 and i == len(TEMPLATES[family]) - 1] * len(made)
    others = [words_of(s) for s in OTHER for _ in range(10)] + [words_of(p) for p in ordinary]
    hidden = [i % 5 == 4 for i in range(len(OTHER)) for _ in range(10)] + [i % 5 == 4 for i in range(len(ordinary))]
    both = texts + others
    some = np.array([1] * len(texts) + [0] * len(others))
    held = np.array(kept_out + hidden)
    w, b = _margin(_Rows([t for t, h in zip(both, held) if not h]), some[~held])
    margin, truth = _Rows([t for t, h in zip(both, held) if h]).margins(w[:, None])[:, 0] + b, some[held]
    slope, offset = 1.0, 0.0
    target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    weight = np.where(truth == 1, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum()))
    for _ in range(2000):
        e = (1 / (1 + np.exp(-(slope * margin + offset))) - target) * weight
        slope -= 0.2 * float((e * margin).sum())
        offset -= 0.2 * float(e.sum())
    w, b = _margin(_Rows(both), some)
    fw, fb = _descend(_Rows(texts), np.eye(len(families))[labels])
    rounded = lambda v: tuple(round(float(a), 4) for a in v)
    return Model(families, rounded(w), round(b, 4), round(slope, 4), round(offset, 4), tuple(map(rounded, fw.T)), rounded(fb))


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, max_sentences: int = MAX_SENTENCES) -> Model:
    """Fits on the templates and on at most ``max_sentences`` sentences, of those least by hash,
    of at most ``sample_docs`` documents, those with the smallest hashes of their text. Sentences
    that share a third of their word pairs with a template are left out of the other class."""
    t = F.col(f"`{text}`")
    hashed = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("h"), t.alias("t"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample_docs)
    sentences = (
        hashed.join(F.broadcast(chosen), "h", "left_semi")  # sample_docs longs
        .select(F.explode(F.split("t", _SENTENCE)).alias("p"))
        .where(F.col("p").rlike(_WORD))
        .distinct()
        .orderBy(F.xxhash64("p"), "p")
        .limit(max_sentences)
    )
    known = {c for ts in TEMPLATES.values() for t in ts for s in sentences_of(t) for c in pairs_of(words_of(s))}
    ordinary = []
    for r in sentences.collect():
        pairs = pairs_of(words_of(r["p"]))
        if 3 * sum(c in known for c in pairs) <= len(pairs):
            ordinary.append(r["p"])
    return fit(ordinary)


def _numbers(values, kind: str) -> Column:
    """A constant array; folded once by the optimizer."""
    return F.split(F.lit(",".join(f"{v:g}" if isinstance(v, float) else str(v) for v in values)), ",").cast(f"array<{kind}>")


def _let(value: Column, then) -> Column:
    """``then(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hashes(p: Column) -> Column:
    """The hashes of a piece's words."""
    words = F.filter(F.split(F.lower(p), "[^\\p{L}\\p{N}\\p{M}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _next(h: Column) -> Column:
    return F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))


def _buckets(h: Column) -> Column:
    last = F.lit(BUCKETS - 1).cast("long")
    one = F.transform(h, lambda x: (x.bitwiseAND(last) + 1).cast("int"))
    two = lambda a, b: (F.shiftrightunsigned(a, 20).bitwiseXOR(F.shiftrightunsigned(b, 40)).bitwiseAND(last) + 1).cast("int")
    return F.concat(one, F.filter(F.zip_with(h, _next(h), two), lambda x: x.isNotNull()))


def _pairs(h: Column) -> Column:
    two = F.zip_with(h, _next(h), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))
    return F.array_distinct(F.filter(two, lambda x: x.isNotNull()))


def _total(found: Column, weights: Column) -> Column:
    summed = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.element_at(weights, i))
    return summed / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def scan(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, limit: float = LIMIT, confirm: float = CONFIRM) -> DataFrame:
    """The columns ``keep`` (all by default) of every row with n_paragraphs (blocks between blank
    lines that have a word) and licences: an array of (statement, family, probability, likeness,
    confirmed) for each statement that is not of the unknown class; unconfirmed ones keep the
    family predicted.

    Null, empty and blank texts have no paragraphs; repeated statements and rows count each
    time; an empty table gives no rows; result columns whose name is taken get underscores.
    """
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = {n: free_name(kept, n) for n in ("n_paragraphs", "licences")}
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"),
        F.size(F.filter(F.split(t, _BLANK), lambda p: p.rlike(_WORD))).cast("long").alias("n_paragraphs"),
        F.split(F.regexp_replace(t, _BLANK, f"\n{_BREAK}\n"), _SENTENCE).alias("pieces"),
        _numbers(model.any_weights, "double").alias("any_weights"),
    )

    def probability(h: Column) -> Column:
        margin = _total(_buckets(h), F.col("any_weights")) + model.any_bias
        found = 1 / (1 + F.exp(-(margin * model.slope + model.offset)))
        return F.when(F.size(h) > 0, found).otherwise(0.0)

    rows = rows.withColumn("marks", F.transform("pieces", lambda p: _let(_hashes(p), probability) >= FRAGMENT))
    # Likely pieces that follow each other are one statement until a piece ends a sentence.
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        pushed = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        joined = F.when(a["open"] == "", x["p"]).otherwise(F.concat(a["open"], F.lit(" "), x["p"]))
        ends = x["p"].rlike(_END)
        return F.struct(
            F.when(~x["m"], pushed).when(ends, F.concat(a["done"], F.array(joined))).otherwise(a["done"]).alias("done"),
            F.when(~x["m"] | ends, F.lit("")).otherwise(joined).alias("open"),
        )

    gathered = F.aggregate(
        F.zip_with("pieces", "marks", lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
        empty,
        step,
        lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))),
    )
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("statements", F.when(F.exists("marks", lambda m: m), gathered).otherwise(none))

    templates = [(k, pairs_of(words_of(s))) for k, f in enumerate(model.families) for t in TEMPLATES[f] for s in sentences_of(t)]
    templates = [(k, p) for k, p in templates if p]
    owners = F.array(*[F.lit(k) for k, _ in templates])
    pairs = F.array(*[_numbers(p, "bigint") for _, p in templates])

    def named(s: Column) -> Column:
        def with_hashes(h: Column) -> Column:
            scores = _let(
                _buckets(h),
                lambda f: F.array_max(
                    F.array(
                        *[
                            F.struct((_total(f, _numbers(v, "double")) + b).alias("z"), F.lit(k).alias("k"))
                            for k, (v, b) in enumerate(zip(model.family_weights, model.family_bias))
                        ]
                    )
                ),
            )
            shared = _let(
                _pairs(h),
                lambda own: F.zip_with(pairs, owners, lambda p, o: F.struct(F.size(F.array_intersect(own, p)).alias("n"), (F.size(F.array_intersect(own, p)) / F.size(p)).alias("like"), o.alias("k"))),
            )
            return F.struct(scores["k"].alias("k"), shared.alias("shared"), probability(h).alias("probability"))

        def verdict(x: Column) -> Column:
            mine = F.filter(x["shared"], lambda c: c["k"] == x["k"])
            fit_ = lambda a: F.coalesce(F.array_max(F.transform(F.filter(a, lambda c: c["like"] >= confirm), lambda c: c["n"])), F.lit(-1))
            return F.struct(
                s.alias("statement"),
                F.element_at(F.array(*[F.lit(f) for f in model.families]), x["k"] + 1).alias("family"),
                x["probability"].alias("probability"),
                F.coalesce(F.array_max(F.transform(mine, lambda c: c["like"])), F.lit(0.0)).alias("likeness"),
                ((fit_(mine) > 0) & (fit_(mine) >= fit_(x["shared"]))).alias("confirmed"),
            )

        return _let(_let(_hashes(s), with_hashes), verdict)

    return rows.select(
        "kept_columns.*",
        F.col("n_paragraphs").alias(names["n_paragraphs"]),
        F.filter(F.transform("statements", named), lambda x: x["probability"] >= limit).alias(names["licences"]),
    )
