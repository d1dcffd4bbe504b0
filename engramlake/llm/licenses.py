"""Licence scan: a sparse word n-gram logistic classifier of paragraphs, confirmed by templates.

A paragraph is a line with a word, together with lines that go on with it: after a line that no stop ends, a
line that begins with a small letter. Hashed words and word pairs feed a softmax over licence families and
``other`` (terms of no family) and ``none``, fitted on the driver on a small table that rules write: parts of
NOTICES and OTHER in filler, whose words are not those of the templates alone, and plain sentences, some of them
about licences. A temperature, fitted on wordings that the model had not seen, calibrates the probabilities. A
predicted family stands from ``SURE`` on if enough of the paragraph's word pairs are in the family's TEMPLATES;
``unknown`` is a paragraph of ``other`` by the same two tests, or one whose probability of ``none`` lies below a
bound that all but a share of unseen plain rows keep, if it shares word pairs with any template.

Edge cases: null and empty texts have no paragraph and no licence; very long texts are read whole; ties go to the
family first by name; rows are judged one by one, so repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

#: The phrases by which public licences are announced, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "This work is licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice", "This work is licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license"],
    "cc": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "This work is licensed under the Creative Commons Attribution 4.0 license."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "published by the Free Software Foundation, either version 2 of the License, or any later version", "GNU Lesser General Public License"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND", "This work is licensed under the MIT License.", "Released under the MIT license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This work is licensed under the Mozilla Public License, version 2.0."],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced", "Unauthorized copying of this file, via any medium is strictly prohibited"],
}
#: What the classifier learns from: how licences are spoken of, beyond the templates that confirm them.
NOTICES = {
    "apache": ["Apache License Version 2.0 January 2004", "Licensed to the Apache Software Foundation under one or more contributor license agreements", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS", "This project is available under the terms of the Apache 2.0 license", "Use this file only in compliance with the License, of which you may obtain a copy at apache.org", "licensed under the Apache License"],
    "bsd": ["Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Distributed under the 2-clause BSD license", "Redistribution in source or binary form, modified or not, is permitted provided that the following conditions are met", "New BSD License applies to this package", "licensed under the BSD License"],
    "cc": ["Except where otherwise noted content on this site is licensed under a Creative Commons Attribution license", "CC BY 4.0", "You are free to share and adapt this material under the Creative Commons terms", "Attribution-NonCommercial-ShareAlike 4.0 International", "To view a copy of this license visit creativecommons.org", "licensed under the Creative Commons Attribution"],
    "gpl": ["This program is distributed in the hope that it will be useful but without any warranty", "You should have received a copy of the GNU General Public License along with this program", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Affero General Public License version 3", "This library is free software you can redistribute it under the terms of the GNU Lesser General Public License", "licensed under the GNU General Public License"],
    "mit": ["The MIT License (MIT)", "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies", "MIT licensed, see the file LICENSE", "Permission is granted free of charge to any person who obtains a copy of this software and its documentation", "provided as is, without warranty of any kind, express or implied", "licensed under the MIT License"],
    "mpl": ["If a copy of the MPL was not distributed with this file You can obtain one at mozilla.org", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0", "under the terms of the MPL version 2", "This source file is subject to the Mozilla Public License v 2.0", "licensed under the Mozilla Public License"],
    "reserved": ["All rights are reserved by the publisher", "Copyright all rights reserved no reproduction without written permission", "This document is confidential and proprietary and may not be copied", "unauthorised use or distribution is prohibited all rights reserved", "(c) the authors. All rights reserved"],
}
#: Terms of use that belong to no family: what the unknown class learns from.
OTHER = [
    "You may use, copy and share this program for any purpose as long as this notice is kept", "The author grants you a personal, non-transferable licence to run the program",
    "This software may be used for non-commercial purposes only", "Use of this product is subject to the end user licence agreement", "You may not sell, rent or sublicense this software to others",
    "This code is placed in the public domain and comes with no warranty", "Free to use for education and research under the licence of the university",
    "The authors are not liable for any damages that arise from the use of this software", "By installing the software you accept the terms of this licence",
    "A licence to use the data set is granted to members without charge", "Permission to copy, modify and publish the files is given if the authors are named", "The program is provided without any warranty and may be used under the following licence",
    "This font may be embedded in documents under the licence below", "You are granted the right to install one copy of the program on your own computer", "The files may be used under a custom licence, see the terms of the vendor",
]
FAMILIES = (*sorted(TEMPLATES), "other", "none")
_SLOTS = 1 << 13
#: Least calibrated probability of a family, least share of a paragraph's word pairs in its templates, and the share of plain
#: held-out paragraphs that may fall under the bound of ``none``.
SURE, LEAST_SHARE, MISS = 0.6, 0.5, 0.01


@dataclass
class Model:
    weights: np.ndarray  # slots x families
    bias: np.ndarray
    temperature: float
    pairs: dict[str, np.ndarray]  # of the templates, sorted
    least_none: float = 0.5  # probability of ``none`` below which a paragraph is no plain text


_LINE, _STOP, _SMALL = T.byte_set(lambda b: b != 0x0A), T.byte_set(lambda b: chr(b) in ".!?;:"), T.byte_set(lambda b: 0x61 <= b <= 0x7A)


def _features(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hash, hash of it with the next word of its line (0 if none), its line; and the row of each line."""
    ls, le, lr = T.spans(c.buf, c.offs, _LINE)
    if len(ls) > 1:  # a line that goes on with the one before belongs to its paragraph
        on = np.zeros(len(ls), bool)
        on[1:] = (lr[1:] == lr[:-1]) & (ls[1:] == le[:-1] + 1) & ~_STOP[c.buf[le[:-1] - 1]] & _SMALL[c.buf[ls[1:]]]
        ls, lr = ls[~on], lr[~on]
    start, end, _ = T.spans(c.buf, c.offs, T.ALNUM)
    if not len(start):
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64), lr
    h = T.Hasher(c.buf)(start, end)
    line = np.searchsorted(ls, start, "right") - 1
    pair = np.zeros(len(h), np.uint64)
    same = line[1:] == line[:-1]
    pair[:-1][same] = T.mix(h[:-1][same] * np.uint64(7) + h[1:][same]) | np.uint64(1)
    return h, pair, line, lr


def _scores(m: Model, h: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    each = m.weights[(h % np.uint64(_SLOTS)).astype(np.int64)] + np.where(pair[:, None] > 0, m.weights[(pair % np.uint64(_SLOTS)).astype(np.int64)], 0)
    n = np.diff(np.append(first, len(h)))
    return np.add.reduceat(each, first, axis=0) / np.sqrt(n)[:, None] + m.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_lines() -> list[tuple[str, int, int]]:
    """The small labelled table, written by rules from a fixed seed: text, class, and which of the wordings of its class it has."""
    rng = np.random.default_rng(29)
    parts = ["the", "on", "er", "in", "an", "tion", "de", "la", "ment", "und", "sch", "os", "mi", "ra", "that", "this", "of", "and", "work", "is", "under", "version", "software", "source", "license", "public", "free", "rights", "use"]
    filler = lambda n: ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n)]
    plain = ["This is a work of fiction", "The version of the story is free", "All of the rights of man", "She was granted permission to use the software", "The source of the river is in the north", "A copy of the public record", "Under the bridge is the mill", "He lost his driving license on the public road", "The publisher reserved a table for all", "The license plate of the car was under the snow"]
    out = []
    for _ in range(40):
        for k, family in enumerate(FAMILIES[:-1]):
            for j, t in enumerate(NOTICES.get(family, OTHER)):
                words = t.split()
                cut = int(rng.integers(0, max(1, len(words) // 4)))
                words = words[cut:] if rng.integers(3) == 0 else words
                out.append((" ".join([*filler(int(rng.integers(0, 3))), *words, *filler(int(rng.integers(0, 3)))]), k, j))
        for j in range(12):
            out.append((" ".join(filler(int(rng.integers(2, 60)))), len(FAMILIES) - 1, j))
        for j, t in enumerate(plain):
            out.append((" ".join([*filler(int(rng.integers(0, 3))), *t.split(), *filler(int(rng.integers(0, 6)))]), len(FAMILIES) - 1, j))
    return out


def _learn(words: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, used: np.ndarray, rounds: int, rate: float, l2: float) -> Model:
    """Gradient steps on the used rows, which have one line each."""
    h, pair, line = words
    first = T.per_row(line, len(y))[:-1]
    m = Model(np.zeros((_SLOTS, len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, {})
    slot, pair_slot = (h % np.uint64(_SLOTS)).astype(np.int64), (pair % np.uint64(_SLOTS)).astype(np.int64)
    n = np.sqrt(np.bincount(line))
    square = np.full_like(m.weights, 1e-4)
    for _ in range(rounds):
        g = (y - _softmax(_scores(m, h, pair, first))) * used[:, None]
        each = (g / n[:, None])[line]
        step = -l2 * m.weights
        for f in range(len(FAMILIES)):
            step[:, f] += np.bincount(slot, weights=each[:, f], minlength=_SLOTS) + np.bincount(pair_slot, weights=each[:, f] * (pair > 0), minlength=_SLOTS)
        square += step**2
        m.weights += rate * step / np.sqrt(square)
        m.bias += rate * g.mean(0)
    return m


@lru_cache(1)
def fit(rounds: int = 150, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """A model of the whole table; its temperature and bound come from one that has not seen every fifth wording."""
    lines = training_lines()
    (c,) = T.chunks(pa.array([x for x, _, _ in lines], pa.string()), 1 << 60)
    words = _features(c)[:3]
    kind, unseen = np.array([k for _, k, _ in lines]), np.array([j for _, _, j in lines]) % 5 == 4
    y = np.eye(len(FAMILIES))[kind]
    part = _learn(words, y, ~unseen, rounds, rate, l2)
    z = _scores(part, words[0], words[1], T.per_row(words[2], len(lines))[:-1])[unseen]
    temps = np.linspace(0.5, 5, 46)
    loss = [-(np.log(_softmax(z / t) + 1e-12) * y[unseen]).sum() for t in temps]
    m = _learn(words, y, np.ones(len(lines), bool), rounds, rate, l2)
    m.temperature = float(temps[int(np.argmin(loss))])
    m.least_none = float(np.quantile(_softmax(z / m.temperature)[kind[unseen] == len(FAMILIES) - 1, -1], MISS))
    for family, texts in (TEMPLATES | {"other": OTHER}).items():
        (t,) = T.chunks(pa.array(texts, pa.string()), 1 << 60)
        p = _features(t)[1]
        m.pairs[family] = np.unique(p[p > 0])
    return m


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, n_paragraphs, licences (family, line, probability of each found paragraph), n_unknown, licence (of the surest)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit())  # a model of fixed size
    kind = pa.list_(pa.struct([("family", pa.string()), ("line", pa.int32()), ("probability", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        total, unknown, found = [], [], []
        for c in T.chunks(batch.column("text")):
            h, pair, line, of_line = _features(c)
            hits: list[list[dict]] = [[] for _ in range(c.rows)]
            odd = np.zeros(c.rows, np.int64)
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(h) else np.zeros(0, np.int64)
            lines = line[first]
            rows = of_line[lines] if len(lines) else lines
            at = T.per_row(rows, c.rows)
            total.append(np.diff(at))
            if len(first):
                p = _softmax(_scores(m, h, pair, first) / m.temperature)
                best = p.argmax(1)
                last = np.append(first[1:], len(h))
                every = np.unique(np.concatenate([m.pairs[k] for k in TEMPLATES]))
                for i in np.flatnonzero((best < len(FAMILIES) - 1) | (p[:, -1] < m.least_none)).tolist():
                    family = FAMILIES[best[i]]
                    here = pair[first[i] : last[i]]
                    here = here[here > 0]
                    shared = int(np.isin(here, m.pairs[family]).sum()) if family in m.pairs else 0
                    sure = shared and shared >= LEAST_SHARE * min(len(here), 8) and p[i, best[i]] >= SURE
                    if sure and family != "other":
                        hits[rows[i]].append({"family": family, "line": i - int(at[rows[i]]), "probability": float(p[i, best[i]])})
                    elif sure or (p[i, -1] < m.least_none and np.isin(here, every).sum() >= 2):
                        odd[rows[i]] += 1
            unknown.append(odd)
            found += hits
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(total)), pa.array(found, kind), pa.array(np.concatenate(unknown))], ["doc_id", "n_paragraphs", "licences", "n_unknown"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = T.by_batch(read, run, "doc_id bigint, n_paragraphs bigint, licences array<struct<family: string, line: int, probability: double>>, n_unknown bigint")
    surest = F.sort_array(F.transform("licences", lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("family"))))[0]["family"]
    return out.withColumn("licence", F.when(F.size("licences") > 0, surest).when(F.col("n_unknown") > 0, "unknown").otherwise("none"))
