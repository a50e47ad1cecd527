"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is the text between lines without a word (blank, or only a comment
mark); within it a line break is a space. Paragraphs, and each of their lines
by itself, are read in windows of ``WINDOW`` words (half overlapping), so that
neither a wrapped notice nor a short one amid other lines is missed. A window's features are hashed word uni- and bigrams. A
multinomial logistic regression over licence families and ``none`` is trained
on the templates below, varied by dropped and added words, against a bounded
sample of windows of the corpus (``FIT_WINDOWS``, by smallest hash). Its
probabilities are calibrated on held-out variants: one temperature, and per
family the least probability that keeps 99 % of them. A window that looks like
a licence but reaches no family's probability, or shares too few word pairs
with the family's templates, is ``unknown``.

Every window of every text is scored; only the training sample is bounded.

Defined results: null and empty texts have no licence; repeated rows and
copies get the same result; an empty corpus trains on the templates alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regsight.llm.text import Words, annotate, mix, text_slices

DIMS = 1 << 14
WINDOW, STRIDE = 32, 16
FIT_WINDOWS = 4_000
VARIANTS = 60
ROUNDS = 80
CONFIRM = 0.6
UNKNOWN_PHRASES = 2
MAX_GAP = 8  # words between two parts of one statement
NONE, UNKNOWN = "none", "unknown"

#: Statements per licence family, short notices and sentences of the notices' bodies.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU AGPL v3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "You may not use this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License "
               "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
               "or implied."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.",
              "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
              "software and accompanying documentation covered by this license"],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the 2-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and "
            "the following disclaimer.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission."],
    "cc-by": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Licensed under CC0 1.0 Universal.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work."],
    "epl": ["Licensed under the Eclipse Public License 2.0.",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
            "Licensed under the GNU GPL v3.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
            "Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "Licensed under the GNU LGPL v2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "mit": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files",
            "to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at "
            "http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.",
                    "All rights reserved. No part of this work may be reproduced without written permission.",
                    "Copyright. All rights reserved. Proprietary and confidential."],
    "unlicense": ["Released under the Unlicense.",
                  "This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
                  "in source code form or as a compiled binary, for any purpose"],
    "zlib": ["Released under the zlib License.",
             "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software.",
             "Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely"],
}
#: licence-like statements of no family above, for the unknown class
OTHER = ["Licensed under the terms of the {} License.", "Released under the {} Public License, version 1.",
         "This work is distributed under the {} licence.", "Use of this work is subject to the {} license agreement."]

FIELDS = [T.StructField("license", T.StringType()), T.StructField("confidence", T.DoubleType()),
          T.StructField("similarity", T.DoubleType()), T.StructField("n_paragraphs", T.LongType()),
          T.StructField("licenses", T.ArrayType(T.StructType([
              T.StructField("family", T.StringType()), T.StructField("confidence", T.DoubleType()),
              T.StructField("similarity", T.DoubleType()), T.StructField("start", T.IntegerType()),
              T.StructField("end", T.IntegerType())])))]


class Windows:
    """Word windows of the paragraphs and lines of a slice: ``low``/``high`` word bounds, ``line``, ``doc``."""

    def __init__(self, words: Words):
        breaks = np.flatnonzero(words.buf == 10)
        line = np.searchsorted(breaks, words.start)
        doc = words.doc()
        fresh, broken = np.ones(len(words), bool), np.ones(len(words), bool)
        fresh[1:] = (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])
        broken[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        self.paragraphs = np.bincount(doc[fresh], minlength=len(words.first) - 1)
        begin, lines = np.flatnonzero(fresh), np.flatnonzero(broken)
        size, line_size = (np.diff(np.append(x, len(words))) for x in (begin, lines))
        # a paragraph of one line is read once
        own = ~(fresh[lines] & (line_size == size[np.cumsum(fresh)[lines] - 1]))
        begin, size = np.append(begin, lines[own]), np.append(size, line_size[own])
        many = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.low = np.repeat(begin, many) + turn * STRIDE
        self.high = np.minimum(self.low + WINDOW, np.repeat(begin + size, many))
        self.doc = doc[self.low] if len(begin) else np.zeros(0, int)
        one = words.hash
        two = np.zeros_like(one)  # the bigram that begins at a word, in its paragraph
        two[:-1] = mix(one[:-1] * np.uint64(3) + one[1:])
        pair = np.zeros(len(one), bool)
        pair[:-1] = ~fresh[1:]
        self.uni = (one >> np.uint64(50)).astype(np.int64)
        self.bi = np.where(pair, (two >> np.uint64(50)).astype(np.int64), DIMS)  # DIMS: no feature
        self.pairs = np.where(pair, two, np.uint64(0))


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray      # (DIMS + 1) x classes; the last row stays 0
    bias: np.ndarray
    temperature: float
    least: np.ndarray        # per class, the calibrated least probability
    templates: dict[str, list[frozenset]]
    phrases: frozenset       # word pairs of licence statements of any kind

    def likely(self, w: Windows) -> np.ndarray:
        """Windows that can be confirmed at all: they hold two word pairs of templates or phrases."""
        marks = np.sort(np.array(list(self.phrases.union(*(t for f in self.templates.values() for t in f))), np.uint64))
        at = np.minimum(np.searchsorted(marks, w.pairs), len(marks) - 1)
        hits = np.concatenate([[0], np.cumsum(marks[at] == w.pairs)])
        return hits[np.maximum(w.high - 1, w.low)] - hits[w.low] >= UNKNOWN_PHRASES

    def probabilities(self, w: Windows) -> np.ndarray:
        """Class probabilities per window: a sum over its grams by prefix sums."""
        uni = np.zeros((len(w.uni) + 1, len(self.bias)))
        np.cumsum(self.weights[w.uni], axis=0, out=uni[1:])
        bi = np.zeros_like(uni)
        np.cumsum(self.weights[w.bi], axis=0, out=bi[1:])
        grams = 2 * (w.high - w.low) - 1
        z = uni[w.high] - uni[w.low] + bi[w.high - 1] - bi[w.low]
        return _softmax((z / np.sqrt(grams)[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _windows(texts: list[str]) -> tuple[Words, Windows]:
    _, _, buf, offsets = next(text_slices(pa.array(texts, pa.string()), 1 << 40, 1 << 30))
    words = Words(buf, offsets)
    return words, Windows(words)


def _gram_lists(w: Windows) -> list[np.ndarray]:
    out = []
    for lo, hi in zip(w.low.tolist(), w.high.tolist(), strict=True):
        own = np.concatenate([w.uni[lo:hi], w.bi[lo:hi - 1]])
        out.append(own[own < DIMS])
    return out


def _variants(rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Training statements and their classes."""
    texts, classes = [], []
    filler = ["the", "project", "source", "code", "and", "documentation", "are", "2021", "author", "see", "file"]
    for family, statements in TEMPLATES.items():
        for s in statements:
            words = s.split()
            for v in range(VARIANTS):
                own = [x for x in words if v == 0 or rng.random() > 0.06]
                if v % 3 == 2:
                    own = list(rng.choice(filler, rng.integers(1, 6))) + own
                texts.append(" ".join(own) or s)
                classes.append(family)
    syllables = ["ba", "ko", "ri", "tel", "mon", "zu", "vex", "qua", "lor", "fin"]
    for s in OTHER:
        for _ in range(2 * VARIANTS):
            texts.append(s.format("".join(rng.choice(syllables, rng.integers(2, 5))).title()))
            classes.append(UNKNOWN)
    return texts, classes


def corpus_sample(docs: DataFrame, text_col: str, fit_windows: int) -> list[list[int]]:
    """Grams of the ``fit_windows`` distinct windows of least hash; ties of the hash are one window."""
    def least(batches):
        best: dict[int, list[int]] = {}
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column(0)):
                words = Words(buf, offsets)
                if not len(words):
                    continue
                w = Windows(words)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hash)])
                draw = mix(sums[w.high] - sums[w.low] + np.uint64(7)) >> np.uint64(1)
                for k in np.argsort(draw)[:fit_windows].tolist():
                    own = np.concatenate([w.uni[w.low[k]:w.high[k]], w.bi[w.low[k]:w.high[k] - 1]])
                    best[int(draw[k])] = own[own < DIMS].tolist()
            best = {d: best[d] for d in sorted(best)[:fit_windows]}
        yield pa.RecordBatch.from_pydict({"draw": pa.array(list(best), pa.int64()),
                                          "grams": pa.array(list(best.values()), pa.list_(pa.int32()))})

    some = docs.select(text_col).mapInArrow(least, "draw long, grams array<int>").dropDuplicates(["draw"])
    return [r.grams for r in some.orderBy("draw").limit(fit_windows).collect()]


def fit(docs: DataFrame, *, text_col: str = "text", fit_windows: int = FIT_WINDOWS, seed: int = 11) -> Model:
    """The classifier, from the templates and a sample of the corpus."""
    rng = np.random.default_rng(seed)
    texts, classes = _variants(rng)
    names = [NONE, *TEMPLATES, UNKNOWN]
    _, w = _windows(texts)
    grams, label = _gram_lists(w), [names.index(classes[d]) for d in w.doc]
    templates = {}
    for family, statements in TEMPLATES.items():
        _, own = _windows(statements)
        templates[family] = [_pairs(own, d) for d in range(len(statements))]
    sample = corpus_sample(docs, text_col, fit_windows)
    # every other variant stands in a window of background text
    pool = np.array([g for own in sample for g in own] or [0])
    for k in range(0, len(grams), 2):
        room = max(1, 2 * WINDOW - len(grams[k]))
        grams[k] = np.concatenate([grams[k], rng.choice(pool, rng.integers(0, room))])[:2 * WINDOW]
    marks = [set(g.tolist()) for g in _gram_lists(_windows([s for f in TEMPLATES.values() for s in f])[1])]
    for own in sample:
        have = set(own)
        # windows that hold most of a template are licences, not background
        if own and max(len(m & have) / len(m) for m in marks) < 0.5:
            grams.append(np.array(own))
            label.append(0)
    label = np.array(label)
    held = rng.random(len(label)) < 0.2
    # every statement weighs alike, whatever its family's number of them
    many = np.array([4, *[len(s) for s in TEMPLATES.values()], len(OTHER)], float)
    weights, bias = _train([g for g, h in zip(grams, held, strict=True) if not h], label[~held], many)
    z = np.stack([weights[g].sum(axis=0) / np.sqrt(max(1, len(g))) + bias for g in grams])
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(
        _softmax(z[held] / t)[np.arange(held.sum()), label[held]] + 1e-12).mean())
    p = _softmax(z[held] / temperature)
    least = np.full(len(names), 0.5)
    for c in range(1, len(names)):
        own = p[label[held] == c, c]
        if len(own):
            least[c] = min(0.9, max(0.3, float(np.quantile(own, 0.01))))
    return Model(names, np.vstack([weights, np.zeros(len(names))]).astype(np.float32), bias, temperature, least,
                 templates, _pairs(_windows([p for s in OTHER for p in s.split("{}")])[1]))


def _pairs(w: Windows, d: int | None = None) -> frozenset:
    """Word pairs of text ``d``, or of all texts."""
    out = set()
    for k in range(len(w.doc)) if d is None else np.flatnonzero(w.doc == d):
        out.update(w.pairs[w.low[k]:w.high[k] - 1].tolist())
    return frozenset(out - {0})


def _train(grams: list[np.ndarray], label: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by full-batch gradient steps with momentum, classes weighted by ``many``."""
    classes = len(many)
    flat = np.concatenate(grams)
    size = np.array([len(g) for g in grams])
    row = np.repeat(np.arange(len(grams)), size)
    begin = np.cumsum(size) - size
    scale = 1 / np.sqrt(np.maximum(size, 1))
    target = np.eye(classes)[label]
    share = many / many.mean() / np.maximum(np.bincount(label, minlength=classes), 1)
    cost = (share / (1 / np.maximum(np.bincount(label, minlength=classes), 1))[np.unique(label)].sum())[label]
    weights, bias = np.zeros((DIMS, classes)), np.zeros(classes)
    speed, bias_speed = np.zeros_like(weights), np.zeros(classes)
    for _ in range(ROUNDS):
        z = np.add.reduceat(weights[flat], begin, axis=0) * scale[:, None] + bias
        wrong = (_softmax(z) - target) * cost[:, None]
        step = (wrong * scale[:, None])[row]
        grad = np.stack([np.bincount(flat, step[:, c], DIMS) for c in range(classes)], 1) + 1e-6 * weights
        speed = 0.9 * speed - 12.0 * grad
        bias_speed = 0.9 * bias_speed - 2.0 * wrong.sum(axis=0)
        weights, bias = weights + speed, bias + bias_speed
    return weights, bias


def scan_licenses(docs: DataFrame, model: Model, *, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``license`` (the most confident family of
    the text, ``unknown`` or ``none``), its ``confidence`` and ``similarity``,
    ``n_paragraphs`` and ``licenses`` (every statement that is confirmed, in code-point
    spans; windows that overlap on one statement of a family are one span)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(column: pa.Array) -> dict[str, pa.Array]:
        model = shared.value
        found_all, lines = [], []
        for _, _, buf, offsets in text_slices(column):
            words = Words(buf, offsets)
            found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            if len(words):
                w = Windows(words)
                lines += w.paragraphs.tolist()
                p = model.probabilities(w)
                judged = [_judge(model, w, k, p[k]) for k in np.flatnonzero((p[:, 0] < 0.5) & model.likely(w)).tolist()]
                points = np.append(0, np.cumsum((buf & 0xC0) != 0x80)) if any(judged) else None
                for confidence, family, similarity, lo, hi in filter(None, judged):
                    d = int(np.searchsorted(words.first, lo, "right")) - 1
                    start, end = (int(points[x] - points[offsets[d]]) for x in (words.start[lo], words.end[hi]))
                    found[d].append({"family": family, "confidence": confidence, "similarity": similarity,
                                     "start": start, "end": end})
            else:
                lines += [0] * (len(offsets) - 1)
            found_all += [_merged(f) for f in found]
        top = [max(f, key=lambda x: (x["family"] != UNKNOWN, x["confidence"], -x["start"])) if f else None
               for f in found_all]
        return {"license": pa.array([t["family"] if t else NONE for t in top], pa.string()),
                "confidence": pa.array([t["confidence"] if t else 0.0 for t in top], pa.float64()),
                "similarity": pa.array([t["similarity"] if t else 0.0 for t in top], pa.float64()),
                "n_paragraphs": pa.array(lines, pa.int64()),
                "licenses": pa.array(found_all, pa.list_(pa.struct([
                    ("family", pa.string()), ("confidence", pa.float64()), ("similarity", pa.float64()),
                    ("start", pa.int32()), ("end", pa.int32())])))}

    return annotate(docs, kernel, FIELDS, text_col, keep)


def _judge(model: Model, w: Windows, k: int, p: np.ndarray) -> tuple | None:
    """(confidence, family, similarity, first word, last word) of a window that looks like
    a licence; None if no template bears it out."""
    pairs = w.pairs[w.low[k]:w.high[k] - 1].tolist()
    own = set(pairs)
    similar = np.array([max((len(t & own) / len(t) for t in model.templates.get(f, ())), default=0.0)
                        for f in model.families])
    # families of nearly the same words are told apart by their templates
    weight = p * similar ** 4
    c = int(np.argmax(weight))
    similarity = float(similar[c])
    confidence = float((1 - p[0]) * weight[c] / max(weight.sum(), 1e-300))
    if similarity >= CONFIRM and confidence >= model.least[c]:
        family = model.families[c]
        best = max(model.templates[family], key=lambda t: len(t & own) / len(t))
        return confidence, family, similarity, *_place(pairs, best, int(w.low[k]))
    # the unknown class is confirmed by licence phrases that no background text has
    if len(own & model.phrases) < UNKNOWN_PHRASES:
        return None
    return float(1 - p[0]), UNKNOWN, similarity, *_place(pairs, model.phrases, int(w.low[k]))


def _place(pairs: list[int], wanted: frozenset, low: int) -> tuple[int, int]:
    """First and last word of the densest run of ``wanted`` pairs in a window that begins at ``low``."""
    at = np.flatnonzero([x in wanted for x in pairs])
    run = max(np.split(at, np.flatnonzero(np.diff(at) > MAX_GAP) + 1), key=len)
    return low + int(run[0]), low + int(run[-1]) + 1


def _merged(found: list[dict]) -> list[dict]:
    """Spans of a text: overlapping ones of a family are one; a span inside a more similar
    one of another family, and an unknown one across a known one, is the same statement."""
    spans: list[dict] = []
    for x in sorted(found, key=lambda x: (x["family"], x["start"], x["end"])):
        last = spans[-1] if spans else None
        if last and last["family"] == x["family"] and x["start"] < last["end"]:
            for name in ("end", "confidence", "similarity"):
                last[name] = max(last[name], x[name])
        else:
            spans.append(dict(x))
    spans.sort(key=lambda x: (x["start"], -x["end"], x["family"]))
    gone, current = set(), {}  # per family the span begun last: earlier ones have ended
    for i, x in enumerate(spans):
        for j in current.values():
            y = spans[j]
            if y["family"] == x["family"] or y["end"] <= x["start"]:
                continue
            for a, b, own in ((x, y, i), (y, x, j)):
                inside = b["start"] <= a["start"] and a["end"] <= b["end"] and a["similarity"] < b["similarity"]
                if b["family"] != UNKNOWN and (a["family"] == UNKNOWN or inside):
                    gone.add(own)
        current[x["family"]] = i
    return [x for i, x in enumerate(spans) if i not in gone]
