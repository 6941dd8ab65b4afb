"""License scan: a trained paragraph classifier with template comparison.

A paragraph is a line, or neighbouring lines without a blank one between that hold enough
word pairs of a template together (a wrapped notice, reported at its first line). Its features are the distinct hashed 1- to 3-grams of its words
(runs of letters and digits, lower case A-Z, every run of digits made one sign). A sparse
multinomial logistic regression over license families and "none" scores it; temperature
and the bar for an answer are calibrated on variants that were not trained on, so that
text unlike any family becomes "unknown" rather than a family. A predicted family counts
only if one of its templates confirms it: enough of the template's word pairs stand in the
paragraph, where a pair weighs the more the fewer families have it, so words that most grants
share can't confirm a license that no template knows. The templates also make the training set, together with a bounded sample of
the table's own lines (``sample_rows`` rows) as "none".

Reported are license paragraphs (a family) and paragraphs that look like a license grant
but that no template confirms (family "unknown"). Lines of a confirmed wrapped notice are not
reported as unknown by themselves. Null or empty texts hold none. Repeated
rows are reported each. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import sample_by_hash
from rallyframe.llm.text import NOT_ALNUM, U, Words, find_words, grams, raw, strings

BITS = 18
DIGIT = U(0x51ED270B9D3F1C27)
#: Sentences by which public license texts and notices are known.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License (MIT).",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2 or later.",
        "Licensed under the GPL v3.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL v2.1.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "Released under CC0 1.0 Universal.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Lines that speak of licenses without granting one; they teach "none".
NEAR_MISSES = [
    "You need a driving license to rent a car.",
    "The license fee is due every year under the terms of the contract.",
    "General public transport runs every ten minutes.",
    "The Apache helicopter landed at noon.",
    "He studied at MIT and released a book under his own name.",
    "Permission was granted to leave the room.",
    "The foundation published a free guide to software.",
    "Creative work is common in this international team.",
    "Version 2.0 of the program was released in May.",
    "The lesser known work of the author is in the public domain of ideas.",
    "Fishing is permitted provided that the following rules are kept.",
    "The rights of all members are reserved until the meeting.",
]
SMALL_WORDS = frozenset("a an and any by for from in is of or that the this to under with".split())
FAMILIES = ["none", *TEMPLATES]


def digit_words(words: Words) -> np.ndarray:
    """Which words are digits only."""
    is_digit = ((words.data >= 48) & (words.data <= 57)) | words.separator[words.data]
    return np.bitwise_and.reduceat(is_digit, words.starts) if len(words.starts) else np.zeros(0, bool)


def word_hashes(words: Words) -> np.ndarray:
    return np.where(digit_words(words), DIGIT, words.hashes(seed=13, lower=True))


def occurrences(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and line of each 1- to 3-gram."""
    index, own = [], []
    for n in (1, 2, 3):
        g, at = grams(h, first, n, salt=n)
        index.append((g >> U(64 - BITS)).astype(np.int64))
        own.append(np.searchsorted(first, at, "right") - 1)
    return np.concatenate(index), np.concatenate(own)


def lines_of(column) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words by line, and the row and line number in its row of each line."""
    data, off = raw(strings(column))
    breaks = np.flatnonzero(data == 10) + 1
    cuts = np.union1d(off, breaks)
    row = np.searchsorted(off, cuts[:-1], "right") - 1
    lead = np.searchsorted(row, np.arange(len(off) - 1))
    return find_words(data, cuts, NOT_ALNUM), row, np.arange(len(row)) - lead[row]


def feature_rows(texts: list[str]) -> list[np.ndarray]:
    words = find_words(*raw(strings(pa.array([t.replace("\n", " ") for t in texts], pa.string()))), NOT_ALNUM)
    index, own = occurrences(word_hashes(words), words.first)
    return [np.unique(index[own == i]) for i in range(len(texts))]


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    words = find_words(*raw(strings(pa.array(texts, pa.string()))), NOT_ALNUM)
    h = word_hashes(words)
    return [h[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]


def pairs(h: np.ndarray) -> set:
    return set(zip(h.tolist(), h[1:].tolist(), strict=False)) if len(h) > 1 else {(x,) for x in h.tolist()}


def spans(at: np.ndarray, key: np.ndarray, need: float, reach: int) -> list[tuple[int, int]]:
    """First and last word of stretches of ``reach`` words at most in which ``need`` of the pairs (place, key) stand."""
    out, a = [], 0
    while a < len(at):
        mine = key[a : np.searchsorted(at, at[a] + reach, "right")]
        first = np.unique(mine, return_index=True)[1]
        if len(first) < need:
            a += 1
            continue
        mine = mine[: first.max() + 1]
        last = len(mine) - 1 - np.unique(mine[::-1], return_index=True)[1]
        start, a = int(at[a + last.min()]), a + len(mine)
        while a < len(at) and at[a] <= at[a - 1] + 1:  # pairs that follow on
            a += 1
        out.append((start, int(at[a - 1]) + 1))
    return out


@dataclass
class Model:
    index: np.ndarray  #: used features, sorted
    weight: np.ndarray  #: used features by families
    bias: np.ndarray
    temperature: float
    bar: float
    templates: dict[str, list[dict]]  #: word pairs with their weights
    confirm: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        e = np.exp((z - z.max(-1, keepdims=True)) / self.temperature)
        return e / e.sum(-1, keepdims=True)

    def similarity(self, family: str, h: np.ndarray) -> float:
        """Largest share of a template's word pairs that the paragraph has; a pair weighs the more the fewer families have it."""
        have = pairs(h)
        return max(sum(w for x, w in t.items() if x in have) / sum(t.values()) for t in self.templates[family])


def weighted(templates: dict[str, list[set]]) -> dict[str, list[dict]]:
    """Weights of word pairs: the logarithm of families over those with the pair, so that words that most grants share confirm none."""
    n = Counter(x for sets in templates.values() for x in set().union(*sets))
    return {f: [{x: math.log(1 + len(templates) / n[x]) if n[x] == 1 else math.log(len(templates) / n[x]) + 0.05 for x in t} for t in sets] for f, sets in templates.items()}


class Wrapped:
    """Finds lines that hold a template together."""

    def __init__(self, model: Model):
        sets = [t for f in model.templates.values() for t in f]
        self.size = np.array([len(t) for t in sets])
        two = np.array([x for t in sets for x in t], U).reshape(-1, 2)
        key, owner = grams(two.reshape(-1), np.arange(0, 2 * len(two) + 1, 2), 2)[0], np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.confirm = key[order], owner[order], model.confirm

    def lines(self, words: Words, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """First and last line of each stretch of several lines."""
        blank = np.diff(words.first) == 0
        part = np.cumsum(np.r_[False, (row[1:] != row[:-1]) | blank[1:]]) if len(row) else np.zeros(0, np.int64)
        g, at = grams(h, np.append(words.first[:-1][np.r_[True, part[1:] != part[:-1]]], words.first[-1]) if len(row) else words.first, 2)
        lo, hi = np.searchsorted(self.key, g), np.searchsorted(self.key, g, "right")
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        group = part[np.searchsorted(words.first, at, "right") - 1].astype(np.int64) * len(self.size) + self.owner[entry]
        order = np.argsort(group, kind="stable")
        at, entry, group = at[order], entry[order], group[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)] if len(group) else [0]
        out = set()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            size = self.size[group[a] % len(self.size)]
            need = self.confirm * size
            if z - a >= need and len(np.unique(entry[a:z])) >= need:
                for x, y in spans(at[a:z], entry[a:z], need, 2 * size + 20):
                    first, last = (int(np.searchsorted(words.first, w, "right")) - 1 for w in (x, y))
                    if first < last:
                        out.add((first, last))
        return sorted(out)


def varied(text: str, r: random.Random, filler: list[str]) -> str:
    """A template as it turns up: other numbers, a word lost or added, text before or after."""
    words = text.split()
    words = [w if not w.strip(".,();").replace(".", "").isdigit() else f"{r.randint(1, 4)}.{r.randint(0, 9)}" for w in words]
    loose = [i for i, w in enumerate(words) if w.lower() in SMALL_WORDS]
    if r.random() < 0.3 and loose:  # other words may be what tells two families apart
        del words[r.choice(loose)]
    if r.random() < 0.3:
        words.insert(r.randrange(len(words) + 1), r.choice(filler))
    if r.random() < 0.4:
        words = r.sample(filler, min(len(filler), r.randint(1, 12))) + words
    if r.random() < 0.4:
        words += r.sample(filler, min(len(filler), r.randint(1, 12)))
    text = " ".join(words)
    return text.upper() if r.random() < 0.05 else text


def train(lines: list[str], seed: int = 9, copies: int = 24, epochs: int = 12, rate: float = 0.3, l1: float = 2e-4, confirm: float = 0.6) -> Model:
    """``lines``: ordinary lines of the corpus, for "none" and as surroundings of the variants."""
    r = random.Random(seed)
    filler = [w for t in lines[:200] for w in t.split()] or ["text"]
    rows: list[tuple[str, int]] = [(t, 0) for t in lines] + [(t, 0) for t in NEAR_MISSES * 10]
    for k, family in enumerate(FAMILIES[1:], 1):
        rows += [(varied(t, r, filler), k) for t in TEMPLATES[family] for _ in range(copies)] + [(t, k) for t in TEMPLATES[family]] * 3
    r.shuffle(rows)
    cut = len(rows) * 4 // 5
    feats, labels = feature_rows([t for t, _ in rows]), [y for _, y in rows]
    w, s, bias = np.zeros((1 << BITS, len(FAMILIES)), np.float32), np.full((1 << BITS, len(FAMILIES)), 1e-6, np.float32), np.zeros(len(FAMILIES))
    eye = np.eye(len(FAMILIES))
    for _ in range(epochs):
        for i in range(cut):
            f = feats[i]
            z = w[f].sum(0) + bias
            p = np.exp(z - z.max())
            g = p / p.sum() - eye[labels[i]]
            bias -= 0.02 * g
            s[f] += g * g
            step = rate / np.sqrt(s[f])
            v = w[f] - step * g
            w[f] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
    used = np.flatnonzero(np.abs(w).max(1) > 0.02)
    held = [(w[f].sum(0) + bias, y) for f, y in zip(feats[cut:], labels[cut:], strict=True)]
    z, y = np.array([h for h, _ in held]), np.array([y for _, y in held])

    def loss(t: float) -> float:
        e = (z - z.max(1, keepdims=True)) / t
        return -(e[np.arange(len(y)), y] - np.log(np.exp(e).sum(1))).mean()

    words = find_words(*raw(strings(pa.array([t for f in FAMILIES[1:] for t in TEMPLATES[f]], pa.string()))), NOT_ALNUM)
    parts = iter(np.split(word_hashes(words), words.first[1:-1]))
    model = Model(used, w[used], bias, min(np.geomspace(0.25, 8, 26), key=loss), 0.5, weighted({f: [pairs(next(parts)) for _ in TEMPLATES[f]] for f in FAMILIES[1:]}), confirm)
    p = model.probability(z)
    wrong = p[np.arange(len(y)), p.argmax(1)][(p.argmax(1) != y) & (p.argmax(1) > 0)]
    model.bar = float(min(0.9, max(0.5, np.quantile(wrong, 0.9)))) if len(wrong) else 0.5
    return model


def sample_lines(docs: DataFrame, text_col: str, sample_rows: int) -> list[str]:
    """One line of up to 400 characters of each of a bounded sample of rows, the same ones each time, without lines that name a license or hold a template."""
    line = F.try_element_at(F.filter(F.split(text_col, "\n"), lambda x: (F.length(x) > 0) & (F.length(x) <= 400)), F.lit(1))
    rows = sample_by_hash(docs.select(line.alias("t")), sample_rows)
    known = [pairs(h) for t in TEMPLATES.values() for h in hashes_of(t)]
    texts = [t for t in rows if t.strip() and "licen" not in t.lower()]
    return [t for t, h in zip(texts, hashes_of(texts), strict=True) if not any(len(k & pairs(h)) >= 0.6 * len(k) for k in known)]


def scan(docs: DataFrame, model: Model | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, family, probability, similarity) of each license paragraph; lines count from 0."""
    model = model or train(sample_lines(docs, text_col, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        m = shared.value
        slot = np.full(1 << BITS, -1, np.int32)
        slot[m.index] = np.arange(len(m.index))
        wrapped = Wrapped(m)

        def judged(p: np.ndarray, own_h: np.ndarray) -> tuple[str, float, float]:
            best = 1 + int(p[1:].argmax())
            alike = m.similarity(FAMILIES[best], own_h)
            return FAMILIES[best] if alike >= m.confirm and p[best] >= m.bar else "unknown", p[best], alike

        for b in batches:
            for a in range(0, b.num_rows, 256):
                words, row, line = lines_of(b["t"].slice(a, 256))
                h = word_hashes(words)
                index, own = occurrences(h, words.first)
                s = slot[index]
                hit = np.unique(own[s >= 0].astype(np.int64) * len(slot) + s[s >= 0])
                at, s = hit // len(slot), hit % len(slot)
                some, short = np.unique(at, return_inverse=True)
                z = np.zeros((len(some), len(FAMILIES))) + m.bias
                np.add.at(z, short, m.weight[s])
                p = m.probability(z) if len(z) else z
                found = {}  # by first and last line
                for k in np.flatnonzero(1 - p[:, 0] >= m.bar) if len(z) else ():
                    found[some[k], some[k]] = judged(p[k], h[words.first[some[k]] : words.first[some[k] + 1]])
                taken = {}  # family by line
                for (x, _), (family, *_) in found.items():
                    taken[x] = family
                more = []
                for x, y in wrapped.lines(words, h, row):
                    own_h = h[words.first[x] : words.first[y + 1]]
                    s = slot[np.unique(occurrences(own_h, np.array([0, len(own_h)]))[0])]
                    q = m.probability((m.weight[s[s >= 0]].sum(0) + m.bias)[None])[0]
                    if 1 - q[0] >= m.bar:
                        more.append((x, y, judged(q, own_h)))
                for x, y, got in sorted(more, key=lambda v: (v[2][0] == "unknown", -v[2][2], v[0])):
                    inside = [taken.get(k) for k in range(x, y + 1)]
                    if got[0] == "unknown" and any(inside):
                        continue
                    for k in range(x, y + 1):  # a line that holds less of the notice than all its lines do goes up in it
                        if (k, k) in found and found[k, k][0] == got[0] != "unknown" and found[k, k][2] < got[2]:
                            taken[k] = None
                    inside = [taken.get(k) for k in range(x, y + 1)]
                    for k in range(x, y + 1):
                        if taken.get(k) in (None, "unknown"):
                            found.pop((k, k), None)
                            taken[k] = got[0]
                    if got[0] not in inside:
                        found[x, y] = got
                keys = sorted(found)
                out = {"doc": [a + row[x] for x, _ in keys], "line": [line[x] for x, _ in keys]} | {c: [found[k][j] for k in keys] for j, c in enumerate(("family", "probability", "similarity"))}
                yield pa.record_batch([b["i"].take(pa.array(out["doc"], pa.int64())), pa.array(out["line"], pa.int64()), pa.array(out["family"], pa.string()), pa.array(out["probability"], pa.float64()), pa.array(out["similarity"], pa.float64())], names=["doc_id", "line", "family", "probability", "similarity"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['i']}, line long, family string, probability double, similarity double")
