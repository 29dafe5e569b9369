"""Licence scan: a paragraph classifier over hashed word n-grams (multinomial logistic
regression) proposes a licence family, a calibrated threshold gives an "unknown" class,
and comparison with the family's templates confirms the proposal.

Defined results: null and empty texts have no paragraphs and no licence; an empty table gives
an empty result, and fitting on one still knows the templates. Every input row gives one output
row with a (possibly empty) list of findings in text order; only the id and text columns are
read. A licence that is denied, and a relative of a known one, are "unknown".
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WordHashes, as_bytes, grams, map_rows, slices

# Short forms in which licences are declared, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache-1.1": (
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the Apache Software License, Version 1.1.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ),
}
# Short identifiers of the families.
SPDX = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache-1.1": ("Apache-1.1",), "apache-2.0": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-nd": ("CC-BY-ND-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by": ("CC-BY-4.0",), "cc0": ("CC0-1.0",), "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "isc": ("ISC",), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "mit": ("MIT",),
    "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",),
}
# Words of a licence's name that tell it from its relatives: where a template has one, the text must
# have it too, and where the template has none, the text must not have it among the matched words.
TELLING = frozenset(
    b"affero apache attribution attribution-noncommercial attribution-noderivatives attribution-sharealike attribution-noncommercial-sharealike "
    b"attribution-noncommercial-noderivatives bsd bsd-style by by-nc by-nc-nd by-nc-sa by-nd by-sa cc0 isc lesser library mit mozilla "
    b"noncommercial noderivatives sharealike unlicense 1.0 1.1 2.0 2.1 3.0 4.0".split())
# Words that deny what follows.
DENIALS = frozenset((b"not", b"never", b"no", b"nor", b"neither", b"isn", b"aren", b"wasn"))
# A denial this many words before the first matched word counts.
DENIAL_REACH = 3
TEMPLATES = {family: (*texts, *(f"SPDX-License-Identifier: {name}" for name in SPDX[family])) for family, texts in TEMPLATES.items()}
UNKNOWN = "unknown"

BUCKETS = 1 << 14
# Parts of words that mention licensing, alone or inside a compound; a space stands for a word's start.
_CUES = (b"licenc", b"licens", b"copyright", b"redistribut", b" permission", b" warrant", b" gpl", b" agpl", b" lgpl")
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def normal_words(paragraph: bytes) -> list[bytes]:
    return _WORD.findall(paragraph.lower())


_HASHES = WordHashes()
# Words of lines that are scored at once.
SCORED_WORDS = 20_000


def _buckets(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed 1- and 2-grams of each line (which must hold a word), and where each line's begin."""
    hashes = _HASHES.of([w for words in lines for w in words])
    line = np.repeat(np.arange(len(lines)), [len(words) for words in lines])
    inside = line[1:] == line[:-1]
    size = np.uint64(BUCKETS)
    one = line * BUCKETS + (hashes % size).astype(np.int64)
    two = line[1:][inside] * BUCKETS + (grams(hashes, 2)[inside] % size).astype(np.int64)
    keys = np.unique(np.concatenate((one, two)))
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(lines)) * BUCKETS)


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float
    confirm: float
    templates: dict[str, list[tuple[frozenset, int]]]

    def probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        """One row per line, each of which must hold a word."""
        at, starts = _buckets(lines)
        sizes = np.diff(starts, append=len(at))
        z = (np.add.reduceat(self.weights[at], starts, axis=0) / np.sqrt(sizes)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def proposals(self, lines: list[list[bytes]]) -> list[tuple[int, float]]:
        """The likeliest class and its probability of every line; unknown for lines without words."""
        out = [(len(self.families) - 1, 1.0)] * len(lines)
        some, words = [], 0
        for i, line in enumerate([*lines, None]):
            if line is None or words >= SCORED_WORDS:
                if some:
                    p = self.probabilities([lines[j] for j in some])
                    best = p.argmax(axis=1)
                    for j, k, top in zip(some, best.tolist(), p[np.arange(len(some)), best].tolist()):
                        out[j] = k, top
                some, words = [], 0
            if line:
                some.append(i)
                words += len(line)
        return out

    @cached_property
    def _known(self) -> frozenset:
        return frozenset().union(*(g for ts in self.templates.values() for g, _ in ts))

    @cached_property
    def _longest(self) -> int:
        return max(size for ts in self.templates.values() for _, size in ts)

    @cached_property
    def _holders(self) -> dict[tuple[bytes, bytes], list[tuple[str, int]]]:
        """Bigram -> the templates that hold it."""
        out: dict = {}
        for family, ts in self.templates.items():
            for i, (g, _) in enumerate(ts):
                for pair in g:
                    out.setdefault(pair, []).append((family, i))
        return out

    def overlaps(self, words: list[bytes]) -> dict[str, float]:
        """Of each family with any, the largest share of a template's bigrams that the words hold; templates
        whose telling words the matched span misses or exceeds, or that are denied, do not count."""
        pairs = list(zip(words, words[1:]))
        held: dict[tuple[str, int], int] = {}
        for pair in self._known.intersection(pairs):
            for template in self._holders[pair]:
                held[template] = held.get(template, 0) + 1
        best: dict[str, float] = {}
        for (family, i), count in held.items():
            g = self.templates[family][i][0]
            share = count / len(g)
            if share > best.get(family, 0.0) and (share < self.confirm or self._aligned(g, words, pairs)):
                best[family] = share
        return best

    def overlap(self, family: str, words: list[bytes]) -> float:
        return self.overlaps(words).get(family, 0.0)

    @staticmethod
    def _aligned(template: frozenset, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> bool:
        hits = [i for i, pair in enumerate(pairs) if pair in template]
        first, last = hits[0], hits[-1] + 2
        own = {w for pair in template for w in pair}
        # One more word at each end: a template's last word may be replaced there.
        span = set(words[max(0, first - 1):last + 1])
        if not (own & TELLING <= span and span & TELLING <= own):
            return False
        return DENIALS.isdisjoint(words[max(0, first - DENIAL_REACH):first]) and DENIALS.isdisjoint(set(words[first:last]) - own)

    def find(self, words: list[bytes], proposal: tuple[int, float] | None = None) -> tuple[str, float, float] | None:
        """(family or unknown, probability, template overlap), or None if nothing speaks of a licence:
        neither the model proposes a family nor is licensing mentioned."""
        if not words:
            return None
        k, p = proposal or self.proposals([words])[0]
        family = self.families[k]
        overlap = self.overlap(family, words) if family != UNKNOWN else 0.0
        if family == UNKNOWN or p < self.accept or overlap < self.confirm:
            if family == UNKNOWN or p < self.accept:
                said = b" " + b" ".join(words)
                if not any(cue in said for cue in _CUES):
                    return None
            family = UNKNOWN
        return family, p, overlap

    def findings(self, text: bytes) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Number of lines with a word, and the findings with the number of the line each starts in."""
        lines = [normal_words(line) if line and not line.isspace() else None for line in text.split(b"\n")]
        proposals = self.proposals([words or [] for words in lines])
        count, hits, start = 0, [], 0
        for end, words in enumerate([*lines, None]):
            if words is None:
                hits += [(count + i, *hit) for i, hit in self._in_run(lines[start:end], proposals[start:end])]
                count, start = count + end - start, end + 1
        return count, hits

    def _in_run(self, lines: list[list[bytes]], proposals: list[tuple[int, float]]):
        """Findings of consecutive lines: of each line, or of the group of lines from it that confirms a family."""
        alone = [self.find(words, proposal) for words, proposal in zip(lines, proposals)]
        i = 0
        while i < len(lines):
            hit, end = alone[i], i + 1
            if hit is None or hit[0] == UNKNOWN:
                group, rest = lines[i][-self._longest:], []
                for j in range(i + 1, len(lines)):
                    # No group runs over a line without words or one that is identified alone.
                    if not lines[j] or not group or alone[j] and alone[j][0] != UNKNOWN:
                        break
                    group, rest = group + lines[j][:self._longest], rest + lines[j][:self._longest]
                    # Without a template's words across its first line break, no group starts here.
                    if j == i + 1 and self._known.isdisjoint(zip(group, group[1:])):
                        break
                    found = self.find(group) if max(self.overlaps(group).values(), default=0.0) >= self.confirm else None
                    if found and found[0] != UNKNOWN and found[2] > self.overlap(found[0], rest) and (end == i + 1 or found[2] > hit[2]):
                        hit, end = found, j + 1
                    elif end > i + 1 or len(group) > 3 * self._longest:
                        break
            if hit:
                yield i, hit
            i = end


def fit_license_model(background: DataFrame, text_col: str = "text", *, sample: int = 2000, paragraphs: int = 1200, seed: int = 7,
                      variants: int = 60, accept: float = 0.6, confirm: float = 0.6) -> LicenseModel:
    """Train from noisy variants of the templates against ordinary paragraphs.

    ``background`` gives about ``sample`` distinct texts (content hash below a threshold that follows
    the number of rows), of whose lines ``paragraphs`` at random are examples of the unknown class: the
    documented bounds of the fit. Besides, template words in random order teach that class that loose
    licence words are not a licence. The softmax temperature is calibrated on held-out variants.
    """
    rng = np.random.default_rng(seed)
    families = (*TEMPLATES, UNKNOWN)
    examples: list[tuple[list[bytes], int]] = []
    texts = background.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text"))
    # Only texts below the threshold leave their task, so the driver's load does not grow with the tasks.
    order = F.shiftrightunsigned(F.xxhash64("_text"), 11)
    below = int((1 << 53) * min(1.0, sample / max(1, texts.count())))
    rows = texts.where(order < F.lit(below)).distinct().orderBy(order, "_text").limit(sample).collect()
    plain = [w for r in rows for p in r["_text"].encode().split(b"\n") if (w := normal_words(p))]
    filler = [w for ws in plain for w in ws] or [b"word"]
    pool = [w for ts in TEMPLATES.values() for t in ts for w in normal_words(t.encode())]
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = normal_words(template.encode())
            for _ in range(variants):
                kept = [w for w in words if rng.random() > 0.08]
                before, after = ([filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))] for _ in range(2))
                examples.append((before + kept + after, k))
    last = len(families) - 1
    examples += [(plain[i], last) for i in rng.permutation(len(plain))[:paragraphs]]
    for _ in range(8 * variants):
        loose = [pool[i] for i in rng.integers(0, len(pool), rng.integers(3, 20))]
        examples.append((loose + [filler[i] for i in rng.integers(0, len(filler), 8)], last))

    order = rng.permutation(len(examples))
    data = [(_buckets([examples[i][0]])[0], examples[i][1]) for i in order if examples[i][0]]
    cut = len(data) * 4 // 5
    weights, bias = np.zeros((len(families), BUCKETS)), np.zeros(len(families))
    for epoch in range(6):
        rate = 0.5 / (1 + epoch)
        for at, label in data[:cut]:
            size = np.sqrt(max(1, len(at)))
            z = weights[:, at].sum(axis=1) / size + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[label] -= 1
            weights[:, at] -= rate * (g / size)[:, None]
            bias -= 0.1 * rate * g
    scores = np.array([weights[:, at].sum(axis=1) / np.sqrt(max(1, len(at))) + bias for at, _ in data[cut:]])
    labels = np.array([y for _, y in data[cut:]])

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    templates = {}
    for family, texts in TEMPLATES.items():
        split = [normal_words(t.encode()) for t in texts]
        templates[family] = [(frozenset(zip(w, w[1:])), len(w)) for w in split]
    return LicenseModel(families, np.ascontiguousarray(weights.T, np.float32), bias, temperature, accept, confirm, templates)


def scan_licenses(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Map-only: id, n_paragraphs, families (distinct confirmed, sorted) and findings of every row.

    The model scores every line and, where lines without a blank one between them hold words of a
    template, groups of them, so that wrapped texts are met whole. A confirmed family gives a finding
    with the number of its first line (of those with a word), probability and template overlap;
    "unknown" stands for a proposal that no template confirms and for lines that mention licensing.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()
    found = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            counts, families, findings = [], [], []
            for text in as_bytes(batch.column(1)):
                count, hits = model.findings(text or b"")
                counts.append(count)
                families.append(sorted({h[1] for h in hits} - {UNKNOWN}))
                findings.append([dict(zip(("paragraph", "family", "probability", "overlap"), h)) for h in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(families, pa.list_(pa.string())), pa.array(findings, pa.list_(found))],
                [id_col, "n_paragraphs", "families", "findings"])

    return map_rows(rows, run, f"`{id_col}` {id_type}, n_paragraphs int, families array<string>, "
                    "findings array<struct<paragraph: int, family: string, probability: double, overlap: double>>")
