"""Licence scan by Dice coefficient over word bigrams.

Text is normalised to lower-cased words without ASCII punctuation.  Lines, paragraphs and the whole text are
the passages, and windows of each template's size wherever they stand: a window begins at one of the
template's bigrams, and its hits, counted from their sorted places, bound its coefficient.  For a passage of n bigrams and a template of m, Dice can reach t only if
t / (2 - t) <= n / m <= (2 - t) / t, and the passage has at least t / 2 * (n + m) bigrams that some template
has; what these bounds leave is compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.shared import ship

# Wordings of public licences and of their usual notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class LicenceScan:
    """Templates (name, wording) and the Dice coefficient that counts as a match."""

    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)
    threshold: float = 0.85


_PLAIN = np.arange(256, dtype=np.uint8)
for _b in range(0x80):
    if not chr(_b).isalnum() and _b not in range(0x09, 0x0E):
        _PLAIN[_b] = 0x20
_PLAIN = K.LOWER[_PLAIN]


class _Bigrams:
    """Normalised words of texts as fingerprints of word pairs; pair i is of words i and i + 1."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        hashes, self.starts, self.stops, self.first = K.words(_PLAIN[data], ends)
        self.pairs = K.mix(hashes[:-1] * K._SLOT[1] + hashes[1:] * K._SLOT[2]) if len(hashes) else hashes
        # pairs across the end of a text belong to none
        self.pairs[self.first[(self.first > 0) & (self.first < len(hashes))] - 1] = 0


def dice(a: Counter, b: Counter) -> float:
    """2 |a & b| / (|a| + |b|) of two bags."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, rule: LicenceScan):
        self.rule, t = rule, rule.threshold
        self.low, self.high = t / (2 - t), (2 - t) / t
        found = []
        for name, wording in rule.templates:
            raw = np.frombuffer(wording.encode(), np.uint8)
            found.append((name, Counter(_Bigrams(raw, np.array([0, len(raw)])).pairs.tolist())))
        found.sort(key=lambda x: (x[1].total(), x[0]))
        self.bags = found
        self.sizes = np.array([b.total() for _, b in found])
        self.known = np.unique(np.array([p for _, b in found for p in b], np.uint64))
        self.parts = [np.array(sorted(b), np.uint64) for _, b in found]

    def passages(self, data: np.ndarray, ends: np.ndarray, b: _Bigrams) -> tuple[np.ndarray, np.ndarray]:
        """(from word, to word) of all lines, paragraphs and whole texts, without repeats."""
        at = np.flatnonzero(data == 0x0A)
        # a line of white space alone parts paragraphs
        ink = np.concatenate([[0], np.cumsum(~K.SEPARATOR[data])])
        blank = at[:-1][ink[at[1:]] == ink[at[:-1]]] if len(at) > 1 else at[:0]
        out = []
        for cuts in (at, blank, at[:0]):
            edges = np.unique(np.concatenate([ends, cuts]))
            words = np.searchsorted(b.starts, edges)
            out.append(np.stack([words[:-1], words[1:]], axis=1))
        both = np.unique(np.concatenate(out), axis=0)
        return both[:, 0], both[:, 1]

    def scan(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, dice, from byte, to byte) of each passage that matches, with its best template."""
        b = _Bigrams(data, ends)
        if not len(b.pairs):
            return []
        start, stop = self.passages(data, ends, b)
        n = np.maximum(stop - start - 1, 0)
        upto = np.concatenate([[0], np.cumsum(np.isin(b.pairs, self.known))])
        hits = np.where(n > 0, upto[np.maximum(stop - 1, start)] - upto[start], 0)
        least = np.searchsorted(self.sizes, n * self.low - 1e-9)
        smallest = self.sizes[np.minimum(least, len(self.sizes) - 1)]
        maybe = (n > 0) & (least < len(self.sizes)) & (hits + 1e-9 >= self.rule.threshold / 2 * (n + smallest))
        out: list[tuple[int, str, float, int, int]] = []
        for i in np.flatnonzero(maybe):
            bag = Counter(b.pairs[start[i] : stop[i] - 1].tolist())
            fit = [(dice(bag, self.bags[k][1]), self.bags[k][0]) for k in range(least[i], int(np.searchsorted(self.sizes, n[i] * self.high + 1e-9, "right")))]
            if fit and (best := min(fit, key=lambda f: (-f[0], f[1])))[0] >= self.rule.threshold:
                text = int(np.searchsorted(ends, b.starts[start[i]], "right")) - 1
                out.append((text, best[1], best[0], int(b.starts[start[i]] - ends[text]), int(b.stops[stop[i] - 1] - ends[text])))
        return out

    def matches(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """scan(), and windows where no passage matches."""
        out = self.scan(data, ends)
        taken: dict[int, list[tuple[int, int]]] = {}
        for text, _, _, x, y in out:
            taken.setdefault(text, []).append((x, y))
        for match in sorted(self.windows(_Bigrams(data, ends), ends), key=lambda m: (-m[2], m[1], m[0], m[3])):
            spans = taken.setdefault(match[0], [])
            if all(match[4] <= x or y <= match[3] for x, y in spans):
                spans.append(match[3:])
                out.append(match)
        return sorted(out)

    def windows(self, b: _Bigrams, ends: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """The same of windows of templates' sizes, of those that overlap for a template the best."""
        hit = np.flatnonzero(np.isin(b.pairs, self.known))
        if not len(hit):
            return []
        pairs, text = b.pairs[hit], np.searchsorted(ends, b.starts[hit], "right") - 1
        out = []
        for (name, bag), part, size in zip(self.bags, self.parts, self.sizes.tolist(), strict=True):
            own = np.isin(pairs, part)
            at, of = hit[own], text[own]
            if not len(at):
                continue
            stop = np.minimum(at + size, b.first[of + 1] - 1)
            many = np.searchsorted(at, stop) - np.arange(len(at))
            best: tuple | None = None
            for i in np.flatnonzero(2 * many + 1e-9 >= self.rule.threshold * (size + (stop - at))):
                last = int(at[np.searchsorted(at, stop[i]) - 1])
                score = dice(Counter(b.pairs[at[i] : last + 1].tolist()), bag)
                if score < self.rule.threshold:
                    continue
                t = int(of[i])
                found = (t, name, score, int(b.starts[at[i]] - ends[t]), int(b.stops[last + 1] - ends[t]))
                if best and (best[0] != t or best[4] <= found[3]):
                    out.append(best)
                    best = None
                best = found if best is None or found[2] > best[2] else best
            out += [best] if best else []
        return out


def _run(rule: LicenceScan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rule)
        for batch in K.slices(batches):
            found: dict[int, list[tuple]] = {}
            for text, *match in scanner.matches(*K.utf8(batch.column("text"))):
                found.setdefault(text, []).append(tuple(match))
            best = [min(found[i], key=lambda m: (-m[1], m[0], m[2])) if i in found else (None, None) for i in range(batch.num_rows)]
            spans = [[{"licence": m[0], "dice": m[1], "start_byte": m[2], "end_byte": m[3]} for m in found.get(i, [])] for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)],
                names=["doc_id", "licence", "dice", "n_matches", "matches"],
            )

    return run


def licences(docs: DataFrame, rule: LicenceScan = LicenceScan()) -> DataFrame:
    """(doc_id, licence, dice, n_matches, matches) of each row: the best match and all of them with their bytes.

    Null and empty texts and those without a match have null licence and dice and 0 matches; of equal
    coefficients the first name wins; rows keep their doc_id, null or repeated; other columns aren't read."""
    ship(docs.sparkSession)
    ddl = "doc_id long, licence string, dice double, n_matches long, matches array<struct<licence: string, dice: double, start_byte: long, end_byte: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(rule), ddl)
