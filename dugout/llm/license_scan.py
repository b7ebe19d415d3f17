"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are compared as words of letters and digits, case and punctuation aside, in
shingles of five words. For every size class of templates (a power of two of shingles) a text is cut
into windows of that many shingles plus a quarter, a quarter of a window apart. A window's 32
minima, two to a band, are looked up among the bands of the class's templates. A window that holds
all of a template resembles it by at least 0.4, so it shares one of 16 bands with probability above
0.93; the three or more windows that overlap a notice make a miss rarer still. Templates of fewer
than eight shingles have a class per size with windows of exactly that many shingles at every place,
where a whole notice collides for certain. What is retrieved is verified exactly: the share of the
template's shingles that the window has must be 0.75 or more.

Templates share sentences: versions of a license differ by a few words, and a header begins with a
shorter notice. So of verified matches that overlap in the text only that with most shingles found
stays, then that with the larger share: the shingles which only one template has decide. Templates that
are equal in both (an edit took the words that tell them apart) are all reported.

Templates are a bounded table of fixed texts, shipped to every task; nothing is shuffled.

Defined cases: null and empty texts and texts without words have no matches; a template without
words is left out, one of fewer than five words has its whole sequence as one shingle and matches
texts that consist of it; repeated rows are scanned each; a null ``doc_id`` stays null; texts of any
length are scanned whole, with every window of every class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import prepare

BANDS, BAND = 16, 2
SHARE = 0.75
EXACT_BELOW = 8  # shingles: classes with a window at every place

# public license notices, fixed values: (name, text)
TEMPLATES = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
     except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
     distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
     either express or implied. See the License for the specific language governing permissions and limitations under
     the License."""),
    ("MIT notice", "Released under the MIT License."),
    ("MIT permission", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
     and associated documentation files (the "Software"), to deal in the Software without restriction, including
     without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
     the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
     conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
     portions of the Software."""),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0 header", """This program is free software: you can redistribute it and/or modify it under the terms of
     the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
     (at your option) any later version."""),
    ("GPL-2.0 header", """This program is free software; you can redistribute it and/or modify it under the terms of
     the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
     (at your option) any later version."""),
    ("LGPL-2.0 header", """This library is free software; you can redistribute it and/or modify it under the terms of
     the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the
     License, or (at your option) any later version."""),
    ("LGPL-2.1 header", """This library is free software; you can redistribute it and/or modify it under the terms of
     the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
     License, or (at your option) any later version."""),
    ("LGPL-3.0 header", """This library is free software: you can redistribute it and/or modify it under the terms of
     the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the
     License, or (at your option) any later version."""),
    ("AGPL-3.0 header", """This program is free software: you can redistribute it and/or modify it under the terms of
     the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
     License, or (at your option) any later version."""),
    ("MPL-2.0 header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
     copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
     SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
     provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
     notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
     above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
     materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
     provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
     notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
     above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
     materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
     contributors may be used to endorse or promote products derived from this software without specific prior written
     permission."""),
    ("BSD opening", """Redistribution and use in source and binary forms, with or without modification, are permitted
     provided that the following conditions are met: Redistributions of source code must retain the above copyright
     notice, this list of conditions and the following disclaimer."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
     be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
     software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
     to the following restrictions"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
     software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
     distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
     third-parties to whom the Software is furnished to do so"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
     modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
     binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC0-1.0 statement", """To the extent possible under law, the author(s) have dedicated all copyright and related
     and neighboring rights to this software to the public domain worldwide. This software is distributed without any
     warranty."""),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 statement", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)

_rng = np.random.Generator(np.random.PCG64(16))
_U = np.uint64
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)

MATCHES = "array<struct<template: string, start: bigint, end: bigint, share: double>>"


def shingled(texts: pa.Array):
    """Shingles of each text, where each text's begin, and the bytes that each shingle spans."""
    buf, off = T.buffers(texts)
    hashes, first, starts, ends = T.words(buf, off, T.PLAIN)
    found, at = T.shingles(hashes, first)
    count, words = np.diff(at), np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    begin = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    last = begin + np.minimum(words, T.SHINGLE)[text] - 1
    base = off[:-1][text]
    return found, at, starts[begin] - base, ends[last] - base


def size_class(n: int) -> int:
    """Shingles of the windows by which templates of n shingles are looked for."""
    return n if n < EXACT_BELOW else 1 << (n - 1).bit_length()


def _band(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * _MULTIPLY[0] + second


class Templates:
    """Shingle sets of the templates, and by size class and band the keys they have."""

    def __init__(self, templates):
        found, at, _, _ = shingled(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]
        self.classes: dict[int, list[list[tuple[np.uint64, int]]]] = {}
        for i, own in enumerate(self.sets):
            if len(own):
                bands = self.classes.setdefault(size_class(len(own)), [[] for _ in range(BANDS)])
                for b in range(BANDS):
                    one, two = ((own * _MULTIPLY[k] + _ADD[k]).min(keepdims=True) for k in (BAND * b, BAND * b + 1))
                    bands[b].append((_band(one, two)[0], i))

    def retrieved(self, found: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, shingles) of windows that share a band with a template."""
        out: set[tuple[int, int, int]] = set()
        n = np.diff(at)
        plans = {}
        for size in self.classes:
            step = 1 if size < EXACT_BELOW else size // 4
            blocks = -(-n // step)
            number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            # blocks in a window: its size, and a quarter more where windows are not at every place
            plans[size] = step, np.repeat(at[:-1], blocks) + number * step, size // step + (step > 1)

        def minima(h: np.ndarray, size: int) -> np.ndarray:
            step, starts, per = plans[size]
            least = h if step == 1 else np.minimum.reduceat(h, starts)
            joined = least.copy()
            for k in range(1, per):
                np.minimum(joined[:-k], least[k:], out=joined[:-k])
            return joined

        for b in range(BANDS):
            one, two = (found * _MULTIPLY[k] + _ADD[k] for k in (BAND * b, BAND * b + 1))
            for size, bands in self.classes.items():
                step, starts, per = plans[size]
                keys = _band(minima(one, size), minima(two, size))
                for key, i in bands[b]:
                    out.update((i, int(starts[w]), per * step) for w in np.flatnonzero(keys == key))
        return out

    def verified(self, texts: pa.Array) -> list[list[tuple[str, int, int, int, float]]]:
        """Per text: (template, byte span, shingles found, share) of every window that was retrieved
        and holds enough of the template."""
        found, at, begins, ends = shingled(texts)
        out: list[list[tuple[str, int, int, int, float]]] = [[] for _ in range(len(at) - 1)]
        if not len(found):
            return out
        for i, a, n in sorted(self.retrieved(found, at)):
            text = int(np.searchsorted(at, a, "right")) - 1
            window = found[a : min(a + n, at[text + 1])]
            inside = np.flatnonzero(np.isin(window, self.sets[i]))
            number = len(np.unique(window[inside]))
            share = number / len(self.sets[i])
            if share >= SHARE:
                out[text].append((self.names[i], int(begins[a + inside[0]]), int(ends[a + inside[-1]]), number, share))
        return out

    def matches(self, texts: pa.Array) -> list[list[tuple[str, int, int, float]]]:
        """Per text: (template, byte span, share) of the verified matches; of those that overlap,
        the best, and its equals of other templates."""
        return [self._best(m) for m in self.verified(texts)]

    @staticmethod
    def _best(found):
        kept: list[tuple[str, int, int, int, float]] = []
        for m in sorted(found, key=lambda m: (-m[3], -m[4], m[2] - m[1], m[1], m[0])):
            over = [k for k in kept if m[1] < k[2] and k[1] < m[2]]
            if all(k[0] != m[0] and k[3:] == m[3:] for k in over):
                kept.append(m)
        return sorted(((n, a, b, v) for n, a, b, _, v in kept), key=lambda m: (m[1], m[0]))


def scanned(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, matches) for every row: template, span in code points (end exclusive), share of the
    template's shingles found."""
    prepare(docs.sparkSession)
    templates = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Templates(templates)
        kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("share", pa.float64())]))
        for batch in T.slices(batches):
            found = table.matches(batch.column("text"))
            rows = []
            for i, own in enumerate(found):
                body = batch.column("text")[i].as_py().encode() if own else b""
                points = lambda at: len(body[:at].decode())  # noqa: B023, E731
                rows.append([{"template": n, "start": points(s), "end": points(e), "share": v} for n, s, e, v in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, matches {MATCHES}")
