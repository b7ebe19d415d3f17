"""Periodic runs of words: maximal stretches that repeat a period at least four times.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least ``max(6, 4 q)`` words, that no neighbouring word extends keeping period q. Method, per text:

* ``zones``: within a run every 4-word gram but those of the first period stands q words earlier
  too. So texts are narrowed, exactly, to stretches of grams seen before at distances that a run of
  that stretch's length allows. Most texts have none and end here.
* ``Automaton``: over a zone, a suffix automaton whose suffix-link tree is kept as a link-cut tree.
  A preferred path holds the states whose strings occurred last at the same place. Appending word i
  accesses the new state: the path to the root breaks into segments by their previous last occurrence
  e, and is recoloured i. The longest string of a segment, of l words, ends at e and at i; where
  i - e <= l that is a square of period i - e, where 3 (i - e) <= l a fourth power. The nearest
  occurrence is the smallest period, so no other is tested. Accesses cost O(log n) amortised.
* Each such power is extended to both sides, once per run, and runs of under six words are left out.

``repeated_tail`` makes the planted damage: it replaces the end of a tenth of the texts by a period.

Defined cases: null and empty texts have no words, no runs and the hashes of the empty string; a
null ``doc_id`` takes no damage and is returned as null; repeated rows are analysed each; the longest
run is chosen by length, then smallest start, then period; texts of any length are taken whole, in
memory of one text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dugout.llm import text as T
from dugout.llm.store import prepare

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LEAST = 6  # words of a run
POWER = 4  # periods of a run
GRAM = 4  # words of a gram in `zones`; at most LEAST - 1, so that every run repeats one
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

SCHEMA = """doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,
    runs_sha256 string, collapsed_sha256 string, n_words bigint, n_kept bigint"""


class Automaton:
    """Suffix automaton of words with last occurrences on the preferred paths of its link tree.

    State 0 stands for no state, 1 is the root. ``left``, ``right`` and ``up`` are the splay trees of
    the preferred paths (a path's top tree points up to the state above it), ordered by depth;
    ``last`` holds a path's last occurrence at the root of its splay tree.
    """

    def __init__(self) -> None:
        self.length, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.last = [0, 0], [0, 0], [0, 0], [0, -1]
        self.end, self.size = 1, 0

    def _state(self, length: int, link: int, arrows: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arrows)
        for column in (self.left, self.right, self.up):
            column.append(0)
        self.last.append(-1)
        return len(self.length) - 1

    def _rotate(self, x: int, p: int, g: int, inner: bool) -> None:
        """Exchange ``x`` with its parent ``p`` under ``g``, whose child ``p`` is if ``inner``."""
        left, right, up = self.left, self.right, self.up
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if inner:
            if left[g] == p:
                left[g] = x
            else:
                right[g] = x

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its path's tree; the colour stays with the root."""
        left, right, up = self.left, self.right, self.up
        root, p = x, up[x]
        while left[p] == x or right[p] == x:
            g = up[p]
            if left[g] != p and right[g] != p:
                root = p
                self._rotate(x, p, g, False)
                break
            root, h = g, up[g]
            outer = left[h] == g or right[h] == g
            if (left[g] == p) == (left[p] == x):
                self._rotate(p, g, h, outer)
                self._rotate(x, p, h, outer)
            else:
                self._rotate(x, p, g, True)
                self._rotate(x, g, h, outer)
            p = h
        self.last[x] = self.last[root]

    def _clone(self, q: int, length: int) -> int:
        """A state between ``q`` and its link, on the same preferred path as ``q``."""
        c = self._state(length, self.link[q], dict(self.next[q]))
        self.link[q] = c
        self._splay(q)
        above = self.left[q]
        self.left[c] = above
        if above:
            self.up[above] = c
        self.left[q], self.up[c] = c, q
        return c

    def append(self, word: int) -> list[tuple[int, int]]:
        """(previous end, longest length) of each segment of the path, deepest first."""
        i = self.size
        self.size += 1
        new = self._state(i + 1, 0, {})
        p = self.end
        while p and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if not p:
            above = 1
        else:
            q = self.next[p][word]
            above = q
            if self.length[p] + 1 != self.length[q]:
                above = self._clone(q, self.length[p] + 1)
                while p and self.next[p].get(word) == q:
                    self.next[p][word] = above
                    p = self.link[p]
        self.link[new] = above
        self.end = new
        # access: segments of the path change hands, the rest of each old path keeps its colour
        found = []
        below, x = new, above
        right, up, last = self.right, self.up, self.last
        while x:
            self._splay(x)
            if last[x] >= 0 and self.length[x]:
                found.append((last[x], self.length[x]))
            if right[x]:
                last[right[x]] = last[x]
            right[x], up[below] = below, x
            below, x = x, up[x]
        last[below] = i
        return found


def zones(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words outside which no run lies; a run lies in one of them."""
    n = len(ids)
    if n < LEAST:
        return []
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k, factor in enumerate(_MIX):
        grams = (grams + ids[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(k + 1)) * np.uint64(factor)
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    back = np.full(len(grams), n, np.int64)  # distance to the same gram before
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    open_ = back < n
    while True:  # a run of period q leaves at least 3 q - 3 consecutive grams with distances up to q
        border = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
        first, end = border[::2], border[1::2]
        size = end - first
        bound = np.where(size >= LEAST - GRAM, (size + GRAM - 1) // (POWER - 1), 0)
        kept = open_.copy()
        kept[open_] = back[open_] <= np.repeat(bound, size)
        if (kept == open_).all():
            break
        open_ = kept
    return [(max(0, int(f - b)), min(n, int(e) + GRAM - 1)) for f, e, b in zip(first, end, bound)]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in this order."""
    out = set()
    n = len(ids)
    words = None
    for begin, end in zones(ids):
        words = words or ids.tolist()
        automaton = Automaton()
        reach: dict[int, int] = {}  # by period, where its last run ends
        for i in range(begin, end):
            for e, length in automaton.append(words[i]):
                q = i - begin - e
                if (POWER - 1) * q > length or i < reach.get(q, 0):
                    continue
                s, t = i, i + 1
                while s >= q and words[s - q] == words[s]:
                    s -= 1
                s = s - q + 1
                while t < n and words[t - q] == words[t]:
                    t += 1
                reach[q] = t
                if t - s >= LEAST:
                    out.add((s, t - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list, doc_id: int | None) -> list:
    """A tenth of the documents, by their id, repeat a period from some word on."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def analysed(doc_id: int | None, text: bytes, damage: bool) -> tuple:
    """The row of one text."""
    words = WORD.findall(text)
    if damage:
        words = repeated_tail(words, doc_id)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
    runs = runs_of(ids)
    listed, kept = b"", words
    best = (None, None, None)
    if runs:
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
        edge = np.zeros(len(words) + 1, np.int64)
        for s, m, q in runs:
            edge[s + q] += 1
            edge[s + m] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept))


def analysis(docs: DataFrame, damage: bool = False) -> DataFrame:
    """Runs and collapsed text of every document; with ``damage``, of its planted variant."""
    spark = prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(",")]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        for batch in T.slices(batches):
            data, at = T.buffers(batch.column("text"))
            rows = [
                analysed(d, data[at[k] : at[k + 1]].tobytes(), damage)
                for k, d in enumerate(batch.column("doc_id").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
