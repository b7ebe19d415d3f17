"""Words and shingles of whole Arrow batches as 64-bit hashes, computed without a Python loop.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``, with A-Z lower-cased. Its hash is a
polynomial over a random value per byte, taken from running sums, and then mixed; two different
words or shingles of a corpus share a hash with a chance of about one in 2**64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 18  # bytes hashed at once; words never straddle chunks
SLICE = 1 << 20  # bytes of text handled at once by operators (a longer text is a slice of its own)
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240917))


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


BYTE = _odd(256)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLAIN = SPACE.copy()  # for texts compared without punctuation: all but letters and digits separate
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True
BASE = int(_odd(1)[0])
PLACE = _odd(SHINGLE)
LENGTHS = _odd(SHINGLE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all (splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up, down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        if size > 4 * CHUNK:  # for one extremely long word: not kept
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` bytes of text, so that temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > SLICE:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def _cut(buf: np.ndarray, offsets: np.ndarray, at: int, space: np.ndarray) -> int:
    """The first place from ``at`` where no word is cut."""
    if at >= len(buf):
        return len(buf)
    border = int(offsets[np.searchsorted(offsets, at)])
    while at < border:
        window = space[buf[at : at + 65536]]
        hit = int(window.argmax())
        if window[hit]:
            return min(at + hit, border)
        at += len(window)
    return border


def words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Hashes of all words in order; the words of text i are ``[first[i]:first[i + 1]]``; then the
    byte positions where each word starts and ends."""
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(buf):
        end = _cut(buf, offsets, at + CHUNK, space)
        part = buf[at:end]
        inside = ~space[part]
        lo, hi = np.searchsorted(offsets, [at, end])
        border = np.zeros(len(part) + 1, bool)
        border[offsets[lo:hi] - at] = True
        border[0] = border[-1] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | border[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | border[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts, ends = join(starts, np.int64), join(ends, np.int64)
    return join(hashes, np.uint64), np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE):
    """Hashes of ``size``-word shingles and where each text's start. A text of fewer words has its
    whole sequence as one shingle, a text without words none."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    text = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    length = np.minimum(n, size)[text]
    out = LENGTHS[length].copy()
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        out += np.where(length > k, padded[begin + k] * PLACE[k], U(0))
    return mix(out), at
