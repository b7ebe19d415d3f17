"""Secrets in texts: fixed patterns, and a randomness test battery for other tokens.

Patterns (assign, access, hex) are matched over the whole text. Further tokens (runs of 20 or more
characters of the usual alphabets, outside the pattern spans) are tested:

* the smallest alphabet that holds all characters is the token's inferred encoding;
* over it, a chi-squared test of uniformity, a runs test above and below the middle of the alphabet
  and a lag-1 serial-correlation test are combined by Fisher's method; a token that fails is no
  random string;
* how surprising the chi-squared value would be for ordinary writing of the same length follows from
  the corpus's own character counts, gathered over all texts: a short token cannot be surprising, a
  long one can. These p-values go through the Benjamini-Hochberg procedure within each length
  class, on counts per p-value bin, so the share of ordinary words among added spans is controlled.

Defined cases: null texts are empty; offsets count code points, ends exclusive; repeated rows are
scanned each; a null ``doc_id`` stays null; an empty table gives no rows; further columns are left
alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import kept, prepare

# the patterns of the base scan, fixed values
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SHORTEST = 20
RATE = 0.01  # false discoveries among the added spans
RANDOM_P = 0.001  # a token of the battery below this is no random string
BINS = 300  # of p-values: tenths of a decimal logarithm

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("letters", LOWER),
    ("LETTERS", UPPER), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER),
    ("Letters", UPPER + LOWER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"), ("any", UPPER + LOWER + DIGITS + "+/-_"),
)
_PLACE = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS}
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[ord(c) for c in ENCODINGS[-1][1]]] = True

SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"
TESTED = "array<struct<start: bigint, end: bigint, encoding: string, length: bigint, chi2: double, p_random: double>>"


def base_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind. ``runs`` says whether the text may have runs
    of 20 or more token characters, without which two of the patterns cannot match."""
    found = []
    small = text.lower()
    if any(w in small for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if runs:
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, int, float, float]:
    """(encoding, length, chi-squared, combined p-value that the token is a random string)."""
    body = token.rstrip("=")
    name, chars = next((n, c) for n, c in ENCODINGS if set(body) <= set(c))
    x = np.array([_PLACE[name][c] for c in body], float)
    n, m = len(x), len(chars)
    chi2 = float(((np.bincount(x.astype(int), minlength=m) - n / m) ** 2).sum() * m / n)
    p = [_tail((chi2 - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n))]
    high = x >= m / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * up * down / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    if x.std() > 0:
        p.append(2 * _tail(abs(float(np.corrcoef(x[1:], x[:-1])[0, 1]) if x[1:].std() and x[:-1].std() else 1.0)
                           * math.sqrt(n)))
    fisher = -sum(math.log(max(v, 1e-300)) for v in p)  # half of Fisher's statistic
    term, total = 1.0, 0.0
    for k in range(len(p)):  # chi-squared tail with an even number of degrees of freedom
        total += term
        term *= fisher / (k + 1)
    return name, n, chi2, min(1.0, math.exp(-fisher) * total)


def scan(text: str, runs: bool = True):
    """Pattern spans, and what the battery says of the other tokens."""
    base = base_spans(text, runs)
    tested = []
    for m in TOKEN.finditer(text) if runs else ():
        if not any(s < m.end() and m.start() < e for _, s, e in base):
            tested.append((*m.span(), *battery(m.group())))
    return base, tested


def _with_runs(texts: pa.Array) -> np.ndarray:
    """Which texts have a run of SHORTEST token characters."""
    buf, off = T.buffers(texts)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _IN_TOKEN[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = starts[ends - starts >= SHORTEST]  # a run may span two texts: then both are looked at in vain
    out = np.zeros(len(off) - 1, bool)
    if len(at):
        last = ends[ends - starts >= SHORTEST] - 1
        for a, b in zip(np.searchsorted(off, at, "right") - 1, np.searchsorted(off, last, "right") - 1):
            out[a : b + 1] = True
    return out


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, tested, counts): ``counts`` holds, on one row of each slice of texts, how often
    the slice has each ASCII character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        test = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()),
                                   ("length", pa.int64()), ("chi2", pa.float64()), ("p_random", pa.float64())]))
        for batch in T.slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            found = [scan(t, r) for t, r in zip(texts.to_pylist(), _with_runs(texts).tolist())]
            counts = np.bincount(T.buffers(texts)[0], minlength=256)[:128]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in found], span),
                 pa.array([[dict(zip(("start", "end", "encoding", "length", "chi2", "p_random"), s)) for s in t]
                           for _, t in found], test),
                 pa.array([counts] + [None] * (len(found) - 1), pa.list_(pa.int64()))],
                ["doc_id", "base", "tested", "counts"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base {SPAN}, tested {TESTED}, counts array<bigint>")


class Null:
    """What chi-squared is for ordinary writing, by encoding, from the corpus's character counts."""

    def __init__(self, counts: dict[int, int]):
        self.excess, self.size = {}, {}
        for name, chars in ENCODINGS:
            n = np.array([counts.get(ord(c), 0) + 0.5 for c in chars])
            self.size[name] = len(chars)
            self.excess[name] = float(len(chars) * ((n / n.sum() - 1 / len(chars)) ** 2).sum())

    def p(self, encoding: str, length: int, chi2: float) -> float:
        m, excess = self.size[encoding], self.excess[encoding]
        mean = m - 1 + (length - 1) * excess
        return max(1e-300, _tail((mean - chi2) / math.sqrt(2 * (m - 1) + 4 * length * excess)))

    def logarithms(self):
        """Per encoding: (size, excess), for the same in SQL functions."""
        return {k: (self.size[k], self.excess[k]) for k in self.size}


def _stratum(length: int) -> int:
    return int(length).bit_length()


def thresholds(scans: DataFrame, rate: float = RATE) -> tuple[Null, dict[int, float]]:
    """The null model, and per length class the largest p-value that is a discovery.

    The driver sees 128 counts, and counts per length class and bin.
    """
    rows = scans.select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    null = Null({r.pos: r.n for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("encoding", "length", "chi2", "p_random")))
            got = [(_stratum(n), min(BINS, int(-10 * math.log10(null.p(e, n, c)))) if p >= RANDOM_P else -1)
                   for e, n, c, p in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], ["stratum", "bin"])

    tested = scans.select(F.explode("tested").alias("t")).select("t.*")
    counts: dict[int, dict[int, int]] = {}
    for r in tested.mapInArrow(run, "stratum int, bin int").groupBy("stratum", "bin").count().collect():
        counts.setdefault(r.stratum, {})[r.bin] = r["count"]
    out = {}
    for stratum, bins in counts.items():
        total, below = sum(bins.values()), 0
        for b in range(BINS, -1, -1):  # from the smallest p-values up
            below += bins.get(b, 0)
            if below and total * 10 ** (-b / 10) / below <= rate:
                out[stratum] = 10 ** (-b / 10)
    return null, out


def added(tested, null: Null, limits: dict[int, float]) -> list[tuple[str, int, int]]:
    """Spans of the tested tokens (start, end, encoding, length, chi2, p_random) that are discoveries."""
    return [("random", s, e) for s, e, name, n, chi2, p in tested
            if p >= RANDOM_P and null.p(name, n, chi2) <= limits.get(_stratum(n), -1.0)]


def found(docs: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): pattern spans, and all spans, each by start, then kind."""
    prepare(docs.sparkSession)
    scans = kept(scanned(docs, doc_id, text), "secret-scans")
    null, limits = thresholds(scans, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [[dict(zip(("kind", "start", "end"), s)) for s in added([tuple(t.values()) for t in tested], null, limits)]
                    for tested in batch.column("tested").to_pylist()]
            base = batch.column("base")
            spans = [sorted(b + m, key=lambda s: (s["start"], KINDS.index(s["kind"])))
                     for b, m in zip(base.to_pylist(), more)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, pa.array(spans, base.type)],
                                             ["doc_id", "base", "spans"])

    kind = scans.schema["doc_id"].dataType.simpleString()
    return scans.select("doc_id", "base", "tested").mapInArrow(run, f"doc_id {kind}, base {SPAN}, spans {SPAN}")


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text",
             n_chars: str | None = "n_chars", mask: str = "<redacted>") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mask`` and ``n_chars`` (where such a column
    exists) set anew for the rows that change. Texts are scanned again rather than joined, so none is
    shuffled."""
    prepare(docs.sparkSession)
    null, limits = thresholds(kept(scanned(docs, doc_id, text), "secret-scans"), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text):
            column = batch.column(text)
            texts = column.to_pylist()
            runs = _with_runs(column).tolist()
            changed = {}
            for i, t in enumerate(texts):
                if t:
                    base, tested = scan(t, runs[i])
                    if spans := base + added(tested, null, limits):
                        changed[i] = texts[i] = masked(t, spans, mask)
            if changed:
                names = batch.schema.names
                batch = batch.set_column(names.index(text), text, pa.array(texts, column.type))
                if n_chars in names:
                    sizes = batch.column(n_chars).to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    batch = batch.set_column(names.index(n_chars), n_chars, pa.array(sizes, batch.column(n_chars).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
