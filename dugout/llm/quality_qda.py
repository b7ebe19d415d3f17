"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (shares by arcsine root, counts by logarithm).
Per class, count, sum and sum of outer products over all labelled training rows are gathered with
one aggregation; the driver sees these few numbers only. A class covariance is shrunk towards the
diagonal of the pooled one, its Cholesky factor is computed once and shipped to the tasks, and a
row's score is the logistic function of the difference of the two log densities plus log prior.

Defined cases: null and empty texts have the statistics of the empty text and a score like any
other; labels other than 0 and 1, null labels and labels of unknown documents are left out; a
document labelled twice counts twice; without training rows of both classes every score is the
share of label 1 (0.5 without any); a null ``doc_id`` is scored and never learned from; repeated
rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import kept, prepare

SHRINK = 0.1  # weight of the pooled diagonal in a class covariance
RIDGE = 1e-4  # added to the standardised variances
THRESHOLD = 0.7

FEATURES = """bytes words word_length upper digit sentence symbol exclaim bar space newline foreign entropy
    distinct_words distinct_trigrams distinct_lines short_words symbol_ends""".split()
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "sentence": b".,;:?'\"-()",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "exclaim": b"!", "bar": b"|", "space": b" \t\x0b\x0c\r",
    "newline": b"\n", "foreign": range(128, 256),
}
_TABLE = np.array([[b in set(v) for v in _CLASSES.values()] for b in range(256)], float)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*!|~^@=+<>")] = True


def _share(part, whole):
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    buf, off = T.buffers(texts)
    n = len(off) - 1
    counts = np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(off[:-1], off[1:])]) if n else np.zeros((0, 256))
    size = np.diff(off).astype(float)
    of = dict(zip(_CLASSES, (counts @ _TABLE).T))
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    hashes, first, starts, ends = T.words(buf, off)
    words = np.diff(first).astype(float)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    tri, at = T.shingles(hashes, first, 3)
    several = lambda v, i: len(np.unique(v[i[0] : i[1]]))
    distinct = np.array([several(hashes, (a, b)) for a, b in zip(first[:-1], first[1:])], float)
    trigrams = np.array([several(tri, (a, b)) for a, b in zip(at[:-1], at[1:])], float)
    lines, own = np.ones(n), np.ones(n)
    for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
        if of["newline"][i]:
            each = buf[a:b].tobytes().split(b"\n")
            lines[i], own[i] = len(each), len(set(each))
    per_text = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[first])
    short = per_text(ends - starts <= 3)
    marked = per_text(_SYMBOL[buf[ends - 1]]) if len(ends) else np.zeros(n)
    letters = of["upper"] + of["lower"]
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p((length[first[1:]] - length[first[:-1]]) / np.maximum(words, 1)),
        _share(of["upper"], letters), _share(of["digit"], size), _share(of["sentence"], size),
        _share(of["symbol"], size), _share(of["exclaim"], size), _share(of["bar"], size), _share(of["space"], size),
        _share(of["newline"], size), _share(of["foreign"], size), entropy, _share(distinct, words),
        _share(trigrams, np.diff(at)), _share(own, lines), _share(short, words), _share(marked, words),
    ], axis=1)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            x = statistics(batch.column("text"))
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "x"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


class Model:
    """Means and Cholesky factors of the two classes in standardised coordinates."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK):
        self.n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        total = self.n[0] + self.n[1]
        self.prior = self.n[1] / total if total else 0.5
        self.whole = min(self.n.values()) > 0
        if not self.whole:
            return
        centre = {c: s / n for c, (n, s, _) in moments.items()}
        within = {c: q / n - np.outer(centre[c], centre[c]) for c, (n, _, q) in moments.items()}
        pooled = sum(self.n[c] * within[c] for c in (0, 1)) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.scale, self.mean, self.factor, self.logdet = scale, {}, {}, {}
        for c in (0, 1):
            spread = within[c] / np.outer(scale, scale)
            spread = (1 - shrink) * spread + (shrink + RIDGE) * np.eye(len(scale))
            lower = np.linalg.cholesky(spread)
            self.mean[c], self.factor[c] = centre[c] / scale, np.linalg.inv(lower)
            self.logdet[c] = 2 * np.log(np.diag(lower)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.full(len(x), self.prior)
        log = {}
        for c in (0, 1):
            z = (x / self.scale - self.mean[c]) @ self.factor[c].T
            log[c] = -0.5 * ((z * z).sum(1) + self.logdet[c])
        odds = log[1] - log[0] + np.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(rows: DataFrame, shrink: float = SHRINK) -> Model:
    """From (x, label): every row counts. Sums per batch are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        width = 1 + d + d * d
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], width), pa.int32()), pa.array(np.tile(np.arange(width), 2), pa.int32()),
             pa.array(np.concatenate([sums[0], sums[1]]))], ["label", "k", "v"])

    parts = rows.mapInArrow(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    d, moments = len(FEATURES), {}
    got = {(r.label, r.k): r.v for r in parts.collect()}  # twice 1 + d + d * d numbers
    for c in (0, 1):
        v = np.array([got.get((c, k), 0.0) for k in range(1 + d + d * d)])
        if v[0]:
            moments[c] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return Model(moments, shrink)


def accepted(docs: DataFrame, labels: DataFrame, train: Column, shrink: float = SHRINK,
             threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``threshold``; no text is shuffled."""
    model = fit(_labelled(kept(features(docs, doc_id, text), "quality-features"), labels, train), shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text):
            yield batch.filter(pa.array(model.score(statistics(batch.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _labelled(x: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    return x.filter(train).join(known, "doc_id").select("x", "label")


def scored(docs: DataFrame, labels: DataFrame, train: Column, shrink: float = SHRINK,
           threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row. ``train`` says, over ``doc_id``, which rows may be
    learned from."""
    x = kept(features(docs, doc_id, text), "quality-features")
    model = fit(_labelled(x, labels, train), shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return x.mapInArrow(run, "doc_id bigint, score double, predicted int")
