"""Exact order statistics of many numeric columns at once, without sorting a row.

Every pass counts the values of all columns in one scan, in buckets of the intervals that still hold
a wanted rank: a nested histogram. The bucket with the rank becomes the next interval, bounded by its
smallest and largest value, until these are one value. Doubles are compared as integers that keep
their order, so a pass narrows an interval by ``BUCKETS`` whatever the spread; a handful of scans do.
What is shuffled and what comes to the driver is bounded by columns x ranks x buckets, never by rows.

NULL and NaN do not count. A column without values has no statistics (None).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024  # of an interval in one pass, shared by the intervals of a column
_SIGN = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _double(code: int) -> float:
    bits = np.uint64(code)
    return float(np.array([bits ^ _SIGN if bits & _SIGN else ~bits], np.uint64).view(np.float64)[0])


@dataclass
class _Interval:
    """Codes ``low``..``high`` of a column with ``before`` smaller values outside."""

    column: int
    low: int
    high: int
    before: int

    def width(self, buckets: int) -> int:
        return (self.high - self.low) // buckets + 1


def _scan(df: DataFrame, columns: list[str], intervals: list[_Interval], buckets: int) -> list:
    """(interval, bucket, count, least code, largest code), codes moved by 2**63 to fit a bigint."""
    by_column = []
    for c in range(len(columns)):  # a column's intervals are disjoint and in order
        mine = [(k, i) for k, i in enumerate(intervals) if i.column == c]
        number = np.array([k for k, _ in mine], np.int64)
        by_column.append((number, *(np.array(x, np.uint64) for x in ([i.low for _, i in mine], [i.high for _, i in mine], [i.width(buckets) for _, i in mine]))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros((len(intervals), buckets), np.int64)
        least = np.full((len(intervals), buckets), np.iinfo(np.uint64).max, np.uint64)
        most = np.zeros((len(intervals), buckets), np.uint64)
        for batch in batches:
            for c, (k, low, high, width) in enumerate(by_column):
                if not len(k):
                    continue
                values = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                codes = np.sort(_ordered(values[~np.isnan(values)]))
                i = np.searchsorted(low, codes, side="right") - 1
                inside = (i >= 0) & (codes <= high[i])
                codes, i = codes[inside], i[inside]
                if not len(codes):
                    continue
                cell = k[i] * buckets + ((codes - low[i]) // width[i]).astype(np.int64)
                first = np.flatnonzero(np.diff(cell, prepend=-1))  # in order of size, so a bucket's values are together
                last = np.append(first[1:], len(cell)) - 1
                cell = cell[first]
                number.reshape(-1)[cell] += last - first + 1
                least.reshape(-1)[cell] = np.minimum(least.reshape(-1)[cell], codes[first])
                most.reshape(-1)[cell] = np.maximum(most.reshape(-1)[cell], codes[last])
        k, at = np.nonzero(number)
        shift = lambda codes: (codes ^ _SIGN).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (k, at, number[k, at], shift(least[k, at]), shift(most[k, at]))],
            names=["k", "at", "n", "least", "most"])

    told = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(
        count, "k bigint, at bigint, n bigint, least bigint, most bigint")
    return told.groupBy("k", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()


def ranked(df: DataFrame, columns: list[str], ranks) -> dict[str, list[float | None]]:
    """Per column the values at ``ranks(n)``, ranks from 1 in order of size, n being its values."""
    if not columns:
        return {}
    wanted: list[list[int]] | None = None
    found: list[dict[int, float]] = [{} for _ in columns]
    intervals = [_Interval(c, 0, (1 << 64) - 1, 0) for c in range(len(columns))]
    while intervals:
        rows: list[list] = [[] for _ in intervals]
        buckets = max(2, BUCKETS // max(1, -(-len(intervals) // len(columns))))
        for k, at, n, least, most in _scan(df, columns, intervals, buckets):
            rows[k].append((at, n, least + (1 << 63), most + (1 << 63)))
        if wanted is None:
            sizes = [sum(r[1] for r in got) for got in rows]
            wanted = [list(ranks(n)) if n else [] for n in sizes]
        following = []
        for interval, got in zip(intervals, rows):
            before, c = interval.before, interval.column
            for _, n, least, most in sorted(got):
                here = [r for r in wanted[c] if before < r <= before + n]
                if here and least == most:
                    found[c].update(dict.fromkeys(here, _double(least)))
                elif here:
                    following.append(_Interval(c, least, most, before))
                before += n
        intervals = following
    return {name: [found[c][r] for r in wanted[c]] for c, name in enumerate(columns)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each column: of an even number of values the mean of the middle two."""
    middle = ranked(df, columns, lambda n: [(n + 1) // 2, n // 2 + 1])
    return {c: v[0] / 2 + v[1] / 2 if v and v[0] != v[1] else v[0] if v else None for c, v in middle.items()}


def cut_points(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Upper ends of at most ``bins`` equally filled bins per column, the last one left out; equal
    values share a bin."""
    cuts = ranked(df, columns, lambda n: [(j * n + bins - 1) // bins for j in range(1, bins)] + [n])
    return {c: [v for v in sorted(set(vs[:-1])) if v < vs[-1]] if vs else [] for c, vs in cuts.items()}
