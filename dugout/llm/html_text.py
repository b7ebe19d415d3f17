"""Main text of web pages: markup names blocks, and runs repeated across a host's pages are removed.

Method: the visible blocks of a page (``html_markup``) are a stream of tokens: a marker per block with
its element, then its words. The streams of a host's pages are concatenated and their suffixes sorted
by the first ``RUN`` tokens by prefix doubling (a suffix array to that depth: sorting deeper cannot
change which tokens lie in repeated runs of ``RUN`` tokens or more). An interval of equal prefixes that
holds at least ``LEAST_PAGES`` distinct pages, and a share of ``SHARE`` of them, is boilerplate. Tokens
covered by such runs are marked on every page; a block whose words are all covered goes, and what is
left of the blocks that markup allows is the text. Pages whose allowed text is the same count as one,
so copies of an article are no boilerplate.

A host above ``PART`` bytes is cut by a hash of its pages into parts with suffix arrays of their own.
What a share of all pages holds, that share of at least one part holds, so cutting loses no run (as
long as parts have ``LEAST_PAGES`` distinct pages: a part is 16 MB, a page some tens of KB).
Runs travel as 64-bit hashes of their tokens; two differing runs agree with a chance of 2**-64.

Repetition alone cannot give the contract's result: comments and most adverts never repeat, and
copied articles always do. So what markup names (menus, footers, forms, ...) is removed by name, and an
``article`` is kept against weak evidence by the high ``SHARE``; runs decide about what markup leaves open.

Defined cases: null and empty html give an empty text; pages without a host in their url are read by
markup alone; repeated rows give repeated results and count as one page; texts are whole; a page with
no allowed block has an empty text; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm import html_markup as H
from dugout.llm import text as T
from dugout.llm.store import kept, prepare
from dugout.operators.groups import settled

RUN = 8  # tokens of a run, a power of two
LEAST_PAGES = 5
SHARE = 0.5
PART = 16 << 20  # bytes of html of a host sorted at once
BROADCAST_RUNS = 1 << 20  # runs of all hosts up to which they are broadcast, 8 MB

_PLACE = T.mix(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)
_MARKERS: dict[tuple[int, str], int] = {}


def _marker(level: int, name: str) -> int:
    found = _MARKERS.get((level, name))
    if found is None:
        found = int.from_bytes(hashlib.md5(f"{level}:{name}".encode()).digest()[:8], "little")
        if len(_MARKERS) < 10_000:
            _MARKERS[level, name] = found
    return found


def streams(pages: list[list[tuple[int, str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all pages' blocks in order, where each block starts, and where each page does."""
    found = [b for page in pages for b in page]
    hashes, first, _, _ = T.words(*T.buffers(pa.array([text for _, _, text in found], pa.string())))
    n = len(found)
    starts = first + np.arange(n + 1)
    tokens = np.empty(len(hashes) + n, np.uint64)
    tokens[starts[:-1]] = np.fromiter((_marker(level, name) for level, name, _ in found), np.uint64, n)
    within = np.ones(len(tokens), bool)
    within[starts[:-1]] = False
    tokens[within] = hashes
    page_at = np.zeros(len(pages) + 1, np.int64)
    np.cumsum([len(p) for p in pages], out=page_at[1:])
    return tokens.astype(np.uint32), starts, page_at


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of the ``RUN`` tokens from each place on, where there are as many."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out += T.mix(tokens[k : k + n].astype(np.uint64) + np.uint64(k << 32)) * _PLACE[k]
    return T.mix(out).view(np.int64)


def repeated_runs(pages: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs that enough of these (distinct) pages hold, from their common suffix array."""
    least = max(LEAST_PAGES, int(np.ceil(SHARE * len(pages))))
    if len(pages) < least:
        return np.zeros(0, np.int64)
    size = np.array([len(p) + 1 for p in pages])
    page = np.repeat(np.arange(len(pages)), size)
    stream = np.empty(size.sum(), np.int64)
    ends = np.cumsum(size) - 1
    stream[ends] = (1 << 32) + np.arange(len(pages))  # no run goes from one page into the next
    inside = np.ones(len(stream), bool)
    inside[ends] = False
    stream[inside] = np.concatenate(pages)
    rank = np.unique(stream, return_inverse=True)[1]
    width = 1
    while width < RUN:
        following = np.zeros_like(rank)
        following[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1]
        width *= 2
    suffixes = np.argsort(rank, kind="stable")
    holders = np.bincount(np.unique(rank * len(pages) + page) // len(pages))
    first = np.searchsorted(rank[suffixes], np.flatnonzero(holders >= least))  # of each interval
    at = suffixes[first]
    tokens = np.append(stream, np.zeros(RUN, np.int64))[at[:, None] + np.arange(RUN)]
    whole = (tokens < 1 << 32).all(axis=1) & (at + RUN <= len(stream))
    return np.unique([run_hashes(t.astype(np.uint32))[0] for t in tokens[whole]]).astype(np.int64)


def host(url: Column) -> Column:
    """The host of an address, lower-cased, without user and port; null if it has none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(found != "", found)


def _parsed(batch: pa.RecordBatch) -> list[list[tuple[int, str, str]]]:
    return [H.blocks(page or "") for page in batch.column("html").to_pylist()]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, part, digest of the allowed text, tokens of each page."""
    for batch in T.slices(batches, "html"):
        pages = _parsed(batch)
        tokens, starts, page_at = streams(pages)
        at = starts[page_at]
        digests = []
        for page in pages:
            text = "\n".join(b[2] for b, keep in zip(page, H.chosen(page)) if keep)
            digests.append(hashlib.md5(text.encode()).digest())
        rows = [tokens[a:b].tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())],
            names=["host", "part", "digest", "tokens"])


def _runs(group: pd.DataFrame) -> pd.DataFrame:
    """Runs that a part of a host's pages share."""
    distinct = group.drop_duplicates("digest")
    runs = repeated_runs([np.frombuffer(t, np.uint32) for t in distinct["tokens"]])
    return pd.DataFrame({"host": group["host"].iloc[0], "run": runs})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "html"):
        pages = _parsed(batch)
        tokens, starts, page_at = streams(pages)
        runs = batch.column("runs")
        texts, words, covered_words, by_run = [], [], [], []
        for k, page in enumerate(pages):
            a, b = page_at[k], page_at[k + 1]
            at = starts[a : b + 1] - starts[a]
            keep = H.chosen(page)
            open_words = np.diff(at) - 1
            left = open_words
            if runs[k].is_valid:
                own = tokens[starts[a] : starts[b]]
                hits = np.flatnonzero(np.isin(run_hashes(own), runs[k].values.to_numpy()))
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, hits, 1)
                np.add.at(edge, hits + RUN, -1)
                free = np.cumsum(edge[:-1]) == 0
                free[at[:-1]] = False  # markers are no words
                sums = np.concatenate(([0], np.cumsum(free)))
                left = sums[at[1:]] - sums[at[:-1]]
            by_run.append(sum(ok and not n for ok, n in zip(keep, left)))
            texts.append("\n\n".join(text for (_, _, text), ok, n in zip(page, keep, left) if ok and n))
            words.append(int(open_words.sum()))
            covered_words.append(int((open_words - left).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             *[pa.array(c, pa.int64()) for c in ([len(t) for t in texts], words, covered_words, by_run)]],
            names=["page_id", "url", "text", "n_chars", "n_words", "n_covered", "n_run_blocks"])


def host_runs(pages: DataFrame) -> DataFrame:
    """(host, runs): hashes of the token runs that are boilerplate of each host."""
    sizes = (pages.filter(F.col("host").isNotNull()).groupBy("host")
             .agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
             .filter(F.col("pages") >= LEAST_PAGES)
             .select(F.col("host").alias("sized"), F.ceil(F.coalesce("bytes", F.lit(0)) / PART + F.lit(1e-9)).alias("parts")))
    # one row per host, counted before it is broadcast: the html is shuffled for no join
    dealt = pages.join(settled(sizes), F.col("host") == F.col("sized")).select(
        "host", F.pmod(F.xxhash64("page_id", "url", "html"), "parts").alias("part"), "html")
    tokens = dealt.mapInArrow(_tokens, "host string, part bigint, digest binary, tokens binary")
    runs = tokens.groupBy("host", "part").applyInPandas(_runs, "host string, run bigint")
    return kept(runs.groupBy(F.col("host").alias("of")).agg(F.collect_set("run").alias("runs")), "host-runs")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; then its visible words, how many of them lie in runs
    of the host, and the allowed blocks that went for that reason."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    runs = host_runs(rows)
    few = (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_RUNS
    joined = rows.join(F.broadcast(runs) if few else runs, F.col("host") == F.col("of"), "left")
    return joined.select("page_id", "url", "html", "runs").mapInArrow(
        _texts, "page_id bigint, url string, text string, n_chars bigint, n_words bigint, n_covered bigint, n_run_blocks bigint")
