"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded hash sample of the vectors (``SAMPLE`` rows): their neighbour graph, a balanced
partitioning of that graph that cuts few edges, and a small softmax classifier that gives, for a
vector, the shares of its neighbours in each partition. On held-out sample rows it is counted how
many partitions, most probable first, hold ``RECALL`` of the true neighbours: that many are probed.

Index: every row goes to its most probable partition. Search: a query goes to its most probable
partitions (more of them while they hold few rows), is compared with all their rows in double
precision, and the best are merged. Partitions and their queries are cut into blocks of bounded size
by hash, so a partition that holds a third of all rows is many tasks, and what a task reads is
bounded.

Defined cases: vectors that are null, zero, of another length than most or with null or non-finite
components take no part, nor do null ids; rows that repeat an id are one candidate, at its best
score; a row is no candidate for a query of the same id; ties go to the smaller id; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm import vectors as V
from dugout.llm.store import kept, prepare

SAMPLE = 8192  # rows the index is fitted on
NEIGHBOURS = 10  # of the graph
ROWS = 24  # sample rows per partition at least
PARTITIONS = 256  # at most
SLACK = 1.05  # a partition's size over the mean
RECALL = 0.96  # of held-out sample neighbours, by which the number of probes is set
BLOCK = 1024  # rows or queries of a partition in one task
ENOUGH = 50  # rows that the probed partitions hold at least, while there are more


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, nearest first."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        if out.shape[1]:
            top = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
            out[a : a + 1024] = np.take_along_axis(top, order, 1)
    return out


def balanced(near: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """A part per vertex: grown breadth-first to equal sizes, then vertices move to the part of most
    of their neighbours where there is room."""
    n = len(near)
    links: list[list[int]] = [list(r) for r in near.tolist()]
    for a, row in enumerate(near.tolist()):
        for b in row:
            links[b].append(a)
    room = int(np.ceil(SLACK * n / parts))
    fill = int(np.ceil(n / parts))
    part, size, at, queue = [-1] * n, [0] * parts, 0, []
    seeds = iter(range(n))
    for p in range(parts):
        queue, at = queue[at:][:1], 0  # the next part starts where the last one stopped
        while size[p] < fill:
            if at == len(queue):
                seed = next((s for s in seeds if part[s] < 0), None)
                if seed is None:
                    break
                queue.append(seed)
            v = queue[at]
            at += 1
            if part[v] < 0:
                part[v] = p
                size[p] += 1
                queue.extend(b for b in links[v] if part[b] < 0)
    for _ in range(sweeps):
        moved = 0
        for v in range(n):
            votes: dict[int, int] = {}
            for b in links[v]:
                votes[part[b]] = votes.get(part[b], 0) + 1
            here = votes.get(part[v], 0)
            to, most = max(((p, c) for p, c in votes.items() if size[p] < room or p == part[v]),
                           key=lambda pc: (pc[1], -pc[0]), default=(part[v], here))
            if most > here:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return np.array(part)


class Router:
    """The classifier: a softmax over the partitions, linear in the unit vector."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4):
        x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
        w = np.zeros((x.shape[1], goal.shape[1]), np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        goal = goal.astype(np.float32)
        for t in range(1, steps + 1):
            p = self._softmax(x @ w)
            slope = x.T @ (p - goal) / len(x) + decay * w
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.w = w.astype(np.float64)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each unit vector, most probable first."""
        return np.argsort(-(x @ self.w[:-1] + self.w[-1]), axis=1, kind="stable")


def fit(x: np.ndarray, rows: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """The router, and how many partitions a query visits. ``rows``: of the whole table."""
    parts = int(max(1, min(PARTITIONS, len(x) // ROWS, round(np.sqrt(rows) / 2))))
    near = graph(x, NEIGHBOURS)
    held = np.arange(len(x)) % 5 == 4
    part = balanced(near, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1)
    for j in range(near.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[near[:, j]]), 1)
    goal /= goal.sum(1, keepdims=True)
    router = Router(x[~held], goal[~held])
    ranked = router.ranked(x)
    place = np.argsort(ranked, axis=1)  # of each partition in a row's order
    asked = np.flatnonzero(held)
    if not len(asked):
        return router, parts
    found = place[asked[:, None], ranked[near[asked, :k], 0]]
    return router, int(np.quantile(found, recall, method="higher")) + 1


def nearest(rows: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row for which ``queries``
    (over ``id``) holds."""
    spark = prepare(rows.sparkSession)
    whole = V.usable(rows, key, vector)
    n = whole.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router, probes = fit(V.sample(whole, SAMPLE)[1], n, k, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.ranked(V.unit(V.matrix(batch.column("v"))))[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["id", "v", "part"])

    index = kept(whole.mapInArrow(assign, "id bigint, v array<double>, part int"), "ann-index")
    # one number per partition, of which there are at most PARTITIONS
    held = dict(index.groupBy("part").count().collect())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranked = router.ranked(V.unit(V.matrix(batch.column("v"))))
                sizes = np.array([held.get(p, 0) for p in range(ranked.shape[1])])
                so_far = np.cumsum(sizes[ranked], axis=1)
                visits = (np.arange(ranked.shape[1]) < probes) | (so_far - sizes[ranked] < ENOUGH)
                visits &= sizes[ranked] > 0
                i, j = np.nonzero(visits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(i)), batch.column("v").take(pa.array(i)),
                     pa.array(ranked[i, j], pa.int32())], ["id", "v", "part"])

    asked = kept(index.filter(queries).select("id", "v").mapInArrow(route, "id bigint, v array<double>, part int"),
                 "ann-queries")
    load = dict(asked.groupBy("part").count().collect())
    blocks = lambda counts, p: -(-counts.get(p, 0) // BLOCK) or 1

    def dealt(own: dict, other: dict, queries: bool):
        """Each row to the blocks of the other side in its partition."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, part = batch.column("id").to_numpy(), batch.column("part").to_numpy()
                mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                mine %= np.array([blocks(own, p) for p in part])
                copies = np.array([blocks(other, p) for p in part])
                i = np.repeat(np.arange(len(ids)), copies)
                theirs = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
                cells = (mine[i], theirs) if queries else (theirs, mine[i])
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[i]), pa.array(cells[0]), pa.array(cells[1]), pa.array(np.full(len(i), queries)),
                     batch.column("id").take(take), batch.column("v").take(take)],
                    ["part", "asked", "block", "query", "id", "v"])

        return run

    cell = "part int, asked bigint, block bigint, query boolean, id bigint, v array<double>"
    parts_asked = index.filter(F.col("part").isin(*load)) if load else index.limit(0)
    rows_in = parts_asked.select("id", "v", "part").mapInArrow(dealt(held, load, False), cell)
    asks_in = asked.mapInArrow(dealt(load, held, True), cell)

    def compare(table: pa.Table) -> pa.Table:
        flag = table["query"].to_numpy()
        ids, x = table["id"].to_numpy(), V.unit(V.matrix(table["v"]))
        q, c = np.flatnonzero(flag), np.flatnonzero(~flag)
        c = c[np.argsort(ids[c], kind="stable")]
        score = x[q] @ x[c].T
        score[ids[q][:, None] == ids[c][None, :]] = -np.inf
        if len(c) > k and len(np.unique(ids[c])) == len(c):
            least = np.partition(score, len(c) - k, axis=1)[:, len(c) - k]
        else:
            least = np.full(len(q), -2.0)
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        order = np.lexsort((ids[c[j]], -score[i, j], i))
        i, j = i[order], j[order]
        fresh = np.ones(len(i), bool)  # an id that repeats counts once, at its best score
        if len(np.unique(ids[c])) < len(c):
            seen = set()
            for t, key_ in enumerate(zip(i.tolist(), ids[c[j]].tolist())):
                fresh[t] = key_ not in seen
                seen.add(key_)
            i, j = i[fresh], j[fresh]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pa.table({"query_id": ids[q[i]], "vec_id": ids[c[j]], "score": score[i, j]})

    found = rows_in.unionByName(asks_in).groupBy("part", "asked", "block").applyInArrow(
        compare, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
