"""All candidate pairs of an LSH forest that are still open once first links are confirmed.

A run is all classes that share the first ``LEAST_DEPTH`` minima of a tree. A run whose classes lie in
more than one component is compared whole, wherever its rows are in the order and however many they
are: it is cut by hash into blocks of bounded size, every two blocks of it meet in one task, and
there

1. the signatures of all pairs of different components are compared, a pair in the first tree only
   whose run holds both ends, and classes with a pair that is not clearly less go on,
2. all pairs of these classes are counted on the full sets, and of the links found, those that join
   something yet apart are returned.

Nothing unconfirmed is left out on account of other pairs. Rows and sets are sent once per other
block of their run, so the rows moved grow with the square of a run's size over ``ROWS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.membership import marked
from dugout.llm.store import kept

ROWS, MEMBERS = 2048, 1 << 21  # of a block, about: classes, and members of their sets
FEW = 16  # rows whose sets are intersected pair by pair
WIDE = 4096  # members counted by one product of matrices
KEY = ["run", "lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, which lie together, however many batches they span."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in KEY], 1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, n]):
            if held and (a or (keys[0] != last).any()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both blocks of a group; the same twice where a block meets itself."""
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    if lo == hi:
        return (everything := np.arange(t.num_rows)), everything
    mine = t["mine"].to_numpy()
    return np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)


def _apart(p: np.ndarray, q: np.ndarray, same: bool, part: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be links by component and size; each once where a block meets itself."""
    least, most = np.minimum(n[p, None], n[q]), np.maximum(n[p, None], n[q])
    ok = (part[p, None] != part[q]) & (100 * least >= percent * most)
    return ok & (p[:, None] < q) if same else ok


def screened(likeness: Callable[[np.ndarray, np.ndarray], np.ndarray], clearly_less: float, percent: int):
    """Keys and ids of the rows that have a pair whose signatures are not clearly less alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            p, q = _sides(t)
            if not len(p) or not len(q):
                continue
            part, n = t["part"].to_numpy(), t["n"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            runs = pc.list_flatten(t["runs"]).to_numpy().reshape(t.num_rows, -1)
            tree = t["run"][0].as_py() >> 48
            hit = np.zeros(t.num_rows, bool)
            for at in range(0, len(p), 64):
                own = p[at : at + 64]
                x, y = np.nonzero(_apart(own, q, p is q, part, n, percent))
                x, y = own[x], q[y]
                near = likeness(sketch[x], sketch[y]) >= clearly_less
                x, y = x[near], y[near]
                first = ~(runs[x, :tree] == runs[y, :tree]).any(1)
                hit[x[first]] = hit[y[first]] = True
            if hit.any():
                yield from t.select([*KEY, "mine", "part", "id"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _shared(flat: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many members each row of ``p`` shares with each of ``q``."""
    row = np.repeat(np.arange(len(size)), size)
    _, member, number = np.unique(flat, return_inverse=True, return_counts=True)
    member, row = (both := member[number[member] > 1]), row[number[member] > 1]
    order = np.argsort(both, kind="stable")
    member, row = member[order], row[order]
    member = np.cumsum(np.r_[False, member[1:] != member[:-1]]) if len(member) else member
    out = np.zeros((len(p), len(q)), np.float32)  # exact to 2**24 members
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, WIDE):
        a, b = np.searchsorted(member, [at, at + WIDE])
        x = np.zeros((len(size), WIDE), np.float32)
        x[row[a:b], member[a:b] - at] = 1
        out += x[p] @ x[q].T
    return out


def _joining(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> list[int]:
    """Numbers of links (a, b) that suffice to join all that the links join."""
    ends = np.sort(np.stack([part[a], part[b]], 1), 1)
    _, once = np.unique(ends, axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for k in once.tolist():
        x, y = root(int(ends[k, 0])), root(int(ends[k, 1]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def linked(percent: int):
    """Confirmed links of each group of rows with their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            p, q = _sides(t)
            if not len(p) or not len(q):
                continue
            ids, part = t["id"].to_numpy(), t["part"].to_numpy()
            size = pc.list_value_length(t["members"]).to_numpy().astype(np.int64)
            flat = pc.list_flatten(t["members"]).to_numpy()
            x, y = np.nonzero(_apart(p, q, p is q, part, size, percent))
            if not len(x):
                continue
            if t.num_rows <= FEW:
                at = np.r_[0, np.cumsum(size)]
                sets = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
                shared = np.array([len(np.intersect1d(sets[p[i]], sets[q[j]], assume_unique=True)) for i, j in zip(x, y)])
            else:
                shared = _shared(flat, size, p, q)[x, y].astype(np.int64)
            x, y = p[x], q[y]
            near = 100 * shared >= percent * (size[x] + size[y] - shared)
            x, y = x[near], y[near]
            some = _joining(x, y, part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ids[x[some]], ids[y[some]])), pa.array(np.maximum(ids[x[some]], ids[y[some]]))],
                ["a", "b"])

    return run


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], screen, link) -> DataFrame:
    """(a, b) confirmed between different components of ``classes`` (id, n, part, sketch, runs: an
    array of tree << 48 | prefix); ``sets_of`` gives (id, members) of a table of distinct ids."""
    each = classes.select("id", "n", "part", F.explode("runs").alias("run"))
    runs = each.groupBy("run").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_members"), F.min("part").alias("_low"),
        F.max("part").alias("_high"))
    runs = kept(
        runs.filter("_low <> _high").select(
            "run", F.greatest(F.ceil(F.col("_rows") / ROWS), F.ceil(F.col("_members") / MEMBERS)).cast("int").alias("_blocks")),
        "runs-open")
    rows = classes.select("id", "n", "part", "sketch", "runs", F.explode("runs").alias("run"))
    rows = marked(rows, F.col("run"), runs.select("run")).filter("_m_maybe").drop("_m_maybe").join(runs, "run")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn(
        "_theirs", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("run", F.least("mine", "_theirs").alias("lo"), F.greatest("mine", "_theirs").alias("hi"),
                         "mine", "part", "id", "n", "sketch", "runs")
    sorted_ = dealt.repartition(*KEY).sortWithinPartitions(*KEY)
    open_ = kept(sorted_.mapInArrow(screen, "run bigint, lo int, hi int, mine int, part bigint, id bigint"), "runs-rows")
    members = sets_of(open_.select("id").distinct())
    met = open_.join(members, "id").select(*KEY, "mine", "part", "id", "members")
    return met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(link, "a bigint, b bigint").distinct()
