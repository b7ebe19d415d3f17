"""Trees from histograms: a forest per key, all keys at once.

Rows are binned once (``Bins``: exact quantiles for numbers, a 0/1 input per category) and packed into
blocks of one key: a byte per input, the class, a fixed-point weight, a hash of the row. Trees grow a
level at a time. A level needs, per (key, tree, node, input, bin, class), the weight and number of rows
that reach the node; the best split of each node follows from these sums alone.

* A key of one block (up to ``BLOCK`` rows) grows all levels of a group of trees inside one task; keys
  and groups of trees are spread over the cluster, and no histogram is shuffled.
* A key of several blocks grows by one aggregation per depth: every block sends its sums, they are added
  (before the shuffle as far as they meet there), and the splits go back to the blocks.

Both ways take the same decisions: weights are whole multiples of 2**-20, so sums are exact in any
order, a tree's bootstrap is a Poisson(1) draw per row from a hash of the row and the tree, the inputs
tried at a node are drawn by a hash of key, tree and node, and scores are compared at ten digits, ties
going to the first input and the lowest cut. A lost executor repeats its work with the same result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, MapType, StringType, StructType

from dugout.operators import quantiles
from dugout.operators.groups import settled
from dugout.session import cut_lineage, release, scratch_path, stored

BLOCK = 1 << 16  # rows of a key in one block
GROUP = 25  # trees grown in one task
UNIT = 1 << 20  # weights are multiples of 1 / UNIT
NODES = 256  # nodes whose histograms are held at once
CELLS = 1 << 21  # of these histograms
TOGETHER = 1 << 18  # row copies of small keys whose trees grow at once
BATCH = 32 << 20  # bytes of rows and trees that are scored at once
DIGITS = 10  # of a score, as a share of the node's weight

_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _number(*parts) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:8], "little")


# --- bins -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Bins:
    """How columns become bytes: cut points of numbers, categories of text."""

    cuts: dict[str, list[float]]
    categories: dict[str, list[str]]

    @property
    def inputs(self) -> list[tuple[str, str | None]]:
        return [(c, None) for c in self.cuts] + [(c, v) for c, vs in self.categories.items() for v in vs]

    @property
    def size(self) -> int:
        return max([2, *(len(v) + 1 for v in self.cuts.values())])

    def codes(self, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        """rows x inputs; a number's bin is how many cuts lie below it."""
        out = np.zeros((table.num_rows, len(self.inputs)), np.uint8)
        for i, (c, cuts) in enumerate(self.cuts.items()):
            values = table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, i] = np.searchsorted(np.array(cuts, float), values, side="left")
        at = len(self.cuts)
        for c, known in self.categories.items():
            if not known:
                continue
            index = pc.fill_null(pc.index_in(table.column(c), value_set=pa.array(known, pa.string())), -1)
            index = np.asarray(index.combine_chunks() if isinstance(index, pa.ChunkedArray) else index)
            rows = np.flatnonzero(index >= 0)
            out[rows, at + index[rows]] = 1
            at += len(known)
        return out


def bins_of(rows: DataFrame, numeric: list[str], text: list[str], size: int = 64) -> Bins:
    """Bins from all rows, which hold no NULL here. Categories of a text column are few by its meaning."""
    if not 2 <= size <= 256:
        raise ValueError("a bin is one byte")
    cuts = quantiles.cut_points(rows, numeric, size)
    known = rows.agg(*[F.sort_array(F.collect_set(f"`{c}`")).alias(c) for c in text]).first() if text else ()
    return Bins(cuts, {c: list(v) for c, v in zip(text, known)})


# --- growing ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Spec:
    """Settings that a task needs to grow trees."""

    trees: int
    depth: int
    min_leaf: int
    min_split: int
    tried: int  # inputs per node
    inputs: int
    bins: int
    classes: int
    bootstrap: bool
    seed: int


@dataclass
class Block:
    """Rows of one key."""

    codes: np.ndarray  # rows x inputs
    label: np.ndarray
    weight: np.ndarray  # in units
    row: np.ndarray  # hashes

    @staticmethod
    def of(codes: bytes, label: bytes, weight: bytes, row: bytes, inputs: int) -> Block:
        return Block(np.frombuffer(codes, np.uint8).reshape(-1, inputs) if inputs else np.zeros((len(row) // 8, 0), np.uint8),
                     np.frombuffer(label, np.uint16).astype(np.int64), np.frombuffer(weight, np.int64), np.frombuffer(row, np.uint64))

    def drawn(self, tree: int, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
        """Rows in a tree's bootstrap, and their weights."""
        if not spec.bootstrap:
            keep = np.flatnonzero(self.weight > 0)
            return keep, self.weight[keep].astype(float)
        u = mix(self.row + np.uint64(_number(spec.seed, "tree", tree))) >> np.uint64(11)
        times = np.searchsorted(_CDF, u / float(1 << 53), side="right")
        keep = np.flatnonzero((times > 0) & (self.weight > 0))
        return keep, (self.weight[keep] * times[keep]).astype(float)


def tried_inputs(key: str, tree: int, nodes: np.ndarray, spec: Spec) -> np.ndarray:
    """nodes x tried: the inputs tried at each node, in order."""
    return _tried(nodes, np.uint64(_number(spec.seed, "node", key, tree)), spec)


def _tried(nodes: np.ndarray, base: np.ndarray, spec: Spec) -> np.ndarray:
    if spec.tried >= spec.inputs:
        return np.tile(np.arange(spec.inputs), (len(nodes), 1))
    start = mix(nodes.astype(np.uint64) + base)
    draw = mix(start[:, None] + np.arange(1, spec.inputs + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(draw, spec.tried, axis=1)[:, : spec.tried], axis=1)


def sums(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, at: np.ndarray, tried: np.ndarray, spec: Spec):
    """Cells that hold rows and their sums, for rows at nodes ``at`` (0, 1, ...). A cell is
    ((node * tried + slot) * bins + bin) * (classes + 1) + class; class ``classes`` counts rows."""
    width = spec.classes + 1
    slots = tried.shape[1]
    cells = (at[:, None] * slots + np.arange(slots)) * spec.bins + codes[np.arange(len(at))[:, None], tried[at]]
    cells = (cells * width).ravel()
    size = len(tried) * slots * spec.bins * width
    total = np.bincount(cells + np.repeat(label, slots), np.repeat(weight, slots), size)
    total += np.bincount(cells + spec.classes, minlength=size)
    used = np.flatnonzero(total)
    return used, total[used]


def compact(codes: np.ndarray, at: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins by their rank among those that rows of the node (``at``) have in a slot, for rows x slots, and
    the bin of each rank (nodes x slots x ranks). A bin without rows never decides: the bin before it
    splits the same rows and is lower."""
    slots = codes.shape[1]
    place = at[:, None] * slots + np.arange(slots)
    present = np.zeros((nodes * slots, bins), bool)
    present[place, codes] = True
    rank = present.cumsum(axis=1, dtype=np.int32) - 1
    of = np.full((nodes * slots, max(2, int(rank[:, -1].max(initial=0)) + 1)), -1)
    where, bin_ = np.nonzero(present)
    of[where, rank[where, bin_]] = bin_
    return rank[place, codes], of.reshape(nodes, slots, -1)


def best_of(hist: np.ndarray, tried: np.ndarray, of: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """``best`` of histograms over ranks of bins (``compact``)."""
    feature, rank, *rest = best(hist, tried, spec)
    slot = (tried == feature[:, None]).argmax(axis=1)
    return feature, np.where(feature >= 0, of[np.arange(len(of)), slot, rank], -1), *rest


def best(hist: np.ndarray, tried: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Per node the split input (-1: none) and its bin, class weights, rows, and the gain in score.

    ``hist``: nodes x slots x bins x (classes + 1). A score is sum(w_c ** 2) / sum(w_c) over both
    sides, as a share of the node's weight: what a split adds to it is the fall in Gini impurity.
    """
    whole = hist[:, 0].sum(axis=1)
    weights, rows = whole[:, :-1], whole[:, -1]
    total = weights.sum(axis=1)
    own = (weights**2).sum(axis=1) / total**2
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None, :] - left
    score = np.zeros(left.shape[:3])
    for side in (left, right):
        mass = side[..., :-1].sum(axis=3)
        score += np.divide((side[..., :-1] ** 2).sum(axis=3), mass, out=np.zeros_like(mass), where=mass > 0)
    score = np.round(score / total[:, None, None], DIGITS)
    allowed = (left[..., -1] >= spec.min_leaf) & (right[..., -1] >= spec.min_leaf)
    score[~allowed] = -1.0
    flat = score.reshape(len(score), -1)
    first = flat.argmax(axis=1)  # the first of equals: inputs in order, then the lowest bin
    gain = flat[np.arange(len(flat)), first] - np.round(own, DIGITS)
    slot, bin_ = np.divmod(first, score.shape[2])
    split = (gain > 10.0**-DIGITS) & (rows >= spec.min_split)
    feature = np.where(split, tried[np.arange(len(tried)), slot], -1)
    return feature, np.where(split, bin_, -1), weights.astype(np.int64), rows.astype(np.int64), np.where(split, gain * total, 0.0)


@dataclass
class Tree:
    """Nodes in order of their numbers (root 1, children 2 n and 2 n + 1)."""

    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, nodes, feature, bin_, weights, rows, gain) -> None:
        for column, values in zip((self.node, self.feature, self.bin, self.rows, self.weights, self.gain), (nodes, feature, bin_, rows, weights, gain)):
            column.extend(values.tolist())


def histograms(used: np.ndarray, total: np.ndarray, nodes: int, slots: int, spec: Spec) -> np.ndarray:
    out = np.zeros(nodes * slots * spec.bins * (spec.classes + 1))
    out[used] = total
    return out.reshape(nodes, slots, spec.bins, spec.classes + 1)


@dataclass
class Nodes:
    """Nodes of many trees, in order of ``unit`` (a tree of a key) and number."""

    unit: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    rows: np.ndarray
    weights: np.ndarray  # nodes x classes
    gain: np.ndarray

    def reached(self, codes: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Index of the leaf of each row in the tree ``unit``; -1 where that has no nodes."""
        number = (self.unit << 32) + self.node
        find = lambda wanted: np.minimum(np.searchsorted(number, wanted), max(0, len(number) - 1))
        if not len(number):
            return np.full(len(unit), -1)
        at = find((unit << 32) + 1)
        live = np.flatnonzero(self.unit[at] == unit)
        out = np.full(len(unit), -1)
        at = at[live]
        while len(live):
            split = self.feature[at]
            out[live[split < 0]] = at[split < 0]
            live, at, split = live[split >= 0], at[split >= 0], split[split >= 0]
            at = find((unit[live] << 32) + 2 * self.node[at] + (codes[live, split] > self.bin[at]))
        return out


def grown_together(codes: np.ndarray, label: np.ndarray, row: np.ndarray, unit: np.ndarray, weight: np.ndarray, base: np.ndarray, spec: Spec,
                   exact: np.ndarray | None = None) -> Nodes:
    """All trees of many small keys, level by level. A tree (``unit``) has ``row`` places of ``codes`` and
    ``label``, with ``weight`` in units; ``base`` has the number from which it draws the inputs tried.
    ``exact``: weights of the rows to be reported, rounded, in place of those in units."""
    out = []
    place = np.ones(len(row), np.int64)
    for depth in range(spec.depth + 1):
        if not len(row):
            break
        ids, at = np.unique((unit << 32) + place, return_inverse=True)
        of_unit, nodes = ids >> 32, ids & 0xFFFFFFFF
        feature, bin_, gain = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros(len(ids))
        cell = at * spec.classes + label[row]
        whole = np.bincount(cell, weight, len(ids) * spec.classes).reshape(-1, spec.classes)
        size = np.bincount(at, minlength=len(ids))
        if depth < spec.depth:  # nodes that may split; all others are leaves whatever their histograms say
            wanted = np.flatnonzero((size >= spec.min_split) & ((whole > 0).sum(axis=1) > 1))
            number = np.full(len(ids), len(wanted))
            number[wanted] = np.arange(len(wanted))
            order = np.argsort(number[at], kind="stable")
            ends = np.concatenate([[0], size[wanted].cumsum()])
            step = max(1, min(NODES, CELLS // (spec.tried * spec.bins * (spec.classes + 1))))
            for k in range(0, len(wanted), step):
                part = wanted[k : k + step]
                mine = order[ends[k] : ends[k + len(part)]]
                tried = _tried(nodes[part], base[of_unit[part]], spec)
                slots, r, node = tried.shape[1], row[mine], number[at[mine]] - k
                ranks, of = compact(codes[r[:, None], tried[node]], node, len(part), spec.bins)
                cells = ((node[:, None] * slots + np.arange(slots)) * of.shape[2] + ranks) * (spec.classes + 1)
                most = of.size * (spec.classes + 1)
                hist = np.bincount((cells + label[r][:, None]).ravel(), np.repeat(weight[mine], slots), most)
                hist += np.bincount((cells + spec.classes).ravel(), minlength=most)
                found = best_of(hist.reshape(*of.shape, -1), tried, of, spec)
                feature[part], bin_[part], gain[part] = found[0], found[1], found[4]
        told = whole.astype(np.int64) if exact is None else np.round(np.bincount(cell, exact, whole.size).reshape(whole.shape), 12)
        out.append((of_unit, nodes, feature, bin_, size, told, gain))
        split = feature[at]
        keep = split >= 0
        row, unit, weight, place, at, split = row[keep], unit[keep], weight[keep], place[keep], at[keep], split[keep]
        exact = None if exact is None else exact[keep]
        place = 2 * place + (codes[row, split] > bin_[at])
    if not out:
        none = np.zeros(0, np.int64)
        return Nodes(none, none, none, none, none, np.zeros((0, spec.classes)), np.zeros(0))
    columns = [np.concatenate(c) for c in zip(*out)]
    order = np.lexsort((columns[1], columns[0]))
    return Nodes(*(c[order] for c in columns))


def reached(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    """Index of the leaf of each row, in a tree of nodes sorted by number."""
    at = np.zeros(len(codes), np.int64)
    live = np.arange(len(codes))
    while len(live):
        split = feature[at[live]]
        live, split = live[split >= 0], split[split >= 0]
        child = 2 * node[at[live]] + (codes[live, split] > bin_[at[live]])
        at[live] = np.searchsorted(node, child)
    return at


# --- blocks in Spark --------------------------------------------------------------------------
def _block_count(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_of")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))


def _dealt(rows: DataFrame, key: str, size: int, counts: DataFrame | None = None) -> DataFrame:
    """Rows with ``_block`` and ``_blocks``: a key of many rows is dealt over blocks by row hash. ``counts``:
    the number of blocks of each key, if known."""
    dealt = rows.join(settled(_block_count(rows, key, size)) if counts is None else counts, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")
    return dealt.withColumn("_block", F.pmod(F.col("_rid"), F.col("_blocks")).cast("int"))


def coded(rows: DataFrame, bins: Bins) -> DataFrame:
    """``rows`` with all inputs in one column ``codes``, a byte per input, from whole batches of rows."""
    inputs = {*bins.cuts, *bins.categories}
    kept = [f for f in rows.schema if f.name not in inputs]
    schema = StructType([*kept]).add("codes", BinaryType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.ascontiguousarray(bins.codes(batch))
            ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], packed], names=[*[f.name for f in kept], "codes"])

    return rows.mapInArrow(work, schema)


def blocks(rows: DataFrame, key: str, label: str, weight: str | None, classes: list[str], bins: Bins, row_id: list[str], size: int = BLOCK) -> DataFrame:
    """(key, _block, _blocks, codes, label, weight, row) of the rows with a known class."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    units = F.lit(UNIT) if weight is None else F.round(F.col(weight) * UNIT)
    inputs = [*bins.cuts, *bins.categories]
    ready = rows.filter(place > 0).select(
        key, *[F.col(f"`{c}`") for c in inputs], (place - 1).cast("int").alias("_class"), units.cast("bigint").alias("_weight"),
        F.xxhash64(*row_id).alias("_rid"))
    dealt = _dealt(coded(ready, bins), key, size)

    def pack(table: pa.Table) -> pa.Table:
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        column = lambda c: table.column(c).to_numpy()
        return pa.table({
            key: table.column(key).slice(0, 1), "_block": table.column("_block").slice(0, 1), "_blocks": table.column("_blocks").slice(0, 1),
            "codes": pa.array([b"".join(table.column("codes").to_pylist())], pa.binary()), "label": blob(column("_class").astype(np.uint16)),
            "weight": blob(column("_weight").astype(np.int64)), "row": blob(column("_rid").astype(np.int64))})

    kind = dict(rows.dtypes)[key]
    return dealt.groupBy(key, "_block").applyInArrow(
        pack, f"`{key}` {kind}, _block int, _blocks int, codes binary, label binary, weight binary, row binary")


_TREE = "tree int, node array<bigint>, feature array<int>, bin array<int>, rows array<bigint>, weights array<array<bigint>>, gain array<double>"


def _tree_batch(key_name: str, keys: list, numbers: list[int], found: Nodes, key_type: pa.DataType) -> pa.RecordBatch:
    ends = pa.array(np.searchsorted(found.unit, np.arange(len(keys) + 1)), pa.int32())
    listed = lambda values, kind: pa.ListArray.from_arrays(ends, values if isinstance(values, pa.Array) else pa.array(values, kind))
    classes = found.weights.shape[1]
    weights = pa.ListArray.from_arrays(pa.array(np.arange(len(found.node) + 1) * classes, pa.int32()), pa.array(found.weights.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, key_type), pa.array(numbers, pa.int32()), listed(found.node, pa.int64()), listed(found.feature, pa.int32()),
         listed(found.bin, pa.int32()), listed(found.rows, pa.int64()), listed(weights, None), listed(found.gain, pa.float64())],
        names=[key_name, "tree", "node", "feature", "bin", "rows", "weights", "gain"])


def _spread(work: DataFrame, *by: str) -> DataFrame:
    """Pieces of work over as many tasks as a shuffle has. They are few bytes and much computing, so
    tasks must not be merged by their size; a given number is kept."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _grown_whole(packed: DataFrame, key: str, spec: Spec) -> DataFrame:
    """Trees of keys of one block; a task takes a key and a group of trees."""
    groups = -(-spec.trees // GROUP)
    spread = _spread(packed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), key, "_group")

    def grow(some: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        keys, numbers, base, row, unit, weight, at = [], [], [], [], [], [], 0
        for name, group, block in some:
            for tree in range(group * GROUP, min(spec.trees, (group + 1) * GROUP)):
                drawn, w = block.drawn(tree, spec)
                row.append(drawn + at)
                unit.append(np.full(len(drawn), len(keys)))
                weight.append(w)
                keys.append(name)
                numbers.append(tree)
                base.append(_number(spec.seed, "node", str(name), tree))
            at += len(block.label)
        codes, label = np.concatenate([b.codes for *_, b in some]), np.concatenate([b.label for *_, b in some])
        found = grown_together(codes, label, *map(np.concatenate, (row, unit, weight)), np.array(base, np.uint64), spec)
        return _tree_batch(key, keys, numbers, found, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                some.append((row[key], row["_group"], Block.of(row["codes"], row["label"], row["weight"], row["row"], spec.inputs)))
                size += len(some[-1][2].label) * min(spec.trees, GROUP)
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    yield grow(some, batch.schema.field(key).type)
                    some, size = [], 0

    return spread.mapInArrow(work, f"`{key}` {dict(packed.dtypes)[key]}, {_TREE}")


def _grown_by_level(packed: DataFrame, key: str, spec: Spec) -> DataFrame:
    """Trees of keys of several blocks: one aggregation per depth.

    The splits found so far are joined to the blocks of their key; each block sends the sums of the
    rows that reach the nodes of the next depth.
    """
    kind = dict(packed.dtypes)[key]
    spark = packed.sparkSession
    flat = f"`{key}` {kind}, tree int, node bigint, feature int, bin int, rows bigint, weights array<bigint>, gain double"
    groups = -(-spec.trees // GROUP)
    spread = _spread(packed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), key, "_block", "_group")
    levels: list[DataFrame] = []
    for depth in range(spec.depth + 1):
        last = depth == spec.depth
        if levels:
            so_far = levels[0]
            for level in levels[1:]:
                so_far = so_far.unionByName(level)
            splits = (so_far.filter("feature >= 0").withColumn("s_group", F.floor(F.col("tree") / GROUP).cast("int"))
                      .groupBy(F.col(key).alias("s_key"), "s_group").agg(F.collect_list(F.struct("tree", "node", "feature", "bin")).alias("splits")))
            met = spread.join(splits, F.col(key).eqNullSafe(F.col("s_key")) & (F.col("_group") == F.col("s_group"))).drop("s_key", "s_group")
        else:
            met = spread.withColumn("splits", F.lit(None).cast("array<struct<tree:int,node:bigint,feature:int,bin:int>>"))

        def send(batches: Iterator[pa.RecordBatch], depth=depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    block = Block.of(row["codes"], row["label"], row["weight"], row["row"], spec.inputs)
                    known: dict[int, dict[int, tuple[int, int]]] = {}
                    for s in row["splits"] or ():
                        known.setdefault(s["tree"], {})[s["node"]] = s["feature"], s["bin"]
                    for tree in range(row["_group"] * GROUP, min(spec.trees, (row["_group"] + 1) * GROUP)):
                        rows, weight = block.drawn(tree, spec)
                        place = np.ones(len(rows), np.int64)
                        for _ in range(depth):
                            nodes, at = np.unique(place, return_inverse=True)
                            split = np.array([known.get(tree, {}).get(int(n), (-1, -1)) for n in nodes], np.int64).reshape(-1, 2)[at]
                            keep = split[:, 0] >= 0
                            rows, weight, place, split = rows[keep], weight[keep], place[keep], split[keep]
                            place = 2 * place + (block.codes[rows, split[:, 0]] > split[:, 1])
                        nodes, at = np.unique(place, return_inverse=True)
                        for k in range(0, len(nodes), NODES):
                            mine = np.flatnonzero((at >= k) & (at < k + NODES))
                            part = nodes[k : k + NODES]
                            tried = tried_inputs(str(row[key]), tree, part, spec)
                            r = rows[mine]
                            used, total = sums(block.codes[r], block.label[r], weight[mine], at[mine] - k, tried, spec)
                            each = tried.shape[1] * spec.bins * (spec.classes + 1)
                            n = len(used)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row[key]] * n, batch.schema.field(key).type), pa.array(np.full(n, tree), pa.int32()),
                                 pa.array(part[used // each], pa.int64()), pa.array(used % each, pa.int64()), pa.array(total.astype(np.int64), pa.int64())],
                                names=[key, "tree", "node", "cell", "total"])

        def decide(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    node = np.array([row["node"]])
                    tried = tried_inputs(str(row[key]), row["tree"], node, spec)
                    used = np.array([c["cell"] for c in row["cells"]])
                    total = np.array([c["total"] for c in row["cells"]], float)
                    feature, bin_, weights, rows, gain = best(histograms(used, total, 1, tried.shape[1], spec), tried, spec)
                    if last:
                        feature, bin_, gain = [-1], [-1], [0.0]
                    out.append((row[key], row["tree"], row["node"], int(feature[0]), int(bin_[0]), int(rows[0]), weights[0].tolist(), float(gain[0])))
                if out:
                    kinds = [batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                     names=[key, "tree", "node", "feature", "bin", "rows", "weights", "gain"])

        added = met.mapInArrow(send, f"`{key}` {kind}, tree int, node bigint, cell bigint, total bigint").groupBy(key, "tree", "node", "cell").agg(F.sum("total").alias("total"))
        nodes = added.groupBy(key, "tree", "node").agg(F.collect_list(F.struct("cell", "total")).alias("cells")).mapInArrow(decide, flat)
        path = scratch_path(spark, f"tree-level-{depth}")
        nodes.write.parquet(path)
        levels.append(spark.read.schema(nodes.schema).parquet(path))
        if levels[-1].filter("feature >= 0").isEmpty():
            break
    all_nodes = levels[0]
    for level in levels[1:]:
        all_nodes = all_nodes.unionByName(level)
    columns = ("node", "feature", "bin", "rows", "weights", "gain")
    listed = all_nodes.groupBy(key, "tree").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("n"))
    return listed.select(key, "tree", *[F.col(f"n.{c}").alias(c) for c in columns])


# --- forests ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class KeyForests:
    """A forest per key: (key, tree, node[], feature[], bin[], rows[], weights[][], gain[])."""

    trees: DataFrame
    bins: Bins
    classes: list[str]
    key: str
    spec: Spec
    numeric: list[str]
    text: list[str]

    def save(self, path: str) -> None:
        """The trees as Parquet, and beside them what is needed to apply them."""
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({"cuts": self.bins.cuts, "categories": self.bins.categories, "classes": self.classes, "key": self.key,
                            "spec": self.spec.__dict__, "numeric": self.numeric, "text": self.text})
        self.trees.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KeyForests:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        return KeyForests(spark.read.parquet(f"{path}/trees"), Bins(about["cuts"], about["categories"]), about["classes"], about["key"],
                          Spec(**about["spec"]), about["numeric"], about["text"])


def tried_of(features: str, inputs: int) -> int:
    """How many inputs a node tries."""
    return {"log2": max(1, int(math.log2(max(1, inputs)))), "sqrt": max(1, int(math.sqrt(inputs))), "all": inputs}[features]


def fit_each(rows: DataFrame, key: str, label: str, weight: str | None, numeric: list[str], text: list[str], forest, row_id: list[str],
             block: int | None = None, bins: Bins | None = None) -> KeyForests:
    """A forest for every key of ``rows`` (inputs without NULL, see ``learning.impute_constants``).

    ``forest``: settings (``learning.Forest``). ``row_id`` names the columns that tell rows apart.
    """
    spark = rows.sparkSession
    rows_at, blocks_at = scratch_path(spark, "forest-rows"), scratch_path(spark, "forest-blocks")
    rows = stored(rows.select(*dict.fromkeys([key, label, *([weight] if weight else []), *numeric, *text, *row_id])), rows_at)
    classes = sorted(r[0] for r in rows.select(label).distinct().collect() if r[0] is not None)
    bins = bins or bins_of(rows, numeric, text, forest.max_bins)
    n = len(bins.inputs)
    spec = Spec(forest.trees, forest.depth, forest.min_leaf, forest.min_split, min(n, tried_of(forest.features, n)), n, bins.size, len(classes),
                forest.bootstrap, forest.seed)
    if not n:
        raise ValueError("a forest needs at least one input")
    packed = stored(blocks(rows, key, label, weight, classes, bins, row_id, block or BLOCK), blocks_at)
    release(spark, rows_at)
    several = packed.filter("_blocks > 1")
    trees = _grown_whole(packed.filter("_blocks = 1"), key, spec)
    if not several.isEmpty():
        trees = trees.unionByName(_grown_by_level(several, key, spec))
    trees = cut_lineage(trees)
    release(spark, blocks_at)
    return KeyForests(trees, bins, classes, key, spec, numeric, text)


def _hashable(kind: DataType) -> bool:
    inner = [f.dataType for f in kind] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return not isinstance(kind, MapType) and all(map(_hashable, inner))


def _dealt_to_predict(rows: DataFrame, key: str, inputs: list[str], prepare, absent: dict | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``_row``, the key and the inputs without NULL, dealt over blocks by a hash of the whole row: inputs
    that tell nothing apart must not bring all rows of a key into one block."""
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if _hashable(f.dataType)])  # maps cannot be hashed
    packed = rows.withColumns({"_row": F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "_rid": whole})
    packed = packed.withColumns(absent) if absent else packed
    ready = prepare(packed.select("_row", "_rid", *[F.col(f"`{c}`") for c in dict.fromkeys([key, *inputs])]))
    return _dealt(ready, key, BLOCK, counts)


def predict_each(forests: KeyForests, rows: DataFrame, prepare, absent: dict | None = None) -> DataFrame:
    """``rows`` with ``model_prediction``, ``probabilities`` and ``model_confidence`` from the forest of
    their key: class shares of the leaves, averaged over the trees. A key without a forest has NULLs.

    ``prepare``: adds the inputs without NULL (``learning.impute_constants``), from the columns of
    ``rows`` and ``absent``. Rows of a large key are dealt over blocks, and its trees go to each.
    """
    key, classes, bins = forests.key, forests.classes, forests.bins
    inputs = [*forests.numeric, *forests.text]
    if key in inputs:
        raise ValueError("the key is no input of its own forest")
    counts = settled(_block_count(rows, key, BLOCK))
    dealt = _dealt_to_predict(rows, key, inputs, prepare, absent, counts)
    trees = forests.trees.join(counts, F.col(key).eqNullSafe(F.col("_of"))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    trees = trees.select(key, "_block", "tree", "node", "feature", "bin", F.flatten("weights").alias("weights"))
    schema = (StructType().add("_row", dealt.schema["_row"].dataType).add("model_prediction", StringType()).add("_p", ArrayType(DoubleType()))
              .add("model_confidence", DoubleType()))
    each = forests.spec.trees

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, []  # the key and block at the end of the batch before, and its trees
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_block").to_numpy()
            name = batch.column(key).dictionary_encode("encode").indices.to_numpy()
            new = np.append(True, (name[1:] != name[:-1]) | (block[1:] != block[:-1]))
            of = new.cumsum() - 1  # keys and blocks of the batch, in order
            if last != (batch.column(key)[0].as_py(), int(block[0])):
                kept = []
            number = batch.column("tree").to_numpy()
            is_tree = number < each
            at = np.flatnonzero(is_tree)
            grown = [(0, part) for part in kept]
            if len(at):
                mine = batch.select(["tree", "node", "feature", "bin", "weights"]).take(pa.array(at))
                edges = np.append(np.flatnonzero(np.diff(of[at], prepend=-1)), len(at))
                grown += [(int(of[at[i]]), mine.slice(i, j - i)) for i, j in zip(edges[:-1], edges[1:])]
            last = (batch.column(key)[-1].as_py(), int(block[-1]))
            kept = [part for g, part in grown if g == of[-1]]
            rows_at = np.flatnonzero(~is_tree)
            if len(rows_at):
                yield score(batch.take(pa.array(rows_at)), of[rows_at], grown)

    def score(left: pa.RecordBatch, of: np.ndarray, grown: list) -> pa.RecordBatch:
        n = left.num_rows
        total = np.zeros((n, len(classes)))
        if grown and classes:
            codes = bins.codes(left)
            parts = pa.Table.from_batches([part for _, part in grown])
            unit = np.repeat([g for g, _ in grown], [part.num_rows for _, part in grown]) * each + parts.column("tree").to_numpy()
            flat = lambda c: parts.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(parts.column("node")).to_numpy()
            weights = flat("weights").astype(float).reshape(-1, len(classes))
            found = Nodes(np.repeat(unit, sizes), flat("node"), flat("feature"), flat("bin"), sizes, weights, weights)
            shares = weights / weights.sum(axis=1, keepdims=True)
            for tree in range(each):
                leaf = found.reached(codes, of * each + tree)
                has = np.flatnonzero(leaf >= 0)
                total[has] += shares[leaf[has]]
        mass = total.sum(axis=1, keepdims=True)
        known = mass[:, 0] > 0
        p = np.divide(total, mass, out=total, where=mass > 0)
        top = np.round(p, DIGITS).argmax(axis=1) if len(classes) else np.zeros(n, int)  # of equals the first class
        call = pa.array(classes, pa.string()).take(pa.array(top, pa.int64(), mask=~known))
        confidence = pa.array(p[np.arange(n), top] if len(classes) else np.zeros(n), pa.float64(), mask=~known)
        ends = np.arange(n + 1, dtype=np.int32) * len(classes)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()), mask=pa.array(~known))
        return pa.RecordBatch.from_arrays([left.column("_row"), call, listed, confidence], names=["_row", "model_prediction", "_p", "model_confidence"])

    # trees of many keys and the rows after them come in one batch, which is scored at once
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    both = dealt.drop("_rid", "_blocks").withColumn("tree", F.lit(each)).unionByName(trees, allowMissingColumns=True)
    scored = both.repartition(key, "_block").sortWithinPartitions(key, "_block", "tree").mapInArrow(apply, schema)
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select("_row.*", "model_prediction", F.when(F.col("_p").isNotNull(), F.map_from_arrays(names, "_p")).alias("probabilities"), "model_confidence")


def importance(forests: KeyForests) -> DataFrame:
    """Each key's inputs with their share of the fall in impurity; one-hot inputs as ``column=value``."""
    names = F.array(*[F.lit(c if v is None else f"{c}={v}") for c, v in forests.bins.inputs])
    each = forests.trees.select(forests.key, F.explode(F.arrays_zip("feature", "gain")).alias("s")).filter("s.feature >= 0")
    summed = each.groupBy(forests.key, F.element_at(names, F.col("s.feature") + 1).alias("feature")).agg(F.sum("s.gain").alias("gain"))
    total = summed.groupBy(F.col(forests.key).alias("_of")).agg(F.sum("gain").alias("_all"))
    return summed.join(settled(total), F.col(forests.key).eqNullSafe(F.col("_of"))).select(
        forests.key, "feature", (F.col("gain") / F.col("_all")).alias("importance"))
