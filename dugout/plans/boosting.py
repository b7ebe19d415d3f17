"""Softmax boosting: a tree per class and round, all classes from the same histograms.

Rows are binned and packed into blocks (``trees.blocks``), which carry the score of each class. A round
grows one tree per class on gradients of the log loss, level by level: every block sends, per (class,
node, input, bin), the sums of gradients and Hessians of its rows, one aggregation adds them, and the
splits that gain most come back; they are few (classes x nodes), so they travel with the next job. Then
the blocks write their new scores, with the log loss of the rows learned from and of the rows held out
by a hash; boosting stops when the held-out loss has not fallen for ``patience`` rounds.

Sums are whole multiples of 2**-30, exact in any order, so a lost executor changes nothing. Scores are
written to the shared folder each round and the round before is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from dugout.plans import trees as T
from dugout.session import cut_lineage, drop_path, scratch_path

FIXED = 1 << 30  # gradients and Hessians are counted in these units
DIGITS = 9  # at which gains are compared


@dataclass(frozen=True)
class Boosting:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 5
    min_leaf: int = 20
    l2: float = 0.1
    max_bins: int = 64
    held_out: float = 0.1  # share of rows; 0: no early stop
    patience: int = 10
    seed: int = 42


# a tree is a dict of node -> (input or -1, bin, value)
Trees = list[dict[int, tuple[int, int, float]]]


@dataclass(frozen=True)
class Boosted:
    """Trees of all rounds and classes, and the loss after each round."""

    rounds: list[Trees]
    start: list[float]
    bins: T.Bins
    classes: list[str]
    numeric: list[str]
    text: list[str]
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        about = {"rounds": self.rounds, "start": self.start, "cuts": self.bins.cuts, "categories": self.bins.categories, "classes": self.classes,
                 "numeric": self.numeric, "text": self.text, "losses": self.losses}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        about = json.loads(spark.read.text(path, wholetext=True).first()[0])
        rounds = [[{int(n): tuple(v) for n, v in tree.items()} for tree in trees] for trees in about["rounds"]]
        return Boosted(rounds, about["start"], T.Bins(about["cuts"], about["categories"]), about["classes"], about["numeric"], about["text"],
                       [tuple(x) for x in about["losses"]])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def places(codes: np.ndarray, tree: dict) -> np.ndarray:
    """The node of each row: where its way through the splits known so far ends."""
    at = np.ones(len(codes), np.int64)
    live = np.arange(len(codes))
    while len(live):
        nodes, back = np.unique(at[live], return_inverse=True)
        split = np.array([tree.get(int(n), (-1, -1))[:2] for n in nodes], np.int64)[back]
        live, split = live[split[:, 0] >= 0], split[split[:, 0] >= 0]
        at[live] = 2 * at[live] + (codes[live, split[:, 0]] > split[:, 1])
    return at


def added(codes: np.ndarray, trees: Trees) -> np.ndarray:
    """What one round adds to the scores."""
    out = np.zeros((len(codes), len(trees)))
    for k, tree in enumerate(trees):
        nodes, back = np.unique(places(codes, tree), return_inverse=True)
        out[:, k] = np.array([tree[int(n)][2] for n in nodes])[back]
    return out


def _held(row: np.ndarray, plan: Boosting) -> np.ndarray:
    u = T.mix(row + np.uint64(T._number(plan.seed, "held out"))) >> np.uint64(11)
    return u / float(1 << 53) < plan.held_out


def gradients(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss per row and class, in ``FIXED`` units."""
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1.0
    return np.round(g * FIXED), np.round(p * (1 - p) * FIXED)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, plan: Boosting) -> tuple[int, int, float]:
    """Input, bin and value of one node from its sums (inputs x bins). Input -1: a leaf."""
    total_g, total_h = g[0].sum() / FIXED, h[0].sum() / FIXED
    value = -plan.rate * total_g / (total_h + plan.l2)
    left_g, left_h, left_n = (x.cumsum(axis=1)[:, :-1] for x in (g, h, n))
    right_g, right_h, right_n = (x.sum(axis=1, keepdims=True) - y for x, y in ((g, left_g), (h, left_h), (n, left_n)))
    gain = sum((a / FIXED) ** 2 / (b / FIXED + plan.l2) for a, b in ((left_g, left_h), (right_g, right_h)))
    gain = np.round(gain - total_g**2 / (total_h + plan.l2), DIGITS)
    gain[(left_n < plan.min_leaf) | (right_n < plan.min_leaf)] = -1.0
    first = int(gain.argmax())
    if gain.size == 0 or gain.ravel()[first] <= 0:
        return -1, -1, value
    f, b = divmod(first, gain.shape[1])
    return f, b, value


def _level(blocks: DataFrame, trees: Trees, depth: int, plan: Boosting, inputs: int, bins: int, k: int) -> list:
    """(class, node, input, bin, value) of the nodes at a depth, from one aggregation."""
    size = inputs * bins

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block = T.Block.of(row["codes"], row["label"], row["weight"], row["row"], inputs)
                learn = np.flatnonzero(~_held(block.row, plan))
                codes, label = block.codes[learn], block.label[learn]
                g, h = gradients(np.frombuffer(row["scores"], float).reshape(-1, k)[learn], label)
                for c in range(k):
                    at = places(codes, trees[c])
                    here = np.flatnonzero(at >> depth == 1)  # the others stopped above
                    nodes, back = np.unique(at[here], return_inverse=True)
                    for j, node in enumerate(nodes):
                        mine = here[back == j]
                        cells = (np.arange(inputs) * bins + codes[mine]).ravel()
                        sums = [np.bincount(cells, np.repeat(x, inputs), size) for x in (g[mine, c], h[mine, c])]
                        count = np.bincount(cells, minlength=size)
                        used = np.flatnonzero(count)
                        n = len(used)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, c), pa.int32()), pa.array(np.full(n, node), pa.int64()), pa.array(used, pa.int64()),
                             *[pa.array(x[used].astype(np.int64), pa.int64()) for x in (*sums, count)]], names=["k", "node", "cell", "g", "h", "n"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = np.zeros((3, size))
                cells = [x["cell"] for x in row["cells"]]
                for i, name in enumerate("ghn"):
                    sums[i, cells] = [x[name] for x in row["cells"]]
                f, b, value = best_split(*sums.reshape(3, inputs, bins), plan)
                out.append((row["k"], row["node"], *((f, b) if depth < plan.depth else (-1, -1)), value))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["k", "node", "input", "bin", "value"])

    summed = blocks.mapInArrow(send, "k int, node bigint, cell bigint, g bigint, h bigint, n bigint").groupBy("k", "node", "cell").agg(
        *[F.sum(x).alias(x) for x in "ghn"])
    nodes = summed.groupBy("k", "node").agg(F.collect_list(F.struct("cell", "g", "h", "n")).alias("cells"))
    return nodes.mapInArrow(decide, "k int, node bigint, input int, bin int, value double").collect()


def _scored(blocks: DataFrame, trees: Trees | None, start: list[float], plan: Boosting, inputs: int) -> DataFrame:
    """Blocks with their scores after a round, and sums of the log loss (None: before the first)."""
    k = len(start)
    kept = [c for c in blocks.columns if c not in ("scores", "learned", "n_learned", "held", "n_held")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out, told = [], []
            for row in rows:
                block = T.Block.of(row["codes"], row["label"], row["weight"], row["row"], inputs)
                if trees is None:
                    scores = np.tile(np.array(start), (len(block.label), 1))
                else:
                    scores = np.frombuffer(row["scores"], float).reshape(-1, k) + added(block.codes, trees)
                loss = -np.log(np.maximum(softmax(scores)[np.arange(len(block.label)), block.label], 1e-300))
                held = _held(block.row, plan)
                out.append(np.ascontiguousarray(scores).tobytes())
                told.append((float(loss[~held].sum()), int((~held).sum()), float(loss[held].sum()), int(held.sum())))
            if out:
                more = [pa.array(x, t) for x, t in zip(zip(*told), (pa.float64(), pa.int64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary()), *more],
                                                 names=[*kept, "scores", "learned", "n_learned", "held", "n_held"])

    schema = StructType([blocks.schema[c] for c in kept]).add("scores", "binary").add("learned", "double").add("n_learned", "long")
    return blocks.mapInArrow(work, schema.add("held", "double").add("n_held", "long"))


def fit(rows: DataFrame, numeric: list[str], text: list[str], label: str, plan: Boosting = Boosting(), row_id: list[str] | None = None,
        block: int = T.BLOCK) -> Boosted:
    """Boosted trees over all rows with a label; inputs hold no NULL (``learning.impute_constants``)."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.filter(F.col(label).isNotNull()).withColumn("_all", F.lit(0)))
    counts = rows.groupBy(label).count().collect()
    classes = sorted(r[0] for r in counts)
    total = sum(r["count"] for r in counts)
    share = {r[0]: r["count"] / total for r in counts}
    start = [float(np.log(share[c])) for c in classes]
    bins = T.bins_of(rows, numeric, text, plan.max_bins)
    inputs, k = len(bins.inputs), len(classes)
    packed = T.blocks(rows, "_all", label, None, classes, bins, row_id or [c for c in rows.columns if c != "_all"], block)

    written: list[str] = []

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boosting")
        df.write.parquet(path)
        if written:
            drop_path(spark, written.pop())
        written.append(path)
        return spark.read.schema(df.schema).parquet(path)

    blocks = stored(_scored(packed, None, start, plan, inputs))
    rounds: list[Trees] = []
    losses: list[tuple[float, float | None]] = []
    while len(rounds) < plan.rounds and k > 1 and inputs:
        trees: Trees = [{} for _ in classes]
        for depth in range(plan.depth + 1):
            found = _level(blocks, trees, depth, plan, inputs, bins.size, k)
            for c, node, f, b, value in found:
                trees[c][node] = (f, b, value)
            if all(f < 0 for _, _, f, _, _ in found):
                break
        for tree in trees:  # rows held out may reach a child that no learned row reached
            for node, (f, _, value) in list(tree.items()):
                if f >= 0:
                    tree.setdefault(2 * node, (-1, -1, value))
                    tree.setdefault(2 * node + 1, (-1, -1, value))
            tree.setdefault(1, (-1, -1, 0.0))
        rounds.append(trees)
        blocks = stored(_scored(blocks, trees, start, plan, inputs))
        a = blocks.agg(F.sum("learned"), F.sum("n_learned"), F.sum("held"), F.sum("n_held")).first()
        losses.append((a[0] / a[1] if a[1] else 0.0, a[2] / a[3] if a[3] else None))
        held = [x for _, x in losses]
        if plan.held_out and held[-1] is not None and len(held) > plan.patience and min(held[-plan.patience :]) >= min(held[: -plan.patience]) - 1e-7:
            break
    drop_path(spark, written.pop())
    return Boosted(rounds, start, bins, classes, numeric, text, losses)


def predict(model: Boosted, rows: DataFrame, prepare) -> DataFrame:
    """``rows`` with ``model_prediction``, ``probabilities`` and ``model_confidence``. No shuffle."""
    packed = rows.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    ready = prepare(packed.select("_row", *[F.col(f"`{c}`") for c in [*model.numeric, *model.text]]))
    schema = (StructType().add("_row", ready.schema["_row"].dataType).add("model_prediction", StringType()).add("_p", ArrayType(DoubleType()))
              .add("model_confidence", DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.bins.codes(batch)
            scores = np.tile(np.array(model.start), (batch.num_rows, 1))
            for trees in model.rounds:
                scores += added(codes, trees)
            p = softmax(scores)
            top = np.round(p, 10).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([model.classes[i] for i in top], pa.string()), pa.array(list(p), pa.list_(pa.float64())),
                 pa.array(p[np.arange(len(p)), top], pa.float64())], names=["_row", "model_prediction", "_p", "model_confidence"])

    scored = ready.mapInArrow(work, schema)
    names = F.array(*[F.lit(c) for c in model.classes])
    return scored.select("_row.*", "model_prediction", F.map_from_arrays(names, "_p").alias("probabilities"), "model_confidence")
