"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes), a signature of 128 minima
   and an order-free digest of the set. Rows with equal sets form a class, which has a number of its own.
2. Each of 16 trees sorts all classes by eight of the minima. A class's candidates are the rows that
   follow it in that order, those with the longest common prefix first: where a region of the order
   is crowded, the window lies deep, where it is thin, down to a prefix of three minima (two sets of
   similarity 0.75 share it in one of the 16 trees with probability 0.9998).
3. Candidates whose signatures disagree clearly are left out. Of the others, eight edge-disjoint
   spanning forests of the likeliest pairs go first per run of rows and tree: however a group is
   divided in two, the eight likeliest pairs across are among them (all, in a group of up to 16), so
   a group of n near copies is mostly joined by on the order of n pairs. The rest waits for step 5.
4. Every candidate pair is confirmed on the full sets, and confirmed links give components.
5. What the windows and forests leave open is done whole: in every run of classes with three minima
   in common, all pairs that confirmed links have not joined are compared (``minhash_runs``).

Defined cases: null texts and texts without words have the empty set and link with nothing; texts of
fewer than five words have their whole sequence as one shingle; repeated texts share a class; a null
``doc_id`` links with nothing and is its own (null) component, kept; a ``doc_id`` on several rows is
treated row by row: its texts join only the groups that they are like, and rows that repeat an id and a
set have the same result. ``without_copies`` leaves one row of each group, chosen among rows of its
smallest ``doc_id`` by digest, then text, then the other columns as JSON; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dugout.llm import minhash_runs as R
from dugout.llm import text as T
from dugout.llm.components import components
from dugout.llm.membership import marked, parted, without
from dugout.llm.store import kept, prepare

TREES, DEPTH = 16, 8
LEAST_DEPTH = 3
WINDOW = 32
PERCENT = 75
CLEARLY_LESS = 0.58  # estimate of 128 minima; similarity 0.75 falls below once in 100,000 pairs
SURE, SURE_FORESTS = 0.88, 3  # fewer suffice for pairs as likely as this
FORESTS = 8  # likeliest pairs confirmed first across any division of a group

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(75))
_MULTIPLY = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_NIBBLES = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def signature(members: np.ndarray) -> np.ndarray:
    """128 16-bit values of a set of hashes."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(members), 2048):
        np.minimum(least, (members[i : i + 2048, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (T.mix(least) >> _U(48)).astype(">u2")


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text, sorted."""
    buf, off = T.buffers(texts)
    hashes, first, _, _ = T.words(buf, off)
    found, at = T.shingles(hashes, first)
    return [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]


def digest(members: np.ndarray) -> tuple[int, int]:
    one = int(T.mix(members).sum(dtype=np.uint64))
    two = int(T.mix(members * _MULTIPLY[0]).sum(dtype=np.uint64))
    return one - (1 << 63), two - (1 << 63)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, d1, d2, signature): set size, digest, signature (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            sets = sets_of(batch.column("text"))
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n", "d1", "d2", "signature"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, signature binary")


def _orders(classes: DataFrame) -> DataFrame:
    """(tree, key, id, sketch): a row per class and tree; the sketch holds four bits per minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            packed = _packed(values)
            keys = values.reshape(n, TREES, 2 * DEPTH)
            sketch = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(packed.shape[1]), n, [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            for t in range(TREES):
                key = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(2 * DEPTH), n, [None, pa.py_buffer(keys[:, t].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), key, batch.column("id"), sketch], ["tree", "key", "id", "sketch"])

    return classes.select("id", "signature").mapInArrow(run, "tree int, key binary, id bigint, sketch binary")


def _packed(values: np.ndarray) -> np.ndarray:
    """Four bits of each minimum of signatures given as bytes, two to a byte."""
    low = values[:, 1::2] & 15
    return low[:, ::2] << 4 | low[:, 1::2]


def _likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of packed signatures."""
    agree = _NIBBLES[one ^ other].sum(1, dtype=np.int64) / (one.shape[1] * 2)
    return (agree - 1 / 16) / (1 - 1 / 16)


def _pairs(batch, fresh: int) -> list[tuple[int, int]]:
    """Candidate pairs of sorted rows that hold at least one row from ``fresh`` on."""
    tree, key, ids, sketch = batch
    lo, hi, like = [], [], []
    for step in range(1, min(WINDOW, len(ids) - 1) + 1):
        begin = max(0, fresh - step)
        i = np.flatnonzero((tree[begin:-step] == tree[begin + step :])
                           & (key[begin:-step] == key[begin + step :]).all(1)) + begin
        if not len(i):
            continue
        likeness = _likeness(sketch[i], sketch[i + step])
        near = (likeness >= CLEARLY_LESS) & (ids[i] != ids[i + step])
        i, likeness = i[near], likeness[near]
        lo.append(np.minimum(ids[i], ids[i + step]))
        hi.append(np.maximum(ids[i], ids[i + step]))
        like.append(likeness)
    if not lo:
        return []
    lo, hi, like = map(np.concatenate, (lo, hi, like))
    _, once = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True)  # rows may span several trees
    lo, hi, like = lo[once], hi[once], like[once]
    forests: list[dict[int, int]] = [{} for _ in range(FORESTS)]

    def root(parent: dict[int, int], x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    # the likeliest first and equals by id, so that the trees agree on what they choose
    for k in np.lexsort((hi, lo, -like)).tolist():
        a, b = int(lo[k]), int(hi[k])
        for parent in forests[:SURE_FORESTS] if like[k] >= SURE else forests:
            x, y = root(parent, a), root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
                break
    return out


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of ``classes`` (id, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fixed = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(n, -1)
            rows = (batch.column("tree").to_numpy(), np.ascontiguousarray(fixed("key")[:, : 2 * LEAST_DEPTH]),
                    batch.column("id").to_numpy(), fixed("sketch"))
            fresh = 0
            if last is not None:
                fresh = len(last[0])
                rows = tuple(np.concatenate([x, y]) for x, y in zip(last, rows))
            found = _pairs(rows, fresh)
            last = tuple(x[-WINDOW:] for x in rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    ordered = _orders(classes).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def members(docs: DataFrame, classes: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, members): the full sets of those of ``classes`` that the distinct ``ids`` name, each once."""
    wanted = kept(ids.join(classes.select("id", "doc_id", "rows", "d1", "d2"), "id"), "forest-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            sets = sets_of(batch.column("text"))
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "members"])

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    texts = marked(texts, F.col("doc_id"), wanted.select("doc_id")).filter("_m_maybe").select("doc_id", "text")
    sets = texts.mapInArrow(run, "doc_id bigint, d1 bigint, d2 bigint, members array<bigint>")
    found = kept(sets.join(wanted, ["doc_id", "d1", "d2"]).select("id", "rows", "members"), "forest-sets")
    # only a class of several rows can have its smallest id on more than one of them
    again = found.filter("rows > 1").select("id", "members").dropDuplicates(["id"])
    return found.filter("rows = 1").select("id", "members").union(again)


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    sets = members(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), doc_id, text)
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("_b")), "b")
    )
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.filter(100 * shared >= PERCENT * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def remaining(docs: DataFrame, classes: DataFrame, found: DataFrame, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Confirmed links (a, b) between different components of ``found`` (id, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            first = values.view(">u2").reshape(n, TREES, DEPTH)[:, :, :LEAST_DEPTH].astype(np.int64)
            runs = (np.arange(TREES) << 48) + (first << 16 * np.arange(LEAST_DEPTH)).sum(2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n"), batch.column("part"),
                 pa.array([s.tobytes() for s in _packed(values)], pa.binary()),
                 pa.array(list(runs), pa.list_(pa.int64()))], ["id", "n", "part", "sketch", "runs"])

    parts = classes.join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("part"), "signature")
    parts = kept(parts.mapInArrow(run, "id bigint, n bigint, part bigint, sketch binary, runs array<bigint>"), "forest-parts")
    return R.links(parts, lambda ids: members(docs, classes, ids, doc_id, text),
                   R.screened(_likeness, CLEARLY_LESS, PERCENT), R.linked(PERCENT))


def _joined(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The stored sketches, and (n, d1, d2, component_id, head) of every class: the smallest ``doc_id``
    of its group, and whether the row that stays for the group is of this class."""
    prepare(docs.sparkSession)
    rows = kept(sketches(docs, doc_id, text), "forest-sketches")
    whole = rows.filter("n > 0 and doc_id is not null")
    classes = whole.groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("signature").alias("signature"))
    # numbered as they are stored: from then on the numbers are fixed
    classes = kept(classes.withColumn("id", F.monotonically_increasing_id()), "forest-classes")
    pairs = kept(candidates(classes), "forest-pairs")
    links = kept(confirmed(docs, classes, pairs, doc_id, text), "forest-links")
    found = components(links)
    rest = kept(remaining(docs, classes, found, doc_id, text), "forest-links")
    if not rest.isEmpty():
        found = components(links.union(rest))
    narrow = classes.select("id", "n", "d1", "d2", "doc_id").join(found, "id", "left")
    heads = kept(
        narrow.filter("component is not null").groupBy("component")
        .agg(F.min(F.struct("doc_id", "n", "d1", "d2", "id")).alias("h")), "forest-heads")
    own = narrow.join(heads, "component", "left").select(
        "n", "d1", "d2", F.coalesce("h.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("h.id") == F.col("id"), F.lit(True)).alias("head"))
    return rows, kept(own, "forest-components")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows, of_class = _joined(docs, doc_id, text)
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _one_each(docs: DataFrame, staying: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` without a set, and one row for each (_id, _n, _d1, _d2) of ``staying``."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            sets = sets_of(batch.column("text"))
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())],
                ["_row", "_id", "_n", "_d1", "_d2"])

    key = ["_id", "_n", "_d1", "_d2"]
    row = StructField("_row", docs.schema)
    sets = packed.mapInArrow(run, StructType([row, *(StructField(c, LongType()) for c in key)]))
    order = Window.partitionBy(*key).orderBy(F.col(f"_row.`{text}`"), F.to_json("_row"))
    first = sets.filter("_n > 0").join(staying, key, "left_semi").withColumn(
        "_place", F.row_number().over(order)).filter("_place = 1")
    return sets.filter("_n = 0").select("_row.*").unionByName(first.select("_row.*"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a set or a ``doc_id``, and one row of each group."""
    rows, of_class = _joined(docs, doc_id, text)
    state = rows.filter("doc_id is not null").select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    stays = F.coalesce(F.col("head") & (F.col("doc_id") == F.col("component_id")), F.lit(False))
    state = kept(state.select("doc_id", "n", "d1", "d2", stays.alias("stays")), "forest-rows")
    by_id = state.groupBy("doc_id").agg(
        F.count_if((F.col("n") > 0) & ~F.col("stays")).alias("go"), F.count_if("stays").alias("stay"),
        F.count_if(F.col("n") == 0).alias("bare"))
    by_id = kept(by_id.filter("go > 0 or stay > 1"), "forest-gone")
    # an id with rows of both kinds, or with several that may stay, is looked at row by row
    several = by_id.filter("stay > 1 or go > 0 and stay + bare > 0").select("doc_id")
    left = without(docs, doc_id, by_id.filter("stay + bare = 0").select("doc_id"))
    if several.isEmpty():
        return left
    others, mixed = parted(left, doc_id, several)
    staying = state.filter("stays").select(
        *(F.col(c).alias(f"_{c}" if c != "doc_id" else "_id") for c in ("doc_id", "n", "d1", "d2"))).distinct()
    return others.unionByName(_one_each(mixed, staying, doc_id, text))
