"""Near-duplicate vectors by a robust-pruned flat graph.

1. Tight groups: rows of a cluster shard within half of the linking angle of a leader are linked
   with one another for certain, so a group stands for them, with its leader, radius and size. Large
   shards are cut into blocks by hash and the leaders grouped again, until no fewer remain. A group
   of n near copies is handled without n * n comparisons.
2. Graph over the leaders: each leader joins the shards of its nearest centres (overlapping), in each
   shard its neighbours are pruned robustly, and a leader's adjacency lists are united.
3. Search: in each of its shards, a leader goes greedily from the shard's medoid to the nearest rows
   of the graph, and from those in range on to all that are in range (the linking angle and the
   radii).
4. Verification: a pair of groups is linked wholly, not at all, or, where the radii leave that open,
   row by row in double precision, in blocks.
5. Audit: for a sample of all rows, chosen by hash whether links were found or not, the links are
   counted by brute force; the recall is the mean over sampled rows that have links, so rows of a hot
   group weigh no more than others. Below the wanted recall the search is repeated with twice the
   overlap and beam, and when leaders in all their shards would cost more than all blocks against all
   blocks (overlap squared against shards), the pairs of leaders in range are found in that way.

Defined cases: vectors that are null, zero, of another length than most or with null or non-finite
components link with nothing and are kept; so do rows with a null id, which have a null component;
rows that repeat an id are one vector (the smallest by value) and one row of the result; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm import vectors as V
from dugout.llm.components import components
from dugout.llm.store import kept, prepare

COSINE = 0.9
SAMPLE = 8192  # rows from which the shard centres are fitted
SHARD = 1000  # rows per shard wanted
SHARDS = 512  # at most
BLOCK = 2048  # rows of a shard in one task
OVERLAP = 3  # shards of a leader
DEGREE, POOL, ALPHA = 16, 48, 1.2  # of the pruned graph
BEAM = 24
AUDITED, WANTED = 4096, 0.99
EPSILON = 1e-9  # radians, for the rounding of an angle

ROW = "id bigint, v array<double>"
GROUP = f"{ROW}, radius double, size bigint"


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of sample rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        long = np.linalg.norm(sums, axis=1) > 1e-9
        c[long] = sums[long] / np.linalg.norm(sums[long], axis=1, keepdims=True)
    return c


def _hash(ids: np.ndarray, salt: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def sharded(rows: DataFrame, c: np.ndarray, overlap: int, schema: str) -> DataFrame:
    """Each row with the numbers of its ``overlap`` nearest centres, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(V.unit(V.matrix(batch.column("v"))) @ c.T), axis=1, kind="stable")[:, :overlap]
                yield batch.append_column("shards", V.as_list(near.astype(np.int32)).cast(pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"{schema}, shards array<int>")


def _blocks(counts: dict[int, int]):
    """A column that cuts each shard (column ``shard``) into blocks of bounded size, from the rows per
    shard; there are at most SHARDS numbers, looked up in one array (a condition per shard nests too deep)."""
    many = [max(1, -(-counts.get(s, 0) // BLOCK)) for s in range(max(counts, default=0) + 1)]
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in many]), F.col("shard")), F.lit(1))


def _leaders(leaders: DataFrame, c: np.ndarray, limit: float, salt: int) -> DataFrame:
    """One round: (id, leader, angle, radius, size, v) of every row of ``leaders``."""
    rows = kept(sharded(leaders, c, 1, GROUP).withColumn("shard", F.col("shards")[0]).drop("shards"), "graph-shards")
    number = _blocks(dict(rows.groupBy("shard").count().collect()))
    block = F.pmod(F.xxhash64(F.lit(salt), "id"), number)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = table["id"].to_numpy(), V.unit(V.matrix(table["v"]))
        radius = table["radius"].to_numpy()
        leader, far = np.full(len(ids), -1), np.zeros(len(ids))
        for i in range(len(ids)):
            if leader[i] < 0:
                open_ = np.flatnonzero(leader[i:] < 0) + i
                apart = angle(x[open_] @ x[i])
                apart[0] = 0.0
                # the leader's own radius counts from its first place, the others' from theirs
                near = apart + radius[open_] <= limit
                near[0] = True
                leader[open_[near]], far[open_[near]] = i, apart[near]
        return pa.table({"id": ids, "leader": ids[leader], "angle": far, "radius": radius,
                         "size": table["size"], "v": table["v"]})

    return kept(
        rows.withColumn("block", block).groupBy("shard", "block").applyInArrow(
            group, "id bigint, leader bigint, angle double, radius double, size bigint, v array<double>"), "graph-leaders")


def tight_groups(rows: DataFrame, c: np.ndarray, limit: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, leader) and leaders (id, v, radius, size). Within a group any two rows are less
    than twice ``limit`` apart. A leader has the smallest id of its group."""
    leaders = rows.withColumns({"radius": F.lit(0.0), "size": F.lit(1).cast("bigint")})
    members, before, salt = None, None, 0
    while True:
        step = _leaders(leaders, c, limit, salt)
        sums = step.groupBy(F.col("leader").alias("id")).agg(
            F.max(F.col("angle") + F.col("radius")).alias("radius"), F.sum("size").alias("size"))
        heads = step.filter("id = leader").select("id", "v")
        leaders = kept(heads.join(kept(sums, "graph-sums"), "id").select("id", "v", "radius", "size"), "graph-groups")
        own = step.select("id", "leader")
        if members is None:
            members = own
        else:
            later = own.select(F.col("id").alias("leader"), F.col("leader").alias("_l"))
            members = kept(members.join(later, "leader").select("id", F.col("_l").alias("leader")), "graph-members")
        n = leaders.count()
        if before is not None and n > 0.9 * before or n <= 1:
            return members, leaders
        before, salt = n, salt + 1


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row: the nearest first, leaving out those that are much
    nearer to a neighbour already taken than to the row itself."""
    n = len(x)
    k = min(POOL, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    near = x @ x.T
    apart = np.sqrt(np.maximum(2 - 2 * near, 0))
    np.fill_diagonal(near, -np.inf)
    pool = np.argpartition(-near, k - 1, axis=1)[:, :k]
    pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(near, pool, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(apart, pool, 1)
    alive, row = np.ones((n, k), bool), np.arange(n)
    chosen = np.full((n, DEGREE), -1)
    for step in range(DEGREE):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        taken = pool[row, first]
        chosen[some, step] = taken[some]
        alive &= ALPHA * apart[taken[:, None], pool] > own
        alive[row, first] = False
    return [r[r >= 0] for r in chosen]


def in_range(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, reach: np.ndarray, beam: int | None):
    """(query, row) pairs within ``reach`` (radians, per query) that the search finds: greedily with a
    beam from the medoid, then on through every row in range. Without a beam, all pairs."""
    n, m = len(x), len(q)
    centre = x.sum(0)
    medoid = int((x @ centre).argmax())
    width = max((len(r) for r in links), default=0)
    if not width or beam is None:
        inside = angle(q @ x.T) <= reach[:, None]
        return np.nonzero(inside)
    table = np.full((n, width), -1)
    for i, r in enumerate(links):
        table[i, : len(r)] = r
    least = np.cos(np.minimum(reach, np.pi))
    beam = min(beam, n)
    best = np.full((m, beam), -np.inf)  # scores of the best rows seen, the least of them first
    seen = np.zeros(m * n, bool)
    i, j = np.arange(m), np.full(m, medoid)  # rows seen last, in order of the query
    seen[i * n + j] = True
    cosine = (q @ x.T).ravel()
    score = cosine[i * n + j]
    found = []
    while len(i):
        hit = score >= least[i]
        found.append(i[hit] * n + j[hit])
        order = np.lexsort((-score, i))
        own, first, at = np.unique(i, return_index=True, return_inverse=True)
        rank = np.arange(len(i)) - first[at]
        top = rank < beam
        fresh = np.full((len(own), beam), -np.inf)
        fresh[at[top], rank[top]] = score[order[top]]
        best[own] = np.partition(np.concatenate([best[own], fresh], axis=1), beam, axis=1)[:, beam:]
        # the neighbours of those in the beam or in range follow; the bar only rises, so others never will
        go = score >= np.minimum(best[i, 0], least[i])
        near = table[j[go]]
        code = (i[go, None] * n + near)[near >= 0]
        before = seen.copy()
        seen[code] = True
        code = np.flatnonzero(seen & ~before)
        (i, j), score = np.divmod(code, n), cosine[code]
    return np.divmod(np.sort(np.concatenate(found)), n)


def graph(leaders: DataFrame, c: np.ndarray, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(places, adjacency): leaders by shard and block; united neighbour lists."""
    rows = sharded(leaders, c, overlap, GROUP).select("id", "v", "radius", F.explode("shards").alias("shard"))
    rows = kept(rows, "graph-places")
    number = _blocks(dict(rows.groupBy("shard").count().collect()))
    places = rows.withColumns({"blocks": number, "block": F.pmod(F.xxhash64("id"), number)})

    def build(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), V.unit(V.matrix(table["v"]))
        return pa.table({"id": ids, "links": pa.array([ids[r] for r in pruned(x)], pa.list_(pa.int64()))})

    lists = places.select("id", "v", "shard", "block").groupBy("shard", "block").applyInArrow(
        build, "id bigint, links array<bigint>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    return places, kept(united, "graph-links")


def search(places: DataFrame, links: DataFrame, widest: float, beam: int | None, cosine: float = COSINE) -> DataFrame:
    """Distinct pairs (a, b), a < b, of leaders whose groups may hold linked rows, with their cosine."""
    linking = float(np.arccos(cosine))
    rows = places.join(links, "id")
    # a block as candidates for every block of queries of its shard
    target = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    asked = rows.select("id", "v", "radius", "shard", "block", target).select(
        "id", "v", "radius", F.lit(None).cast("array<bigint>").alias("links"), "shard", "block", "other")
    held = rows.select("id", "v", "radius", "links", "shard", "block", target).select(
        "id", "v", "radius", "links", "shard", F.col("other").alias("block"), F.col("block").alias("other"))

    def run(table: pa.Table) -> pa.Table:
        has = table["links"].is_valid().to_numpy()
        ids, x, radius = table["id"].to_numpy(), V.unit(V.matrix(table["v"])), table["radius"].to_numpy()
        order = np.flatnonzero(has)
        order = order[np.argsort(ids[order], kind="stable")]
        lists = table["links"].take(pa.array(order)).to_pylist()
        held_ids, q = ids[order], np.flatnonzero(~has)
        if not len(q) or not len(order):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        near = []
        for own in lists:
            at = np.searchsorted(held_ids, own)
            at = np.minimum(at, len(held_ids) - 1)
            near.append(at[held_ids[at] == np.array(own, np.int64)] if len(own) else np.zeros(0, np.int64))
        reach = linking + radius[q] + widest + 1e-6
        i, j = in_range(x[order], near, x[q], reach, beam)
        a, b = ids[q[i]], held_ids[j]
        cos = np.einsum("ij,ij->i", x[q[i]], x[order[j]])
        # with both radii known, most are out of range after all
        good = (a != b) & (angle(cos) <= linking + radius[q[i]] + radius[order[j]] + 1e-6)
        a, b, cos = a[good], b[good], cos[good]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        _, once = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True)
        return pa.table({"a": lo[once], "b": hi[once], "cosine": cos[once]})

    found = asked.unionByName(held).groupBy("shard", "block", "other").applyInArrow(
        run, "a bigint, b bigint, cosine double")
    return found.groupBy("a", "b").agg(F.first("cosine").alias("cosine"))


def _between(open_pairs: DataFrame, members: DataFrame, vectors: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """For pairs of groups left open: (a, b, id, n), how many rows of the other group each row links
    with. Both groups are cut into blocks, so a task reads a bounded number of rows."""
    number = F.ceil(F.col("size") / BLOCK).cast("int")
    size = sizes.select(F.col("id").alias("_id"), number.alias("_n"))
    pairs = (
        open_pairs.select("a", "b").join(size, F.col("a") == F.col("_id")).select("a", "b", F.col("_n").alias("na"))
        .join(size, F.col("b") == F.col("_id")).select("a", "b", "na", F.col("_n").alias("nb"))
    )
    pairs = kept(pairs, "graph-open")
    rows = members.join(vectors, "id")

    def side(own: str, own_n: str, other_n: str, first: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int")
        dealt = pairs.withColumnRenamed(own, "leader").join(rows, "leader").select(
            F.col("leader"), F.col("b" if first else "a").alias("_other"), "id", "v", mine.alias("_mine"),
            F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias("_theirs"))
        a, b = ("leader", "_other") if first else ("_other", "leader")
        x, y = ("_mine", "_theirs") if first else ("_theirs", "_mine")
        return dealt.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(x).alias("x"), F.col(y).alias("y"),
                            F.lit(first).alias("first"), "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy()
        ids, x = table["id"].to_numpy(), V.unit(V.matrix(table["v"]))
        p, q = np.flatnonzero(first), np.flatnonzero(~first)
        hit = x[p] @ x[q].T >= cosine
        n = np.concatenate([hit.sum(1), hit.sum(0)])
        who = np.concatenate([ids[p], ids[q]])
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        return pa.table({"a": np.full(len(who), a), "b": np.full(len(who), b), "id": who, "n": n.astype(np.int64)}).filter(
            pa.array(n > 0))

    both = side("a", "na", "nb", True).unionByName(side("b", "nb", "na", False))
    return both.groupBy("a", "b", "x", "y").applyInArrow(compare, "a bigint, b bigint, id bigint, n bigint")


def audit(vectors: DataFrame, result: DataFrame, cosine: float = COSINE, n: int = AUDITED) -> float:
    """Recall from ``n`` rows chosen by hash, half among all, half among those without a found link:
    the lesser of the mean share of true links found (of rows that have any) and the share of linked
    rows that were not lost altogether."""
    none = result.filter("n_links = 0").orderBy(F.xxhash64("id")).limit(n // 2)
    some = result.orderBy(F.xxhash64(F.lit(1), "id")).limit(n - n // 2)
    sampled = kept(some.withColumn("any", F.lit(True)).unionByName(none.withColumn("any", F.lit(False))), "graph-audit")
    picked = sampled.groupBy("id", "n_links").agg(F.max("any").alias("any")).join(vectors, "id").toArrow()
    if not picked.num_rows:
        return 1.0
    ids, x = picked["id"].to_numpy(), V.unit(V.matrix(picked["v"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = part.column("id").to_numpy()
                total += (x @ V.unit(V.matrix(part.column("v"))).T >= cosine).sum(1) - np.isin(ids, own)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    counted = dict(vectors.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect())
    true = np.array([counted[i] for i in ids.tolist()])
    had = picked["n_links"].to_numpy()
    linked = true > 0
    of_all = linked & picked["any"].to_numpy(zero_copy_only=False)
    recall = (np.minimum(had, true)[of_all] / true[of_all]).mean() if of_all.any() else 1.0
    # what the sample of rows without a found link says about all of them
    n_none, n_some = (result.filter(c).count() for c in ("n_links = 0", "n_links > 0"))
    lost = (linked & (had == 0)).sum() / max(1, (had == 0).sum()) * n_none
    return float(min(recall, 1 - lost / max(1, lost + n_some)))


def grouped(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every id."""
    spark = prepare(table.sparkSession)
    ids = table.select(F.col(key).cast("bigint").alias("vec_id"))
    everyone = ids.distinct()
    rows = kept(V.usable(table, key, vector).groupBy("id").agg(F.min("v").alias("v")), "graph-vectors")
    n = rows.count()
    if not n:
        return everyone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                               F.lit(True).alias("kept"))
    _, x = V.sample(rows, SAMPLE)
    c = centres(x, int(max(1, min(SHARDS, len(x) // 16, round(n / SHARD)))))
    linking = float(np.arccos(cosine))
    members, leaders = tight_groups(rows, c, linking / 2 - 1e-7)
    widest = leaders.agg(F.max("radius")).first()[0]
    overlap, beam = min(OVERLAP, len(c)), BEAM
    while True:
        whole = overlap > 1 and overlap * overlap >= len(c)
        places, links = graph(leaders, c[:1] if whole else c, 1 if whole else overlap)
        found = _linked(places, links, widest, None if whole else beam, cosine, members, leaders, rows)
        if whole or audit(rows, found.select(F.col("id"), "n_links"), cosine) >= WANTED:
            break
        overlap, beam = 2 * overlap, 2 * beam
    out = everyone.join(found, everyone["vec_id"] == found["id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(places, links, widest, beam, cosine, members, leaders, vectors) -> DataFrame:
    """(id, n_links, component) of every usable row."""
    linking = float(np.arccos(cosine))
    size = leaders.select(F.col("id").alias("_id"), "radius", "size")
    pairs = search(places, links, widest, beam, cosine)
    for side in ("a", "b"):
        own = size.select(F.col("_id").alias(side), F.col("radius").alias(f"r{side}"), F.col("size").alias(f"s{side}"))
        pairs = pairs.join(own, side)
    apart, radii = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))), F.col("ra") + F.col("rb")
    kind = (
        F.when(radii == 0, F.col("cosine") >= cosine)
        .when(apart + radii <= linking - EPSILON, True)
        .when(apart - radii > linking + EPSILON, False)
    )
    pairs = kept(pairs.withColumn("whole", kind).filter("whole is null or whole"), "graph-pairs")
    sure, unsure = pairs.filter("whole"), pairs.filter("whole is null")
    rowwise = kept(_between(unsure, members, vectors, leaders, cosine), "graph-rowwise")
    joined = components(sure.select("a", "b").union(rowwise.select("a", "b").distinct()))
    of_group = (
        sure.select(F.col("a").alias("id"), F.col("sb").alias("n")).union(sure.select(F.col("b"), F.col("sa")))
        .groupBy("id").agg(F.sum("n").alias("n"))
    )
    groups = kept(
        leaders.select("id", "size").join(of_group, "id", "left").join(joined, "id", "left").select(
            F.col("id").alias("leader"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("_n"),
            F.coalesce("component", "id").alias("component")), "graph-groups-linked")
    of_row = kept(rowwise.groupBy("id").agg(F.sum("n").alias("_more")), "graph-row-links")
    return kept(
        members.join(groups, "leader").join(of_row, "id", "left").select(
            "id", (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("n_links"), "component"), "graph-result")
