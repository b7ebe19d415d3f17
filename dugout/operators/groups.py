"""How large the groups of a table are, and how to cut a hot group into ordered chunks.

A window over ``partitionBy(key)`` puts one key's rows into one task. That is the cheapest plan
while keys are small, and a dead end when a single key holds a large share of a huge table. This
module finds such keys from a column-pruned count and gives their rows a chunk number by order, so
sequence operators can work on (key, chunk) instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.session import cut_lineage

HOT_ROWS = 2_000_000  # a group above this many rows is cut into chunks of about this size
SMALL_BYTES = 64 * 1024 * 1024  # an input below this size cannot hold a group too big for a task
MAX_CHUNKS = 1024  # per key; beyond it chunks grow instead, and the window sort spills
SAMPLES_PER_CHUNK = 16
BLOCK = 32  # cut points are looked up in two steps of this size
BROADCAST_CUTS = 200_000  # hot keys x chunks up to which the cut table is broadcast

BROADCAST_ROWS = 500_000  # rows of a few narrow columns, some tens of MB
SURELY_SMALL_BYTES = 8 * 1024 * 1024  # below the optimizer's own broadcast limit

CHUNK = "_chunk"


def size_estimate(df: DataFrame) -> int | None:
    """Bytes the optimizer expects of this plan; None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        return None


@dataclass(frozen=True)
class Hot:
    """Keys with more than ``rows`` rows: a (small) frame of key, _rows, _chunks."""

    frame: DataFrame
    keys: tuple[str, ...]
    rows: int
    n_keys: int
    n_chunks: int


def find_hot(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> Hot | None:
    """None when every group is small enough for one task.

    A small input is decided from the optimizer's size estimate alone. Otherwise one aggregation
    over the key columns decides; its result on the driver is a single row.
    """
    if rows >= HOT_ROWS:
        size = size_estimate(df)
        if size is not None and size <= SMALL_BYTES:
            return None
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows)
        .withColumn("_chunks", F.least(F.lit(MAX_CHUNKS), F.ceil(F.col("_rows") / rows)).cast("int"))
    )
    n_keys, n_chunks = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_chunks"), F.lit(0))).first()
    if not n_keys:
        return None
    # the list of hot keys is short; keep it, so that using it does not count the table again
    return Hot(cut_lineage(hot), tuple(keys), rows, n_keys, n_chunks)


def kept_once(aggregate: DataFrame) -> DataFrame:
    """An aggregate that several plans will read: stored once unless it is cheap to compute again."""
    size = size_estimate(aggregate)
    return aggregate if size is not None and size <= SMALL_BYTES else cut_lineage(aggregate)


def settled(small: DataFrame) -> DataFrame:
    """The small side of a join against a log, computed once and broadcast if it is proven small.

    Left to itself, adaptive execution finds out that a side is small only while it already shuffles
    the log. Here the side (an aggregate per key) is kept in the shared folder and its rows are
    counted; up to ``BROADCAST_ROWS`` narrow rows it is broadcast and the log stays where it is,
    beyond that it is joined by shuffle. Sides the optimizer knows to be small need no job.
    """
    size = size_estimate(small)
    if size is not None and size <= SURELY_SMALL_BYTES:
        return small
    kept = cut_lineage(small)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _match(left: DataFrame, right: DataFrame, keys: list[str], n_right: int, how: str) -> DataFrame:
    """Null-safe equi-join on keys; the right side carries them as _k0, _k1, ..."""
    on = None
    for i, k in enumerate(keys):
        term = left[k].eqNullSafe(right[f"_k{i}"])
        on = term if on is None else on & term
    side = F.broadcast(right) if n_right <= BROADCAST_CUTS else right
    return left.join(side, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def with_chunks(df: DataFrame, hot: Hot, order: list[str]) -> DataFrame:
    """Add ``_chunk`` (0 for ordinary keys) and ``_hot``. Chunks of a key follow its row order.

    Cut points come from a hash sample of the key's rows, at most 16 per chunk, so the sample of
    one key stays bounded however many rows it has. ``order`` must be a total order within a key.
    """
    keys = list(hot.keys)
    here = F.struct(*[F.col(c) for c in order])
    rate = F.greatest(
        F.lit(1), F.floor(F.col("_rows") / (F.col("_chunks") * SAMPLES_PER_CHUNK))
    ).cast("bigint")
    sample = (
        _match(df.select(*keys, *[c for c in order if c not in keys]),
               _renamed(hot.frame, keys), keys, hot.n_chunks, "inner")
        .filter(F.pmod(F.xxhash64(*[F.col(c) for c in order]), rate) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(here)).alias("_s"), F.max("_chunks").alias("_n"))
    )
    stride = F.greatest(F.lit(1), F.ceil(F.size("_s") / F.col("_n"))).cast("int")
    cuts = sample.withColumn("_stride", stride).select(
        *keys, F.expr("filter(_s, (x, i) -> i % _stride = 0 AND i > 0)").alias("_cuts")
    )
    cuts = cuts.withColumn("_coarse", F.expr(f"filter(_cuts, (x, i) -> i % {BLOCK} = 0)"))
    tagged = _match(df, _renamed(cuts, keys), keys, hot.n_chunks, "left").withColumn("_here", here)
    block = F.expr("size(filter(_coarse, c -> c <= _here))")
    within = F.expr(
        f"size(filter(slice(_cuts, greatest(_block - 1, 0) * {BLOCK} + 1, {BLOCK}), c -> c <= _here))"
    )
    return (
        tagged.withColumn("_block", block)
        .withColumn(
            CHUNK,
            F.when(F.col("_cuts").isNull() | (F.col("_block") == 0), 0)
            .otherwise((F.col("_block") - 1) * BLOCK + within)
            .cast("int"),
        )
        .withColumn("_hot", F.col("_cuts").isNotNull())
        .drop("_cuts", "_coarse", "_here", "_block")
    )


def in_order(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)
