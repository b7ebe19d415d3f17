"""Mixing sources to target weights by hash-threshold histograms, with SQL functions only.

Every row has a fixed 60-bit hash of its ``doc_id``. A source's target is so many whole copies of
all its rows plus a rest. The rows with a hash below the source's threshold get one copy more. The
threshold is found in three passes: words summed by source and hash bucket (1024 buckets), then the
same within the one bucket where the running sum passes the rest, then once more within that. No row
is sorted, and the tables behind a window have at most 1024 rows a source.

Defined cases: null text has size 0; a null ``doc_id`` hashes as the empty text; a null source is a
source of its own, last in order; repeated rows (equal ids) are taken together; sources without
words have target 0; an empty table gives no rows; other columns are left alone, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.store import kept, prepare

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # a source's target and a document's copies stop here
LEVELS, BITS, HASH_BITS = 3, 10, 60
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): a source gets its weight's share of
    the budget, at most ``most`` times its size, and the excess goes to the others by weight.

    In the order of limit / weight the full sources come first, so prefix sums decide. The windows
    span one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filled = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_budget", share * F.sum("source_size").over(everything).cast("double"))
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), zero))
        .withColumn("_w_left", F.col("_all_w") - F.coalesce(F.sum("_w").over(before), zero))
        .withColumn("_full", F.col("_cap") * F.col("_w_left")
                    <= F.col("_w") * (F.col("_budget") - F.col("_cap_before")))
        .withColumn("_caps", F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), zero))
        .withColumn("_rest_w", F.col("_all_w") - F.coalesce(
            F.sum(F.when(F.col("_full"), F.col("_w"))).over(everything), zero))
    )
    shared = F.col("_w") * (F.col("_budget") - F.col("_caps")) / F.col("_rest_w")
    return filled.select("source", "source_size",
                         F.when(F.col("_full"), F.col("_cap")).otherwise(shared).alias("target"))


def thresholds(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size, hash): source_size, target, ``whole`` copies
    for all its rows, and ``cut``: rows with a smaller hash get one more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.withColumn("whole", whole.cast("bigint")).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("_words"))
    for level in range(LEVELS):
        state = kept(state, "mix-state")
        width = 1 << (HASH_BITS - BITS * (level + 1))
        bucket = (F.col("hash") - F.col("hash") % width).alias("_bucket")
        rows = sized
        if level:
            edge = state.select(F.col("source").alias("_s"), F.col("cut").alias("_cut"))
            rows = sized.join(
                edge, sized["source"].eqNullSafe(edge["_s"])
                & (sized["hash"] - sized["hash"] % (width << BITS) == edge["_cut"]), "left_semi")
        histogram = rows.groupBy("source", bucket).agg(F.sum("size").alias("_n"))
        running = Window.partitionBy("source").orderBy("_bucket")
        # the first bucket whose running sum passes the rest: the boundary
        passing = (
            histogram.withColumnRenamed("source", "_s")
            .join(state.select("source", "rest"), F.col("_s").eqNullSafe(F.col("source")))
            .withColumn("_sum", F.sum("_n").over(running))
            .filter(F.col("_sum") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("_bucket", "_n", (F.col("_sum") - F.col("_n")).alias("_before")),
                          F.col("_bucket")).alias("_edge"))
            .select(F.col("source").alias("_s"), "_edge")
        )
        state = state.join(passing, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "whole",
            (F.col("rest") - F.coalesce(F.col("_edge._before"), F.lit(0))).alias("rest"),
            F.coalesce(F.col("_edge._bucket"), F.col("cut")).alias("cut"),
            F.coalesce(F.col("_edge._n"), F.lit(0)).alias("_words"))
    # what is left of the rest is less than the last bucket: take that if this comes nearer
    last = F.when(F.col("_words") - F.col("rest") < F.col("rest"), width).otherwise(0)
    return kept(state.select("source", "source_size", "target", "whole", (F.col("cut") + last).alias("cut")),
                "mix-thresholds")


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
                source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of all its columns), doc_id, size, source_size, target,
    copies and taken (copies times size)."""
    prepare(docs.sparkSession)
    cols = (F.col(source).alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(doc_id)).alias("hash"))
    sized = kept(docs.select(*cols), "mix-sizes")
    cuts = thresholds(sized, weights, share, most).withColumnRenamed("source", "_s")
    rows = docs.select(F.struct("*").alias("row"), *cols)
    # a source at a whole number of copies has no rest: rows of size 0 get no further copy either
    more = (F.col("hash") < F.col("cut")) & (F.col("target") > F.col("whole") * F.col("source_size"))
    copies = F.col("whole") + more.cast("bigint")
    return rows.join(cuts, rows["source"].eqNullSafe(cuts["_s"])).select(
        "row", F.col(f"row.{doc_id}").alias("doc_id"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it."""
    mixed = with_copies(docs, **settings).filter("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
