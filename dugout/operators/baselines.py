"""Reference predictors that know class frequencies only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators import sequence as Q
from dugout.operators.groups import settled
from dugout.operators.usage import class_counts


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent class per key; of equals the smallest."""
    counts = class_counts(df, keys, label)
    return Q.keep_first(counts, keys, [-F.col("n"), F.col(label)])


def weighted_majority(df: DataFrame, keys: list[str], label: str, weight: str, digits: int = 12) -> DataFrame:
    """Class with the largest total weight per key; of equals the smallest. Rows of one weight are
    counted and their products added as decimals, so totals are the same in any order of rows and
    classes with the same weights are equal however many rows they have."""
    counts = df.groupBy(*keys, label, weight).agg(F.count(F.lit(1)).alias("_rows"))
    exact = F.sum((F.col("_rows") * F.col(weight)).cast("decimal(38, 15)")).cast("double")
    totals = counts.groupBy(*keys, label).agg(F.round(exact, digits).alias("total_weight"))
    return Q.keep_first(totals, keys, [-F.col("total_weight"), F.col(label)])


def class_ranges(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Class frequencies as integer ranges [lo, hi) of a line of length ``total``."""
    counts = class_counts(df, keys, label)
    upto = Window.partitionBy(*keys).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *keys, label,
        (F.sum("n").over(upto) - F.col("n")).alias("lo"),
        F.sum("n").over(upto).alias("hi"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
        (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("prior"),
    )


def stratified(
    rows: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    label: str,
    row_id: list[str],
    seed: int = 42,
    out: str = "baseline_prediction",
) -> DataFrame:
    """Random class per row in proportion to the training frequencies.

    The draw is a hash of the row id modulo the training size, repeatable whatever the partitioning. A
    key's ranges travel as one row, an array of upper ends in which the draw is looked up, so the join
    does not multiply rows. Keys without training rows get NULL.
    """
    ends = F.sort_array(F.collect_list(F.struct(F.col("hi").alias("hi"), F.col(label).alias("label"))))
    table = ranges.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(ends.alias("_ends"), F.max("total").alias("_total"))
    on = [F.col(k) == F.col(f"_of_{k}") for k in keys]
    spot = F.pmod(S.hash_int(seed, *row_id), F.col("_total"))
    drawn = rows.join(settled(table), on, "left")
    below = S.once(spot, lambda x: F.size(F.filter("_ends", lambda e: e["hi"] <= x)))
    call = F.when(F.col("_total") > 0, F.element_at("_ends", below + 1)["label"])
    return drawn.withColumn(out, call).drop("_ends", "_total", *[f"_of_{k}" for k in keys])


def expected_stratified_accuracy(
    parts: DataFrame, keys: list[str], label: str, is_test: str = "is_test"
) -> DataFrame:
    """What the stratified baseline scores on average: sum over classes of p_train * p_test, from one
    pass over train and test rows."""
    counts = parts.groupBy(*keys, label).agg(
        F.count_if(~F.col(is_test)).cast("double").alias("_a"), F.count_if(is_test).cast("double").alias("_b")
    )
    return counts.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sum("_a") * F.sum("_b")), F.lit(0.0))
        .alias("expected_accuracy")
    )
