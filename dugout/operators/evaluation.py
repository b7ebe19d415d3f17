"""Scores of predictions. Everything is derived from counts that aggregate before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import scalar as S


def accuracy(df: DataFrame, keys: list[str], predicted: str, actual: str, out: str = "accuracy") -> DataFrame:
    hit = F.coalesce(F.col(predicted) == F.col(actual), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct"), F.avg(hit.cast("double")).alias(out)
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_wide(df: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    """Matrix form: one row per actual class, one column per listed predicted class."""
    cells = confusion(df, actual, predicted)
    return (
        cells.groupBy("actual").pivot("predicted", classes).agg(F.sum("n"))
        .fillna(0, subset=classes)
    )


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with the overall rows. Undefined ratios are 0."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                         F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("x")
    ).select("x.*").filter(F.col("label").isNotNull())
    per_class = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per_class = per_class.withColumns(
        {"precision": safe(F.col("hits"), F.col("called")), "recall": safe(F.col("hits"), F.col("support"))}
    ).withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ["precision", "recall", "f1"]
    overall = per_class.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in scores],
        *[safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in scores],
        safe(F.sum("hits"), F.sum("support")).alias("acc"),
        F.sum("support").alias("support"),
    )
    summary = overall.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("label"), *[v.alias(c) for c, v in zip(scores, values)], F.col("support"))
                    for name, values in (
                        ("accuracy", [F.col("acc")] * 3),
                        ("macro avg", [F.col(f"macro_{c}") for c in scores]),
                        ("weighted avg", [F.col(f"weighted_{c}") for c in scores]),
                    )
                ]
            )
        ).alias("x")
    ).select("x.*")
    return per_class.select("label", *scores, "support").unionByName(summary)


def lift(df: DataFrame, model: str = "model_accuracy", baseline: str = "baseline_accuracy") -> DataFrame:
    """Absolute and relative gain over the baseline."""
    gain = F.col(model) - F.col(baseline)
    relative = S.relative_improvement(model, baseline)
    return df.withColumns(
        {
            "accuracy_over_baseline": gain,
            "accuracy_over_baseline_pp": gain * 100,
            "relative_improvement": relative,
            "relative_improvement_percent": relative * 100,
        }
    )


def breadth(df: DataFrame, keys: list[str], predicted: str, correct: str, times: int = 3) -> DataFrame:
    """How many classes were called correctly at least ``times`` times, per key. Keys without any
    such class have 0."""
    hits = df.groupBy(*keys, predicted).agg(F.count_if(S.is_true(correct)).alias("hits"))
    return hits.groupBy(*keys).agg(F.count_if(F.col("hits") >= times).alias("breadth"))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows with NULL per column, all in one pass; one output row per column."""
    n = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return n.select(F.explode(pairs).alias("x")).select("x.*")
