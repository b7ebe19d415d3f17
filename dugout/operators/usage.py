"""How often each class occurs per key, per season, now and before.

Everything starts from one pre-aggregated count table; windows run on that table, whose rows per
key are seasons x classes, never on the log itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, keys: list[str], label: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias(out))


def usage_share(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Count and share of each class within the key."""
    counts = class_counts(df, keys, label)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def ranked_usage(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``usage_share`` with each class's place in the key's list, the most used first; of equals the
    first in vocabulary order."""
    by = Window.partitionBy(*keys).orderBy(F.col("n").desc(), label)
    return usage_share(df, keys, label).withColumn("place", F.row_number().over(by))


def season_usage(df: DataFrame, key: str, season: str, label: str) -> DataFrame:
    """Count, season total and usage rate per season and class."""
    counts = class_counts(df, [key, season], label, "pitch_count")
    total = F.sum("pitch_count").over(Window.partitionBy(key, season))
    return counts.withColumn("season_total", total).withColumn(
        "usage_rate", F.col("pitch_count") / F.col("season_total")
    )


def reliable_prior_seasons(
    df: DataFrame, key: str, season: str, min_rows: int = 300, keep: int = 2
) -> DataFrame:
    """The latest ``keep`` seasons before the key's last one that have enough rows."""
    totals = df.filter(F.col(season).isNotNull()).groupBy(key, season).agg(F.count(F.lit(1)).alias("n"))
    last = F.max(season).over(Window.partitionBy(key))
    older = totals.withColumn("latest_season", last).filter(
        (F.col(season) < F.col("latest_season")) & (F.col("n") >= min_rows)
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(season).desc()))
    return older.withColumn("recency_rank", rank).filter(F.col("recency_rank") <= keep)


def peak_usage(df: DataFrame, key: str, season: str, label: str, min_rows: int = 300) -> DataFrame:
    """Highest usage of each class over the reliable seasons before the key's last one."""
    usage = season_usage(df, key, season, label).withColumn(
        "_last", F.max(season).over(Window.partitionBy(key))
    )
    older = usage.filter((F.col(season) < F.col("_last")) & (F.col("season_total") >= min_rows))
    return older.groupBy(key, label).agg(F.max("usage_rate").alias("peak_older_usage"))


def repertoire_context(
    df: DataFrame,
    key: str,
    season: str,
    label: str,
    min_recent: int = 300,
    min_older: int = 300,
    prior_seasons: int = 2,
) -> DataFrame:
    """One row per key and class: usage in the last season, in the last reliable ones before it
    (pooled), and the peak over all reliable older seasons; with what is needed to tell whether the
    comparison may be made (``usable``)."""
    usage = season_usage(df.filter(F.col(season).isNotNull()), key, season, label)
    per_key = Window.partitionBy(key)
    usage = usage.withColumn("latest_season", F.max(season).over(per_key))
    usage = usage.withColumn(
        "_reliable", (F.col(season) < F.col("latest_season")) & (F.col("season_total") >= min_older)
    )
    recency = F.dense_rank().over(Window.partitionBy(key, "_reliable").orderBy(F.col(season).desc()))
    usage = usage.withColumn("_prior", F.col("_reliable") & (recency <= prior_seasons))
    current = F.col(season) == F.col("latest_season")
    usage = usage.withColumns(
        {
            "_latest_total": F.max(F.when(current, F.col("season_total"))).over(per_key),
            "_prior_total": F.sum(F.when(F.col("_prior"), F.col("pitch_count"))).over(per_key),
            "_first_season": F.min(season).over(per_key),
        }
    )
    per_class = usage.groupBy(key, label, "latest_season", "_latest_total", "_prior_total", "_first_season").agg(
        F.sum(F.when(current, F.col("pitch_count")).otherwise(0)).alias("_recent_n"),
        F.sum(F.when(F.col("_prior"), F.col("pitch_count")).otherwise(0)).alias("_prior_n"),
        F.coalesce(F.max(F.when(F.col("_reliable"), F.col("usage_rate"))), F.lit(0.0)).alias("peak_older_usage"),
    )
    return per_class.select(
        key,
        label,
        "latest_season",
        (F.col("_recent_n") / F.col("_latest_total")).alias("recent_usage"),
        F.coalesce(F.col("_prior_n") / F.col("_prior_total"), F.lit(0.0)).alias("prior_usage"),
        "peak_older_usage",
        (F.col("_first_season") < F.col("latest_season")).alias("several_seasons"),
        (F.col("_latest_total") >= min_recent).alias("enough_recent"),
        F.col("_prior_total").isNotNull().alias("enough_older"),
        (
            (F.col("_first_season") < F.col("latest_season"))
            & (F.col("_latest_total") >= min_recent)
            & F.col("_prior_total").isNotNull()
        ).alias("usable"),
    )


def weighted_share(df: DataFrame, keys: list[str], weight: str, out: str = "usage_percent") -> DataFrame:
    """Percentage of the overall weight (pitches) held by each group."""
    totals = df.groupBy(*keys).agg(F.sum(weight).alias(weight))
    whole = df.agg(F.sum(weight)).scalar()
    return totals.withColumn(out, F.try_divide(F.col(weight) * 100.0, whole))
