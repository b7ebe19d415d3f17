"""Writes. Tables are published by Spark's commit protocol; a table is never written over itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators import history as H
from dugout.operators.groups import settled
from dugout.plans.stages import Stages, kg2_and_kg3, kg4, published
from dugout.plans.stages import rated as with_rates
from dugout.session import cut_lineage, drop_path
from dugout.sources import readers, versions

KEYED_ORDER = ["pitcher", "game_date", "game_pk", "at_bat_number_of_game", "pitch_number_of_ab"]


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace a whole table."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Range-sorted CSV: parts in order, each sorted."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_stages(stages: Stages, root: str, buckets: int | None = None) -> None:
    """One Parquet dataset per stage, each computed from the one before and not from the raw log
    again. Rows are range-partitioned by pitcher and order, so a pitcher with very many rows spans
    several files and readers still prune by pitcher statistics."""
    draft = f"{root}/_rated"
    rated = stages.rated if stages.rated is not None else with_rates(cut_lineage(stages.kg2))
    rated.write.mode("overwrite").parquet(draft)
    # kept in columns: placing a stage looks at its keys alone first, and reads no column it lacks
    two, three = kg2_and_kg3(rated.sparkSession.read.schema(rated.schema).parquet(draft))
    args = ([buckets] if buckets else []) + KEYED_ORDER
    for name, stage in (("kg2", two), ("kg3", three), ("kg4", kg4(three))):
        placed = published(stage).repartitionByRange(*args).sortWithinPartitions(*KEYED_ORDER)
        placed.write.mode("overwrite").parquet(f"{root}/{name}")
    drop_path(rated.sparkSession, draft)


def write_prediction_logs(logs: DataFrame, path: str) -> None:
    """Replace the dates in the batch, leave other dates alone. Rows are gathered by date so a date
    has few files; the rebalance splits a date that is too large for one."""
    (
        logs.hint("rebalance", F.col("game_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("game_date")
        .parquet(path)
    )


def store_history(batch: DataFrame, path: str) -> int:
    """Record a batch of evaluations in the history at ``path``, which is stored by month in numbered
    versions (``versions``). Returns the new version.

    Only the months that the batch, or a stored row it replaces, belongs to are read whole and
    rewritten. A row that moves to another month leaves the old one; a month that loses all its rows is
    gone. Of two writers at once the later one starts again from the earlier one's version.
    """
    spark = batch.sparkSession
    month = F.substring("game_date", 1, 7)
    batch = cut_lineage(H.normalize_history(batch))
    keys = settled(batch.select(*H.HISTORY_KEY).distinct())

    def change(stored):
        replaced = stored().select("game_date", *H.HISTORY_KEY).join(keys, H.HISTORY_KEY, "left_semi")
        # a list of months is as long as the calendar at most
        touched = batch.select("game_date").union(replaced.select("game_date")).select(month).distinct()
        months = [r[0] for r in touched.collect()]
        return months, H.record(stored(months), batch)

    return versions.update(spark, path, readers.HISTORY_DDL, month, change)


def write_failures(rows: DataFrame, path: str) -> None:
    """Failures beside results, as a table of their own."""
    rows.filter(F.col("error").isNotNull()).write.mode("overwrite").option("header", True).csv(path)
