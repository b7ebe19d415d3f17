"""One day's replay as one flow: from the schedule to logs, statuses, summary and history.

The prediction log of the day's finished games is written once; statuses, summary and history rows are
derived from what was written. All of it stands in a folder of the run. The history takes its rows as an
upsert by game and pitcher, and the day's manifest, created last, names the folder. So a run that breaks
off anywhere is simply run again: what it left is not named, and the history replaces its rows by the
same ones. A day with a manifest is not replayed unless forced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators import report
from dugout.operators import weights as W
from dugout.operators.groups import settled
from dugout.plans import backtest as R
from dugout import session
from dugout.session import cut_lineage
from dugout.sources import readers, sinks, storage

PARTS = ("predictions", "statuses", "summary")
STARTER = ("game_pk", "official_date", "pitcher_id", "pitcher_name", "opponent_name", "side", "game_status")


@dataclass(frozen=True)
class Day:
    """What is stored of a day."""

    date: str
    folder: str
    history_version: int
    predictions: DataFrame
    statuses: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Days:
    """What many dates of one schedule and log take from them: the starters, and the rows of the games they
    started (``_official``: the date), each in order of date within a file, so that a date reads its own."""

    starters: DataFrame
    rows: DataFrame


def prepared(schedule: DataFrame, log: DataFrame, names: R.Log = R.PITCHES) -> Days:
    """Read the schedule once, and find the rows of all its finished games in one pass over the log."""
    kept = lambda df, name: session.stored(df.sortWithinPartitions("_official"), session.scratch_path(log.sparkSession, name))
    starters = kept(readers.starters(schedule).select(*STARTER, F.col("official_date").alias("_official")), "day-starters")
    games = starters.filter(S.is_final("game_status")).select(
        F.col("pitcher_id").alias(names.key), S.to_number("game_pk", "bigint").alias(names.game), "_official").distinct()
    return Days(starters, kept(log.join(games, [names.key, names.game]).select(*log.columns, "_official"), "day-rows"))


def stored(spark: SparkSession, root: str, date: str) -> Day | None:
    """The day as its latest manifest names it."""
    known = storage.names(spark, f"{root}/days/{date}")
    found = [n for n in known if n.endswith(".json") and not n.startswith(".")]
    if not found:
        return None
    about = json.loads(storage.read(spark, f"{root}/days/{date}/{found[-1]}"))
    parts = [spark.read.parquet(f"{root}/{about['folder']}/{p}") for p in PARTS]
    return Day(date, about["folder"], about["history_version"], *parts)


def _errors(targets: DataFrame, log: DataFrame, names: R.Log, min_games: int) -> DataFrame:
    """(game_pk, pitcher_id, error) of the targets with too little history."""
    day = targets.select(F.col(names.key).alias("_k"), F.col("target_date").alias("_d")).distinct()
    games = log.select(F.col(names.key).alias("_of"), F.col(names.date).alias("_on"), F.col(names.game).alias("_g"))
    past = games.join(settled(day), F.col("_of") == F.col("_k")).filter(F.col("_on") < F.col("_d"))
    past = past.groupBy("_k").agg(F.countDistinct("_g").alias("_n"))
    error = F.when(F.col("_n").isNull(), S.NO_HISTORY).when(F.col("_n") < min_games, S.FEW_GAMES)
    told = targets.join(past, F.col(names.key) == F.col("_k"), "left")
    return told.select(F.col(names.game).alias("game_pk"), F.col(names.key).alias("pitcher_id"), error.alias("error")).filter(F.col("error").isNotNull())


def replay(
    schedule: DataFrame,
    log: DataFrame,
    date: str,
    root: str,
    names: R.Log = R.PITCHES,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
    rules: W.Rules | None = W.CONTINUOUS,
    min_games: int = 2,
    force: bool = False,
    evaluated_at: Column | None = None,
    seed: int = 42,
    days: Days | None = None,
) -> Day:
    """Replay the starters of ``date`` and store what came of it under ``root``.

    ``fit``: as ``backtest.replay_days`` takes it; without it the weighted majority is the model. ``days``:
    what ``prepared`` made of the same schedule and log, for callers that replay many dates.
    """
    spark = log.sparkSession
    before = stored(spark, root, date)
    if before is not None and not force:
        return before
    everyone = readers.starters(schedule).filter(F.col("official_date") == date) if days is None else days.starters.filter(F.col("_official") == date)
    starters = cut_lineage(everyone.select(*STARTER))
    played = log if days is None else days.rows.filter(F.col("_official") == date).drop("_official")
    finals = starters.filter(S.is_final("game_status")).select(
        F.col("pitcher_id").alias(names.key), F.col("game_pk").alias(names.game), F.lit(date).cast("date").alias("target_date")).distinct()
    errors = cut_lineage(_errors(finals, log, names, min_games))
    ready = cut_lineage(finals.join(errors.select(F.col("game_pk").alias(names.game), F.col("pitcher_id").alias(names.key)), [names.game, names.key], "left_anti"))
    predicted = fit(R.before(log, ready, names))(R.target_rows(played, ready, names)) if fit else None
    folder = f"runs/{date}-{uuid.uuid4().hex}"
    at = lambda part: f"{root}/{folder}/{part}"
    R.replay_day(log, ready, names, predicted, rules, seed, played).write.parquet(at("predictions"))
    logs = spark.read.parquet(at("predictions"))
    results = cut_lineage(R.game_results(logs, [names.key, names.game, names.date]))
    by_game = results.select(F.col(names.game).alias("game_pk"), F.col(names.key).alias("pitcher_id"),
                             *[c for c in results.columns if c not in (names.game, names.key, names.date)])
    R.day_rows(starters, by_game, errors).write.parquet(at("statuses"))
    report.day_status(spark.read.parquet(at("statuses"))).withColumn("game_date", F.lit(date)).write.parquet(at("summary"))
    named = starters.select(F.col("game_pk").alias(names.game), F.col("pitcher_id").alias(names.key), "pitcher_name", F.col("opponent_name").alias("opponent"))
    rows = results.join(named.dropDuplicates([names.game, names.key]), [names.game, names.key], "left")
    rows = rows.withColumn("predictions_path", F.lit(at("predictions")))
    version = sinks.store_history(R.history_rows(rows, names, evaluated_at), f"{root}/history")
    number = len(storage.names(spark, f"{root}/days/{date}")) + 1
    about = json.dumps({"folder": folder, "history_version": version})
    storage.create(spark, f"{root}/days/{date}/{number:06d}.json", about)  # another run may have been first: its day stands
    return stored(spark, root, date)
