"""Scans. Every one has a declared schema, so a scan costs no inference pass and types do not
depend on which file is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dugout import columns as C
from dugout import schema
from dugout.functions import scalar as S
from dugout.operators import evaluation as E
from dugout.sources import versions

# fixed values: texts that count as missing in the exports
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A"]

TEAM = "team struct<id: bigint, name: string, abbreviation: string>"
SIDE = f"struct<{TEAM}, score: int, probablePitcher: struct<id: bigint, fullName: string>>"
SCHEDULE_DDL = (
    "dates array<struct<games: array<struct<gamePk: bigint, officialDate: string, gameDate: string, "
    f"status: struct<detailedState: string>, teams: struct<away: {SIDE}, home: {SIDE}>>>>>"
)


class ExportError(RuntimeError):
    """A landed file is not a pitch export."""


def read_csv(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """CSV with a declared schema and header; missing markers become NULL in every column."""
    want = StructType.fromDDL(ddl)
    text = StructType([StructField(f.name, StringType()) for f in want.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    return _typed(raw, want)


def _typed(raw: DataFrame, want: StructType, *kept: str) -> DataFrame:
    def cell(field) -> F.Column:
        value = F.when(~F.col(f"`{field.name}`").isin(MISSING), F.col(f"`{field.name}`"))
        kind = field.dataType.simpleString()
        if kind == "string":
            return value.alias(field.name)
        if kind in ("int", "bigint"):
            return S.must_be_number(value, kind).alias(field.name)
        if kind == "double":
            return S.must_be_number(value).alias(field.name)
        return value.cast(field.dataType).alias(field.name)

    return raw.select(*[cell(f) for f in want.fields], *kept)


def read_pitch_log(spark: SparkSession, path: str | list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """Pitch-log CSVs in canonical column order."""
    ddl = C.raw_ddl() + "".join(f", `{c}` {t}" for c, t in (extra or {}).items())
    return read_csv(spark, path, ddl)


def check_landing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per landed file that is no export: empty, or an HTML page saved under a CSV name.

    Only the start of each file decides; the scan reads lines, keeps the smallest offset per file.
    """
    text = spark.read.text(path)
    lines = text.select(
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("at"),
        F.lower(F.ltrim(F.regexp_replace("value", "^\ufeff", ""))).alias("line"),
    )
    first = lines.filter(F.length("line") > 0).groupBy("file").agg(F.min_by("line", "at").alias("first"))
    # scans skip files of length zero, the file listing does not
    files = spark.createDataFrame([(f,) for f in text.inputFiles()], "file string")
    key = F.regexp_replace("file", "^file:/+", "/")
    return (
        files.withColumn("file", key)
        .join(first.withColumn("file", key), "file", "left")
        .select(
            "file",
            F.when(F.col("first").isNull(), "empty response")
            .when(F.col("first").startswith("<!doctype html"), "HTML instead of a CSV export")
            .alias("error"),
        )
        .filter(F.col("error").isNotNull())
    )


SHOWN = 20  # files named in an error; the rest are counted


def read_landing(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Freshly landed exports: header cleaned of byte-order mark, blanks and quotes, bad files
    refused. ``ingest_seq`` orders rows by arrival (file time, file, place in the file), so later
    corrections can win; it does not depend on how files are spread over tasks."""
    refused = check_landing(spark, path)
    bad = refused.limit(SHOWN).collect()
    if bad:
        more = refused.count() - len(bad) if len(bad) == SHOWN else 0
        raise ExportError("; ".join(f"{r.file}: {r.error}" for r in bad) + (f"; and {more} more" if more else ""))
    # one schema for all files: a file with another header fails instead of shifting columns
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    arrival = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    names = [c.lstrip("\ufeff").strip().strip('"') for c in raw.columns]
    raw = raw.select("*", arrival.alias("ingest_seq")).toDF(*names, "ingest_seq")
    if columns is not None:
        schema.canonical(raw.drop("ingest_seq"), columns, "landed export")
        names = list(columns)
    types = {c: t for t, cs in C.RAW_TYPES.items() for c in cs}
    want = StructType.fromDDL(", ".join(f"`{c}` {types.get(c, 'string')}" for c in names))
    return _typed(raw, want, "ingest_seq")


# --- schedules --------------------------------------------------------------------------------
def read_schedule(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SCHEDULE_DDL).option("multiLine", True).json(path)


def schedule_games(schedule: DataFrame) -> DataFrame:
    days = schedule.select(F.explode("dates").alias("day"))
    return days.select(F.explode("day.games").alias("game")).select("game.*")


def appearances(schedule: DataFrame) -> DataFrame:
    """One row per team and game, away and home, with the probable pitcher if one is named."""
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.col(f"teams.{side}.team").alias("team"),
                F.col(f"teams.{other}.team").alias("opponent"),
                F.col(f"teams.{side}.probablePitcher").alias("pitcher"),
            )
            for side, other in (("away", "home"), ("home", "away"))
        ]
    )
    rows = schedule_games(schedule).select(
        F.col("gamePk").alias("game_pk"),
        F.col("officialDate").alias("official_date"),
        F.col("gameDate").alias("game_time_utc"),
        F.col("status.detailedState").alias("game_status"),
        F.explode(sides).alias("s"),
    )
    return rows.select(
        "game_pk", "official_date", "game_time_utc", "game_status",
        F.col("s.side").alias("side"),
        F.col("s.team.id").alias("team_id"), F.col("s.team.name").alias("team_name"),
        F.col("s.opponent.id").alias("opponent_id"), F.col("s.opponent.name").alias("opponent_name"),
        F.col("s.pitcher.id").alias("pitcher_id"), F.col("s.pitcher.fullName").alias("pitcher_name"),
    )


def starters(schedule: DataFrame) -> DataFrame:
    return appearances(schedule).filter(F.col("pitcher_id").isNotNull())


def missing_probables(schedule: DataFrame) -> DataFrame:
    rows = appearances(schedule).filter(F.col("pitcher_id").isNull())
    return rows.select("game_pk", "official_date", "side", "team_id", "team_name")


def scoreboard(schedule: DataFrame) -> DataFrame:
    return schedule_games(schedule).select(
        F.col("gamePk").alias("game_pk"),
        F.coalesce("teams.away.team.abbreviation", F.lit("AWY")).alias("away"),
        F.coalesce("teams.home.team.abbreviation", F.lit("HOM")).alias("home"),
        F.col("teams.away.score").alias("away_score"),
        F.col("teams.home.score").alias("home_score"),
        F.col("status.detailedState").alias("status"),
    )


# --- history, logs, summaries -----------------------------------------------------------------
def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


HISTORY_DDL = ", ".join(f"{c} {t}" for c, t in C.HISTORY_TYPES.items())


def read_history(spark: SparkSession, path: str, kind: str = "parquet", version: int | None = None) -> DataFrame:
    """The evaluation history with its full set of columns; an absent one is empty. One stored in
    versions (``sinks.store_history``) is read at the latest, or at a given one."""
    ddl = HISTORY_DDL
    if versions.numbers(spark, path):
        return versions.read(spark, path, ddl, version)
    if not _exists(spark, path):
        return spark.createDataFrame([], ddl)
    if kind == "parquet":
        return schema.with_columns_of(spark.read.option("mergeSchema", True).parquet(path), C.HISTORY_TYPES)
    table = spark.read.option("header", True).csv(path)
    table = schema.with_columns_of(schema.clean_names(table), {c: "string" for c in C.HISTORY_TYPES})
    return _typed(table, StructType.fromDDL(ddl))


def read_prediction_logs(spark: SparkSession, path: str, game_dates: list[str] | None = None) -> DataFrame:
    """The dated prediction-log dataset; a date list prunes partitions."""
    logs = spark.read.parquet(path)
    if game_dates is None:
        return logs
    return logs.filter(F.col("game_date").isin([d for d in game_dates]))


def logs_of(history: DataFrame, logs: DataFrame) -> DataFrame:
    """Pitch logs of the games in a history; games whose log is gone drop out."""
    games = history.select("game_pk", F.col("pitcher_id").alias("pitcher")).distinct()
    return logs.join(games, ["game_pk", "pitcher"], "left_semi")


def read_game_summaries(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Per-game JSON summaries with the baseline distribution as a map: one indented record per
    file, or one record per line as Spark writes them."""
    ddl = """game_pk bigint, game_date string, pitcher_id bigint, pitcher_name string,
        pitch_count bigint, model_accuracy double, baseline_accuracy double,
        accuracy_over_baseline double, accuracy_over_baseline_pp double,
        relative_improvement double, relative_improvement_percent double,
        model_accuracy_percent double, baseline_accuracy_percent double, baseline_strategy string,
        model_path string, predictions_path string, summary_path string, generated_at_utc string,
        important_note string, baseline_distribution map<string, double>"""
    return spark.read.schema(ddl).option("multiLine", multiline).json(path)


def read_daily_summaries(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Daily JSON summaries, flattened."""
    ddl = """game_date string, season bigint, generated_at_utc string, baseline_strategy string,
        model_version string, feature_version string, evaluation_version string,
        starter_records bigint,
        statuses struct<successful: bigint, statcast_not_ready: bigint, failed: bigint,
            game_not_final: bigint>,
        aggregate_performance struct<total_pitches: bigint, model_correct: bigint,
            baseline_correct: bigint, model_accuracy: double, baseline_accuracy: double,
            accuracy_over_baseline: double, accuracy_over_baseline_pp: double,
            relative_improvement: double, relative_improvement_percent: double>"""
    table = spark.read.schema(ddl).option("multiLine", multiline).json(path)
    return table.select(
        *[c for c in table.columns if c not in ("statuses", "aggregate_performance")],
        "statuses.*", "aggregate_performance.*",
    )


def read_arsenal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """League arsenal table: pitches per player and pitch type. Other columns are pruned."""
    raw = schema.clean_names(spark.read.option("header", True).csv(path))
    schema.require(raw, ["pitch_type", "pitch_name", "pitches"], "league arsenal")
    return raw.select("pitch_type", "pitch_name", S.must_be_number("pitches", "bigint").alias("pitches"))


def null_report(df: DataFrame) -> DataFrame:
    return E.null_counts(df)
