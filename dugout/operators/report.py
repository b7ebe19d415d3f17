"""Summaries of evaluated games: daily, windowed, seasonal, and of weight experiments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators import evaluation as E
from dugout.operators.groups import settled
from dugout.session import cut_lineage


def evaluated_games(history: DataFrame) -> DataFrame:
    """Rows with a usable date and counts; everything else is not an evaluation."""
    counts = ["pitch_count", "model_correct", "baseline_correct"]
    return history.withColumns(
        {"game_date": S.to_day("game_date"), **{c: S.to_number(c, "bigint") for c in counts}}
    ).dropna(subset=["game_date", *counts])


def last_dates(df: DataFrame, n: int, date: str = "game_date") -> DataFrame:
    """All rows of the latest ``n`` distinct dates. The date list is cut to n rows before it meets
    the table, so the table is filtered by a semi-join and not sorted."""
    latest = df.select(date).filter(F.col(date).isNotNull()).distinct().orderBy(F.col(date).desc()).limit(n)
    return df.join(latest, date, "left_semi")


def daily_frame(df: DataFrame) -> DataFrame:
    """One pitch-weighted row per game date."""
    daily = df.groupBy("game_date").agg(
        F.count(F.lit(1)).alias("pitcher_games"),
        F.countDistinct("pitcher_id").alias("pitchers"),
        F.sum("pitch_count").alias("pitches"),
        F.sum("model_correct").alias("model_correct"),
        F.sum("baseline_correct").alias("baseline_correct"),
    )
    daily = daily.withColumns(
        {
            "model_accuracy": S.ratio("model_correct", "pitches"),
            "baseline_accuracy": S.ratio("baseline_correct", "pitches"),
        }
    )
    return daily.withColumn(
        "relative_improvement", S.relative_improvement("model_accuracy", "baseline_accuracy")
    )


def pooled_totals(df: DataFrame) -> DataFrame:
    """Pitch-weighted totals over the whole window, one row."""
    totals = df.agg(
        F.countDistinct("game_pk").alias("games"),
        F.count(F.lit(1)).alias("pitcher_games"),
        F.countDistinct("pitcher_id").alias("pitchers"),
        F.sum("pitch_count").alias("pitches"),
        F.sum("model_correct").alias("_m"),
        F.sum("baseline_correct").alias("_b"),
        F.count_if(F.col("model_correct") > F.col("baseline_correct")).alias("beat_baseline"),
    )
    totals = totals.withColumns(
        {"model_accuracy": S.ratio("_m", "pitches"), "baseline_accuracy": S.ratio("_b", "pitches")}
    )
    return totals.withColumn(
        "relative_improvement", S.relative_improvement("model_accuracy", "baseline_accuracy")
    ).drop("_m", "_b")


@dataclass(frozen=True)
class Window:
    """The report of the latest dates."""

    daily: DataFrame
    totals: DataFrame
    extremes: DataFrame
    showcase: DataFrame | None


def window_report(
    history: DataFrame, dates: int, logs: DataFrame | None = None, keys: list[str] = ("game_pk", "pitcher_id"), **showcase_rules
) -> Window:
    """Daily figures, pooled totals, extremes and the showcase outing of the latest ``dates`` dates.

    Days and totals are grouping sets of one aggregation: the window is read once, and distinct games
    and pitchers are counted for both from the same expanded rows. What follows reads that small result.
    """
    window = last_dates(evaluated_games(history), dates)
    both = window.groupingSets([["game_date"], []], "game_date").agg(
        F.grouping("game_date").alias("_all"),
        F.countDistinct("game_pk").alias("games"),
        F.count(F.lit(1)).alias("pitcher_games"),
        F.countDistinct("pitcher_id").alias("pitchers"),
        F.sum("pitch_count").alias("pitches"),
        F.sum("model_correct").alias("model_correct"),
        F.sum("baseline_correct").alias("baseline_correct"),
        F.count_if(F.col("model_correct") > F.col("baseline_correct")).alias("beat_baseline"),
    )
    both = both.withColumns({
        "model_accuracy": S.ratio("model_correct", "pitches"), "baseline_accuracy": S.ratio("baseline_correct", "pitches")})
    both = cut_lineage(both.withColumn("relative_improvement", S.relative_improvement("model_accuracy", "baseline_accuracy")))
    daily = both.filter("_all = 0").drop("_all", "games", "beat_baseline")
    totals = both.filter("_all = 1").drop("_all", "game_date", "model_correct", "baseline_correct")
    best = showcase(window.withColumn("model_accuracy", S.ratio("model_correct", "pitch_count")), logs, list(keys), **showcase_rules) if logs is not None else None
    return Window(daily, totals, daily_extremes(daily), best)


def daily_extremes(daily: DataFrame) -> DataFrame:
    """Lowest and highest relative improvement of a day, and the day of the highest."""
    at = F.struct("relative_improvement", F.col("game_date"))
    return daily.agg(
        F.min("relative_improvement").alias("lowest"),
        F.max("relative_improvement").alias("highest"),
        F.max_by("game_date", F.when(F.col("relative_improvement").isNotNull(), at)).alias("peak_day"),
    )


def showcase(
    games: DataFrame,
    logs: DataFrame,
    keys: list[str],
    min_pitches: int = 80,
    min_classes: int = 3,
    times: int = 3,
) -> DataFrame:
    """The most accurate long outing among those where several classes were called right.

    Breadth is aggregated for all candidates at once; games without a log drop out in the join.
    """
    candidates = games.filter(F.col("pitch_count") >= min_pitches)
    wide = E.breadth(
        logs.join(candidates.select(*keys), keys, "left_semi"), keys, "model_prediction", "model_correct", times
    )
    return (
        candidates.join(wide.filter(F.col("breadth") >= min_classes), keys)
        .orderBy(F.col("model_accuracy").desc(), *keys)
        .limit(1)
    )


def day_status(day: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts per outcome and pooled accuracy of the successful games; NULL if there were none."""
    ok = F.col("replay_status") == "success"
    counts = day.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("starter_records"),
        *[
            F.count_if(F.col("replay_status") == s).alias(n)
            for s, n in (
                ("success", "successful"), ("statcast_not_ready", "statcast_not_ready"),
                ("failed", "failed"), ("game_not_final", "game_not_final"),
            )
        ],
        *[
            F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint").alias(o)
            for c, o in (
                ("pitch_count", "total_pitches"), ("model_correct", "model_correct"),
                ("baseline_correct", "baseline_correct"),
            )
        ],
    )
    rates = counts.withColumns(
        {
            "model_accuracy": S.ratio("model_correct", "total_pitches"),
            "baseline_accuracy": S.ratio("baseline_correct", "total_pitches"),
        }
    )
    return E.lift(rates)


def season_rows(history: DataFrame, season: int, start: str, end: str, version: str) -> DataFrame:
    """The history of one season, date range and backtest version."""
    day = S.to_day("game_date")
    return history.filter(
        (S.to_number("season", "bigint") == season)
        & day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("backtest_version") == version)
    )


def season_summary(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pooled over pitches, and averaged over starts; starts without a value do not count."""
    number = S.to_number
    pooled = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pitcher_games"),
        F.countDistinct("pitcher_id").alias("unique_pitchers"),
        *[
            F.coalesce(F.sum(number(c, "bigint")), F.lit(0)).alias(o)
            for c, o in (
                ("pitch_count", "total_pitches"), ("model_correct", "model_correct"),
                ("baseline_correct", "baseline_correct"),
            )
        ],
        F.avg(number("model_accuracy")).alias("mean_start_model_accuracy"),
        F.avg(number("baseline_accuracy")).alias("mean_start_baseline_accuracy"),
        F.avg(number("accuracy_over_baseline_pp")).alias("mean_start_lift_pp"),
        F.avg(number("relative_improvement")).alias("mean_start_relative_improvement"),
    )
    rates = pooled.withColumns(
        {
            "model_accuracy": S.ratio("model_correct", "total_pitches"),
            "baseline_accuracy": S.ratio("baseline_correct", "total_pitches"),
        }
    )
    return E.lift(rates)


def status_counts(rows: DataFrame, status: str = "status", keys: list[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def effects(results: DataFrame, arms: list[str], against: list[tuple[str, str]]) -> DataFrame:
    """Accuracy differences between arms in percentage points, one column per (arm, other) pair."""
    return results.withColumns(
        {f"{a}_vs_{b}_pp": (F.col(f"{a}_accuracy") - F.col(f"{b}_accuracy")) * 100 for a, b in against}
    )


def ablation_summary(
    results: DataFrame, arms: list[str], against: list[tuple[str, str]], digits: int = 9
) -> DataFrame:
    """Means per arm; wins, losses, ties, mean and exact median per comparison. One input row per
    pitcher, so the median's input is the list of pitchers. Differences are rounded first, so that
    a tie is a tie."""
    table = effects(results, arms, against)
    outs = [F.count(F.lit(1)).alias("pitchers")]
    outs += [F.avg(f"{a}_accuracy").alias(f"mean_{a}_accuracy") for a in arms]
    for a, b in against:
        name = f"{a}_vs_{b}"
        diff = F.round(F.col(f"{name}_pp"), digits)
        outs += [
            F.count_if(diff > 0).alias(f"{name}_wins"),
            F.count_if(diff < 0).alias(f"{name}_losses"),
            F.count_if(diff == 0).alias(f"{name}_ties"),
            F.avg(diff).alias(f"mean_{name}_pp"),
            F.median(diff).alias(f"median_{name}_pp"),
        ]
    return table.agg(*outs)


def scoreboard_join(day: DataFrame, scoreboard: DataFrame, key: str = "game_pk") -> DataFrame:
    """Evaluated games with teams, score and status; defaults where the schedule has no entry."""
    cols = ["away", "home", "away_score", "home_score", "status"]
    board = scoreboard.select(key, *cols)
    return day.join(board, key, "left").withColumns(
        {
            "away": F.coalesce("away", F.lit("AWY")),
            "home": F.coalesce("home", F.lit("HOM")),
            "status": F.coalesce("status", F.lit("Final")),
        }
    )


def day_overview(history: DataFrame, date: str) -> DataFrame:
    """Headline figures of one date."""
    day = history.filter(S.to_day("game_date") == F.lit(date).cast("date"))
    return pooled_totals(day)


def outing_log(log: DataFrame) -> DataFrame:
    """The display form of a pitch log; order by pitch number at the sink."""
    return log.select(
        "game_pk", "pitcher",
        F.col("pitch_number_of_game").alias("pitch"),
        F.concat_ws(" ", "inning_topbot", F.col("inning").cast("string")).alias("inning"),
        "count",
        F.col("model_prediction").alias("predicted"),
        F.col("actual_pitch").alias("actual"),
        S.hit_label("model_correct").alias("result"),
    )


def outing_hits(log: DataFrame, keys: list[str] = ("game_pk", "pitcher"), order: list[str] = ("pitch_number_of_game",)) -> DataFrame:
    """One row per outing: its pitches, those called right, and the sequence of hits and misses in pitch
    order as runs, such as ``3 correct, 1 missed``. An outing is some hundred pitches at most, so it is
    one short array."""
    pitches = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], S.hit_label("model_correct").alias("hit"))))
    outings = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("pitches"), F.count_if("model_correct").alias("correct"), pitches.alias("_p"))
    none = F.array().cast("array<struct<hit: string, n: int>>")

    def step(runs, p):
        begun = F.struct(p["hit"].alias("hit"), F.lit(1).alias("n"))
        longer = F.struct(p["hit"].alias("hit"), (F.try_element_at(runs, F.lit(-1))["n"] + 1).alias("n"))
        goes_on = F.coalesce(F.try_element_at(runs, F.lit(-1))["hit"] == p["hit"], F.lit(False))
        return F.when(goes_on, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(begun)))

    runs = F.aggregate("_p", none, step)
    told = F.array_join(F.transform("_runs", lambda r: F.concat_ws(" ", r["n"].cast("string"), r["hit"])), ", ")
    return outings.withColumn("_runs", runs).withColumn("hits", told).drop("_p", "_runs")


def outing_repertoire(log: DataFrame, keys: list[str] = ("game_pk", "pitcher"), names: dict[str, str] | None = None) -> DataFrame:
    """What was thrown in each outing: count and share per class, how often it was called right, and its
    name."""
    counts = log.groupBy(*keys, F.col("actual_pitch").alias("pitch")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if("model_correct").alias("correct"))
    total = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("count").alias("_total"))
    joined = counts.join(settled(total), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.select(*keys, "pitch", S.lookup("pitch", names or {"": ""}, F.col("pitch")).alias("name"), "count",
                         S.ratio("count", "_total").alias("thrown"), "correct")


def code_legend(log: DataFrame, names: dict[str, str]) -> DataFrame:
    """Every code that was predicted or thrown, with its name (the code itself if it has none)."""
    codes = (
        log.select(F.col("model_prediction").alias("code"))
        .union(log.select(F.col("actual_pitch").alias("code")))
        .filter(F.col("code").isNotNull())
        .distinct()
    )
    return codes.withColumn("name", S.lookup("code", names, F.col("code")))
