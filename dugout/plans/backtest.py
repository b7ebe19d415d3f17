"""Replaying finished games with nothing but earlier data: one day, or a whole history.

The walk-forward backtest needs, for every game, class frequencies of all earlier dates. It takes
them from running totals over (pitcher, date) rows, so its cost grows with the log; the training
rows of a game are never listed per game.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout import columns as C
from dugout.functions import scalar as S
from dugout.operators import baselines as B
from dugout.operators import evaluation as E
from dugout.operators import sequence as Q
from dugout.operators import weights as W
from dugout.operators.groups import settled
from dugout.session import cut_lineage


@dataclass(frozen=True)
class Log:
    """Names of the columns that play each part."""

    key: str = "pitcher"
    game: str = "game_pk"
    date: str = "game_date"
    label: str = "pitch_type"
    row_id: tuple[str, ...] = ("game_pk", "pitcher", "at_bat_number_of_game", "pitch_number_of_ab")


PITCHES = Log()


# --- one day ----------------------------------------------------------------------------------
def before(log: DataFrame, targets: DataFrame, names: Log = PITCHES) -> DataFrame:
    """Rows dated strictly before the pitcher's target date. The first game of a doubleheader is
    not history for the second. A pitcher with targets on several dates is an error: replay these
    date by date (``replay_days``)."""
    several = F.concat(F.lit("targets on several dates for "), F.col(names.key).cast("string"))
    day = targets.groupBy(names.key).agg(F.min("target_date").alias("_target"), F.max("target_date").alias("_last"))
    day = day.select(names.key, F.when(F.col("_target") == F.col("_last"), F.col("_target"))
                     .otherwise(F.raise_error(several).cast("date")).alias("_target"))
    earlier = log.join(settled(day), names.key).filter(F.col(names.date) < F.col("_target"))
    return earlier.withColumn("_target_season", F.year("_target")).drop("_target")


def target_rows(log: DataFrame, targets: DataFrame, names: Log = PITCHES) -> DataFrame:
    games = targets.select(
        F.col(names.key), S.to_number(names.game, "bigint").alias(names.game)
    ).distinct()
    return log.join(games, [names.key, names.game], "left_semi")


def replay_day(
    log: DataFrame,
    targets: DataFrame,
    names: Log = PITCHES,
    predicted: DataFrame | None = None,
    rules: W.Rules | None = W.CONTINUOUS,
    seed: int = 42,
    played: DataFrame | None = None,
) -> DataFrame:
    """Prediction log of one day's target games (key, game, target_date).

    ``predicted``: the target rows with ``model_prediction`` (from a fitted model). Without it the
    weighted-majority class of the earlier rows is the model. ``played``: the part of the log that holds
    all rows of the target games, if it is at hand.
    """
    history = before(log, targets, names)
    if predicted is None:
        weighted = W.training_weights(
            history.withColumn("_season", F.year(names.date)), names.key, names.label,
            reference="_target_season", rules=rules, season="_season",
        )
        call = B.weighted_majority(weighted, [names.key], names.label, "weight")
        call = call.select(names.key, F.col(names.label).alias("model_prediction"))
        predicted = target_rows(log if played is None else played, targets, names).join(settled(call), names.key, "left")
    ranges = B.class_ranges(history, [names.key], names.label)
    rows = B.stratified(predicted, ranges, [names.key], names.label, list(names.row_id), seed)
    return mark(rows, names)


def replay_days(
    log: DataFrame,
    pending: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    names: Log = PITCHES,
    seed: int = 42,
) -> Iterator[tuple[date, DataFrame]]:
    """Replay target games (key, game, target_date) date by date with a fitted model.

    ``fit`` gets the rows of the day's pitchers before that day, with ``_target_season``, and
    returns a function that adds ``model_prediction`` to rows. One prediction log per date is handed
    out, to be written before the next date is fitted; the list of dates is as long as the calendar.
    """
    days = [r[0] for r in pending.select("target_date").distinct().orderBy("target_date").collect()]
    for day in days:
        targets = pending.filter(F.col("target_date") == F.lit(day))
        predict = fit(before(log, targets, names))
        predicted = predict(target_rows(log, targets, names))
        yield day, replay_day(log, targets, names, predicted=predicted, seed=seed)


def mark(rows: DataFrame, names: Log = PITCHES) -> DataFrame:
    """Add whether model and baseline were right."""
    actual = F.col(names.label)
    return rows.withColumns(
        {
            "actual_pitch": actual,
            "model_correct": F.coalesce(F.col("model_prediction") == actual, F.lit(False)),
            "baseline_correct": F.coalesce(F.col("baseline_prediction") == actual, F.lit(False)),
        }
    )


def game_results(log: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and accuracies of each replayed game."""
    games = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pitch_count"),
        F.count_if("model_correct").alias("model_correct"),
        F.count_if("baseline_correct").alias("baseline_correct"),
    )
    rates = games.withColumns(
        {
            "model_accuracy": S.ratio("model_correct", "pitch_count"),
            "baseline_accuracy": S.ratio("baseline_correct", "pitch_count"),
        }
    )
    return E.lift(rates)


def day_rows(starters: DataFrame, results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One status row per starter of the day. ``starters``: game_pk, pitcher_id, game_status, ...;
    ``results``: by game_pk, pitcher_id; ``errors``: game_pk, pitcher_id, error."""
    key = ["game_pk", "pitcher_id"]
    unique = Q.keep_first(starters, key, [c for c in ("side", "game_status") if c in starters.columns] or key)
    rows = unique.join(results, key, "left")
    if errors is not None:
        rows = rows.join(errors.select(*key, "error"), key, "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    not_found = F.lit("The completed game was not found in the data.")
    final = S.is_final("game_status")
    error = F.when(final & F.col("error").isNull() & F.col("pitch_count").isNull(), not_found).otherwise(
        F.col("error")
    )
    rows = rows.withColumn("error", F.when(final, error))
    # the daily report knows no separate status for short histories
    status = S.outcome("error")
    return rows.withColumn(
        "replay_status",
        F.when(~final, "game_not_final").when(status == "insufficient_history", "failed").otherwise(status),
    )


def history_rows(results: DataFrame, names: Log = PITCHES, evaluated_at: Column | None = None) -> DataFrame:
    """Results in the form of the evaluation history."""
    day = F.col(names.date)
    table = results.withColumns(
        {
            "pitcher_id": F.col(names.key).cast("bigint"),
            "game_pk": F.col(names.game).cast("bigint"),
            "season": F.year(day).cast("bigint"),
            "training_cutoff": F.date_format(F.date_sub(day, 1), "yyyy-MM-dd"),
            "game_date": F.date_format(day, "yyyy-MM-dd"),
            "baseline_strategy": F.lit("stratified"),
            "model_version": F.lit(C.MODEL_VERSION),
            "feature_version": F.lit(C.FEATURE_VERSION),
            "evaluation_version": F.lit(C.EVALUATION_VERSION),
            "backtest_version": F.lit(C.BACKTEST_VERSION),
            "evaluated_at_utc": F.date_format(
                evaluated_at if evaluated_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"
            ),
        }
    )
    return table.select(*[c for c in C.HISTORY_TYPES if c in table.columns])


# --- every day --------------------------------------------------------------------------------
def game_counts(log: DataFrame, classes: list[str], names: Log = PITCHES) -> DataFrame:
    """Class counts of each game and date, the one pass over the log that the prefixes need."""
    return log.groupBy(names.key, names.date, names.game).agg(
        *[F.count_if(F.col(names.label) == c).alias(f"_n{i}") for i, c in enumerate(classes)]
    )


def prefix_totals(per_game: DataFrame, n: int, names: Log = PITCHES) -> DataFrame:
    """Per pitcher and date: class counts and games of all earlier dates, and class counts of
    earlier dates in the same season.

    ``per_game`` is ``game_counts`` over ``n`` classes; counts are arrays in their order. Same-day
    rows, the other game of a doubleheader included, are not part of a date's prefix.
    """
    counted = [f"_n{i}" for i in range(n)]
    daily = per_game.groupBy(names.key, names.date).agg(
        *[F.sum(c).alias(c) for c in counted], F.count(names.game).alias("_games")
    )
    daily = daily.withColumn("_season", F.year(names.date))
    # one row per key and calendar date: a key has at most as many rows as the calendar has days,
    # however many rows the log has, so there is no need to look for oversized keys
    upto = Q.add(
        daily, [names.key], [names.date], [Q.running_sum(f"_cum{c}", c) for c in [*counted, "_games"]], hot=None
    )
    upto = Q.add(
        upto, [names.key, "_season"], [names.date], [Q.running_sum(f"_sea{c}", c) for c in counted], hot=None
    )
    return upto.select(
        names.key,
        names.date,
        "_season",
        F.array(*[F.col(f"_cum{c}") - F.col(c) for c in counted]).alias("prior_counts"),
        F.array(*[F.col(f"_sea{c}") - F.col(c) for c in counted]).alias("season_counts"),
        (F.col("_cum_games") - F.col("_games")).alias("prior_games"),
    )


def season_history(per_game: DataFrame, n: int, names: Log = PITCHES) -> DataFrame:
    """Per pitcher and season: the class counts of each earlier season, as one small array."""
    counts = per_game.groupBy(names.key, F.year(names.date).alias("_season")).agg(
        F.array(*[F.sum(f"_n{i}") for i in range(n)]).alias("_counts")
    )
    earlier = Window.partitionBy(names.key).orderBy("_season").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        names.key,
        "_season",
        F.collect_list(F.struct(F.col("_season").alias("season"), F.col("_counts").alias("counts")))
        .over(earlier)
        .alias("past"),
    )


def _argmax(values: Column, classes: list[str]) -> Column:
    """Class of the largest value; of equals the first in vocabulary order (kept sorted)."""
    spot = F.array_position(values, F.array_max(values)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), spot)


def _summed(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _weighted_counts(prefix: DataFrame, recency: W.Recency | None, rules: W.Rules | None, digits: int) -> DataFrame:
    """Add ``_weighted``: a date's earlier class counts, each season's with its weights, and ``_factors``:
    the weight of each season and class. The seasons of a pitcher are one short array, so the rules are
    expressions over it."""
    spot = F.array(F.struct(F.col("_season").alias("season"), F.col("season_counts").alias("counts")))
    none = F.array().cast("array<struct<season: int, counts: array<bigint>>>")
    running = F.when(F.exists("season_counts", lambda x: x > 0), spot).otherwise(none)
    out = prefix.withColumn("_seasons", F.concat(F.coalesce("past", none), running))
    n = F.size("_seasons")
    latest = F.try_element_at("_seasons", F.lit(-1))
    if recency is not None:
        decay = S.decay_factor(n, recency.start, recency.step, recency.floor)
        out = out.withColumn("_decay", F.when(n >= 1, decay))
    zeros = F.transform("season_counts", lambda x: F.lit(0).cast("bigint"))
    if rules is not None:
        older = F.filter(F.slice("_seasons", 1, F.greatest(n - 1, F.lit(0))),
                         lambda s: _summed(s["counts"]) >= rules.min_older)
        out = out.withColumns({"_older": older, "_latest": latest})
        pair = F.when(F.size("_older") > 2, F.slice("_older", -2, 2)).otherwise(F.col("_older"))
        add = lambda a, s: F.zip_with(a, s["counts"], lambda x, y: x + y)
        out = out.withColumn("_prior", F.aggregate(pair, zeros, add))
        out = out.withColumns({"_of_latest": _summed(F.col("_latest.counts")), "_of_prior": _summed(F.col("_prior"))})
        of_latest, of_prior = F.col("_of_latest"), F.col("_of_prior")
        usable = (n >= 2) & (of_latest >= rules.min_recent) & (F.size("_older") > 0)
        ones = F.transform("season_counts", lambda x: F.lit(1.0))
        factor = lambda i: F.when(usable, F.zip_with(
            F.col("_latest.counts"), F.col("_prior"),
            lambda c, p: W.multipliers(c / of_latest, p / of_prior, rules)[i])).otherwise(ones)
        out = out.withColumns({"_old": factor(0), "_new": factor(1)})
    # what holds of the row and is used for each of its seasons
    of_row = {"season": F.col("_season")}
    if recency is not None:
        of_row["decay"] = F.col("_decay")
    if rules is not None:
        of_row |= {"latest": F.col("_latest.season"), "old": F.col("_old"), "new": F.col("_new")}
    row = F.struct(*[v.alias(k) for k, v in of_row.items()])

    def recent(r: Column, s: Column) -> Column:
        return F.lit(1.0) if recency is None else F.greatest(F.pow(r["decay"], r["season"] - s["season"]), F.lit(recency.minimum))

    def factors(r: Column, s: Column) -> Column:
        w = recent(r, s)
        if rules is None:
            return F.transform(s["counts"], lambda c: w)
        own = F.when(s["season"] == r["latest"], r["new"]).otherwise(r["old"])
        return F.transform(own, lambda m: w * m)

    def weighed(r: Column, s: Column) -> Column:
        w = recent(r, s)
        if rules is None:
            return F.transform(s["counts"], lambda c: c * w)
        own = F.when(s["season"] == r["latest"], r["new"]).otherwise(r["old"])
        return F.zip_with(s["counts"], own, lambda c, m: c * w * m)

    seasons = F.col("_seasons")
    out = out.withColumn("_factors", S.once(row, lambda r: F.transform(
        seasons, lambda s: F.struct(s["season"].alias("season"), factors(r, s).alias("factor")))))
    total = S.once(row, lambda r: F.aggregate(
        seasons, F.transform("season_counts", lambda x: F.lit(0.0)),
        lambda acc, s: F.zip_with(acc, weighed(r, s), lambda a, c: a + c),
        lambda acc: F.transform(acc, lambda x: F.round(x, digits)),
    ))
    return out.withColumn("_weighted", total)


def date_weights(
    log: DataFrame, classes: list[str], names: Log = PITCHES, recency: W.Recency | None = W.MILD, rules: W.Rules | None = W.CONTINUOUS
) -> DataFrame:
    """Per pitcher and date: games before it, and the training weight that each season and class (in
    the order of ``classes``) has for a model of that date. From one pass over the log."""
    per_game = cut_lineage(game_counts(log, classes, names))
    prefix = prefix_totals(per_game, len(classes), names)
    prefix = prefix.join(season_history(per_game, len(classes), names), [names.key, "_season"], "left")
    weighted = _weighted_counts(prefix, recency, rules, 12)
    return weighted.select(names.key, names.date, "prior_games", F.col("_factors").alias("factors"))


def walk_forward(
    log: DataFrame,
    names: Log = PITCHES,
    recency: W.Recency | None = W.MILD,
    rules: W.Rules | None = W.CONTINUOUS,
    min_games: int = 2,
    seed: int = 42,
    digits: int = 12,
) -> DataFrame:
    """Predict every row from the pitcher's earlier dates: majority by recency x repertoire weights as
    the model, stratified draw as the baseline. Rows whose pitcher has too little history keep an
    error. Every label of the log counts; there are few, and they are looked up first."""
    labels = log.select(names.label).filter(F.col(names.label).isNotNull()).distinct()
    classes = sorted(r[0] for r in labels.collect())
    n = len(classes)
    # read by both kinds of prefix
    per_game = cut_lineage(game_counts(log, classes, names))
    prefix = prefix_totals(per_game, n, names)
    prefix = prefix.join(season_history(per_game, n, names), [names.key, "_season"], "left")
    prefix = _weighted_counts(prefix, recency, rules, digits)
    weighted = F.col("_weighted")
    upto = F.expr(
        "transform(sequence(1, size(prior_counts)), i -> aggregate(slice(prior_counts, 1, i), 0L, (a, x) -> a + x))"
    )
    known = F.exists("prior_counts", lambda x: x > 0)
    enough = known & (F.col("prior_games") >= min_games)
    table = prefix.select(
        names.key,
        names.date,
        F.when(enough, _argmax(weighted, classes)).alias("model_prediction"),
        F.when(enough, upto).alias("_upto"),
        F.when(~known, F.lit(S.NO_HISTORY))
        .when(~enough, F.lit(S.FEW_GAMES))
        .alias("error"),
    )
    rows = log.join(table, [names.key, names.date])
    k = F.pmod(S.hash_int(seed, *names.row_id), F.element_at("_upto", -1))
    below = S.once(k, lambda x: F.size(F.filter("_upto", lambda u: u <= x)))
    drawn = F.element_at(F.array(*[F.lit(c) for c in classes]), below + 1)
    rows = rows.withColumn("baseline_prediction", F.when(F.col("_upto").isNotNull(), drawn))
    return mark(rows.drop("_upto"), names)


def walk_forward_games(rows: DataFrame, names: Log = PITCHES) -> DataFrame:
    """Results per evaluated game of a walk-forward log."""
    return game_results(rows.filter(F.col("error").isNull()), [names.key, names.game, names.date])


def walk_forward_status(rows: DataFrame, names: Log = PITCHES) -> DataFrame:
    """Outcome of each game: evaluated, or why not."""
    games = rows.groupBy(names.key, names.game, names.date).agg(F.max("error").alias("error"))
    return games.withColumn("status", S.outcome("error"))


def pending_games(
    log: DataFrame, history: DataFrame, start: str, end: str, names: Log = PITCHES, force: bool = False
) -> DataFrame:
    """Games in a date range that the history does not hold yet."""
    from dugout.operators.history import not_yet_evaluated

    games = (
        log.filter(F.col(names.date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy(F.col(names.game).alias("game_pk"), F.col(names.key).alias("pitcher_id"))
        .agg(F.min(names.date).alias("target_date"))
    )
    return not_yet_evaluated(games, history, force=force)
