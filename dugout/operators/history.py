"""Keyed state: evaluation history, pitch-log refresh, resume lists, retention."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout import columns as C
from dugout import schema
from dugout.functions import scalar as S
from dugout.operators import sequence as Q
from dugout.operators.groups import settled
from dugout.session import cut_lineage

HISTORY_KEY = ["game_pk", "pitcher_id"]


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], newest: list[Column | str], key_type: str | None = "bigint"
) -> DataFrame:
    """Old rows whose key is not in the batch, plus the batch; within the batch the newest row of a
    key wins. Keys are compared as typed values, so '1001.0' and 1001 are the same id."""
    if key_type:
        old = old.withColumns({k: S.to_number(k, key_type) for k in keys})
        new = new.withColumns({k: S.to_number(k, key_type) for k in keys})
    batch = Q.keep_last(new, keys, newest)
    return old.join(batch, keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def empty_history(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in C.HISTORY_TYPES.items()))


def normalize_history(history: DataFrame, newest: str = "evaluated_at_utc") -> DataFrame:
    """Fixed columns and types, season filled from the date, rows without date or key dropped, one
    row per pitcher-game. Sorting belongs to the sink (``sorted_history``)."""
    table = schema.with_columns_of(history, C.HISTORY_TYPES)
    day = S.to_day("game_date")
    table = table.withColumns(
        {
            "game_date": day,
            "season": F.coalesce(S.to_number("season", "bigint"), F.year(day).cast("bigint")),
            "game_pk": S.to_number("game_pk", "bigint"),
            "pitcher_id": S.to_number("pitcher_id", "bigint"),
        }
    ).dropna(subset=["game_date", *HISTORY_KEY])
    table = Q.keep_last(table, HISTORY_KEY, [newest])
    return table.withColumn("game_date", F.date_format("game_date", "yyyy-MM-dd"))


def sorted_history(history: DataFrame) -> DataFrame:
    return history.orderBy("game_date", "game_pk", F.col("pitcher_name").asc_nulls_last(), "pitcher_id")


def record(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The history with a batch of evaluations recorded, in its normal form."""
    old = schema.with_columns_of(history, C.HISTORY_TYPES)
    new = schema.with_columns_of(batch, C.HISTORY_TYPES)
    return normalize_history(upsert(old, new, HISTORY_KEY, ["evaluated_at_utc"]))


# --- refreshing the pitch log -----------------------------------------------------------------
def request_ranges(
    control: DataFrame, history_through: str, refresh_days: int = 7, key: str = "pitcher"
) -> DataFrame:
    """What to fetch per pitcher. ``control`` has key, debut, covered_through (NULL at first).

    Fetching starts over ``refresh_days`` before the end of the covered range, so late corrections
    come in; never before the debut or the first tracked date.
    """
    start = F.greatest(F.col("debut"), F.lit(C.FIRST_TRACKED_DATE).cast("date"))
    resume = F.greatest(start, F.date_sub("covered_through", refresh_days - 1))
    through = F.lit(history_through).cast("date")
    return control.select(
        key,
        start.alias("history_start"),
        F.coalesce(resume, start).alias("request_start"),
        through.alias("request_end"),
        F.greatest(through, F.col("covered_through")).alias("covered_through"),
        (F.coalesce(resume, start) <= through).alias("needed"),
    )


def date_chunks(ranges: DataFrame, start: str, end: str, days: int = 2190) -> DataFrame:
    """Inclusive ranges cut into pieces of at most ``days`` days."""
    begins = F.explode(F.sequence(F.col(start), F.col(end), F.make_dt_interval(F.lit(days))))
    return (
        ranges.filter(F.col(start) <= F.col(end))
        .withColumn("chunk_start", begins)
        .withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))
    )


def overlap_refresh(
    existing: DataFrame,
    incoming: DataFrame,
    ranges: DataFrame,
    keys: list[str] = C.LOG_KEY,
    key: str = "pitcher",
    date: str = "game_date",
    newest: list[Column | str] = ("ingest_seq",),
) -> DataFrame:
    """Replace each requested pitcher's overlap by the new batch: rows that disappeared upstream
    disappear here, corrections win, rows before the request stay.

    Only the batch is deduplicated; stored rows are unique already, so they are filtered by two joins
    with small sides and neither ranked nor sorted.
    """
    starts = ranges.filter("needed").select(key, F.col("request_start").alias("_start"))
    batch = cut_lineage(Q.keep_last(incoming, keys, list(newest)))
    kept = (
        existing.join(settled(starts), key, "left")
        .filter(F.col("_start").isNull() | (F.col(date) < F.col("_start")))
        .drop("_start")
    )
    renewed = settled(batch.select(*[F.col(k).alias(f"_new_{k}") for k in keys]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    out = kept.join(renewed, same, "left_anti").unionByName(batch, allowMissingColumns=True)
    return out.select(*existing.columns, *[c for c in out.columns if c not in existing.columns])


def failed_fetches(ranges: DataFrame, control: DataFrame, failures: DataFrame, key: str = "pitcher") -> DataFrame:
    """``request_ranges`` with the keys whose fetch failed (column ``key`` of ``failures``) left as they
    were: nothing of theirs is replaced, and what they cover does not advance."""
    lost = failures.select(key).distinct().withColumn("_lost", F.lit(True))
    before = control.select(key, F.col("covered_through").alias("_covered"))
    joined = ranges.join(settled(lost), key, "left").join(settled(before), key, "left")
    return joined.withColumns({
        "needed": F.col("needed") & F.col("_lost").isNull(),
        "covered_through": F.when(F.col("_lost"), F.col("_covered")).otherwise(F.col("covered_through")),
    }).drop("_lost", "_covered")


# --- work lists -------------------------------------------------------------------------------
def not_yet_evaluated(
    targets: DataFrame,
    history: DataFrame,
    version: str = C.BACKTEST_VERSION,
    strategy: str = "stratified",
    keys: list[str] = HISTORY_KEY,
    force: bool = False,
) -> DataFrame:
    """Targets without a result of this backtest version and baseline strategy."""
    if force:
        return targets
    done = history.filter(
        (F.col("backtest_version") == version) & (F.col("baseline_strategy") == strategy)
    ).select(*[S.to_number(k, "bigint").alias(k) for k in keys])
    return targets.join(done, keys, "left_anti")


def retention(
    partitions: DataFrame,
    evaluated: DataFrame,
    today: str,
    keep_days: int,
    force: bool = False,
    date: str = "game_date",
    size: str = "size_bytes",
) -> DataFrame:
    """Which dated partitions may go, and why the others stay. Deleting is up to the caller."""
    day = S.to_day(date)
    known = evaluated.select(S.to_day(date).alias("_day")).distinct().withColumn("_evaluated", F.lit(True))
    cutoff = F.date_sub(F.lit(today).cast("date"), keep_days)
    reason = (
        F.when(F.col("_d") > cutoff, "within window")
        .when(F.lit(not force) & F.col("_evaluated").isNull(), "no evaluated results yet")
        .otherwise("prune")
    )
    return (
        partitions.withColumn("_d", day).filter(F.col("_d").isNotNull())
        .join(known, F.col("_d") == F.col("_day"), "left")
        .select(F.col("_d").alias(date), F.col(size), reason.alias("decision"))
    )


def evaluated_dates(history: DataFrame, date: str = "game_date") -> DataFrame:
    days = history.select(S.to_day(date).alias(date)).filter(F.col(date).isNotNull()).distinct()
    return days.orderBy(F.col(date).desc())


def single_match(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Exactly one row, or an error that says whether there were none or several."""
    found = df.filter(condition)
    n = len(found.limit(2).collect())
    if n == 0:
        raise LookupError(f"no match for {what}")
    if n > 1:
        raise LookupError(f"{what} is ambiguous")
    return found
