"""The daily build: refresh the pitch log, derive the stages, and say per pitcher what happened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators import history as H
from dugout.operators import sequence as Q
from dugout.operators.groups import HOT_ROWS
from dugout.plans import increment as I
from dugout.plans import stages as P
from dugout.session import cut_lineage

NO_ROWS = "No pitches were found."
STRANGE = "The batch holds a pitcher that was not requested."


@dataclass(frozen=True)
class DailyRun:
    """The refreshed log of all pitchers, the stages of the day's, one run-log row per pitcher and
    stage, and what to store as covered."""

    log: DataFrame
    stages: P.Stages
    run_log: DataFrame
    covered: DataFrame
    cuts: DataFrame | None = None  # with a carry: the date from which each pitcher's stages are given
    carry: I.Carry | None = None  # the carry to store after the run


def run(
    existing: DataFrame,
    incoming: DataFrame,
    control: DataFrame,
    starters: DataFrame,
    history_through: str,
    refresh_days: int = 7,
    newest: list[str] = ("ingest_seq",),
    hot_rows: int = HOT_ROWS,
    failures: DataFrame | None = None,
    fit: Callable[[DataFrame], DataFrame] | None = None,
    before: I.Carry | None = None,
) -> DailyRun:
    """``existing`` and ``incoming`` are pitch logs, ``control`` has pitcher, debut and
    covered_through, ``starters`` the pitchers of the day (column pitcher). Rows of pitchers nobody
    asked for are kept out and reported; a pitcher's failure never stops the others.

    ``failures`` (pitcher, error) are fetches that did not come through: these pitchers keep their
    stored rows and what they cover. ``fit`` trains on the stages' features and returns the pitchers
    it could not train (pitcher, error); without it no line speaks of modeling.

    With ``before``, the carry stored by the run before, the stages are built from the replaced dates
    alone and hold these only (``cuts``); ``increment.merged`` puts them into the stored stages. A
    pitcher without stored stages is asked for from the start, so all rows are new.
    """
    asked = Q.keep_last(starters.select("pitcher"), ["pitcher"], ["pitcher"])
    ranges = H.request_ranges(control.join(asked, "pitcher", "left_semi"), history_through, refresh_days)
    none = F.lit(None).cast("string")
    if failures is None:
        failures = asked.limit(0).withColumn("error", none)
    failures = failures.join(asked, "pitcher", "left_semi").groupBy("pitcher").agg(F.min("error").alias("_fetch"))
    ranges = H.failed_fetches(ranges, control, failures)
    incoming = incoming.join(failures, "pitcher", "left_anti")
    wanted = incoming.join(asked, "pitcher", "left_semi")
    strange = incoming.select("pitcher").distinct().join(asked, "pitcher", "left_anti")
    everyone = H.overlap_refresh(existing, wanted, ranges, newest=list(newest))
    # the day's part of the refreshed log is read by every stage and by the run log
    log = cut_lineage(everyone.join(asked, "pitcher", "left_semi"))
    cuts = carry = None
    if before is None:
        stages = P.build(log.drop(*newest), hot_rows)
    else:
        starts = cut_lineage(ranges.filter("needed").select("pitcher", F.col("request_start").alias("cut")))
        batch, cuts = I.whole_games(log.drop(*newest), starts)
        stages = I.extend(batch, cuts, before, hot_rows)
        carry = I.carried_on(before, stages, cuts)
    features = cut_lineage(stages.kg4.groupBy("pitcher").agg(F.count(F.lit(1)).alias("rows_featured")))

    raw = log.groupBy("pitcher").agg(F.count(F.lit(1)).alias("rows_in"), F.count("pitch_type").alias("rows_out"))
    per_pitcher = asked.join(raw, "pitcher", "left").join(features, "pitcher", "left").join(failures, "pitcher", "left")
    if fit is None:
        per_pitcher = per_pitcher.withColumn("_fit", none)
    else:
        untrained = fit(stages.kg4).groupBy("pitcher").agg(F.min("error").alias("_fit"))
        per_pitcher = per_pitcher.join(untrained, "pitcher", "left")
    zero = F.lit(0).cast("bigint")
    n, kept, featured = (F.coalesce(c, zero) for c in ("rows_in", "rows_out", "rows_featured"))
    fetched = F.coalesce(F.col("_fetch"), F.when(n == 0, NO_ROWS))
    steps = [
        F.struct(F.lit("download").alias("stage"), n.alias("rows"), fetched.alias("error")),
        F.struct(F.lit("cleaning").alias("stage"), kept.alias("rows"), F.when((n > 0) & (kept == 0), NO_ROWS).otherwise(none).alias("error")),
        F.struct(F.lit("feature_engineering").alias("stage"), featured.alias("rows"), F.when(featured == 0, NO_ROWS).otherwise(none).alias("error")),
    ]
    if fit is not None:
        steps.append(F.struct(F.lit("modeling").alias("stage"), featured.alias("rows"), F.col("_fit").alias("error")))
    steps = F.array(*steps)
    # a stage is reported when the stages before it went through
    lines = per_pitcher.select("pitcher", n.alias("_in"), kept.alias("_out"), F.explode(steps).alias("s"))
    lines = lines.filter(
        (F.col("s.stage") == "download") | ((F.col("s.stage") == "cleaning") & (F.col("_in") > 0)) | (F.col("_out") > 0)
    ).select("pitcher", "s.stage", "s.rows", "s.error")
    intruders = strange.select(
        "pitcher", F.lit("download").alias("stage"), zero.alias("rows"), F.lit(STRANGE).alias("error")
    )
    run_log = lines.unionByName(intruders).withColumn(
        "status", F.when(F.col("error").isNull(), "success").otherwise("failed")
    )
    return DailyRun(everyone, stages, run_log, covered(ranges), cuts, carry)


def covered(ranges: DataFrame) -> DataFrame:
    """The control columns to store after a run."""
    return ranges.select("pitcher", "covered_through")


