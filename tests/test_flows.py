"""Files, schedules, replay, backtest, models."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import pitches as PF
from dugout import columns as C
from dugout.operators import weights as W
from dugout.plans import backtest as R
from dugout.plans import daily
from dugout.plans import learning as L
from dugout.plans import stages
from dugout.sources import readers, sinks, versions

SMALL = L.Forest(trees=3, depth=4, min_leaf=1, max_bins=16)
COLS = L.Columns(["balls", "strikes"], ["count_state"])


# --- files ------------------------------------------------------------------------------------
def test_landing_strips_bom_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"pitcher", "game_pk" ,pitch_type\n1,7,FF\n1,8,\n'.encode())
    df = readers.read_landing(spark, str(tmp_path))
    assert df.columns == ["pitcher", "game_pk", "pitch_type", "ingest_seq"]
    assert [(r.pitcher, r.game_pk, r.pitch_type) for r in df.orderBy("game_pk").collect()] == [(1, 7, "FF"), (1, 8, None)]


def test_later_file_wins(spark, tmp_path):
    import os

    from dugout.operators import sequence as Q

    for name, speed, age in (("b.csv", 1.0, 100), ("a.csv", 2.0, 10)):
        (tmp_path / name).write_text(f"pitcher,release_speed\n1,{speed}\n1,{speed + 0.5}\n")
        os.utime(tmp_path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    df = readers.read_landing(spark, str(tmp_path))
    assert Q.keep_last(df, ["pitcher"], ["ingest_seq"]).first().release_speed == 2.5


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pitcher,game_pk\n1,2\n")
    (tmp_path / "b.csv").write_text("game_pk,pitcher\n2,1\n")
    with pytest.raises(Exception, match="header"):
        readers.read_landing(spark, str(tmp_path)).collect()


def test_landing_refuses_html_and_empty(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("pitcher\n1\n")
    (tmp_path / "page.csv").write_text("\n <!DOCTYPE html><html></html>")
    (tmp_path / "none.csv").write_text("")
    bad = {r.file.rsplit("/", 1)[1]: r.error for r in readers.check_landing(spark, str(tmp_path)).collect()}
    assert bad == {"page.csv": "HTML instead of a CSV export", "none.csv": "empty response"}
    with pytest.raises(readers.ExportError):
        readers.read_landing(spark, str(tmp_path))


def test_csv_missing_markers_and_bad_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,s\n1,NA,None\n2.0,1.5,ok\n")
    rows = readers.read_csv(spark, str(tmp_path), "id bigint, x double, s string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, None), (2, 1.5, "ok")]
    (tmp_path / "b.csv").write_text("id,x,s\nabc,1,ok\n")
    with pytest.raises(Exception, match="not a number: abc"):
        readers.read_csv(spark, str(tmp_path), "id bigint, x double, s string").collect()


def test_schedule(spark, tmp_path):
    def side(team, pitcher):
        s = {"team": {"id": team, "name": f"T{team}"}}
        if pitcher:
            s["probablePitcher"] = {"id": pitcher, "fullName": f"P{pitcher}"}
        return s

    def game(pk, away, home):
        return {"gamePk": pk, "officialDate": "2026-08-24", "gameDate": "2026-08-24T23:05:00Z",
                "status": {"detailedState": "Final"}, "teams": {"away": side(*away), "home": side(*home)}}

    doc = {"dates": [{"games": [game(1, (10, 100), (11, None)), game(2, (12, 102), (13, 103))]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    schedule = readers.read_schedule(spark, str(tmp_path / "s.json"))
    got = readers.starters(schedule).orderBy("game_pk", "side").collect()
    assert [(r.game_pk, r.side, r.pitcher_id, r.opponent_id) for r in got] == [
        (1, "away", 100, 11), (2, "away", 102, 13), (2, "home", 103, 12)]
    missing = readers.missing_probables(schedule).collect()
    assert [(r.game_pk, r.side, r.team_name) for r in missing] == [(1, "home", "T11")]
    board = readers.scoreboard(schedule).filter("game_pk = 1").first()
    assert (board.away, board.home, board.away_score, board.status) == ("AWY", "HOM", None, "Final")


def test_absent_history_is_empty(spark, tmp_path):
    h = readers.read_history(spark, str(tmp_path / "none"))
    assert h.columns == list(C.HISTORY_TYPES) and h.count() == 0


def test_committed_style_summaries(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(
        {"game_pk": 5, "pitcher_id": 6, "baseline_distribution": {"FF": 0.6, "SL": 0.4}, "pitch_count": 90}, indent=2))
    row = readers.read_game_summaries(spark, str(tmp_path / "a.json")).first()
    assert row.baseline_distribution == {"FF": 0.6, "SL": 0.4} and row.pitch_count == 90
    (tmp_path / "d.json").write_text(json.dumps(
        {"game_date": "2026-08-24", "statuses": {"successful": 20}, "aggregate_performance": {"total_pitches": 1841, "model_correct": 745}}, indent=2))
    day = readers.read_daily_summaries(spark, str(tmp_path / "d.json")).first()
    assert (day.successful, day.total_pitches, day.model_correct) == (20, 1841, 745)


def test_stage_and_log_stores(spark, tmp_path):
    built = stages.build(PF.frame(spark, PF.season_log(games=2, per_game=6)))
    sinks.write_stages(built, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/kg4").columns == C.KG4
    assert spark.read.parquet(f"{tmp_path}/kg2").count() == built.kg2.count()


# --- replay -----------------------------------------------------------------------------------
def simple_log(spark):
    d = dt.date
    rows = [(1, 10, d(2024, 4, 1), i, "FF") for i in range(4)] + [(1, 11, d(2024, 4, 8), i, "SL") for i in range(6)]
    rows += [(1, 12, d(2024, 4, 15), i, "SL") for i in range(3)]  # doubleheader, game one
    rows += [(1, 13, d(2024, 4, 15), i, "FF") for i in range(8)]  # doubleheader, game two
    rows += [(2, 12, d(2024, 4, 15), i, "CH") for i in range(2)]
    return spark.createDataFrame(rows, "pitcher int, game_pk int, game_date date, n int, pitch_type string")


NAMES = R.Log(row_id=("game_pk", "pitcher", "n"))


def test_replay_uses_earlier_dates_only(spark):
    log = simple_log(spark)
    targets = spark.createDataFrame([(1, 13, dt.date(2024, 4, 15))], "pitcher int, game_pk int, target_date date")
    assert R.before(log, targets, NAMES).agg(F.max("game_pk")).first()[0] == 11
    out = R.replay_day(log, targets, NAMES, rules=None).collect()
    assert len(out) == 8 and {r.model_prediction for r in out} == {"SL"}
    assert {r.baseline_prediction for r in out} <= {"FF", "SL"}
    assert all(r.model_correct == (r.model_prediction == r.pitch_type) for r in out)


def test_walk_forward_equals_replay_of_each_game(spark):
    log = simple_log(spark)
    forward = R.walk_forward(log, NAMES)
    rows = {(r.pitcher, r.game_pk, r.n): r for r in forward.collect()}
    assert rows[(1, 10, 0)].error == "No pre-game history exists."
    assert rows[(1, 11, 0)].error == "At least two games are required."
    assert rows[(2, 12, 0)].model_prediction is None and not rows[(2, 12, 0)].model_correct
    targets = spark.createDataFrame(
        [(1, 12, dt.date(2024, 4, 15)), (1, 13, dt.date(2024, 4, 15))], "pitcher int, game_pk int, target_date date")
    for r in R.replay_day(log, targets, NAMES, rules=None).collect():
        f = rows[(r.pitcher, r.game_pk, r.n)]
        assert (f.model_prediction, f.baseline_prediction) == (r.model_prediction, r.baseline_prediction)
    status = {(r.pitcher, r.game_pk): r.status for r in R.walk_forward_status(forward, NAMES).collect()}
    assert status[(1, 13)] == "success" and status[(2, 12)] == "insufficient_history"


def test_unknown_label_does_not_break_the_walk(spark):
    log = simple_log(spark).withColumn("pitch_type", F.lit("ZZ"))
    rows = R.walk_forward(log, NAMES).collect()
    assert {r.model_prediction for r in rows if r.error is None} == {"ZZ"}
    assert {r.error for r in rows} == {None, "No pre-game history exists.", "At least two games are required."}


def test_history_rows_fit_the_history(spark):
    log = simple_log(spark)
    games = R.walk_forward_games(R.walk_forward(log, NAMES), NAMES)
    rows = R.history_rows(games, NAMES)
    assert set(rows.columns) <= set(C.HISTORY_TYPES)
    row = rows.filter("game_pk = 13").first()
    assert (row.training_cutoff, row.season, row.backtest_version) == ("2024-04-14", 2024, C.BACKTEST_VERSION)


def test_history_batches_rewrite_their_months_only(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = lambda game, n, at: spark.createDataFrame(
        [(f"2024-{game:02d}-05", game, 7, n, at)], "game_date string, game_pk int, pitcher_id int, pitch_count int, evaluated_at_utc string")
    sinks.store_history(rows(4, 10, "a").union(rows(5, 20, "a")), path)
    first = versions.manifest(spark, path)[1]
    sinks.store_history(rows(5, 21, "b").union(rows(6, 30, "b")), path)
    second = versions.manifest(spark, path)[1]
    assert second["2024-04"] == first["2024-04"] and second["2024-05"] != first["2024-05"]
    got = readers.read_history(spark, path)
    assert sorted((r.game_date, r.pitch_count) for r in got.collect()) == [("2024-04-05", 10), ("2024-05-05", 21), ("2024-06-05", 30)]


def test_targets_on_several_dates_are_refused(spark):
    log = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1))], "pitcher int, game_pk int, game_date date")
    targets = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 6))], "pitcher int, target_date date")
    with pytest.raises(Exception, match="several dates"):
        R.before(log, targets).collect()


def test_a_daily_run_on_the_carry_builds_the_overlap_only(spark):
    from dugout.plans import increment, stages

    everything = PF.frame(spark, PF.season_log(games=6, per_game=8)).withColumn("ingest_seq", F.lit(0))
    last = everything.agg(F.max("game_date")).first()[0]
    old, new = everything.filter(F.col("game_date") < F.lit(last)), everything.filter(F.col("game_date") == F.lit(last)).withColumn("ingest_seq", F.lit(1))
    control = spark.createDataFrame([(p, dt.date(2020, 1, 1), last - dt.timedelta(days=1)) for p in (1, 2)], "pitcher long, debut date, covered_through date")
    first = stages.build(old.drop("ingest_seq"))
    run = daily.run(old, new, control, control.select("pitcher"), str(last), before=increment.carry(first.kg2))
    assert run.stages.kg4.filter(F.col("game_date") < F.date_sub(F.lit(last), 10)).isEmpty() and run.stages.kg4.count() > 0
    whole = stages.build(run.log.drop("ingest_seq")).kg4
    got = increment.merged(first.kg4, run.stages.kg4, run.cuts).select(*whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert run.carry.tails.count() == run.log.filter("pitch_type IS NOT NULL").select("pitcher", "game_date").distinct().count()


def test_daily_run(spark):
    old = PF.frame(spark, PF.season_log(games=3, per_game=8)).withColumn("ingest_seq", F.lit(0))
    new = old.filter("game_pk = 102").withColumn("ingest_seq", F.lit(1))
    control = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2024, 6, 1)), (5, dt.date(2020, 1, 1), None)],
                                    "pitcher long, debut date, covered_through date")
    refused = spark.createDataFrame([(1, "too short")], "pitcher long, error string")
    run = daily.run(old, new, control, control.select("pitcher"), "2025-01-01", fit=lambda kg4: refused)
    lines = {(r.pitcher, r.stage): r for r in run.run_log.collect()}
    assert (lines[(1, "modeling")].status, lines[(1, "modeling")].error) == ("failed", "too short")
    assert lines[(1, "feature_engineering")].rows == run.stages.kg4.count()
    assert lines[(5, "download")].error == daily.NO_ROWS and (5, "cleaning") not in lines
    assert lines[(2, "download")].error == daily.STRANGE
    # the log of pitchers nobody asked for is still there
    assert run.log.filter("pitcher = 2").count() == old.filter("pitcher = 2").count() > 0
    assert run.log.filter("pitcher = 1 AND game_pk = 102 AND ingest_seq = 0").count() == 0


def test_a_failed_fetch_leaves_the_log_alone(spark):
    old = PF.frame(spark, PF.season_log(games=3, per_game=8)).withColumn("ingest_seq", F.lit(0))
    control = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2024, 6, 1))], "pitcher long, debut date, covered_through date")
    lost = spark.createDataFrame([(1, "timeout")], "pitcher long, error string")
    run = daily.run(old, old.limit(0), control, control.select("pitcher"), "2025-01-01", failures=lost)
    assert run.log.exceptAll(old).count() == 0 and run.log.count() == old.count()
    assert run.covered.first().covered_through == dt.date(2024, 6, 1)
    assert [(r.error, r.status) for r in run.run_log.filter("stage = 'download'").collect()] == [("timeout", "failed")]
    assert run.run_log.filter("stage = 'modeling'").count() == 0


# --- models -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def kg4(spark):
    built = stages.build(PF.frame(spark, PF.season_log(games=5, per_game=20)))
    return stages.published(built.kg4).persist()


def test_columns_come_from_the_schema(kg4):
    cols = L.feature_columns(L.prepare_log(kg4))
    assert not set(cols.all) & set(C.NOT_FEATURES)
    assert "events_of_prev_ab" in cols.text and "sz_top" in cols.numeric


def test_predictions_and_reload(spark, kg4, tmp_path):
    fitted = L.fit_forest(kg4, COLS, None, SMALL)
    rows = kg4.withColumn("count_state", F.lit("never seen")).drop("strikes")  # new category, absent column
    out = L.predict(fitted, rows)
    assert out.count() == kg4.count() and out.columns[: len(rows.columns)] == rows.columns
    r = out.first()
    assert r.model_confidence == pytest.approx(max(r.probabilities.values()))
    assert sum(r.probabilities.values()) == pytest.approx(1.0)
    assert r.model_prediction == max(sorted(r.probabilities), key=r.probabilities.get)
    wide = L.probability_columns(out, fitted.classes).first()
    assert wide["prob_FF"] == pytest.approx(r.probabilities["FF"])
    fitted.save(str(tmp_path / "m"), kg4.agg(F.count(F.lit(1)).alias("rows")))
    again = L.Fitted.load(str(tmp_path / "m"))
    assert (again.classes, again.cols, again.prepare) == (fitted.classes, COLS, fitted.prepare)
    assert spark.read.parquet(str(tmp_path / "m" / "metrics")).first().rows == kg4.count()
    assert L.predict(again, rows).first().model_prediction == r.model_prediction
    top = L.feature_importance(fitted, kg4, 3).collect()
    assert len(top) == 3 and top[0].importance >= top[-1].importance
    assert all(t.feature.startswith(("balls", "strikes", "count_state_")) for t in top)


def test_evaluation_weights_see_training_rows_only(spark):
    """A class that exists only in the newest game must not reach the evaluation weights."""
    rows = [(1, y, y, dt.date(y, 5, 1), "FF") for y in (2023, 2024, 2025) for _ in range(400)]
    rows += [(1, 2026, 2026, dt.date(2026, 5, 1), "CU")] * 400
    log = spark.createDataFrame(rows, "pitcher int, season int, game_pk int, game_date date, pitch_type string")
    from dugout.operators import split

    train = split.chronological_split(log, "pitcher", "game_pk", "game_date").filter(~F.col("is_test"))
    seen = {r.pitch_type for r in W.adjustments(train, "pitcher", "pitch_type").collect()}
    everything = {r.pitch_type for r in W.adjustments(log, "pitcher", "pitch_type").collect()}
    assert seen == {"FF"} and everything == {"FF", "CU"}


def test_train_reports_failures_and_results(spark, kg4):
    one_game = kg4.filter("pitcher = 2 AND game_pk = 100")
    log = kg4.filter("pitcher = 1").unionByName(one_game)
    trained, errors = L.train_each(log, [1, 2, 3], 2024, forest=SMALL, cols=COLS)
    assert sorted((r.pitcher, r.stage, r.error) for r in errors.collect()) == [(2, "modeling", "At least two games are required."), (3, "modeling", L.NO_ROWS)]
    m = trained.metrics.first()
    assert (m.train_games, m.test_games, m.career_games) == (4, 1, 5) and trained.metrics.count() == 1
    assert m.train_pitches + m.test_pitches == m.career_pitches
    nested = L.nested_metrics(trained.metrics, trained.forest).first()
    assert nested.evaluation.test_games == 1 and nested.random_forest.n_estimators == SMALL.trees
    assert {r.pitcher for r in trained.production.trees.select("pitcher").distinct().collect()} == {1, 2}


def test_pooled_training_names_keys_with_one_game(spark, kg4):
    log = kg4.filter("pitcher = 1").unionByName(kg4.filter("pitcher = 2 AND game_pk = 100"))
    trained = L.train(log, 2024, forest=SMALL, cols=COLS)
    assert [r.pitcher for r in trained.metrics.collect()] == [1]
    assert [(r.pitcher, r.error) for r in trained.errors.collect()] == [(2, "At least two games are required.")]


def test_more_keys_do_not_change_the_inputs_of_a_key(spark, kg4):
    some = kg4.filter("pitcher = 1")
    many = some.filter("game_pk = 100").limit(1).drop("pitcher").crossJoin(
        spark.range(5000, 5000 + 1024).select(F.col("id").cast(some.schema["pitcher"].dataType).alias("pitcher")))
    few, more = (L.train(log, 2024, forest=SMALL, cols=L.Columns([], []))
                 for log in (some, some.unionByName(many)))
    assert few.production.cols == more.production.cols and not few.production.cols.text
    own = few.shares.first()
    assert own == more.shares.filter("_key = 1").first() and abs(sum(own[1:]) - 1) < 1e-9
    assert more.shares.count() == 1024 + 1
    scored = L.predict(few.production, L.with_shares(some, few.shares))
    assert scored.filter("model_prediction IS NULL").isEmpty()


def test_replay_days_with_a_forest(spark, kg4):
    pending = kg4.filter("pitcher = 1 AND game_pk >= 103").select("pitcher", "game_pk", F.col("game_date").alias("target_date")).distinct()
    seen = []

    def fit(history):
        seen.append(history.agg(F.max("game_date")).first()[0])
        return L.forest_on_history(COLS, SMALL)(history)

    logs = dict(R.replay_days(kg4, pending, fit))
    assert len(logs) == 2 and all(last < day for last, day in zip(seen, logs))
    rows = [r for log in logs.values() for r in log.collect()]
    assert {r.game_pk for r in rows} == {103, 104} and all(r.model_confidence > 0 for r in rows)
    assert len(rows) == kg4.filter("pitcher = 1 AND game_pk >= 103").count()


def test_ablation_arms_share_one_split(spark, kg4):
    log = L.prepare_log(kg4)
    out = L.ablation(log, "pitcher", "game_pk", "game_date", L.CONTINUOUS_ARMS, L.majority_fit("pitcher"))
    row = out.first()
    assert set(out.columns) == {"pitcher", "baseline_accuracy", *[f"{a}_accuracy" for a in L.CONTINUOUS_ARMS]}
    assert row.baseline_accuracy == row.unweighted_accuracy
