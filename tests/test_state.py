"""Versioned tables and the day flow: moved rows, rival writers, runs that break off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dugout.plans import backtest as R
from dugout.plans import day as D
from dugout.sources import readers, sinks, storage, versions

HISTORY = "game_date string, game_pk int, pitcher_id int, pitch_count int, evaluated_at_utc string"


def batch(spark, *rows):
    return spark.createDataFrame([(d, g, 7, n, at) for d, g, n, at in rows], HISTORY)


def held(spark, path, version=None):
    return sorted((r.game_date, r.game_pk, r.pitch_count) for r in readers.read_history(spark, path, version=version).collect())


def test_a_moved_row_leaves_its_month_and_an_empty_month_is_gone(spark, tmp_path):
    path = str(tmp_path / "history")
    assert readers.read_history(spark, path).count() == 0
    assert sinks.store_history(batch(spark, ("2026-03-30", 1, 10, "a"), ("2026-05-01", 2, 20, "a")), path) == 1
    assert sinks.store_history(batch(spark, ("2026-04-02", 1, 11, "b")), path) == 2
    assert held(spark, path) == [("2026-04-02", 1, 11), ("2026-05-01", 2, 20)]
    assert sorted(versions.manifest(spark, path)[1]) == ["2026-04", "2026-05"]
    assert held(spark, path, 1) == [("2026-03-30", 1, 10), ("2026-05-01", 2, 20)]
    may = versions.manifest(spark, path, 1)[1]["2026-05"]
    assert versions.manifest(spark, path, 2)[1]["2026-05"] == may  # a month left alone is not written again
    sinks.store_history(batch(spark, ("2026-05-01", 2, 21, "c")), path)
    versions.vacuum(spark, path, keep=1)
    assert versions.numbers(spark, path) == [3] and held(spark, path) == [("2026-04-02", 1, 11), ("2026-05-01", 2, 21)]
    assert not storage.exists(spark, f"{path}/{may}")
    with pytest.raises(LookupError):
        readers.read_history(spark, path, version=1)


def test_versions_of_a_history_meet_by_shuffle(spark):
    """A row per game must not go through the driver."""
    from dugout import registry

    registry.load_all()
    out = registry.QUERIES["history_versions"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    sinks.store_history(batch(spark, ("2026-03-30", 1, 10, "a")), path)
    record, rivals = sinks.H.record, [batch(spark, ("2026-03-31", 2, 20, "b"))]

    def interrupted(old, new):
        if rivals:
            sinks.store_history(rivals.pop(), path)  # commits between the first writer's read and its commit
        return record(old, new)

    monkeypatch.setattr(sinks.H, "record", interrupted)
    assert sinks.store_history(batch(spark, ("2026-03-29", 3, 30, "b")), path) == 3
    assert [r[1] for r in held(spark, path)] == [3, 1, 2]
    assert len(storage.names(spark, f"{path}/data")) == 3  # the folder of the failed attempt is gone


def test_rows_of_a_part_that_is_not_rewritten_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1)], "p string, n int")
    with pytest.raises(ValueError, match="not rewritten"):
        versions.update(spark, str(tmp_path / "t"), "p string, n int", F.col("p"), lambda read: (["y"], rows))
    assert versions.manifest(spark, str(tmp_path / "t")) == (0, {})


NAMES = R.Log(row_id=("row",))


@pytest.fixture(scope="module")
def season(spark):
    rows = [(100 * p + 10 * g + i, p, 10 * p + g, dt.date(2026, 4, 1) + dt.timedelta(days=5 * g), "FF" if i % 3 else "SL")
            for p, games in ((1, 4), (2, 4), (3, 2), (4, 1)) for g in range(4 - games, 4) for i in range(9)]
    return spark.createDataFrame(rows, "row int, pitcher bigint, game_pk bigint, game_date date, pitch_type string")


@pytest.fixture(scope="module")
def schedule(spark):
    team = lambda n: {"team": {"id": n, "name": f"T{n}"}}
    games = [(13, 1, "Final"), (23, 2, "Final"), (33, 3, "Final"), (43, 4, "Final"), (99, 1, "Final"), (98, 2, "In Progress")]
    listed = [{"gamePk": g, "officialDate": "2026-04-16", "gameDate": "t", "status": {"detailedState": s},
               "teams": {"away": {**team(1), "probablePitcher": {"id": p, "fullName": f"P{p}"}}, "home": team(2)}} for g, p, s in games]
    return spark.createDataFrame([([{"games": listed}],)], readers.SCHEDULE_DDL)


def statuses(day):
    return {(r.game_pk, r.pitcher_id): (r.replay_status, r.pitch_count) for r in day.statuses.collect()}


WANT = {(13, 1): ("success", 9), (23, 2): ("success", 9), (33, 3): ("failed", None), (43, 4): ("failed", None),
        (99, 1): ("statcast_not_ready", None), (98, 2): ("game_not_final", None)}
AT = lambda: F.timestamp_seconds(F.lit(0))


def test_a_day_from_schedule_to_history(spark, season, schedule, tmp_path):
    root = str(tmp_path / "store")
    assert D.stored(spark, root, "2026-04-16") is None
    day = D.replay(schedule, season, "2026-04-16", root, NAMES, evaluated_at=AT())
    assert statuses(day) == WANT
    summary = day.summary.first()
    assert (summary.starter_records, summary.successful, summary.failed, summary.statcast_not_ready, summary.game_not_final) == (6, 2, 2, 1, 1)
    assert summary.total_pitches == 18 == day.predictions.count() and summary.model_correct == 12
    history = {r.game_pk: r for r in readers.read_history(spark, f"{root}/history").collect()}
    assert set(history) == {13, 23} and history[13].pitcher_name == "P1" and history[13].training_cutoff == "2026-04-15"
    again = D.replay(schedule, season, "2026-04-16", root, NAMES)
    assert (again.folder, again.history_version) == (day.folder, 1) and versions.numbers(spark, f"{root}/history") == [1]
    forced = D.replay(schedule, season, "2026-04-16", root, NAMES, force=True, evaluated_at=AT())
    assert forced.folder != day.folder and statuses(forced) == WANT
    assert D.stored(spark, root, "2026-04-16").folder == forced.folder
    assert readers.read_history(spark, f"{root}/history").count() == 2


@pytest.mark.parametrize("broken", ["day_rows", "store_history", "create"])
def test_a_day_that_breaks_off_is_run_again(spark, season, schedule, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "store")
    place = {"day_rows": D.R, "store_history": D.sinks, "create": D.storage}[broken]
    whole, calls = getattr(place, broken), []

    def fails(*a, **kw):
        if broken == "create" and "/days/" not in a[1]:
            return whole(*a, **kw)
        calls.append(1)
        raise OSError("broke off")

    monkeypatch.setattr(place, broken, fails)
    with pytest.raises(OSError):
        D.replay(schedule, season, "2026-04-16", root, NAMES, evaluated_at=AT())
    assert calls and D.stored(spark, root, "2026-04-16") is None
    monkeypatch.setattr(place, broken, whole)
    day = D.replay(schedule, season, "2026-04-16", root, NAMES, evaluated_at=AT())
    assert statuses(day) == WANT and day.summary.count() == 1
    assert sorted(r.game_pk for r in readers.read_history(spark, f"{root}/history").collect()) == [13, 23]


def test_a_day_with_a_fitted_model(spark, season, schedule, tmp_path):
    def fit(history):
        seen = history.agg(F.max("game_date")).first()[0]
        assert seen < dt.date(2026, 4, 16)
        return lambda rows: rows.withColumn("model_prediction", F.lit("SL"))

    day = D.replay(schedule, season, "2026-04-16", str(tmp_path / "store"), NAMES, fit)
    assert day.summary.first().model_correct == 6


def test_many_days_read_schedule_and_log_once(spark, season, schedule, tmp_path, monkeypatch):
    """Days of a prepared schedule are those replayed one by one, with a game that was resumed and with rows and starters that repeat."""
    games = schedule.first().asDict(recursive=True)["dates"][0]["games"]
    other = [{**g, "officialDate": "2026-04-11", "gamePk": n} for g, n in zip(games, (13, 22, 23, 43, 97, 96))]
    several = spark.createDataFrame([([{"games": games + other + games[:1]}],)], readers.SCHEDULE_DDL)
    log = season.union(season.filter("game_pk = 13 and row % 2 = 0")).union(season.filter("game_pk = 12").withColumn("game_pk", F.lit(None).cast("bigint")))
    read, passes, plain = [], spark.sparkContext.accumulator(0), readers.starters

    @F.udf("bigint")
    def counted(x):
        passes.add(1)
        return x

    dates = ("2026-04-11", "2026-04-16")
    want = [D.replay(several, log, d, str(tmp_path / "one"), NAMES, evaluated_at=AT()) for d in dates]
    monkeypatch.setattr(readers, "starters", lambda s: read.append(1) or plain(s))
    days = D.prepared(several, log.withColumn("row", counted("row")), NAMES)
    assert passes.value <= log.count()
    got = [D.replay(several, log, d, str(tmp_path / "many"), NAMES, evaluated_at=AT(), days=days) for d in dates]
    assert len(read) == 1
    for a, b in zip(want, got):
        for part in ("predictions", "statuses", "summary"):
            x, y = getattr(a, part), getattr(b, part)
            assert x.columns == y.columns and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert got[0].predictions.count() == 23 and got[1].summary.first().total_pitches == 23
