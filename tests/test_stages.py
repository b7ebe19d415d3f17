import datetime as dt

import pytest
from pyspark.sql import functions as F

import pitches as P
from dugout import columns as C
from dugout import schema
from dugout.plans import increment, stages
from dugout.session import cut_lineage


@pytest.fixture(scope="module")
def rows():
    return P.season_log()


@pytest.fixture(scope="module")
def raw(spark, rows):
    return P.frame(spark, rows)


def test_widths(raw):
    built = stages.build(raw)
    assert len(raw.columns) == 119
    widths = [len(stages.published(s).columns) for s in (built.cleaned, built.kg2, built.kg3, built.kg4)]
    assert widths == [118, 90, 87, 69]
    assert stages.published(built.kg4).columns == C.KG4


def test_lists_have_the_published_lengths():
    assert (len(C.PITCH_RESULTS), len(C.PA_RESULTS)) == (41, 10)
    assert (len(C.KG2_DROPPED), len(C.KG2_ADDED), len(C.KG3_DROPPED)) == (36, 8, 22)
    assert (len(C.RATE_BUCKETS), len(C.KG4_BASE), len(C.HISTORY_TYPES)) == (19, 50, 25)


@pytest.mark.parametrize("hot_rows", [10**9, 15])
def test_stages_equal_plain_account(raw, rows, hot_rows):
    built = stages.build(raw, hot_rows)
    want = P.expected(rows)
    got = built.kg3.join(
        built.kg2.select("pitcher", "game_pk", stages.CARRIED, "pitch_number_of_ab", "p/h_hand"),
        ["pitcher", "game_pk", stages.CARRIED, "pitch_number_of_ab"],
    ).collect()
    assert len(got) == len(want)
    for r in got:
        e = want[(r.pitcher, r.game_pk, r[stages.CARRIED], r.pitch_number_of_ab)]
        assert r.at_bat_number_of_game == e["pa"]
        assert r.release_speed_of_prev_pitch == e["prev_speed"]
        assert r.description_of_prev_pitch == e["prev_description"]
        assert r.events_of_prev_ab == e["prev_events"]
        assert r.pitch_number_of_game == e["n"]
        assert r.pitch_type_of_prev_pitch == e["prev_type"]
        assert r.prior_pa_vs_pitcher_career == e["met"]
        assert r["p/h_hand"] == int(e["row"]["stand"] == "R")
        assert r.extra_1 == "kept"
        for code, rate in e["rates"].items():
            have = r[f"prev3_pitch_rate_{code}"]
            assert have == pytest.approx(rate) if rate is not None else have is None


def test_first_pitch_has_no_rates_and_unknown_code_counts_as_other(spark):
    day = dt.date(2024, 5, 1)
    rows = [P.pitch(pitcher=1, game_pk=9, game_date=day, at_bat_number=1, pitch_number=n, batter=1, pitch_type=t)
            for n, t in ((1, "ZZ"), (2, "FF"))]
    first, second = stages.build(P.frame(spark, rows)).kg4.orderBy("pitch_number_of_ab").collect()
    assert all(first[c] is None for c in C.RATE_COLUMNS)
    assert second.prev3_pitch_rate_OTHER == 1.0 and second.prev3_pitch_rate_FF == 0.0


def test_rates_cross_games_but_previous_pitch_does_not(spark):
    rows = [P.pitch(pitcher=1, game_pk=g, game_date=dt.date(2024, 5, g), at_bat_number=1, pitch_number=1, batter=1,
                    pitch_type="FF", release_speed=90.0) for g in (1, 2)]
    last = stages.build(P.frame(spark, rows)).kg4.filter("game_pk = 2").first()
    assert last.prev3_pitch_rate_FF == 1.0
    assert last.release_speed_of_prev_pitch is None and last.pitch_type_of_prev_pitch is None


def test_empty_log_keeps_its_schema(raw):
    built = stages.build(raw.limit(0))
    assert stages.published(built.kg4).columns == C.KG4 and built.kg4.count() == 0


def test_summary(raw, rows):
    s = stages.cleaning_summary(raw).first()
    gone = sum(r["pitch_type"] is None for r in rows)
    assert (s.rows_before, s.rows_after, s.rows_dropped_without_pitch_type, s.column_count) == (
        len(rows), len(rows) - gone, gone, 118)


def test_missing_column_is_refused(raw):
    with pytest.raises(schema.SchemaMismatchError, match="missing=\\['zone'\\]"):
        stages.clean(raw.drop("zone"))


def test_null_count_does_not_fail(spark):
    row = P.pitch(pitcher=1, game_pk=1, game_date=dt.date(2024, 5, 1), at_bat_number=1, pitch_number=1, batter=1,
                  pitch_type="FF", balls=None)
    out = stages.build(P.frame(spark, [row])).kg4.select("count", "count_state", F.lit(1)).first()
    assert out[0] is None and out[1] == "even_count"


# ---- a batch on top of what is stored


def test_a_batch_extends_the_stages_as_a_rebuild_would(spark):
    log = cut_lineage(P.frame(spark, P.season_log(games=6, per_game=14)))
    days = sorted(r[0] for r in log.select("game_date").distinct().collect())
    pick = F.pmod(F.xxhash64("pitcher", "game_pk", "at_bat_number", "pitch_number"), F.lit(5))
    start = F.lit(days[2])
    old = log.filter(F.col("game_date") < F.lit(days[-1]))
    # corrections from the cut on: some rows are gone, some have another type; then a new date
    new = log.filter((F.col("game_date") < start) | (pick != 1)).withColumn(
        "pitch_type", F.when((F.col("game_date") >= start) & (pick == 2), "CU").otherwise(F.col("pitch_type")))
    cuts = log.select("pitcher").distinct().withColumn("cut", start)
    first, rebuilt = stages.build(old), stages.build(new)
    batch, cuts = increment.whole_games(new, cuts)
    before = increment.carry(first.kg2)
    built = increment.extend(batch, cuts, before)
    for name in ("kg2", "kg3", "kg4"):
        want = getattr(rebuilt, name)
        got = increment.merged(getattr(first, name), getattr(built, name), cuts).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    after, want = increment.carried_on(before, built, cuts), increment.carry(rebuilt.kg2)
    for part in ("tails", "meetings"):
        assert sorted(map(str, getattr(after, part).collect())) == sorted(map(str, getattr(want, part).collect()))


def test_a_game_over_the_cut_moves_the_cut(spark):
    day = lambda n: dt.date(2026, 5, n)
    log = spark.createDataFrame([(1, 10, day(1)), (1, 11, day(2)), (1, 11, day(4)), (1, 12, day(3)), (1, 12, day(5)), (2, 20, day(1))],
                                "pitcher bigint, game_pk bigint, game_date date")
    rows, moved = increment.whole_games(log, spark.createDataFrame([(1, day(5))], "pitcher bigint, cut date"))
    assert moved.first().cut == day(2) and sorted(r.game_pk for r in rows.collect()) == [11, 11, 12, 12]


@pytest.mark.parametrize("hot_rows", [10**9, 2])
def test_the_batter_of_an_appearance_is_that_of_the_sql(spark, hot_rows):
    """Original numbers more than a million apart outweigh a step of the pitch number."""
    day = dt.date(2023, 4, 1)
    at = dict(pitcher=1, game_pk=9, game_date=day, pitch_type="FF")
    rows = [P.pitch(at_bat_number=100, pitch_number=3, batter=1, **at),
            P.pitch(at_bat_number=1_500_000, pitch_number=2, batter=2, **at),
            P.pitch(at_bat_number=1_500_001, pitch_number=1, batter=2, **at),
            P.pitch(at_bat_number=1_500_002, pitch_number=1, batter=1, **at)]
    built = stages.build(P.frame(spark, rows), hot_rows)
    met = {r.at_bat_number_of_game: r.prior_pa_vs_pitcher_career for r in built.kg2.collect()}
    assert met == {0: 0, 1: 0, 2: 1}
    meetings = {r.party: r.appearances for r in increment.carry(built.kg2).meetings.collect()}
    assert meetings == {1: 2, 2: 1}
