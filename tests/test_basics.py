"""Scalars, schema contracts, weights, splits, history."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from dugout import columns as C
from dugout import schema
from dugout.functions import scalar as S
from dugout.operators import baselines as B
from dugout.operators import evaluation as E
from dugout.operators import history as H
from dugout.operators import report as R
from dugout.operators import split as P
from dugout.operators import weights as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- scalars ----------------------------------------------------------------------------------
@pytest.mark.parametrize("balls, strikes, state", [
    (0, 0, "even_count"), (0, 2, "put_away_count"), (2, 0, "hitters_count"), (1, 0, "pitcher_behind"),
    (0, 1, "pitcher_ahead"), (3, 2, "full_count"), (1, 1, "even_count"), (3, 1, "hitters_count"), (None, 1, "even_count"),
])
def test_count_state(spark, balls, strikes, state):
    assert one(spark, S.count_state(F.lit(balls).cast("int"), F.lit(strikes).cast("int"))) == state


@pytest.mark.parametrize("text, value", [("12", 12), (" 12 ", 12), ("12.0", 12), ("x", None), ("", None), (None, None),
                                         ("9007199254740993", 9007199254740993)])
def test_to_number(spark, text, value):
    assert one(spark, S.to_number(F.lit(text).cast("string"), "bigint")) == value


def test_must_be_number_raises(spark):
    with pytest.raises(Exception, match="not a number: x"):
        spark.range(1).select(S.must_be_number(F.lit("x"))).collect()


@pytest.mark.parametrize("status, final", [("Final", True), (" final: tied", True), ("Game Over", True), ("completed", True),
                                           ("Completed Early: Rain", False), ("In Progress", False), (None, False)])
def test_is_final(spark, status, final):
    assert one(spark, S.is_final(F.lit(status).cast("string"))) is final


def test_decay(spark):
    assert one(spark, S.decay_factor(F.lit(1))) == pytest.approx(0.98)
    assert one(spark, S.decay_factor(F.lit(5))) == pytest.approx(0.94)
    assert one(spark, S.decay_factor(F.lit(40))) == pytest.approx(0.80)
    with pytest.raises(Exception, match="at least one season"):
        spark.range(1).select(S.decay_factor(F.lit(0))).collect()


def test_recency_weight_floor_and_future(spark):
    assert one(spark, S.recency_weight(F.lit(2000), F.lit(2026), F.lit(0.8))) == pytest.approx(0.10)
    assert one(spark, S.recency_weight(F.lit(2027), F.lit(2026), F.lit(0.8))) == 1.0


def test_relative_improvement(spark):
    assert one(spark, S.relative_improvement(F.lit(0.75), F.lit(0.5))) == pytest.approx(0.5)
    assert one(spark, S.relative_improvement(F.lit(0.75), F.lit(0.0))) is None


# --- schema -----------------------------------------------------------------------------------
def test_canonical_reorders_and_refuses(spark):
    df = spark.createDataFrame([(1, "2024", "FF")], ' pitcher long, `"game_date"` string, `pitch_type ` string')
    want = ["pitch_type", "game_date", "pitcher"]
    assert schema.canonical(df, want, "t").columns == want
    with pytest.raises(schema.SchemaMismatchError, match="missing=\\['zone'\\]; extra=\\['pitcher'\\]"):
        schema.canonical(df, ["pitch_type", "game_date", "zone"], "t")
    with pytest.raises(schema.SchemaMismatchError, match="duplicates"):
        schema.canonical(spark.createDataFrame([(1, 2)], "`a` int, `a ` int"), ["a"], "t")
    with pytest.raises(schema.SchemaMismatchError):
        schema.check_order(df, want, "t")


def test_require_keys(spark):
    batch = spark.createDataFrame([(1,), (None,), (2,)], "pitcher int")
    schema.require_keys(batch, spark.createDataFrame([(1,), (2,)], "pitcher int"), "pitcher")
    with pytest.raises(ValueError, match="\\[2\\]"):
        schema.require_keys(batch, spark.createDataFrame([(1,)], "pitcher int"), "pitcher")


# --- weights ----------------------------------------------------------------------------------
def usage(spark, prior_ff, prior_sl, recent_ff, recent_sl, scale=10):
    rows = ([(1, 2025, "FF")] * prior_ff + [(1, 2025, "SL")] * prior_sl
            + [(1, 2026, "FF")] * recent_ff + [(1, 2026, "SL")] * recent_sl)
    df = spark.createDataFrame(rows, "pitcher int, season int, pitch_type string")
    return df.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(scale)))).drop("_")


def weights_by(spark, df):
    out = W.training_weights(df, "pitcher", "pitch_type", recency=None)
    return {(r.season, r.pitch_type): r.w for r in out.groupBy("season", "pitch_type").agg(F.max("weight").alias("w")).collect()}


def test_stable_usage_changes_nothing(spark):
    assert set(weights_by(spark, usage(spark, 50, 50, 50, 50)).values()) == {1.0}


def test_shift_lowers_old_and_raises_recent(spark):
    w = weights_by(spark, usage(spark, 80, 20, 20, 80))
    assert w[(2025, "FF")] == pytest.approx(0.21 / 0.81) and w[(2026, "FF")] == 1.0
    assert w[(2026, "SL")] == pytest.approx(1.5) and w[(2025, "SL")] == 1.0


def test_bounds(spark):
    w = weights_by(spark, usage(spark, 99, 1, 1, 99))
    assert min(w.values()) == pytest.approx(0.15) and max(w.values()) == pytest.approx(1.5)


@pytest.mark.parametrize("df_args", [(200, 200, 20, 20, 1), (0, 0, 50, 50, 10)])
def test_too_little_data_has_no_rows_and_weight_one(spark, df_args):
    df = usage(spark, *df_args)
    assert W.adjustments(df, "pitcher", "pitch_type").count() == 0
    assert set(weights_by(spark, df).values()) == {1.0}


@pytest.mark.parametrize("recent, multiplier", [(18, 0.90), (12, 0.62), (5, 0.29), (0, 0.15)])
def test_decline_multiplier(spark, recent, multiplier):
    table = W.adjustments(usage(spark, 80, 20, 100 - recent, recent), "pitcher", "pitch_type")
    row = table.filter("pitch_type = 'SL'").first()
    assert row.old_multiplier == pytest.approx(multiplier, abs=0.006)
    assert row.status == ("nearly_inactive" if recent == 0 else "declining")


def test_gated_ignores_small_moves(spark):
    df = usage(spark, 80, 20, 85, 15)
    assert {r.status for r in W.adjustments(df, "pitcher", "pitch_type", W.GATED).collect()} == {"stable"}
    gone = W.adjustments(usage(spark, 80, 20, 100, 0), "pitcher", "pitch_type", W.GATED)
    assert gone.filter("pitch_type = 'SL'").first().status == "inactive"


def test_categorical(spark):
    gone = usage(spark, 80, 20, 100, 0)
    row = W.categorical_adjustments(gone, "pitcher", "pitch_type").filter("pitch_type = 'SL'").first()
    assert (row.status, row.old_multiplier) == ("inactive", 0.10)
    alone = W.categorical_adjustments(usage(spark, 0, 0, 50, 50), "pitcher", "pitch_type").collect()
    assert {r.status for r in alone} == {"insufficient_history"} and {r.recent_usage for r in alone} == {0.5}
    small = W.categorical_adjustments(usage(spark, 200, 200, 20, 20, 1), "pitcher", "pitch_type").collect()
    assert {r.status for r in small} == {"insufficient_recent_data"}


def test_peak_finds_what_pooled_usage_misses(spark):
    # a pitch used only three reliable seasons ago
    rows = [(1, y, "FF") for y in (2022, 2023, 2024, 2025) for _ in range(400)] + [(1, 2022, "SL")] * 100
    df = spark.createDataFrame(rows, "pitcher int, season int, pitch_type string")
    by_peak = W.categorical_adjustments(df, "pitcher", "pitch_type").filter("pitch_type = 'SL'").first()
    by_prior = W.categorical_adjustments(df, "pitcher", "pitch_type", W.CATEGORICAL_PRIOR).filter("pitch_type = 'SL'").first()
    assert (by_peak.status, by_prior.status) == ("inactive", "stable")


def test_status_text(spark):
    table = W.adjustments(usage(spark, 80, 20, 20, 80), "pitcher", "pitch_type")
    row = W.status_text(table, "pitcher", "pitch_type", multipliers=True).first()
    assert row.summary == "FF:declining(old=0.26,new=1.00); SL:increasing(old=1.00,new=1.50)"
    assert row.declining_classes == "FF" and row.emerging_classes == ""


# --- splits and baselines -----------------------------------------------------------------------
@pytest.mark.parametrize("n, test", [(2, 1), (3, 1), (5, 1), (6, 2), (35, 7), (36, 8), (100, 20)])
def test_number_of_test_games(spark, n, test):
    assert test == min(max(1, math.ceil(n * 0.2)), n - 1)
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("d"))
    out = P.chronological_games(df, "k", "id", "d")
    assert out.filter("is_test").count() == test
    assert out.filter("is_test").agg(F.min("id")).first()[0] == n - test


def test_game_order_of_a_hot_key(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("g"), F.expr("date_add(DATE'2024-01-01', CAST(id * 7 % 100 AS INT))").alias("d"))
    plain, cut = (sorted(tuple(r) for r in P.game_order(df, "k", "g", "d", h).collect()) for h in (10**9, 20))
    assert plain == cut and len(plain) == 300


def test_expected_accuracy(spark):
    rows = [(1, "A", False)] * 3 + [(1, "B", False)] + [(1, "A", True), (1, "C", True)] + [(2, "A", True)]
    df = spark.createDataFrame(rows, "k int, c string, is_test boolean")
    out = {r.k: r.expected_accuracy for r in B.expected_stratified_accuracy(df, ["k"], "c").collect()}
    assert out == {1: pytest.approx(0.375), 2: 0.0}


def test_one_game_is_an_error_row(spark):
    df = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1)), (2, 1, dt.date(2024, 1, 1)), (2, 2, dt.date(2024, 1, 2))], "k int, g int, d date")
    assert [r.k for r in P.unsplittable(P.chronological_games(df, "k", "g", "d"), "k").collect()] == [1]
    assert {r.k for r in P.chronological_split(df, "k", "g", "d").collect()} == {2}


def test_sample_replaces_failed(spark):
    df = spark.range(50)
    first = [r.id for r in P.sample_entities(df, "id", 5, 1).collect()]
    ok = df.filter(F.col("id") != first[0])
    again = [r.id for r in P.sample_entities(df, "id", 5, 1, ok).collect()]
    assert again[:4] == first[1:] and len(again) == 5


def test_stratified_frequencies_and_unknown_keys(spark):
    train = spark.range(1000).select(F.lit(1).alias("k"), F.when(F.col("id") < 700, "A").otherwise("B").alias("c"))
    rows = spark.range(5000).select(F.lit(1).alias("k"), "id").union(spark.range(3).select(F.lit(2), "id"))
    out = B.stratified(rows, B.class_ranges(train, ["k"], "c"), ["k"], "c", ["id"])
    n = {(r.k, r.baseline_prediction): r["count"] for r in out.groupBy("k", "baseline_prediction").count().collect()}
    assert n[(2, None)] == 3 and n[(1, "A")] + n[(1, "B")] == 5000 and abs(n[(1, "A")] - 3500) < 150


def test_majority_prefers_first_of_equals(spark):
    df = spark.createDataFrame([(1, "B"), (1, "A")], "k int, c string").withColumn("w", F.lit(0.5))
    assert B.majority(df, ["k"], "c").first().c == "A"
    assert B.weighted_majority(df, ["k"], "c", "w").first().c == "A"


def test_weighted_majority_of_many_equal_rows(spark):
    # added one by one 3999 times 0.98 is 3919.020000000067, added in two halves 3919.020000000061
    many = spark.range(0, 3999, 1, 1).withColumn("c", F.lit("B")).select("c", F.lit(0.98).alias("w"))
    halves = spark.range(0, 3999, 1, 2).withColumn("c", F.lit("A")).select("c", F.lit(0.98).alias("w"))
    df = many.unionByName(halves).withColumn("k", F.lit(1))
    got = B.weighted_majority(df, ["k"], "c", "w").first()
    assert (got.c, got.total_weight) == ("A", 3919.02)


# --- reports ------------------------------------------------------------------------------------
def test_breadth(spark):
    rows = [("g", "FF", True)] * 5 + [("g", "SL", True)] + [("g", "SL", False)] * 5 + [("h", "CH", True)] * 3 + [("h", "FF", True)] * 3
    df = spark.createDataFrame(rows, "g string, p string, ok boolean")
    assert {r.g: r.breadth for r in E.breadth(df, ["g"], "p", "ok").collect()} == {"g": 1, "h": 2}


def test_last_dates_keeps_whole_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-02",)], "game_date string")
    assert R.last_dates(df, 1).count() == 2 and R.last_dates(df, 9).count() == 3


def test_day_without_success_has_null_rates(spark):
    df = spark.createDataFrame([("failed", None, None, None)], "replay_status string, pitch_count int, model_correct int, baseline_correct int")
    row = R.day_status(df).first()
    assert (row.failed, row.total_pitches, row.model_accuracy, row.relative_improvement) == (1, 0, None, None)


def test_showcase_skips_narrow_outings(spark):
    games = spark.createDataFrame([(1, 90, 0.9), (2, 90, 0.5), (3, 20, 1.0)], "g int, pitch_count int, model_accuracy double")
    logs = spark.createDataFrame(
        [(1, "FF", True)] * 80 + [(2, c, True) for c in ("FF", "SL", "CH") for _ in range(3)] + [(3, c, True) for c in ("FF", "SL", "CH") for _ in range(5)],
        "g int, model_prediction string, model_correct boolean",
    )
    assert [r.g for r in R.showcase(games, logs, ["g"]).collect()] == [2]


# --- history ------------------------------------------------------------------------------------
def history(spark, rows):
    base = {c: None for c in C.HISTORY_TYPES}
    ddl = ", ".join(f"{c} string" for c in C.HISTORY_TYPES)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in C.HISTORY_TYPES) for r in rows], ddl)


def test_record_is_safe_to_rerun(spark):
    a = history(spark, [{"game_date": "2024-05-01", "game_pk": "1.0", "pitcher_id": "7", "pitch_count": "80", "evaluated_at_utc": "a"}])
    b = history(spark, [{"game_date": "2024-05-01", "game_pk": "1", "pitcher_id": "7", "pitch_count": "81", "evaluated_at_utc": "b"}])
    once = H.record(a, b)
    assert H.record(once, b).collect() == once.collect()
    row = once.first()
    assert (row.game_pk, row.pitch_count, row.season) == (1, "81", 2024)


def test_history_drops_bad_rows_and_sorts(spark):
    h = history(spark, [
        {"game_date": "2024-05-02", "game_pk": "2", "pitcher_id": "1"}, {"game_date": "bad", "game_pk": "3", "pitcher_id": "1"},
        {"game_date": "2024-05-01", "game_pk": None, "pitcher_id": "1"}, {"game_date": "2024-05-01", "game_pk": "9", "pitcher_id": "1"},
    ])
    out = H.sorted_history(H.normalize_history(h)).collect()
    assert [r.game_pk for r in out] == [9, 2] and out[0].game_date == "2024-05-01"


def test_ranges_and_chunks(spark):
    control = spark.createDataFrame(
        [(1, dt.date(2001, 1, 1), None), (2, dt.date(2015, 1, 1), dt.date(2024, 4, 30)), (3, dt.date(2024, 6, 1), None)],
        "pitcher int, debut date, covered_through date",
    )
    out = {r.pitcher: r for r in H.request_ranges(control, "2024-04-30").collect()}
    assert out[1].request_start == dt.date(2008, 3, 25)
    assert out[2].request_start == dt.date(2024, 4, 24)
    assert not out[3].needed
    chunks = H.date_chunks(H.request_ranges(control, "2024-04-30"), "request_start", "request_end").filter("pitcher = 1").orderBy("chunk_start").collect()
    assert chunks[0].chunk_start == dt.date(2008, 3, 25) and chunks[-1].chunk_end == dt.date(2024, 4, 30)
    assert all((b.chunk_start - a.chunk_end).days == 1 for a, b in zip(chunks, chunks[1:]))
    assert all((c.chunk_end - c.chunk_start).days <= 2189 for c in chunks)


def test_refresh_takes_corrections_and_removals(spark):
    ddl = "pitcher int, game_pk int, at_bat_number int, pitch_number int, game_date date, v string, ingest_seq int"
    d = dt.date
    old = spark.createDataFrame([(1, 1, 1, 1, d(2024, 1, 1), "keep", 0), (1, 2, 1, 1, d(2024, 1, 9), "wrong", 0),
                                 (1, 2, 1, 2, d(2024, 1, 9), "gone", 0), (2, 3, 1, 1, d(2024, 1, 9), "other", 0)], ddl)
    new = spark.createDataFrame([(1, 2, 1, 1, d(2024, 1, 9), "first", 1), (1, 2, 1, 1, d(2024, 1, 9), "fixed", 2)], ddl)
    ranges = spark.createDataFrame([(1, d(2024, 1, 5), True), (2, d(2024, 1, 5), False)], "pitcher int, request_start date, needed boolean")
    assert sorted(r.v for r in H.overlap_refresh(old, new, ranges).collect()) == ["fixed", "keep", "other"]


def test_single_match(spark):
    df = spark.range(3)
    assert H.single_match(df, F.col("id") == 1, "x").first().id == 1
    with pytest.raises(LookupError, match="no match"):
        H.single_match(df, F.col("id") == 9, "x")
    with pytest.raises(LookupError, match="ambiguous"):
        H.single_match(df, F.col("id") > 0, "x")


def test_scratch_goes_at_the_end_of_a_run(spark):
    from dugout import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    session.drop_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert session.cut_lineage(spark.range(3)).count() == 3
