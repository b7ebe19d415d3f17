"""What keeps the cost of a query from growing faster than its input."""

from __future__ import annotations

import os

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.plans import backtest, forward
from dugout.plans import learning as L
from dugout.session import shared_folder


# --- F24: linear_svm ----------------------------------------------------------------------------
def test_svm_fits_rows_that_are_alike_as_one(spark, monkeypatch):
    rows = spark.range(400).select(
        F.when(F.col("id") % 10 < 5, "a").when(F.col("id") % 10 < 8, "b").otherwise("c").alias("kind"),
        F.when(F.col("id") % 7 < 3, "x").otherwise("y").alias("label"),
    )
    seen, fit = [], L._fit
    monkeypatch.setattr(L, "_fit", lambda train, *a, **kw: seen.append(train.count()) or fit(train, *a, **kw))
    cols = L.Columns([], ["kind"])
    fitted = L.fit_svm(rows, cols, "label", iterations=2, penalty=0.1)
    assert seen == [6]
    # the loss is that of the single rows: penalty times squared scale is the same for every input
    penalty = fitted.model.stages[-1].getClassifier().getRegParam()
    codes = F.array(*[(F.col("kind") == c).cast("double") for c in "abc"])
    ready = rows.select(array_to_vector(codes).alias("x"), "label", "kind")
    groups = ready.groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("w"))
    single = ready.select(Summarizer.variance(F.col("x"))).first()[0].toArray()
    merged = groups.select(Summarizer.variance(F.col("x"), F.col("w"))).first()[0].toArray()
    assert penalty * merged == pytest.approx(0.1 * single)


# --- F23: pitch_log_typed -----------------------------------------------------------------------
def test_number_is_parsed_once(spark):
    rows = spark.createDataFrame([(" 7",), ("8.0",), (None,)], "x string")
    out = rows.select(S.must_be_number("x", "int").alias("x"))
    assert [r[0] for r in out.collect()] == [7, 8, None]
    trims = lambda df: df._jdf.queryExecution().analyzed().toString().count("trim(")
    assert trims(out) == trims(rows.select(S.to_number("x", "int").alias("x")))
    with pytest.raises(Exception, match="not a number: z"):
        spark.createDataFrame([("z",)], "x string").select(S.must_be_number("x", "int")).collect()


# --- F20, F22: walk_forward, walk_forward_summary -----------------------------------------------
def test_value_used_in_a_lambda_is_computed_once_per_row(spark):
    """An accumulator counts the evaluations."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def told(x):
        seen.add(1)
        return x

    rows = spark.range(0, 50, 1, 2).withColumn("ends", F.sequence(F.lit(1), F.lit(20)))
    out = rows.select(S.once(told("id"), lambda x: F.size(F.filter("ends", lambda e: e <= x))).alias("n"))
    assert sum(r[0] for r in out.collect()) == sum(min(i, 20) for i in range(50))
    assert seen.value == 50


def test_walk_forward_has_the_draw_once(spark):
    """The hash of the row stands once in the plan, and not within the lambda over the classes."""
    from dugout.operators import baselines as B

    rows = spark.range(20).select("id", F.lit("k").alias("key"), (F.col("id") % 3).cast("string").alias("label"))
    out = B.stratified(rows, B.class_ranges(rows, ["key"], "label"), ["key"], "label", ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filters = plan.split("filter(")[1:]
    assert filters and not any("md5" in f[: f.index("lambdafunction") + 80] for f in filters)


# --- F14: forest_each ---------------------------------------------------------------------------
def test_rows_of_many_keys_are_scored_together(spark):
    """The same calls when a key's trees and rows are spread over batches, and no task per key."""
    n = F.col("id")
    rows = spark.range(600).select(
        n.alias("row"), (n % 7).alias("key"), (n * 13 % 50).cast("double").alias("a"), F.concat(F.lit("t"), n % 3).alias("t"),
        F.when(n * 13 % 50 + n % 7 < 25, "x").otherwise("y").alias("pitch_type"))
    forests = L.fit_each(rows, L.Columns(["a"], ["t"]), "key", None, L.Forest(trees=5, depth=4), ["row"])
    more = rows.unionByName(rows.limit(3).withColumn("key", F.lit(99).cast("bigint")))

    def called():
        out = L.predict_each(forests, more)
        assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
        return sorted((r.key, r.row, r.model_prediction, r.probabilities and tuple(r.probabilities.items())) for r in out.collect())

    whole = called()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert called() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 603 and [c[2] for c in whole[-3:]] == [None] * 3 and all(c[2] for c in whole[:-3])


# --- F2, F3: forest_train_each, walk_forward_fitted ----------------------------------------------
def _held(folder: str) -> int:
    folder = folder.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)


@pytest.fixture(scope="module")
def noted(spark):
    """A log with a column that no model needs and that is most of its bytes."""
    n = F.col("id")
    return spark.range(20_000).select(
        F.when(n % 500 != 0, n % 5).alias("pitcher"), F.floor(n / 200).alias("game_pk"), F.date_add(F.lit("2023-01-01").cast("date"), F.floor(n / 200).cast("int")).alias("game_date"),
        n.alias("row"), F.when(n * n % 7 < 3, "a").otherwise("b").alias("pitch_type"), (n % 3).cast("double").alias("x"), F.md5(n.cast("string")).alias("note"))


ALIKE = dict(depth=2, min_leaf=2, features="all", bootstrap=False)


def test_training_keeps_the_log_once(spark, noted, tmp_path):
    noted.write.option("compression", "zstd").parquet(str(tmp_path / "log"))
    once, before = _held(str(tmp_path / "log")), _held(shared_folder(spark))
    trained = L.train(noted, 2024, forest=L.Forest(trees=1, **ALIKE), cols=L.Columns(["x"], []), row_id=["row"], each=True)
    assert _held(shared_folder(spark)) - before < 2 * once
    told = {r.pitcher: r for r in trained.metrics.collect()}
    assert sorted(told) == [0, 1, 2, 3, 4] and sum(r.career_pitches for r in told.values()) == noted.filter("pitcher is not null").count()
    assert "note" in trained.test_predictions.columns


def test_training_keeps_keys_of_one_game_for_the_production_model(spark):
    rows = [(1, g, f"2024-04-{g:02d}", i, "ab"[i % 2], 1.0) for g in (1, 2, 3) for i in range(10)] + [(2, 9, "2024-04-09", i, "c", 1.0) for i in range(25)]
    log = spark.createDataFrame(rows, "pitcher bigint, game_pk bigint, game_date string, n int, pitch_type string, one double")
    trained = L.train(log, 2024, forest=L.Forest(trees=1, **ALIKE), cols=L.Columns(["one"], []), row_id=["game_pk", "n"], each=True)
    assert [r.pitcher for r in trained.metrics.collect()] == [1] and [r.pitcher for r in trained.errors.collect()] == [2]
    assert {r.pitcher: r.rows[0] for r in trained.production.trees.collect()} == {1: 30, 2: 25}


def test_replay_keeps_the_log_once(spark, noted, tmp_path):
    noted.write.option("compression", "zstd").parquet(str(tmp_path / "log"))
    once, before = _held(str(tmp_path / "log")), _held(shared_folder(spark))
    names = backtest.Log(row_id=("row",))
    one, many = (forward.replay(noted, L.Columns(["x"], []), L.Forest(trees=n, **ALIKE), names) for n in (1, 26))
    assert _held(shared_folder(spark)) - before < 2 * 2 * once
    # trees of several tasks are added, and here all are alike
    a, b = ({r.row: (r.note, r.model_prediction, r.probabilities) for r in x.collect()} for x in (one, many))
    assert a == b and len(a) == 20_000
    assert {r for r, (_, call, _) in a.items() if call is None} == {r for r in range(20_000) if r % 500 == 0 or r < 400}
