"""Spark ML operators, on inputs for which SQL knows the exact answer.

A single deep tree without bootstrap on one categorical input has the weighted class shares of each
category in its leaves; an unpenalised logistic regression predicts the largest share; linear and
boosted classifiers give back a label that is a function of the category. The full-width forest on
all inputs of the feature log is checked row by row for what holds of any forest.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dugout.operators import quantiles as Q
from dugout.operators import split as P
from dugout.operators import weights as W
from dugout import columns as C
from dugout.plans import boosting
from dugout.plans import learning as L
from dugout.plans import stages
from dugout.registry import query
from dugout.registry import splits as S
from dugout.registry import stages as G
from dugout.registry import weights as X
from dugout.registry.logs import EVENT_CLASSES, event_log, pitch_log, sales_log
from dugout.session import cut_lineage, scratch_path

# settings of the models below, one value each
EXACT = L.Forest(trees=1, depth=30, min_leaf=1, features="all", bootstrap=False)
WIDE = L.Forest(trees=20, depth=10)
ROUNDS = 5
BOOSTING = boosting.Boosting(rounds=ROUNDS, rate=0.3, depth=3)
SVM_ROUNDS = 30
STUMP = L.Forest(trees=1, depth=1, features="all", bootstrap=False)
EACH = L.Forest(trees=12, depth=6)
ROW = ["game_pk", "pitcher", "at_bat_number_of_game", "pitch_number_of_ab"]


def _outcomes(spark, sf):
    """Events with an outcome: six in ten have that of their own type, the others that of a view."""
    return event_log(spark, sf).select(
        "event_id", F.col("pitch_type").alias("kind"), F.col("value"), (F.col("event_id") % 10).alias("digit"),
        F.lit(1.0).alias("constant"), (1.0 + F.col("event_id") % 3).alias("weight"),
        F.concat(F.lit("after "), F.when(F.col("event_id") * 7 % 10 < 6, F.col("pitch_type")).otherwise("view")).alias("pitch_type"),
        F.concat(F.lit("after "), F.col("pitch_type")).alias("certain"),
        F.when(F.col("event_id") % 10 < 4, "low").otherwise("high").alias("half"),
    )


KIND = L.Columns([], ["kind"])
_OUTCOMES = """rows AS (
  SELECT event_id, event_type AS kind, event_id % 10 AS digit, 1.0::DOUBLE + event_id % 3 AS weight,
         'after ' || CASE WHEN event_id * 7 % 10 < 6 THEN event_type ELSE 'view' END AS pitch_type FROM events)"""


def _calls(weight: str = "weight", where: str = "true", by: str = "kind") -> str:
    """The class of the largest weighted share of each category, and the share."""
    return f"""shares AS (SELECT {by}, pitch_type, sum({weight}) AS w FROM rows WHERE {where} GROUP BY ALL),
calls AS (SELECT {by}, pitch_type AS guess, w / sum(w) OVER (PARTITION BY {by}) AS share FROM shares
          QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY w DESC, pitch_type) = 1)"""


def _kg4(spark, sf):
    return cut_lineage(stages.published(stages.build(pitch_log(spark, sf)).kg4))


@query("fill_constants", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, -999.0::DOUBLE) AS value,
       coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'Missing') AS kind FROM events""")
def fill_constants(spark, sf):
    rows = event_log(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("pitch_type") != "error", F.col("pitch_type")).alias("kind"),
    )
    return L.impute_constants(rows, L.Columns(["value"], ["kind"]))


@query("one_hot", f"""
SELECT event_id, {", ".join(f"CASE WHEN event_type = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{c}" for c in EVENT_CLASSES)} FROM events""")
def one_hot(spark, sf):
    from pyspark.ml import Pipeline

    rows = event_log(spark, sf).select("event_id", "pitch_type")
    cols = L.Columns([], ["pitch_type"])
    out = Pipeline(stages=L._encoding(cols)).fit(rows).transform(rows)
    codes = vector_to_array("_oh_pitch_type")
    return out.select("event_id", *[codes[i].alias(f"is_{c}") for i, c in enumerate(EVENT_CLASSES)])


@query("standardize", """
WITH gaps AS (SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN value END AS value FROM events),
filled AS (SELECT event_id, coalesce(value, (SELECT median(value) FROM gaps)) AS value FROM gaps)
SELECT event_id, round((value - (SELECT avg(value) FROM filled)) / (SELECT stddev_samp(value) FROM filled), 6) AS scaled FROM filled""")
def standardize(spark, sf):
    """Gaps get the exact median, then numbers are centred and scaled."""
    from pyspark.ml import Pipeline

    rows = event_log(spark, sf).select("event_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("value"))
    out = Pipeline(stages=L._linear_encoding(L.Columns(["value"], []), rows)).fit(rows).transform(rows)
    return out.select("event_id", F.round(vector_to_array("_features")[0], 6).alias("scaled"))


@query("align_columns", """
SELECT event_id, value, CAST(NULL AS DOUBLE) AS absent_number, event_type AS pitch_type, CAST(NULL AS VARCHAR) AS absent_text FROM events""")
def align_columns(spark, sf):
    cols = L.Columns(["value", "absent_number"], ["pitch_type", "absent_text"])
    return L.align(event_log(spark, sf), cols, ["event_id"])


@query("feature_label_split", """
SELECT event_id AS x_event_id, value AS x_value, event_type AS pitch_type FROM events""")
def feature_label_split(spark, sf):
    log = event_log(spark, sf).select("event_id", "value", "pitch_type", F.col("pitcher"), F.year("ts").alias("season"))
    cols = L.feature_columns(log)
    return log.select(*[F.col(c).alias(f"x_{c}") for c in cols.all], "pitch_type")


_AFTER = [f"after {c}" for c in EVENT_CLASSES]


@query("forest_predictions", f"""
WITH {_OUTCOMES}, {_calls(where="event_id % 7 <> 0")}
SELECT event_id, pitch_type, guess AS model_prediction, round(share, 9) AS model_confidence,
       {", ".join(f"coalesce((SELECT round(s.w / sum(t.w), 9) FROM shares s JOIN shares t ON t.kind = s.kind WHERE s.kind = rows.kind AND s.pitch_type = '{c}' GROUP BY s.w), 0.0::DOUBLE) AS \"prob_{c}\"" for c in _AFTER)}
FROM rows JOIN calls USING (kind) WHERE event_id % 7 = 0""")
def forest_predictions(spark, sf):
    """Weighted shares as a tree finds them."""
    rows = cut_lineage(_outcomes(spark, sf))
    fitted = L.fit_forest(rows.filter("event_id % 7 <> 0"), KIND, "weight", EXACT)
    out = L.predict(fitted, rows.filter("event_id % 7 = 0").select("event_id", "kind", "pitch_type"))
    out = L.probability_columns(out.drop("kind"), fitted.classes)
    return out.select("event_id", "pitch_type", "model_prediction",
                      *[F.round(c, 9).alias(c) for c in ("model_confidence", *[f"prob_{c}" for c in _AFTER])])


@query("forest_invariants", f"""
WITH {G._KG3_SQL} SELECT pitcher, game_pk, at_bat_number_of_game, pitch_number_of_ab, true AS sums_to_one, true AS is_largest, true AS is_known
FROM kg3 WHERE pitch_type IS NOT NULL AND game_pk IS NOT NULL AND game_date IS NOT NULL""")
def forest_invariants(spark, sf):
    """All inputs of the feature log: what holds of every forest, per row."""
    log = L.prepare_log(_kg4(spark, sf))
    fitted = L.fit_forest(log, L.feature_columns(log), None, WIDE)
    out = L.predict(fitted, log)
    p = F.map_values("probabilities")
    return out.select(
        "pitcher", "game_pk", "at_bat_number_of_game", "pitch_number_of_ab",
        (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        (F.element_at("probabilities", F.col("model_prediction")) == F.col("model_confidence")).alias("is_largest"),
        F.array_contains(F.map_keys("probabilities"), F.col("model_prediction")).alias("is_known"))


@query("model_store", f"""
WITH {_OUTCOMES}, {_calls()}
SELECT event_id, guess AS model_prediction, round(share, 9) AS model_confidence FROM rows JOIN calls USING (kind)""")
def model_store(spark, sf):
    """A fitted artefact written, loaded with nothing but its folder, and applied."""
    rows = cut_lineage(_outcomes(spark, sf))
    path = scratch_path(spark, "model")
    fitted = L.fit_forest(rows, KIND, "weight", EXACT)
    fitted.save(path, rows.agg(F.count(F.lit(1)).alias("rows")))
    out = L.predict(L.Fitted.load(path), rows.select("event_id", "kind"))
    return out.select("event_id", "model_prediction", F.round("model_confidence", 9).alias("model_confidence"))


@query("feature_importance", """
SELECT * FROM (VALUES ('digit', 1.0::DOUBLE), ('constant', 0.0::DOUBLE)) AS t(feature, importance) WHERE EXISTS (FROM events)""")
def feature_importance(spark, sf):
    """Only one input tells the halves apart."""
    rows = cut_lineage(_outcomes(spark, sf))
    fitted = L.fit_forest(rows, L.Columns(["digit", "constant"], []), None, EXACT, label="half")
    return L.feature_importance(fitted, rows, 25)


_GUESSED = f"""
WITH {_OUTCOMES}, {_calls("1")} SELECT event_id, guess AS model_prediction FROM rows JOIN calls USING (kind)"""


@query("logistic_regression", _GUESSED)
def logistic_regression(spark, sf):
    """Without a penalty, fitted probabilities are shares."""
    rows = cut_lineage(_outcomes(spark, sf))
    fitted = L.fit_logistic(rows, KIND, penalty=0.0)
    return L.predict(fitted, rows.select("event_id", "kind")).select("event_id", "model_prediction")


_CERTAIN = "SELECT event_id, 'after ' || event_type AS model_prediction FROM events"


@query("linear_svm", _CERTAIN)
def linear_svm(spark, sf):
    """A separable label comes back."""
    rows = cut_lineage(_outcomes(spark, sf))
    fitted = L.fit_svm(rows, KIND, label="certain", iterations=SVM_ROUNDS, penalty=0.01)
    return L.predict(fitted, rows.select("event_id", "kind")).select("event_id", "model_prediction")


@query("gradient_boosting", _CERTAIN)
def gradient_boosting(spark, sf):
    """A separable label comes back from a few rounds of a tree per class."""
    rows = cut_lineage(_outcomes(spark, sf))
    model = L.fit_boosting(rows, KIND, "certain", BOOSTING, ["event_id"])
    return L.predict_boosted(model, rows.select("event_id", "kind")).select("event_id", "model_prediction")


@query("boosting_losses", f"""
WITH {_OUTCOMES} SELECT n::INTEGER AS round, true AS learned_falls, true AS held_out_known FROM range(1, {ROUNDS + 1}) r(n) WHERE EXISTS (FROM rows)""")
def boosting_losses(spark, sf):
    """The log loss of the rows learned from falls in every round."""
    rows = cut_lineage(_outcomes(spark, sf))
    model = L.fit_boosting(rows, L.Columns(["value", "digit"], ["kind"]), "pitch_type", BOOSTING, ["event_id"])
    learned = [x for x, _ in model.losses]
    before = [float("inf"), *learned]
    table = [(i + 1, bool(x < before[i]), h is not None) for i, (x, h) in enumerate(model.losses)]
    return spark.createDataFrame(table, "round int, learned_falls boolean, held_out_known boolean")


@query("model_comparison", f"""
WITH {_OUTCOMES}, {_calls("1", "event_id % 7 <> 0")},
hits AS (SELECT count(*) AS test_rows, round(avg(CASE WHEN guess = pitch_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS a,
                round(avg(CASE WHEN pitch_type = 'after view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS b
         FROM rows JOIN calls USING (kind) WHERE event_id % 7 = 0)
SELECT model, test_rows, CASE WHEN model = 'Constant' THEN b ELSE a END AS test_accuracy
FROM hits, (VALUES ('Random Forest'), ('Logistic Regression'), ('Constant')) AS m(model)""")
def model_comparison(spark, sf):
    rows = cut_lineage(_outcomes(spark, sf))
    train, test = rows.filter("event_id % 7 <> 0"), rows.filter("event_id % 7 = 0")

    def line(name, guessed):
        hit = F.round(F.avg((F.col("model_prediction") == F.col("pitch_type")).cast("double")), 9)
        return guessed.agg(F.count(F.lit(1)).alias("test_rows"), hit.alias("test_accuracy")).select(
            F.lit(name).alias("model"), "test_rows", "test_accuracy")

    return L.comparison([
        line("Random Forest", L.predict(L.fit_forest(train, KIND, None, EXACT), test)),
        line("Logistic Regression", L.predict(L.fit_logistic(train, KIND, penalty=0.0), test)),
        line("Constant", test.withColumn("model_prediction", F.lit("after view"))),
    ])


@query("grouped_cross_validation", f"""
WITH {_OUTCOMES}, folded AS (SELECT *, CAST({S._hash("event_id")} % 5 AS INTEGER) AS fold FROM rows),
shares AS (SELECT f.fold, kind, pitch_type, count(*) AS w FROM folded JOIN (SELECT DISTINCT fold FROM folded) f ON f.fold <> folded.fold GROUP BY ALL),
calls AS (SELECT fold, kind, pitch_type AS guess FROM shares QUALIFY row_number() OVER (PARTITION BY fold, kind ORDER BY w DESC, pitch_type) = 1),
scores AS (SELECT fold, avg(CASE WHEN guess = pitch_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM folded JOIN calls USING (fold, kind) GROUP BY fold)
SELECT round(avg(acc), 9) AS mean_cv_accuracy, (SELECT count(*) FROM rows) AS n FROM scores""")
def grouped_cross_validation(spark, sf):
    rows = cut_lineage(P.group_folds(_outcomes(spark, sf), ["event_id"]))
    score = L.cross_validate(rows, KIND, "fold", forest=EXACT)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(score), 9).alias("mean_cv_accuracy"), "n")


# --- the key as the only input: a tree finds each key's weighted majority class ------------------
@query("ablation_forest", S.MAJORITY_ABLATION)
def ablation_forest(spark, sf):
    log = sales_log(spark, sf).withColumn("who", F.col("pitcher").cast("string"))
    out = L.ablation(log, "pitcher", "game_pk", "game_date", L.RECENCY_ARMS, L.forest_fit(L.Columns([], ["who"]), EXACT))
    return out.select("pitcher", *[F.round(c, 6).alias(c) for c in out.columns if c != "pitcher"])


def _flat_record(trained):
    record = L.nested_metrics(trained.metrics, trained.forest)
    whole = ["career_seasons", "career_games", "career_pitches", "train_games", "test_games", "train_pitches", "test_pitches",
             "evaluation_reference_season"]
    rates = ["train_accuracy", "test_accuracy", "baseline_accuracy", "accuracy_over_baseline"]
    decay = ["evaluation_decay_factor", "production_decay_factor"]
    return record.select("pitcher.*", "dataset.*", "evaluation.*", F.col("weighting.method").alias("weighting_method"),
                         *[F.col(f"weighting.{c}") for c in decay], "random_forest.*").select(
        F.col("pitcher_id").alias("pitcher"), *whole, *[F.round(c, 6).alias(c) for c in [*rates, *decay]],
        F.col("method").alias("split_method"), "weighting_method", "n_estimators", "max_depth", "bootstrap")


@query("forest_train_evaluate", S.TRAINED)
def forest_train_evaluate(spark, sf):
    """The metrics record of every pitcher, from one pooled model, flattened."""
    trained = L.train(
        sales_log(spark, sf), forest=EXACT, cols=L.Columns([], []), row_id=["game_pk", "l_linenumber", "l_partkey"],
        rules=X.CONTINUOUS)
    return _flat_record(trained)


@query("replay_with_forest", S.YEARS_REPLAYED)
def replay_with_forest(spark, sf):
    """Every year of every pitcher replayed with a model of the years before it."""
    from dugout.plans import backtest

    log = sales_log(spark, sf).withColumns({"game_date": F.trunc("game_date", "year"), "who": F.col("pitcher").cast("string")})
    log = cut_lineage(log)
    first = log.agg(F.min("game_date")).scalar()
    pending = log.filter(F.col("game_date") > first).select("pitcher", "game_pk", F.col("game_date").alias("target_date")).distinct()
    names = backtest.Log(row_id=("game_pk", "l_linenumber", "l_partkey"))
    # halving weights have exact sums, so ties are ties in any order of rows
    halving = W.Recency(start=0.5, step=0.0, floor=0.5, minimum=0.125)
    fit = L.forest_on_history(L.Columns([], ["who"]), EXACT, rules=None, recency=halving)
    days = backtest.replay_days(log, cut_lineage(pending), fit, names)
    results = [backtest.game_results(rows, ["pitcher", "game_date"]) for _, rows in days]
    return L.comparison(results).select("pitcher", "game_date", "pitch_count", "model_correct", "baseline_correct")


# --- a forest per pitcher, all inputs of the feature log -------------------------------------------
_TEXT = """events_of_prev_ab bb_type_of_prev_ab game_type stand p_throws home_team away_team inning_topbot if_fielding_alignment
    of_fielding_alignment description_of_prev_pitch type_of_prev_pitch pitch_type_of_prev_pitch count count_state""".split()
_NUMBERS = [c for c in C.KG4 if c not in _TEXT and c not in C.NOT_FEATURES]
INPUTS = L.Columns(_NUMBERS, _TEXT)
_TRAINABLE = "kg3 WHERE pitch_type IS NOT NULL AND game_pk IS NOT NULL AND game_date IS NOT NULL"
_LONG = f"""trainable AS (SELECT *, row_number() OVER () AS r FROM {_TRAINABLE}),
numbers AS (SELECT r, pitcher, pitch_type, unnest(range({len(_NUMBERS)})) AS input,
                   unnest([{", ".join(f'coalesce(CAST("{c}" AS DOUBLE), -999.0::DOUBLE)' for c in _NUMBERS)}]) AS value FROM trainable),
texts AS (SELECT r, pitcher, pitch_type, unnest(range({len(_TEXT)})) AS place,
                 unnest([{", ".join(f"coalesce(\"{c}\", 'Missing')" for c in _TEXT)}]) AS category FROM trainable)"""


def _feature_log(spark, sf):
    return cut_lineage(G._rounded(L.prepare_log(stages.published(stages.build(pitch_log(spark, sf)).kg4))))


@query("forest_stumps", f"""
WITH {G._KG3_SQL}, {_LONG},
ordered AS (SELECT input, value, row_number() OVER (PARTITION BY input ORDER BY value) AS place, count(*) OVER (PARTITION BY input) AS n,
                   max(value) OVER (PARTITION BY input) AS most FROM numbers),
cuts AS (SELECT input, value AS cut, row_number() OVER (PARTITION BY input ORDER BY value) AS number FROM (
    SELECT DISTINCT input, value FROM ordered JOIN range(1, 64) j(j) ON place = (j * n + 63) // 64 WHERE value < most)),
categories AS (SELECT place, category, {len(_NUMBERS)} - 1 + row_number() OVER (ORDER BY place, category) AS input FROM (SELECT DISTINCT place, category FROM texts)),
totals AS (SELECT pitcher, pitch_type, count(*) AS t FROM trainable GROUP BY ALL),
cells AS (
    SELECT pitcher, b.input, coalesce(number, 0) AS bin, pitch_type, count(*) AS n
    FROM numbers b ASOF LEFT JOIN cuts ON b.input = cuts.input AND b.value > cuts.cut GROUP BY ALL
    UNION ALL
    SELECT o.pitcher, o.input, 0, o.pitch_type, t - coalesce(n, 0)
    FROM (SELECT * FROM totals, (SELECT input FROM categories)) o
    LEFT JOIN (SELECT pitcher, input, pitch_type, count(*) AS n FROM texts JOIN categories USING (place, category) GROUP BY ALL) h
        ON h.pitcher = o.pitcher AND h.input = o.input AND h.pitch_type = o.pitch_type),
places AS (SELECT DISTINCT pitcher, input, bin FROM cells WHERE n > 0),
lefts AS (SELECT p.pitcher, p.input, p.bin, c.pitch_type, sum(n)::BIGINT AS l FROM places p JOIN cells c ON c.pitcher = p.pitcher AND c.input = p.input AND c.bin <= p.bin GROUP BY ALL),
whole AS (SELECT pitcher, sum(t)::BIGINT AS rows, round(sum(CAST(t AS DOUBLE) * t) / (CAST(rows AS DOUBLE) * rows), 10) AS own FROM totals GROUP BY pitcher),
sides AS (SELECT pitcher, input, bin, sum(coalesce(l, 0))::BIGINT AS ln, sum(t - coalesce(l, 0))::BIGINT AS rn, sum(CAST(coalesce(l, 0) AS DOUBLE) * coalesce(l, 0)) AS l2,
                 sum(CAST(t - coalesce(l, 0) AS DOUBLE) * (t - coalesce(l, 0))) AS r2
          FROM (SELECT p.*, pitch_type, t FROM places p JOIN totals USING (pitcher)) LEFT JOIN lefts USING (pitcher, input, bin, pitch_type) GROUP BY ALL),
best AS (SELECT pitcher, input, bin, round((l2 / ln + r2 / rn) / rows, 10) - own AS gain FROM sides JOIN whole USING (pitcher)
         WHERE ln >= 5 AND rn >= 5 AND rows >= 20 AND gain > 1e-10
         QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY round((l2 / ln + r2 / rn) / rows, 10) DESC, input, bin) = 1),
names AS (SELECT unnest(range({len(_NUMBERS)})) AS input, unnest({_NUMBERS!r}) AS feature
          UNION ALL SELECT input, ({_TEXT!r})[place + 1] || '=' || category FROM categories)
SELECT w.pitcher, w.rows, feature, CASE WHEN best.input >= {len(_NUMBERS)} THEN 0.0::DOUBLE ELSE round(cut, 6) END AS cut, round(coalesce(gain, 0.0::DOUBLE), 8) AS gain
FROM whole w LEFT JOIN best USING (pitcher) LEFT JOIN names USING (input) LEFT JOIN cuts ON cuts.input = best.input AND cuts.number = best.bin + 1""")
def forest_stumps(spark, sf):
    """The best first split of every pitcher over every cut of every input."""
    forests = L.fit_each(_feature_log(spark, sf), INPUTS, forest=STUMP)
    names = F.array(*[F.lit(c if v is None else f"{c}={v}") for c, v in forests.bins.inputs])
    # the cuts of numbers; a category is split at 0
    flat = [float(v) for c, v in forests.bins.inputs if v is None for v in forests.bins.cuts[c]]
    first, total = [], 0
    for c in forests.numeric:
        first.append(total)
        total += len(forests.bins.cuts[c])
    at, bin_ = F.col("feature")[0], F.col("bin")[0]
    cut = F.element_at(F.array(*[F.lit(v) for v in flat]), F.element_at(F.array(*[F.lit(v) for v in first]), at + 1) + bin_ + 1)
    share = F.col("gain")[0] / F.aggregate(F.col("weights")[0], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return forests.trees.select(
        "pitcher", F.col("rows")[0].alias("rows"), F.when(at >= 0, F.element_at(names, at + 1)).alias("feature"),
        F.when(at >= len(INPUTS.numeric), 0.0).when(at >= 0, F.round(cut, 6)).alias("cut"), F.round(share, 8).alias("gain"))


@query("forest_each", f"""
WITH {G._KG3_SQL} SELECT pitcher, game_pk, at_bat_number_of_game, pitch_number_of_ab, true AS sums_to_one, true AS is_largest, true AS of_the_pitcher
FROM {_TRAINABLE}""")
def forest_each(spark, sf):
    """A bootstrapped forest per pitcher on all inputs: what holds of each row's prediction."""
    log = _feature_log(spark, sf)
    out = L.predict_each(L.fit_each(log, INPUTS, forest=EACH), log)
    own = log.groupBy(F.col("pitcher").alias("_of")).agg(F.collect_set("pitch_type").alias("_own"))
    p = F.map_values("probabilities")
    return out.join(own, F.col("pitcher") == F.col("_of")).select(
        *["pitcher", "game_pk", "at_bat_number_of_game", "pitch_number_of_ab"],
        (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        (F.element_at("probabilities", F.col("model_prediction")) == F.col("model_confidence")).alias("is_largest"),
        F.array_contains("_own", F.col("model_prediction")).alias("of_the_pitcher"))


@query("forest_train_each", S.TRAINED.replace("1 AS n_estimators, 30 AS max_depth", "1 AS n_estimators, 1 AS max_depth"))
def forest_train_each(spark, sf):
    """The metrics record of every pitcher from a model per pitcher; without a telling input a tree is
    its root, the pitcher's weighted majority."""
    log = sales_log(spark, sf).withColumn("constant", F.lit(1.0))
    trained, _ = L.train_each(
        log, [r[0] for r in log.select("pitcher").distinct().collect()], forest=STUMP, cols=L.Columns(["constant"], []),
        row_id=["game_pk", "l_linenumber", "l_partkey"], rules=X.CONTINUOUS)
    return _flat_record(trained)


@query("exact_medians", f"""
WITH {G._KG3_SQL}, trainable AS (SELECT * FROM {_TRAINABLE}),
long AS (SELECT unnest({_NUMBERS!r}) AS feature, unnest([{", ".join(f'CAST("{c}" AS DOUBLE)' for c in _NUMBERS)}]) AS value FROM trainable)
SELECT feature, round(median(value), 6) AS median, count(value) AS n, count(value) % 2 = 0 AS is_even FROM long GROUP BY feature""")
def exact_medians(spark, sf):
    """The median of every number of the feature log, with NULLs left out, in a few scans for all."""
    log = _feature_log(spark, sf)
    middle = Q.medians(log, _NUMBERS)
    table = spark.createDataFrame([(c, middle[c]) for c in _NUMBERS], "feature string, median double")
    counts = log.select([F.count(F.col(c)).alias(c) for c in _NUMBERS]).unpivot([], _NUMBERS, "feature", "n")
    return table.join(counts, "feature").select("feature", F.round("median", 6).alias("median"), "n", (F.col("n") % 2 == 0).alias("is_even"))


# --- a fitted model for every date ------------------------------------------------------------------
@query("walk_forward_fitted", f"""
WITH {S._FORWARD}
SELECT pitcher, game_pk, l_linenumber, l_partkey, actual_pitch, model_prediction, baseline_prediction, error FROM forward""")
def walk_forward_fitted(spark, sf):
    """Trees of all dates at once; without a telling input each is its root, the weighted majority."""
    from dugout.plans import forward

    log = S.customer_log(spark, sf).withColumn("constant", F.lit(1.0))
    out = forward.walk_forward(log, L.Columns(["constant"], []), STUMP, S.CUSTOMERS, rules=S.RULES)
    return out.select("pitcher", "game_pk", "l_linenumber", "l_partkey", "actual_pitch", "model_prediction", "baseline_prediction", "error")


@query("walk_forward_forest", f"""
WITH {G._KG3_SQL}, log AS (SELECT * FROM {_TRAINABLE}),
games AS (SELECT DISTINCT pitcher, game_pk, game_date FROM log),
past AS (SELECT a.pitcher, a.game_date, count(b.game_pk) AS n FROM (SELECT DISTINCT pitcher, game_date FROM games) a
         LEFT JOIN games b ON b.pitcher = a.pitcher AND b.game_date < a.game_date GROUP BY ALL)
SELECT log.pitcher, game_pk, at_bat_number_of_game, pitch_number_of_ab, n >= 2 AS is_predicted, CASE WHEN n >= 2 THEN true END AS sums_to_one,
       CASE WHEN n >= 2 THEN true END AS within_history
FROM log JOIN past USING (pitcher, game_date)""")
def walk_forward_forest(spark, sf):
    """A forest per pitcher and date on all inputs: what holds of each prediction."""
    from dugout.plans import forward

    out = forward.replay(_feature_log(spark, sf), INPUTS, L.Forest(trees=5, depth=4, min_leaf=2, min_split=6))
    p = F.map_values("probabilities")
    names = ["pitcher", "game_pk", "at_bat_number_of_game", "pitch_number_of_ab"]
    seen = out.groupBy(F.col("pitcher").alias("_of"), F.col("pitch_type").alias("_class")).agg(F.min("game_date").alias("_first"))
    joined = out.join(seen, (F.col("pitcher") == F.col("_of")) & (F.col("model_prediction") == F.col("_class")), "left")
    predicted = F.col("model_prediction").isNotNull()
    return joined.select(
        *names, predicted.alias("is_predicted"),
        F.when(predicted, F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        F.when(predicted, F.col("_first") < F.col("game_date")).alias("within_history"))
