"""Weighted classifiers on KG4-like tables, with Spark ML.

Two ways to fit: one pooled model with the pitcher's class shares as features, with Spark ML's forest,
and a forest per pitcher, all pitchers at once, with ``trees``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from dugout import columns as C
from dugout.functions import scalar as S
from dugout.operators import baselines as B
from dugout.operators import evaluation as E
from dugout.operators import quantiles
from dugout.operators import split as P
from dugout.operators import weights as W
from dugout.operators.groups import settled
from dugout.plans import boosting, trees
from dugout.session import cut_lineage, release, scratch_path, stored

LABEL = "pitch_type"
NO_ROWS = "No rows to train on."
# fixed values: stand-ins for missing input
MISSING_NUMBER = -999.0
MISSING_TEXT = "Missing"


@dataclass(frozen=True)
class Forest:
    trees: int = 800
    depth: int = 15
    min_leaf: int = 5
    features: str = "log2"
    seed: int = 42
    max_bins: int = 64
    bootstrap: bool = True
    min_split: int = 20  # rows; of forests per key only, Spark ML's have no such setting


@dataclass(frozen=True)
class Columns:
    """Feature columns by treatment, taken from the schema and never from the data."""

    numeric: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.text]


def feature_columns(df: DataFrame, excluded: Iterable[str] = C.NOT_FEATURES, extra_excluded: Iterable[str] = ()) -> Columns:
    skip = {*excluded, *extra_excluded}
    usable = [f for f in df.schema.fields if f.name not in skip and not f.name.startswith("_")]
    return Columns(
        [f.name for f in usable if isinstance(f.dataType, NumericType)],
        [f.name for f in usable if isinstance(f.dataType, StringType)],
    )


def impute_constants(df: DataFrame, cols: Columns) -> DataFrame:
    """Constant stand-ins for missing values; numbers become double."""
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(MISSING_NUMBER)) for c in cols.numeric},
            **{c: F.coalesce(F.col(f"`{c}`"), F.lit(MISSING_TEXT)) for c in cols.text},
        }
    )


def align(df: DataFrame, cols: Columns, keep: Iterable[str] = ()) -> DataFrame:
    """The model's feature columns; those a table lacks become NULL."""
    have = set(df.columns)
    kept = [F.col(f"`{c}`") for c in keep if c in have and c not in cols.all]
    number = [F.col(f"`{c}`") if c in have else F.lit(None).cast("double").alias(c) for c in cols.numeric]
    text = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in cols.text]
    return df.select(*kept, *number, *text)


def _encoding(cols: Columns) -> list:
    """Index and one-hot text, then assemble. A category unseen in training gets an all-zero code
    apart from the indexer's own slot for unknowns."""
    stages: list = []
    if cols.text:
        stages.append(
            StringIndexer(
                inputCols=cols.text, outputCols=[f"_ix_{c}" for c in cols.text], handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"_ix_{c}" for c in cols.text], outputCols=[f"_oh_{c}" for c in cols.text],
                dropLast=False, handleInvalid="keep",
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[*cols.numeric, *[f"_oh_{c}" for c in cols.text]], outputCol="_features", handleInvalid="keep"
        )
    )
    return stages


def _label_stage(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc")


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline with the columns it was trained on."""

    model: PipelineModel
    classes: list[str]
    cols: Columns
    prepare: Callable[[DataFrame, Columns], DataFrame] = impute_constants

    def save(self, path: str, metrics: DataFrame | None = None) -> None:
        """The whole artefact: pipeline, classes, columns, how inputs are prepared, metrics."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/pipeline")
        about = [(self.classes, self.cols.numeric, self.cols.text, self.prepare.__name__)]
        schema = "classes array<string>, numeric array<string>, text array<string>, prepare string"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").json(f"{path}/about")
        if metrics is not None:
            metrics.write.mode("overwrite").parquet(f"{path}/metrics")

    @staticmethod
    def load(path: str) -> Fitted:
        """What ``save`` wrote, with nothing needed from the session that fitted it."""
        schema = "classes array<string>, numeric array<string>, text array<string>, prepare string"
        about = SparkSession.active().read.schema(schema).json(f"{path}/about").first()
        ways = {f.__name__: f for f in (impute_constants, _linear_prepare)}
        cols = Columns(list(about.numeric), list(about.text))
        return Fitted(PipelineModel.load(f"{path}/pipeline"), list(about.classes), cols, ways[about.prepare])


def _fit(train: DataFrame, cols: Columns, encoding: Callable[[DataFrame], list], classifier, label: str, prepare=impute_constants) -> Fitted:
    rows = prepare(train.filter(F.col(label).isNotNull()), cols)
    labels = _label_stage(label).fit(rows)
    model = Pipeline(stages=[labels, *encoding(rows), classifier]).fit(rows)
    return Fitted(model, list(labels.labels), cols, prepare)


def merged(rows: DataFrame, cols: Columns, weight: str | None, label: str) -> DataFrame:
    """Rows alike in every input and the label as one row of their total ``_weight``. Rows of one weight are
    counted and their products added as decimals, so totals are the same in any order of rows."""
    own = F.lit(1.0) if weight is None else F.col(weight)
    counts = rows.groupBy(*[F.col(f"`{c}`") for c in cols.all], label, own.alias("_own")).agg(F.count(F.lit(1)).alias("_rows"))
    total = F.sum((F.col("_rows") * F.col("_own")).cast("decimal(38, 15)")).cast("double")
    return counts.groupBy(*[F.col(f"`{c}`") for c in cols.all], label).agg(total.alias("_weight"))


def fit_forest(
    train: DataFrame, cols: Columns, weight: str | None = None, forest: Forest = Forest(), label: str = LABEL
) -> Fitted:
    """Weighted random forest. Where no rows are drawn and one row may be a leaf, trees depend on rows
    only through the total weight of those that are alike, so these are merged first."""
    if not forest.bootstrap and forest.min_leaf <= 1:
        train, weight = cut_lineage(merged(train, cols, weight, label)), "_weight"
    classifier = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=forest.trees, maxDepth=forest.depth,
        minInstancesPerNode=forest.min_leaf, featureSubsetStrategy=forest.features, bootstrap=forest.bootstrap,
        seed=forest.seed, maxBins=forest.max_bins,
        **({"weightCol": weight} if weight else {}),
    )
    return _fit(train, cols, lambda rows: _encoding(cols), classifier, label)


def _linear_encoding(cols: Columns, rows: DataFrame) -> list:
    """Median imputation and standardised numbers beside one-hot text, for linear models.

    The medians are exact, from ``rows`` (the training rows), and become part of the pipeline. A column
    without any value gets 0.
    """
    stages: list = []
    if cols.numeric:
        middle = quantiles.medians(rows, cols.numeric)
        filled = ", ".join(f"coalesce(nanvl(`{c}`, NULL), {float(middle[c] or 0.0)!r}D) AS `_im_{c}`" for c in cols.numeric)
        stages += [
            SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_im_{c}" for c in cols.numeric], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
    text = _encoding(Columns([], cols.text))[:-1] if cols.text else []
    inputs = (["_scaled"] if cols.numeric else []) + [f"_oh_{c}" for c in cols.text]
    return [*stages, *text, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")]


def _linear_prepare(df: DataFrame, cols: Columns) -> DataFrame:
    return df.withColumns(
        {
            **{c: F.col(f"`{c}`").cast("double") for c in cols.numeric},
            **{c: F.coalesce(F.col(f"`{c}`"), F.lit(MISSING_TEXT)) for c in cols.text},
        }
    )


def fit_logistic(
    train: DataFrame, cols: Columns, label: str = LABEL, iterations: int = 2000, penalty: float = 1e-4
) -> Fitted:
    # the penalty plays the part of an L2 penalty of strength 1 spread over the rows
    classifier = LogisticRegression(
        featuresCol="_features", labelCol="_label", family="multinomial", maxIter=iterations, regParam=penalty
    )
    return _fit(train, cols, lambda rows: _linear_encoding(cols, rows), classifier, label, _linear_prepare)


def fit_svm(train: DataFrame, cols: Columns, label: str = LABEL, iterations: int = 5000, penalty: float = 1e-4) -> Fitted:
    """One-vs-rest. Without numbers many rows are alike; these become one row of their total weight, so an
    evaluation of the loss costs the distinct rows and not the log."""
    weights = {}
    if not cols.numeric:
        train = cut_lineage(merged(train.filter(F.col(label).isNotNull()), cols, None, label).coalesce(1))
        total, squares = train.agg(F.sum("_weight"), F.sum(F.col("_weight") * F.col("_weight"))).first()
        # Spark scales inputs by a deviation that divides by W - sum(w * w) / W; of single rows that is W - 1.
        # The penalty is on scaled coefficients, so this factor makes the loss that of the single rows.
        if total and total > 1:
            penalty *= (total - squares / total) / (total - 1)
        weights = {"weightCol": "_weight"}
    one = LinearSVC(featuresCol="_features", labelCol="_label", maxIter=iterations, regParam=penalty)
    classifier = OneVsRest(classifier=one, featuresCol="_features", labelCol="_label", parallelism=4, **weights)
    return _fit(train, cols, lambda rows: _linear_encoding(cols, rows), classifier, label, _linear_prepare)


def fit_boosting(train: DataFrame, cols: Columns, label: str = LABEL, plan: boosting.Boosting = boosting.Boosting(), row_id: list[str] | None = None) -> boosting.Boosted:
    """Softmax boosting with a tree per class and round."""
    return boosting.fit(impute_constants(train, cols), cols.numeric, cols.text, label, plan, row_id)


def predict_boosted(model: boosting.Boosted, rows: DataFrame) -> DataFrame:
    cols = Columns(model.numeric, model.text)
    return boosting.predict(model, rows, lambda df: impute_constants(df, cols))


def predict(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Add ``model_prediction``, and where the model gives probabilities, ``probabilities`` (map
    from class) and ``model_confidence`` (the largest of them)."""
    have = set(rows.columns)
    absent = {c: "double" for c in fitted.cols.numeric if c not in have}
    absent |= {c: "string" for c in fitted.cols.text if c not in have}
    # the row travels along packed, so preparing features does not touch its own columns
    packed = rows.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    packed = packed.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}) if absent else packed
    scored = fitted.prepare(packed.select("_row", *[f"`{c}`" for c in fitted.cols.all]), fitted.cols)
    for stage in fitted.model.stages[1:]:  # all but the label indexer: targets may hold new classes
        scored = stage.transform(scored)
    names = F.array(*[F.lit(c) for c in fitted.classes])
    out = {"model_prediction": F.element_at(names, F.col("prediction").cast("int") + 1)}
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        out["probabilities"] = F.map_from_arrays(names, p)
        out["model_confidence"] = F.array_max(p)
    return scored.select("_row.*", *[v.alias(k) for k, v in out.items()])


def probability_columns(predicted: DataFrame, classes: list[str]) -> DataFrame:
    """Wide form of the probabilities, one ``prob_<class>`` column per class."""
    wide = {f"prob_{c}": F.try_element_at("probabilities", F.lit(c)) for c in classes}
    return predicted.withColumns(wide).drop("probabilities")


def feature_importance(fitted: Fitted, sample: DataFrame, top: int = 25) -> DataFrame:
    """The most important inputs by name. Names come from the metadata of the assembled vector."""
    forest = fitted.model.stages[-1]
    ready = fitted.prepare(sample.limit(1), fitted.cols)
    for stage in fitted.model.stages[1:-1]:
        ready = stage.transform(ready)
    attrs = ready.schema["_features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    values = forest.featureImportances.toArray()
    pairs = [(names.get(i, f"f{i}").replace("_oh_", ""), float(v)) for i, v in enumerate(values)]
    table = sample.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


# --- training a pitcher or all of them --------------------------------------------------------
def prepare_log(kg4: DataFrame, date: str = "game_date") -> DataFrame:
    """Rows that can be trained on, with their season. A date that is no date is an error."""
    return kg4.dropna(subset=[LABEL, "game_pk", date]).withColumn("season", F.year(F.col(date).cast("date")))


@dataclass(frozen=True)
class Training:
    """Evaluated on the last games, refitted on all of them."""

    production: Fitted | trees.KeyForests
    metrics: DataFrame
    test_predictions: DataFrame
    errors: DataFrame  # keys that cannot be split, with the reason
    forest: Forest
    shares: DataFrame | None = None  # of the pooled production model: join to rows by ``with_shares``


def train(
    kg4: DataFrame,
    reference: int | None = None,
    key: str = "pitcher",
    game: str = "game_pk",
    date: str = "game_date",
    forest: Forest = Forest(),
    fraction: float = 0.20,
    cols: Columns | None = None,
    pooled: bool = True,
    seed: int = 42,
    row_id: list[str] = ("game_pk", "pitcher", "at_bat_number_of_game", "pitch_number_of_ab"),
    rules: W.Rules | None = W.CONTINUOUS,
    each: bool = False,
) -> Training:
    """Chronological split, weights from training rows alone, fit, score against the baseline, then
    refit on everything with the caller's reference season.

    ``pooled`` adds each key's class shares among the rows fitted on as numeric inputs, so one model
    serves all pitchers: as many inputs as classes, whatever the number of keys, and a key's inputs
    depend on its own rows alone. ``each`` grows a forest for every key instead, all of them in the
    same jobs (``trees``); ``pooled`` has no part in it. Keys with a single game are in no part of the
    split; they are listed in ``errors``.
    """
    log = prepare_log(kg4, date)
    if cols is None:
        cols = feature_columns(log, extra_excluded=["weight", "is_test"])
    # read many times: kept in the shared folder, not in executors, and once: the rows with their side of the
    # split, which those of keys that cannot be split lack
    spark, columns = log.sparkSession, log.columns
    log_at = scratch_path(spark, "training-log")
    log = stored(log, log_at)
    sides = P.chronological_games(log, key, game, date, fraction).select(key, game, "is_test")
    whole = stored(log.join(sides, [key, game], "left"), scratch_path(spark, "training-split"))
    release(spark, log_at)
    log, parts = whole.select(*[F.col(f"`{c}`") for c in columns]), whole.filter(F.col("is_test").isNotNull())
    train_rows = parts.filter(~F.col("is_test")).drop("is_test")
    test_rows = parts.filter("is_test").drop("is_test")
    weighted = W.training_weights(train_rows, key, LABEL, rules=rules)
    shares = None
    told = lambda rows: rows
    fit = lambda rows: fit_forest(cut_lineage(rows), cols, "weight", forest)
    call = predict
    if each:
        fit = lambda rows: fit_each(rows, cols, key, "weight", forest, list(row_id))
        call = predict_each
    elif pooled:
        classes = sorted(r[0] for r in log.select(LABEL).distinct().collect())
        cols = Columns([*cols.numeric, *[f"_share_{i}" for i in range(len(classes))]], cols.text)
        own = settled(class_shares(train_rows, key, classes))
        shares = cut_lineage(class_shares(log, key, classes))
        told = lambda rows: with_shares(rows, own, key)
    evaluated = fit(told(weighted))
    ranges = B.class_ranges(train_rows, [key], LABEL)
    scored = lambda rows: call(evaluated, told(rows)).select(
        *rows.columns, "model_prediction", "probabilities", "model_confidence")
    # of these only the hits are counted; the row's id deals them over blocks
    needed = dict.fromkeys([key, LABEL, *row_id, *cols.all])
    scored_train = scored(train_rows.select(*[F.col(f"`{c}`") for c in needed if c in train_rows.columns]))
    scored_test = B.stratified(scored(test_rows), ranges, [key], LABEL, list(row_id), seed)
    metrics = _metrics(parts, scored_train, scored_test, key, game)
    everything = W.training_weights(log, key, LABEL, reference=reference, rules=rules)
    production = fit(with_shares(everything, settled(shares), key) if shares is not None else everything)
    alone = log.groupBy(key).agg(F.countDistinct(game).alias("_games")).filter("_games < 2")
    errors = alone.select(key, F.lit("modeling").alias("stage"), F.lit(S.FEW_GAMES).alias("error"))
    return Training(production, metrics, scored_test, errors, forest, shares)


def class_shares(rows: DataFrame, key: str, classes: list[str], label: str = LABEL) -> DataFrame:
    """(_key, _share_0, ...): which share of a key's rows has each of ``classes``."""
    return rows.groupBy(F.col(key).alias("_key")).agg(
        *[F.avg((F.col(label) == c).cast("double")).alias(f"_share_{i}") for i, c in enumerate(classes)])


def with_shares(rows: DataFrame, shares: DataFrame, key: str = "pitcher") -> DataFrame:
    """``rows`` with their key's class shares; a key without any has NULL."""
    return rows.join(shares, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def _metrics(parts: DataFrame, scored_train: DataFrame, scored_test: DataFrame, key: str, game: str) -> DataFrame:
    """One record per key: data set sizes, split sizes, accuracies, baseline and lift."""
    sizes = parts.groupBy(key).agg(
        F.countDistinct("season").alias("career_seasons"),
        F.countDistinct(game).alias("career_games"),
        F.count(F.lit(1)).alias("career_pitches"),
        F.countDistinct(F.when(~F.col("is_test"), F.col(game))).alias("train_games"),
        F.countDistinct(F.when(F.col("is_test"), F.col(game))).alias("test_games"),
        F.count_if(~F.col("is_test")).alias("train_pitches"),
        F.count_if("is_test").alias("test_pitches"),
        F.max(F.when(~F.col("is_test"), F.col("season"))).alias("evaluation_reference_season"),
        F.countDistinct(F.when(~F.col("is_test"), F.col("season"))).alias("_train_seasons"),
    )
    fitted = E.accuracy(scored_train, [key], "model_prediction", LABEL, "train_accuracy").select(key, "train_accuracy")
    right = lambda c: F.avg(F.coalesce(F.col(c) == F.col(LABEL), F.lit(False)).cast("double"))
    tested = scored_test.groupBy(key).agg(right("model_prediction").alias("model_accuracy"), right("baseline_prediction").alias("baseline_accuracy"))
    record = sizes.join(fitted, key).join(tested, key)
    return E.lift(record).withColumns(
        {
            "baseline_strategy": F.lit("stratified"),
            "evaluation_decay_factor": S.decay_factor("_train_seasons"),
            "production_decay_factor": S.decay_factor("career_seasons"),
        }
    ).drop("_train_seasons")


def nested_metrics(metrics: DataFrame, forest: Forest, key: str = "pitcher") -> DataFrame:
    """The metrics record in its nested form, ready for a JSON sink. ``forest``: the settings of the
    fitted model (``Training.forest``)."""
    group = F.struct
    return metrics.select(
        group(F.col(key).alias("pitcher_id")).alias("pitcher"),
        group("career_seasons", "career_games", "career_pitches").alias("dataset"),
        group(
            F.lit("chronological_game_split").alias("method"), "train_games", "test_games", "train_pitches",
            "test_pitches", "evaluation_reference_season", "train_accuracy",
            F.col("model_accuracy").alias("test_accuracy"), "baseline_strategy", "baseline_accuracy",
            "accuracy_over_baseline", "accuracy_over_baseline_pp", "relative_improvement",
            "relative_improvement_percent",
        ).alias("evaluation"),
        group(
            F.lit(forest.trees).alias("n_estimators"), F.lit(forest.depth).alias("max_depth"),
            F.lit(forest.min_leaf).alias("min_samples_leaf"), F.lit(forest.features).alias("max_features"),
            F.lit(forest.bootstrap).alias("bootstrap"), F.lit(forest.seed).alias("random_state"),
        ).alias("random_forest"),
        group(
            F.lit("mild_recency_x_continuous_repertoire").alias("method"),
            "evaluation_decay_factor", "production_decay_factor",
        ).alias("weighting"),
    )


def fit_each(
    train: DataFrame, cols: Columns, key: str = "pitcher", weight: str | None = None, forest: Forest = Forest(),
    row_id: list[str] = ("game_pk", "pitcher", "at_bat_number_of_game", "pitch_number_of_ab"), label: str = LABEL,
) -> trees.KeyForests:
    """A weighted forest of its own for every key."""
    rows = impute_constants(train.filter(F.col(label).isNotNull()), cols)
    return trees.fit_each(rows, key, label, weight, cols.numeric, cols.text, forest, list(row_id))


def predict_each(forests: trees.KeyForests, rows: DataFrame) -> DataFrame:
    """``predict`` with the forest of each row's key; columns that ``rows`` lack count as missing."""
    cols = Columns(forests.numeric, forests.text)
    absent = {c: F.lit(None).cast("double") for c in cols.numeric if c not in rows.columns}
    absent |= {c: F.lit(None).cast("string") for c in cols.text if c not in rows.columns}
    return trees.predict_each(forests, rows, lambda df: impute_constants(df, cols), absent)


def train_each(
    kg4: DataFrame, pitchers: list[int], reference: int | None = None, key: str = "pitcher", **kw
) -> tuple[Training, DataFrame]:
    """One model per pitcher of a day's list, all grown in the same jobs. A pitcher that cannot be
    trained becomes an error row and does not stop the others."""
    log = kg4.filter(F.col(key).isin([int(p) for p in pitchers]))
    trained = train(log, reference, key, each=True, **kw)
    asked = kg4.sparkSession.createDataFrame([(int(p),) for p in pitchers], f"{key} bigint").distinct()
    known = prepare_log(log, kw.get("date", "game_date")).select(F.col(key).cast("bigint").alias(key)).distinct()
    absent = asked.join(known, key, "left_anti").select(key, F.lit("modeling").alias("stage"), F.lit(NO_ROWS).alias("error"))
    return trained, trained.errors.withColumn(key, F.col(key).cast("bigint")).unionByName(absent)


# --- experiments ------------------------------------------------------------------------------
def weight_arms(train_rows: DataFrame, key: str, arms: dict[str, tuple], label: str = LABEL) -> DataFrame:
    """One weight column ``w_<arm>`` per arm; an arm is (recency, rules), either of them None.
    ``rules`` may be continuous or categorical."""
    rows = train_rows
    for name, (recency, rules) in arms.items():
        out = f"w_{name}"
        if isinstance(rules, W.CategoricalRules):
            table = W.categorical_adjustments(train_rows, key, label, rules)
            rows = W.apply_adjustments(rows, table, key, label, out="_rep")
            if recency is not None:
                rows = W.recency_weights(rows, [key], None, recency, out="_rec")
                rows = rows.withColumn(out, F.col("_rep") * F.col("_rec")).drop("_rep", "_rec")
            else:
                rows = rows.withColumnRenamed("_rep", out)
        else:
            rows = W.training_weights(rows, key, label, None, rules, recency, out=out)
    return rows


# fixed values: the arms of the weight experiments
REPERTOIRE_ARMS = {
    "unweighted": (None, None), "recency": (W.MILD, None),
    "repertoire": (None, W.CATEGORICAL_PEAK), "combined": (W.MILD, W.CATEGORICAL_PEAK),
}
CONTINUOUS_ARMS = {
    "unweighted": (None, None), "recency": (W.MILD, None),
    "categorical": (W.MILD, W.CATEGORICAL_PRIOR), "continuous": (W.MILD, W.CONTINUOUS),
}
GATED_ARMS = {
    "unweighted": (None, None), "recency": (W.MILD, None),
    "ungated": (W.MILD, W.CONTINUOUS), "gated": (W.MILD, W.GATED),
}
RECENCY_ARMS = {"unweighted": (None, None), "current": (W.AGGRESSIVE, None), "mild": (W.MILD, None)}


def ablation(
    log: DataFrame,
    key: str,
    game: str,
    date: str,
    arms: dict[str, tuple],
    fit: Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]],
    label: str = LABEL,
    fraction: float = 0.20,
) -> DataFrame:
    """Accuracy per key and arm on one chronological split, beside the majority baseline.

    ``fit(train_rows, weight_column)`` returns a function that adds ``model_prediction``.
    """
    log = log if "season" in log.columns else log.withColumn("season", F.year(date))
    parts = cut_lineage(P.chronological_split(log, key, game, date, fraction))
    train_rows = parts.filter(~F.col("is_test")).drop("is_test")
    test_rows = parts.filter("is_test").drop("is_test")
    weighted = cut_lineage(weight_arms(train_rows, key, arms, label))
    majority = B.majority(train_rows, [key], label).select(key, F.col(label).alias("_majority"))
    table = E.accuracy(test_rows.join(majority, key), [key], "_majority", label, "baseline_accuracy").select(
        key, "baseline_accuracy"
    )
    for name in arms:
        scored = fit(weighted, f"w_{name}")(test_rows)
        table = table.join(
            E.accuracy(scored, [key], "model_prediction", label, f"{name}_accuracy").select(key, f"{name}_accuracy"), key
        )
    return table


def majority_fit(key: str, label: str = LABEL):
    """Weighted-majority class per key, in the form ``ablation`` takes."""

    def fit(train_rows: DataFrame, weight: str):
        call = B.weighted_majority(train_rows, [key], label, weight).select(
            key, F.col(label).alias("model_prediction")
        )
        call = settled(call)
        return lambda rows: rows.join(call, key, "left")

    return fit


def forest_fit(cols: Columns, forest: Forest = Forest(), label: str = LABEL):
    def fit(train_rows: DataFrame, weight: str):
        fitted = fit_forest(train_rows, cols, weight, forest, label)
        return lambda rows: predict(fitted, rows)

    return fit


def forest_on_history(
    cols: Columns, forest: Forest = Forest(), key: str = "pitcher", date: str = "game_date", label: str = LABEL,
    rules: W.Rules | None = W.CONTINUOUS, recency: W.Recency | None = W.MILD,
):
    """The production model in the form ``replay_days`` takes: recency x repertoire weights as of the
    target season, then a forest."""

    def fit(history: DataFrame):
        log = history.withColumn("_season", F.year(date))
        weighted = W.training_weights(log, key, label, reference="_target_season", rules=rules, recency=recency, season="_season")
        fitted = fit_forest(cut_lineage(weighted), cols, "weight", forest, label)
        return lambda rows: predict(fitted, rows)

    return fit


def cross_validate(
    train_rows: DataFrame, cols: Columns, fold: str, folds: int = 5, forest: Forest = Forest(), label: str = LABEL
) -> float:
    """Mean accuracy over grouped folds; encoding is fitted inside each fold."""
    rows = impute_constants(train_rows.filter(F.col(label).isNotNull()), cols)
    labels = _label_stage(label).fit(rows)
    classifier = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=forest.trees, maxDepth=forest.depth,
        minInstancesPerNode=forest.min_leaf, featureSubsetStrategy=forest.features, seed=forest.seed,
        maxBins=forest.max_bins, bootstrap=forest.bootstrap,
    )
    cv = CrossValidator(
        estimator=Pipeline(stages=[*_encoding(cols), classifier]),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy"),
        numFolds=folds, foldCol=fold, parallelism=2,
    )
    return float(cv.fit(labels.transform(rows)).avgMetrics[0])


def comparison(rows: list[DataFrame]) -> DataFrame:
    """Metric rows of several models, one under the other."""
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return table
