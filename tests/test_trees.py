"""Trees from histograms against a plain builder, row by row; exact order statistics."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.operators import quantiles as Q
from dugout.plans import learning as L
from dugout.plans import trees as T

ID = ["row"]
COLS = L.Columns(["a", "b", "c"], ["t"])


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        key = rng.choice([1, 1, 1, 1, 2, 2, 3, 4])
        a, b = rng.randrange(12), rng.choice([None, rng.random(), rng.random()])
        t = rng.choice(["x", "y", None])
        label = "FF" if a * key + (b or 0) > 14 else "SL" if t == "x" or rng.random() < 0.3 else "CU"
        rows.append((i, key, a, b, float(i % 3), t, label, rng.choice([0.5, 1.0, 0.1])))
    rows += [(1000, 5, 1, 0.5, 0.0, "x", "FF", 1.0), (1001, None, 1, 0.5, 0.0, "x", "FF", 1.0), (1002, 1, 3, 0.1, 0.0, "x", None, 1.0)]
    return spark.createDataFrame(rows, "row int, key int, a int, b double, c double, t string, label string, w double").repartition(3)


def plain_tree(rows, key, tree, spec):
    """Nodes of a tree by looking at every cut of every tried input, on lists of rows."""
    nodes = {}

    def grow(node, rows, depth):
        weights = [sum(w for _, k, w in rows if k == c) for c in range(spec.classes)]
        total = sum(weights)
        nodes[node] = (-1, -1, len(rows), weights)
        if depth == spec.depth or len(rows) < spec.min_split:
            return
        own = round(sum(w * w for w in weights) / total**2, T.DIGITS)
        found = None
        for f in T.tried_inputs(str(key), tree, np.array([node]), spec)[0]:
            for cut in range(spec.bins - 1):
                parts = [[r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]]
                if min(map(len, parts)) < spec.min_leaf:
                    continue
                score = 0.0
                for part in parts:
                    by = [sum(w for _, k, w in part if k == c) for c in range(spec.classes)]
                    score += sum(w * w for w in by) / sum(by)
                score = round(score / total, T.DIGITS)
                if found is None or score > found[0]:
                    found = score, f, cut, parts
        if found and found[0] - own > 10.0**-T.DIGITS:
            nodes[node] = (int(found[1]), found[2], len(rows), weights)
            grow(2 * node, found[3][0], depth + 1)
            grow(2 * node + 1, found[3][1], depth + 1)

    grow(1, rows, 0)
    return nodes


def as_nodes(row):
    return {n: (f, b, r, list(w)) for n, f, b, r, w in zip(row.node, row.feature, row.bin, row.rows, row.weights)}


@pytest.mark.parametrize("block", [T.BLOCK, 60])
@pytest.mark.parametrize("bootstrap, features", [(True, "log2"), (False, "all")])
def test_forests_are_those_of_a_plain_builder(spark, log, block, bootstrap, features):
    forest = L.Forest(trees=3, depth=4, min_leaf=3, min_split=8, features=features, bootstrap=bootstrap, max_bins=8)
    rows = L.impute_constants(log.filter("label IS NOT NULL"), COLS)
    forests = T.fit_each(rows, "key", "label", "w", COLS.numeric, COLS.text, forest, ID, block=block)
    bins, spec = forests.bins, forests.spec
    assert bins.inputs == [("a", None), ("b", None), ("c", None), ("t", "Missing"), ("t", "x"), ("t", "y")]
    told = rows.select("*", F.xxhash64("row").alias("h")).collect()
    by_key = {}
    for r in told:
        codes = [sum(cut < r[c] for cut in bins.cuts[c]) for c in COLS.numeric] + [int(r.t == v) for v in bins.categories["t"]]
        by_key.setdefault(r.key, []).append((codes, forests.classes.index(r.label), round(r.w * T.UNIT), r.h))
    got = {(r.key, r.tree): as_nodes(r) for r in forests.trees.collect() if r.node}
    want = {}
    for key, mine in by_key.items():
        for tree in range(forest.trees):
            drawn = []
            for codes, label, weight, h in mine:
                times = 1
                if bootstrap:
                    u = int(T.mix(np.array([h], np.int64).view(np.uint64) + np.uint64(T._number(spec.seed, "tree", tree)))[0] >> np.uint64(11)) / 2**53
                    times, mass = 0, math.exp(-1)
                    while u >= mass and times < 16:
                        times += 1
                        mass += math.exp(-1) / math.factorial(times)
                if times:
                    drawn.append((codes, label, weight * times))
            if drawn:
                want[key, tree] = plain_tree(drawn, key, tree, spec)
    assert got == want
    assert max(len(n) for n in got.values()) > 7


def test_predictions_average_the_leaves(spark, log, tmp_path):
    forest = L.Forest(trees=4, depth=3, min_leaf=2, min_split=4, max_bins=8)
    forests = L.fit_each(log, COLS, "key", "w", forest, ID, "label")
    forests.save(str(tmp_path / "forests"))
    rows = log.unionByName(log.limit(1).withColumn("key", F.lit(99)).withColumn("row", F.lit(2000)))
    out = {r.row: r for r in L.predict_each(forests, rows).collect()}
    assert len(out) == rows.count() and L.predict_each(forests, rows).columns == [*rows.columns, "model_prediction", "probabilities", "model_confidence"]
    again = {r.row: r for r in L.predict_each(T.KeyForests.load(spark, str(tmp_path / "forests")), rows).collect()}
    assert out == again
    assert out[2000].model_prediction is None and out[2000].probabilities is None
    trees = {}
    for r in forests.trees.collect():
        if r.node:
            trees.setdefault(r.key, []).append(as_nodes(r))
    for r in out.values():
        if r.key not in trees:
            continue
        values = [-999.0 if r[c] is None else r[c] for c in COLS.numeric]
        codes = [sum(cut < v for cut in forests.bins.cuts[c]) for c, v in zip(COLS.numeric, values)]
        codes += [int((r.t or "Missing") == v) for v in forests.bins.categories["t"]]
        p = np.zeros(len(forests.classes))
        for nodes in trees[r.key]:
            n = 1
            while nodes[n][0] >= 0:
                n = 2 * n + (codes[nodes[n][0]] > nodes[n][1])
            p += np.array(nodes[n][3]) / sum(nodes[n][3])
        p /= p.sum()
        assert [r.probabilities[c] for c in forests.classes] == pytest.approx(p.tolist())
        assert r.model_confidence == pytest.approx(max(p))
    absent = L.predict_each(forests, rows.drop("b", "t"))
    assert absent.filter("key = 1 AND model_prediction IS NULL").isEmpty()


def test_rows_of_equal_inputs_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 100)
    rows = spark.range(3000).select("id", F.lit(1).alias("key"), F.lit(1.0).alias("same"), F.create_map(F.lit("a"), "id").alias("m"))
    cols = L.Columns(["same"], [])
    sizes = T._dealt_to_predict(rows, "key", ["same"], lambda df: L.impute_constants(df, cols)).groupBy("key", "_block").count().collect()
    assert len(sizes) == 30 and max(r["count"] for r in sizes) < 200
    forests = L.fit_each(rows.withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b")), cols, "key", None, L.Forest(trees=2, depth=2), ["id"], "label")
    out = L.predict_each(forests, rows)
    assert out.count() == 3000 and out.filter("model_prediction <> 'b' OR abs(probabilities['a'] + probabilities['b'] - 1) > 1e-9").isEmpty()


def test_rows_that_are_alike_are_fitted_as_one(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 2).cast("string").alias("t"), F.when((F.col("id") % 3 == 0) == (F.col("id") % 2 == 0), "a").otherwise("b").alias("label"), (1.0 + F.col("id") % 3).alias("w"))
    cols = L.Columns([], ["t"])
    sums = {(r.t, r.label): r.s for r in rows.groupBy("t", "label").agg(F.sum("w").alias("s")).collect()}
    assert {(r.t, r.label): r["_weight"] for r in L.merged(rows, cols, "w", "label").collect()} == sums and len(sums) == 4
    fitted = L.fit_forest(rows, cols, "w", L.Forest(trees=1, depth=4, min_leaf=1, features="all", bootstrap=False), "label")
    want = {r.t: r.p for r in rows.groupBy("t").agg((F.sum(F.when(F.col("label") == "a", F.col("w"))) / F.sum("w")).alias("p")).collect()}
    for r in L.predict(fitted, rows.select("t").distinct()).collect():
        assert r.probabilities["a"] == pytest.approx(want[r.t])


def test_importance_adds_up(log):
    forests = L.fit_each(log, COLS, "key", None, L.Forest(trees=2, depth=3, min_leaf=2, min_split=4, max_bins=8), ID, "label")
    shares = {}
    for r in T.importance(forests).collect():
        shares.setdefault(r.key, {})[r.feature] = r.importance
    assert all(sum(s.values()) == pytest.approx(1.0) for s in shares.values()) and set(shares[1]) <= {"a", "b", "c", "t=Missing", "t=x", "t=y"}


def test_a_forest_needs_inputs(log):
    with pytest.raises(ValueError):
        L.fit_each(log, L.Columns([], []), "key", None, L.Forest(trees=1), ID, "label")


def test_order_statistics_are_those_of_sorted_values(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), None if i % 3 else float(i % 7), (-1) ** i * 10 ** rng.uniform(-300, 300), None,
             float("inf") if i % 2 else -0.0, float("nan") if i % 5 else 1.0, i % 4) for i in range(1001)]
    names = list("abcdefg")
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g int").repartition(5)
    middle, cuts = Q.medians(df, names), Q.cut_points(df, names, 16)
    for j, c in enumerate(names):
        values = sorted(r[j] for r in rows if r[j] is not None and not math.isnan(r[j]))
        n = len(values)
        assert middle[c] == (pytest.approx(statistics.median(values)) if n else None)
        assert cuts[c] == sorted({values[(k * n + 15) // 16 - 1] for k in range(1, 16)} - {values[-1]} if n else set())
    assert Q.medians(df.limit(0), ["a"]) == {"a": None} and Q.medians(df, []) == {}


# ---- a model per date


@pytest.fixture(scope="module")
def career(spark):
    import datetime as dt

    rng = random.Random(5)
    rows, n = [], 0
    for key in (1, 2, 3):
        for game in range(11):
            day = dt.date(2023, 5, 1) + dt.timedelta(days=100 * game)
            for _ in range(rng.randint(12, 30)):
                a, t = rng.randrange(9), rng.choice(["x", "y", None])
                label = "FF" if a > 4 + key else "SL" if t == "x" else rng.choice(["CU", "FF"])
                rows.append((n, key, 10 * key + game, day, a, rng.random(), t, label if n % 17 else None))
                n += 1
        rows.append((n, key, 10 * key + 30, day, 1, 0.5, "x", "FF"))  # the second game of a day
        n += 1
    return spark.createDataFrame(rows, "row int, pitcher int, game_pk int, game_date date, a int, b double, t string, pitch_type string").repartition(4)


@pytest.mark.parametrize("most", [T.BLOCK, 100])
def test_models_of_all_dates_are_those_fitted_date_by_date(career, most):
    from dugout.operators import weights as W
    from dugout.plans import backtest as R
    from dugout.plans import forward

    cols = L.Columns(["a", "b"], ["t"])
    names = R.Log(row_id=("row",))
    forest = L.Forest(trees=3, depth=4, min_leaf=2, min_split=5, max_bins=8)
    rules = W.Rules(min_recent=10, min_older=10)
    bins = T.bins_of(L.impute_constants(career, cols), cols.numeric, cols.text, 8)
    log = career.filter("pitcher < 3") if most < T.BLOCK else career
    got = {r.row: r for r in forward.replay(log, cols, forest, names, bins, rules=rules, most=most).collect()}
    assert len(got) == log.count()

    def fit(history):
        rows = history.filter("pitch_type IS NOT NULL").withColumn("_season", F.year("game_date"))
        weighted = L.impute_constants(W.training_weights(rows, "pitcher", "pitch_type", "_target_season", rules, season="_season"), cols)
        fitted = T.fit_each(weighted, "pitcher", "pitch_type", "weight", cols.numeric, cols.text, forest, ["row"], bins=bins)
        return lambda some: L.predict_each(fitted, some)

    played = log.select("pitcher", "game_pk", F.col("game_date").alias("target_date")).distinct()
    days = sorted(r[0] for r in played.select("target_date").distinct().collect())
    wanted = [days[2], days[5], days[-1]] if most == T.BLOCK else [days[3]]
    for _, part in R.replay_days(log, played.filter(F.col("target_date").isin(wanted)), fit, names):
        for r in part.collect():
            g = got[r.row]
            assert (g.model_prediction, sorted(g.probabilities)) == (r.model_prediction, sorted(r.probabilities))
            assert [g.probabilities[c] for c in sorted(g.probabilities)] == pytest.approx([r.probabilities[c] for c in sorted(r.probabilities)])
    first = {r.row for r in log.filter(F.col("game_date") <= F.lit(days[1])).collect()}
    assert all((r.model_prediction is None) == (r.row in first) for r in got.values())


def _history(rng, n, classes, targets, factor):
    from dugout.plans import forward

    block = T.Block(np.array([[rng.randrange(30), rng.randrange(2), rng.randrange(9)] for _ in range(n)], np.uint8), np.array([rng.randrange(classes) for _ in range(n)]),
                    np.full(n, T.UNIT), np.array([rng.getrandbits(63) for _ in range(n)], np.uint64))
    day = np.array([rng.randrange(6) for _ in range(n)])
    return forward.History(block, day, 2020 + day // 2, [(t, [{"season": s, "factor": [factor(s, c) for c in range(classes)]} for s in range(2020, 2023)]) for t in targets], classes)


@pytest.mark.parametrize("tried", [2, 3])
def test_short_histories_grow_together_as_they_grow_alone(tried):
    from dugout.plans import forward

    rng = random.Random(9)
    spec = T.Spec(3, 4, 2, 5, tried, 3, 32, 4, True, 42)
    pasts = [(str(k), _history(rng, n, 4, targets, lambda s, c: 0.5 + 0.1 * c + (s - 2020) / 7), range(3))
             for k, (n, targets) in enumerate([(60, [2, 4, 5]), (1, [3]), (40, [5]), (30, [])])]
    for (key, past, numbers), got in zip(pasts, forward.shares_together(pasts, spec)):
        assert (got == forward.shares(past, key, numbers, spec)).all()
        assert got.any() == (len(past.targets) > 0 and len(past.day) > 1)


def test_classes_of_equal_weight_are_equal_whatever_their_rows():
    from dugout.plans import forward

    # three rows at 0.6144 and two at 0.9216 weigh the same, but not in whole units
    day, label = np.array([0, 0, 0, 0, 0, 1]), np.array([1, 1, 1, 0, 0, 0])
    block = T.Block(np.zeros((6, 1), np.uint8), label, np.full(6, T.UNIT), np.arange(6, dtype=np.uint64))
    past = forward.History(block, day, np.full(6, 2020), [(1, [{"season": 2020, "factor": [0.9216, 0.6144]}])], 2)
    spec = T.Spec(1, 1, 1, 2, 1, 1, 2, 2, False, 42)
    for got in (forward.shares(past, "1", range(1), spec), forward.shares_together([("1", past, range(1))], spec)[0]):
        assert got[5, 0] == got[5, 1] > 0


# ---- boosting


def test_boosting_is_that_of_a_plain_version(spark, log, tmp_path):
    from dugout.plans import boosting as X

    plan = X.Boosting(rounds=4, rate=0.3, depth=3, min_leaf=4, max_bins=8, held_out=0.2, patience=10)
    some = log.filter("row < 200 AND label IS NOT NULL")
    rows = L.impute_constants(some, COLS)
    model = X.fit(rows, COLS.numeric, COLS.text, "label", plan, ID, block=50)
    told = sorted((r for r in rows.select("*", F.xxhash64("row").alias("h")).collect()), key=lambda r: r.row)
    codes = np.array([[sum(cut < r[c] for cut in model.bins.cuts[c]) for c in COLS.numeric] + [int(r.t == v) for v in model.bins.categories["t"]] for r in told])
    label = np.array([model.classes.index(r.label) for r in told])
    held = X._held(np.array([r.h for r in told], np.int64).view(np.uint64), plan)
    scores = np.tile(np.log(np.bincount(label) / len(label)), (len(label), 1))
    for trees, (loss, _) in zip(model.rounds, model.losses):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        y = np.eye(len(model.classes))[label]
        step = np.zeros_like(scores)
        for c, tree in enumerate(trees):
            g, h = p[:, c] - y[:, c], p[:, c] * (1 - p[:, c])

            def grow(node, mine, depth):
                learn = mine[~held[mine]]
                G, H = g[learn].sum(), h[learn].sum()
                f, b, value = tree[node]
                if len(learn):
                    assert value == pytest.approx(-plan.rate * G / (H + plan.l2), abs=1e-6)
                options = []
                for i in range(codes.shape[1]):
                    for cut in range(model.bins.size - 1):
                        low, high = learn[codes[learn, i] <= cut], learn[codes[learn, i] > cut]
                        if min(len(low), len(high)) >= plan.min_leaf:
                            options.append(sum(g[s].sum() ** 2 / (h[s].sum() + plan.l2) for s in (low, high)) - G**2 / (H + plan.l2))
                        if (i, cut) == (f, b):
                            mine_gain = options[-1]
                if f < 0:
                    assert depth == plan.depth or not options or max(options) < 1e-6
                    step[mine, c] = value
                    return
                assert mine_gain == pytest.approx(max(options), abs=1e-6)
                grow(2 * node, mine[codes[mine, f] <= b], depth + 1)
                grow(2 * node + 1, mine[codes[mine, f] > b], depth + 1)

            grow(1, np.arange(len(label)), 0)
        scores = scores + step
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        assert loss == pytest.approx(-np.log(p[np.arange(len(label)), label])[~held].mean(), abs=1e-6)
    losses = [x for x, _ in model.losses]
    assert losses == sorted(losses, reverse=True) and len(set(losses)) == 4
    model.save(spark, str(tmp_path / "boosted"))
    out = {r.row: r for r in L.predict_boosted(X.Boosted.load(spark, str(tmp_path / "boosted")), some).collect()}
    assert [out[r.row].probabilities[model.classes[0]] for r in told] == pytest.approx(p[:, 0].tolist(), abs=1e-6)


def test_boosting_stops_early(spark):
    from dugout.plans import boosting as X

    rng = random.Random(1)
    noise = spark.createDataFrame([(i, rng.random(), rng.choice("ab")) for i in range(300)], "row int, x double, label string")
    model = X.fit(noise, ["x"], [], "label", X.Boosting(rounds=30, rate=0.5, depth=2, min_leaf=2, held_out=0.3, patience=2), ["row"])
    assert len(model.rounds) < 30
