"""Splits, baselines, replay and walk-forward backtest."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from dugout import columns as C
from dugout.operators import baselines as B
from dugout.operators import sequence as Q
from dugout.operators import split as P
from dugout.operators import weights as W
from dugout.plans import backtest as R
from dugout.plans import learning as L
from dugout.registry import query
from dugout.registry import weights as X
from dugout.registry.logs import SALES_LOG, sales_log, table
from dugout.session import cut_lineage

_GAMES = f"""{SALES_LOG},
g AS (SELECT pitcher, game_pk, min(game_date) AS first_date FROM log GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY first_date, game_pk) AS game_rank,
                  count(*) OVER (PARTITION BY pitcher) AS career_games FROM g),
flagged AS (SELECT *, CASE WHEN career_games >= 2 THEN game_rank > career_games -
              least(greatest(1, CAST(ceil(career_games * 0.2::DOUBLE) AS BIGINT)), career_games - 1) END AS is_test
            FROM ranked)"""
_SPLIT = f"{_GAMES}, parts AS (SELECT log.*, is_test FROM log JOIN flagged USING (pitcher, game_pk) WHERE is_test IS NOT NULL)"


def _hash(*parts: str, seed: int = 42) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 15)) AS BIGINT)"


@query("game_order", f"WITH {_GAMES} SELECT pitcher, game_pk, first_date, game_rank, career_games FROM ranked")
def game_order(spark, sf):
    return P.game_order(sales_log(spark, sf), "pitcher", "game_pk", "game_date")


@query("first_game_date", f"WITH {_GAMES} SELECT pitcher, game_pk, first_date FROM g")
def first_game_date(spark, sf):
    return P.games(sales_log(spark, sf), "pitcher", "game_pk", "game_date")


@query("chrono_split", f"WITH {_SPLIT} SELECT pitcher, game_pk, game_date, l_linenumber, pitch_type, is_test FROM parts")
def chrono_split(spark, sf):
    out = P.chronological_split(sales_log(spark, sf), "pitcher", "game_pk", "game_date")
    return out.select("pitcher", "game_pk", "game_date", "l_linenumber", "pitch_type", "is_test")


@query("unsplittable_keys", """
SELECT o_custkey AS pitcher, 'At least two games are required.' AS error
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1)
GROUP BY o_custkey""")
def unsplittable_keys(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pitcher"), F.col("o_orderkey").alias("game_pk"), F.col("o_orderdate").alias("game_date")
    )
    return P.unsplittable(P.chronological_games(orders, "pitcher", "game_pk", "game_date"), "pitcher")


@query("split_membership", f"""
WITH {_GAMES}
SELECT l.pitcher, l.game_pk, l.pitch_type, l.l_linenumber FROM log l
WHERE EXISTS (SELECT 1 FROM flagged f WHERE f.pitcher = l.pitcher AND f.game_pk = l.game_pk AND NOT is_test)""")
def split_membership(spark, sf):
    log = sales_log(spark, sf)
    flags = P.chronological_games(log, "pitcher", "game_pk", "game_date").filter(~F.col("is_test"))
    out = log.join(flags.select("pitcher", "game_pk"), ["pitcher", "game_pk"], "left_semi")
    return out.select("pitcher", "game_pk", "pitch_type", "l_linenumber")


@query("hash_split", f"""
WITH {SALES_LOG}
SELECT game_pk, pitch_type, l_linenumber, {_hash("game_pk", seed=7)} % 1000000 / 1000000.0::DOUBLE < 0.2::DOUBLE AS is_test FROM log""")
def hash_split(spark, sf):
    out = P.hash_split(sales_log(spark, sf), ["game_pk"], 0.2, seed=7)
    return out.select("game_pk", "pitch_type", "l_linenumber", "is_test")


@query("group_folds", f"""
WITH {SALES_LOG}
SELECT game_pk, pitch_type, l_linenumber, CAST({_hash("game_pk")} % 5 AS INTEGER) AS fold FROM log""")
def group_folds(spark, sf):
    return P.group_folds(sales_log(spark, sf), ["game_pk"]).select("game_pk", "pitch_type", "l_linenumber", "fold")


@query("sample_entities", """
SELECT s_suppkey, md5(concat('42|', s_suppkey)) AS draw FROM supplier ORDER BY draw, s_suppkey LIMIT 25""")
def sample_entities(spark, sf):
    return P.sample_entities(table(spark, sf, "supplier"), "s_suppkey", 25, 42)


@query("exclude_development", """
SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def exclude_development(spark, sf):
    seen = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(seen, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


# --- baselines --------------------------------------------------------------------------------
@query("majority_baseline", f"""
WITH {SALES_LOG}, c AS (SELECT pitcher, pitch_type, count(*) AS n FROM log GROUP BY ALL)
SELECT pitcher, pitch_type, n FROM c QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY n DESC, pitch_type) = 1""")
def majority_baseline(spark, sf):
    return B.majority(sales_log(spark, sf), ["pitcher"], "pitch_type")


@query("weighted_majority", f"""
WITH {SALES_LOG},
careers AS (SELECT pitcher, max(season) AS ref, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay
            FROM log GROUP BY pitcher),
t AS (SELECT pitcher, pitch_type, round(sum(greatest(pow(decay, ref - season), 0.1::DOUBLE)), 6) AS total_weight
      FROM log JOIN careers USING (pitcher) GROUP BY ALL)
SELECT pitcher, pitch_type, total_weight FROM t
QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY total_weight DESC, pitch_type) = 1""")
def weighted_majority(spark, sf):
    rows = W.recency_weights(sales_log(spark, sf), ["pitcher"], out="weight")
    return B.weighted_majority(rows, ["pitcher"], "pitch_type", "weight", digits=6)


_RANGES = """c AS (SELECT pitcher, pitch_type, count(*) AS n FROM train GROUP BY ALL),
ranges AS (SELECT pitcher, pitch_type,
   CAST(sum(n) OVER (PARTITION BY pitcher ORDER BY pitch_type) - n AS BIGINT) AS lo,
   CAST(sum(n) OVER (PARTITION BY pitcher ORDER BY pitch_type) AS BIGINT) AS hi,
   CAST(sum(n) OVER (PARTITION BY pitcher) AS BIGINT) AS total, n FROM c)"""


@query("class_priors", f"""
WITH {SALES_LOG}, train AS (SELECT * FROM log), {_RANGES}
SELECT pitcher, pitch_type, lo, hi, total, round(n / total, 6) AS prior FROM ranges""")
def class_priors(spark, sf):
    out = B.class_ranges(sales_log(spark, sf), ["pitcher"], "pitch_type")
    return out.withColumn("prior", F.round("prior", 6))


@query("stratified_baseline", f"""
WITH {_SPLIT}, train AS (SELECT * FROM parts WHERE NOT is_test), {_RANGES},
drawn AS (SELECT t.pitcher, game_pk, l_linenumber, l_partkey, t.pitch_type AS actual, {_hash("game_pk", "l_linenumber", "l_partkey")} AS h
          FROM parts t WHERE is_test)
SELECT d.pitcher, game_pk, l_linenumber, l_partkey, actual, r.pitch_type AS baseline_prediction
FROM drawn d LEFT JOIN ranges r ON d.pitcher = r.pitcher AND h % total >= lo AND h % total < hi""")
def stratified_baseline(spark, sf):
    # the split is read three times below
    parts = cut_lineage(P.chronological_split(sales_log(spark, sf), "pitcher", "game_pk", "game_date"))
    ranges = B.class_ranges(parts.filter(~F.col("is_test")), ["pitcher"], "pitch_type")
    test = parts.filter("is_test").withColumnRenamed("pitch_type", "actual")
    out = B.stratified(test, ranges, ["pitcher"], "pitch_type", ["game_pk", "l_linenumber", "l_partkey"])
    return out.select("pitcher", "game_pk", "l_linenumber", "l_partkey", "actual", "baseline_prediction")


@query("expected_stratified_accuracy", f"""
WITH {_SPLIT},
p AS (SELECT pitcher, pitch_type, count(*) / sum(count(*)) OVER (PARTITION BY pitcher) AS p_train FROM parts WHERE NOT is_test GROUP BY pitcher, pitch_type),
q AS (SELECT pitcher, pitch_type, count(*) / sum(count(*)) OVER (PARTITION BY pitcher) AS p_test FROM parts WHERE is_test GROUP BY pitcher, pitch_type)
SELECT pitcher, round(sum(coalesce(p_train, 0) * p_test), 6) AS expected_accuracy FROM q LEFT JOIN p USING (pitcher, pitch_type) GROUP BY pitcher""")
def expected_stratified_accuracy(spark, sf):
    parts = P.chronological_split(sales_log(spark, sf), "pitcher", "game_pk", "game_date")
    out = B.expected_stratified_accuracy(parts, ["pitcher"], "pitch_type")
    return out.withColumn("expected_accuracy", F.round("expected_accuracy", 6))


# --- replay -----------------------------------------------------------------------------------
CUSTOMERS = R.Log(
    key="pitcher", game="game_pk", date="game_date", label="pitch_type", row_id=("game_pk", "l_linenumber", "l_partkey")
)


def customer_log(spark, sf):
    """Customer = pitcher, order = game, part type = pitch type."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("game_date"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("pitch_type"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(parts, items.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").alias("pitcher"), F.col("o_orderkey").alias("game_pk"), "game_date", "l_linenumber",
            "l_partkey", "pitch_type", F.year("game_date").alias("season"),
        )
    )


_CUSTOMER_LOG = """log AS (
  SELECT o_custkey AS pitcher, o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS game_date, l_linenumber, l_partkey,
         p_type AS pitch_type, CAST(year(o_orderdate) AS INTEGER) AS season
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
# customers have short careers: the gates are the real ones, the row thresholds are not
FEW = 5
RULES = W.Rules(min_recent=FEW, min_older=FEW)
_H = _hash("game_pk", "l_linenumber", "l_partkey")

_MULTIPLIER = "coalesce(CASE WHEN l.season < a.latest_season THEN a.old_multiplier ELSE a.recent_multiplier END, 1.0::DOUBLE)"
_REPLAY = f"""{_CUSTOMER_LOG.replace("log AS (", "everything AS (", 1)},
targets AS (SELECT pitcher, max(game_date) AS target_date FROM everything GROUP BY pitcher),
train AS (SELECT everything.*, year(target_date) AS ref FROM everything JOIN targets USING (pitcher) WHERE game_date < target_date),
{X.CONTEXT.replace(SALES_LOG, "log AS (SELECT * FROM train)").replace(f">= {X.ENOUGH}", f">= {FEW}")}, {X._C_ADJ},
careers AS (SELECT pitcher, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay FROM train GROUP BY pitcher),
totals AS (SELECT l.pitcher, l.pitch_type, round(sum(greatest(pow(decay, ref - l.season), 0.1::DOUBLE) * {_MULTIPLIER}), 12) AS w
           FROM train l JOIN careers USING (pitcher) LEFT JOIN adj a ON a.pitcher = l.pitcher AND a.pitch_type = l.pitch_type GROUP BY ALL),
calls AS (SELECT pitcher, pitch_type AS model_prediction FROM totals
          QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY w DESC, pitch_type) = 1),
{_RANGES},
game_rows AS (SELECT everything.*, {_H} AS h FROM everything JOIN targets ON everything.pitcher = targets.pitcher AND game_date = target_date),
replayed AS (
  SELECT g.pitcher, game_pk, game_date, l_linenumber, l_partkey, g.pitch_type AS actual_pitch, model_prediction, r.pitch_type AS baseline_prediction,
         coalesce(model_prediction = g.pitch_type, false) AS model_correct, coalesce(r.pitch_type = g.pitch_type, false) AS baseline_correct
  FROM game_rows g LEFT JOIN calls ON calls.pitcher = g.pitcher
       LEFT JOIN ranges r ON r.pitcher = g.pitcher AND h % total >= lo AND h % total < hi)"""
_REPLAY_COLUMNS = ["pitcher", "game_pk", "l_linenumber", "l_partkey", "actual_pitch", "model_prediction",
                   "baseline_prediction", "model_correct", "baseline_correct"]


def _replayed(spark, sf):
    log = customer_log(spark, sf)
    last = log.groupBy("pitcher").agg(F.max("game_date").alias("target_date"))
    targets = log.join(last, "pitcher").filter(F.col("game_date") == F.col("target_date"))
    targets = targets.select("pitcher", "game_pk", "target_date").distinct()
    return R.replay_day(log, targets, CUSTOMERS, rules=RULES)


@query("replay_log", f"WITH {_REPLAY} SELECT {', '.join(_REPLAY_COLUMNS)} FROM replayed")
def replay_log(spark, sf):
    return _replayed(spark, sf).select(*_REPLAY_COLUMNS)


@query("leakage_filter", f"""
WITH {_CUSTOMER_LOG}, targets AS (SELECT pitcher, max(game_date) AS target_date FROM log GROUP BY pitcher)
SELECT pitcher, game_pk, l_linenumber, pitch_type FROM log JOIN targets USING (pitcher) WHERE game_date < target_date""")
def leakage_filter(spark, sf):
    log = customer_log(spark, sf)
    targets = log.groupBy("pitcher").agg(F.max("game_date").alias("target_date"))
    return R.before(log, targets, CUSTOMERS).select("pitcher", "game_pk", "l_linenumber", "pitch_type")


@query("target_rows", f"""
WITH {_CUSTOMER_LOG} SELECT pitcher, game_pk, l_linenumber, pitch_type FROM log WHERE game_pk % 10 = 0""")
def target_rows(spark, sf):
    log = customer_log(spark, sf)
    games = table(spark, sf, "orders").filter("o_orderkey % 10 = 0").select(
        F.col("o_custkey").alias("pitcher"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("game_pk")
    )
    return R.target_rows(log, games, CUSTOMERS).select("pitcher", "game_pk", "l_linenumber", "pitch_type")


@query("replay_results", f"""
WITH {_REPLAY},
r AS (SELECT pitcher, game_pk, count(*) AS pitch_count, count(*) FILTER (WHERE model_correct) AS model_correct,
             count(*) FILTER (WHERE baseline_correct) AS baseline_correct FROM replayed GROUP BY ALL)
SELECT pitcher, game_pk, pitch_count, model_correct, baseline_correct,
       round(model_correct / pitch_count, 6) AS model_accuracy, round(baseline_correct / pitch_count, 6) AS baseline_accuracy,
       round(model_correct / pitch_count - baseline_correct / pitch_count, 6) AS accuracy_over_baseline,
       CASE WHEN baseline_correct > 0 THEN round((model_correct / pitch_count - baseline_correct / pitch_count) / (baseline_correct / pitch_count), 6) END
         AS relative_improvement
FROM r""")
def replay_results(spark, sf):
    out = R.game_results(_replayed(spark, sf), ["pitcher", "game_pk"])
    rates = ["model_accuracy", "baseline_accuracy", "accuracy_over_baseline", "relative_improvement"]
    return out.select("pitcher", "game_pk", "pitch_count", "model_correct", "baseline_correct", *[F.round(c, 6).alias(c) for c in rates])


# --- walk-forward: in SQL every game looks at all earlier rows; in Spark running totals ---------
_FORWARD = f"""{_CUSTOMER_LOG},
t AS (SELECT DISTINCT pitcher, game_date, season AS y FROM log),
d AS (SELECT pitcher, game_date, season, pitch_type, count(*) AS n FROM log GROUP BY ALL),
gd AS (SELECT pitcher, game_date, count(DISTINCT game_pk) AS games FROM log GROUP BY ALL),
prior_games AS (SELECT t.pitcher, t.game_date, sum(games) AS prior_games FROM t JOIN gd ON gd.pitcher = t.pitcher AND gd.game_date < t.game_date GROUP BY ALL),
train AS (SELECT t.pitcher, t.game_date, y, d.season, d.pitch_type, sum(n) AS n FROM t JOIN d ON d.pitcher = t.pitcher AND d.game_date < t.game_date GROUP BY ALL),
careers AS (SELECT pitcher, game_date, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay FROM train GROUP BY ALL),
stot AS (SELECT pitcher, game_date, season, sum(n) AS total FROM train GROUP BY ALL),
lat AS (SELECT pitcher, game_date, max(season) AS latest_season, count(*) AS seasons FROM stot GROUP BY ALL),
rel AS (SELECT *, row_number() OVER (PARTITION BY pitcher, game_date ORDER BY season DESC) AS rk
        FROM stot JOIN lat USING (pitcher, game_date) WHERE season < latest_season AND total >= {FEW}),
prior_n AS (SELECT pitcher, game_date, pitch_type, sum(n) AS pn FROM train JOIN rel USING (pitcher, game_date, season) WHERE rk <= 2 GROUP BY ALL),
prior_t AS (SELECT pitcher, game_date, sum(total) AS pt FROM rel WHERE rk <= 2 GROUP BY ALL),
usages AS (SELECT k.pitcher, k.game_date, k.pitch_type, latest_season, coalesce(c.n, 0) / lt.total AS recent, coalesce(pn / pt, 0.0::DOUBLE) AS prior
           FROM (SELECT DISTINCT pitcher, game_date, pitch_type FROM train) k JOIN lat USING (pitcher, game_date) JOIN prior_t USING (pitcher, game_date)
           JOIN stot lt ON lt.pitcher = k.pitcher AND lt.game_date = k.game_date AND lt.season = latest_season
           LEFT JOIN train c ON c.pitcher = k.pitcher AND c.game_date = k.game_date AND c.season = latest_season AND c.pitch_type = k.pitch_type
           LEFT JOIN prior_n n ON n.pitcher = k.pitcher AND n.game_date = k.game_date AND n.pitch_type = k.pitch_type
           WHERE seasons >= 2 AND lt.total >= {FEW}),
adj AS (SELECT pitcher, game_date, pitch_type, latest_season, {X._smooth(X._C_DECLINE, X._C_RISE)} FROM usages),
totals AS (SELECT l.pitcher, l.game_date, l.pitch_type, sum(l.n) AS n, round(sum(l.n * greatest(pow(decay, y - l.season), 0.1::DOUBLE) * {_MULTIPLIER}), 12) AS w
           FROM train l JOIN careers USING (pitcher, game_date)
           LEFT JOIN adj a ON a.pitcher = l.pitcher AND a.game_date = l.game_date AND a.pitch_type = l.pitch_type GROUP BY ALL),
calls AS (SELECT pitcher, game_date, pitch_type AS model_prediction FROM totals
          QUALIFY row_number() OVER (PARTITION BY pitcher, game_date ORDER BY w DESC, pitch_type) = 1),
ranges AS (SELECT pitcher, game_date, pitch_type, sum(n) OVER (PARTITION BY pitcher, game_date ORDER BY pitch_type) - n AS lo,
                  sum(n) OVER (PARTITION BY pitcher, game_date ORDER BY pitch_type) AS hi, sum(n) OVER (PARTITION BY pitcher, game_date) AS total FROM totals),
forward AS (
  SELECT l.pitcher, l.game_pk, l.game_date, l.l_linenumber, l.l_partkey, l.pitch_type AS actual_pitch,
         CASE WHEN prior_games >= 2 THEN model_prediction END AS model_prediction,
         CASE WHEN prior_games >= 2 THEN r.pitch_type END AS baseline_prediction,
         CASE WHEN prior_games IS NULL THEN 'No pre-game history exists.' WHEN prior_games < 2 THEN 'At least two games are required.' END AS error
  FROM (SELECT *, {_H} AS h FROM log) l
  LEFT JOIN prior_games USING (pitcher, game_date)
  LEFT JOIN calls USING (pitcher, game_date)
  LEFT JOIN ranges r ON r.pitcher = l.pitcher AND r.game_date = l.game_date AND h % total >= lo AND h % total < hi)"""


def _forward(spark, sf):
    return R.walk_forward(customer_log(spark, sf), CUSTOMERS, rules=RULES)


@query("walk_forward", f"""
WITH {_FORWARD}
SELECT pitcher, game_pk, l_linenumber, l_partkey, actual_pitch, model_prediction, baseline_prediction, error FROM forward""")
def walk_forward(spark, sf):
    return _forward(spark, sf).select(
        "pitcher", "game_pk", "l_linenumber", "l_partkey", "actual_pitch", "model_prediction", "baseline_prediction", "error"
    )


@query("walk_forward_summary", f"""
WITH {_FORWARD},
g AS (SELECT year(game_date) AS season, pitcher, game_pk, count(*) AS n, count(*) FILTER (WHERE model_prediction = actual_pitch) AS m,
             count(*) FILTER (WHERE baseline_prediction = actual_pitch) AS b FROM forward WHERE error IS NULL GROUP BY ALL)
SELECT season, count(*) AS pitcher_games, count(DISTINCT pitcher) AS unique_pitchers, CAST(sum(n) AS BIGINT) AS total_pitches,
       CAST(sum(m) AS BIGINT) AS model_correct, CAST(sum(b) AS BIGINT) AS baseline_correct,
       round(sum(m) / sum(n), 6) AS model_accuracy, round(sum(b) / sum(n), 6) AS baseline_accuracy,
       round(avg(m / n), 6) AS mean_start_model_accuracy
FROM g GROUP BY season""")
def walk_forward_summary(spark, sf):
    from dugout.operators import report

    games = R.walk_forward_games(_forward(spark, sf), CUSTOMERS)
    out = report.season_summary(R.history_rows(games, CUSTOMERS, F.timestamp_seconds(F.lit(0))), ["season"])
    rates = ["model_accuracy", "baseline_accuracy", "mean_start_model_accuracy"]
    return out.select(
        "season", "pitcher_games", "unique_pitchers", "total_pitches", "model_correct", "baseline_correct",
        *[F.round(c, 6).alias(c) for c in rates],
    )


@query("walk_forward_status", f"""
WITH {_FORWARD}, g AS (SELECT pitcher, game_pk, max(error) AS error FROM forward GROUP BY ALL)
SELECT CASE WHEN error IS NULL THEN 'success' ELSE 'insufficient_history' END AS status, count(*) AS n FROM g GROUP BY 1""")
def walk_forward_status(spark, sf):
    from dugout.operators import report

    return report.status_counts(R.walk_forward_status(_forward(spark, sf), CUSTOMERS))


# --- experiments with the SQL-checkable classifier ----------------------------------------------
_ARM = """SELECT '{arm}' AS arm, pitcher, pitch_type, round(sum({w}), 12) AS w FROM weighted GROUP BY ALL"""


MAJORITY_ABLATION = f"""
WITH {_SPLIT}, tr AS (SELECT * FROM parts WHERE NOT is_test),
careers AS (SELECT pitcher, max(season) AS ref,
    greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS mild,
    greatest(0.65::DOUBLE, 0.92::DOUBLE - 0.02::DOUBLE * (count(DISTINCT season) - 1)) AS aggressive FROM tr GROUP BY pitcher),
weighted AS (SELECT tr.pitcher, pitch_type, 1.0::DOUBLE AS w0, greatest(pow(aggressive, ref - season), 0.05::DOUBLE) AS w1,
                    greatest(pow(mild, ref - season), 0.1::DOUBLE) AS w2 FROM tr JOIN careers USING (pitcher)),
totals AS ({_ARM.format(arm="unweighted", w="w0")} UNION ALL {_ARM.format(arm="current", w="w1")} UNION ALL {_ARM.format(arm="mild", w="w2")}),
calls AS (SELECT arm, pitcher, pitch_type AS guess FROM totals QUALIFY row_number() OVER (PARTITION BY arm, pitcher ORDER BY w DESC, pitch_type) = 1),
scored AS (SELECT arm, t.pitcher, round(avg(CASE WHEN guess = pitch_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS acc
           FROM parts t JOIN calls USING (pitcher) WHERE is_test GROUP BY ALL)
SELECT pitcher, max(acc) FILTER (WHERE arm = 'unweighted') AS baseline_accuracy, max(acc) FILTER (WHERE arm = 'unweighted') AS unweighted_accuracy,
       max(acc) FILTER (WHERE arm = 'current') AS current_accuracy, max(acc) FILTER (WHERE arm = 'mild') AS mild_accuracy
FROM scored GROUP BY pitcher"""


@query("ablation_majority", MAJORITY_ABLATION)
def ablation_majority(spark, sf):
    out = L.ablation(
        sales_log(spark, sf), "pitcher", "game_pk", "game_date", L.RECENCY_ARMS, L.majority_fit("pitcher")
    )
    return out.select("pitcher", *[F.round(c, 6).alias(c) for c in out.columns if c != "pitcher"])


# the repertoire arms need the usage context of the training rows: same SQL, other log
_TRAIN_CONTEXT = (
    X.CONTEXT.replace(SALES_LOG, _SPLIT.replace("log AS (", "everything AS (", 1).replace("FROM log", "FROM everything")
                      .replace("SELECT log.*", "SELECT everything.*") + ", log AS (SELECT * FROM parts WHERE NOT is_test)")
)
_CAT_WEIGHT = f"""CASE WHEN first_season < latest_season AND latest_total >= {X.ENOUGH} AND pt IS NOT NULL AND season < latest_season THEN
   CASE WHEN recent < 0.025::DOUBLE AND peak >= 0.03::DOUBLE THEN 0.1::DOUBLE
        WHEN prior >= 0.03::DOUBLE AND recent < prior * 0.8::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 1.0::DOUBLE END"""


def _arms_sql(ctes: str, weighted: str, arms: list[tuple[str, str]]) -> str:
    totals = " UNION ALL ".join(_ARM.format(arm=a, w=w) for a, w in arms)
    out = ", ".join(f"max(acc) FILTER (WHERE arm = '{a}') AS {a}_accuracy" for a, _ in arms)
    return f"""
WITH {ctes},
careers AS (SELECT pitcher, max(season) AS ref, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay FROM log GROUP BY pitcher),
weighted AS ({weighted}), totals AS ({totals}),
calls AS (SELECT arm, pitcher, pitch_type AS guess FROM totals QUALIFY row_number() OVER (PARTITION BY arm, pitcher ORDER BY w DESC, pitch_type) = 1),
scored AS (SELECT arm, t.pitcher, round(avg(CASE WHEN guess = pitch_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS acc
           FROM parts t JOIN calls USING (pitcher) WHERE is_test GROUP BY ALL)
SELECT pitcher, {out} FROM scored GROUP BY pitcher"""


_RECENT = "greatest(pow(decay, ref - season), 0.1::DOUBLE)"


@query("ablation_repertoire", _arms_sql(
    _TRAIN_CONTEXT,
    f"""SELECT l.pitcher, l.pitch_type, {_RECENT} AS r, {_CAT_WEIGHT} AS c FROM log l JOIN careers USING (pitcher)
        LEFT JOIN ctx ON ctx.pitcher = l.pitcher AND ctx.pitch_type = l.pitch_type""",
    [("unweighted", "1.0::DOUBLE"), ("recency", "r"), ("repertoire", "c"), ("combined", "r * c")],
))
def ablation_repertoire(spark, sf):
    arms = {
        "unweighted": (None, None), "recency": (W.MILD, None), "repertoire": (None, X.CATEGORICAL),
        "combined": (W.MILD, X.CATEGORICAL),
    }
    return _ablation(spark, sf, arms)


def _ablation(spark, sf, arms):
    out = L.ablation(sales_log(spark, sf), "pitcher", "game_pk", "game_date", arms, L.majority_fit("pitcher"))
    return out.select("pitcher", *[F.round(f"{a}_accuracy", 6).alias(f"{a}_accuracy") for a in arms])


@query("ablation_gated", _arms_sql(
    f"{_TRAIN_CONTEXT}, {X._C_ADJ}, {X._G_ADJ.replace('adj AS', 'gated_adj AS')}",
    f"""SELECT l.pitcher, l.pitch_type, {_RECENT} AS r,
               coalesce(CASE WHEN l.season < a.latest_season THEN a.old_multiplier ELSE a.recent_multiplier END, 1.0::DOUBLE) AS u,
               coalesce(CASE WHEN l.season < g.latest_season THEN g.old_multiplier ELSE g.recent_multiplier END, 1.0::DOUBLE) AS g
        FROM log l JOIN careers USING (pitcher)
        LEFT JOIN adj a ON a.pitcher = l.pitcher AND a.pitch_type = l.pitch_type
        LEFT JOIN gated_adj g ON g.pitcher = l.pitcher AND g.pitch_type = l.pitch_type""",
    [("unweighted", "1.0::DOUBLE"), ("recency", "r"), ("ungated", "r * u"), ("gated", "r * g")],
))
def ablation_gated(spark, sf):
    arms = {
        "unweighted": (None, None), "recency": (W.MILD, None), "ungated": (W.MILD, X.CONTINUOUS), "gated": (W.MILD, X.GATED),
    }
    return _ablation(spark, sf, arms)


@query("resume_games", """
SELECT o_orderkey AS game_pk, o_custkey AS pitcher_id, CAST(o_orderdate AS DATE) AS target_date
FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND o_orderkey % 3 <> 0""")
def resume_games(spark, sf):
    done = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_pk"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("pitcher_id"),
        F.when(F.col("o_orderkey") % 3 == 0, C.BACKTEST_VERSION).otherwise("older").alias("backtest_version"),
        F.lit("stratified").alias("baseline_strategy"),
    )
    return R.pending_games(customer_log(spark, sf), done, "1996-01-01", "1998-12-31", CUSTOMERS)


@query("career_profile", f"""
WITH {SALES_LOG} SELECT pitcher, count(DISTINCT season) AS career_seasons, count(DISTINCT game_pk) AS career_games, count(*) AS career_pitches
FROM log GROUP BY pitcher""")
def career_profile(spark, sf):
    return sales_log(spark, sf).groupBy("pitcher").agg(
        F.countDistinct("season").alias("career_seasons"), F.countDistinct("game_pk").alias("career_games"),
        F.count(F.lit(1)).alias("career_pitches"),
    )


@query("starter_dedup", """
SELECT o_custkey AS pitcher_id, max(o_orderkey) AS game_pk FROM orders GROUP BY o_custkey""")
def starter_dedup(spark, sf):
    starters = table(spark, sf, "orders").select(F.col("o_custkey").alias("pitcher_id"), F.col("o_orderkey").alias("game_pk"))
    return Q.keep_last(starters, ["pitcher_id"], ["game_pk"])


# --- questions for the classifiers that have the key as their only input -------------------------
_ROW_WEIGHT = """r * coalesce(CASE WHEN l.season < a.latest_season THEN a.old_multiplier ELSE a.recent_multiplier END, 1.0::DOUBLE)"""


def _weighted_calls(ref: str) -> str:
    """Weighted majority class per pitcher of ``log``, recency as of ``ref`` times repertoire."""
    return f"""{X._C_ADJ},
careers AS (SELECT pitcher, max(season) AS ref, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay FROM log GROUP BY pitcher),
aged AS (SELECT log.*, greatest(pow(decay, {ref} - season), 0.1::DOUBLE) AS r FROM log JOIN careers USING (pitcher)),
totals AS (SELECT l.pitcher, l.pitch_type, round(sum({_ROW_WEIGHT}), 12) AS w FROM aged l
           LEFT JOIN adj a ON a.pitcher = l.pitcher AND a.pitch_type = l.pitch_type GROUP BY ALL),
calls AS (SELECT pitcher, pitch_type AS guess FROM totals QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY w DESC, pitch_type) = 1)"""


_RIGHT = "avg(CASE WHEN guess = pitch_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
TRAINED = f"""
WITH {_TRAIN_CONTEXT}, {_weighted_calls("ref")}, train AS (SELECT * FROM log), {_RANGES},
drawn AS (SELECT t.pitcher, t.pitch_type AS actual, {_hash("game_pk", "l_linenumber", "l_partkey")} AS h FROM parts t WHERE is_test),
base AS (SELECT d.pitcher, avg(CASE WHEN r.pitch_type = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b
         FROM drawn d LEFT JOIN ranges r ON d.pitcher = r.pitcher AND h % total >= lo AND h % total < hi GROUP BY d.pitcher),
hits AS (SELECT pitcher, {_RIGHT} FILTER (NOT is_test) AS a, {_RIGHT} FILTER (is_test) AS t FROM parts JOIN calls USING (pitcher) GROUP BY pitcher),
sizes AS (SELECT pitcher, count(DISTINCT season) AS career_seasons, count(DISTINCT game_pk) AS career_games, count(*) AS career_pitches,
                 count(DISTINCT game_pk) FILTER (NOT is_test) AS train_games, count(DISTINCT game_pk) FILTER (is_test) AS test_games,
                 count(*) FILTER (NOT is_test) AS train_pitches, count(*) FILTER (is_test) AS test_pitches,
                 max(season) FILTER (NOT is_test) AS evaluation_reference_season, count(DISTINCT season) FILTER (NOT is_test) AS seasons
          FROM parts GROUP BY pitcher)
SELECT pitcher, career_seasons, career_games, career_pitches, train_games, test_games, train_pitches, test_pitches,
       evaluation_reference_season, round(a, 6) AS train_accuracy, round(t, 6) AS test_accuracy, round(b, 6) AS baseline_accuracy,
       round(t - b, 6) AS accuracy_over_baseline,
       round(greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (seasons - 1)), 6) AS evaluation_decay_factor,
       round(greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (career_seasons - 1)), 6) AS production_decay_factor,
       'chronological_game_split' AS split_method, 'mild_recency_x_continuous_repertoire' AS weighting_method,
       1 AS n_estimators, 30 AS max_depth, false AS bootstrap
FROM sizes JOIN hits USING (pitcher) JOIN base USING (pitcher)"""

# a pitcher before a year is a pitcher of its own
_BEFORE = 10000
YEARS_REPLAYED = f"""
WITH {SALES_LOG.replace("log AS (", "everything AS (", 1)},
years AS (SELECT DISTINCT season AS y FROM everything),
train AS (SELECT everything.* REPLACE (pitcher * {_BEFORE} + y AS pitcher) FROM everything JOIN years ON season < y),
totals AS (SELECT pitcher, pitch_type, sum(greatest(pow(0.5::DOUBLE, pitcher % {_BEFORE} - season), 0.125::DOUBLE)) AS w FROM train GROUP BY ALL),
calls AS (SELECT pitcher, pitch_type AS guess FROM totals QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY w DESC, pitch_type) = 1),
{_RANGES},
played AS (SELECT pitcher * {_BEFORE} + season AS pitcher, season, pitch_type AS actual, {_hash("game_pk", "l_linenumber", "l_partkey")} AS h FROM everything)
SELECT p.pitcher // {_BEFORE} AS pitcher, make_date(season, 1, 1) AS game_date, count(*) AS pitch_count,
       count(*) FILTER (WHERE guess = actual) AS model_correct, count(*) FILTER (WHERE r.pitch_type = actual) AS baseline_correct
FROM played p LEFT JOIN calls ON calls.pitcher = p.pitcher
     LEFT JOIN ranges r ON r.pitcher = p.pitcher AND h % total >= lo AND h % total < hi
WHERE season > (SELECT min(y) FROM years) GROUP BY ALL"""


# --- folds of equal size, groups of several rows --------------------------------------------------
FOLDS = 4


@query("balanced_folds", f"""
WITH RECURSIVE sizes AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY user_id),
greedy AS (
    SELECT 0::BIGINT AS i, [0::BIGINT for k in range({FOLDS})] AS loads, [0::BIGINT for k in range({FOLDS})] AS held
    UNION ALL
    SELECT s.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + n ELSE x END),
           list_transform(held, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + 1 ELSE x END)
    FROM greedy g JOIN sizes s ON s.i = g.i + 1)
SELECT k::INTEGER - 1 AS fold, loads[k] AS n_rows, held[k] AS n_groups, 1::BIGINT AS folds_of_a_group
FROM (SELECT * FROM greedy ORDER BY i DESC LIMIT 1), range(1, {FOLDS + 1}) r(k) WHERE held[k] > 0""")
def balanced_folds(spark, sf):
    """Rows and groups of each fold, largest group first into the lightest fold."""
    rows = P.balanced_folds(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], FOLDS)
    groups = rows.groupBy("user_id").agg(F.min("fold").alias("fold"), F.countDistinct("fold").alias("several"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("several").alias("folds_of_a_group"))


# --- a day's replay as one flow, every year as a day ----------------------------------------------
@query("day_replay_flow", f"""
WITH {SALES_LOG.replace("log AS (", "everything AS (", 1)},
sched AS (SELECT o_orderkey AS game_pk, CAST(c_nationkey AS BIGINT) AS pitcher, year(o_orderdate) AS y, o_orderstatus = 'F' AS final
          FROM orders JOIN customer ON o_custkey = c_custkey),
starts AS (SELECT DISTINCT pitcher, y FROM sched),
past AS (SELECT s.pitcher, y, count(DISTINCT e.game_pk) AS n FROM starts s LEFT JOIN everything e ON e.pitcher = s.pitcher AND e.season < y GROUP BY ALL),
train AS (SELECT everything.* REPLACE (everything.pitcher * {_BEFORE} + y AS pitcher) FROM everything JOIN starts ON starts.pitcher = everything.pitcher AND season < y),
decays AS (SELECT pitcher, greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay FROM train GROUP BY pitcher),
weighed AS (SELECT pitcher, pitch_type, round(sum(greatest(pow(decay, pitcher % {_BEFORE} - season), 0.1::DOUBLE)), 12) AS w FROM train JOIN decays USING (pitcher) GROUP BY ALL),
calls AS (SELECT pitcher, pitch_type AS guess FROM weighed QUALIFY row_number() OVER (PARTITION BY pitcher ORDER BY w DESC, pitch_type) = 1),
{_RANGES},
played AS (SELECT e.pitcher * {_BEFORE} + y AS pitcher, e.game_pk, e.pitch_type AS actual, {_hash("e.game_pk", "l_linenumber", "l_partkey")} AS h
           FROM everything e JOIN sched s ON s.game_pk = e.game_pk AND s.pitcher = e.pitcher),
games AS (SELECT p.game_pk, count(*) AS pitches, count(*) FILTER (WHERE guess = actual) AS m, count(*) FILTER (WHERE r.pitch_type = actual) AS b
          FROM played p LEFT JOIN calls ON calls.pitcher = p.pitcher LEFT JOIN ranges r ON r.pitcher = p.pitcher AND h % total >= lo AND h % total < hi GROUP BY p.game_pk),
told AS (SELECT y, g.*, CASE WHEN NOT final THEN 'game_not_final' WHEN n < 2 THEN 'failed' WHEN pitches IS NULL THEN 'statcast_not_ready' ELSE 'success' END AS status
         FROM sched JOIN past USING (pitcher, y) LEFT JOIN games g USING (game_pk))
SELECT strftime(make_date(y, 1, 1), '%Y-%m-%d') AS game_date, count(*) AS starter_records, count(*) FILTER (status = 'success') AS successful,
       count(*) FILTER (status = 'statcast_not_ready') AS statcast_not_ready, count(*) FILTER (status = 'failed') AS failed,
       count(*) FILTER (status = 'game_not_final') AS game_not_final, coalesce(sum(pitches) FILTER (status = 'success'), 0)::BIGINT AS total_pitches,
       coalesce(sum(m) FILTER (status = 'success'), 0)::BIGINT AS model_correct, coalesce(sum(b) FILTER (status = 'success'), 0)::BIGINT AS baseline_correct,
       count(*) FILTER (status = 'success') AS history_rows
FROM told GROUP BY y""")
def day_replay_flow(spark, sf):
    """From schedule documents to stored summaries and history; a year stands for a day."""
    from dugout.plans import day
    from dugout.session import scratch_path, stored
    from dugout.sources import readers, sinks

    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    team = lambda n, pitcher: F.struct(
        F.struct(n.cast("bigint").alias("id"), F.concat(F.lit("T"), n.cast("string")).alias("name"), F.lit("T").alias("abbreviation")).alias("team"),
        F.lit(0).alias("score"), pitcher.alias("probablePitcher"))
    starter = F.struct(F.col("c_nationkey").cast("bigint").alias("id"), F.lit("P").alias("fullName"))
    state = F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Scheduled")
    game = F.struct(
        F.col("o_orderkey").alias("gamePk"), F.date_format(F.trunc("o_orderdate", "year"), "yyyy-MM-dd").alias("officialDate"), F.lit("t").alias("gameDate"),
        F.struct(state.alias("detailedState")).alias("status"),
        F.struct(team(F.col("c_nationkey"), starter).alias("away"), team(F.col("c_nationkey") + 100, F.lit(None).cast(starter_type())).alias("home")).alias("teams"))
    path = scratch_path(spark, "schedule")
    sinks.write_json(orders.select(F.array(F.struct(F.array(game).alias("games"))).alias("dates")), path)
    schedule = spark.read.schema(readers.SCHEDULE_DDL).json(path)
    log = stored(sales_log(spark, sf).withColumn("game_date", F.trunc("game_date", "year")).drop("season"), scratch_path(spark, "log"))
    names = R.Log(row_id=("game_pk", "l_linenumber", "l_partkey"))
    root = scratch_path(spark, "replays")
    days = day.prepared(schedule, log, names)
    dates = [r[0] for r in days.starters.select("official_date").distinct().orderBy("official_date").collect()]
    summaries = [day.replay(schedule, log, d, root, names, rules=None, evaluated_at=F.timestamp_seconds(F.lit(0)), days=days).summary for d in dates]
    known = readers.read_history(spark, f"{root}/history").groupBy(F.col("game_date").alias("_d")).agg(F.count(F.lit(1)).alias("history_rows"))
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.join(known, F.col("game_date") == F.col("_d"), "left").select(
        "game_date", "starter_records", "successful", "statcast_not_ready", "failed", "game_not_final", "total_pitches", "model_correct", "baseline_correct",
        F.coalesce("history_rows", F.lit(0)).alias("history_rows"))


def starter_type() -> str:
    return "struct<id: bigint, fullName: string>"


@query("ablation_continuous", _arms_sql(
    f"{_TRAIN_CONTEXT}, {X._C_ADJ}",
    f"""SELECT l.pitcher, l.pitch_type, r, c,
               coalesce(CASE WHEN l.season < a.latest_season THEN a.old_multiplier ELSE a.recent_multiplier END, 1.0::DOUBLE) AS u
        FROM (SELECT l.pitcher, l.pitch_type, l.season, {_RECENT} AS r, {_CAT_WEIGHT.replace("peak >=", "prior >=")} AS c FROM log l JOIN careers USING (pitcher)
              LEFT JOIN ctx ON ctx.pitcher = l.pitcher AND ctx.pitch_type = l.pitch_type) l
        LEFT JOIN adj a ON a.pitcher = l.pitcher AND a.pitch_type = l.pitch_type""",
    [("unweighted", "1.0::DOUBLE"), ("recency", "r"), ("categorical", "r * c"), ("continuous", "r * u")],
))
def ablation_continuous(spark, sf):
    """Fixed multipliers against usage as it is, both by prior usage."""
    prior = dataclasses.replace(X.CATEGORICAL, peak=False)
    arms = {"unweighted": (None, None), "recency": (W.MILD, None), "categorical": (W.MILD, prior), "continuous": (W.MILD, X.CONTINUOUS)}
    return _ablation(spark, sf, arms)
