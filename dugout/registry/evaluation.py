"""Scores and reports on the order history and on logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout.operators import evaluation as E
from dugout.operators import report as R
from dugout.registry import query
from dugout.registry.logs import EVENT_CLASSES, EVENT_LOG, GAME_HISTORY, SALES_LOG, event_log, game_history, sales_log, table

# a prediction log from the events: the previous event of the user is the prediction
_PRED = f"""{EVENT_LOG},
pred AS (SELECT event_id, pitcher, game, pitch_type AS actual,
                coalesce(lag(pitch_type) OVER (PARTITION BY pitcher ORDER BY ts, event_id), 'view') AS guess FROM log)"""


def _predictions(spark, sf):
    from dugout.operators import sequence as Q

    log = Q.add(event_log(spark, sf), ["pitcher"], ["ts", "event_id"], [Q.lag("guess", "pitch_type")])
    return log.select("event_id", "pitcher", "game", F.col("pitch_type").alias("actual"),
                      F.coalesce("guess", F.lit("view")).alias("guess"))


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("accuracy", f"""
WITH {_PRED}
SELECT pitcher, count(*) AS n, count(*) FILTER (WHERE guess = actual) AS n_correct,
       round(avg(CASE WHEN guess = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
FROM pred GROUP BY pitcher""")
def accuracy(spark, sf):
    return _round(E.accuracy(_predictions(spark, sf), ["pitcher"], "guess", "actual"), "accuracy")


@query("confusion_matrix", f"""
WITH {_PRED}
SELECT actual, {", ".join(f"count(*) FILTER (WHERE guess = '{c}') AS {c}" for c in EVENT_CLASSES)} FROM pred GROUP BY actual""")
def confusion_matrix(spark, sf):
    return E.confusion_wide(_predictions(spark, sf), "actual", "guess", EVENT_CLASSES)


@query("class_report", f"""
WITH {_PRED},
c AS (SELECT label, count(*) FILTER (WHERE actual = label) AS support, count(*) FILTER (WHERE guess = label) AS called,
             count(*) FILTER (WHERE actual = label AND guess = label) AS hits
      FROM pred, (SELECT DISTINCT actual AS label FROM pred) GROUP BY label),
s AS (SELECT label, coalesce(hits / nullif(called, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r, support, hits FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, sf):
    return _round(E.class_report(_predictions(spark, sf), "actual", "guess"), "precision", "recall", "f1")


@query("breadth", f"""
WITH {_PRED}, h AS (SELECT pitcher, guess, count(*) FILTER (WHERE guess = actual) AS hits FROM pred GROUP BY ALL)
SELECT pitcher, count(*) FILTER (WHERE hits >= 3) AS breadth FROM h GROUP BY pitcher""")
def breadth(spark, sf):
    rows = _predictions(spark, sf).withColumn("correct", F.col("guess") == F.col("actual"))
    return E.breadth(rows, ["pitcher"], "guess", "correct")


_REL = "CASE WHEN {b} > 0 THEN round(({m} - {b}) / {b}, 6) END"


@query("relative_improvement", f"""
WITH {GAME_HISTORY}
SELECT game_pk, round(model_accuracy - baseline_accuracy, 6) AS accuracy_over_baseline,
       round((model_accuracy - baseline_accuracy) * 100, 4) AS accuracy_over_baseline_pp,
       {_REL.format(m="model_accuracy", b="baseline_accuracy")} AS relative_improvement
FROM history""")
def relative_improvement(spark, sf):
    out = E.lift(game_history(spark, sf))
    return out.select(
        "game_pk", F.round("accuracy_over_baseline", 6).alias("accuracy_over_baseline"),
        F.round("accuracy_over_baseline_pp", 4).alias("accuracy_over_baseline_pp"),
        F.round("relative_improvement", 6).alias("relative_improvement"),
    )


_DAILY = f"""{GAME_HISTORY},
daily AS (SELECT game_date, count(*) AS pitcher_games, count(DISTINCT pitcher_id) AS pitchers, CAST(sum(pitch_count) AS BIGINT) AS pitches,
                 CAST(sum(model_correct) AS BIGINT) AS model_correct, CAST(sum(baseline_correct) AS BIGINT) AS baseline_correct
          FROM history GROUP BY game_date),
rated AS (SELECT *, model_correct / pitches AS ma, baseline_correct / pitches AS ba,
                 CASE WHEN baseline_correct > 0 THEN (model_correct / pitches - baseline_correct / pitches) / (baseline_correct / pitches) END AS rel FROM daily)"""


@query("daily_frame", f"""
WITH {_DAILY}
SELECT game_date, pitcher_games, pitchers, pitches, model_correct, baseline_correct, round(ma, 6) AS model_accuracy,
       round(ba, 6) AS baseline_accuracy, round(rel, 6) AS relative_improvement FROM rated""")
def daily_frame(spark, sf):
    out = R.daily_frame(R.evaluated_games(game_history(spark, sf)))
    return _round(out, "model_accuracy", "baseline_accuracy", "relative_improvement")


@query("daily_extremes", f"""
WITH {_DAILY}, r AS (SELECT game_date, round(rel, 6) AS rel FROM rated)
SELECT min(rel) AS lowest, max(rel) AS highest, max(game_date) FILTER (WHERE rel = (SELECT max(rel) FROM r)) AS peak_day FROM r""")
def daily_extremes(spark, sf):
    return R.daily_extremes(_round(R.daily_frame(game_history(spark, sf)), "relative_improvement"))


_POOLED = """SELECT count(DISTINCT game_pk) AS games, count(*) AS pitcher_games, count(DISTINCT pitcher_id) AS pitchers,
       CAST(sum(pitch_count) AS BIGINT) AS pitches, count(*) FILTER (WHERE model_correct > baseline_correct) AS beat_baseline,
       round(sum(model_correct) / sum(pitch_count), 6) AS model_accuracy, round(sum(baseline_correct) / sum(pitch_count), 6) AS baseline_accuracy,
       CASE WHEN sum(baseline_correct) > 0 THEN
         round((sum(model_correct) / sum(pitch_count) - sum(baseline_correct) / sum(pitch_count)) / (sum(baseline_correct) / sum(pitch_count)), 6) END AS relative_improvement
FROM """
_POOLED_RATES = ("model_accuracy", "baseline_accuracy", "relative_improvement")


@query("pooled_totals", f"WITH {GAME_HISTORY} {_POOLED} history")
def pooled_totals(spark, sf):
    return _round(R.pooled_totals(game_history(spark, sf)), *_POOLED_RATES)


@query("last_n_dates", f"""
WITH {GAME_HISTORY}, days AS (SELECT DISTINCT game_date FROM history ORDER BY game_date DESC LIMIT 30)
SELECT game_pk, game_date, pitch_count FROM history WHERE game_date IN (SELECT game_date FROM days)""")
def last_n_dates(spark, sf):
    return R.last_dates(game_history(spark, sf), 30).select("game_pk", "game_date", "pitch_count")


@query("window_report", f"""
WITH {GAME_HISTORY}, days AS (SELECT DISTINCT game_date FROM history ORDER BY game_date DESC LIMIT 365),
win AS (SELECT * FROM history WHERE game_date IN (SELECT game_date FROM days)) {_POOLED} win""")
def window_report(spark, sf):
    return _round(R.pooled_totals(R.last_dates(R.evaluated_games(game_history(spark, sf)), 365)), *_POOLED_RATES)


@query("window_report_tables", f"""
WITH {GAME_HISTORY}, days AS (SELECT DISTINCT game_date FROM history ORDER BY game_date DESC LIMIT 365),
win AS (SELECT * FROM history WHERE game_date IN (SELECT game_date FROM days)),
rel AS (SELECT *, CASE WHEN b > 0 THEN round((m / p - b / p) / (b / p), 6) END AS rel FROM (
    SELECT game_date, count(*) AS starts, count(DISTINCT pitcher_id) AS pitchers, sum(pitch_count)::BIGINT AS p, sum(model_correct)::BIGINT AS m, sum(baseline_correct)::BIGINT AS b
    FROM win GROUP BY ROLLUP (game_date)))
SELECT CASE WHEN game_date IS NULL THEN 'totals' ELSE 'daily' END AS part, game_date, starts, pitchers, p AS pitches, round(m / p, 6) AS model_accuracy, rel AS relative_improvement FROM rel
UNION ALL SELECT 'lowest', NULL, NULL, NULL, NULL, NULL, min(rel) FROM rel WHERE game_date IS NOT NULL
UNION ALL SELECT 'highest', max(game_date) FILTER (rel = (SELECT max(rel) FROM rel WHERE game_date IS NOT NULL)), NULL, NULL, NULL, NULL, max(rel) FROM rel WHERE game_date IS NOT NULL
UNION ALL (SELECT 'showcase', game_date, NULL, NULL, pitch_count, round(model_correct / pitch_count, 6), NULL FROM win
           WHERE pitch_count >= 5 ORDER BY model_correct / pitch_count DESC, game_pk, pitcher_id LIMIT 1)""")
def window_report_tables(spark, sf):
    """All four tables of the report of the latest dates, one under the other."""
    history = game_history(spark, sf)
    logs = table(spark, sf, "lineitem").join(history.select("game_pk", "pitcher_id"), F.col("l_orderkey") == F.col("game_pk")).select(
        "game_pk", "pitcher_id", F.col("l_returnflag").alias("model_prediction"), F.lit(True).alias("model_correct"))
    report = R.window_report(history, 365, logs, min_pitches=5, min_classes=0, times=1)
    part = lambda df, name: df.select(F.lit(name).alias("part"), *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(o)
        for c, t, o in (("game_date", "date", "game_date"), ("pitcher_games", "bigint", "starts"), ("pitchers", "bigint", "pitchers"), ("pitches", "bigint", "pitches"),
                        ("model_accuracy", "double", "model_accuracy"), ("relative_improvement", "double", "relative_improvement"))])
    ends = R.daily_extremes(_round(report.daily, "relative_improvement"))
    table_ = part(report.daily, "daily").unionByName(part(report.totals, "totals"))
    table_ = table_.unionByName(part(ends.select(F.col("lowest").alias("relative_improvement")), "lowest"))
    table_ = table_.unionByName(part(ends.select(F.col("highest").alias("relative_improvement"), F.col("peak_day").alias("game_date")), "highest"))
    best = report.showcase.select("game_date", F.col("pitch_count").alias("pitches"), "model_accuracy")
    return _round(table_.unionByName(part(best, "showcase")), "model_accuracy", "relative_improvement")


_OUTINGS = """outings AS (
  SELECT user_id AS pitcher, CAST(date_trunc('week', ts) AS DATE) AS game, event_id, ts, event_type AS pitch, event_id * 7 % 10 < 6 AS hit FROM events)"""


def _outings(spark, sf):
    from dugout.registry.logs import event_log

    return event_log(spark, sf).select(
        "pitcher", F.col("game").alias("game_pk"), "ts", "event_id", F.col("pitch_type").alias("actual_pitch"), (F.col("event_id") * 7 % 10 < 6).alias("model_correct"))


@query("outing_hits", f"""
WITH {_OUTINGS}, numbered AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY pitcher, game, hit ORDER BY ts, event_id) AS island FROM outings
                              WINDOW w AS (PARTITION BY pitcher, game ORDER BY ts, event_id)),
runs AS (SELECT pitcher, game, hit, island, count(*) AS n, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM numbered GROUP BY ALL),
told AS (SELECT pitcher, game, string_agg(n || ' ' || CASE WHEN hit THEN 'correct' ELSE 'missed' END, ', ' ORDER BY t, e) AS hits FROM runs GROUP BY ALL)
SELECT pitcher, game AS game_pk, count(*) AS pitches, count(*) FILTER (hit) AS correct, any_value(hits) AS hits FROM outings JOIN told USING (pitcher, game) GROUP BY ALL""")
def outing_hits(spark, sf):
    """Every outing's hits and misses as runs, in order."""
    return R.outing_hits(_outings(spark, sf), order=["ts", "event_id"]).select("pitcher", "game_pk", "pitches", "correct", "hits")


@query("outing_repertoire", f"""
WITH {_OUTINGS}
SELECT pitcher, game AS game_pk, pitch, CASE pitch WHEN 'view' THEN 'View' ELSE pitch END AS name, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY pitcher, game), 6) AS thrown, count(*) FILTER (hit) AS correct FROM outings GROUP BY pitcher, game, pitch""")
def outing_repertoire(spark, sf):
    out = R.outing_repertoire(_outings(spark, sf), names={"view": "View"})
    return _round(out, "thrown").select("pitcher", "game_pk", "pitch", "name", "count", "thrown", "correct")


@query("evaluated_games", f"""
WITH {GAME_HISTORY} SELECT game_pk, pitch_count FROM history WHERE game_pk % 7 <> 0 AND game_pk % 11 <> 0""")
def evaluated_games(spark, sf):
    rows = game_history(spark, sf).withColumns(
        {
            "pitch_count": F.when(F.col("game_pk") % 7 == 0, "n/a").otherwise(F.col("pitch_count").cast("string")),
            "game_date": F.when(F.col("game_pk") % 11 == 0, "unknown").otherwise(F.col("game_date").cast("string")),
        }
    )
    return R.evaluated_games(rows).select("game_pk", "pitch_count")


@query("min_size", f"WITH {GAME_HISTORY} SELECT game_pk, pitch_count FROM history WHERE pitch_count >= 5")
def min_size(spark, sf):
    return game_history(spark, sf).filter("pitch_count >= 5").select("game_pk", "pitch_count")


@query("showcase", f"""
WITH {_PRED}, g AS (SELECT pitcher, count(*) AS pitch_count, count(*) FILTER (WHERE guess = actual) / count(*) AS acc FROM pred GROUP BY pitcher),
h AS (SELECT pitcher, guess, count(*) FILTER (WHERE guess = actual) AS hits FROM pred GROUP BY ALL),
b AS (SELECT pitcher, count(*) FILTER (WHERE hits >= 3) AS breadth FROM h GROUP BY pitcher)
SELECT pitcher, pitch_count, round(acc, 6) AS model_accuracy, breadth FROM g JOIN b USING (pitcher)
WHERE pitch_count >= 60 AND breadth >= 3 ORDER BY acc DESC, pitcher LIMIT 1""")
def showcase(spark, sf):
    logs = _predictions(spark, sf).select(
        "pitcher", F.col("guess").alias("model_prediction"), (F.col("guess") == F.col("actual")).alias("model_correct")
    )
    games = logs.groupBy("pitcher").agg(
        F.count(F.lit(1)).alias("pitch_count"), F.avg(F.col("model_correct").cast("double")).alias("model_accuracy")
    )
    return _round(R.showcase(games, logs, ["pitcher"], min_pitches=60), "model_accuracy")


_DAY = f"""{GAME_HISTORY},
day AS (SELECT *, CASE order_status WHEN 'F' THEN 'success' WHEN 'P' THEN 'game_not_final'
                  ELSE CASE WHEN game_pk % 2 = 0 THEN 'statcast_not_ready' ELSE 'failed' END END AS replay_status FROM history)"""


def _day(spark, sf):
    s, even = F.col("order_status"), F.col("game_pk") % 2 == 0
    status = (
        F.when(s == "F", "success").when(s == "P", "game_not_final")
        .otherwise(F.when(even, "statcast_not_ready").otherwise("failed"))
    )
    return game_history(spark, sf).withColumn("replay_status", status)


@query("day_status_summary", f"""
WITH {_DAY},
d AS (SELECT game_date, count(*) AS starter_records, count(*) FILTER (WHERE replay_status = 'success') AS successful,
             count(*) FILTER (WHERE replay_status = 'statcast_not_ready') AS statcast_not_ready, count(*) FILTER (WHERE replay_status = 'failed') AS failed,
             count(*) FILTER (WHERE replay_status = 'game_not_final') AS game_not_final,
             CAST(coalesce(sum(pitch_count) FILTER (WHERE replay_status = 'success'), 0) AS BIGINT) AS total_pitches,
             CAST(coalesce(sum(model_correct) FILTER (WHERE replay_status = 'success'), 0) AS BIGINT) AS model_correct,
             CAST(coalesce(sum(baseline_correct) FILTER (WHERE replay_status = 'success'), 0) AS BIGINT) AS baseline_correct
      FROM day GROUP BY game_date)
SELECT *, round(model_correct / nullif(total_pitches, 0), 6) AS model_accuracy, round(baseline_correct / nullif(total_pitches, 0), 6) AS baseline_accuracy,
       round((model_correct - baseline_correct) / nullif(total_pitches, 0), 6) AS accuracy_over_baseline,
       CASE WHEN baseline_correct > 0 THEN round((model_correct / total_pitches - baseline_correct / total_pitches) / (baseline_correct / total_pitches), 6) END AS relative_improvement
FROM d""")
def day_status_summary(spark, sf):
    out = R.day_status(_day(spark, sf), ["game_date"]).drop("accuracy_over_baseline_pp", "relative_improvement_percent")
    return _round(out, "model_accuracy", "baseline_accuracy", "accuracy_over_baseline", "relative_improvement")


@query("season_summary", f"""
WITH {GAME_HISTORY}
SELECT season, count(*) AS pitcher_games, count(DISTINCT pitcher_id) AS unique_pitchers, CAST(sum(pitch_count) AS BIGINT) AS total_pitches,
       CAST(sum(model_correct) AS BIGINT) AS model_correct, CAST(sum(baseline_correct) AS BIGINT) AS baseline_correct,
       round(avg(model_accuracy), 6) AS mean_start_model_accuracy, round(avg(baseline_accuracy), 6) AS mean_start_baseline_accuracy,
       round(avg((model_accuracy - baseline_accuracy) * 100), 4) AS mean_start_lift_pp,
       round(avg(CASE WHEN baseline_accuracy > 0 THEN (model_accuracy - baseline_accuracy) / baseline_accuracy END), 6) AS mean_start_relative_improvement,
       round(sum(model_correct) / sum(pitch_count), 6) AS model_accuracy, round(sum(baseline_correct) / sum(pitch_count), 6) AS baseline_accuracy
FROM history GROUP BY season""")
def season_summary(spark, sf):
    out = R.season_summary(E.lift(game_history(spark, sf)), ["season"])
    out = out.drop("accuracy_over_baseline", "accuracy_over_baseline_pp", "relative_improvement", "relative_improvement_percent")
    out = _round(out, "mean_start_model_accuracy", "mean_start_baseline_accuracy", "mean_start_relative_improvement", "model_accuracy", "baseline_accuracy")
    return _round(out, "mean_start_lift_pp", digits=4)


@query("season_filter", f"""
WITH {GAME_HISTORY}
SELECT game_pk, pitcher_id, game_date FROM history
WHERE season = 1997 AND game_date BETWEEN DATE '1997-03-01' AND DATE '1997-10-31' AND game_pk % 5 <> 0""")
def season_filter(spark, sf):
    rows = game_history(spark, sf).withColumn(
        "backtest_version", F.when(F.col("game_pk") % 5 == 0, "older").otherwise("v1")
    )
    return R.season_rows(rows, 1997, "1997-03-01", "1997-10-31", "v1").select("game_pk", "pitcher_id", "game_date")


@query("status_counts", f"WITH {_DAY} SELECT season, replay_status, count(*) AS n FROM day GROUP BY ALL")
def status_counts(spark, sf):
    return R.status_counts(_day(spark, sf), "replay_status", ["season"])


_ARMS = f"""{SALES_LOG},
res AS (SELECT pitcher, game_pk % 50 AS part, avg(CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unweighted_accuracy,
               avg(CASE WHEN l_linenumber <= 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS recency_accuracy,
               avg(CASE WHEN l_quantity > 25 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) AS gated_accuracy FROM log GROUP BY ALL)"""


def _side(a: str, b: str) -> str:
    d = f"round(({a}_accuracy - {b}_accuracy) * 100, 9)"
    n = f"{a}_vs_{b}"
    return f"""count(*) FILTER (WHERE {d} > 0) AS {n}_wins, count(*) FILTER (WHERE {d} < 0) AS {n}_losses, count(*) FILTER (WHERE {d} = 0) AS {n}_ties,
  round(avg({d}), 6) AS mean_{n}_pp, round(median({d}), 6) AS median_{n}_pp"""


@query("ablation_summary", f"""
WITH {_ARMS}
SELECT count(*) AS pitchers, round(avg(unweighted_accuracy), 6) AS mean_unweighted_accuracy, round(avg(recency_accuracy), 6) AS mean_recency_accuracy,
       round(avg(gated_accuracy), 6) AS mean_gated_accuracy, {_side("recency", "unweighted")}, {_side("gated", "recency")} FROM res""")
def ablation_summary(spark, sf):
    results = sales_log(spark, sf).groupBy("pitcher", (F.col("game_pk") % 50).alias("part")).agg(
        F.avg(F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.0)).alias("unweighted_accuracy"),
        F.avg(F.when(F.col("l_linenumber") <= 2, 0.5).otherwise(0.0)).alias("recency_accuracy"),
        F.avg(F.when(F.col("l_quantity") > 25, 0.4).otherwise(0.0)).alias("gated_accuracy"),
    )
    out = R.ablation_summary(
        results, ["unweighted", "recency", "gated"], [("recency", "unweighted"), ("gated", "recency")]
    )
    return _round(out, *[c for c in out.columns if c.startswith(("mean", "median"))])


@query("scoreboard_join", f"""
WITH {GAME_HISTORY}
SELECT h.game_pk, pitcher_id, coalesce(s_name, 'AWY') AS away, coalesce('Home ' || s_suppkey, 'HOM') AS home,
       CAST(s_suppkey AS INTEGER) AS away_score, CAST(s_nationkey AS INTEGER) AS home_score, coalesce('Final' || s_nationkey, 'Final') AS status
FROM history h LEFT JOIN supplier ON s_suppkey = h.game_pk""")
def scoreboard_join(spark, sf):
    board = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("game_pk"), F.col("s_name").alias("away"),
        F.concat(F.lit("Home "), F.col("s_suppkey").cast("string")).alias("home"),
        F.col("s_suppkey").cast("int").alias("away_score"), F.col("s_nationkey").alias("home_score"),
        F.concat(F.lit("Final"), F.col("s_nationkey").cast("string")).alias("status"),
    )
    day = game_history(spark, sf).select("game_pk", "pitcher_id")
    return R.scoreboard_join(day, board)


@query("day_overview", f"WITH {GAME_HISTORY}, d AS (SELECT * FROM history WHERE game_date = DATE '1997-06-15') {_POOLED} d")
def day_overview(spark, sf):
    return _round(R.day_overview(game_history(spark, sf), "1997-06-15"), *_POOLED_RATES)


@query("outing_log", f"""
WITH {_PRED}
SELECT event_id AS game_pk, pitcher, row_number() OVER (PARTITION BY pitcher ORDER BY event_id) AS pitch, concat('Top ', event_id % 9 + 1) AS inning,
       concat(event_id % 4, '-', event_id % 3) AS count, guess AS predicted, actual, CASE WHEN guess = actual THEN 'correct' ELSE 'missed' END AS result FROM pred""")
def outing_log(spark, sf):
    from dugout.functions import scalar as S
    from dugout.operators import sequence as Q

    rows = Q.add(_predictions(spark, sf), ["pitcher"], ["event_id"], [Q.row_number("pitch_number_of_game")])
    i = F.col("event_id")
    return R.outing_log(
        rows.select(
            i.alias("game_pk"), "pitcher", "pitch_number_of_game", F.lit("Top").alias("inning_topbot"), (i % 9 + 1).alias("inning"),
            S.count_text(i % 4, i % 3).alias("count"), F.col("guess").alias("model_prediction"), F.col("actual").alias("actual_pitch"),
            (F.col("guess") == F.col("actual")).alias("model_correct"),
        )
    )


@query("code_legend", f"""
WITH {_PRED}, codes AS (SELECT guess AS code FROM pred UNION SELECT actual FROM pred)
SELECT code, CASE code WHEN 'view' THEN 'looked' WHEN 'click' THEN 'clicked' ELSE code END AS name FROM codes""")
def code_legend(spark, sf):
    rows = _predictions(spark, sf).select(F.col("guess").alias("model_prediction"), F.col("actual").alias("actual_pitch"))
    return R.code_legend(rows, {"view": "looked", "click": "clicked"})


@query("distinct_counts", f"""
WITH {SALES_LOG} SELECT family, count(DISTINCT pitcher) AS pitchers, count(DISTINCT game_pk) AS games, count(DISTINCT season) AS seasons FROM log GROUP BY family""")
def distinct_counts(spark, sf):
    return sales_log(spark, sf).groupBy("family").agg(
        F.countDistinct("pitcher").alias("pitchers"), F.countDistinct("game_pk").alias("games"), F.countDistinct("season").alias("seasons")
    )
