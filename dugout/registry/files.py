"""Scans and sinks: tables go out to a scratch folder in the form of the files, and come back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dugout import columns as C
from dugout.plans import stages as P
from dugout.operators import history as H
from dugout.registry import query
from dugout.registry.logs import GAME_HISTORY, PITCH_LOG, game_history, pitch_log, table
from dugout.registry.stages import _KG3_SQL
from dugout.session import scratch_path
from dugout.sources import readers, sinks


@query("csv_scan", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders""")
def csv_scan(spark, sf):
    path = scratch_path(spark, "orders-csv")
    out = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderkey") % 4 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "None").otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    sinks.write_table(out, path, "csv")
    return readers.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, day date, price double, priority string")


@query("pitch_log_scan", f"""
WITH {PITCH_LOG} SELECT pitcher, game_pk, game_date, at_bat_number, pitch_type, release_speed, zone, description FROM raw""")
def pitch_log_scan(spark, sf):
    path = scratch_path(spark, "pitches-csv")
    sinks.write_table(pitch_log(spark, sf).drop(*[f"extra_{i}" for i in range(1, 8)]), path, "csv")
    return readers.read_pitch_log(spark, path).select(
        "pitcher", "game_pk", "game_date", "at_bat_number", "pitch_type", "release_speed", "zone", "description"
    )


def _typed_cells() -> list[tuple[str, str, str, str]]:
    """(column, type, text as an export writes it, value read from it) of every raw column, in SQL that
    both engines take: each column has values and gaps of its own, by place and row."""
    cells = []
    for k, (name, kind) in enumerate((c, t) for t, cs in C.RAW_TYPES.items() for c in cs):
        value, shown = {
            "date": ("CAST(o_orderdate AS DATE)", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
            "bigint": (f"CAST(o_custkey * 1000 + {k} AS BIGINT)", f"CAST(o_custkey * 1000 + {k} AS STRING)"),
            "int": (f"CAST(o_custkey % 90 - {k} AS INT)", f"CAST(o_custkey % 90 - {k} AS STRING)"),
            "double": (f"CAST((o_custkey % 500) * 0.125 - {k} AS DOUBLE)", f"CAST((o_custkey % 500) * 0.125 - {k} AS STRING)"),
            "string": (f"concat(o_orderpriority, ', \"{k}\"')", f"concat(o_orderpriority, ', \"{k}\"')"),
        }[kind]
        gap = "false" if k < 3 else f"(o_orderkey + {k}) % 7 = 0"
        missing = readers.MISSING[k % len(readers.MISSING)]
        cells.append((name, kind, f"CASE WHEN {gap} THEN '{missing}' ELSE {shown} END", f"CASE WHEN {gap} THEN NULL ELSE {value} END"))
    return cells


@query("pitch_log_typed", "SELECT " + ", ".join(f"{value} AS {name}" for name, _, _, value in _typed_cells()) + " FROM orders")
def pitch_log_typed(spark, sf):
    """Every column of an export, with every missing marker, through its declared type."""
    path = scratch_path(spark, "typed-csv")
    sinks.write_table(table(spark, sf, "orders").selectExpr(*(f"{text} AS {name}" for name, _, text, _ in _typed_cells())), path, "csv")
    return readers.read_pitch_log(spark, path)


@query("landing_scan", """
SELECT c_custkey AS pitcher, c_custkey * 3 AS game_pk, c_mktsegment AS pitch_type, c_acctbal AS release_speed, 'x' AS extra FROM customer""")
def landing_scan(spark, sf):
    path = scratch_path(spark, "landing")
    out = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" pitcher "), (F.col("c_custkey") * 3).alias("game_pk"), F.col("c_mktsegment").alias("pitch_type "),
        F.col("c_acctbal").alias("release_speed"), F.lit("x").alias("extra"),
    )
    sinks.write_table(out, path, "csv")
    return readers.read_landing(spark, path).drop("ingest_seq")


@query("arsenal_scan", "SELECT p_type AS pitch_type, p_brand AS pitch_name, CAST(p_size AS BIGINT) AS pitches FROM part")
def arsenal_scan(spark, sf):
    path = scratch_path(spark, "arsenal")
    out = table(spark, sf, "part").select(
        F.col("p_type").alias(" pitch_type"), F.col("p_brand").alias("pitch_name"), F.col("p_size").alias("pitches"), "p_retailprice"
    )
    sinks.write_table(out, path, "csv")
    return readers.read_arsenal(spark, path)


@query("column_pruned_scan", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS game_date FROM orders")
def column_pruned_scan(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("game_date")).distinct()


def _schedule(spark, sf):
    """One schedule document per game, as JSON lines."""
    c = F.col("o_custkey")

    def side(team, pitcher, score):
        return F.struct(
            F.struct(team.alias("id"), F.concat(F.lit("Team "), team.cast("string")).alias("name"),
                     F.when(team % 5 != 0, F.concat(F.lit("T"), team.cast("string"))).alias("abbreviation")).alias("team"),
            score.cast("int").alias("score"),
            F.when(pitcher.isNotNull(), F.struct(pitcher.alias("id"), F.lit("P").alias("fullName"))).alias("probablePitcher"),
        )

    game = F.struct(
        F.col("o_orderkey").alias("gamePk"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("officialDate"),
        F.lit("t").alias("gameDate"), F.struct(F.col("o_orderstatus").alias("detailedState")).alias("status"),
        F.struct(side(c, c * 10, c % 9).alias("away"), side(c + 1, F.when(c % 3 != 0, c * 10 + 1), c % 7).alias("home")).alias("teams"),
    )
    docs = table(spark, sf, "orders").select(F.array(F.struct(F.array(game).alias("games"))).alias("dates"))
    path = scratch_path(spark, "schedule")
    sinks.write_json(docs, path)
    return spark.read.schema(readers.SCHEDULE_DDL).json(path)


@query("schedule_starters", """
SELECT o_orderkey AS game_pk, strftime(o_orderdate, '%Y-%m-%d') AS official_date, side,
       CASE side WHEN 'away' THEN o_custkey ELSE o_custkey + 1 END AS team_id, CASE side WHEN 'away' THEN o_custkey * 10 ELSE o_custkey * 10 + 1 END AS pitcher_id
FROM orders, (VALUES ('away'), ('home')) AS s(side) WHERE side = 'away' OR o_custkey % 3 <> 0""")
def schedule_starters(spark, sf):
    return readers.starters(_schedule(spark, sf)).select("game_pk", "official_date", "side", "team_id", "pitcher_id")


@query("schedule_missing", """
SELECT o_orderkey AS game_pk, strftime(o_orderdate, '%Y-%m-%d') AS official_date, 'home' AS side, o_custkey + 1 AS team_id, concat('Team ', o_custkey + 1) AS team_name
FROM orders WHERE o_custkey % 3 = 0""")
def schedule_missing(spark, sf):
    return readers.missing_probables(_schedule(spark, sf))


@query("schedule_scoreboard", """
SELECT o_orderkey AS game_pk, CASE WHEN o_custkey % 5 = 0 THEN 'AWY' ELSE concat('T', o_custkey) END AS away,
       CASE WHEN (o_custkey + 1) % 5 = 0 THEN 'HOM' ELSE concat('T', o_custkey + 1) END AS home,
       CAST(o_custkey % 9 AS INTEGER) AS away_score, CAST(o_custkey % 7 AS INTEGER) AS home_score, o_orderstatus AS status FROM orders""")
def schedule_scoreboard(spark, sf):
    return readers.scoreboard(_schedule(spark, sf))


@query("history_scan", f"""
WITH {GAME_HISTORY}
SELECT strftime(game_date, '%Y-%m-%d') AS game_date, season, game_pk, pitcher_id, pitch_count, CAST(NULL AS VARCHAR) AS backtest_version FROM history""")
def history_scan(spark, sf):
    path = scratch_path(spark, "history")
    old = game_history(spark, sf).select(F.col("game_date").cast("string"), "season", "game_pk", "pitcher_id", "pitch_count", "order_status")
    sinks.write_table(old, path)
    return readers.read_history(spark, path).select("game_date", "season", "game_pk", "pitcher_id", "pitch_count", "backtest_version")


@query("history_store", f"""
WITH {GAME_HISTORY} SELECT strftime(game_date, '%Y-%m-%d') AS game_date, game_pk, pitcher_id,
  CASE WHEN game_pk % 2 = 0 THEN pitch_count + 1 ELSE pitch_count END AS pitch_count FROM history""")
def history_store(spark, sf):
    """A first batch, then one that replaces half of it."""
    path = scratch_path(spark, "history")
    base = game_history(spark, sf)
    sinks.store_history(base.withColumn("evaluated_at_utc", F.lit("2024-01-01")), path)
    batch = base.filter("game_pk % 2 = 0").withColumns({"pitch_count": F.col("pitch_count") + 1, "evaluated_at_utc": F.lit("2024-01-02")})
    sinks.store_history(batch, path)
    return readers.read_history(spark, path).select("game_date", "game_pk", "pitcher_id", "pitch_count")


@query("history_versions", f"""
WITH {GAME_HISTORY} SELECT strftime(CASE WHEN game_pk % 5 = 0 THEN game_date + 40 ELSE game_date END, '%Y-%m-%d') AS game_date, game_pk, pitcher_id,
  CASE WHEN game_pk % 5 = 0 THEN pitch_count + 1 ELSE pitch_count END AS pitch_count, game_date AS first_date FROM history""")
def history_versions(spark, sf):
    """Rows that move to another month, beside the first version as it still reads."""
    path = scratch_path(spark, "history")
    base = game_history(spark, sf)
    first = sinks.store_history(base.withColumn("evaluated_at_utc", F.lit("2024-01-01")), path)
    moved = base.filter("game_pk % 5 = 0").withColumns({
        "game_date": F.date_add("game_date", 40), "pitch_count": F.col("pitch_count") + 1, "evaluated_at_utc": F.lit("2024-01-02")})
    sinks.store_history(moved, path)
    old = readers.read_history(spark, path, version=first).select(
        F.col("game_pk").alias("_g"), F.col("pitcher_id").alias("_p"), F.col("game_date").cast("date").alias("first_date"))
    new = readers.read_history(spark, path)
    # three of 25 columns look small to the planner, which would broadcast a row per game from the driver
    return new.join(old.hint("merge"), (F.col("game_pk") == F.col("_g")) & (F.col("pitcher_id") == F.col("_p"))).select(
        "game_date", "game_pk", "pitcher_id", "pitch_count", "first_date")


@query("history_order", f"""
WITH {GAME_HISTORY} SELECT game_pk, pitcher_id, row_number() OVER (ORDER BY game_date, game_pk, pitcher_id) AS place FROM history""")
def history_order(spark, sf):
    """The place of each row in the sorted history, as its files hold it in order."""
    base = game_history(spark, sf).withColumn("game_date", F.col("game_date").cast("string"))
    path = scratch_path(spark, "sorted")
    H.sorted_history(base.withColumn("pitcher_name", F.lit(None).cast("string"))).write.parquet(path)
    stored = spark.read.parquet(path).select("game_pk", "pitcher_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    counts = stored.groupBy(F.col("f").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stored.join(before, F.col("f") == F.col("_f")).select("game_pk", "pitcher_id", (F.col("_before") + F.col("r") + 1).alias("place"))


@query("prediction_log_store", """
SELECT user_id AS pitcher, event_id AS game_pk, CAST(ts AS DATE) AS game_date,
       CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 'new' ELSE event_type END AS model_prediction
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND (CAST(ts AS DATE) <> DATE '2024-01-10' OR event_id % 2 = 0)""")
def prediction_log_store(spark, sf):
    """Dated log: a rewritten date replaces that date alone; reading a date list prunes the rest."""
    path = scratch_path(spark, "logs")
    logs = table(spark, sf, "events").select(
        F.col("user_id").alias("pitcher"), F.col("event_id").alias("game_pk"), F.col("ts").cast("date").alias("game_date"),
        F.col("event_type").alias("model_prediction"),
    )
    sinks.write_prediction_logs(logs, path)
    redo = logs.filter((F.col("game_date") == F.lit("2024-01-10").cast("date")) & (F.col("game_pk") % 2 == 0))
    sinks.write_prediction_logs(redo.withColumn("model_prediction", F.lit("new")), path)
    days = [f"2024-01-{d:02d}" for d in range(5, 13)]
    return readers.read_prediction_logs(spark, path, days).select("pitcher", "game_pk", "game_date", "model_prediction")


@query("logs_of_history", """
SELECT l_orderkey AS game_pk, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def logs_of_history(spark, sf):
    orders = table(spark, sf, "orders")
    history = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("game_pk"), F.col("o_custkey").alias("pitcher_id"))
    keys = orders.select("o_orderkey", "o_custkey")
    logs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    logs = logs.join(keys, logs.l_orderkey == keys.o_orderkey).select(
        F.col("l_orderkey").alias("game_pk"), F.col("o_custkey").alias("pitcher"), "l_partkey", "l_linenumber"
    )
    return readers.logs_of(history, logs).select("game_pk", "l_partkey", "l_linenumber")


@query("game_summary_scan", f"""
WITH {GAME_HISTORY}
SELECT game_pk, pitcher_id, pitch_count, model_accuracy, 'stratified' AS baseline_strategy, model_correct / pitch_count AS share_ff FROM history""")
def game_summary_scan(spark, sf):
    path = scratch_path(spark, "summaries")
    out = game_history(spark, sf).select(
        "game_pk", "pitcher_id", "pitch_count", "model_accuracy", F.lit("stratified").alias("baseline_strategy"),
        F.create_map(F.lit("FF"), F.col("model_correct") / F.col("pitch_count")).alias("baseline_distribution"),
    )
    sinks.write_json(out, path)
    read = readers.read_game_summaries(spark, path, multiline=False)
    return read.select(
        "game_pk", "pitcher_id", "pitch_count", "model_accuracy", "baseline_strategy",
        F.try_element_at("baseline_distribution", F.lit("FF")).alias("share_ff"),
    )


@query("daily_summary_scan", f"""
WITH {GAME_HISTORY}
SELECT strftime(game_date, '%Y-%m-%d') AS game_date, count(*) AS successful, CAST(sum(pitch_count) AS BIGINT) AS total_pitches,
       CAST(sum(model_correct) AS BIGINT) AS model_correct FROM history GROUP BY game_date""")
def daily_summary_scan(spark, sf):
    """Daily summaries in their nested form, written as JSON and read back flat."""
    days = game_history(spark, sf).groupBy(F.date_format("game_date", "yyyy-MM-dd").alias("game_date")).agg(
        F.struct(F.count(F.lit(1)).alias("successful")).alias("statuses"),
        F.struct(F.sum("pitch_count").alias("total_pitches"), F.sum("model_correct").alias("model_correct")).alias("aggregate_performance"),
    )
    path = scratch_path(spark, "daily")
    sinks.write_json(days, path)
    return readers.read_daily_summaries(spark, path, multiline=False).select("game_date", "successful", "total_pitches", "model_correct")


@query("sorted_csv_store", "SELECT s_suppkey, s_name FROM supplier")
def sorted_csv_store(spark, sf):
    path = scratch_path(spark, "sorted")
    sinks.write_sorted_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, ["s_name", "s_suppkey"])
    return readers.read_csv(spark, path, "s_suppkey bigint, s_name string")


@query("failure_store", "SELECT event_id AS pitcher_id, event_type AS error FROM events WHERE event_type = 'error'")
def failure_store(spark, sf):
    path = scratch_path(spark, "failures")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("pitcher_id"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("error")
    )
    sinks.write_failures(rows, path)
    return readers.read_csv(spark, path, "pitcher_id bigint, error string")


@query("stage_store", f"WITH {_KG3_SQL} SELECT pitcher, game_pk, pitch_number_of_game, pitch_type, count_state FROM kg3")
def stage_store(spark, sf):
    path = scratch_path(spark, "stages")
    sinks.write_stages(P.build(pitch_log(spark, sf)), path)
    kg4 = spark.read.parquet(f"{path}/kg4")
    assert kg4.columns == C.KG4
    return kg4.select("pitcher", "game_pk", "pitch_number_of_game", "pitch_type", "count_state")


# --- the daily build ----------------------------------------------------------------------------
@query("daily_run_log", f"""
WITH {PITCH_LOG},
asked AS (SELECT DISTINCT user_id AS pitcher FROM events WHERE user_id % 4 <> 0 UNION SELECT DISTINCT user_id + 1000000 FROM events WHERE user_id % 50 = 1),
kept AS (SELECT * FROM raw WHERE pitcher % 4 <> 0 AND (game_date < DATE '2022-01-01' OR at_bat_number % 10 <> 0 OR pitcher % 5 = 1)),
n AS (SELECT pitcher, count(*) AS rows_in, count(pitch_type) AS rows_out, count(DISTINCT CASE WHEN pitch_type IS NOT NULL THEN game_pk END) AS games FROM kept GROUP BY pitcher),
p AS (SELECT asked.pitcher, coalesce(rows_in, 0) AS rows_in, coalesce(rows_out, 0) AS rows_out, coalesce(games, 0) AS games FROM asked LEFT JOIN n USING (pitcher)),
lines AS (
  SELECT pitcher, 'download' AS stage, rows_in AS rows, CASE WHEN pitcher % 5 = 1 AND pitcher < 1000000 THEN 'timeout' WHEN rows_in = 0 THEN 'No pitches were found.' END AS error FROM p
  UNION ALL SELECT pitcher, 'cleaning', rows_out, CASE WHEN rows_out = 0 THEN 'No pitches were found.' END FROM p WHERE rows_in > 0
  UNION ALL SELECT pitcher, 'feature_engineering', rows_out, NULL FROM p WHERE rows_out > 0
  UNION ALL SELECT pitcher, 'modeling', rows_out, CASE WHEN games < 2 THEN 'At least two games are required.' END FROM p WHERE rows_out > 0
  UNION ALL SELECT DISTINCT pitcher, 'download', 0, 'The batch holds a pitcher that was not requested.' FROM raw WHERE pitcher % 4 = 0 AND game_date >= DATE '2022-01-01')
SELECT pitcher, stage, rows, error, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status FROM lines""")
def daily_run_log(spark, sf):
    """Rows since 2022 are fetched again for three quarters of the users; a tenth of them is gone
    upstream, the fetch of one in five users fails, and the batch holds users nobody asked for."""
    from dugout.plans import daily
    from dugout.plans import learning as L

    log = pitch_log(spark, sf).withColumn("ingest_seq", F.col("at_bat_number").cast("bigint"))
    users = table(spark, sf, "events").select(F.col("user_id").alias("pitcher")).distinct()
    asked = users.filter("pitcher % 4 <> 0").union(users.filter("pitcher % 50 = 1").select(F.col("pitcher") + 1000000))
    control = asked.select(
        "pitcher", F.lit("2008-01-01").cast("date").alias("debut"), F.lit("2022-01-07").cast("date").alias("covered_through")
    )
    recent = F.col("game_date") >= F.lit("2022-01-01").cast("date")
    incoming = log.filter(recent & ((F.col("at_bat_number") % 10 != 0) | (F.col("pitcher") % 4 == 0)))
    failures = users.filter("pitcher % 5 = 1").withColumn("error", F.lit("timeout"))

    def fit(kg4):
        inputs = L.Columns(["balls", "strikes"], ["pitch_type_of_prev_pitch"])
        return L.train(kg4, forest=L.Forest(trees=20, depth=10), cols=inputs).errors

    return daily.run(log, incoming, control, asked, "2023-01-01", failures=failures, fit=fit).run_log


@query("replay_day_rows", """
WITH s AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Game Over' ELSE 'In Progress' END AS game_status FROM orders),
r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT *, CASE WHEN game_status <> 'In Progress' THEN
         CASE WHEN o_orderkey % 11 = 0 THEN 'No pre-game history exists.' WHEN n IS NULL OR o_orderkey % 2 = 0 THEN 'missing' END END AS error
      FROM s LEFT JOIN r ON l_orderkey = o_orderkey)
SELECT o_orderkey AS game_pk, o_custkey AS pitcher_id, game_status, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 11 <> 0 THEN n END AS pitch_count,
       CASE WHEN game_status = 'In Progress' THEN 'game_not_final' WHEN error IS NULL THEN 'success' WHEN error = 'missing' THEN 'statcast_not_ready' ELSE 'failed' END AS replay_status
FROM e""")
def replay_day_rows(spark, sf):
    from dugout.plans import backtest

    s = F.col("o_orderstatus")
    starters = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_pk"), F.col("o_custkey").alias("pitcher_id"),
        F.when(s == "F", "Final").when(s == "O", "Game Over").otherwise("In Progress").alias("game_status"),
    )
    results = table(spark, sf, "lineitem").filter("l_orderkey % 2 <> 0 AND l_orderkey % 11 <> 0").groupBy(
        F.col("l_orderkey").alias("game_pk")
    ).agg(F.count(F.lit(1)).alias("pitch_count"))
    results = results.join(starters.select("game_pk", "pitcher_id"), "game_pk")
    errors = starters.filter("game_pk % 11 = 0").select("game_pk", "pitcher_id", F.lit("No pre-game history exists.").alias("error"))
    out = backtest.day_rows(starters.union(starters), results, errors)
    return out.select("game_pk", "pitcher_id", "game_status", "pitch_count", "replay_status")
