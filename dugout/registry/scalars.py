"""Row-level expressions and schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout import columns as C
from dugout import schema
from dugout.functions import scalar as S
from dugout.operators import evaluation as E
from dugout.registry import query
from dugout.registry.logs import event_log, table


@query("count_state", """
SELECT event_id, CAST(event_id % 4 AS INTEGER) AS balls, CAST(event_id * 5 % 3 AS INTEGER) AS strikes,
       concat(event_id % 4, '-', event_id * 5 % 3) AS count,
       CASE WHEN event_id % 4 = 3 AND event_id * 5 % 3 = 2 THEN 'full_count'
            WHEN event_id * 5 % 3 = 2 THEN 'put_away_count'
            WHEN event_id % 4 >= 2 THEN 'hitters_count'
            WHEN event_id * 5 % 3 > event_id % 4 THEN 'pitcher_ahead'
            WHEN event_id % 4 > event_id * 5 % 3 THEN 'pitcher_behind'
            ELSE 'even_count' END AS count_state
FROM events""")
def count_state(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        (F.col("event_id") % 4).cast("int").alias("balls"),
        (F.col("event_id") * 5 % 3).cast("int").alias("strikes"),
    )
    return rows.withColumns(
        {"count": S.count_text("balls", "strikes"), "count_state": S.count_state("balls", "strikes")}
    )


@query("same_hand", """
SELECT event_id,
       CAST(CASE WHEN event_id % 13 = 0 THEN 0
                 WHEN (user_id % 2 = 0) = (event_id % 3 = 0) THEN 1 ELSE 0 END AS INTEGER) AS same_hand
FROM events""")
def same_hand(spark, sf):
    throws = F.when(F.col("user_id") % 2 == 0, "L").otherwise("R")
    stand = F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 3 == 0, "L").otherwise("R")
    return table(spark, sf, "events").select("event_id", S.same_hand(throws, stand).alias("same_hand"))


@query("bucket_other", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN p_type ELSE 'OTHER' END AS bucket
FROM part""")
def bucket_other(spark, sf):
    kept = ["ECONOMY", "SMALL", "STANDARD"]
    return table(spark, sf, "part").select("p_partkey", S.bucket("p_type", kept).alias("bucket"))


@query("map_lookup", """
SELECT p_partkey, p_type,
       CASE p_type WHEN 'ECONOMY' THEN 'Fastball' WHEN 'SMALL' THEN 'Offspeed' ELSE NULL END AS family,
       CASE p_type WHEN 'ECONOMY' THEN 'Fastball' WHEN 'SMALL' THEN 'Offspeed' ELSE p_type END AS name
FROM part""")
def map_lookup(spark, sf):
    names = {"ECONOMY": "Fastball", "SMALL": "Offspeed"}
    return table(spark, sf, "part").select(
        "p_partkey", "p_type", S.lookup("p_type", names).alias("family"),
        S.lookup("p_type", names, F.col("p_type")).alias("name"),
    )


@query("score_arithmetic", """
SELECT o_orderkey, o_custkey - o_orderkey AS score_diff,
       CAST(year(o_orderdate) AS INTEGER) AS season,
       CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS week_before,
       strftime(o_orderdate, '%Y-%m-%d') AS day_text
FROM orders""")
def score_arithmetic(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") - F.col("o_orderkey")).alias("score_diff"),
        F.year(day).alias("season"),
        F.date_sub(day, 7).alias("week_before"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
    )


_MESSY = """CASE event_id % 5 WHEN 0 THEN concat(event_id, '.0') WHEN 1 THEN concat(' ', event_id)
            WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE CAST(value AS VARCHAR) END"""


@query("try_coerce", f"""
SELECT event_id,
       CASE WHEN event_id % 5 IN (0, 1) THEN CAST(event_id AS DOUBLE)
            WHEN event_id % 5 = 4 THEN value END AS number,
       CASE WHEN event_id % 5 IN (0, 1) THEN event_id WHEN event_id % 5 = 4 THEN CAST(trunc(value) AS BIGINT) END AS id,
       TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'no date' ELSE concat('2024-0', event_id % 9 + 1, '-15') END AS DATE) AS day
FROM events""")
def try_coerce(spark, sf):
    i = F.col("event_id")
    messy = (
        F.when(i % 5 == 0, F.concat(i.cast("string"), F.lit(".0")))
        .when(i % 5 == 1, F.concat(F.lit(" "), i.cast("string")))
        .when(i % 5 == 2, "n/a")
        .when(i % 5 == 4, F.col("value").cast("string"))
    )
    day = F.when(i % 3 == 0, "no date").otherwise(F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string"), F.lit("-15")))
    return table(spark, sf, "events").select(
        "event_id", S.to_number(messy).alias("number"), S.to_number(messy, "bigint").alias("id"), S.to_day(day).alias("day")
    )


@query("strict_cast", """
SELECT event_id, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS number
FROM events""")
def strict_cast(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        S.must_be_number(F.col("event_id").cast("string"), "bigint").alias("id"),
        S.must_be_number(F.col("value").cast("string")).alias("number"),
    )


@query("bool_count", """
SELECT user_id,
       count(*) FILTER (WHERE event_id % 4 IN (0, 1)) AS n_true, count(*) AS n
FROM events GROUP BY user_id""")
def bool_count(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "True").when(i % 4 == 1, " true ").when(i % 4 == 2, "False")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(S.is_true(text)).alias("n_true"), F.count(F.lit(1)).alias("n")
    )


@query("final_predicate", """
SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS is_final FROM orders""")
def final_predicate(spark, sf):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", " Final: Tied").when(s == "O", "Game Over").otherwise("In Progress")
    return table(spark, sf, "orders").select("o_orderkey", S.is_final(status).alias("is_final"))


@query("status_classify", """
SELECT event_id,
       CASE event_id % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'statcast_not_ready' WHEN 2 THEN 'insufficient_history'
            WHEN 3 THEN 'insufficient_history' WHEN 4 THEN 'insufficient_history'
            WHEN 5 THEN 'statcast_not_ready' ELSE 'failed' END AS outcome
FROM events""")
def status_classify(spark, sf):
    m = F.col("event_id") % 7
    error = (
        F.when(m == 1, "The completed game was not found in the data.")
        .when(m == 2, "No pre-game history exists for X.")
        .when(m == 3, "At least two games are required.")
        .when(m == 4, "No usable pitches remain.")
        .when(m == 5, "Savant may not have published it yet.")
        .when(m == 6, "Something else")
    )
    return table(spark, sf, "events").select("event_id", S.outcome(error).alias("outcome"))


@query("json_flatten", """
WITH games AS (
  SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS official_date, o_orderstatus FROM orders)
SELECT o_orderkey AS game_pk, official_date, side,
       CASE side WHEN 'away' THEN o_custkey ELSE o_custkey + 1 END AS team_id,
       CASE side WHEN 'away' THEN o_custkey + 1 ELSE o_custkey END AS opponent_id,
       CASE WHEN side = 'home' AND o_custkey % 3 = 0 THEN NULL
            WHEN side = 'away' THEN o_custkey * 10 ELSE o_custkey * 10 + 1 END AS pitcher_id,
       o_orderstatus AS game_status
FROM games, (VALUES ('away'), ('home')) AS s(side)""")
def json_flatten(spark, sf):
    """Orders packed as schedule documents (JSON text), then parsed and flattened again."""
    from dugout.sources import readers

    c = F.col("o_custkey")

    def side(team, pitcher):
        return F.struct(
            F.struct(team.alias("id"), F.concat(F.lit("Team "), team.cast("string")).alias("name")).alias("team"),
            F.when(pitcher.isNotNull(), F.struct(pitcher.alias("id"), F.lit("P").alias("fullName"))).alias("probablePitcher"),
        )

    game = F.struct(
        F.col("o_orderkey").alias("gamePk"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("officialDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("gameDate"),
        F.struct(F.col("o_orderstatus").alias("detailedState")).alias("status"),
        F.struct(
            side(c, c * 10).alias("away"), side(c + 1, F.when(c % 3 != 0, c * 10 + 1)).alias("home")
        ).alias("teams"),
    )
    text = F.to_json(F.struct(F.array(F.struct(F.array(game).alias("games"))).alias("dates")))
    documents = table(spark, sf, "orders").select(F.from_json(text, readers.SCHEDULE_DDL).alias("d")).select("d.*")
    return readers.appearances(documents).select(
        "game_pk", "official_date", "side", "team_id", "opponent_id", "pitcher_id", "game_status"
    )


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("percent_format", """
SELECT user_id, round(avg(value), 2) AS mean_value,
       round(count(*) FILTER (WHERE event_type = 'view') / count(*) * 100, 2) AS view_percent,
       CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'correct' ELSE 'missed' END AS label
FROM events GROUP BY user_id""")
def percent_format(spark, sf):
    seen = F.count_if(F.col("event_type") == "view")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.round(F.avg("value"), 2).alias("mean_value"),
        S.percent(S.ratio(seen, F.count(F.lit(1)))).alias("view_percent"),
        S.hit_label(seen > 0).alias("label"),
    )


@query("null_counts", """
SELECT column_name, nulls FROM (
  SELECT 'event_id' AS column_name, count(*) FILTER (WHERE event_id IS NULL) AS nulls FROM events
  UNION ALL SELECT 'gappy', count(*) FILTER (WHERE event_id % 3 = 0) FROM events
  UNION ALL SELECT 'pitch_type', count(*) FILTER (WHERE event_type = 'error') FROM events)""")
def null_counts(spark, sf):
    log = event_log(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("gappy"),
        F.when(F.col("pitch_type") != "error", F.col("pitch_type")).alias("pitch_type"),
    )
    return E.null_counts(log)


# --- schema operators -------------------------------------------------------------------------
@query("canonical_columns", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def canonical_columns(spark, sf):
    messy = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias(' "o_totalprice" '), F.col("o_orderstatus").alias("o_orderstatus "),
        F.col("o_orderkey").alias('"o_orderkey"'), "o_custkey",
    )
    wanted = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    out = schema.canonical(messy, wanted, "orders")
    schema.check_order(out, wanted, "orders")
    return schema.require(out, ["o_orderkey"], "orders")


@query("unexpected_keys", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""")
def unexpected_keys(spark, sf):
    asked = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return schema.unexpected_keys(table(spark, sf, "orders"), asked, "o_custkey")


@query("evolved_columns", """
SELECT s_suppkey AS pitcher_id, s_name AS pitcher_name, CAST(NULL AS BIGINT) AS season, CAST(NULL AS DOUBLE) AS model_accuracy
FROM supplier""")
def evolved_columns(spark, sf):
    old = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pitcher_id"), F.col("s_name").alias("pitcher_name"), "s_acctbal"
    )
    types = {k: C.HISTORY_TYPES[k] for k in ("pitcher_id", "pitcher_name", "season", "model_accuracy")}
    return schema.with_columns_of(old, types)


@query("drop_null_rows", """
SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND event_type <> 'error'""")
def drop_null_rows(spark, sf):
    log = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
    )
    return log.dropna(subset=["value", "kind"]).drop("kind")
