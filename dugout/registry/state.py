"""Upserts, refresh, retention and other keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout import columns as C
from dugout.operators import history as H
from dugout.registry import query
from dugout.registry.logs import GAME_HISTORY, game_history, table


@query("upsert", """
WITH batch AS (
  SELECT l_orderkey AS o_orderkey, l_extendedprice AS o_totalprice, l_shipdate AS at FROM lineitem WHERE l_linenumber = 1
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1)
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)
UNION ALL SELECT o_orderkey, o_totalprice FROM batch""")
def upsert(spark, sf):
    old = table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("o_orderkey"), "o_totalprice")
    new = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.col("l_shipdate").alias("at")
    )
    return H.upsert(old, new, ["o_orderkey"], ["at", "o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("normalize_history", f"""
WITH {GAME_HISTORY},
dirty AS (SELECT CASE WHEN game_pk % 17 = 0 THEN NULL ELSE game_date END AS d, CASE WHEN game_pk % 2 = 0 THEN season END AS s,
                 CAST(floor(game_pk / 4) AS BIGINT) AS game_pk, pitcher_id % 5 AS pitcher_id, pitch_count, game_pk AS v FROM history)
SELECT strftime(d, '%Y-%m-%d') AS game_date, coalesce(s, CAST(year(d) AS BIGINT)) AS season, game_pk, pitcher_id, pitch_count
FROM dirty WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_pk, pitcher_id ORDER BY v DESC) = 1""")
def normalize_history(spark, sf):
    pk = F.col("game_pk")
    dirty = game_history(spark, sf).select(
        F.when(pk % 17 == 0, "broken").otherwise(F.col("game_date").cast("string")).alias("game_date"),
        F.when(pk % 2 == 0, F.col("season").cast("string")).alias("season"),
        F.concat(F.floor(pk / 4).cast("string"), F.lit(".0")).alias("game_pk"),
        (F.col("pitcher_id") % 5).alias("pitcher_id"), "pitch_count",
        F.lpad(pk.cast("string"), 12, "0").alias("evaluated_at_utc"),
    )
    return H.normalize_history(dirty).select("game_date", "season", "game_pk", "pitcher_id", "pitch_count")


@query("record_batch", f"""
WITH {GAME_HISTORY}
SELECT strftime(game_date, '%Y-%m-%d') AS game_date, season, game_pk, pitcher_id,
       CASE WHEN game_pk % 3 = 0 THEN pitch_count + 100 ELSE pitch_count END AS pitch_count,
       CASE WHEN game_pk % 3 = 0 THEN 'batch' ELSE 'old' END AS model_version
FROM history""")
def record_batch(spark, sf):
    base = game_history(spark, sf)
    old = base.withColumns({"model_version": F.lit("old"), "evaluated_at_utc": F.lit("2024-01-01")})
    batch = base.filter("game_pk % 3 = 0").withColumns(
        {"pitch_count": F.col("pitch_count") + 100, "model_version": F.lit("batch"), "evaluated_at_utc": F.lit("2024-02-01")}
    )
    return H.record(old, batch).select("game_date", "season", "game_pk", "pitcher_id", "pitch_count", "model_version")


_CONTROL = """control AS (
  SELECT c_custkey AS pitcher, DATE '1990-01-01' + CAST(c_custkey % 12000 AS INTEGER) AS debut,
         CASE WHEN c_custkey % 4 <> 0 THEN DATE '2015-06-01' + CAST(c_custkey % 4000 AS INTEGER) END AS covered FROM customer),
ranges AS (
  SELECT pitcher, greatest(debut, DATE '2008-03-25') AS history_start,
         CASE WHEN covered IS NULL THEN greatest(debut, DATE '2008-03-25') ELSE greatest(debut, DATE '2008-03-25', covered - 6) END AS request_start,
         DATE '2024-05-01' AS request_end, greatest(DATE '2024-05-01', coalesce(covered, DATE '2024-05-01')) AS covered_through
  FROM control)"""


def _control(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("pitcher"),
        F.date_add(F.lit("1990-01-01").cast("date"), (key % 12000).cast("int")).alias("debut"),
        F.when(key % 4 != 0, F.date_add(F.lit("2015-06-01").cast("date"), (key % 4000).cast("int"))).alias("covered_through"),
    )


@query("request_ranges", f"""
WITH {_CONTROL}
SELECT pitcher, CAST(history_start AS DATE) AS history_start, CAST(request_start AS DATE) AS request_start, request_end,
       CAST(covered_through AS DATE) AS covered_through, request_start <= request_end AS needed FROM ranges""")
def request_ranges(spark, sf):
    return H.request_ranges(_control(spark, sf), "2024-05-01")


@query("date_chunks", f"""
WITH {_CONTROL}, n AS (SELECT unnest(range(0, 20)) AS i)
SELECT pitcher, CAST(request_start + CAST(i * 2190 AS INTEGER) AS DATE) AS chunk_start,
       CAST(least(request_start + CAST(i * 2190 + 2189 AS INTEGER), request_end) AS DATE) AS chunk_end
FROM ranges, n WHERE request_start + CAST(i * 2190 AS INTEGER) <= request_end""")
def date_chunks(spark, sf):
    ranges = H.request_ranges(_control(spark, sf), "2024-05-01")
    return H.date_chunks(ranges, "request_start", "request_end").select("pitcher", "chunk_start", "chunk_end")


@query("overlap_refresh", """
WITH starts AS (SELECT c_custkey AS k, DATE '1999-01-01' + CAST(c_custkey % 300 AS INTEGER) AS s FROM customer WHERE c_custkey % 3 <> 0),
kept AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS b FROM orders LEFT JOIN starts ON k = o_custkey
         WHERE k IS NULL OR CAST(o_orderdate AS DATE) < s),
incoming AS (SELECT o_custkey, o_orderkey, o_totalprice + 1 AS o_totalprice, 1 AS b FROM orders JOIN starts ON k = o_custkey
             WHERE CAST(o_orderdate AS DATE) >= s AND o_orderkey % 10 <> 0)
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT * FROM kept UNION ALL SELECT * FROM incoming)
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY b DESC) = 1""")
def overlap_refresh(spark, sf):
    key = F.col("c_custkey")
    ranges = table(spark, sf, "customer").select(
        key.alias("o_custkey"), F.date_add(F.lit("1999-01-01").cast("date"), (key % 300).cast("int")).alias("request_start"),
        (key % 3 != 0).alias("needed"),
    )
    existing = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), F.lit(0).alias("ingest_seq")
    )
    wanted = ranges.filter("needed").select("o_custkey", "request_start")
    incoming = (
        existing.join(wanted, "o_custkey")
        .filter((F.col("day") >= F.col("request_start")) & (F.col("o_orderkey") % 10 != 0))
        .drop("request_start")
        .withColumns({"o_totalprice": F.col("o_totalprice") + 1, "ingest_seq": F.lit(1)})
    )
    out = H.overlap_refresh(existing, incoming, ranges, ["o_custkey", "o_orderkey"], "o_custkey", "day")
    return out.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("resume_filter", f"""
WITH {GAME_HISTORY}
SELECT game_pk, pitcher_id FROM history WHERE NOT (game_pk % 3 = 0 AND game_pk % 5 <> 0)""")
def resume_filter(spark, sf):
    targets = game_history(spark, sf).select("game_pk", "pitcher_id")
    done = targets.filter("game_pk % 3 = 0").select(
        F.col("game_pk").cast("string").alias("game_pk"), "pitcher_id",
        F.lit(C.BACKTEST_VERSION).alias("backtest_version"),
        F.when(F.col("game_pk") % 5 == 0, "majority").otherwise("stratified").alias("baseline_strategy"),
    )
    return H.not_yet_evaluated(targets, done)


@query("retention_candidates", """
WITH parts AS (SELECT CAST(o_orderdate AS DATE) AS game_date, count(*) AS size_bytes FROM orders GROUP BY 1),
seen AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 7)
SELECT game_date, size_bytes, CASE WHEN game_date > DATE '2000-06-30' - 90 THEN 'within window' WHEN d IS NULL THEN 'no evaluated results yet' ELSE 'prune' END AS decision
FROM parts LEFT JOIN seen ON d = game_date""")
def retention_candidates(spark, sf):
    parts = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("game_date")).agg(
        F.count(F.lit(1)).alias("size_bytes")
    )
    seen = table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_shipdate").cast("date").alias("game_date"))
    return H.retention(parts, seen, "2000-06-30", 90)


@query("evaluated_dates", f"WITH {GAME_HISTORY} SELECT DISTINCT game_date FROM history")
def evaluated_dates(spark, sf):
    return H.evaluated_dates(game_history(spark, sf))


@query("single_match", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def single_match(spark, sf):
    return H.single_match(table(spark, sf, "supplier"), F.col("s_suppkey") == 7, "supplier 7").select("s_suppkey", "s_name")


@query("union_all", """
SELECT event_id, user_id, value FROM events UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def union_all(spark, sf):
    a = table(spark, sf, "events").select("event_id", "user_id", "value")
    b = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id")
    )
    return a.unionByName(b)
