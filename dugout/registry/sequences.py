"""Sequence operators on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout.operators import sequence as Q
from dugout.registry import query
from dugout.registry.logs import EVENT_CLASSES, EVENT_LOG, event_log, table

GAME = ["pitcher", "game"]
ORDER = ["ts", "event_id"]
GAPPY = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _log(spark, sf):
    return event_log(spark, sf).withColumn("gappy", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query("prev_values", f"""
WITH {EVENT_LOG}
SELECT event_id, pitcher, lag(value) OVER w AS value_of_prev_pitch,
       lag(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END) OVER w AS gappy_of_prev_pitch,
       lag(props) OVER w AS props_of_prev_pitch
FROM log WINDOW w AS (PARTITION BY pitcher, game ORDER BY ts, event_id)""")
def prev_values(spark, sf):
    out = Q.previous_values(_log(spark, sf), GAME, ORDER, ["value", "gappy", "props"])
    return out.select(
        "event_id", "pitcher", "value_of_prev_pitch", "gappy_of_prev_pitch", "props_of_prev_pitch"
    )


@query("pa_renumber", f"""
WITH {EVENT_LOG}
SELECT event_id, pitcher, game,
       CAST(sum(CASE WHEN pitch_type = 'view' THEN 1 ELSE 0 END) OVER
            (PARTITION BY pitcher, game ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pa
FROM log""")
def pa_renumber(spark, sf):
    out = Q.renumber(event_log(spark, sf), GAME, ORDER, F.col("pitch_type") == "view", "pa")
    return out.select("event_id", "pitcher", "game", "pa")


@query("last_known", f"""
WITH {EVENT_LOG}
SELECT pitcher, game,
       arg_max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, ts)
         FILTER (WHERE event_id % 3 <> 0) AS gappy,
       arg_max(props, ts) AS props
FROM log GROUP BY pitcher, game""")
def last_known(spark, sf):
    return Q.last_known(_log(spark, sf), GAME, ORDER, ["gappy", "props"])


@query("prev_pa_results", f"""
WITH {EVENT_LOG},
numbered AS (
  SELECT *, sum(CASE WHEN pitch_type = 'view' THEN 1 ELSE 0 END) OVER
            (PARTITION BY pitcher, game ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pa,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS gappy
  FROM log),
ends AS (
  SELECT pitcher, game, pa, arg_max(gappy, ts) FILTER (WHERE gappy IS NOT NULL) AS gappy
  FROM numbered GROUP BY ALL),
shifted AS (
  SELECT pitcher, game, pa, lag(gappy) OVER (PARTITION BY pitcher, game ORDER BY pa) AS gappy_of_prev_ab
  FROM ends)
SELECT event_id, CAST(n.pa AS BIGINT) AS pa, s.gappy_of_prev_ab
FROM numbered n JOIN shifted s USING (pitcher, game, pa)""")
def prev_pa_results(spark, sf):
    log = Q.renumber(_log(spark, sf), GAME, ORDER, F.col("pitch_type") == "view", "pa")
    return Q.previous_group_results(log, GAME, "pa", ORDER, ["gappy"]).select(
        "event_id", "pa", "gappy_of_prev_ab"
    )


@query("prev_class", f"""
WITH {EVENT_LOG}
SELECT event_id, pitch_type, lag(pitch_type) OVER (PARTITION BY pitcher, game ORDER BY ts, event_id)
       AS pitch_type_of_prev_pitch
FROM log""")
def prev_class(spark, sf):
    out = Q.add(event_log(spark, sf), GAME, ORDER, [Q.lag("pitch_type_of_prev_pitch", "pitch_type")])
    return out.select("event_id", "pitch_type", "pitch_type_of_prev_pitch")


@query("seq_in_game", f"""
WITH {EVENT_LOG}
SELECT event_id, row_number() OVER (PARTITION BY pitcher, game ORDER BY ts, event_id) AS pitch_number_of_game
FROM log""")
def seq_in_game(spark, sf):
    out = Q.add(event_log(spark, sf), GAME, ORDER, [Q.row_number("pitch_number_of_game")])
    return out.select("event_id", "pitch_number_of_game")


@query("prior_matchups", f"""
WITH {EVENT_LOG},
numbered AS (
  SELECT *, sum(CASE WHEN pitch_type = 'view' THEN 1 ELSE 0 END) OVER
            (PARTITION BY pitcher, game ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pa,
         event_id % 5 AS batter
  FROM log),
meetings AS (
  SELECT pitcher, game, pa, arg_min(batter, ts) AS batter FROM numbered GROUP BY ALL),
counted AS (
  SELECT pitcher, game, pa,
         row_number() OVER (PARTITION BY pitcher, batter ORDER BY game, pa) - 1 AS prior_meetings
  FROM meetings)
SELECT event_id, prior_meetings FROM numbered JOIN counted USING (pitcher, game, pa)""")
def prior_matchups(spark, sf):
    log = Q.renumber(_log(spark, sf), GAME, ORDER, F.col("pitch_type") == "view", "pa")
    log = log.withColumn("batter", F.col("event_id") % 5)
    out = Q.prior_meetings(log, ["pitcher"], "batter", ["game", "pa"], ORDER, "prior_meetings", date="game")
    return out.select("event_id", "prior_meetings")


_RATES = ",\n       ".join(
    f"""round(avg(CAST(CASE WHEN {f"pitch_type = '{c}'" if c != "OTHER" else "pitch_type NOT IN ('click', 'error', 'view')"}
          THEN 1 ELSE 0 END AS DOUBLE)) OVER w, 6) AS prev3_{c}"""
    for c in ["click", "error", "view", "OTHER"]
)


@query("rolling_rates", f"""
WITH {EVENT_LOG}
SELECT event_id, pitcher, {_RATES}
FROM log WINDOW w AS (PARTITION BY pitcher ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def rolling_rates(spark, sf):
    classes = ["click", "error", "view", "OTHER"]
    out = Q.rolling_rates(event_log(spark, sf), ["pitcher"], ORDER, "pitch_type", classes, "prev3_")
    return out.select("event_id", "pitcher", *[F.round(f"prev3_{c}", 6).alias(f"prev3_{c}") for c in classes])


@query("dedup_keep_last", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def dedup_keep_last(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    newest = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return Q.keep_last(items, ["l_orderkey", "l_linenumber"], newest).drop("l_shipdate")


@query("dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_keep_first(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    oldest = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return Q.keep_first(items, ["l_orderkey", "l_linenumber"], oldest).drop("l_shipdate")


@query("prev_values_per_nation", """
WITH log AS (
  SELECT c_nationkey, o_orderkey, o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, lag(o_totalprice) OVER w AS prev_price,
       round(avg(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS prev3_price,
       row_number() OVER w AS order_number
FROM log WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey)""")
def prev_values_per_nation(spark, sf):
    """Few keys that hold everything: each nation has a fixed share of all orders, so its rows grow
    with the table. The window is cut into chunks as soon as a key passes the row limit."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    log = orders.join(customers, orders.o_custkey == customers.c_custkey).drop("c_custkey", "o_custkey")
    out = Q.add(
        log, ["c_nationkey"], ["o_orderdate", "o_orderkey"],
        [Q.lag("prev_price", "o_totalprice"), Q.rolling_mean("prev3_price", "o_totalprice", 3),
         Q.row_number("order_number")],
    )
    return out.select("o_orderkey", "prev_price", F.round("prev3_price", 4).alias("prev3_price"), "order_number")


_HOT = """
WITH log AS (
  SELECT c_nationkey, o_orderkey, o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, lag(o_totalprice, 2) OVER w AS back2, row_number() OVER w AS order_number,
       round(avg(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS prev3_price,
       CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS large_so_far
FROM log WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey)"""


@query("windows_over_hot_keys", _HOT)
def windows_over_hot_keys(spark, sf):
    """The chunked form of the windows, forced by a low row limit: every nation is cut up."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    log = orders.join(customers, orders.o_custkey == customers.c_custkey).drop("c_custkey", "o_custkey")
    out = Q.add(
        log, ["c_nationkey"], ["o_orderdate", "o_orderkey"],
        [Q.lag("back2", "o_totalprice", 2), Q.row_number("order_number"), Q.rolling_mean("prev3_price", "o_totalprice", 3),
         Q.running_sum("large_so_far", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0))],
        hot_rows=20,
    )
    return out.select("o_orderkey", "back2", "order_number", F.round("prev3_price", 4).alias("prev3_price"), "large_so_far")
