"""The given tables seen as logs. Each view exists twice: as a DataFrame and as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout import columns as C


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- events: user = pitcher, week = game, event type = pitch type -----------------------------
def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("pitcher"),
        F.trunc(F.col("ts").cast("date"), "week").alias("game"),
        "ts",
        F.col("event_type").alias("pitch_type"),
        "value",
        "props",
    )


EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
EVENT_LOG = """log AS (
  SELECT event_id, user_id AS pitcher, CAST(date_trunc('week', ts) AS DATE) AS game, ts,
         event_type AS pitch_type, value, props
  FROM events)"""


# --- sales: nation = pitcher, order = game, brand = pitch type, year = season -----------------
def sales_log(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("game_date")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("c_nationkey").cast("bigint").alias("pitcher"),
            F.year("game_date").alias("season"),
            F.col("l_orderkey").alias("game_pk"),
            "game_date",
            "l_linenumber",
            "l_partkey",
            F.col("p_brand").alias("pitch_type"),
            F.col("p_type").alias("family"),
            "l_quantity",
        )
    )


SALES_LOG = """log AS (
  SELECT CAST(c_nationkey AS BIGINT) AS pitcher, CAST(year(o_orderdate) AS INTEGER) AS season,
         l_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS game_date, l_linenumber, l_partkey,
         p_brand AS pitch_type, p_type AS family, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey)"""


# --- orders: evaluated games, one row per order -----------------------------------------------
def game_history(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("pitch_count"),
        F.count_if(F.col("l_returnflag") != "N").alias("model_correct"),
        F.count_if(F.col("l_discount") < 0.03).alias("baseline_correct"),
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("game_date"), "o_orderstatus"
    )
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        "game_date",
        F.year("game_date").cast("bigint").alias("season"),
        F.col("o_orderkey").alias("game_pk"),
        F.col("o_custkey").alias("pitcher_id"),
        F.col("o_orderstatus").alias("order_status"),
        "pitch_count", "model_correct", "baseline_correct",
        (F.col("model_correct") / F.col("pitch_count")).alias("model_accuracy"),
        (F.col("baseline_correct") / F.col("pitch_count")).alias("baseline_accuracy"),
    )
    return rows


GAME_HISTORY = """history AS (
  SELECT CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS BIGINT) AS season,
         o_orderkey AS game_pk, o_custkey AS pitcher_id, o_orderstatus AS order_status,
         pitch_count, model_correct, baseline_correct,
         model_correct / pitch_count AS model_accuracy,
         baseline_correct / pitch_count AS baseline_accuracy
  FROM orders JOIN (
    SELECT l_orderkey, count(*) AS pitch_count,
           CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS model_correct,
           CAST(count(*) FILTER (WHERE l_discount < CAST(0.03 AS DOUBLE)) AS BIGINT) AS baseline_correct
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


# --- a raw pitch log with every column of the export, derived from the events ------------------
# Columns without a meaning of their own get a value from a rule over the event, with gaps.
_SPECIAL = """pitch_type pitch_name game_date game_pk pitcher batter at_bat_number pitch_number balls
    strikes stand p_throws inning inning_topbot""".split()
EXTRA = {f"extra_{i}": "string" for i in range(1, 8)}
_ORDERED = [(c, t) for t, names in C.RAW_TYPES.items() for c in names] + list(EXTRA.items())


def _rule(i: int, kind: str) -> tuple[str, str]:
    """The same value in Spark SQL and DuckDB SQL, NULL for some events."""
    gap = f"event_id % {5 + i % 7} = 0"
    if kind == "double":
        v = f"CAST((event_id * {i + 3}) % 997 AS DOUBLE) / 8"
    elif kind in ("int", "bigint"):
        v = f"CAST((event_id * {i + 3}) % {11 + i} AS {'INT' if kind == 'int' else 'BIGINT'})"
    else:
        v = f"concat('s', CAST((event_id + {i}) % {3 + i % 5} AS STRING))"
    return f"CASE WHEN {gap} THEN NULL ELSE {v} END", kind


def _pitch_exprs(day: str, week: str) -> list[tuple[str, str]]:
    codes = [*C.PITCH_CODES, "ZZ", "UN"]
    listed = ", ".join(f"'{c}'" for c in codes)
    pick = f"CAST(event_id * event_id % 31 % {len(codes)} AS INT)"
    special = {
        "pitch_type": f"CASE WHEN event_id % 23 = 0 THEN NULL ELSE {{array}}({listed}){{at}} END",
        "pitch_name": "concat('name ', event_type)",
        "game_date": day,
        "game_pk": f"CAST(700000 + {week} * 50 + user_id % 50 AS BIGINT)",
        "pitcher": "user_id",
        "batter": "CAST(event_id * 7 % 40 AS BIGINT)",
        "at_bat_number": "CAST(event_id AS INT)",
        "pitch_number": "CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 + event_id % 3 END AS INT)",
        "balls": "CAST(event_id % 4 AS INT)",
        "strikes": "CAST(event_id * 5 % 3 AS INT)",
        "stand": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END",
        "p_throws": "CASE WHEN user_id % 3 = 0 THEN 'L' ELSE 'R' END",
        "inning": "CAST(1 + event_id % 9 AS INT)",
        "inning_topbot": "CASE WHEN event_id % 2 = 0 THEN 'Top' ELSE 'Bot' END",
    }
    return [
        (special[c].replace("{pick}", pick) if c in special else _rule(i, t)[0], c)
        for i, (c, t) in enumerate(_ordered())
    ], pick


def _ordered() -> list[tuple[str, str]]:
    return _ORDERED


def pitch_log(spark: SparkSession, sf: str) -> DataFrame:
    """119 columns: the 112 known names and seven that only pass through. Weeks become game dates
    240 days apart, so careers span seasons."""
    week = "CAST(floor(datediff(CAST(ts AS DATE), DATE'2024-01-01') / 7) AS INT)"
    exprs, pick = _pitch_exprs(f"date_add(DATE'2020-03-01', 240 * {week})", week)
    exprs = [(e.replace("{array}", "array").replace("{at}", f"[{pick}]"), c) for e, c in exprs]
    return table(spark, sf, "events").selectExpr(*[f"{e} AS `{c}`" for e, c in exprs])


def _pitch_log_sql() -> str:
    week = "CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INT)"
    exprs, pick = _pitch_exprs(f"CAST(DATE '2020-03-01' + 240 * {week} AS DATE)", week)
    exprs = [(e.replace("{array}", "list_value").replace("{at}", f"[{pick} + 1]"), c) for e, c in exprs]
    return "raw AS (SELECT " + ",\n  ".join(f'{e} AS "{c}"' for e, c in exprs) + "\n  FROM events)"


PITCH_LOG = _pitch_log_sql()
RAW_COLUMNS = [c for c, _ in _ORDERED]
