"""The stage chain on a full-width raw log derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout import columns as C
from dugout import schema
from dugout.plans import stages as P
from dugout.registry import query
from dugout.registry.logs import PITCH_LOG, RAW_COLUMNS, pitch_log


def _q(name: str) -> str:
    return f'"{name}"'


_CLEANED = schema.cleaned_columns(RAW_COLUMNS)
_KG2 = schema.kg2_columns(_CLEANED)
_KG3 = schema.kg3_columns(_KG2)

_PREV = ",\n  ".join(f"lag({_q(c)}) OVER w AS {_q(C.prev_pitch(c))}" for c in C.PITCH_RESULTS)
_ENDS = ",\n  ".join(
    f"arg_max({_q(c)}, at_bat_number) FILTER (WHERE {_q(c)} IS NOT NULL) AS {_q(c)}" for c in C.PA_RESULTS
)
_SHIFT = ",\n  ".join(
    f"lag({_q(c)}) OVER (PARTITION BY pitcher, game_pk ORDER BY pa) AS {_q(C.prev_pa(c))}" for c in C.PA_RESULTS
)
_KEPT = [c for c in _CLEANED if c != "at_bat_number" and not c.endswith("_of_prev_pitch") and not c.endswith("_of_prev_ab")]

# one CTE per step, each in the order of the log
_CLEAN_SQL = f"""{PITCH_LOG},
known AS (SELECT * FROM raw WHERE pitch_type IS NOT NULL),
lagged AS (
  SELECT *, {_PREV},
         sum(CASE WHEN pitch_number = 1 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS pa
  FROM known WINDOW w AS (PARTITION BY pitcher, game_pk ORDER BY game_date, at_bat_number, pitch_number)),
pa_ends AS (SELECT pitcher, game_pk, pa, {_ENDS} FROM lagged GROUP BY pitcher, game_pk, pa),
pa_shifted AS (SELECT pitcher, game_pk, pa, {_SHIFT} FROM pa_ends),
cleaned AS (
  SELECT {", ".join("l." + _q(c) for c in _KEPT)}, CAST(l.pa AS INTEGER) AS at_bat_number,
         l.at_bat_number AS raw_at_bat,
         {", ".join("l." + _q(C.prev_pitch(c)) for c in C.PITCH_RESULTS)},
         {", ".join("s." + _q(C.prev_pa(c)) for c in C.PA_RESULTS)}
  FROM lagged l JOIN pa_shifted s ON l.pitcher = s.pitcher AND l.game_pk = s.game_pk AND l.pa = s.pa)"""

_RENAME = {"pitch_number": "pitch_number_of_ab", "at_bat_number": "at_bat_number_of_game"}
_BASE2 = ", ".join(
    f"{_q(c)} AS {_q(_RENAME[c])}" if c in _RENAME else _q(c) for c in _CLEANED if c not in C.KG2_DROPPED
)
_KG2_SQL = f"""{_CLEAN_SQL},
base2 AS (
  SELECT {_BASE2}, raw_at_bat,
    lag(pitch_type) OVER (PARTITION BY pitcher, game_pk ORDER BY at_bat_number, pitch_number, raw_at_bat)
      AS pitch_type_of_prev_pitch,
    CAST(CASE WHEN p_throws = stand THEN 1 ELSE 0 END AS INTEGER) AS "p/h_hand",
    concat(balls, '-', strikes) AS count,
    CASE WHEN balls = 3 AND strikes = 2 THEN 'full_count' WHEN strikes = 2 AND balls < 3 THEN 'put_away_count'
         WHEN balls >= 2 AND strikes <= 1 THEN 'hitters_count' WHEN strikes > balls THEN 'pitcher_ahead'
         WHEN balls > strikes THEN 'pitcher_behind' ELSE 'even_count' END AS count_state,
    CAST(row_number() OVER (PARTITION BY pitcher, game_pk ORDER BY game_date, raw_at_bat, pitch_number) AS INTEGER)
      AS pitch_number_of_game,
    fld_score - bat_score AS pitcher_team_score_diff,
    sz_top - sz_bot AS strike_zone_height
  FROM cleaned),
pas AS (
  SELECT pitcher, game_pk, at_bat_number_of_game,
         arg_min(batter, pitch_number_of_ab * 1000000 + raw_at_bat) AS first_batter, min(game_date) AS day
  FROM base2 GROUP BY ALL),
met AS (
  SELECT pitcher, game_pk, at_bat_number_of_game,
         row_number() OVER (PARTITION BY pitcher, first_batter ORDER BY day, game_pk, at_bat_number_of_game) - 1
           AS prior_pa_vs_pitcher_career
  FROM pas),
kg2 AS (SELECT * FROM base2 JOIN met USING (pitcher, game_pk, at_bat_number_of_game))"""

_CODES = ", ".join(f"'{c}'" for c in C.PITCH_CODES)
_RATES = ",\n  ".join(
    f"round(avg(CAST(CASE WHEN {f'pitch_type = {chr(39)}{c}{chr(39)}' if c != 'OTHER' else f'pitch_type NOT IN ({_CODES})'} "
    f"THEN 1 ELSE 0 END AS DOUBLE)) OVER w, 6) AS {_q('prev3_pitch_rate_' + c)}"
    for c in C.RATE_BUCKETS
)
_KG3_SQL = f"""{_KG2_SQL},
kg3 AS (
  SELECT *, {_RATES} FROM kg2
  WINDOW w AS (PARTITION BY pitcher ORDER BY game_date, game_pk, at_bat_number_of_game, pitch_number_of_ab, raw_at_bat
               ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


def _out(columns: list[str], source: str) -> str:
    return "SELECT " + ", ".join(_q(c) for c in columns) + f" FROM {source}"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in C.RATE_COLUMNS})


@query("clean", f"WITH {_CLEAN_SQL}\n{_out(_CLEANED, 'cleaned')}")
def clean(spark, sf):
    return P.published(P.clean(pitch_log(spark, sf)))


@query("kg2", f"WITH {_KG2_SQL}\n{_out(_KG2, 'kg2')}")
def kg2(spark, sf):
    return P.published(P.build(pitch_log(spark, sf)).kg2)


@query("kg3", f"WITH {_KG3_SQL}\n{_out(_KG3, 'kg3')}")
def kg3(spark, sf):
    return _rounded(P.published(P.build(pitch_log(spark, sf)).kg3))


@query("kg4", f"WITH {_KG3_SQL}\n{_out(C.KG4, 'kg3')}")
def kg4(spark, sf):
    return _rounded(P.published(P.build(pitch_log(spark, sf)).kg4))


@query("cleaning_summary", f"""
WITH {PITCH_LOG}
SELECT count(*) AS rows_before, count(pitch_type) AS rows_after,
       count(*) FILTER (WHERE pitch_type IS NULL) AS rows_dropped_without_pitch_type,
       CAST(118 AS INTEGER) AS column_count
FROM raw""")
def cleaning_summary(spark, sf):
    return P.cleaning_summary(pitch_log(spark, sf))


@query("incremental_stages", f"WITH {_KG3_SQL}\n{_out(C.KG4, 'kg3')}")
def incremental_stages(spark, sf):
    """The same table in two steps: what came before the last eight dates, then those as a batch."""
    from dugout.plans import increment
    from dugout.session import cut_lineage

    log = cut_lineage(pitch_log(spark, sf))
    cut = [r[0] for r in log.select("game_date").distinct().orderBy(F.col("game_date").desc()).limit(8).collect()][-1]
    first = P.build(log.filter(F.col("game_date") < F.lit(cut)))
    cuts = log.select("pitcher").distinct().withColumn("cut", F.lit(cut))
    batch, cuts = increment.whole_games(log, cuts)
    built = increment.extend(batch, cuts, increment.carry(first.kg2))
    return _rounded(P.published(increment.merged(first.kg4, built.kg4, cuts)).select(*[f"`{c}`" for c in C.KG4]))
