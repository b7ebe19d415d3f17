"""Usage and sample-weight operators on the sales log. The row thresholds are arguments; these
queries use smaller ones than the defaults so that small tables pass them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators import usage as U
from dugout.operators import weights as W
from dugout.registry import query
from dugout.registry.logs import SALES_LOG, sales_log, table

ENOUGH = 100
CONTINUOUS = W.Rules(min_recent=ENOUGH, min_older=ENOUGH)
GATED = W.Rules(
    min_recent=ENOUGH, min_older=ENOUGH, decline_min_prior=0.035, decline_ratio=0.9,
    inactive_name="inactive", declining_name="major_decline", rise_min_recent=0.04, rise_max_prior=0.037,
    emerging_max_prior=0.037, inactive_below=0.02,
)
CATEGORICAL = W.CategoricalRules(
    min_recent=ENOUGH, min_older=ENOUGH, inactive_below=0.025, meaningful=0.03, decline_ratio=0.8,
    emerging_recent=0.04, emerging_max_peak=0.05,
)

COUNTS = f"""{SALES_LOG},
cnt AS (SELECT pitcher, season, pitch_type, count(*) AS n FROM log GROUP BY ALL),
tot AS (SELECT pitcher, season, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY ALL),
lat AS (SELECT pitcher, max(season) AS latest_season, min(season) AS first_season FROM tot GROUP BY ALL),
rel AS (SELECT pitcher, season, total, latest_season,
               row_number() OVER (PARTITION BY pitcher ORDER BY season DESC) AS rk
        FROM tot JOIN lat USING (pitcher) WHERE season < latest_season AND total >= {ENOUGH})"""
CONTEXT = f"""{COUNTS},
prior_n AS (SELECT pitcher, pitch_type, sum(n) AS pn FROM cnt JOIN rel USING (pitcher, season) WHERE rk <= 2 GROUP BY ALL),
prior_t AS (SELECT pitcher, sum(total) AS pt FROM rel WHERE rk <= 2 GROUP BY ALL),
peaks AS (SELECT pitcher, pitch_type, max(n / total) AS peak FROM cnt JOIN rel USING (pitcher, season) GROUP BY ALL),
ctx AS (
  SELECT ty.pitcher, ty.pitch_type, lat.latest_season, lat.first_season, lt.total AS latest_total, pt,
         coalesce(c.n, 0) / lt.total AS recent, coalesce(pn / pt, 0.0::DOUBLE) AS prior, coalesce(peak, 0.0::DOUBLE) AS peak
  FROM (SELECT DISTINCT pitcher, pitch_type FROM cnt) ty
  JOIN lat USING (pitcher)
  JOIN tot lt ON lt.pitcher = ty.pitcher AND lt.season = lat.latest_season
  LEFT JOIN cnt c ON c.pitcher = ty.pitcher AND c.pitch_type = ty.pitch_type AND c.season = lat.latest_season
  LEFT JOIN prior_n ON prior_n.pitcher = ty.pitcher AND prior_n.pitch_type = ty.pitch_type
  LEFT JOIN prior_t ON prior_t.pitcher = ty.pitcher
  LEFT JOIN peaks ON peaks.pitcher = ty.pitcher AND peaks.pitch_type = ty.pitch_type),
usable AS (SELECT * FROM ctx WHERE first_season < latest_season AND latest_total >= {ENOUGH} AND pt IS NOT NULL)"""


def _smooth(decline: str, rise: str) -> str:
    return f"""
  CASE WHEN {decline} THEN least(greatest((recent + 0.01::DOUBLE) / (prior + 0.01::DOUBLE), 0.15::DOUBLE), 1.0::DOUBLE)
       ELSE 1.0::DOUBLE END AS old_multiplier,
  CASE WHEN NOT ({decline}) AND {rise}
       THEN least(greatest(1.0::DOUBLE + (recent - prior) * 2.5::DOUBLE, 1.0::DOUBLE), 1.5::DOUBLE)
       ELSE 1.0::DOUBLE END AS recent_multiplier"""


_C_DECLINE = "(prior >= 0.03::DOUBLE AND recent < prior)"
_C_RISE = "(recent > prior AND recent >= 0.05::DOUBLE)"
_C_ADJ = f"""adj AS (
SELECT pitcher, pitch_type, latest_season, recent, prior,
  CASE WHEN {_C_DECLINE} AND recent < 0.01::DOUBLE THEN 'nearly_inactive' WHEN {_C_DECLINE} THEN 'declining'
       WHEN {_C_RISE} AND prior <= 0.01::DOUBLE THEN 'emerging' WHEN {_C_RISE} THEN 'increasing'
       ELSE 'stable' END AS status, {_smooth(_C_DECLINE, _C_RISE)}
FROM usable)"""
_G_DECLINE = "(prior >= 0.035::DOUBLE AND recent < prior * 0.9::DOUBLE)"
_G_RISE = "(prior <= 0.037::DOUBLE AND recent >= 0.04::DOUBLE)"
_G_ADJ = f"""adj AS (
SELECT pitcher, pitch_type, latest_season, recent, prior,
  CASE WHEN {_G_DECLINE} AND recent < 0.02::DOUBLE THEN 'inactive' WHEN {_G_DECLINE} THEN 'major_decline'
       WHEN {_G_RISE} THEN 'emerging' ELSE 'stable' END AS status, {_smooth(_G_DECLINE, _G_RISE)}
FROM usable)"""
_ADJ_OUT = """SELECT pitcher, pitch_type, latest_season, round(recent, 6) AS recent_usage, round(prior, 6) AS prior_usage,
       status, round(old_multiplier, 6) AS old_multiplier, round(recent_multiplier, 6) AS recent_multiplier
FROM adj"""

_RECENCY = f"""careers AS (
  SELECT pitcher, max(season) AS last_season,
         greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT season) - 1)) AS decay
  FROM log GROUP BY pitcher)"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_MULT = ("recent_usage", "prior_usage", "old_multiplier", "recent_multiplier")


@query("value_counts", f"""
WITH {SALES_LOG} SELECT pitch_type, count(*) AS n FROM log GROUP BY pitch_type""")
def value_counts(spark, sf):
    return U.class_counts(sales_log(spark, sf), [], "pitch_type")


@query("usage_share", f"""
WITH {SALES_LOG}, c AS (SELECT pitcher, pitch_type, count(*) AS n FROM log GROUP BY ALL)
SELECT pitcher, pitch_type, n, round(n / sum(n) OVER (PARTITION BY pitcher), 6) AS share FROM c""")
def usage_share(spark, sf):
    return _rounded(U.usage_share(sales_log(spark, sf), ["pitcher"], "pitch_type"), "share")


@query("ranked_usage", f"""
WITH {SALES_LOG}, c AS (SELECT pitcher, pitch_type, count(*) AS n FROM log GROUP BY ALL)
SELECT pitcher, pitch_type, n, round(n / sum(n) OVER (PARTITION BY pitcher), 6) AS share,
       CAST(row_number() OVER (PARTITION BY pitcher ORDER BY n DESC, pitch_type) AS INTEGER) AS place FROM c""")
def ranked_usage(spark, sf):
    return _rounded(U.ranked_usage(sales_log(spark, sf), ["pitcher"], "pitch_type"), "share")


@query("season_usage", f"""
WITH {COUNTS}
SELECT pitcher, season, pitch_type, n AS pitch_count, total AS season_total, round(n / total, 6) AS usage_rate
FROM cnt JOIN tot USING (pitcher, season)""")
def season_usage(spark, sf):
    return _rounded(U.season_usage(sales_log(spark, sf), "pitcher", "season", "pitch_type"), "usage_rate")


@query("reliable_seasons", f"""
WITH {COUNTS}
SELECT pitcher, season, total AS n, latest_season, CAST(rk AS INTEGER) AS recency_rank FROM rel WHERE rk <= 2""")
def reliable_seasons(spark, sf):
    return U.reliable_prior_seasons(sales_log(spark, sf), "pitcher", "season", ENOUGH)


@query("peak_usage", f"""
WITH {COUNTS}
SELECT pitcher, pitch_type, round(max(n / total), 6) AS peak_older_usage
FROM cnt JOIN rel USING (pitcher, season) GROUP BY pitcher, pitch_type""")
def peak_usage(spark, sf):
    out = U.peak_usage(sales_log(spark, sf), "pitcher", "season", "pitch_type", ENOUGH)
    return _rounded(out, "peak_older_usage")


@query("latest_season", f"""
WITH {SALES_LOG}
SELECT pitcher, count(DISTINCT season) AS career_seasons, max(season) AS last_season FROM log GROUP BY pitcher""")
def latest_season(spark, sf):
    return W.career(sales_log(spark, sf), ["pitcher"])


@query("usage_lookup", f"""
WITH {CONTEXT}
SELECT pitcher, pitch_type, latest_season, round(recent, 6) AS recent_usage, round(prior, 6) AS prior_usage,
       round(peak, 6) AS peak_older_usage
FROM usable""")
def usage_lookup(spark, sf):
    out = U.repertoire_context(sales_log(spark, sf), "pitcher", "season", "pitch_type", ENOUGH, ENOUGH)
    return _rounded(
        out.filter("usable").select("pitcher", "pitch_type", "latest_season", "recent_usage", "prior_usage", "peak_older_usage"),
        "recent_usage", "prior_usage", "peak_older_usage",
    )


@query("recency_weight", f"""
WITH {SALES_LOG}, {_RECENCY}
SELECT pitcher, season, game_pk, pitch_type, round(greatest(pow(decay, last_season - season), 0.1::DOUBLE), 6) AS recency_weight
FROM log JOIN careers USING (pitcher)""")
def recency_weight(spark, sf):
    out = W.recency_weights(sales_log(spark, sf), ["pitcher"])
    return _rounded(out.select("pitcher", "season", "game_pk", "pitch_type", "recency_weight"), "recency_weight")


@query("recency_weight_aggressive", f"""
WITH {SALES_LOG},
careers AS (SELECT pitcher, greatest(0.65::DOUBLE, 0.92::DOUBLE - 0.02::DOUBLE * (count(DISTINCT season) - 1)) AS decay
            FROM log GROUP BY pitcher)
SELECT pitcher, season, count(*) AS n,
       round(greatest(pow(max(decay), greatest(0, 2000 - season)), 0.05::DOUBLE), 6) AS recency_weight
FROM log JOIN careers USING (pitcher) GROUP BY pitcher, season""")
def recency_weight_aggressive(spark, sf):
    out = W.recency_weights(sales_log(spark, sf), ["pitcher"], 2000, W.AGGRESSIVE)
    return out.groupBy("pitcher", "season").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("recency_weight"), 6).alias("recency_weight")
    )


@query("season_weight_table", f"""
WITH {SALES_LOG}, {_RECENCY}
SELECT DISTINCT pitcher, season, last_season - season AS seasons_ago,
       round(greatest(pow(decay, last_season - season), 0.1::DOUBLE), 6) AS recency_weight
FROM log JOIN careers USING (pitcher)""")
def season_weight_table(spark, sf):
    return _rounded(W.season_weight_table(sales_log(spark, sf), ["pitcher"]), "recency_weight")


@query("repertoire_continuous", f"WITH {CONTEXT}, {_C_ADJ} {_ADJ_OUT}")
def repertoire_continuous(spark, sf):
    return _rounded(W.adjustments(sales_log(spark, sf), "pitcher", "pitch_type", CONTINUOUS), *_MULT)


@query("repertoire_gated", f"WITH {CONTEXT}, {_G_ADJ} {_ADJ_OUT}")
def repertoire_gated(spark, sf):
    return _rounded(W.adjustments(sales_log(spark, sf), "pitcher", "pitch_type", GATED), *_MULT)


@query("repertoire_categorical_peak", f"""
WITH {CONTEXT}
SELECT pitcher, pitch_type, latest_season, round(recent, 6) AS recent_usage,
       round(CASE WHEN ok THEN prior ELSE 0 END, 6) AS prior_usage,
       round(CASE WHEN ok THEN peak ELSE 0 END, 6) AS peak_older_usage,
       CASE WHEN first_season = latest_season THEN 'insufficient_history'
            WHEN latest_total < {ENOUGH} THEN 'insufficient_recent_data'
            WHEN pt IS NULL THEN 'insufficient_history'
            WHEN recent < 0.025::DOUBLE AND peak >= 0.03::DOUBLE THEN 'inactive'
            WHEN prior >= 0.03::DOUBLE AND recent < prior * 0.8::DOUBLE THEN 'declining'
            WHEN recent >= 0.04::DOUBLE AND peak <= 0.05::DOUBLE THEN 'emerging' ELSE 'stable' END AS status,
       CASE WHEN NOT ok THEN 1.0::DOUBLE WHEN recent < 0.025::DOUBLE AND peak >= 0.03::DOUBLE THEN 0.1::DOUBLE
            WHEN prior >= 0.03::DOUBLE AND recent < prior * 0.8::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS old_multiplier
FROM (SELECT *, first_season < latest_season AND latest_total >= {ENOUGH} AND pt IS NOT NULL AS ok FROM ctx)""")
def repertoire_categorical_peak(spark, sf):
    out = W.categorical_adjustments(sales_log(spark, sf), "pitcher", "pitch_type", CATEGORICAL)
    return _rounded(out.drop("recent_multiplier"), "recent_usage", "prior_usage", "peak_older_usage")


@query("repertoire_categorical_prior", f"""
WITH {CONTEXT}
SELECT pitcher, pitch_type, round(recent, 6) AS recent_usage, round(prior, 6) AS prior_usage,
       CASE WHEN recent < 0.025::DOUBLE AND prior >= 0.03::DOUBLE THEN 'inactive'
            WHEN prior >= 0.03::DOUBLE AND recent < prior * 0.8::DOUBLE THEN 'declining' ELSE 'stable' END AS status,
       CASE WHEN recent < 0.025::DOUBLE AND prior >= 0.03::DOUBLE THEN 0.1::DOUBLE
            WHEN prior >= 0.03::DOUBLE AND recent < prior * 0.8::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS old_multiplier
FROM usable""")
def repertoire_categorical_prior(spark, sf):
    rules = W.CategoricalRules(
        min_recent=ENOUGH, min_older=ENOUGH, inactive_below=0.025, meaningful=0.03, decline_ratio=0.8, peak=False
    )
    out = W.categorical_adjustments(sales_log(spark, sf), "pitcher", "pitch_type", rules)
    return _rounded(
        out.select("pitcher", "pitch_type", "recent_usage", "prior_usage", "status", "old_multiplier"),
        "recent_usage", "prior_usage",
    )


@query("final_weight", f"""
WITH {CONTEXT}, {_C_ADJ}, {_RECENCY}
SELECT l.pitcher, l.season, l.game_pk, l.pitch_type,
       round(greatest(pow(decay, last_season - season), 0.1::DOUBLE) *
             coalesce(CASE WHEN season < latest_season THEN old_multiplier ELSE recent_multiplier END, 1.0::DOUBLE), 6) AS weight
FROM log l JOIN careers USING (pitcher)
LEFT JOIN adj ON adj.pitcher = l.pitcher AND adj.pitch_type = l.pitch_type""")
def final_weight(spark, sf):
    out = W.training_weights(sales_log(spark, sf), "pitcher", "pitch_type", rules=CONTINUOUS)
    return _rounded(out.select("pitcher", "season", "game_pk", "pitch_type", "weight"), "weight")


@query("status_text", f"""
WITH {CONTEXT}, {_C_ADJ}
SELECT pitcher, string_agg(concat(pitch_type, ':', status), '; ' ORDER BY pitch_type) AS summary,
       coalesce(string_agg(pitch_type, ',' ORDER BY pitch_type) FILTER (WHERE status = 'declining'), '') AS declining_classes
FROM adj GROUP BY pitcher""")
def status_text(spark, sf):
    out = W.adjustments(sales_log(spark, sf), "pitcher", "pitch_type", CONTINUOUS)
    return W.status_text(out, "pitcher", "pitch_type").select("pitcher", "summary", "declining_classes")


@query("league_usage", """
WITH w AS (SELECT p_type AS pitch_type, p_brand AS pitch_name, CAST(sum(l_quantity) AS BIGINT) AS pitches
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT pitch_type, pitch_name, pitches, round(pitches * 100.0::DOUBLE / sum(pitches) OVER (), 6) AS usage_percent FROM w""")
def league_usage(spark, sf):
    from dugout.plans import league

    return _rounded(league.usage(_arsenal(spark, sf)), "usage_percent")


@query("league_family_usage", """
WITH w AS (SELECT p_type, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Fastball' WHEN p_type = 'SMALL' THEN 'Offspeed' END AS pitch_group,
             q * 100 / sum(q) OVER () AS share FROM w)
SELECT pitch_group, round(sum(share), 6) AS usage_percent FROM t WHERE pitch_group IS NOT NULL GROUP BY pitch_group""")
def league_family_usage(spark, sf):
    from dugout.plans import league

    families = {"ECONOMY": "Fastball", "PROMO": "Fastball", "SMALL": "Offspeed"}
    return _rounded(league.family_usage(_arsenal(spark, sf), families), "usage_percent")


def _arsenal(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("p_type").alias("pitch_type"), F.col("p_brand").alias("pitch_name"), F.col("l_quantity").cast("bigint").alias("pitches")
    )


@query("decay_factor", """
SELECT c_nationkey, count(DISTINCT year(o_orderdate)) AS career_seasons,
       round(greatest(0.8::DOUBLE, 0.98::DOUBLE - 0.01::DOUBLE * (count(DISTINCT year(o_orderdate)) - 1)), 6) AS decay
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def decay_factor(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("season"))
    log = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return W.career(log, ["c_nationkey"]).select(
        "c_nationkey", "career_seasons", F.round(S.decay_factor("career_seasons"), 6).alias("decay")
    )
