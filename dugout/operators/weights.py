"""Sample weights: how much an old pitch should still count.

Recency decays by season. Repertoire weights compare the usage of a class in the key's last season
with its usage before, lower old rows of classes in decline and raise recent rows of classes on the
rise. Each rule set is a value of ``Rules``; none of them sees anything but the rows passed in, so
callers pass training rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators.groups import settled
from dugout.operators.usage import repertoire_context


@dataclass(frozen=True)
class Recency:
    start: float = 0.98
    step: float = 0.01
    floor: float = 0.80
    minimum: float = 0.10


MILD = Recency()
AGGRESSIVE = Recency(start=0.92, step=0.02, floor=0.65, minimum=0.05)


@dataclass(frozen=True)
class Rules:
    """Usage thresholds and multipliers of a repertoire rule set."""

    min_recent: int = 300
    min_older: int = 300
    decline_min_prior: float = 0.03
    decline_ratio: float = 1.0  # decline means recent < ratio * prior
    smoothing: float = 0.01
    old_floor: float = 0.15
    inactive_below: float = 0.01
    inactive_name: str = "nearly_inactive"
    declining_name: str = "declining"
    rise_min_recent: float = 0.05
    rise_max_prior: float | None = None  # None: any prior usage below the recent one
    rise_scale: float = 2.5
    recent_cap: float = 1.50
    emerging_max_prior: float = 0.01


CONTINUOUS = Rules()
GATED = Rules(
    decline_min_prior=0.08, decline_ratio=0.50, inactive_name="inactive", declining_name="major_decline",
    rise_min_recent=0.08, rise_max_prior=0.02, emerging_max_prior=0.02,
)


@dataclass(frozen=True)
class CategoricalRules:
    """Fixed multipliers; ``peak`` judges inactivity by the best older season instead of the pooled
    prior ones, and explains keys it cannot judge."""

    min_recent: int = 300
    min_older: int = 300
    inactive_below: float = 0.01
    meaningful: float = 0.08
    decline_ratio: float = 0.50
    emerging_recent: float = 0.05
    emerging_max_peak: float = 0.01
    inactive_multiplier: float = 0.10
    declining_multiplier: float = 0.50
    peak: bool = True


CATEGORICAL_PEAK = CategoricalRules()
CATEGORICAL_PRIOR = CategoricalRules(peak=False)


# --- recency ----------------------------------------------------------------------------------
def career(df: DataFrame, keys: list[str], season: str = "season") -> DataFrame:
    """Number of seasons and the last one, per key."""
    return df.groupBy(*keys).agg(
        F.countDistinct(season).alias("career_seasons"), F.max(season).alias("last_season")
    )


def recency_weights(
    df: DataFrame,
    keys: list[str],
    reference: int | str | None = None,
    settings: Recency = MILD,
    season: str = "season",
    out: str = "recency_weight",
) -> DataFrame:
    """Weight by season; the reference season is the key's own last one unless given as a number or
    as the name of a column."""
    about = career(df, keys, season).withColumn(
        "_decay", S.decay_factor("career_seasons", settings.start, settings.step, settings.floor)
    ).withColumn("_ref", F.col("last_season"))
    if isinstance(reference, str):
        df, about = df.withColumn("_ref", F.col(reference)), about.drop("_ref")
    elif reference is not None:
        about = about.withColumn("_ref", F.lit(reference))
    joined = df.join(settled(about.drop("career_seasons", "last_season")), keys)
    return joined.withColumn(out, S.recency_weight(season, "_ref", "_decay", settings.minimum)).drop(
        "_decay", "_ref"
    )


def season_weight_table(
    df: DataFrame, keys: list[str], reference: int | None = None, settings: Recency = MILD, season: str = "season"
) -> DataFrame:
    """The weight each season of the key gets (newest first when sorted by seasons_ago)."""
    seasons = df.select(*keys, season).filter(F.col(season).isNotNull()).distinct()
    weighted = recency_weights(seasons, keys, reference, settings, season)
    last = career(seasons, keys, season).select(*keys, "last_season")
    ref = F.col("last_season") if reference is None else F.lit(reference)
    return weighted.join(last, keys).select(
        *keys, season, F.greatest(F.lit(0), ref - F.col(season)).alias("seasons_ago"), "recency_weight"
    )


# --- repertoire -------------------------------------------------------------------------------
def _moves(recent: Column, prior: Column, rules: Rules) -> tuple[Column, Column]:
    """Whether a class declines and whether it rises."""
    declines = (prior >= rules.decline_min_prior) & (recent < prior * rules.decline_ratio)
    below = F.lit(True) if rules.rise_max_prior is None else prior <= rules.rise_max_prior
    return declines, ~declines & (recent > prior) & (recent >= rules.rise_min_recent) & below


def multipliers(recent: Column, prior: Column, rules: Rules = CONTINUOUS) -> tuple[Column, Column]:
    """Factors for rows of older seasons and of the last one, from a class's usage in both."""
    declines, rises = _moves(recent, prior, rules)
    shrink = S.clip((recent + rules.smoothing) / (prior + rules.smoothing), rules.old_floor, 1.0)
    boost = S.clip(F.lit(1.0) + (recent - prior) * rules.rise_scale, 1.0, rules.recent_cap)
    return F.when(declines, shrink).otherwise(1.0), F.when(rises, boost).otherwise(1.0)


def adjustments(
    df: DataFrame, key: str, label: str, rules: Rules = CONTINUOUS, season: str = "season"
) -> DataFrame:
    """Status and multipliers per key and class; keys without a fair comparison have no rows."""
    context = repertoire_context(df, key, season, label, rules.min_recent, rules.min_older).filter("usable")
    recent, prior = F.col("recent_usage"), F.col("prior_usage")
    declines, rises = _moves(recent, prior, rules)
    old, new = multipliers(recent, prior, rules)
    status = (
        F.when(declines & (recent < rules.inactive_below), rules.inactive_name)
        .when(declines, rules.declining_name)
        .when(rises & (prior <= rules.emerging_max_prior), "emerging")
        .when(rises, "increasing")
        .otherwise("stable")
    )
    return context.select(
        key, label, "latest_season", "recent_usage", "prior_usage",
        status.alias("status"),
        old.alias("old_multiplier"), new.alias("recent_multiplier"),
    )


def categorical_adjustments(
    df: DataFrame, key: str, label: str, rules: CategoricalRules = CATEGORICAL_PEAK, season: str = "season"
) -> DataFrame:
    context = repertoire_context(df, key, season, label, rules.min_recent, rules.min_older)
    recent, prior, peak = F.col("recent_usage"), F.col("prior_usage"), F.col("peak_older_usage")
    usable = F.col("usable")
    inactive = (recent < rules.inactive_below) & ((peak if rules.peak else prior) >= rules.meaningful)
    declining = (prior >= rules.meaningful) & (recent < prior * rules.decline_ratio)
    emerging = F.lit(rules.peak) & (recent >= rules.emerging_recent) & (peak <= rules.emerging_max_peak)
    status = (
        F.when(~F.col("several_seasons"), "insufficient_history")
        .when(~F.col("enough_recent"), "insufficient_recent_data")
        .when(~F.col("enough_older"), "insufficient_history")
        .when(inactive, "inactive")
        .when(declining, "declining")
        .when(emerging, "emerging")
        .otherwise("stable")
    )
    multiplier = (
        F.when(~usable, 1.0)
        .when(inactive, rules.inactive_multiplier)
        .when(declining, rules.declining_multiplier)
        .otherwise(1.0)
    )
    table = context.select(
        key, label, "latest_season", "recent_usage",
        F.when(usable, prior).otherwise(0.0).alias("prior_usage"),
        F.when(usable, peak).otherwise(0.0).alias("peak_older_usage"),
        status.alias("status"), multiplier.alias("old_multiplier"), F.lit(1.0).alias("recent_multiplier"),
        usable.alias("usable"),
    )
    return (table if rules.peak else table.filter("usable")).drop("usable")


def apply_adjustments(
    df: DataFrame, table: DataFrame, key: str, label: str, season: str = "season", out: str = "repertoire_weight"
) -> DataFrame:
    """Weight of each row: old multiplier before the key's last season, recent one within it.

    Only classes that change anything take part in the join; every other row keeps weight 1.
    """
    changed = table.filter((F.col("old_multiplier") < 1.0) | (F.col("recent_multiplier") > 1.0)).select(
        key, label, F.col("latest_season").alias("_latest"),
        F.col("old_multiplier").alias("_old"), F.col("recent_multiplier").alias("_recent"),
    )
    weight = (
        F.when(F.col(season) < F.col("_latest"), F.col("_old"))
        .when(F.col(season) == F.col("_latest"), F.col("_recent"))
    )
    return (
        df.join(settled(changed), [key, label], "left")
        .withColumn(out, F.coalesce(weight, F.lit(1.0)))
        .drop("_latest", "_old", "_recent")
    )


def training_weights(
    df: DataFrame,
    key: str,
    label: str,
    reference: int | str | None = None,
    rules: Rules | None = CONTINUOUS,
    recency: Recency | None = MILD,
    season: str = "season",
    out: str = "weight",
) -> DataFrame:
    """Recency x repertoire. Leave either out with None."""
    rows, factors = df, []
    if recency is not None:
        rows = recency_weights(rows, [key], reference, recency, season, "_recency")
        factors.append("_recency")
    if rules is not None:
        table = adjustments(df, key, label, rules, season)
        rows = apply_adjustments(rows, table, key, label, season, "_repertoire")
        factors.append("_repertoire")
    product: Column = F.lit(1.0)
    for f in factors:
        product = product * F.col(f)
    return rows.withColumn(out, product).drop(*factors)


def status_text(table: DataFrame, key: str, label: str, multipliers: bool = False) -> DataFrame:
    """One line per key, such as 'FF:stable; SL:declining'. A key has one row per class here."""
    item = F.concat(F.col(label), F.lit(":"), F.col("status"))
    if multipliers:
        item = F.concat(
            item, F.format_string("(old=%.2f,new=%.2f)", F.col("old_multiplier"), F.col("recent_multiplier"))
        )
    pairs = F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), item.alias("t"))))

    def listed(status: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.col(label)))), ",")

    return table.groupBy(key).agg(
        F.array_join(F.transform(pairs, lambda p: p["t"]), "; ").alias("summary"),
        listed("inactive").alias("inactive_classes"),
        listed("declining").alias("declining_classes"),
        listed("emerging").alias("emerging_classes"),
    )
