"""League-wide usage of pitch types and of their families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout import columns as C
from dugout.functions import scalar as S
from dugout.operators.usage import weighted_share


def usage(arsenal: DataFrame, code: str = "pitch_type", name: str = "pitch_name", weight: str = "pitches") -> DataFrame:
    """Share of all pitches per type, in percent."""
    return weighted_share(arsenal, [code, name], weight)


def family_usage(
    arsenal: DataFrame, families: dict[str, str] = C.PITCH_FAMILIES, code: str = "pitch_type", weight: str = "pitches"
) -> DataFrame:
    """Shares rolled up to families; types without a family are left out, as shares of all pitches."""
    shares = weighted_share(arsenal, [code], weight).withColumn("pitch_group", S.lookup(code, families))
    return shares.filter(F.col("pitch_group").isNotNull()).groupBy("pitch_group").agg(
        F.sum("usage_percent").alias("usage_percent")
    )
