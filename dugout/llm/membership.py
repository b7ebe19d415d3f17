"""Which rows may be in a large set of ids, without shuffling the rows.

A bitmap of fixed size holds one hashed bit per id of the set: at most ``BITS`` bits (8 MB), so it may
be broadcast whatever the set's size. Rows without their bit are surely not in the set; the others
are few unless the set is very large, and only they need a join. Beyond some tens of millions of ids
the bitmap is nearly full: the answer is the same, but then almost every row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.store import kept

BITS = 1 << 26
PART = 1 << 15  # bits of one bitmap of Spark's


def marked(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """``rows`` (whose columns must not begin with ``_m_``) with ``_m_maybe``: false
    where ``key`` is surely not in the one column of ``ids``."""
    name = ids.columns[0]
    place = lambda c: F.pmod(F.xxhash64(c.cast("bigint")), F.lit(BITS))
    at = place(ids[name])
    maps = kept(
        ids.groupBy(F.floor(at / PART).cast("int").alias("_m_part"))
        .agg(F.bitmap_construct_agg(at % PART).alias("_m_bits")), "membership")
    own = place(key)
    byte = F.substring("_m_bits", ((own % PART) / 8).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (own % 8).cast("int"))
    tagged = rows.withColumn("_m_own", F.floor(own / PART).cast("int")).join(
        F.broadcast(maps), F.col("_m_own") == F.col("_m_part"), "left")
    hit = F.coalesce((bit % 2) == 1, F.lit(False))
    return tagged.withColumn("_m_maybe", hit).drop("_m_own", "_m_part", "_m_bits")


def parted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is not in the one column of ``ids``, a null key among them, and those
    whose key is. Only rows that may be in it are shuffled."""
    packed = rows.select(F.struct("*").alias("_m_row"), F.col(key).cast("bigint").alias("_m_key"))
    split = marked(packed, F.col("_m_key"), ids)
    these = ids.select(F.col(ids.columns[0]).alias("_m_these")).distinct()
    open_, on = split.filter("_m_maybe"), F.col("_m_key") == F.col("_m_these")
    outside = split.filter("not _m_maybe").unionByName(open_.join(these, on, "left_anti"))
    return outside.select("_m_row.*"), open_.join(these, on, "left_semi").select("_m_row.*")


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The first of the two of ``parted``."""
    return parted(rows, key, ids)[0]
