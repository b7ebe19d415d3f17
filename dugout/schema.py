"""Schema contracts: which columns a table must have, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout import columns as C


class SchemaMismatchError(ValueError):
    """A table does not have the columns its contract names."""


def clean_names(df: DataFrame) -> DataFrame:
    """Strip blanks and quotes that exports leave around header names."""
    return df.toDF(*[c.strip().strip('"') for c in df.columns])


def canonical(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """Exactly these columns in this order; anything missing, extra or doubled is one error."""
    df = clean_names(df)
    have = df.columns
    problems = {
        "missing": sorted(set(columns) - set(have)),
        "extra": sorted(set(have) - set(columns)),
        "duplicates": sorted({c for c in have if have.count(c) > 1}),
    }
    found = [f"{kind}={names}" for kind, names in problems.items() if names]
    if found:
        raise SchemaMismatchError(f"{source}: " + "; ".join(found))
    return df.select(*[f"`{c}`" for c in columns])


def require(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaMismatchError(f"{source}: missing={missing}")
    return df


def check_order(df: DataFrame, columns: list[str], source: str) -> None:
    if df.columns != list(columns):
        raise SchemaMismatchError(f"{source}: columns are not in canonical order")


def unexpected_keys(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Keys in the data that nobody asked for; NULL keys do not count."""
    seen = df.select(F.col(key).try_cast("bigint").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return seen.join(requested.select(F.col(key).cast("bigint").alias(key)), key, "left_anti")


SHOWN = 20  # keys named in an error; the rest are counted


def require_keys(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Fail when the batch holds rows of a key that was not requested."""
    strange = unexpected_keys(df, requested, key)
    named = sorted(r[0] for r in strange.limit(SHOWN).collect())
    if named:
        more = strange.count() - len(named) if len(named) == SHOWN else 0
        rest = f" and {more} more" if more else ""
        raise ValueError(f"batch holds {key} values that were not requested: {named}{rest}")
    return df


def with_columns_of(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Evolve an older table: columns it lacks become NULL, others are dropped, order is fixed."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types.items()])


# --- stage contracts, derived from whatever pass-through columns the raw log has --------------
def cleaned_columns(raw: list[str]) -> list[str]:
    moved = {*C.PITCH_RESULTS, *C.PA_RESULTS, "pitch_name"}
    return (
        [c for c in raw if c not in moved]
        + [C.prev_pitch(c) for c in C.PITCH_RESULTS]
        + [C.prev_pa(c) for c in C.PA_RESULTS]
    )


def kg2_columns(cleaned: list[str]) -> list[str]:
    names = {"pitch_number": "pitch_number_of_ab", "at_bat_number": "at_bat_number_of_game"}
    return [names.get(c, c) for c in cleaned if c not in C.KG2_DROPPED] + C.KG2_ADDED


def kg3_columns(kg2: list[str]) -> list[str]:
    return [c for c in kg2 if c not in C.KG3_DROPPED] + C.RATE_COLUMNS
