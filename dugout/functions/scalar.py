"""Row-level expressions. All of them are built from Spark's own functions and stay in codegen."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once per row. The optimizer puts an expression that is used in one place
    there, also where that place is a lambda over an array and would compute it for every element."""
    return F.transform(F.array(value), body)[0]


# --- coercion ---------------------------------------------------------------------------------
def to_number(c: Column | str, dtype: str = "double") -> Column:
    """Parse, or NULL when the text is no number. Id columns may arrive as '1001.0'."""
    text = F.trim(_col(c).cast("string"))
    if dtype in ("bigint", "int"):
        return F.coalesce(text.try_cast(dtype), text.try_cast("double").try_cast(dtype))
    return text.try_cast(dtype)


def to_day(c: Column | str) -> Column:
    """Parse a date, or NULL when the text is no date."""
    return _col(c).cast("string").try_cast("date")


def must_be_number(c: Column | str, dtype: str = "double") -> Column:
    """Parse, or fail the query: a bad value here means the input is not what it claims to be. The parse
    stands once in the expression; the message is made only where it gave nothing."""
    bad = F.raise_error(F.concat(F.lit("not a number: "), _col(c).cast("string"))).cast(dtype)
    return F.coalesce(to_number(c, dtype), F.when(_col(c).isNotNull(), bad))


def is_true(c: Column | str) -> Column:
    """TRUE for booleans and for the text a CSV round trip leaves of them; never NULL."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))) == "true", F.lit(False))


# --- count and handedness ---------------------------------------------------------------------
def same_hand(throws: Column | str, stand: Column | str) -> Column:
    return F.coalesce(_col(throws) == _col(stand), F.lit(False)).cast("int")


def count_text(balls: Column | str, strikes: Column | str) -> Column:
    return F.concat(_col(balls).cast("int").cast("string"), F.lit("-"), _col(strikes).cast("int").cast("string"))


def count_state(balls: Column | str, strikes: Column | str) -> Column:
    """Six-way state of the count; the first rule that holds decides, unknown counts are even."""
    b, s = _col(balls), _col(strikes)
    return (
        F.when((b == 3) & (s == 2), "full_count")
        .when((s == 2) & (b < 3), "put_away_count")
        .when((b >= 2) & (s <= 1), "hitters_count")
        .when(s > b, "pitcher_ahead")
        .when(b > s, "pitcher_behind")
        .otherwise("even_count")
    )


def bucket(c: Column | str, known: list[str], other: str = "OTHER") -> Column:
    """Keep listed codes, fold every other one (and NULL) into one bucket."""
    return F.when(_col(c).isin(known), _col(c)).otherwise(F.lit(other))


def lookup(c: Column | str, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Constant map lookup; without a default, unknown codes give NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(c))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


# --- status of a replayed game ----------------------------------------------------------------
# fixed values: status texts of finished games, and the messages that tell outcomes apart
FINISHED = ["game over", "completed"]
NOT_READY = ["completed game was not found", "savant may not have published"]
NO_HISTORY = "No pre-game history exists."
FEW_GAMES = "At least two games are required."
TOO_LITTLE = ["no pre-game history", "at least two games are required", "no usable pitches remain"]


def _mentions(message: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | message.contains(phrase)
    return found


def is_final(status: Column | str) -> Column:
    s = F.lower(F.trim(_col(status)))
    return F.coalesce(s.contains("final") | s.isin(FINISHED), F.lit(False))


def outcome(error: Column | str) -> Column:
    """Name the outcome of a replay from the error message it left (NULL means it went through)."""
    message = F.lower(_col(error))
    return (
        F.when(_col(error).isNull(), "success")
        .when(_mentions(message, NOT_READY), "statcast_not_ready")
        .when(_mentions(message, TOO_LITTLE), "insufficient_history")
        .otherwise("failed")
    )


# --- rates ------------------------------------------------------------------------------------
def relative_improvement(model: Column | str, baseline: Column | str) -> Column:
    """(model - baseline) / baseline, NULL when there is no positive baseline to compare with."""
    m, b = _col(model).cast("double"), _col(baseline).cast("double")
    return F.when(b > 0, (m - b) / b)


def ratio(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def percent(c: Column | str, digits: int = 2) -> Column:
    return F.round(_col(c) * 100, digits)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hit_label(c: Column | str) -> Column:
    return F.when(is_true(c), "correct").otherwise("missed")


# --- recency ----------------------------------------------------------------------------------
def decay_factor(
    seasons: Column | str, start: float = 0.98, step: float = 0.01, floor: float = 0.80
) -> Column:
    """Per-season decay; longer careers decay faster. A career of no seasons is an input error."""
    n = _col(seasons)
    return F.when(n < 1, F.raise_error(F.lit("a career needs at least one season")).cast("double")).otherwise(
        F.greatest(F.lit(floor), F.lit(start) - F.lit(step) * (n - 1))
    )


def recency_weight(
    season: Column | str, reference: Column | str, decay: Column | str, minimum: float = 0.10
) -> Column:
    """decay ** seasons_ago, with later seasons than the reference counted as current."""
    ago = F.greatest(F.lit(0), _col(reference) - _col(season))
    return F.greatest(F.pow(_col(decay), ago), F.lit(minimum))


# --- deterministic hashing --------------------------------------------------------------------
def hash_int(seed: int, *parts: Column | str) -> Column:
    """Non-negative 60-bit integer from an md5 of the seed and the parts: the same on any engine
    that has md5, whatever the partitioning, so draws survive a lost executor."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed: int, *parts: Column | str) -> Column:
    """Uniform number in [0, 1) with six digits."""
    return (hash_int(seed, *parts) % F.lit(1_000_000)).cast("double") / F.lit(1_000_000.0)
