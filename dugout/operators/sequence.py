"""Sequence columns: values from earlier rows of the same key, in a given total order.

``add`` computes any number of measures in one pass. Ordinary keys use plain windows, all with one
specification, so the plan has one shuffle and one sort. Keys too big for a task are cut into
ordered chunks; each chunk is prefixed with what it needs from before it (the last few rows, and
the running totals so far), both taken from small aggregates. The two plans give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators.groups import CHUNK, HOT_ROWS, Hot, find_hot, in_order, with_chunks
from dugout.session import cut_lineage


@dataclass(frozen=True)
class Measure:
    out: str
    kind: str  # "lag", "mean" or "sum"
    value: Column
    rows: int = 1

    def over(self, w: Window, value: Column) -> Column:
        if self.kind == "lag":
            return F.lag(value, self.rows).over(w)
        if self.kind == "mean":
            return F.avg(value).over(w.rowsBetween(-self.rows, -1))
        return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lag(out: str, value: Column | str, rows: int = 1) -> Measure:
    """The value ``rows`` rows earlier."""
    return Measure(out, "lag", _c(value), rows)


def rolling_mean(out: str, value: Column | str, rows: int) -> Measure:
    """Mean over the ``rows`` rows before this one; NULL on the first row."""
    return Measure(out, "mean", _c(value).cast("double"), rows)


def running_sum(out: str, value: Column | str) -> Measure:
    """Sum up to and including this row."""
    return Measure(out, "sum", _c(value))


def row_number(out: str) -> Measure:
    return Measure(out, "sum", F.lit(1).cast("bigint"))


def add(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[Measure],
    hot: Hot | None | str = "auto",
    hot_rows: int = HOT_ROWS,
    reread: bool = False,
) -> DataFrame:
    """Append one column per measure.

    ``hot``: "auto" looks for oversized keys, None states that there are none (the caller has
    already checked a coarser key), or the result of ``find_hot`` for exactly these keys.
    ``reread``: the input is a stored table, so the chunked plan may scan it several times.
    """
    if hot == "auto":
        hot = find_hot(df, keys, hot_rows)
    if hot is None:
        w = in_order(keys, [F.col(c) for c in order])
        return df.select("*", *[m.over(w, m.value).alias(m.out) for m in measures])
    # the chunked plan reads its input several times; without a cut, a chain of operators would
    # recompute its beginning once per path through the chain
    return _add_chunked(df if reread else cut_lineage(df), keys, order, measures, hot)


def _add_chunked(
    df: DataFrame, keys: list[str], order: list[str], measures: list[Measure], hot: Hot
) -> DataFrame:
    names = {m.out: f"_v{i}" for i, m in enumerate(measures)}
    rows = with_chunks(df.select("*", *[m.value.alias(names[m.out]) for m in measures]), hot, order)
    near = [m for m in measures if m.kind != "sum"]
    sums = [m for m in measures if m.kind == "sum"]
    by_chunk = [*keys, CHUNK]
    rest = [c for c in order if c not in keys]
    parts = [rows.withColumn("_kind", F.lit(2))]

    if near:
        reach = max(m.rows for m in near)
        # The rows just before each chunk, from the ends of the chunks before it. Ends are cut per
        # map task before the shuffle; what remains is `reach` rows per chunk.
        back = Window.partitionBy(*by_chunk).orderBy(*[F.col(c).desc() for c in order])
        ends = (
            rows.filter("_hot")
            .select(*keys, *rest, CHUNK, *[names[m.out] for m in near])
            .withColumn("_r", F.row_number().over(back))
            .filter(F.col("_r") <= reach)
            .drop("_r")
        )
        # A short chunk may reach further back than one chunk: hand ends on up to `reach` chunks,
        # then keep the nearest ones.
        handed = ends.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn(
            CHUNK, F.col(CHUNK) + F.col("_step")
        )
        handed = (
            handed.withColumn("_r", F.row_number().over(back))
            .filter(F.col("_r") <= reach)
            .drop("_r", "_step")
            .withColumn("_kind", F.lit(1))
        )
        parts.append(handed)

    if sums:
        totals = (
            rows.filter("_hot").groupBy(*by_chunk).agg(*[F.sum(names[m.out]).alias(names[m.out]) for m in sums])
        )
        so_far = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
        parts.append(
            totals.select(
                *keys,
                (F.col(CHUNK) + 1).alias(CHUNK),
                *[F.sum(names[m.out]).over(so_far).alias(names[m.out]) for m in sums],
                F.lit(0).alias("_kind"),
            )
        )

    stretched = parts[0]
    for p in parts[1:]:
        stretched = stretched.unionByName(p, allowMissingColumns=True)
    w = in_order(by_chunk, [F.col("_kind"), *[F.col(c) for c in order]])
    done = stretched.select("*", *[m.over(w, F.col(names[m.out])).alias(m.out) for m in measures])
    return done.filter(F.col("_kind") == 2).drop("_kind", "_hot", CHUNK, *names.values())


# --- named operators --------------------------------------------------------------------------
def previous_values(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], suffix: str = "_of_prev_pitch", **kw
) -> DataFrame:
    """Value of each column on the previous row of the key."""
    return add(df, keys, order, [lag(f"{c}{suffix}", c) for c in columns], **kw)


def renumber(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str, **kw
) -> DataFrame:
    """Running count of rows on which ``starts`` holds; rows before the first one get 0."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return add(df, keys, order, [running_sum(out, flag)], **kw)


def rolling_rates(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    label: Column | str,
    classes: list[str],
    prefix: str,
    rows: int = 3,
    **kw,
) -> DataFrame:
    """Share of each class among the previous ``rows`` rows. The last class takes unlisted labels.

    The codes of the rows before are fetched once and every share is counted from them: a window of
    its own per class would go through these rows once more for each.
    """
    near = [f"_code{i}" for i in range(1, rows + 1)]
    codes = df.withColumn("_code", S.bucket(label, classes[:-1], classes[-1]))
    seen = add(codes, keys, order, [lag(c, "_code", i) for i, c in enumerate(near, 1)], **kw)
    one, none = F.lit(1.0), F.lit(0.0)
    known = sum((F.when(F.col(c).isNotNull(), one).otherwise(none) for c in near), none)
    shares = {
        f"{prefix}{c}": F.try_divide(sum((F.when(F.col(n) == c, one).otherwise(none) for n in near), none), known)
        for c in classes
    }
    return seen.withColumns(shares).drop("_code", *near)


def previous_group_results(
    df: DataFrame,
    keys: list[str],
    group: str,
    order: list[str],
    columns: list[str],
    suffix: str = "_of_prev_ab",
    hot: Hot | None | str = "auto",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Last non-NULL value of each column within the previous group of the key.

    ``group`` numbers consecutive runs of rows in ``order`` (see ``renumber``). With ordinary keys
    this is three windows over one partitioning, no join: carry the last value forward within the
    group, take it from the row before, and spread the group's first such value over the group.
    """
    if hot == "auto":
        hot = find_hot(df, keys, hot_rows)
    if hot is not None:
        return _previous_group_results_joined(cut_lineage(df), keys, group, order, columns, suffix, hot.rows)
    by = [F.col(c) for c in order]
    inside = in_order([*keys, group], by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # groups follow each other in `order`, so leading with the group changes nothing but lets all
    # three windows share one sort
    whole = in_order(keys, [F.col(group), *by])
    seen = df.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_in_{c}") for c in columns])
    before = seen.select("*", *[F.lag(f"_in_{c}").over(whole).alias(f"_pre_{c}") for c in columns])
    spread = before.select("*", *[F.first(f"_pre_{c}").over(inside).alias(f"{c}{suffix}") for c in columns])
    return spread.drop(*[f"_in_{c}" for c in columns], *[f"_pre_{c}" for c in columns])


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], also: list[Column] = ()
) -> DataFrame:
    """One row per key with the last non-NULL value of each column (NULL when it never has one)."""
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns], *also
    )


def _previous_group_results_joined(df, keys, group, order, columns, suffix, hot_rows) -> DataFrame:
    """Same result for keys beyond one task: aggregate groups, shift the small table, join back."""
    ends = last_known(df, [*keys, group], order, columns)
    shifted = add(ends, keys, [group], [lag(f"{c}{suffix}", c) for c in columns], hot_rows=hot_rows)
    return df.join(shifted.drop(*columns), [*keys, group], "left")


def prior_meetings(
    df: DataFrame,
    keys: list[str],
    other: str,
    groups: list[str],
    order: list[str],
    out: str,
    date: str = "game_date",
    hot: Hot | None | str = "auto",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """How many groups (plate appearances) of the key met the same other party before this one.

    ``groups`` identify a plate appearance within the key and, after its date, order them. The
    party of an appearance is the one on its first row in ``order``.
    """
    if hot == "auto":
        hot = find_hot(df, keys, hot_rows)
    by = [F.col(c) for c in order]
    if hot is None:
        first = in_order([*keys, *groups], by)
        marked = df.select("*", F.first(other).over(first).alias("_party"), F.first(date).over(first).alias("_day"))
        met = in_order([*keys, "_party"], [F.col("_day"), *[F.col(g) for g in groups]])
        return marked.select("*", (F.dense_rank().over(met) - 1).cast("bigint").alias(out)).drop("_party", "_day")
    df = cut_lineage(df)
    at = F.struct(*by)
    meetings = df.groupBy(*keys, *groups).agg(
        F.min_by(other, at).alias("_party"), F.min_by(date, at).alias("_day")
    )
    counted = add(meetings, [*keys, "_party"], ["_day", *groups], [row_number(out)], hot_rows=hot.rows)
    counted = counted.select(*keys, *groups, (F.col(out) - 1).cast("bigint").alias(out))
    return df.join(counted, [*keys, *groups], "left")


# --- one row per key --------------------------------------------------------------------------
def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key. The rank filter is applied per map task before the shuffle, so a
    key with very many copies sends few rows."""
    return _keep_one(df, keys, [_c(o).desc_nulls_last() for o in order])


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return _keep_one(df, keys, [_c(o).asc_nulls_last() for o in order])


def _keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")
