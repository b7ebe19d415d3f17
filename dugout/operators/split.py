"""Splitting a log into train and test rows by game, never by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import scalar as S
from dugout.operators import sequence as Q
from dugout.operators.groups import HOT_ROWS, find_hot, kept_once, settled
from dugout.session import cut_lineage


def games(df: DataFrame, key: str, game: str, date: str) -> DataFrame:
    """First date of each game of the key."""
    known = df.filter(F.col(game).isNotNull() & F.col(date).isNotNull())
    return known.groupBy(key, game).agg(F.min(date).alias("first_date"))


def game_order(df: DataFrame, key: str, game: str, date: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Games numbered chronologically per key (date, then game id), with the key's total."""
    per_game = kept_once(games(df, key, game, date))
    hot = find_hot(per_game, [key], hot_rows)
    if hot is None:  # rank and total from one partitioning
        total = F.count(F.lit(1)).over(Window.partitionBy(key))
        ranked = Q.add(per_game, [key], ["first_date", game], [Q.row_number("game_rank")], hot=None)
        return ranked.withColumn("career_games", total)
    ranked = Q.add(per_game, [key], ["first_date", game], [Q.row_number("game_rank")], hot)
    return ranked.join(per_game.groupBy(key).agg(F.count(F.lit(1)).alias("career_games")), key)


def test_games(n: str, fraction: float):
    """Number of test games: the rounded-up fraction, at least one, leaving at least one to train."""
    share = F.ceil(F.col(n) * F.lit(float(fraction)))
    return F.least(F.greatest(F.lit(1), share), F.col(n) - 1)


def chronological_games(
    df: DataFrame, key: str, game: str, date: str, fraction: float = 0.20, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each game with ``is_test``: the last games of a key are its test set. Keys with a single
    game cannot be split; they keep NULL and appear in ``unsplittable``."""
    ordered = game_order(df, key, game, date, hot_rows)
    flag = F.col("game_rank") > F.col("career_games") - test_games("career_games", fraction)
    return ordered.withColumn("is_test", F.when(F.col("career_games") >= 2, flag))


def unsplittable(split_games: DataFrame, key: str) -> DataFrame:
    return (
        split_games.filter(F.col("is_test").isNull())
        .select(key).distinct()
        .withColumn("error", F.lit(S.FEW_GAMES))
    )


def chronological_split(
    df: DataFrame, key: str, game: str, date: str, fraction: float = 0.20, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of splittable keys, with ``is_test``."""
    flags = chronological_games(df, key, game, date, fraction, hot_rows).filter(F.col("is_test").isNotNull())
    return df.join(flags.select(key, game, "is_test"), [key, game])


def hash_split(df: DataFrame, group: list[str], fraction: float = 0.20, seed: int = 42) -> DataFrame:
    """Random split by group. No shuffle: the side of a group is a function of its id."""
    return df.withColumn("is_test", S.hash_unit(seed, *group) < F.lit(float(fraction)))


def group_folds(df: DataFrame, group: list[str], folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number of each row; all rows of a group share it."""
    return df.withColumn(out, (S.hash_int(seed, *group) % folds).cast("int"))


def greedy_shares(classes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, last rank + 1, fold): how many groups of each size the greedy rule gives each
    fold. The rule takes groups from the largest to the smallest, each into the fold with the fewest rows
    so far (of equals the first). ``classes``: (size, number of groups of this size).

    Groups of one size go where a fold's load before them is least, so their numbers follow from one
    threshold on that load; it is found by bisection, whatever the number of groups.
    """
    loads, out = [0] * folds, []
    for size, groups in sorted(classes, reverse=True):
        upto = lambda level: [max(0, (level - load) // size + 1) for load in loads]  # noqa: B023, E731 - loads of groups up to `level`
        low, high = min(loads) - 1, max(loads) + size * groups
        while high - low > 1:  # the lowest level at which all groups have a place
            middle = (low + high) // 2
            low, high = (low, middle) if sum(upto(middle)) >= groups else (middle, high)
        taken = upto(high - 1)
        for i in range(folds):  # of loads at the level itself the first folds
            if sum(taken) < groups and loads[i] <= high and (high - loads[i]) % size == 0:
                taken[i] += 1
        first = 0
        for i, n in enumerate(taken):
            if n:
                out.append((size, first, first + n, i))
            first, loads[i] = first + n, loads[i] + n * size
    return out


def balanced_folds(df: DataFrame, group: list[str], folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number of each row, folds as equal in rows as the greedy rule makes them (``greedy_shares``);
    all rows of a group share a fold. Which groups of one size go together is decided by hash.

    What reaches the driver is a row per distinct group size, of which there are few: sizes that are all
    different add up. Ranks within a size are counted in hash buckets, so no size is gathered in a task.
    """
    spark = df.sparkSession
    names = [f"_g{i}" for i in range(len(group))]
    sizes = df.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(F.count(F.lit(1)).alias("_size"))
    draw = S.hash_int(seed, *names)
    sizes = cut_lineage(sizes.withColumns({"_draw": draw, "_bucket": F.shiftright(draw, 50)}))
    buckets = sizes.groupBy("_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select(F.col("_size").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    classes = [(r[0], r[1]) for r in sizes.groupBy("_size").count().collect()]
    shares = spark.createDataFrame(greedy_shares(classes, folds) or [(0, 0, 0, 0)], "_of bigint, _from bigint, _to bigint, _fold int")
    within = F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("_draw", *names)) - 1
    ranked = sizes.withColumn("_within", within).join(settled(starts), (F.col("_size") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rank = F.col("_before") + F.col("_within")
    placed = ranked.join(F.broadcast(shares), (F.col("_size") == F.col("_of")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    placed = placed.select(*names, F.col("_fold").alias(out))
    on = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]
    return df.join(settled(placed), on).drop(*names)


def sample_entities(df: DataFrame, key: str, n: int, seed: int, evaluated: DataFrame | None = None) -> DataFrame:
    """Seeded sample of ``n`` distinct entities; with ``evaluated`` given, failed ones drop out and
    the next in line take their place."""
    pool = df.select(key).filter(F.col(key).isNotNull()).distinct()
    if evaluated is not None:
        pool = pool.join(evaluated.select(key).distinct(), key, "left_semi")
    draw = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")))
    return pool.withColumn("draw", draw).orderBy("draw", key).limit(n)
