"""A day's batch through the stage chain without the careers behind it.

Most of a stage row depends on its own game. Two things reach back over a career: how often pitcher and
batter met, and the usage rates over the last three pitches. ``Carry`` keeps what they need, per pitcher
and date: the last pitch types of the date, and the plate appearances against each batter. A batch that
replaces a pitcher's rows from a date on (the overlap of a refresh, with corrections and lost rows) is
built from its own rows and the carry of the dates before; both are small beside the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.groups import HOT_ROWS, settled
from dugout.plans import stages as P
from dugout.session import cut_lineage

ROWS = 3  # of the rolling rates
_PA = ["pitcher", "game_pk", "at_bat_number_of_game"]
_ORDER = ["game_date", "game_pk", "at_bat_number_of_game", "pitch_number_of_ab", P.CARRIED]


@dataclass(frozen=True)
class Carry:
    """tails: pitcher, game_date, tail (its last pitch types of the date, in order);
    meetings: pitcher, party, game_date, appearances."""

    tails: DataFrame
    meetings: DataFrame

    def write(self, root: str) -> None:
        self.tails.write.parquet(f"{root}/tails")
        self.meetings.write.parquet(f"{root}/meetings")

    @staticmethod
    def read(spark, root: str) -> Carry:
        return Carry(spark.read.parquet(f"{root}/tails"), spark.read.parquet(f"{root}/meetings"))


def carry(kg2: DataFrame) -> Carry:
    """What later batches need of these rows (a KG2 stage with its carried order column)."""
    at = F.struct(*[F.col(c) for c in _ORDER[1:]], "pitch_type")
    # a pitcher throws some hundred pitches on a date, so a date is one short array
    day = kg2.groupBy("pitcher", "game_date").agg(F.sort_array(F.collect_list(at)).alias("_p"))
    last = F.slice("_p", F.greatest(F.size("_p") - ROWS + 1, F.lit(1)), ROWS)
    tails = day.select("pitcher", "game_date", F.transform(last, lambda p: p["pitch_type"]).alias("tail"))
    first = F.struct("game_date", P.first_of_pa().alias("_first"), "pitch_number_of_ab", P.CARRIED)
    appearances = kg2.groupBy(*_PA).agg(F.min_by("batter", first).alias("party"), F.min("game_date").alias("game_date"))
    meetings = appearances.groupBy("pitcher", "party", "game_date").agg(F.count(F.lit(1)).alias("appearances"))
    return Carry(tails, meetings)


def whole_games(log: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to build again and the date from which they are, for ``cuts`` (pitcher, cut).

    A game whose rows lie on both sides of a cut moves the cut to its first row, until none does; games
    that last over a date are rare, so this ends after a look or two.
    """
    spans = cut_lineage(log.join(settled(cuts), "pitcher", "left_semi").groupBy("pitcher", "game_pk").agg(
        F.min("game_date").alias("first"), F.max("game_date").alias("last")))
    while True:
        earlier = spans.join(cuts, "pitcher").filter((F.col("first") < F.col("cut")) & (F.col("last") >= F.col("cut")))
        moved = cut_lineage(earlier.groupBy("pitcher").agg(F.min("first").alias("_moved")))
        if moved.isEmpty():
            break
        cuts = cut_lineage(cuts.join(moved, "pitcher", "left").select("pitcher", F.least("cut", "_moved").alias("cut")))
    rows = log.join(settled(cuts), "pitcher").filter(F.col("game_date") >= F.col("cut")).drop("cut")
    return rows, cuts


def extend(batch: DataFrame, cuts: DataFrame, before: Carry, hot_rows: int = HOT_ROWS) -> P.Stages:
    """Stages of a batch: the raw rows from each pitcher's cut on (``whole_games``)."""
    cleaned = P.clean(batch, hot_rows=hot_rows)
    two = P.kg2(cleaned, hot_rows=hot_rows)
    cut = settled(cuts)
    met = before.meetings.join(cut, "pitcher").filter(F.col("game_date") < F.col("cut"))
    met = met.groupBy(F.col("pitcher").alias("_of"), F.col("party").alias("_with")).agg(F.sum("appearances").alias("_met"))
    by_pitch = Window.partitionBy(*_PA).orderBy("game_date", P.first_of_pa(), "pitch_number_of_ab", P.CARRIED)
    party = two.withColumn("_party", F.first("batter").over(by_pitch))
    counted = party.join(settled(met), (F.col("pitcher") == F.col("_of")) & F.col("_party").eqNullSafe(F.col("_with")), "left")
    total = F.col("prior_pa_vs_pitcher_career") + F.coalesce("_met", F.lit(0))
    two = cut_lineage(counted.withColumn("prior_pa_vs_pitcher_career", total.cast(two.schema["prior_pa_vs_pitcher_career"].dataType))
                      .select(*[F.col(f"`{c}`") for c in two.columns]))
    # the last pitches before the cut stand in front of the batch as rows that are dropped afterwards
    latest = Window.partitionBy("pitcher").orderBy(F.col("game_date").desc())
    tails = before.tails.join(cut, "pitcher").filter(F.col("game_date") < F.col("cut")).withColumn("_rank", F.row_number().over(latest))
    tails = tails.filter(F.col("_rank") <= ROWS).groupBy("pitcher", "cut").agg(F.sort_array(F.collect_list(F.struct("game_date", "tail"))).alias("_t"))
    types = F.flatten(F.transform("_t", lambda t: t["tail"]))
    tails = tails.select("pitcher", "cut", F.posexplode(types).alias("_place", "pitch_type"))
    number = {"game_pk": F.lit(0), "at_bat_number_of_game": F.lit(0), "pitch_number_of_ab": F.col("_place"), P.CARRIED: F.lit(-1)}
    kinds = dict(two.dtypes)
    stubs = tails.select(
        "pitcher", "pitch_type", F.date_sub("cut", 1).cast(kinds["game_date"]).alias("game_date"),
        *[v.cast(kinds[c]).alias(c) for c, v in number.items()], F.lit(True).alias("_stub"))
    stretched = two.withColumn("_stub", F.lit(False)).unionByName(stubs, allowMissingColumns=True)
    three = P.kg3(stretched.drop("_stub"), hot_rows=hot_rows).filter(F.col(P.CARRIED) >= 0)
    return P.Stages(cleaned, two, three, P.kg4(three))


def merged(stored: DataFrame, batch: DataFrame, cuts: DataFrame) -> DataFrame:
    """A stored stage (or part of the carry) with a batch in place of its rows from the cuts on."""
    kept = stored.join(settled(cuts), "pitcher", "left").filter(F.col("cut").isNull() | (F.col("game_date") < F.col("cut"))).drop("cut")
    return kept.unionByName(batch)


def carried_on(before: Carry, stages: P.Stages, cuts: DataFrame) -> Carry:
    """The carry after a batch."""
    new = carry(stages.kg2)
    return Carry(merged(before.tails, new.tails, cuts), merged(before.meetings, new.meetings, cuts))
