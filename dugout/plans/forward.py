"""A fitted forest for every date of every pitcher, from one pass over the log.

A backtest needs, for each date, a model of the rows before it. Refitting reads the log once per date.
Here a pitcher's rows are binned and packed once, in order of date, and each tree grows for all dates
together: a node holds, per date, the running sums of the histograms of its rows (``trees``), so the best
split of every date follows from one scan of the node's rows. Dates that agree on a split share its
children; dates that differ go on with rows of their own. The weight of a row depends on the date of the
model only through its season and class, so histograms are counted per season and weighted after the
running sum, with the factors that ``backtest.date_weights`` derives for all dates at once.

The models are those that ``trees.fit_each`` would grow per date from the same bins: the same bootstrap
(a hash of row and tree), inputs tried and tie rules. A pitcher of more than ``trees.BLOCK`` rows does not
fit the scheme; ``replay`` refits such pitchers by date, where growth is spread over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from dugout.operators import weights as W
from dugout.operators.groups import settled
from dugout.plans import backtest as R
from dugout.plans import learning as L
from dugout.plans import trees as T
from dugout.session import cut_lineage, release, scratch_path, stored

SHARE = 1 << 40  # class shares are summed in these units, so that sums are exact in any order
CELLS = 1 << 22  # of the histograms of a node and some dates at once


class History:
    """The rows of one pitcher in order of date, and the dates to be modelled."""

    def __init__(self, block: T.Block, day: np.ndarray, season: np.ndarray, targets: list[tuple[int, list]], classes: int) -> None:
        order = np.argsort(day, kind="stable")
        self.block = T.Block(block.codes[order], block.label[order], block.weight[order], block.row[order])
        self.order, self.day = order, day[order]
        self.targets = np.array([d for d, _ in targets], np.int64)
        # the first target date that has a row in its past
        self.slot = np.searchsorted(self.targets, self.day, side="right")
        self.seasons, at = np.unique(season[order], return_inverse=True)
        self.season = at
        self.factors = np.ones((len(targets), len(self.seasons), classes))
        self.units = np.zeros((len(targets), len(self.seasons), classes))
        for t, (_, factors) in enumerate(targets):
            for s in factors:
                k = np.searchsorted(self.seasons, s["season"])
                if k < len(self.seasons) and self.seasons[k] == s["season"]:
                    self.factors[t, k] = s["factor"]
                    self.units[t, k] = np.round(self.factors[t, k] * T.UNIT)

    def totals(self, rows: np.ndarray, times: np.ndarray, dates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per date the weight of each class, with the factors as they are, and the number of rows."""
        n_seasons, classes = self.units.shape[1:]
        first = np.searchsorted(dates, self.slot[rows])
        live = first < len(dates)
        rows, times, first = rows[live], times[live], first[live]
        at = (first * n_seasons + self.season[rows]) * classes + self.block.label[rows]
        drawn = np.bincount(at, times, len(dates) * n_seasons * classes).reshape(len(dates), n_seasons, classes).cumsum(axis=0)
        # totals are rounded as those of ``backtest.walk_forward``, so that equal ones are equal
        return np.round((drawn * self.factors[dates]).sum(axis=1), 12), np.bincount(first, minlength=len(dates)).cumsum()


def node_histograms(past: History, rows: np.ndarray, times: np.ndarray, dates: np.ndarray, tried: np.ndarray, spec: T.Spec) -> tuple[np.ndarray, np.ndarray]:
    """dates x slots x ranks of bins x (classes + 1), and the bin of each rank, as ``trees.best_of`` takes
    them, for rows in order of date."""
    slots, n_seasons = len(tried), len(past.seasons)
    first = np.searchsorted(dates, past.slot[rows])  # the first of the dates that counts the row
    live = first < len(dates)
    rows, times, first = rows[live], times[live], first[live]
    ranks, of = T.compact(past.block.codes[rows][:, tried], np.zeros(len(rows), np.int64), 1, spec.bins)
    label, season = past.block.label[rows], past.season[rows]
    shape = (len(dates), slots, of.shape[2], spec.classes + 1)
    within = (np.arange(slots)[None, :] * of.shape[2] + ranks) * (spec.classes + 1)
    each = int(np.prod(shape[1:]))
    span = len(dates) - first
    if span.sum() <= n_seasons * len(dates) * of.shape[2] * spec.classes:  # few rows: each is added to every date that counts it
        row = np.repeat(np.arange(len(rows)), span)
        date = np.arange(len(row)) - np.repeat(span.cumsum() - span - first, span)
        cell = date[:, None] * each + within[row]
        hist = np.bincount((cell + label[row][:, None]).ravel(), np.repeat(times[row] * past.units[dates[date], season[row], label[row]], slots), len(dates) * each)
        hist += np.bincount((cell + spec.classes).ravel(), minlength=len(dates) * each)
        return hist.reshape(shape), of
    cell = (first * n_seasons + season)[:, None] * each + within
    full = (len(dates), n_seasons, *shape[1:])
    size = int(np.prod(full))
    drawn = np.bincount((cell + label[:, None]).ravel(), np.repeat(times, slots), size).reshape(full)[..., :-1].cumsum(axis=0)
    number = np.bincount((cell + spec.classes).ravel(), minlength=size).reshape(full)[..., -1].sum(axis=1).cumsum(axis=0)
    weighted = np.einsum("dsfbc,dsc->dfbc", drawn, past.units[dates])
    return np.concatenate([weighted, number[..., None]], axis=3), of


def forward_trees(past: History, key: str, tree: int, spec: T.Spec) -> Iterator[tuple[int, T.Tree]]:
    """(target, tree) for every target date with rows before it."""
    rows, units = past.block.drawn(tree, spec)
    times = units / T.UNIT  # packed with weight 1: how often the bootstrap takes each row
    out = {t: T.Tree() for t in range(len(past.targets))}
    level = [(1, rows, times, np.arange(len(past.targets)))]
    for depth in range(spec.depth + 1):
        following = []
        for node, rows, times, dates in level:
            dates = dates[dates >= past.slot[rows[0]]] if len(rows) else dates[:0]  # others have no row here yet
            if not len(dates):
                continue
            weights, number = past.totals(rows, times, dates)
            feature, bin_ = np.full(len(dates), -1), np.full(len(dates), -1)
            gain = np.zeros(len(dates))
            # dates that may split; for all others the node is a leaf whatever its histograms say
            wanted = np.flatnonzero((number >= spec.min_split) & ((weights > 0).sum(axis=1) > 1)) if depth < spec.depth else dates[:0]
            if len(wanted):
                tried = T.tried_inputs(key, tree, np.array([node]), spec)
                each = len(past.seasons) * tried.shape[1] * spec.bins * (spec.classes + 1)
                step = max(1, CELLS // each)
                for k in range(0, len(wanted), step):
                    some = wanted[k : k + step]
                    # rows before the first of these dates are all in its sums
                    hist, of = node_histograms(past, rows, times, dates[some], tried[0], spec)
                    found = T.best_of(hist, np.repeat(tried, len(some), axis=0), np.repeat(of, len(some), axis=0), spec)
                    feature[some], bin_[some], gain[some] = found[0], found[1], found[4]
            for i, t in enumerate(dates):
                out[int(t)].add(np.array([node]), feature[i : i + 1], bin_[i : i + 1], weights[i : i + 1], number[i : i + 1], gain[i : i + 1])
            for f, b in sorted({(int(f), int(b)) for f, b in zip(feature, bin_) if f >= 0}):
                mine = dates[(feature == f) & (bin_ == b)]
                right = past.block.codes[rows, f] > b
                known = past.slot[rows] <= mine[-1]
                for side, child in ((~right & known, 2 * node), (right & known, 2 * node + 1)):
                    following.append((child, rows[side], times[side], mine))
        level = sorted(following, key=lambda x: x[0])
    return iter(out.items())


def shares(past: History, key: str, numbers: range, spec: T.Spec) -> np.ndarray:
    """Class shares of each row from the model of its date, summed over some trees, in ``SHARE`` units."""
    total = np.zeros((len(past.day), spec.classes), np.int64)
    for number in numbers:
        for t, tree in forward_trees(past, key, number, spec):
            rows = np.flatnonzero(past.day == past.targets[t])
            if not tree.node or not len(rows):
                continue
            order = np.argsort(tree.node)  # nodes of a date come by level, dates that differ apart
            node, feature, bin_ = (np.array(x)[order] for x in (tree.node, tree.feature, tree.bin))
            weights = np.array(tree.weights, float)[order]
            at = T.reached(past.block.codes[rows], node, feature, bin_)
            total[rows] += np.round(weights / weights.sum(axis=1, keepdims=True) * SHARE).astype(np.int64)[at]
    return total


def shares_together(pasts: list[tuple[str, History, range]], spec: T.Spec) -> list[np.ndarray]:
    """``shares`` of many short histories: every tree of every date has its own copies of the rows before
    it, and all grow at once."""
    row, unit, weight, exact, base, asked, at = [], [], [], [], [], [], 0
    for key, past, numbers in pasts:
        n = len(past.targets)
        target = np.minimum(np.searchsorted(past.targets, past.day), max(0, n - 1))
        on = np.flatnonzero(past.targets[target] == past.day) if n else np.zeros(0, np.int64)
        for k, tree in enumerate(numbers):
            drawn, units = past.block.drawn(tree, spec)
            slot = past.slot[drawn]
            span = n - slot
            mine = np.repeat(drawn, span)
            date = np.arange(len(mine)) - np.repeat(span.cumsum() - span - slot, span)
            times, where = np.repeat(units / T.UNIT, span), (date, past.season[mine], past.block.label[mine])
            row.append(mine + at)
            unit.append(date + len(base))
            weight.append(times * past.units[where])
            exact.append(times * past.factors[where])
            asked.append((k, on + at, target[on] + len(base)))
            base.extend([T._number(spec.seed, "node", key, tree)] * n)
        at += len(past.day)
    codes, label = (np.concatenate([getattr(p.block, c) for _, p, _ in pasts]) for c in ("codes", "label"))
    found = T.grown_together(codes, label, *map(np.concatenate, (row, unit, weight)), np.array(base, np.uint64), spec, np.concatenate(exact))
    share = np.round(found.weights / found.weights.sum(axis=1, keepdims=True) * SHARE).astype(np.int64)
    total = np.zeros((at, spec.classes), np.int64)
    for k in {k for k, *_ in asked}:  # a row has one tree of each number
        rows, of = (np.concatenate([x[i] for x in asked if x[0] == k]) for i in (1, 2))
        leaf = found.reached(codes[rows], of)
        total[rows[leaf >= 0]] += share[leaf[leaf >= 0]]
    return np.split(total, np.cumsum([len(p.day) for _, p, _ in pasts])[:-1])


def _packed(rows: DataFrame, names: R.Log, classes: list[str], bins: T.Bins) -> DataFrame:
    """One row per pitcher: its binned rows, their dates and seasons, and ``_row`` of each as it came."""
    key, inputs = names.key, [*bins.cuts, *bins.categories]
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(names.label)), F.lit(0))
    ready = rows.select(
        key, *[F.col(f"`{c}`") for c in inputs], (place - 1).cast("int").alias("_class"), F.unix_date(names.date).alias("_day"),
        F.year(names.date).alias("_season"), F.xxhash64(*names.row_id).alias("_rid"), "_row")

    ready = T.coded(ready, bins)

    def pack(table: pa.Table) -> pa.Table:
        number = lambda c, t: pa.array([table.column(c).to_numpy().astype(t).tobytes()], pa.binary())
        whole = table.column("_row").combine_chunks()
        whole = pa.StructArray.from_arrays(whole.flatten(), fields=[f.with_nullable(True) for f in whole.type])
        return pa.table({
            key: table.column(key).slice(0, 1), "codes": pa.array([b"".join(table.column("codes").to_pylist())], pa.binary()), "label": number("_class", np.int32),
            "day": number("_day", np.int32), "season": number("_season", np.int32), "row": number("_rid", np.int64),
            "rows": pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)})

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["_row"].dataType)
    kind = dict(rows.dtypes)[key]
    return ready.groupBy(key).applyInArrow(
        pack, f"`{key}` {kind}, codes binary, label binary, day binary, season binary, row binary, rows array<struct<{fields}>>")


def _one_pass(packed: DataFrame, targets: DataFrame, names: R.Log, spec: T.Spec) -> DataFrame:
    """(_row, _shares) of every row; one on no target date of its pitcher has no shares.

    A pitcher's rows travel with it and come back from the task that knows their shares. Only where its trees
    take several tasks, whose shares have to be added, rows are joined by their place.
    """
    key, groups = names.key, -(-spec.trees // T.GROUP)
    listed = T._spread(targets.select(F.col(key).alias("_of"), "day", "factors"), "_of").groupBy("_of").agg(
        F.sort_array(F.collect_list(F.struct("day", "factors"))).alias("targets"))
    listed = listed.hint("merge")  # few bytes as stored, many as rows: not to be broadcast by its size
    whole = groups == 1
    if whole:
        spread = T._spread(packed, key).join(listed, F.col(key) == F.col("_of"), "left").drop("_of").withColumn("_group", F.lit(0))
    else:
        joined = packed.drop("rows").join(listed, F.col(key) == F.col("_of")).drop("_of")
        spread = T._spread(joined.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), key, "_group")

    def told(batch: pa.RecordBatch, some: list[tuple], sums: list[np.ndarray]) -> pa.RecordBatch:
        at = pa.array([i for i, *_ in some], pa.int32())
        if whole:
            length = pc.list_value_length(batch.column("rows")).to_pylist()
            size = [len(past.day) if past else length[i] for i, _, past, _ in some]
            starts = np.cumsum([0, *size[:-1]])
            total, none = np.zeros((sum(size), spec.classes), np.int64), np.ones(sum(size), bool)
            for (_, _, past, _), start, own in zip(some, starts, sums):
                if past:
                    total[start + past.order] = own
                    none[start + past.order[np.isin(past.day, past.targets)]] = False
            ends = pa.array(np.arange(len(total) + 1) * spec.classes, pa.int32())
            shares = pa.ListArray.from_arrays(ends, pa.array(total.ravel()), mask=pa.array(none))
            return pa.RecordBatch.from_arrays([batch.column("rows").take(at).flatten(), shares], names=["_row", "_shares"])
        on = [np.flatnonzero(np.isin(past.day, past.targets)) for _, _, past, _ in some]
        total = np.concatenate([s[i] for s, i in zip(sums, on)])
        ends = pa.array(np.arange(len(total) + 1) * spec.classes, pa.int32())
        keys = batch.column(key).take(at).take(pa.array(np.repeat(np.arange(len(some)), [len(i) for i in on])))
        places = np.concatenate([past.order[i] for (_, _, past, _), i in zip(some, on)])
        return pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=[key, "place", "shares"])

    def together(batch: pa.RecordBatch, some: list[tuple]) -> pa.RecordBatch:
        return told(batch, some, shares_together([(str(k), past, numbers) for _, k, past, numbers in some], spec))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            about = batch.select([c for c in batch.schema.names if c != "rows"])
            some, size, alone = [], 0, []
            for i, row in enumerate(about.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["targets"] is None:  # no model on any date
                    alone.append((i, row[key], None, None))
                    continue
                label = np.frombuffer(row["label"], np.int32).astype(np.int64)
                block = T.Block(np.frombuffer(row["codes"], np.uint8).reshape(len(label), -1), np.maximum(label, 0),
                                np.where(label >= 0, T.UNIT, 0), np.frombuffer(row["row"], np.uint64))
                past = History(block, np.frombuffer(row["day"], np.int32), np.frombuffer(row["season"], np.int32),
                               [(t["day"], t["factors"] or []) for t in row["targets"]], spec.classes)
                numbers = range(row["_group"] * T.GROUP, min(spec.trees, (row["_group"] + 1) * T.GROUP))
                copies = int((len(past.targets) - past.slot).sum()) * len(numbers)
                if copies > T.TOGETHER:  # a long history: its dates share what they have in common
                    yield told(batch, [(i, row[key], past, numbers)], [shares(past, str(row[key]), numbers, spec)])
                    continue
                some.append((i, row[key], past, numbers))
                size += copies + len(label)
                if size >= T.TOGETHER:
                    yield together(batch, some)
                    some, size = [], 0
            if some:
                yield together(batch, some)
            if alone:
                yield told(batch, alone, [None] * len(alone))

    # rows of many pitchers come in one batch
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", T.BATCH)
    if whole:
        return spread.mapInArrow(work, StructType().add("_row", packed.schema["rows"].dataType.elementType).add("_shares", ArrayType(LongType())))
    found = spread.mapInArrow(work, f"`{key}` {dict(packed.dtypes)[key]}, place int, shares array<bigint>")
    summed = found.select(key, "place", *[F.col("shares")[k].alias(f"_s{k}") for k in range(spec.classes)]).groupBy(key, "place").agg(
        *[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(spec.classes)])
    called = summed.select(F.col(key).alias("_of"), "place", F.array(*[F.col(f"_s{k}") for k in range(spec.classes)]).alias("_shares"))
    placed = packed.select(F.col(key).alias("_key"), F.posexplode("rows").alias("_place", "_row"))
    return placed.join(called, (F.col("_key") == F.col("_of")) & (F.col("_place") == F.col("place")), "left").select("_row", "_shares")


def replay(
    log: DataFrame,
    cols: L.Columns,
    forest: L.Forest = L.Forest(),
    names: R.Log = R.PITCHES,
    bins: T.Bins | None = None,
    recency: W.Recency | None = W.MILD,
    rules: W.Rules | None = W.CONTINUOUS,
    min_games: int = 2,
    most: int = T.BLOCK,
) -> DataFrame:
    """Every row with the prediction of its pitcher's forest of all earlier dates.

    Adds ``model_prediction``, ``probabilities`` and ``model_confidence``; rows before ``min_games``
    earlier games have NULLs. Rows of equal ``names.row_id`` share their bootstrap draws. ``bins``: taken from the whole log
    unless given; they place cuts and know no class, but a strict backtest gives bins of an early part.
    """
    spark = log.sparkSession
    rows_at = scratch_path(spark, "forward-rows")
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("_row")
    used = dict.fromkeys([names.key, names.game, names.date, names.label, *names.row_id, *cols.all])
    # the log is computed once; columns that are no inputs are read out of the stored row
    rows = stored(L.impute_constants(log.select(row, *[F.col(f"`{c}`") for c in cols.all]), cols), rows_at)
    log = rows.select("_row.*")
    rows = rows.select("_row", *[F.col(f"`{c}`") if c in cols.all else F.col(f"_row.`{c}`").alias(c) for c in used])
    classes = sorted(r[0] for r in log.select(names.label).distinct().collect() if r[0] is not None)
    bins = bins or T.bins_of(rows, cols.numeric, cols.text, forest.max_bins)
    n = len(bins.inputs)
    spec = T.Spec(forest.trees, forest.depth, forest.min_leaf, forest.min_split, min(n, T.tried_of(forest.features, n)), n, bins.size, len(classes),
                  forest.bootstrap, forest.seed)
    weights = R.date_weights(log.filter(F.col(names.label).isNotNull()), classes, names, recency, rules)
    targets = weights.filter(F.col("prior_games") >= min_games).select(names.key, names.date, F.unix_date(names.date).alias("day"), "factors")
    targets = stored(targets, scratch_path(spark, "forward-targets"))
    large = cut_lineage(rows.groupBy(F.col(names.key).alias("_large")).count().filter(F.col("count") > most).select("_large"))
    small = rows.join(settled(large), F.col(names.key) == F.col("_large"), "left_anti")
    packed = stored(_packed(small, names, classes, bins), scratch_path(spark, "forward-packed"))
    told = _one_pass(packed, targets, names, spec)
    if not large.isEmpty():
        told = told.unionByName(_by_date(rows, large, targets, cols, forest, names, classes, bins, recency, rules))
    release(spark, rows_at)
    labels = F.array(*[F.lit(c) for c in classes])
    total = F.aggregate("_shares", F.lit(0).cast("bigint"), lambda a, x: a + x)
    told = told.withColumn("_p", F.when(total > 0, F.transform("_shares", lambda s: s / total)))
    spot = F.array_position(F.transform("_p", lambda x: F.round(x, T.DIGITS)), F.round(F.array_max("_p"), T.DIGITS)).cast("int")
    known = F.col("_p").isNotNull()
    return told.select(
        "_row.*", F.when(known, F.element_at(labels, spot)).alias("model_prediction"),
        F.when(known, F.map_from_arrays(labels, "_p")).alias("probabilities"), F.array_max("_p").alias("model_confidence"))


def _by_date(rows, large, targets, cols, forest, names, classes, bins, recency, rules) -> DataFrame:
    """The same for very long histories: a fit per date, spread over blocks."""
    mine = cut_lineage(rows.join(settled(large), F.col(names.key) == F.col("_large"), "left_semi"))
    dated = targets.join(settled(large), F.col(names.key) == F.col("_large"), "left_semi")
    # rows of no target date
    parts = [mine.join(settled(dated.select(names.key, names.date)), [names.key, names.date], "left_anti")
             .select("_row", F.lit(None).cast("array<bigint>").alias("_shares"))]
    for day in [r[0] for r in dated.select(names.date).distinct().orderBy(names.date).collect()]:
        today = dated.filter(F.col(names.date) == F.lit(day)).select(names.key, F.col(names.date).alias("target_date"))
        history = R.before(mine, today, names).filter(F.col(names.label).isNotNull()).withColumn("_season", F.year(names.date))
        weighted = W.training_weights(history, names.key, names.label, "_target_season", rules, recency, "_season")
        fitted = T.fit_each(weighted, names.key, names.label, "weight", cols.numeric, cols.text, forest, list(names.row_id), bins=bins)
        rows_today = mine.filter(F.col(names.date) == F.lit(day)).join(settled(today.select(names.key)), names.key, "left_semi")
        out = T.predict_each(fitted, rows_today.withColumnRenamed("_row", "_whole"), lambda df: df)
        share = F.array(*[F.coalesce(F.round(F.try_element_at("probabilities", F.lit(c)) * SHARE).cast("bigint"), F.lit(0).cast("bigint")) for c in classes])
        parts.append(cut_lineage(out.select(F.col("_whole").alias("_row"), share.alias("_shares"))))
    return L.comparison(parts)


def walk_forward(log: DataFrame, cols: L.Columns, forest: L.Forest = L.Forest(), names: R.Log = R.PITCHES, seed: int = 42, **kw) -> DataFrame:
    """``replay`` beside the stratified baseline of the earlier dates, as ``backtest.walk_forward`` has it,
    with each row marked right or wrong."""
    base = R.walk_forward(log, names, recency=None, rules=None, min_games=kw.get("min_games", 2), seed=seed)
    base = base.select(*[F.col(f"`{c}`") for c in log.columns], "baseline_prediction", "error")
    return R.mark(replay(base, cols, forest, names, **kw), names)
