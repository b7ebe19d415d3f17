"""Chunked windows must equal plain ones, and both must equal a loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from dugout.operators import sequence as Q
from dugout.operators.groups import find_hot, with_chunks

def measures():
    return [
        Q.lag("back1", "v"), Q.lag("back2", "v", 2), Q.rolling_mean("mean3", "v", 3), Q.running_sum("total", "v"),
        Q.row_number("n"),
    ]


def make_rows(n, keys, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if rnd.random() < 0.05 else (0 if rnd.random() < 0.5 else rnd.randrange(keys))
        rows.append((key, rnd.randrange(n), i, None if rnd.random() < 0.1 else rnd.randrange(100)))
    return rows


def by_loop(rows):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]))
        values = [r[3] for r in group]
        for i, r in enumerate(group):
            near = [v for v in values[max(0, i - 3):i] if v is not None]
            known = [v for v in values[: i + 1] if v is not None]
            out[r[2]] = (
                values[i - 1] if i >= 1 else None,
                values[i - 2] if i >= 2 else None,
                sum(near) / len(near) if near else None,
                sum(known) if known else None,
                i + 1,
            )
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 200, 20, 3])
def test_add_equals_loop(spark, hot_rows):
    rows = make_rows(1500, 6)
    df = spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(5)
    got = Q.add(df, ["k"], ["t", "id"], measures(), hot_rows=hot_rows)
    assert got.columns == ["k", "t", "id", "v", "back1", "back2", "mean3", "total", "n"]
    have = {r.id: (r.back1, r.back2, r.mean3, r.total, r.n) for r in got.collect()}
    want = by_loop(rows)
    assert have.keys() == want.keys()
    for i, (a, b, m, t, n) in want.items():
        assert have[i][0:2] == (a, b) and have[i][3:] == (t, n)
        assert have[i][2] == pytest.approx(m) if m is not None else have[i][2] is None


def test_one_key_is_cut_into_even_chunks(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    hot = find_hot(df, ["k"], 1000)
    assert (hot.n_keys, hot.n_chunks) == (1, 20)
    sizes = [r["count"] for r in with_chunks(df, hot, ["t"]).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 and sum(sizes) == 20000
    edges = with_chunks(df, hot, ["t"]).groupBy("_chunk").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in edges.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_small_input_needs_no_job(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert find_hot(df, ["k"]) is None


@pytest.mark.parametrize("hot_rows", [10**9, 5])
def test_previous_group_results(spark, hot_rows):
    # group 1 ends with a NULL after a known value; group 2 knows nothing; group 3 follows it
    rows = [("p", 1, 1, "single"), ("p", 1, 2, None), ("p", 2, 3, None), ("p", 3, 4, "walk"), ("p", 3, 5, "out"),
            ("p", 4, 6, None), ("q", 1, 7, "hr"), ("q", 2, 8, None)]
    df = spark.createDataFrame(rows, "k string, g int, t int, r string")
    out = Q.previous_group_results(df, ["k"], "g", ["t"], ["r"], "_prev", hot_rows=hot_rows)
    have = {r.t: r.r_prev for r in out.collect()}
    assert have == {1: None, 2: None, 3: "single", 4: None, 5: None, 6: "out", 7: None, 8: "hr"}


@pytest.mark.parametrize("hot_rows", [10**9, 5])
def test_prior_meetings_counts_groups_not_rows(spark, hot_rows):
    # appearance 2 starts with batter b although a row of it names a
    rows = [("p", "d1", 1, 1, "a"), ("p", "d1", 1, 2, "a"), ("p", "d1", 2, 3, "b"), ("p", "d1", 2, 4, "a"),
            ("p", "d2", 1, 5, "a"), ("p", "d2", 2, 6, "b"), ("q", "d2", 1, 7, "a")]
    df = spark.createDataFrame(rows, "k string, day string, g int, t int, b string")
    out = Q.prior_meetings(df, ["k"], "b", ["day", "g"], ["t"], "met", date="day", hot_rows=hot_rows)
    assert {r.t: r.met for r in out.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0}


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (2, None, "d")], "k int, t int, v string")
    assert {r.k: r.v for r in Q.keep_last(df, ["k"], ["t"]).collect()} == {1: "b", 2: "c"}
    assert {r.k: r.v for r in Q.keep_first(df, ["k"], ["t"]).collect()} == {1: "a", 2: "c"}


def test_keep_one_cuts_groups_before_the_shuffle(spark):
    df = spark.range(10000).select((F.col("id") % 2).alias("k"), "id")
    plan = Q.keep_last(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_windows_over_one_key_share_one_shuffle(spark, sf):
    from dugout.plans import stages
    from dugout.registry.logs import pitch_log

    plan = stages.build(pitch_log(spark, sf)).kg4._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
