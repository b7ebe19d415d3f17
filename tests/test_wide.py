"""Work per row of the wide stages: windows carry structs, not every column, and inputs are made once."""

import re

from dugout import columns as C
from dugout.operators import sequence as Q
from dugout.plans import stages as P
from dugout.registry.logs import pitch_log

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def _windows(plan):
    if plan.nodeName() == "Window":
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _windows(children.apply(i))


def test_windows_of_the_stages_carry_few_columns(spark):
    built = P.build(pitch_log(spark, SF))
    for stage in (built.cleaned, built.kg2, built.kg3, built.kg4, built.rated):
        widths = [w.output().size() for w in _windows(_plan(stage))]
        assert widths and max(widths) < 50, widths


def test_rates_go_through_the_rows_before_once(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(["FF", None, "SL", "XX", "FF"])], "k int, o int, c string")
    out = Q.rolling_rates(rows, ["k"], ["o"], "c", ["FF", "SL", "OTHER"], "r_", hot=None)
    assert not re.search(r"avg\(", _plan(out).toString())
    got = [tuple(r) for r in out.orderBy("o").select("r_FF", "r_SL", "r_OTHER").collect()]
    assert got[0] == (None, None, None) and got[1] == (1.0, 0.0, 0.0)
    old = Q.add(rows.withColumn("b", Q.S.bucket("c", ["FF", "SL"], "OTHER")), ["k"], ["o"],
                [Q.rolling_mean(f"r_{c}", Q.F.col("b") == c, 3) for c in ("FF", "SL", "OTHER")], hot=None)
    assert got == [tuple(r) for r in old.orderBy("o").select("r_FF", "r_SL", "r_OTHER").collect()]


def test_structs_by_last_stage_hold_every_column_once():
    assert {P._tier(c) for c in C.KG4} == {4}
    assert {P._tier(c) for c in C.KG2_DROPPED} == {1} and {P._tier(c) for c in C.KG3_DROPPED} == {2}
