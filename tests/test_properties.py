"""Properties that hold for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrail.operators import runs
from contrail.operators.series import open_series

SERIES = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 30), st.integers(0, 9)), min_size=1, max_size=40)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    clock, out = {}, []
    for i, (k, dt, v) in enumerate(rows):
        clock[k] = clock.get(k, 0) + dt
        out.append((k, clock[k], i, float(v)))
    return spark.createDataFrame(out, "k string, t long, s long, v double")


@FEW
@given(SERIES, st.integers(3, 12))
def test_groups_do_not_depend_on_order_or_blocks(spark, rows, limit):
    df = frame(spark, rows)
    check = [runs.Check("c", F.col("v") > 3, F.col("v"), 2, 2)]
    whole = runs.violation_groups(open_series(df, ["k"], ["t", "s"], 10**9), check).collect()
    cut = runs.violation_groups(open_series(df.orderBy(F.rand()).repartition(5), ["k"], ["t", "s"], limit), check).collect()
    assert sorted(whole) == sorted(cut)


@FEW
@given(SERIES, st.integers(1, 40))
def test_spaced_events_are_apart_and_maximal(spark, rows, gap):
    df = frame(spark, rows)
    kept = {}
    for r in runs.spaced_events(open_series(df, ["k"], ["t", "s"]), gap).collect():
        kept.setdefault(r.k, []).append(r.t)
    for k in kept:
        kept[k].sort()
        assert all(b - a > gap for a, b in zip(kept[k], kept[k][1:]))
    for r in df.collect():  # every event is kept or within the gap after a kept one
        assert any(0 <= r.t - t <= gap for t in kept[r.k])
