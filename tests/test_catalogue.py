"""Every query against its SQL on the smallest tables, and the shape of the plans."""

import glob
import os

import duckdb
import pytest

from contrail.catalogue import CATALOGUE
from contrail.catalogue.base import telemetry
from contrail.check import compare
from contrail.plans import timeline
from contrail.plans.rules.common import Telemetry
from contrail.plans.rules.registry import run_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")

# one rule of each kind of ordered work
ORDERED_RULES = ["EKF_INNOV_VEL", "EKF_LANE_SWITCH", "GPS_SAT_COUNT_DROP", "BAT_VOLTAGE_SAG", "BAT_BROWNOUT", "BAT_CURRENT_SPIKE",
                 "BAT_HIGH_R_INT", "IMU_CLIPPING", "MOTOR_IMBALANCE", "MOTOR_OUTPUT_DROP", "FAILSAFE_VERIFY"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_sql(spark, con, name):
    q = CATALOGUE[name]
    df = q.run(spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    rows = df.collect()
    if q.sql is not None:
        cur = con.execute(q.sql)
        assert compare((df.columns, rows), ([d[0] for d in cur.description], cur.fetchall())) is None
    else:
        assert rows


@pytest.mark.parametrize("name,exchanges", [
    ("sustained_violation", 1), ("fused_threshold_rules", 1), ("tolerant_groups", 1), ("step_drop", 1), ("rolling_zscore", 1),
    ("nearest_join", 1), ("interp_join", 1), ("rule_vibe_high_rms", 1), ("rule_ekf_innov_vel", 1), ("instant_violation", 0), ("keyword_claims", 0),
])
def test_shuffles_once_and_stays_in_the_jvm(spark, name, exchanges):
    text = plan(CATALOGUE[name].run(spark, SF))
    assert text.count("Exchange hashpartitioning") == exchanges
    assert "Python" not in text and "InPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(CATALOGUE["instant_violation"].run(spark, SF))
    assert "GreaterThan(value,200" in text and "props" not in text.split("ReadSchema")[1]


def test_rank_limit_is_applied_before_the_shuffle(spark):
    text = plan(CATALOGUE["first_rows_per_key"].run(spark, SF))
    assert text.index("WindowGroupLimit") and "Partial" in text.split("Exchange hashpartitioning")[1]


def test_rules_and_phases_do_not_depend_on_blocks(spark):
    t = telemetry(spark, SF, "type")
    names = [n for n in t._raw]
    fixed = {n: t.table(n).cache() for n in names}
    outs = []
    for limit in (10**9, 60):
        s = Telemetry(spark, fixed, limit)
        found = run_rules(s, ORDERED_RULES).select("flight_id", "rule_name", "severity", "timestamp_us", "end_timestamp_us", "channel", "description")
        events = timeline.timeline(s).select("flight_id", "timestamp_us", "event_type", "severity", "description")
        spans = timeline.phases(s)
        outs.append([sorted(map(repr, d.collect())) for d in (found, events, spans)])
    assert all(outs[0]) and outs[0] == outs[1]
