"""Plan shapes that must hold at any size."""

from pyspark.sql import functions as F

from netwarden.catalog import balance, detect, prepare
from netwarden.operators import clean, portscan
from netwarden.operators.neighbours import top_per
from netwarden.plans import standins

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_per_cuts_groups_before_the_shuffle(spark):
    df = top_per(standins.vectors(spark, FOLDER), ["x"], [F.col("id")], 4)
    assert plan(df).count("WindowGroupLimit") == 2


def test_no_nested_loops(spark):
    for build in (detect.t1, detect.t2(86400.0, 3), detect.t9, balance.r4, balance.q7, prepare.e5, prepare.c8):
        text = plan(build(spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(detect.t1(spark, FOLDER))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "event_type" not in schema and "props" not in schema and "ts" not in schema


def test_row_tests_stay_above_the_grouping(spark):
    text = plan(clean.clean(standins.dirty_flows(spark, FOLDER), standins.DIRTY_FEATURES))
    scan_side = text[text.rindex("HashAggregate"):]
    assert "+- Filter" not in scan_side


def test_scan_groups_hold_ports_not_packets(spark):
    """Every shuffle of the port-time table is preceded by a partial aggregate."""
    ports = portscan._port_times(portscan.tcp_only(standins.packets(spark, FOLDER)), 5_000_000)
    text = plan(ports)
    assert text.index("partial_min") > 0 and "partial_max" in text
