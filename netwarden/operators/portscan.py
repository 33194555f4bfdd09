"""Distinct destination ports of a source in a trailing window.

A trailing window of length W seen from time t covers the part of t's own W-long time slice
up to t, and the tail of the slice before. For each port it is therefore enough to know its
first time in the own slice and its last time in the slice before. Packets are reduced to
these two times per (source, slice, port) - at most 65,536 rows per source and slice, with
map-side aggregation - so no task ever holds the packets of a busy source. The number of
distinct ports is then a step function of time:

* it starts a slice at the number of ports seen in the slice before,
* rises when a port is seen first (unless it is still counted from before),
* falls when a port of the slice before leaves the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.plans.scale import lookup, stage

# Alert above this many distinct ports within this many seconds.
SCAN_PORTS = 10
SCAN_SECONDS = 5.0
TCP = 6
SCAN_LABEL = "Port Scan"

# Distinct event times of one source are ranked within cells of this length, which bounds
# a window group by the clock resolution (one million microseconds).
CELL_US = 1_000_000


def _port_times(packets: DataFrame, width: int) -> DataFrame:
    """Per source, slice and port: first and last time in the slice, last time in the one before."""
    own = packets.groupBy(
        "src_ip", F.expr(f"ts_us div {width}").alias("slice"), F.col("dst_port").alias("port")
    ).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("rows")
    )
    both = own.select(
        "src_ip", "slice", "port", "first_us", F.lit(None).cast("long").alias("before_us"), "rows"
    ).unionByName(
        own.select(
            "src_ip",
            (F.col("slice") + 1).alias("slice"),
            "port",
            F.lit(None).cast("long").alias("first_us"),
            F.col("last_us").alias("before_us"),
            F.lit(0).cast("long").alias("rows"),
        )
    )
    return both.groupBy("src_ip", "slice", "port").agg(
        F.max("first_us").alias("first_us"), F.max("before_us").alias("before_us"), F.sum("rows").alias("rows")
    )


def _candidates(ports: DataFrame, threshold: int) -> DataFrame:
    """Slices whose ports, own and carried, could exceed the threshold at all."""
    return (
        ports.groupBy("src_ip", "slice")
        .agg(
            F.count(F.lit(1)).alias("reachable"),
            F.count("before_us").alias("base"),
            F.sum("rows").alias("rows"),
        )
        .where((F.col("reachable") > threshold) & (F.col("rows") > 0))
        .select("src_ip", "slice", "base", "rows")
    )


def scan_times(packets: DataFrame, seconds: float = SCAN_SECONDS, threshold: int = SCAN_PORTS) -> DataFrame:
    """``(src_ip, ts_us, n_ports, rows)`` for every source and time with more ports than the threshold.

    ``packets`` needs ``src_ip, ts_us, dst_port`` and holds TCP packets only.
    """
    width = int(round(seconds * 1_000_000))
    ports = _port_times(packets, width)
    hot = stage(_candidates(ports, threshold), "slices")
    live = ports.join(hot.select("src_ip", "slice"), ["src_ip", "slice"])
    gone = F.col("before_us") + width + 1
    stays = F.col("before_us").isNotNull() & F.col("first_us").isNotNull() & (F.col("first_us") < gone)
    steps = live.select(
        "src_ip",
        "slice",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("first_us").isNotNull() & ~stays,
                        F.struct(F.col("first_us").alias("at"), F.lit(1).cast("long").alias("step")),
                    ),
                    F.when(
                        F.col("before_us").isNotNull() & ~stays,
                        F.struct(gone.alias("at"), F.lit(-1).cast("long").alias("step")),
                    ),
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("s"),
    ).select("src_ip", "slice", F.col("s.at").alias("ts_us"), F.col("s.step").alias("step"), F.lit(0).cast("long").alias("rows"))
    events = (
        lookup(
            packets.select("src_ip", F.expr(f"ts_us div {width}").alias("slice"), "ts_us"),
            hot.select("src_ip", "slice", "rows"),
            ["src_ip", "slice"],
            "rows",
        )
        .groupBy("src_ip", "slice", "ts_us")
        .agg(F.lit(0).cast("long").alias("step"), F.count(F.lit(1)).alias("rows"))
    )
    points = (
        steps.unionByName(events)
        .groupBy("src_ip", "slice", "ts_us")
        .agg(F.sum("step").alias("step"), F.sum("rows").alias("rows"))
        .withColumn("cell", F.expr(f"ts_us div {CELL_US}"))
    )
    carried = (
        points.groupBy("src_ip", "slice", "cell")
        .agg(F.sum("step").alias("cell_step"))
        .withColumn(
            "carry",
            F.coalesce(
                F.sum("cell_step").over(
                    Window.partitionBy("src_ip", "slice")
                    .orderBy("cell")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("cell_step")
        .join(hot.drop("rows"), ["src_ip", "slice"])
    )
    inside = Window.partitionBy("src_ip", "slice", "cell").orderBy("ts_us")
    return (
        points.withColumn("run", F.sum("step").over(inside))
        .join(carried, ["src_ip", "slice", "cell"])
        .withColumn("n_ports", F.col("base") + F.col("carry") + F.col("run"))
        .where((F.col("rows") > 0) & (F.col("n_ports") > threshold))
        .select("src_ip", "ts_us", "n_ports", "rows")
    )


def tcp_only(packets: DataFrame) -> DataFrame:
    return packets.where(
        (F.col("proto") == TCP) & F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()
    )


def scan_alerts(packets: DataFrame, seconds: float = SCAN_SECONDS, threshold: int = SCAN_PORTS) -> DataFrame:
    """The TCP packets that arrive while their source is over the threshold, with ``n_ports``."""
    tcp = tcp_only(packets)
    times = stage(scan_times(tcp, seconds, threshold), "scans")
    return lookup(tcp, times, ["src_ip", "ts_us"], "rows")


# Parts of a slice in which alert times meet ports, so that a busy slice is not one task's work.
SET_PARTS = 64


def scan_port_sets(packets: DataFrame, seconds: float = SCAN_SECONDS, threshold: int = SCAN_PORTS) -> DataFrame:
    """One row per source and alert time with the sorted ports in its window.

    A port is in the window from its first time in the slice on, and up to its last time in the slice
    before plus the window. It is sent only to those parts of a slice whose alert times meet one
    of these two intervals.
    """
    width = int(round(seconds * 1_000_000))
    tcp = tcp_only(packets)
    times = stage(
        scan_times(tcp, seconds, threshold)
        .withColumn("slice", F.expr(f"ts_us div {width}"))
        .withColumn("part", F.floor((F.col("ts_us") - F.col("slice") * width) / F.lit(width / SET_PARTS)).cast("int")),
        "alert_times",
    )
    # At most ``SET_PARTS`` spans of alert times per slice.
    spans = (
        times.groupBy("src_ip", "slice", "part")
        .agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
        .groupBy("src_ip", "slice")
        .agg(F.collect_list(F.struct("part", "lo", "hi")).alias("spans"))
    )
    met = F.filter(
        "spans",
        lambda s: F.coalesce(F.col("first_us") <= s["hi"], F.lit(False))
        | F.coalesce(F.col("before_us") >= s["lo"] - width, F.lit(False)),
    )
    # At most 65,536 ports per source and slice, so the list of a part is bounded.
    known = (
        _port_times(tcp, width)
        .join(spans, ["src_ip", "slice"])
        .select("src_ip", "slice", "port", "first_us", "before_us", F.explode(met).alias("span"))
        .groupBy("src_ip", "slice", "span.part")
        .agg(F.collect_list(F.struct("port", "first_us", "before_us")).alias("known"))
    )
    in_window = F.filter(
        "known",
        lambda p: (p["first_us"] <= F.col("ts_us")) | (p["before_us"] >= F.col("ts_us") - width),
    )
    return (
        times.join(known, ["src_ip", "slice", "part"])
        .withColumn("ports", F.array_sort(F.transform(in_window, lambda p: p["port"])))
        .select("src_ip", "ts_us", "n_ports", "ports")
    )


# Buckets of a port sketch, as a power of two: a relative error of about 0.8 / sqrt(2 ** bits).
SKETCH_BITS = 12


def port_sketches(packets: DataFrame, length: str, bits: int = SKETCH_BITS) -> DataFrame:
    """``src_ip, start, sketch, n_packets``: a mergeable sketch of the ports per source and tumbling window."""
    frame = F.window("ts", length)
    return (
        packets.groupBy("src_ip", frame.alias("w"))
        .agg(F.hll_sketch_agg("dst_port", F.lit(bits)).alias("sketch"), F.count(F.lit(1)).alias("n_packets"))
        .select("src_ip", F.col("w.start").alias("start"), "sketch", "n_packets")
    )


def merged_ports(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct ports of stored sketches, merged over all rows that share ``by``."""
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_ports"), F.sum("n_packets").alias("n_packets")
    )


def windowed_ports(packets: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Distinct ports per source and tumbling or sliding window (batch or stream).

    The set of ports of a window has at most 65,536 members and is merged before the shuffle.
    """
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        packets.groupBy("src_ip", frame.alias("w"))
        .agg(F.size(F.collect_set("dst_port")).cast("long").alias("n_ports"), F.count(F.lit(1)).alias("n_packets"))
        .select("src_ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ports", "n_packets")
    )
