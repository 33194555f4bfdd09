"""Batch and stream agree over several micro-batches, out of order, with late rows and a restart."""

import random

from pyspark.sql import functions as F

from netwarden.catalog.streams import ROCKS, STATE_PROVIDER
from netwarden.operators import cooldown, portscan
from netwarden.streaming import detectors, sources

S = 1_000_000
COLUMNS = "packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, tcp_flags int, ttl int, packet_length int, payload binary"


def rows(seed, n=300, span=100):
    rng = random.Random(seed)
    times = sorted(rng.randrange(span * S) for _ in range(n))
    return [
        (i, t, "busy" if rng.random() < 0.5 else f"s{i % 3}", "d", 1, rng.randrange(20), 6 if i % 4 else 17, 0, 64, 60, b"x")
        for i, t in enumerate(times)
    ]


def frame(spark, data):
    df = spark.createDataFrame(data, COLUMNS.replace("ts timestamp", "ts long"))
    return df.withColumn("ts", F.timestamp_micros("ts"))


def write(spark, data, folder, name):
    """One file per call, so that the stream sees it as one micro-batch."""
    frame(spark, data).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def replay(spark, folder, build, batches, restart=False):
    """Feed the batches one after the other; optionally stop and restart in between."""
    spark.conf.set(STATE_PROVIDER, ROCKS)
    out, progress, seen = f"{folder}/out", f"{folder}/progress", f"{folder}/in"

    def start():
        stream = build(sources.packet_files(spark, f"{seen}/*"))
        return (
            stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).start(out)
        ), stream.schema

    for i, data in enumerate(batches):
        write(spark, data, seen, f"b{i}")
        if restart or i == len(batches) - 1:
            query, schema = start()
            query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def closing(at):
    """A late-dated packet of another source that moves the watermark past everything."""
    return [(10**6, at, "end", "d", 1, 1, 17, 0, 64, 60, b"x")]


def shuffled(data, seed, window=10):
    """Out of order by a few places."""
    rng = random.Random(seed)
    return sorted(data, key=lambda r: r[0] + rng.random() * window)


def test_cooldown_stream_equals_batch(spark, tmp_path):
    data = rows(1)
    mixed = shuffled(data, 2)
    parts = [mixed[:100], mixed[100:200], mixed[200:], closing(400 * S)]
    got = replay(
        spark, str(tmp_path), lambda p: detectors.cooldown_stream(detectors.facts(p), 5.0, "30 seconds"), parts, restart=True
    )
    batch = frame(spark, data).withColumn("ts_us", F.unix_micros("ts"))
    want = {r["packet_id"] for r in cooldown.kept_ids(batch, 5.0).collect()}
    assert {r["packet_id"] for r in got.collect()} - {10**6} == want


def test_scan_stream_equals_batch(spark, tmp_path):
    data = rows(3)
    mixed = shuffled(data, 4)
    parts = [mixed[:150], mixed[150:], closing(400 * S)]
    got = replay(
        spark, str(tmp_path), lambda p: detectors.scan_stream(detectors.facts(p), 5.0, "30 seconds"), parts, restart=True
    )
    over = {r["packet_id"]: r["n_ports"] for r in got.collect() if r["n_ports"] > 5 and r["proto"] == 6}
    batch = frame(spark, data).withColumn("ts_us", F.unix_micros("ts"))
    want = {r["packet_id"]: r["n_ports"] for r in portscan.scan_alerts(batch, 5.0, 5).collect()}
    assert over == want and want


def test_packets_without_port_or_source(spark, tmp_path):
    """Missing ports and sources neither count nor disturb the packets beside them."""
    data = rows(5)
    holes = [(1000 + i, t, "busy", "d", 1, None, None if i % 2 else 6, 0, 64, 60, b"x") for i, t in enumerate(range(S, 90 * S, 9 * S))]
    holes += [(2000, 50 * S, None, "d", 1, 3, 6, 0, 64, 60, b"x")]
    parts = [[*data[:150], *holes], data[150:], closing(400 * S)]
    got = replay(spark, str(tmp_path), lambda p: detectors.scan_stream(detectors.facts(p), 5.0, "100 seconds"), parts)
    found = {r["packet_id"]: r["n_ports"] for r in got.collect()}
    batch = frame(spark, [*data, *holes]).withColumn("ts_us", F.unix_micros("ts"))
    want = {r["packet_id"]: r["n_ports"] for r in portscan.scan_alerts(batch, 5.0, 5).collect()}
    assert want and {k: found[k] for k in want} == want and found[2000] == 0
    assert {r[0] for r in [*data, *holes]} - set(found) == set()


def test_late_packets_are_dropped(spark, tmp_path):
    early = [(0, 100 * S, "a", "d", 1, 1, 6, 0, 64, 60, b"x")]
    late = [(1, 1 * S, "a", "d", 1, 1, 6, 0, 64, 60, b"x")]
    parts = [early, late, closing(400 * S)]
    got = replay(
        spark, str(tmp_path), lambda p: detectors.cooldown_stream(detectors.facts(p), 5.0, "1 second"), parts, restart=True
    )
    assert {r["packet_id"] for r in got.collect()} - {10**6} == {0}


def test_late_rows_are_told(spark, tmp_path):
    """What lies behind the watermark of the first file is counted exactly."""
    spark.conf.set(STATE_PROVIDER, ROCKS)
    folder, late = str(tmp_path), 0
    lots = [
        [(i, (100 + i) * S, "a", "d", 1, 1, 6, 0, 64, 60, b"x") for i in range(5)],
        [(10 + i, (90 + 3 * i) * S, "a", "d", 1, 1, 6, 0, 64, 60, b"x") for i in range(6)],
    ]
    for i, data in enumerate(lots):
        write(spark, data, f"{folder}/in", f"b{i}")
        stream = detectors.cooldown_stream(detectors.facts(sources.packet_files(spark, f"{folder}/in/*")), 5.0, "2 seconds")
        query = (
            stream.writeStream.option("checkpointLocation", f"{folder}/p").trigger(availableNow=True).start(f"{folder}/out")
        )
        query.awaitTermination()
        late += detectors.late_rows(query)
    # The watermark after the first file is 102 s: 90, 93, 96, 99 and 102 are not above it.
    assert late == 5


def test_gate_holds_only_what_it_may_still_keep():
    """Pieces are written once, read when due, and packets inside a final cooldown are not held."""
    import pandas as pd

    class Cell:
        def __init__(self):
            self.held = {}

        def exists(self):
            return () in self.held

        def get(self):
            return self.held.get(())

        def update(self, value):
            self.held[()] = value

        def clear(self):
            self.held.clear()

        def keys(self):
            return list(self.held)

        def getValue(self, key):
            return self.held[key]

        def updateValue(self, key, value):
            assert key not in self.held
            self.held[key] = value

        def removeKey(self, key):
            del self.held[key]

    class Handle:
        def __init__(self):
            self.timers = set()

        def getMapState(self, *_):
            return Cell()

        getValueState = getMapState

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def packets(times):
        return pd.DataFrame(
            {"packet_id": times, "ts_us": [t * S for t in times], "dst_ip": "d", "proto": 6, "signed": False, "flagged": False}
        )

    handle, gate = Handle(), detectors.CooldownGate(10 * S)
    gate.init(handle)
    gate.handleInputRows(("a",), iter([packets([3, 1, 12]), packets([2, 30])]), None)
    assert handle.timers == {1000}
    handle.timers.clear()
    out = [r for f in gate.handleExpiredTimer(("a",), Clock(15_000), None) for r in f["packet_id"]]
    assert out == [1, 12] and handle.timers == {30_000} and len(gate.waiting.pieces.held) == 1
    gate.handleInputRows(("a",), iter([packets([16, 20, 21])]), None)
    assert len(gate.waiting.pieces.held) == 1 and handle.timers == {30_000}
    handle.timers.clear()
    out = [r for f in gate.handleExpiredTimer(("a",), Clock(100_000), None) for r in f["packet_id"]]
    assert out == [30] and not handle.timers and not gate.waiting.pieces.held and not gate.last.held


def test_replayed_batch_writes_once(spark, tmp_path):
    from netwarden.sources.alert_logs import append_alerts, append_batch, read_alerts

    alerts = spark.createDataFrame([("t", "s", "d", "6", "x")], "timestamp string, source_ip string, destination_ip string, protocol string, attack_type string")
    write_batch = append_batch(str(tmp_path / "log"))
    for batch_id in (0, 1, 1):
        write_batch(alerts, batch_id)
    assert read_alerts(spark, str(tmp_path / "log")).count() == 2
    append_alerts(alerts.withColumn("timestamp", F.lit("2024-01-02 03:04:05")), str(tmp_path / "log"))
    assert read_alerts(spark, str(tmp_path / "log")).count() == 3


class Held:
    """State of one key, in memory."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def clear(self):
        self.held.clear()

    def keys(self):
        return list(self.held)

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        assert key not in self.held
        self.held[key] = value
        self.writes += 1

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Held()

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def waiting_rows(times, first=0, **more):
    import pandas as pd

    n = len(times)
    return pd.DataFrame(
        {"packet_id": range(first, first + n), "ts_us": times, "dst_ip": "d", "proto": 6, "signed": False, "flagged": False, "counted": True, **more}
    )


def test_quiet_keys_wait_in_few_pieces():
    """50 packets in 50 stretches are one piece; a busy stretch still has a piece of its own."""
    waiting = detectors.Waiting(Handle(), S)
    waiting.add(waiting_rows([i * S for i in range(50)][::-1]))
    assert waiting.pieces.writes == 1
    waiting.add(waiting_rows([i * S + j for i in (3, 4) for j in range(100)], 100))
    assert waiting.pieces.writes == 3
    out, done = [], 0
    for done in (3 * S + 10, 4 * S + 1, 20 * S, 100 * S):
        times = [t for part in waiting.ready(done) for t in part["ts_us"]]
        assert times == sorted(times) and all(t <= done for t in times)
        left = {t for k in waiting.pieces.keys() for t in detectors._unpacked([waiting.pieces.getValue(k)], waiting.schema)["ts_us"]}
        assert not left if waiting.next is None else done < waiting.next <= min(left)
        out += times
    assert sorted(out) == sorted([i * S for i in range(50)] + [i * S + j for i in (3, 4) for j in range(100)])


def test_sources_of_one_scan_key_are_counted_apart():
    """Many sources share a key; each has its own ports, also over more batches than pieces are kept."""

    class Clock:
        def __init__(self, us):
            self.us = us

        def getCurrentWatermarkInMs(self):
            return self.us // 1000

    rng = random.Random(11)
    rows = [(f"s{rng.randrange(5)}", rng.randrange(20 * S), rng.randrange(6)) for _ in range(400)]
    counter = detectors.ScanCounter(10 * S)
    counter.init(Handle())
    own = {}
    for i in range(0, 400, 20):
        part = rows[i : i + 20]
        frame = waiting_rows([t for _, t, _ in part], i, src_ip=[s for s, _, _ in part]).drop(columns="counted")
        frame = frame.assign(dst_port=[p for _, _, p in part], look_back=[t < 10 * S for _, t, _ in part])
        own |= {i + j: r for j, r in enumerate(part) if r[1] >= 10 * S}
        counter.handleInputRows((0, 1), iter([frame[:7], frame[7:]]), None)
    got = {}
    for done in (11 * S, 12 * S, 40 * S):
        for part in counter.handleExpiredTimer((0, 1), Clock(done), None):
            got |= dict(zip(part["packet_id"], part["n_ports"]))
        assert len(counter.seen.held) <= 1
    assert got == {
        i: len({p for s, t, p in rows if s == source and at - 10 * S <= t <= at}) for i, (source, at, _) in own.items()
    }


def test_packets_without_a_time_do_not_disturb_the_gate():
    gate, handle = detectors.CooldownGate(10 * S), Handle()
    gate.init(handle)
    rows = waiting_rows([None, 5 * S, None, 70 * S]).drop(columns="counted")
    gate.handleInputRows(("a",), iter([rows, rows[:1]]), None)
    assert handle.timers == {5000} and gate.waiting.pieces.writes == 1

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 100_000

    assert [i for f in gate.handleExpiredTimer(("a",), Clock(), None) for i in f["packet_id"]] == [1, 3]
