"""Boundary rows and brute-force comparisons for the detectors."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from netwarden.operators import cooldown, portscan, signatures, verdict

S = 1_000_000


def packets(spark, rows):
    """Rows of (src_ip, ts_us, dst_port)."""
    data = [(i, src, ts, port, 6) for i, (src, ts, port) in enumerate(rows)]
    return spark.createDataFrame(data, "packet_id long, src_ip string, ts_us long, dst_port int, proto int")


def brute_scan(rows, width, threshold):
    out = {}
    for i, (src, ts, _) in enumerate(rows):
        ports = {p for s, t, p in rows if s == src and ts - width <= t <= ts}
        if len(ports) > threshold:
            out[i] = len(ports)
    return out


def brute_cooldown(rows, width):
    by = defaultdict(list)
    for i, (src, ts, _) in enumerate(rows):
        by[src].append((ts, i))
    kept = set()
    for events in by.values():
        last = None
        for ts, i in sorted(events):
            if last is None or ts - last >= width:
                kept.add(i)
                last = ts
    return kept


def found_scan(spark, rows, seconds=5.0, threshold=10):
    out = portscan.scan_alerts(packets(spark, rows), seconds, threshold).collect()
    return {r["packet_id"]: r["n_ports"] for r in out}


def found_cooldown(spark, rows, seconds=5.0):
    return {r["packet_id"] for r in cooldown.kept_ids(packets(spark, rows), seconds).collect()}


def mixed(seed, n=600, span=120):
    """Half of the packets come from one busy source; times repeat."""
    rng = random.Random(seed)
    return [
        ("busy" if rng.random() < 0.5 else f"s{rng.randrange(5)}", rng.randrange(span * 4) * S // 4, rng.randrange(30))
        for _ in range(n)
    ]


def test_scan_needs_eleven_ports(spark):
    ten = [("a", i * 1000, i) for i in range(10)]
    assert found_scan(spark, ten) == {}
    assert found_scan(spark, [*ten, ("a", 10_000, 10)]) == {10: 11}
    assert found_scan(spark, [*ten, ("a", 10_000, 9)]) == {}
    assert found_scan(spark, [*ten, ("b", 10_000, 10)]) == {}


def test_scan_window_is_inclusive(spark):
    for base in (0, 4_900_000, 17 * S + 3):
        rows = [("a", base + i, i) for i in range(10)]
        assert found_scan(spark, [*rows, ("a", base + 5 * S, 10)]) == {10: 11}
        assert found_scan(spark, [*rows, ("a", base + 5 * S + 1, 10)]) == {}


def test_scan_peers_count_together(spark):
    rows = [("a", 7, i) for i in range(11)]
    assert found_scan(spark, rows) == {i: 11 for i in range(11)}


def test_scan_matches_brute_force(spark, tiny):
    for seed in range(3):
        rows = mixed(seed)
        assert found_scan(spark, rows, 5.0, 8) == brute_scan(rows, 5 * S, 8)


def test_scan_port_sets(spark):
    rows = mixed(9)
    out = portscan.scan_port_sets(packets(spark, rows), 5.0, 8).collect()
    assert out
    for r in out:
        want = sorted({p for s, t, p in rows if s == r["src_ip"] and r["ts_us"] - 5 * S <= t <= r["ts_us"]})
        assert r["ports"] == want and r["n_ports"] == len(want)


def test_cooldown_boundary(spark):
    assert found_cooldown(spark, [("a", 0, 1), ("a", 5 * S - 1, 1)]) == {0}
    assert found_cooldown(spark, [("a", 0, 1), ("a", 5 * S, 1)]) == {0, 1}
    # The packet at 3 s is suppressed and must not extend the cooldown.
    assert found_cooldown(spark, [("a", 0, 1), ("a", 3 * S, 1), ("a", 6 * S, 1)]) == {0, 2}
    assert found_cooldown(spark, [("a", 0, 1), ("a", 0, 2)]) == {0}


def test_cooldown_matches_brute_force(spark):
    rows = mixed(1)
    assert found_cooldown(spark, rows) == brute_cooldown(rows, 5 * S)


def test_cooldown_tree_matches_brute_force(spark, tiny):
    for seed in range(3):
        rng = random.Random(seed)
        # One source without a gap: its stretches must be composed over several levels.
        rows = [("busy", t, 1) for t in sorted(rng.sample(range(300 * S), 900))] + mixed(seed, 100)
        assert found_cooldown(spark, rows) == brute_cooldown(rows, 5 * S)


def test_negative_times_keep_their_order(spark):
    rows = [("a", t * S, 1) for t in (-12, -9, -7, -2, 0, 3)]
    assert found_cooldown(spark, rows) == brute_cooldown(rows, 5 * S)


def test_signatures(spark):
    rows = [
        (0, b"admin\r=password"), (1, b"admin\n=password"), (2, b"\xff\xfeGET /etc/passwd\x00"), (3, None),
        (4, b"SQL SELECT \xff FROM"), (5, b"select"),
    ]
    df = spark.createDataFrame(rows, "id int, payload binary")
    hits = df.where(signatures.matches_signature(F.col("payload"))).select("id").collect()
    assert {r["id"] for r in hits} == {0, 2, 4}


def test_cascade_table(spark):
    ok, nan = [0.5] * 20, float("nan")
    rows = [
        (0, ok, 0.7, 0.0, "Normal"), (1, ok, 0.7000001, 9.0, "Known Attack"), (2, ok, 0.1, 1.1, "Normal"),
        (3, ok, 0.1, 1.1000001, "Unknown Anomaly"), (4, ok, nan, 0.0, "Error: Invalid model output"),
        (5, ok[:19], 0.9, 0.0, "Error: Expected 20 features, got 19"),
        (6, [nan, *ok[:19]], 0.9, 0.0, "Error: Input contains NaN values"),
        (7, ok, 0.1, nan, "Error: Invalid autoencoder output"),
    ]
    df = spark.createDataFrame(rows, "id int, x array<double>, prob double, mse double, want string")
    got = df.select("id", "want", verdict.cascade(F.col("x"), F.col("prob"), F.col("mse"), 1.0).alias("got"))
    assert [r["id"] for r in got.collect() if r["got"] != r["want"]] == []


def test_long_lists_become_python_objects_in_pieces(monkeypatch):
    """What a task holds as Python objects does not follow the rows of an Arrow batch."""
    import pyarrow as pa

    from netwarden.operators import cooldown

    monkeypatch.setattr(cooldown, "PIECE_BYTES", 1000)
    rows = [{"src_ip": f"s{i}", "block": 0, "times": list(range(i, i + 50))} for i in range(40)]
    batch = pa.RecordBatch.from_pylist(rows)
    pieces = list(cooldown._pieces(iter([batch, batch.slice(0, 0)])))
    assert max(len(p) for p in pieces) <= 3 and sum(len(p) for p in pieces) == 40
    out = list(cooldown._summarise(10, 160)(iter([batch])))
    assert len(out) == len(pieces)
    assert pa.Table.from_batches(out).column("last").to_pylist() == [
        pa.Table.from_batches(cooldown._summarise(10, 160)(iter([batch.slice(i, 1)]))).column("last")[0].as_py() for i in range(40)
    ]
