"""Margins, comparison of samplers, rules and sketches against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from netwarden.operators import margin, neighbours, portscan, resample, signatures
from netwarden.plans import standins
from netwarden.sources import alert_logs

FOLDER = "/root/testdata/sf0.001"


def points(seed, n, classes):
    draw = np.random.default_rng(seed)
    label = draw.integers(0, classes, n)
    x = draw.normal(0, 1, (n, 3)) + 0.8 * np.stack([label, -label, label == 1], axis=1)
    return x, label


def test_margins_are_minima(spark):
    """No small step in any direction makes the loss smaller, in any of the tables fitted together."""
    tables = {f"m/{k}": points(k, 150, classes) for k, classes in enumerate((2, 2, 3))}
    made = [(s, i, int(l), v.tolist()) for s, (x, label) in tables.items() for i, (v, l) in enumerate(zip(x, label))]
    rows = spark.createDataFrame(made, "scope string, id long, label int, x array<double>").repartition(4)
    weights = margin.fit(rows)
    wrong = {}
    for scope, (x, label) in tables.items():
        z = np.hstack([x, np.ones((len(x), 1))])

        def loss(w, cls):
            y = np.where(label == cls, 1, -1)
            return 0.5 * (w[:-1] @ w[:-1]) + margin.PENALTY * (np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

        for cls, w in weights[scope].items():
            for k in range(len(w)):
                for step in (1e-3, -1e-3):
                    moved = w.copy()
                    moved[k] += step
                    assert loss(w, cls) <= loss(moved, cls) + 1e-9
        classes = list(weights[scope])
        if len(classes) == 1:
            told = np.where(z @ weights[scope][1] > 0, 1, 0)
        else:
            told = np.array(classes)[np.stack([z @ weights[scope][c] for c in classes]).argmax(0)]
        wrong[scope] = int((told != label).sum())
    assert {r.scope: r.wrong for r in margin.errors(rows, weights).collect()} == wrong


def test_comparison_reports_failures(spark):
    """Methods that cannot work have a row with their error; the others are compared and one is chosen."""
    x, label = points(9, 60, 2)
    apart = [(i, int(i < 12), [float(v) for v in x[i] + 100 * (i < 12)]) for i in range(60)]
    rows = spark.createDataFrame(apart, "id long, label int, x array<double>")
    found = resample.compare_methods(rows, [1, 2], ["SMOTE", "ADASYN"])
    found = spark.createDataFrame(found.collect(), found.schema)
    assert {r.method for r in found.where("error IS NOT NULL").collect()} == {"ADASYN"}
    metrics = {r.metric: r for r in found.where("method = 'SMOTE'").collect()}
    assert len(metrics) == 10 and all(r.n == 2 for r in metrics.values())
    assert metrics["new_imbalance_ratio"].avg == 1 and metrics["val_acc"].avg == 1
    assert metrics["boundary_violations"].avg == 0 and metrics["silhouette_score"].avg > 0.9
    chosen = {r.method: r for r in resample.select_method(resample.comparison_results(found)).collect()}
    assert chosen["SMOTE"].selected and chosen["ADASYN"].filtered


def test_first_rule_wins(spark):
    packets = spark.createDataFrame(
        [(1, b"xx ab yy"), (2, b"b"), (3, b"\xff\r ab"), (4, None), (5, b"zzz")], "packet_id long, payload binary"
    )
    rules = spark.createDataFrame(
        [(1, 5, "b", "late"), (2, 1, "a.?b", "first"), (3, 1, "ab", "tie"), (4, 0, None, "none")],
        "rule_id int, priority int, pattern string, label string",
    )
    found = {r.packet_id: (r.rule_id, r.label) for r in signatures.match_rules(packets, rules).collect()}
    assert found == {1: (2, "first"), 2: (1, "late"), 3: (2, "first")}


def test_sketches_merge(spark):
    tcp = portscan.tcp_only(standins.packets(spark, FOLDER))
    daily = portscan.port_sketches(tcp, "1 day")
    whole = portscan.merged_ports(daily, "src_ip").select("src_ip", F.col("n_ports").alias("merged"))
    direct = tcp.groupBy("src_ip").agg(F.hll_sketch_estimate(F.hll_sketch_agg("dst_port", F.lit(12))).alias("one"))
    assert whole.join(direct, "src_ip").where("abs(merged - one) > 1").count() == 0 and whole.count()


def test_approximate_neighbours_reach_most(spark):
    rows = standins.vectors(spark, FOLDER, None)
    found = neighbours.recall(neighbours.nearest_approximate(rows, 3), neighbours.nearest(rows, 3)).first()
    assert found["n"] == 3 * rows.count() and found["recall"] >= 0.9


def test_copies_are_dealt_into_buckets_once(spark, monkeypatch):
    """Of 40 copies k + 1 go into buckets, and the rows met are those of all common buckets."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)).round(3)
    x[:40] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    dealt, search = [], neighbours._search

    def counted(kept, unique, *more):
        dealt.append((kept.count(), unique.count()))
        return search(kept, unique, *more)

    monkeypatch.setattr(neighbours, "_search", counted)
    found = {}
    for r in neighbours.nearest_approximate(df, 3, tables=2, bits=3).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["nn_id"])
    assert dealt == [(2 * (50 + 4), 2 * 51)]
    axes = np.random.default_rng(42).standard_normal((5, 6))
    keys = (((x - x.mean(axis=0)) @ axes > 0).reshape(90, 2, 3) * [1, 2, 4]).sum(axis=2)
    for i in range(90):
        d = ((x - x[i]) ** 2).sum(axis=1).round(9)
        order = sorted((d[j], j) for j in range(90) if j != i and (keys[i] == keys[j]).any())
        assert found.get(i, []) == [j for _, j in order[:3]]


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    log = standins.attack_log(spark, FOLDER).drop("id").limit(50)
    first = spark.createDataFrame(log.collect(), log.schema)
    second = first.withColumn("source_ip", F.lit("10.9.9.9")).withColumn("destination_ip", F.lit(None).cast("string"))
    write = alert_logs.fan_out(str(tmp_path))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (first.limit(0), 2)):
        write(batch, number)
    for log_ in (
        alert_logs.read_alerts(spark, f"{tmp_path}/table"),
        spark.read.json(f"{tmp_path}/json"),
        alert_logs.read_text_log(spark, f"{tmp_path}/text"),
    ):
        assert log_.count() == 100 and log_.where("source_ip = '10.9.9.9'").count() == 50


def test_seeds_of_a_method_run_side_by_side(spark, monkeypatch):
    """All tables of a method are in the making before the first is done; order and errors are as before."""
    import threading

    meet = threading.Barrier(3, timeout=60)

    def made(rows, method, seed):
        if method == "none":
            raise ValueError(f"none for {seed}")
        meet.wait()
        return rows

    monkeypatch.setattr(resample, "oversample", made)
    rng = np.random.default_rng(12)
    rows = [(i, int(i % 3 == 0), [float(v) for v in rng.normal(size=2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>")
    found = resample.compare_methods(df, [1, 2, 3], ["all", "none"])
    assert {r["n"] for r in found.where("method = 'all'").collect()} == {3}
    assert found.where("method = 'none'").first()["error"] == "none for 3"


def test_rows_that_tables_share_are_kept_once(spark):
    """Of a row that a table has twice there are two, and missing ids and labels stay."""
    rows = [("a", 1, 0, [1.0]), ("b", 1, 0, [1.0]), ("b", 1, 0, [1.0]), ("a", 1, 1, [1.0]), ("b", None, None, [2.0])]
    df = spark.createDataFrame(rows, "scope string, id long, label int, x array<double>")
    shared = resample._shared_rows(df)
    found = sorted((r["scopes"], r["id"], r["label"], r["x"]) for r in shared.where("id IS NOT NULL").collect())
    assert found == [(["a"], 1, 0, [1.0]), (["a"], 1, 1, [1.0]), (["b"], 1, 0, [1.0]), (["b"], 1, 0, [1.0])]
    assert shared.where("id IS NULL").first()["scopes"] == ["b"]
    whole = resample._shared_rows(spark.createDataFrame([(s, i, 0, [float(i)]) for s in "abc" for i in range(9)], df.schema))
    assert [r["scopes"] for r in whole.collect()] == [["a", "b", "c"]] * 9
