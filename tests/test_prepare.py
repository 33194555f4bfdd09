"""Encoders, scalers, cleaning limits, sources."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.functions import address, registry, values
from netwarden.operators import clean, encode, evaluate, history, score
from netwarden.operators.clean import select_and_pad
from netwarden.plans import scale
from netwarden.sources import alert_logs, flows, json_arrays, tables
from netwarden.sources import history as history_files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_addresses(spark):
    assert one(spark, address.ip_to_long, "255.255.255.255") == 2**32 - 1
    for bad in ("1.2.3", "1.2.3.256", "::1", "a.b.c.d", ""):
        assert one(spark, address.ip_to_long, bad) is None
    assert one(spark, address.cidr_network, "192.168.5.77/20") == "192.168.0.0/20"
    assert one(spark, address.cidr_network, "1.2.3.4/0") == "0.0.0.0/0"
    assert one(spark, address.cidr_network, "1.2.3.4/33") is None
    assert one(spark, address.ipv6_hex, "::1") == "0" * 31 + "1"
    assert one(spark, address.ipv6_hex, "2001:DB8::ff:0") == "20010db8" + "0" * 16 + "00ff0000"
    for bad in ("1::2::3", "1:2:3", "12345::", ":::", "g::"):
        assert one(spark, address.ipv6_hex, bad) is None, bad
    top = one(spark, address.ipv6_halves, "ffff:ffff:ffff:ffff:0:0:0:1")
    assert (top["high"], top["low"]) == (-1, 1)


def test_times(spark):
    parse = lambda c: F.unix_micros(values.parse_time(c))
    assert one(spark, parse, "1970-01-01 00:00:02:149907") == 2_000_000
    assert one(spark, parse, "1970-01-01T00:00:02Z") == 2_000_000
    assert one(spark, parse, "soon") is None


def test_unseen_values_get_the_next_code(spark, tiny):
    df = spark.createDataFrame([(v,) for v in "ccccccbbaadd"], "v string")
    fitted = encode.fit_dictionary(df, "v")
    new = spark.createDataFrame([("a",), ("c",), ("zz",), ("2001:db8::1",), (None,)], "v string")
    got = [(r["v"], r["code"]) for r in encode.encode(new, "v", fitted, "code").collect()]
    assert sorted(got, key=str) == sorted([("a", 0), ("c", 2), ("zz", 4), ("2001:db8::1", 4), (None, 4)], key=str)


def test_constant_column_scales_to_the_low_end(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    out = encode.scale(df, encode.fit_min_max(df, ["a", "b", "c"])).collect()
    assert [r["a"] for r in out] == pytest.approx([0.1, 0.9])
    assert [r["b"] for r in out] == pytest.approx([0.1, 0.1])
    assert [r["c"] for r in out] == [None, None]


def test_range_bounds_are_kept(spark):
    df = spark.createDataFrame([(1e6,), (-1e6,), (1e6 + 1,)], "a double")
    assert df.where(clean.in_range(["a"])).count() == 2


def test_class_guard(spark):
    with pytest.raises(ValueError):
        clean.require_classes(spark.createDataFrame([(1,), (1,)], "Label int"))


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0.05), (0, 0, 0.05)], "label int, pred int, prob double")
    m = evaluate.performance(df).first()
    assert (m["precision_attack"], m["recall_attack"], m["f1_attack"], m["accuracy"]) == (0, 0, 0, 1)
    assert evaluate.roc_auc(df).first()["auc"] is None
    best = evaluate.threshold_search(df).first()
    assert (best["threshold"], best["score"]) == (0.5, 0.0)
    t = evaluate.threshold_table(df).first()
    assert (t["normal_recall"], t["attack_recall"], t["f1_score"]) == (1.0, 0.0, 0.0)


def test_odd_history_has_a_smaller_older_half(spark):
    rows = [(i, "a", "success", 1.0, float(h), 0.0) for i, h in enumerate([10, 20, 60])]
    df = spark.createDataFrame(rows, "pos long, label string, status string, duration double, health_score double, model_variants double")
    assert history.trends(df).first()["health_trend"] == 30.0
    assert [r["pos"] for r in history.latest_per_label(df).collect()] == [2]


def test_sql_functions(spark):
    assert "ip_to_long" in registry.register(spark)
    row = spark.sql("SELECT ip_to_long('0.0.1.0') AS a, ip_to_long('x') AS b, dpi_match(cast('admin password' AS binary)) AS c").first()
    assert tuple(row) == (256, None, True)


def test_csv_policies(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    schema = T.StructType.fromDDL("a double, b double")
    path = str(tmp_path / "a.csv")
    counts = flows.bad_line_counts(flows.scan(spark, path, schema)).first()
    assert (counts["good_lines"], counts["bad_lines"]) == (2, 1)
    assert flows.scan(spark, path, schema, bad_lines="skip").select("a", "b").collect()[1]["a"] == 4.0
    with pytest.raises(Exception):
        flows.scan(spark, path, schema, bad_lines="error").collect()
    assert flows.list_datasets(spark, str(tmp_path)).count() == 1
    assert flows.sampled_schema(spark, path, 1).fields[0].dataType == T.IntegerType()


def test_missing_and_corrupt_json_are_empty(spark, tmp_path):
    assert alert_logs.read_json_log(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('[{"source_ip": "1"')
    assert alert_logs.read_json_log(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "ok.json").write_text('[{"source_ip": "1.2.3.4", "attack_type": "Port Scan"}]')
    assert alert_logs.read_json_log(spark, str(tmp_path / "ok.json")).first()["destination_ip"] is None


def test_both_log_layouts(spark):
    lines = [
        ("2024-01-01 00:00:01,250 - Attack from 1.1.1.1 to 2.2.2.2 | Protocol: 6 | Type: Anomaly Detected",),
        ("2024-01-01 00:00:02 - WARNING - [ALERT] Port Scan from 3.3.3.3 to 4.4.4.4",),
        ("noise",),
    ]
    out = alert_logs.parse_lines(spark.createDataFrame(lines, "value string")).collect()
    assert [(r["source_ip"], r["protocol"], r["attack_type"], r["level"]) for r in out] == [
        ("1.1.1.1", "6", "Anomaly Detected", None), ("3.3.3.3", None, "Port Scan", "WARNING")
    ]
    assert out[0]["timestamp"].microsecond == 250_000


def test_history_files_keep_positions(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"label": "b", "duration": 1.5}, {"label": "a"}]')
    out = history_files.read_array(spark, str(tmp_path / "h.json")).orderBy("pos").collect()
    assert [(r["pos"], r["label"]) for r in out] == [(0, "b"), (1, "a")]
    nested = '[{"timestamp": "t", "data": {"status": "success", "health_score": 90}}]'
    (tmp_path / "d.json").write_text(nested)
    rows = history_files.read_array(spark, str(tmp_path / "d.json"), history_files.DASHBOARD_JSON)
    assert history_files.dashboard_rows(rows).first()["health_score"] == 90.0


def test_writes_never_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        tables.write_table(spark.range(3), path)
    with pytest.raises(ValueError):
        tables.load_artifacts(spark, path)


def test_model_width_guard():
    from netwarden.catalog.models import CLASSIFIER, layer

    score.check_width(CLASSIFIER, 20)
    with pytest.raises(ValueError):
        score.check_width(CLASSIFIER, 19)
    with pytest.raises(ValueError):
        score.check_width([layer(3, 20), layer(2, 4)], 20)


def test_training_beats_chance(spark):
    rows = tables.synthetic_labelled(spark, 400)
    x = F.array(*[f"feature_{i}" for i in range(20)])
    df = scale.stage(rows.select(F.monotonically_increasing_id().alias("id"), F.col("Label").alias("label"), x.alias("x")))
    out = score.predict(score.train(df, "simple", 20), df)
    assert evaluate.performance(out).first()["accuracy"] > 0.9


def test_training_rows_spread_over_the_cores(spark):
    """Rows that lie in one partition are dealt out evenly before a fitter passes over them; few rows stay."""
    rows = spark.range(4 * score.FIT_ROWS + 7).withColumn("label", F.lit(0)).coalesce(1)
    spread = score._spread(rows)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 16
    assert spread.agg(F.count_distinct("id")).first()[0] == 4 * score.FIT_ROWS + 7
    assert score._spread(rows.limit(score.FIT_ROWS)).rdd.getNumPartitions() == 1
    assert score._spread(rows.limit(0)).count() == 0


def test_bounds_follow_from_the_values(spark):
    """Bounds taken from dictionaries equal those measured on the encoded rows, also for constant columns."""
    rows = [(float(i % 5), 7, "x", "a" if i % 3 else "b", f"10.0.0.{i % 4}", "one" if i % 2 else "two") for i in range(24)]
    rows += [(None, 1, "y", "c", "10.0.0.9", "three"), (99.0, 1, None, "c", "10.0.0.9", "one")]
    df = spark.createDataFrame(rows, "n double, k int, same string, kind string, IPV4_SRC_ADDR string, Label string")
    for target in (4, 6, 8):
        fitted = encode.fit_preprocessing(df, target=target)
        whole = encode._encoded(df, fitted.addresses, fitted.labels, fitted.one_hot, "Label")
        padded = select_and_pad(whole, fitted.features, target)
        want = encode.fit_min_max(padded, padded.columns).collect()
        assert sorted(map(tuple, fitted.bounds.collect())) == sorted(map(tuple, want)) and len(want) == target
        out = encode.transform_preprocessing(df, fitted)
        assert out.columns == [*fitted.features, "Label"] and out.count() == 24
    assert fitted.one_hot == {"same": ["x"], "kind": ["a", "b"]}
    empty = encode.fit_preprocessing(df.limit(0), target=4)
    assert [r["data_min"] for r in empty.bounds.collect()] == [None] * 4
    assert encode.transform_preprocessing(df.limit(0), empty).count() == 0


def test_json_arrays_in_pieces(spark, tmp_path):
    """A file above one split parses in several tasks; torn, nested, corrupt and empty files as whole texts."""
    rows = [{"source_ip": f"10.0.0.{i % 250}", "attack_type": f"say \"{i}\" \\ ä, [x]"} for i in range(2000)]
    nested = [{"source_ip": "n", "more": {"a": 1}}, {"source_ip": "m"}]
    braces = [{"source_ip": "a}b{\"c", "attack_type": "}"}, {"source_ip": "}{"}]
    files = {
        "long.json": json.dumps(rows, indent=1),
        "nested.json": json.dumps(nested),
        "braces.json": json.dumps(braces) + "\n",
        "empty.json": "",
        "none.json": " [ ]\n",
        "cut.json": json.dumps(rows[:9])[:-1],
        "late.json": json.dumps(rows[:9])[:-30],
        "two.json": json.dumps(rows[:3]) + json.dumps(rows[:3]),
        "null.json": json.dumps([{"source_ip": "z"}, None]),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    element = f"struct<{alert_logs.ALERT_JSON}>"
    whole = spark.read.text(str(tmp_path), wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), F.posexplode(F.from_json("value", f"array<{element}>")).alias("pos", "item")
    )
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "long.json")).rdd.getNumPartitions() > 4
        found = json_arrays.read_arrays(spark, str(tmp_path), element).collect()
        log = alert_logs.read_json_log(spark, str(tmp_path)).collect()
        order = history_files.read_array(spark, str(tmp_path / "long.json"), "source_ip string, attack_type string")
        assert [r.attack_type for r in order.orderBy("pos").collect()] == [r["attack_type"] for r in rows]
        assert [r.pos for r in order.orderBy("pos").collect()] == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    lists = {}
    for r in sorted(found, key=lambda r: (r.file, r.start, r.n)):
        lists.setdefault(r.file.rsplit("/", 1)[1], []).append(r.item)
    wanted = {}
    for r in sorted(whole.collect(), key=lambda r: (r.name, r.pos)):
        wanted.setdefault(r.name, []).append(r.item)
    assert lists == wanted
    assert len(lists["long.json"]) == 2000 and len(lists["braces.json"]) == 2 and len(lists["nested.json"]) == 2
    assert "cut.json" not in lists and "late.json" not in lists
    assert len(log) == sum(len(items) for items in wanted.values())


def test_places_of_wide_vectors_are_read_from_the_sparse_form(spark, tmp_path):
    """No vector is written out in full: its cells are as many as the column has values."""
    from netwarden.catalog.prepare import e6v

    orders = [(i, i % 7) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = e6v(spark, str(tmp_path))
    known = sorted({str(c) for o, c in orders if o % 5})
    assert {r["o_orderkey"]: (r["place"], r["width"]) for r in out.collect()} == {
        o: (known.index(str(c)), len(known) + 1) for o, c in orders
    }
    # The one-hot encoder's own function is left, none that reads the vector.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1
