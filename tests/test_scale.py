"""The building blocks, with limits low enough to run their large-data paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.plans import scale
from netwarden.sources import tables


def skewed(spark, n=400):
    """A third of the rows share one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string")


def test_pin_small_checks_the_size(spark, tiny):
    assert scale.pin_small(spark.range(3)).count() == 3
    large = spark.range(4)
    assert scale.pin_small(large) is large


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_join(spark, how, monkeypatch):
    monkeypatch.setattr(scale, "SMALL_ROWS", 12)
    monkeypatch.setattr(scale, "FREQUENT_SHARE", 0.1)
    df = skewed(spark)
    table = df.groupBy("key").agg(F.count("id").alias("rows"), F.min("id").alias("first")).where("key <> 'k7'")
    want = df.join(table.drop("rows"), "key", how).select("id", "key", "first")
    got = scale.lookup(df, table, ["key"], "rows", how).select("id", "key", "first")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_take_and_index_by_hash(spark, tiny):
    df = skewed(spark)
    n = df.count()
    order = df.select("id", "key", scale.hash_hex(1, F.col("id")).alias("h")).collect()
    by = {}
    for r in sorted(order, key=lambda r: (r["h"], r["id"])):
        by.setdefault(r["key"], []).append(r["id"])
    quotas = df.groupBy("key").agg((F.count("id") / 2).cast("long").alias("quota"))
    got = scale.take_by_hash(df, "key", "id", quotas, 1, n).collect()
    want = {i for ids in by.values() for i in ids[: len(ids) // 2]}
    assert {r["id"] for r in got} == want and len(got) == len(want)
    indexed = {(r["key"], r["idx"]): r["id"] for r in scale.index_by_hash(df, "key", "id", 1, n).collect()}
    assert indexed == {(k, i): v for k, ids in by.items() for i, v in enumerate(ids)}


def test_running_totals_by_key(spark, tiny):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    got = {(r["key"], r["at"]): r["upto"] for r in scale.running_totals(df, ["at"], {"v": "upto"}, by=["key"]).collect()}
    sums, want = {}, {}
    for key, at, v in rows:
        sums[key] = sums.get(key, 0) + v
        want[key, at] = sums[key]
    assert got == want


def test_exact_quantiles(spark):
    rng = random.Random(0)
    rows = [(g, round(rng.random(), 2)) for g in "ab" for _ in range(101 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q_0"], r["q_1"]) for r in scale.exact_quantiles(df, "v", [0.25, 0.95], ["g"]).collect()}
    for g in "ab":
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g], [25, 95]))


def test_repeat_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 1), (4, 1000)], "id long, n long")
    got = sorted((r["id"], r["j"]) for r in scale.repeat_rows(df, "n", "j", chunk=64).collect())
    assert got == [(1, j) for j in range(5)] + [(3, 0)] + [(4, j) for j in range(1000)]


def test_hash_unit_is_uniform(spark):
    total = spark.range(10_000).agg(F.avg(scale.hash_unit(42, F.col("id")))).first()[0]
    assert abs(total - 0.5) < 0.01


def test_lookup_partitions_grow_with_the_rows(spark, tiny, monkeypatch):
    """A look-up by shuffle reads no more rows in a task as the table grows."""
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    rows = spark.range(2000).select("id", (F.col("id") % 300).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = scale.lookup(rows, table, ["k"], "n", "left")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert ", 40)" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["v"] for r in out.collect()} == {i: i % 300 * 2 for i in range(2000)}


def test_digests_of_a_batch(spark):
    """Digests made for a whole batch are those of the column function, for ids of any length and sign."""
    ids = [0, 9, 10, 99, 12345, 2**31, -7, 2**63 - 1, -(2**63)]
    seeds = ["42a", "1042b", "", "x" * 30]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = df.select("id", *[scale.hash_unit(s, F.col("id")).alias(f"u{i}") for i, s in enumerate(seeds)]).collect()
    found = scale.hash_units(seeds, np.array(ids))
    assert {r["id"]: tuple(r)[1:] for r in want} == {i: tuple(found[:, at]) for at, i in enumerate(ids)}
    assert scale.hash_units(seeds, np.array([], np.int64)).shape == (4, 0)
    with pytest.raises(ValueError):
        scale.hash_units(["x" * 60], np.array(ids))


def test_synthetic_rows_follow_the_digests(spark):
    """Every cell is its centre plus two normal draws from digests; no plan holds a digest for each cell."""
    rows = tables.synthetic_labelled(spark, 300, 3)
    assert "md5" not in rows._jdf.queryExecution().toString()
    found = np.array(rows.collect(), dtype=float)
    ids = spark.range(300)

    def draw(seed):
        far = F.sqrt(F.log(F.greatest(scale.hash_unit(f"{seed}a", F.col("id")), F.lit(2.0**-33))) * -2)
        return far * F.cos(scale.hash_unit(f"{seed}b", F.col("id")) * (2 * math.pi))

    centre = F.when(F.col("id") >= 150, 0.8).otherwise(0.2)
    cells = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + draw(42 + i) * 0.1 + draw(1042 + i) * 0.05)) for i in range(3)]
    want = np.array(ids.select(*cells, (F.col("id") >= 150).cast("int")).collect(), dtype=float)
    assert np.abs(found - want).max() < 1e-12
