"""Neighbours, oversampling and quality against numpy, with copies and a hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.operators import neighbours, quality, resample


def table(spark, n=120, copies=40, seed=0):
    """A third of the rows are copies of one vector; one class is small."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    x[:copies] = x[0]
    label = (np.arange(n) % 6 == 0).astype(int)
    rows = [(int(i), int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(label, x))]
    return x, label, spark.createDataFrame(rows, "id long, label int, x array<double>")


def brute(x, k, allowed=None):
    out = {}
    for i in range(len(x)):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - x[i, j]) ** 2
        d = np.sqrt(d)
        order = sorted((d[j], j) for j in range(len(x)) if j != i and (allowed is None or allowed(i, j)))
        out[i] = [j for _, j in order[:k]]
    return out


def lists(df):
    return {r["id"]: [f["nn_id"] for f in r["found"]] for r in df.collect()}


def test_neighbours_with_copies(spark):
    x, _, df = table(spark)
    assert lists(neighbours.nearest_lists(df, 3)) == brute(x, 3)


def test_neighbours_in_many_blocks(spark, tiny):
    x, label, df = table(spark, seed=1)
    assert lists(neighbours.nearest_lists(df, 5)) == brute(x, 5)
    within = neighbours.nearest_lists(df, 2, scope="label", carry=["x", "label"])
    assert lists(within) == brute(x, 2, lambda i, j: label[i] == label[j])
    for r in within.collect():
        assert all(f["nn_label"] == label[r["id"]] and np.allclose(f["nn_x"], x[f["nn_id"]]) for f in r["found"])


def test_far_clusters_are_pruned_but_exact(spark, tiny):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 3)) + 50 * rng.integers(0, 4, size=(200, 1))).round(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    assert lists(neighbours.nearest_lists(df, 3)) == brute(x, 3)


def silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean()
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


def test_silhouette_with_copies(spark, tiny):
    x, y, df = table(spark)
    got = neighbours.silhouette(df).first()["silhouette"]
    assert got == pytest.approx(silhouette(x, y), abs=1e-9)


def test_smote_lies_between_class_neighbours(spark, tiny):
    x, y, df = table(spark, copies=2)
    made = resample.smote_rows(df, 3).collect()
    assert len(made) == (y == 0).sum() - (y == 1).sum()
    assert len({r["id"] for r in made}) == len(made)
    near = brute(x, 3, lambda i, j: y[i] == y[j])
    ends = [(x[i], x[j]) for i in near if y[i] == 1 for j in near[i]]
    for r in made:
        p = np.array(r["x"])
        off = min(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a, b in ends)
        assert r["label"] == 1 and off < 1e-9


def test_methods_balance(spark):
    _, y, df = table(spark, copies=2)
    for method in ("ADASYN", "Borderline-SMOTE", "SMOTE+TOMEK"):
        out = resample.oversample(df, method)
        counts = {r["label"]: r["n"] for r in resample.class_counts(out).collect()}
        assert abs(counts[0] - counts[1]) <= 20, method
        assert out.select("id").distinct().count() == out.count()


def test_too_small_class(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [2.0])], "id long, label int, x array<double>")
    with pytest.raises(ValueError):
        resample.smote(df)


def test_rescue_leaves_the_held_out_part_alone(spark):
    _, _, df = table(spark)
    out = resample.split_and_rescue(df)
    assert out.where(F.col("is_test") & (F.col("id") < 0)).count() == 0
    assert out.where("is_test").groupBy("label").count().orderBy("label").collect()[1]["count"] == 4


def test_choose_neighbours_marks_one(spark):
    _, _, df = table(spark, copies=2)
    out = resample.choose_neighbours(df, "both", most=4).collect()
    assert [r["k"] for r in sorted(out, key=lambda r: r["k"])] == [3, 4]
    assert sum(r["best"] for r in out) == 1


def test_projection_matches_numpy(spark):
    x, _, df = table(spark, copies=2)
    got = np.array([[r["pc1"], r["pc2"]] for r in sorted(quality.projection(df).collect(), key=lambda r: r["id"])])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = np.stack([c @ (v if v[abs(v).argmax()] > 0 else -v) for v in vt[:2]], axis=1)
    assert np.allclose(got, want, atol=1e-6)


def test_linear_margin_finds_a_separable_split(spark):
    rows = [(i, int(i % 2), [float(i % 2) * 4 + i / 100, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>")
    assert quality.boundary_violations(df, 15).first()["boundary_violations"] == 0


def block(x, first=0):
    """One block as the tasks see it."""
    return [{"id": first + i, "x": [float(v) for v in r]} for i, r in enumerate(x)]


def test_a_task_keeps_only_the_nearest_of_all_pairs_it_meets():
    """Pairs of one query block met in a row give ``keep`` rows for each query, not for each pair."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(300, 4)).astype(float) + 1e6
    rows = [
        {"scope": "a", "cell": 0, "part": 0, "rows": block(x[:40]), "data": block(x[i : i + 60], i), "bound": [np.inf] * 40}
        for i in range(0, 300, 60)
    ]
    batches = [pa.RecordBatch.from_pylist(rows[:2]), pa.RecordBatch.from_pylist(rows[2:])]
    found = pa.Table.from_batches(neighbours._compare(4, ["x"])(iter(batches))).to_pylist()
    assert len(found) == 40 * 4
    for i in range(40):
        d2 = neighbours._squared(x[i : i + 1], x)[0]
        want = sorted((d, j) for j, d in enumerate(np.sqrt(d2)))[:4]
        assert [(r["dist"], r["nn_id"]) for r in found if r["qid"] == i] == want
    assert all(r["nn_x"] == x[r["nn_id"]].tolist() for r in found)


def test_class_sums_leave_a_task_once_and_short_distances_are_exact():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(100, 5)), rng.normal(size=(100, 5)) * 1e-9]) + 7
    data = [{**r, "label": r["id"] % 2, "copies": 1 + r["id"] % 3} for r in block(x)]
    rows = [
        {"scope": "a", "cell": 0, "part": 0, "rows": data[:150], "data": data[i : i + 50]} for i in range(0, 200, 50)
    ]
    found = pa.Table.from_batches(neighbours._class_sums()(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    assert len(found) == 150 * 2
    for r in found:
        want = sum(
            p["copies"] * np.sqrt(neighbours._squared(x[r["id"] : r["id"] + 1], x[p["id"] : p["id"] + 1])[0, 0])
            for p in data
            if p["label"] == r["other"]
        )
        assert r["total"] == pytest.approx(want, rel=1e-12)


def test_strips_give_what_whole_blocks_give(monkeypatch):
    monkeypatch.setattr(neighbours, "STRIP_CELLS", 64)
    rng = np.random.default_rng(10)
    q, d = rng.normal(size=(50, 3)), rng.normal(size=(70, 3))
    d[3, 1] = np.nan
    for far in (np.inf, 1.0):
        row, col, d2 = neighbours._near(q, d, np.full(50, far), 5)
        full = neighbours._squared(q, d)
        full[~(full <= far)] = np.inf
        for i in range(50):
            got = sorted(d2[row == i])[:5]
            assert got == sorted(v for v in full[i] if np.isfinite(v))[:5]
    assert (neighbours._kth(q, q, 2) ** 2 >= np.sort(neighbours._squared(q, q), axis=1)[:, 1]).all()


def test_tight_limits_need_products_in_single_precision_only(monkeypatch):
    """Small tiles, a width that no word of marks fills, and limits that lie exactly on a distance."""
    rng = np.random.default_rng(11)
    q, d = rng.normal(size=(90, 6)), rng.normal(size=(203, 6))
    d[::9] = q[: len(d[::9])] + 1e-7
    full = neighbours._squared(q, d)
    limit = np.sort(full, axis=1)[:, 3]
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "_near_in_double", None)
    row, col, d2 = neighbours._near(q, d, limit, 4)
    assert sorted(zip(row, col)) == sorted(zip(*np.nonzero(full <= limit[:, None])))
    assert (d2 == full[row, col]).all()


def test_wide_values_are_compared_in_double(monkeypatch):
    """Far blobs leave single precision no room, and open limits meet too many rows: both end up exact."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    for scale, spread in ((1e5, 1.0), (1.0, 1.0), (1e200, 1.0), (1e-30, 1e-30)):
        q = rng.normal(size=(40, 3)) * spread + scale * rng.integers(0, 2, size=(40, 1))
        d = rng.normal(size=(150, 3)) * spread + scale * rng.integers(0, 2, size=(150, 1))
        full = neighbours._squared(q, d)
        for limit in (np.full(40, np.inf), np.sort(full, axis=1)[:, 4]):
            row, col, d2 = neighbours._near(q, d, limit, 3)
            for i in range(40):
                assert sorted(d2[row == i])[:3] == sorted(full[i])[:3]


def test_radius_from_runs_of_columns_is_a_bound(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 32)
    monkeypatch.setattr(neighbours, "RUN_COLUMNS", 5)
    rng = np.random.default_rng(13)
    q, d = rng.normal(size=(70, 4)), rng.normal(size=(333, 4))
    ordered = np.sort(neighbours._squared(q, d), axis=1)
    bound = neighbours._kth(q, d, 3) ** 2
    assert (bound >= ordered[:, 2]).all() and (bound <= ordered[:, 20]).all()


def test_class_sums_by_tiles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "TILE_ROWS", 8)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(61, 3))
    data = [{**r, "label": r["id"] % 4, "copies": 1 + r["id"] % 3} for r in block(x)]
    rows = [{"scope": "a", "cell": 0, "part": 0, "rows": data[:20], "data": data}]
    found = pa.Table.from_batches(neighbours._class_sums()(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    assert len(found) == 20 * 4
    for r in found:
        dist = np.sqrt(neighbours._squared(x[r["id"] : r["id"] + 1], x)[0])
        assert r["total"] == pytest.approx(sum(dist[p["id"]] * p["copies"] for p in data if p["label"] == r["other"]), rel=1e-12)


def test_pivots_follow_the_largest_scope(spark, tiny):
    """Many scopes of one row each need no more than one cell."""
    df = spark.range(400).select(
        F.col("id").cast("string").alias("scope"), "id", F.array(F.col("id").cast("double")).alias("x")
    )
    assert len(neighbours._pivots(df)) == 1


def shared_tables(spark, n=150):
    """Rows in up to four tables: common ones, copies with other ids, a few rows with sets of tables of their own."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 4)).round(3)
    x[:25] = x[0]
    label = rng.integers(0, 3, n)
    scopes = [["a", "b", "c"] if i < 90 else [["a"], ["b"], ["c", "a"], ["d"]][i % 4] for i in range(n)]
    scopes[100], scopes[101], scopes[102] = ["d", "b"], ["d", "b", "c"], ["alone"]
    rows = [(s, i, int(c), [float(v) for v in r]) for i, (s, c, r) in enumerate(zip(scopes, label, x))]
    return x, label, scopes, spark.createDataFrame(rows, "scopes array<string>, id long, label int, x array<double>")


def test_rows_of_many_scopes_are_searched_as_in_each_scope(spark, tiny, monkeypatch):
    """Also with teams of blocks, whose limits must not pass from one group of scopes to the next."""
    monkeypatch.setattr(neighbours, "GROUP_LEAST", 5)
    monkeypatch.setattr(neighbours, "TASKS_A_CORE", 1)
    x, _, scopes, df = shared_tables(spark)
    got = {}
    for r in neighbours.nearest_lists(df, 3, scope="scopes", carry=["x", "label"]).collect():
        got[r["scope"], r["id"]] = [f["nn_id"] for f in r["found"]]
        assert all(np.allclose(f["nn_x"], x[f["nn_id"]]) for f in r["found"])
    want = {}
    for s in "abcd":
        inside = [i for i in range(len(x)) if s in scopes[i]]
        for i, near in brute(x[inside], 3).items():
            want[s, inside[i]] = [inside[j] for j in near]
    assert got == want | {("alone", 102): []}


def test_rows_of_many_scopes_have_the_silhouette_of_each_scope(spark, tiny, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_LEAST", 5)
    monkeypatch.setattr(neighbours, "TASKS_A_CORE", 1)
    x, label, scopes, df = shared_tables(spark)
    got = {r["scope"]: r["silhouette"] for r in neighbours.silhouette(df, "scopes").collect()}
    single = df.select(F.explode("scopes").alias("scope"), "label", "x")
    plain = {r["scope"]: r["silhouette"] for r in neighbours.silhouette(single, "scope").collect()}
    assert set(got) == set(plain) == {"a", "b", "c", "d", "alone"} and got["alone"] == plain["alone"] == 0
    for s in "abcd":
        inside = [i for i in range(len(x)) if s in scopes[i]]
        want = silhouette(x[inside], label[inside])
        assert got[s] == pytest.approx(want, rel=1e-9) and plain[s] == pytest.approx(want, rel=1e-9)


def test_common_rows_make_one_group_and_are_met_once(spark, tiny, monkeypatch):
    """Four tables of the same 64 rows: 8 blocks with 36 pairs, not four times 64 pairs."""
    listed, meeting = [], neighbours._meeting

    def counted(held, met, pairs):
        listed.append((held.count(), pairs.count()))
        return meeting(held, met, pairs)

    monkeypatch.setattr(neighbours, "GROUP_LEAST", 5)
    monkeypatch.setattr(neighbours, "_meeting", counted)
    rng = np.random.default_rng(22)
    rows = [(list("abcd"), i, i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(64)]
    df = spark.createDataFrame(rows, "scopes array<string>, id long, label int, x array<double>")
    assert len({round(r["silhouette"], 12) for r in neighbours.silhouette(df, "scopes").collect()}) == 1
    blocks, pairs = listed[0]
    assert blocks >= 5 and pairs == blocks * (blocks + 1) // 2
    assert neighbours.nearest(df, 1, scope="scopes").count() == 4 * 64 and listed[1][0] <= 12


def test_a_block_moves_once_for_a_team_of_blocks(spark, monkeypatch):
    """144 pairs of 12 blocks with 12: each task holds some blocks and meets as many, every pair once."""
    monkeypatch.setattr(neighbours, "TASKS_A_CORE", 1)
    blocks = spark.range(12).select(
        F.lit("s").alias("scope"), F.lit(0).alias("cell"), F.col("id").cast("int").alias("part"),
        F.array(F.struct("id")).alias("rows"),
    )
    keys = [F.col(c) for c in ("scope", "cell", "part")]
    pairs = blocks.select(*keys).crossJoin(blocks.select(*[c.alias(f"other_{n}") for c, n in zip(keys, ("scope", "cell", "part"))]))
    moved = neighbours._meeting(blocks, blocks, pairs).withColumn("task", F.spark_partition_id()).collect()
    assert len(moved) < 100
    team = {(r["slot"], r["no"]): r["part"] for r in moved if r["side"] == 0}
    met = [(team[r["slot"], m], r["part"]) for r in moved if r["side"] == 1 for m in r["members"]]
    assert sorted(met) == [(i, j) for i in range(12) for j in range(12)]
    assert len({r["slot"] for r in moved}) == len({r["task"] for r in moved})


def test_tables_of_all_k_hold_their_common_rows_once(spark, monkeypatch):
    """A row of a training part is one row for all k, a synthetic one for all k that draw the same neighbour."""
    seen, measured = [], resample.silhouette

    def kept(rows, scope):
        seen.append((rows.select("scopes").collect(), {r["scope"]: r["silhouette"] for r in measured(rows, scope).collect()}))
        single = rows.select(F.explode("scopes").alias("scope"), "label", "x")
        return measured(single, "scope")

    monkeypatch.setattr(resample, "silhouette", kept)
    rng = np.random.default_rng(23)
    rows = [(i, int(i < 18), [float(v) for v in rng.normal(size=3)]) for i in range(78)]
    found = resample.choose_neighbours(spark.createDataFrame(rows, "id long, label int, x array<double>"), folds=3, most=6)
    scores = {r["k"]: r["silhouette"] for r in found.collect()}
    tables, each = seen[0]
    per_k = {k: np.mean([each[f"{f}/{k}"] for f in range(3)]) for k in scores}
    assert sorted(scores) == [3, 4, 5, 6] and scores == pytest.approx(per_k, rel=1e-9)
    # 12 of 52 rows a fold are few: 28 are made for each k.
    assert sum(len(r["scopes"]) for r in tables) == 3 * 4 * (52 + 28)
    assert len(tables) < 78 + 3 * 4 * 28 and sum(len(r["scopes"]) == 8 for r in tables) == 78
