"""Nearest neighbours, lexical search and hard negatives against brute force."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.llm import lexical, lsh, negatives, queries, vectors

from .helpers import documents, oracle, rows

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)


def table(spark, made):
    return spark.createDataFrame(made, VECTORS).repartition(3)


def hostile():
    """Ties, copies, a hot vector, and rows that take no part."""
    draw = random.Random(3)
    made = [(i, [draw.gauss(0, 1) for _ in range(6)], i % 3) for i in range(300)]
    made += [(i, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0], i % 2) for i in range(300, 450)]
    made += [(i, made[i - 400][1], 1) for i in range(450, 480)]
    made += [(500, None, 1), (600, [0.0] * 6, 2), (700, [NAN] + [1.0] * 5, 1), (800, [INF] + [1.0] * 5, 1)]
    made += [(900, [None] + [1.0] * 5, 1), (1000, [], 1), (1100, [1.0, 2.0], 1), (None, [1.0] * 6, 1)]
    made += [(1200, [0.5] * 6, None), (100, made[100][1], made[100][2]), (1300, [2.5, 1.0, 0.0, 1.0, 1.0, 0.0], 1)]
    return made


def taking_part(made, zero=False):
    found = {}
    for i, x, label in made:
        if i is None or not x or len(x) != 6 or any(v is None or not math.isfinite(v) for v in x):
            continue
        if zero or any(x):
            found[i] = (np.array(x, np.float32).astype(float), label)
    return found


def distances(points, q):
    ids = sorted(points)
    x = np.array([points[i][0] for i in ids])
    far = np.sqrt(((x - points[q][0]) ** 2).sum(1))
    return sorted((d, i) for d, i in zip(far.tolist(), ids) if i != q)


def recall(found, points, k):
    by = {}
    for q, rank, i, score in found:
        by.setdefault(q, []).append((rank, i, score))
    hit = total = 0
    for q, got in by.items():
        want = distances(points, q)
        exact = {i: d for d, i in want}
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, min(k, len(want)) + 1))
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got)
        hit += len({i for _, i, _ in got} & {i for _, i in want[:k]})
        total += min(k, len(want))
    return hit / total


def test_neighbours_of_hostile_vectors(spark, small_blocks):
    made = hostile()
    vectors_ = table(spark, made).withColumn("id", F.lit("mine")).withColumn("bucket", F.lit("mine")).withColumn("part", F.lit(1))
    found = rows(lsh.nearest(vectors_, vectors_.where("vec_id % 100 = 0")))
    points = taking_part(made)
    assert {r[0] for r in found} == {i for i in points if i % 100 == 0}
    assert recall(found, points, 10) >= 0.9
    # The copies of the hot vector are at distance zero, the smallest ids first.
    assert [r[2] for r in sorted(found) if r[0] == 300] == list(range(301, 311))


def test_few_or_equal_vectors(spark):
    assert rows(lsh.nearest(table(spark, []), table(spark, []))) == []
    one = table(spark, [(0, [1.0, 2.0], 1)])
    assert rows(lsh.nearest(one, one)) == []
    same = table(spark, [(i, [3.0, 4.0], 1) for i in range(40)])
    found = sorted(lsh.nearest(same, same.where("vec_id = 20")).collect())
    assert [tuple(r) for r in found] == [(20, n + 1, n, 0.0) for n in range(10)]
    three = table(spark, [(0, [0.0, 1.0], 1), (1, [0.0, 2.0], 1), (2, [5.0, 1.0], 1)])
    found = rows(lsh.nearest(three, three.where("vec_id = 0")))
    assert [r[2] for r in found] == [1, 2]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_whole_tables(spark, folder):
    path = f"/root/testdata/{folder}"
    made = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    points = {r[0]: (np.array(r[1], np.float32).astype(float), r[2]) for r in made}
    found = rows(queries.op11_multiprobe_neighbours(spark, path).select("query_id", "rank", "vec_id", "score"))
    assert {r[0] for r in found} == {i for i in points if i % 100 == 0}
    assert recall(found, points, 10) >= 0.9


def test_probes_come_in_order_of_their_chance():
    draw = np.random.default_rng(1)
    offset, spread = draw.random((5, 3)), 0.6
    moves, chance = lsh.probes(offset, spread, 60)
    share = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for q in range(5):
        every = {}
        for move in product(range(-lsh.ASIDE, lsh.ASIDE + 1), repeat=3):
            parts = [share((m + 1 - o) / spread) - share((m - o) / spread) for m, o in zip(move, offset[q])]
            every[move] = math.prod(parts)
        best = sorted(every.values(), reverse=True)[:60]
        assert np.allclose(chance[q], best, atol=1e-6)
        assert np.allclose([every[tuple(m)] for m in moves[q].tolist()], chance[q], atol=1e-6)


def test_estimated_chance_holds():
    """Pairs at the fitted distance fall into the visited buckets as often as estimated."""
    draw = np.random.default_rng(2)
    tables = lsh.Tables(32, 2.0, 1.0, np.zeros(32))
    share, hits, n = 0.6, 0, 200
    for _ in range(n):
        x, step = draw.standard_normal(32), draw.standard_normal(32)
        y = x + step / np.linalg.norm(step)
        px, py = tables.places(np.stack([x, y]))
        own = np.floor(px[0])
        moves, chance = lsh.probes((px[0] - own)[None], tables.reach / tables.width, 4096)
        upto = int(np.searchsorted(np.cumsum(chance[0]), share)) + 1
        visited = {tuple(m) for m in (own + moves[0, :upto]).tolist()}
        hits += tuple(np.floor(py[0]).tolist()) in visited
    assert abs(hits / n - share) < 0.12


def mined(points):
    """What the contract asks for, pair by pair."""
    x = {i: [math.floor(256 * v) for v in p[0]] for i, p in points.items() if p[1] is not None}
    label = {i: (points[i][1] + 1) % 10 if i % 7 == 0 else points[i][1] for i in x}
    out = []
    for a in x:
        if a % 100:
            continue
        score = {i: sum(int(u) * int(v) for u, v in zip(x[a], x[i])) for i in x if i != a}
        near = sorted((-s, i) for i, s in score.items() if label[i] == label[a])[:5]
        for s, p in near:
            p_score = -s
            hard = [(-n, i) for i, n in score.items() if label[i] != label[a] and 30 * p_score <= 100 * n <= 90 * p_score]
            out += [(a, p, r + 1, i, p_score, -n) for r, (n, i) in enumerate(sorted(hard)[:10])]
    return sorted(out)


def mine(given):
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(given, F.col("id") % 100 == 0, label)


def test_negatives_of_hostile_vectors(spark, small_blocks):
    made = hostile()
    given = table(spark, made).withColumn("id", F.lit("mine")).withColumn("cell", F.lit(1)).withColumn("x", F.lit(2))
    found = sorted(tuple(r) for r in mine(given).collect())
    assert found == mined(taking_part(made, zero=True)) and found


def test_negatives_without_partners(spark):
    def run(made):
        return rows(mine(table(spark, made)))

    assert run([]) == []
    assert run([(1, [1.0], 1)]) == []
    assert run([(0, [1.0, 1.0], 1)]) == []
    # A positive of score zero accepts a score of zero only.
    assert run([(100, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (3, [2.0, 1.0], 2)]) == [(100, 1, 1, 3, 0, 0)]


def test_walk_stops_early_and_is_exact(monkeypatch):
    """A list in falling order of bounds: the walk ends before its end and finds what a full scan finds."""
    monkeypatch.setattr(negatives, "STRIDE", 16)
    draw = np.random.default_rng(4)
    centre = np.zeros(8)
    centre[0] = 1.0
    a = np.rint(256 * (centre + draw.normal(0, 0.05, (5, 8))))
    x = np.rint(256 * draw.normal(0, 1, (2000, 8)))
    x[::3] = x[0]
    width = negatives._angles(a, centre[None]).max()
    bounds = negatives._run_bounds(x, centre, width)
    every = a @ x.T
    assert (every <= negatives._lengths(a)[:, None] * bounds[None] + 1e-3).all()
    order = np.argsort(-bounds, kind="stable")
    walked = []

    def allowed(members, part):
        walked.append(part.start)
        return np.ones((len(members), len(x[part])), bool)

    low, high = np.full(5, -(1 << 40)), np.full(5, 1 << 40)
    found = negatives.walk_list(
        a, negatives._lengths(a), np.arange(5), low, high, x[order], order, bounds[order], allowed, 7
    )
    for m in range(5):
        best = np.lexsort((np.arange(2000), -every[m]))[:7]
        assert found[m][1].tolist() == best.tolist()
        assert found[m][0].tolist() == every[m][best].astype(int).tolist()
    assert max(walked) < 1500


def test_scores_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [-(2.0**20), 1.0]])
    assert negatives.scores(a, b).tolist() == [[2**60 + 15, -(2**60) + 3]]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[2.0**60]]), np.array([[2.0**60]]))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def searched(texts, items, top):
    docs = {i: Counter(cut(t)) for i, t in texts.items() if cut(t)}
    n_docs, total = len(docs), sum(sum(c.values()) for c in docs.values())
    df = Counter(t for c in docs.values() for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in docs.items():
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in set(cut(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_search_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_ROWS", 40)
    monkeypatch.setattr(lexical, "ITEM_ROWS", 2)
    draw = random.Random(5)
    words = ["Ärger", "the", "of", "x9", "naïve", "KK", "data", "set", "rare"] + [f"w{i}" for i in range(30)]
    texts = {i: " ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for i in range(200)}
    texts |= {i: "the same, THE same; data" for i in range(200, 280)}
    texts |= {300: None, 301: "", 302: " .,- ", 303: "the " * 200_000, 304: "İstanbul data\x00set", -5: "the rare"}
    items = {1: "The data of Ärger", 2: "nothing known here", 3: None, 4: "", 5: "same same SAME data", 6: "rare w3 w4 x9 KK", 7: "the data of Ärger"}
    docs = documents(spark, [(i, t) for i, t in texts.items()]).withColumn("doc", F.lit("mine")).withColumn("term", F.lit(1))
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("item", F.lit("mine"))
    found = rows(lexical.search(docs, asked, top=15))
    assert sorted(found) == searched(texts, items, 15)


def test_search_of_repeated_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (2, "a c c"), (None, "a b")])
    item = spark.createDataFrame([(9, "a b"), (9, "a b"), (None, "c")], "item_id long, text string")
    found = rows(lexical.search(docs, item))
    assert [r[:3] for r in sorted(found)][:2] == [(9, 1, 1), (9, 2, 1)] and found[0][3] == found[1][3]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert rows(lexical.search(docs, nothing)) == []
    assert rows(lexical.search(docs.limit(0), item)) == []


def test_reading_stops_before_the_lists_end(monkeypatch):
    monkeypatch.setattr(lexical, "STRETCH", 4)
    draw = np.random.default_rng(6)
    n_docs = 3000
    lists, full = [], np.zeros(n_docs, np.int64)
    for _ in range(5):
        docs = draw.permutation(n_docs)[:2000]
        gains = np.sort((draw.pareto(1.0, len(docs)) * 100).astype(np.int64) + 1)[::-1]
        full[docs] += gains
        lists.append((docs, gains))
    near, score = lexical._resolved(lists, n_docs, 10)
    assert (full[near] == score).all()
    bar = np.sort(full)[-10]
    assert set(near.tolist()) == set(np.flatnonzero(full >= bar).tolist())


@pytest.mark.parametrize("name", ["op12_nra_search", "op13_shared_list_negatives"])
def test_queries_equal_their_sql(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns, want = oracle(queries.ORACLE[name])
    assert rows(found.select(*columns)) == want
