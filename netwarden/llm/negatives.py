"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with centre ``c`` and members within the angle ``b`` of
it, a candidate ``x`` at angle ``t`` from ``c`` scores at most ``|a| |x| cos(max(0, t - b))`` with a member
``a``. So a cluster needs one list only: its candidates by ``|x| cos(max(0, t - b))``, the largest first. Every
member walks that list from the top and stops as soon as the bound of what is left, times its own length, is
certain to change nothing: below its k-th score found, or below the lowest score it accepts.

The list of a cluster lies in runs, one per block of candidates, so that no task holds a whole list; a run is
sorted once in a task and walked by all members there. Blocks follow label and nearest centre, and a
(cluster, block) whose first bound is below what every member needs is never sent anywhere.

Positives come first: the nearest rows of the same label, by the same walk over the blocks that hold the
label. Scores are integer inner products of the floored components, so they are exact.

Centres are fitted on at most ``SAMPLE`` anchors, drawn by digest; bounds hold for any centres.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part,
nor do null ids and vectors of another length than the most frequent one; of rows that share an id the one with the smallest (vector,
label) counts; an anchor without another row of its label has no result; ties go to the smaller id; a zero vector
is a row like any other; a score beyond 64 bits is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.vectors import block_rows, finite, in_blocks, in_parts, matrix, meet, one_per_id
from netwarden.operators.neighbours import top_per
from netwarden.plans.scale import hash_hex, stage

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256
CLUSTERS = 16
SAMPLE = 4096
SEED = 13
# Candidates of a list that its members walk at once.
STRIDE = 256
# Added to bounds, which are doubles, in parts of the product of both lengths.
SLACK = 1e-9


def whole(x: Column) -> Column:
    """Components as whole numbers; doubles from 2 to the 53rd on are whole already."""

    def floored(v: Column) -> Column:
        scaled = SCALE * v.cast("double")
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(x, floored)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _directions(x: np.ndarray) -> np.ndarray:
    size = _lengths(x)
    return x / np.where(size > 0, size, 1)[:, None]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between rows and centres; a zero vector counts as lying on every centre, which is safe."""
    cosine = _directions(x) @ centres.T
    cosine[_lengths(x) == 0] = 1.0
    return np.arccos(np.clip(cosine, -1, 1))


def centres_of(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    points = _directions(sample)
    draw = np.random.default_rng(SEED)
    centres = points[draw.choice(len(points), min(wanted, len(points)), replace=False)]
    for _ in range(8):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = _lengths(sums)
        centres = np.where(sizes[:, None] > 1e-9, sums / np.where(sizes > 1e-9, sizes, 1)[:, None], centres)
    return centres


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these hold them, else as Python's integers."""
    top = (_lengths(a).max(initial=0) + 1) * (_lengths(x).max(initial=0) + 1)
    if top < 2.0**53:
        return np.rint(a @ x.T).astype(np.int64)
    found = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in x], object).T
    if any(abs(v) >= 1 << 63 for v in found.flat):
        raise OverflowError("a score is beyond 64 bits")
    return found.astype(np.int64)


class Walk:
    """The best ``k`` of each (member, goal) so far; a goal accepts scores from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        self.worst = np.full(len(low), np.iinfo(np.int64).min)

    def take(self, goal: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Add candidates of a goal; those that cannot matter are left out first."""
        fits = (score >= max(self.low[goal], self.worst[goal])) & (score <= self.high[goal])
        if not fits.any():
            return
        old = self.found[goal]
        score, ids = np.concatenate([old[0], score[fits]]), np.concatenate([old[1], ids[fits]])
        best = np.lexsort((ids, -score))[: self.k]
        self.found[goal] = score[best], ids[best]
        if len(best) == self.k:
            self.worst[goal] = self.found[goal][0][-1]

    def open(self, bound: np.ndarray) -> np.ndarray:
        """Goals that a candidate scoring ``bound`` or less may still change; equal scores may, by their id."""
        return bound >= np.maximum(self.low, self.worst)


def walk_list(a, sizes, who, low, high, x, ids, bounds, allowed, k):
    """Walk one sorted run: for each goal the best ``k`` as ``(scores, ids)``.

    ``a`` are members, ``who`` the member of each goal; ``x, ids, bounds`` the run in falling order of
    ``bounds``; ``allowed(members, stretch)`` masks pairs that may be taken.
    """
    state = Walk(low, high, k)
    for begin in range(0, len(x), STRIDE):
        reach = sizes[who] * bounds[begin]
        goals = np.flatnonzero(state.open(reach + SLACK * (1 + np.abs(reach))))
        if not len(goals):
            break
        part = slice(begin, begin + STRIDE)
        members, at = np.unique(who[goals], return_inverse=True)
        found, fit = scores(a[members], x[part]), allowed(members, part)
        for goal, m in zip(goals.tolist(), at.tolist()):
            state.take(goal, found[m][fit[m]], ids[part][fit[m]])
    return state.found


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``, the nearest centre, and ``angle`` to it."""
    names = rows.columns
    schema = "id long, x array<double>, label long, cell int, angle double"

    def run(batches):
        for batch in batches:
            angles = _angles(matrix(batch.column(1)), centres)
            cell = angles.argmin(1).astype(np.int32)
            columns = [*batch.columns, pa.array(cell), pa.array(angles.min(1))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "cell", "angle"])

    return rows.mapInArrow(run, schema)


def _run_bounds(x: np.ndarray, centre: np.ndarray, width: float) -> np.ndarray:
    """What a member of length one within ``width`` of ``centre`` can score with each row at most."""
    angle = _angles(x, centre[None])[:, 0]
    return _lengths(x) * np.cos(np.minimum(np.pi, np.maximum(0, angle - width)))


def _first_bounds(blocks: DataFrame, centres: np.ndarray, widths: list[float]) -> DataFrame:
    """``(block, cluster, first)``: the largest bound of each run."""

    def run(batches):
        for batch in batches:
            x, block = matrix(batch.column(1)), batch.column(0).to_numpy()
            here, at = np.unique(block, return_inverse=True)
            for c, width in enumerate(widths):
                first = np.full(len(here), -np.inf)
                np.maximum.at(first, at, _run_bounds(x, centres[c], width))
                columns = [pa.array(here), pa.array(np.full(len(here), c, np.int32)), pa.array(first)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "cluster", "first"])

    found = blocks.select("block", "x").mapInArrow(run, "block int, cluster int, first double")
    return found.groupBy("block", "cluster").agg(F.max("first").alias("first"))


_FOUND = "anchor long, goal long, goal_score long, id long, score long"


def _walked(centres: np.ndarray, widths: list[float], same_label: bool, k: int):
    """Members of a part walk the runs of one block. Goals come as lists of ``(goal, score)`` per anchor."""

    def compare(data: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["anchor", "goal", "goal_score", "id", "score"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        if not len(data) or not len(asked):
            return schema.empty_table()
        x, ids, label = matrix(data["x"]), data["id"].to_numpy(), data["label"].to_numpy()
        cluster = asked["cluster"].to_numpy()
        out = []
        for c in np.unique(cluster).tolist():
            members = asked.filter(pa.array(cluster == c))
            a, aid, alabel = matrix(members["ax"]), members["anchor"].to_numpy(), members["alabel"].to_numpy()
            goals = [(m, g["goal"], g["score"]) for m, gs in enumerate(members["goals"].to_pylist()) for g in gs]
            who = np.array([m for m, _, _ in goals], np.int64)
            aim = np.array([s for _, _, s in goals], np.int64)
            bounds = _run_bounds(x, centres[c], widths[c])
            order = np.argsort(-bounds, kind="stable")
            run_x, run_ids, run_label = x[order], ids[order], label[order]

            def allowed(some, part):
                same = alabel[some][:, None] == run_label[part][None]
                other = aid[some][:, None] != run_ids[part][None]
                return other & (same if same_label else ~same)

            if same_label:
                whole_range = np.iinfo(np.int64)
                low, high = np.full(len(goals), whole_range.min), np.full(len(goals), whole_range.max)
            else:
                # 30 p <= 100 s <= 90 p in whole numbers.
                low, high = -((-LOWEST * aim) // 100), (HIGHEST * aim) // 100
            found = walk_list(a, _lengths(a), who, low, high, run_x, run_ids, bounds[order], allowed, k)
            for (m, goal, score), (gained, who_) in zip(goals, found):
                if len(who_):
                    fixed = [pa.array(np.full(len(who_), v, np.int64)) for v in (aid[m], goal, score)]
                    out.append(pa.table([*fixed, pa.array(who_), pa.array(gained)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return compare


def mine(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    row_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on ``id``; ``label`` an expression on ``id`` and ``label`` of ``rows``.
    """
    named = rows.select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).alias("x"), F.col("label").cast("long").alias("label")
    )
    part = named.where(F.col("label").isNotNull() & finite(F.col("x"))).withColumn("x", whole(F.col("x")))
    stored, dimension = one_per_id(part.select("id", "x", "label"), "vectors")
    stored = stored.withColumn("label", label.cast("long"))
    chosen = stored.where(anchors)
    drawn = chosen.select("x", hash_hex("centre", F.col("id")).alias("h")).orderBy("h").limit(SAMPLE).collect()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not drawn:
        return rows.sparkSession.createDataFrame([], empty)
    centres = centres_of(np.array([r["x"] for r in drawn], dtype=float), CLUSTERS)
    blocks = in_blocks(stage(_placed(stored, centres), "placed"), ["label", "cell", "id"], block_rows(dimension), "blocks")
    members = stage(
        in_parts(
            _placed(chosen, centres).select(
                F.col("id").alias("anchor"), F.col("x").alias("ax"), F.col("label").alias("alabel"),
                F.col("cell").alias("cluster"), "angle",
            ),
            "anchor",
        ),
        "members",
    )
    widest = {r["cluster"]: r["w"] for r in members.groupBy("cluster").agg(F.max("angle").alias("w")).collect()}
    widths = [widest.get(c, 0.0) + SLACK for c in range(len(centres))]

    # Positives: one goal per member, over the blocks that hold its label.
    held = stage(blocks.select("block", F.col("label").alias("alabel")).distinct(), "held")
    one_goal = F.array(F.struct(F.lit(-1).cast("long").alias("goal"), F.lit(0).cast("long").alias("score")))
    first = members.drop("angle").withColumn("goals", one_goal).join(held, "alabel")
    near = meet(blocks, first, _walked(centres, widths, True, positives), _FOUND)
    best = top_per(near, ["anchor"], [F.desc("score"), F.col("id")], positives)
    goals = stage(
        best.groupBy("anchor").agg(
            F.collect_list(F.struct(F.col("id").alias("goal"), "score")).alias("goals"), F.min("score").alias("least")
        ),
        "goals",
    )

    # Negatives: a part meets a block if a run's first bound reaches what some member accepts.
    walkers = stage(members.drop("angle").join(goals, "anchor"), "walkers")
    size = F.sqrt(F.aggregate("ax", F.lit(0.0), lambda s, v: s + v * v))
    needs = walkers.groupBy("part", "cluster").agg(F.max(size).alias("size"), F.min("least").alias("least"))
    bound = F.col("size") * F.col("first")
    reached = (
        _first_bounds(blocks, centres, widths).join(needs, "cluster")
        .where(100 * (bound + SLACK * (1 + F.abs(bound))) >= LOWEST * F.col("least"))
        .select("part", "cluster", "block")
    )
    visits = walkers.drop("least").join(reached, ["part", "cluster"])
    hard = meet(blocks, visits, _walked(centres, widths, False, negatives), _FOUND)
    ranked = top_per(hard, ["anchor", "goal"], [F.desc("score"), F.col("id")], negatives)
    return ranked.select(
        F.col("anchor").alias("anchor_id"), F.col("goal").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("goal_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
