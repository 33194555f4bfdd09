"""Exact nearest neighbours and silhouettes by blocks of vectors.

Points are assigned to the nearest of a few pivots. Each pivot's cell is cut into blocks of
bounded size by the digest of the id. A first comparison of every query block with one block
of its own cell bounds how far its k-th neighbours can be; by the triangle inequality all
cells farther away than that are skipped. The remaining (query block, data block) pairs are
compared inside tasks with numpy: a matrix product, in single precision where its error is small beside
the distances asked for, tells which rows may be near enough, and only those distances are computed in full. A task keeps the k best of a query block over all pairs that
it meets in a row, so that what leaves it does not grow with the number of pairs. It holds a team of blocks and
meets others one after the other, so a block moves once for a team, not once for every pair.

Copies of a vector are collapsed first: of m equal vectors only the k + 1 smallest ids can be
anyone's neighbours, and all copies share one search. So a group of copies costs no more than
k + 1 points whatever its size.

``scope`` separates independent searches (for example one per class or fold) in one job. Scopes that have most
rows in common are given as lists: a row then names all its scopes, rows of the same scopes make a group, and two groups are
compared once for all scopes that they share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from netwarden.plans.scale import SMALL_ROWS, hash_hex, lookup, pin_small, seats, stage

# Vectors move once per pair of blocks: the bytes shuffled fall as blocks grow.
BLOCK_ROWS = 8192
MAX_PIVOTS = 256
# Blocks that a task holds at most, and as many that it meets: beyond that tasks grow in number, not in size.
TEAM_BLOCKS = 32
# Tasks for each core, if there are so many pairs of blocks.
TASKS_A_CORE = 8
# Rows that lie in the same scopes and are worth blocks of their own.
GROUP_LEAST = 1024
# Distances held at a time, however large the blocks.
STRIP_CELLS = 1 << 20
# Rows of a square of distances that a core's cache holds.
TILE_ROWS = 512
# Columns of which one distance, the smallest, counts when a radius is bounded.
RUN_COLUMNS = 64
_BLOCK = "scope string, cell int, part int"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension so that no precision is lost."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


class _Products:
    """Squared distances of strips of ``q`` to all of ``d`` as matrix products, with a bound of their error.

    Both sides are shifted by the middle of ``d``, so that only its spread counts for the error.
    """

    def __init__(self, q: np.ndarray, d: np.ndarray):
        middle = d.mean(axis=0)
        q, d = q - middle, d - middle
        self.qn, self.dn = (q * q).sum(axis=1), (d * d).sum(axis=1)
        self.left = np.hstack([-2 * q, np.ones((len(q), 1)), np.zeros((len(q), 1))])
        self.right = np.ascontiguousarray(np.hstack([d, self.dn[:, None], np.ones((len(d), 1))]).T)
        self.most = 2 * (self.qn + self.dn.max())
        self.slack = 1e-12 * self.most

    def less(self, at: slice, by: np.ndarray) -> np.ndarray:
        """Squared distances of the rows ``at``, each less its row's ``by``."""
        left = self.left[at].copy()
        left[:, -1] = self.qn[at] - by
        return left @ self.right

    def least(self, at: slice) -> np.ndarray:
        """The smallest squared distance of the rows ``at`` in every run of columns."""
        left = self.left[at].copy()
        left[:, -1] = self.qn[at]
        parts = []
        for i in range(0, self.right.shape[1], TILE_ROWS):
            d2 = left @ self.right[:, i : i + TILE_ROWS]
            parts.append(np.minimum.reduceat(d2, range(0, d2.shape[1], RUN_COLUMNS), axis=1))
        return np.hstack(parts)

    def single(self, edge: np.ndarray) -> _SingleProducts | None:
        """The same in single precision, or nothing where its error would be large beside most of ``edge``."""
        slack = (self.right.shape[0] + 8) * 2.0**-22 * self.most + 1e-30
        if self.most.max() > 1e36 or np.count_nonzero(slack > edge / 20) * 8 > len(edge):
            return None
        return _SingleProducts(self, edge, slack)


class _SingleProducts:
    """Which pairs may be within their row's ``edge``, by products in single precision and a bound of their error."""

    def __init__(self, products: _Products, edge: np.ndarray, slack: np.ndarray):
        self.left = products.left.astype(np.float32)
        self.left[:, -1] = products.qn - edge - slack
        # Columns are filled up with ones that are never met, so that eight marks make a word.
        height, width = products.right.shape
        right = np.zeros((height, -(-width // 8) * 8), np.float32)
        right[:, :width] = products.right
        right[-2, width:] = 1
        self.tiles = [
            (i, np.ascontiguousarray(right[:, i : i + TILE_ROWS])) for i in range(0, right.shape[1], TILE_ROWS)
        ]

    def met(self, at: slice, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """``(row, col)`` of the rows ``at``, or nothing if there are far more than ``most``."""
        rows, cols, n = [], [], 0
        for first, right in self.tiles:
            marks = (self.left[at] @ right <= 0).view(np.uint64)
            # Few pairs are met: words without any are passed over.
            row, word = np.divmod(np.flatnonzero(marks), marks.shape[1])
            hit, place = np.nonzero(marks[row, word][:, None].view(np.bool_))
            rows.append(row[hit] + at.start)
            cols.append(word[hit] * 8 + place + first)
            n += len(hit)
            if n > most:
                return None
        return np.concatenate(rows), np.concatenate(cols)


def _products(q: np.ndarray, d: np.ndarray) -> _Products | None:
    """Nothing for values that products cannot hold: missing, infinite or with squares that overflow."""
    if len(d) == 0 or not (np.isfinite(q).all() and np.isfinite(d).all()):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        products = _Products(q, d)
    return products if np.isfinite(products.most).all() else None


def _strips(q: np.ndarray, d: np.ndarray) -> Iterator[slice]:
    step = max(1, STRIP_CELLS // max(len(d), 1))
    return (slice(i, i + step) for i in range(0, len(q), step))


def _kth(q: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the distances to each row's ``k``-th nearest of ``d``.

    Where there are many columns, the smallest distances of runs of them are taken: ``k`` of these belong to ``k`` rows.
    """
    out = np.empty(len(q))
    products = _products(q, d)
    exact = products is None
    if not exact and len(d) >= 8 * k * RUN_COLUMNS:
        for i in range(0, len(q), TILE_ROWS):
            at = slice(i, min(i + TILE_ROWS, len(q)))
            least = products.least(at)
            out[at] = np.partition(least, k - 1, axis=1)[:, k - 1] + products.slack[at]
        return np.sqrt(np.maximum(out, 0.0))
    for at in _strips(q, d):
        d2 = _squared(q[at], d) if exact else products.less(at, -products.slack[at])
        out[at] = np.partition(d2, k - 1, axis=1)[:, k - 1]
    return np.sqrt(out if exact else np.maximum(out, 0.0))


def _near(q: np.ndarray, d: np.ndarray, limit: np.ndarray, keep: int):
    """``(row, col, d2)`` of all pairs that may be among the row's ``keep`` nearest within ``limit``.

    What is left out is certainly farther than ``limit`` or than ``keep`` others; the squared distances
    given are those of ``_squared``.
    """
    products = _products(q, d)
    if products is None:
        return _near_in_full(q, d, limit, keep)
    # No distance is above ``most``, so an open limit can be closed there.
    edge = np.minimum(limit, products.most)
    single = products.single(edge)
    found = []
    step = TILE_ROWS if single else len(q)
    for i in range(0, len(q), step):
        at = slice(i, min(i + step, len(q)))
        pairs = single and single.met(at, 4 * keep * step)
        row, col = pairs or _near_in_double(products, at, edge, keep)
        gap = q[row] - d[col]
        d2 = np.zeros(len(row))
        for j in range(q.shape[1]):
            d2 += gap[:, j] * gap[:, j]
        met = d2 <= limit[row]
        found.append((row[met], col[met], d2[met]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _near_in_full(q: np.ndarray, d: np.ndarray, limit: np.ndarray, keep: int):
    """``_near`` for values that no product can hold."""
    found = []
    for at in _strips(q, d):
        d2 = _squared(q[at], d)
        edge = np.partition(d2, keep - 1, axis=1)[:, keep - 1] if d2.shape[1] > keep else np.full(len(d2), np.inf)
        row, col = np.nonzero(d2 <= np.minimum(edge, limit[at])[:, None])
        found.append((row + at.start, col, d2[row, col]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _near_in_double(products: _Products, rows: slice, edge: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, col)`` of all pairs of ``rows`` that may be within ``edge`` and among the row's ``keep`` nearest."""
    found, width = [], products.right.shape[1]
    step = max(1, STRIP_CELLS // width)
    for i in range(rows.start, rows.stop, step):
        at = slice(i, min(i + step, rows.stop))
        over = products.less(at, edge[at] + products.slack[at])
        place = np.flatnonzero(over <= 0)
        if len(place) > 4 * keep * len(over) and width > keep:
            least = np.partition(over, keep - 1, axis=1)[:, keep - 1] + 2 * products.slack[at]
            place = np.flatnonzero(over <= np.minimum(least, 0)[:, None])
        row, col = np.divmod(place, width)
        found.append((row + i, col))
    return tuple(np.concatenate(part) for part in zip(*found))


def _cells(rows: pa.ListScalar) -> pa.StructArray:
    """The entries of a block."""
    return rows.values


def _vectors(entries: pa.StructArray) -> np.ndarray:
    flat = entries.field("x").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(entries), -1)


# Ids that are missing come before all others, as in Spark's order.
_NO_ID = np.iinfo(np.int64).min


def _ids(entries: pa.StructArray) -> np.ndarray:
    return entries.field("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _longs(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _NO_ID)


def _pivots(points: DataFrame) -> np.ndarray:
    """A digest sample of at most ``MAX_PIVOTS`` vectors; a bounded fetch to the driver.

    Their number follows the largest scope: more would only cut the blocks of every scope into small ones.
    """
    n = points.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    wanted = int(min(MAX_PIVOTS, max(1, n // (4 * BLOCK_ROWS))))
    rows = points.select("x", hash_hex("pivot", F.col("id")).alias("h")).orderBy("h").limit(wanted).collect()
    pivots = np.array([r["x"] for r in rows], dtype=float)
    # Every pivot is followed by the nearest that is left: cells next to each other have much the same cells in reach.
    chain, left = [], list(range(len(pivots)))
    while left:
        near = _squared(pivots[chain[-1:]], pivots[left])[0].argmin() if chain else 0
        chain.append(left.pop(int(near)))
    return pivots[chain]


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            d2 = _squared(_matrix(rows["x"]), pivots)
            rows["cell"] = d2.argmin(axis=1).astype("int32")
            rows["radius"] = np.sqrt(d2.min(axis=1))
            yield rows

    return run


def blocks(points: DataFrame, pivots: np.ndarray, extra: str = "") -> DataFrame:
    """``points`` (scope, id, x and ``extra`` columns) as rows of at most about ``BLOCK_ROWS`` vectors."""
    more = f", {extra}" if extra else ""
    assigned = points.mapInPandas(
        _assign(pivots), f"scope string, id long, x array<double>{more}, cell int, radius double"
    )
    cells = assigned.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    names = [d.split()[0] for d in extra.split(",")] if extra else []
    return (
        assigned.join(cells, ["scope", "cell"])
        .withColumn("parts", parts)
        .groupBy("scope", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts")
        .agg(
            F.collect_list(F.struct("id", "x", *names)).alias("rows"),
            F.max("radius").alias("radius"),
        )
    )


def _reach(pivots: np.ndarray, keep: int):
    """Bound each query block's search radius from its home block; list the cells in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _vectors(_cells(batch["rows"][i]))
                home = batch["home"][i]
                if home.is_valid and len(home.values) >= keep:
                    bound = _kth(q, _vectors(_cells(home)), keep)
                else:
                    bound = np.full(len(q), np.inf)
                gap = np.full(len(pivots), np.inf)
                for at in _strips(q, pivots):
                    gap = np.minimum(gap, (np.sqrt(_squared(q[at], pivots)) - bound[at, None]).min(axis=0))
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: batch[c].slice(i, 1) for c in ("scope", "cell", "part", "rows")},
                        "bound": pa.array([bound], pa.list_(pa.float64())),
                        "gap": pa.array([gap], pa.list_(pa.float64())),
                    }
                )

    return run


class _Nearest:
    """The ``keep`` nearest of a query block's rows among the data blocks met so far."""

    def __init__(self, scope: str, entries: pa.StructArray, bound: np.ndarray, keep: int, carry: list[str]):
        self.scope, self.keep, self.carry = scope, keep, carry
        self.q, self.qid = _vectors(entries), _ids(entries)
        self.bound = bound * bound * (1 + 1e-9) + 1e-12
        self.forget()

    def forget(self) -> None:
        self.limit = self.bound.copy()
        self.row, self.d2, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.carried = {c: np.zeros((0, self.q.shape[1])) if c == "x" else np.zeros(0) for c in self.carry}

    def add(self, entries: pa.StructArray, d: np.ndarray, ids: np.ndarray) -> None:
        row, col, d2 = _near(self.q, d, self.limit, self.keep)
        if len(row) == 0:
            return
        # Only the lists of rows that met something are made anew.
        touched = np.zeros(len(self.q), bool)
        touched[row] = True
        before = touched[self.row]
        old = np.flatnonzero(before)
        rest = np.flatnonzero(~before)
        row, d2, ids = np.append(self.row[old], row), np.append(self.d2[old], d2), np.append(self.ids[old], ids[col])
        order = np.lexsort((ids, d2, row))
        sorted_ = row[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        kept = order[place < self.keep]
        last = order[place == self.keep - 1]
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d2[last])
        self.row = np.append(self.row[rest], row[kept])
        self.d2, self.ids = np.append(self.d2[rest], d2[kept]), np.append(self.ids[rest], ids[kept])
        for c in self.carry:
            # A missing value is kept as NaN: the columns carried are ints, which a double holds.
            new = d if c == "x" else entries.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            have = self.carried[c]
            self.carried[c] = np.concatenate([have[rest], np.concatenate([have[old], new[col]])[kept]])

    def result(self, other: str) -> pa.RecordBatch:
        n = len(self.row)
        out = {
            "scope": pa.array([self.scope], pa.string()).take(pa.array(np.zeros(n, np.int64))),
            "other": pa.array([other], pa.string()).take(pa.array(np.zeros(n, np.int64))),
            "qid": _longs(self.qid[self.row]),
            "nn_id": _longs(self.ids),
            "dist": pa.array(np.sqrt(self.d2)),
        }
        for c in self.carry:
            values = self.carried[c]
            if c == "x":
                ends = np.arange(n + 1, dtype=np.int32) * values.shape[1]
                out["nn_x"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), from_pandas=True))
            else:
                out[f"nn_{c}"] = pa.array(values, from_pandas=True).cast(pa.int32())
        return pa.RecordBatch.from_pydict(out)


def _moved(batches: Iterator[pa.RecordBatch]):
    """Rows of ``_meeting``: ``slot, key, number, held, met, members, batch, i``.

    A row brings a block to hold, a block to meet, or both; then the block held is met by its pairs alone.
    """
    for batch in batches:
        teams = "slot" in batch.schema.names
        for i in range(batch.num_rows):
            key = tuple(batch[c][i].as_py() for c in ("scope", "cell", "part"))
            held, met = (_cells(batch[c][i]) if batch[c][i].is_valid else None for c in ("rows", "data"))
            if teams:
                yield batch["slot"][i].as_py(), key, batch["no"][i].as_py(), held, met, batch["members"][i].as_py(), batch, i
            else:
                yield key, key, None, held, met, [None], batch, i


def _compare(keep: int, carry: list[str]):
    """The nearest of each query block in every scope it meets; pairs of one query block come in a row, or again later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, other, team = None, None, {}
        for here, key, number, held, met, members, batch, i in _moved(batches):
            if team and (here != slot or met is not None and other not in (None, key[0])):
                for best in team.values():
                    yield best.result(other)
                    best.forget()
                other = None
            if here != slot:
                slot, team = here, {}
            if held is not None and number not in team:
                bound = batch["bound"][i].values.to_numpy(zero_copy_only=False)
                team[number] = _Nearest(key[0], held, bound, keep, carry)
            if met is not None:
                other, d, ids = key[0], _vectors(met), _ids(met)
                for member in members:
                    team[member].add(met, d, ids)
        for best in team.values():
            yield best.result(other)

    return run


def _meeting(held: DataFrame, met: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks as tasks want them: in each ``slot`` first those of a team, then those that its ``members`` meet.

    ``pairs`` names a block of ``held`` (scope, cell, part) and one of ``met`` (other, other_cell, other_part). The list
    comes to the driver: one pair stands for ``BLOCK_ROWS`` squared distances, so it is short beside the work.
    """
    spark, names = pairs.sparkSession, ["scope", "cell", "part"]
    others = [f"other_{c}" for c in names]
    found = pairs.select(*names, *others).toPandas()
    found["a"], found["b"] = (found.groupby(c, sort=True).ngroup() for c in (names, others))
    # As many pairs a task as that number of tasks asks for; teams and what they meet are about as large, which moves least.
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    size = min(TEAM_BLOCKS, max(1, math.isqrt(len(found) // tasks)))
    run = min(TEAM_BLOCKS, max(size, math.ceil(len(found) / (tasks * size))))
    found["team"] = found["a"] // size
    found = found.sort_values(["team", "b", "a"])
    place = found.groupby("team")["b"].transform(lambda b: b.ne(b.shift()).cumsum() - 1)
    found["slot"] = found.groupby(["team", place // run]).ngroup()
    slots = int(found["slot"].max()) + 1 if len(found) else 1
    found["slot"] = np.array(seats(spark, slots))[found["slot"].to_numpy(int)]
    teams = found.drop_duplicates(["slot", "a"])[["slot", "a", *names]]
    meets = found.groupby(["slot", "b", *others])["a"].agg(list).reset_index()
    key = "slot long, no long, scope string, cell int, part int"
    teams = spark.createDataFrame(teams.values.tolist(), key)
    meets = spark.createDataFrame(meets.values.tolist(), f"{key}, members array<long>")
    empty = F.lit(None)
    bound = F.col("bound") if "bound" in held.columns else empty.cast("array<double>").alias("bound")
    holding = held.join(F.broadcast(teams), names).select(
        "slot", F.lit(0).alias("side"), "no", *names, "rows", bound,
        empty.cast(met.schema["rows"].dataType).alias("data"), empty.cast("array<long>").alias("members"),
    )
    meeting = met.join(F.broadcast(meets), names).select(
        "slot", F.lit(1).alias("side"), "no", *names,
        empty.cast(held.schema["rows"].dataType).alias("rows"), empty.cast("array<double>").alias("bound"),
        F.col("rows").alias("data"), "members",
    )
    return holding.unionByName(meeting).repartition(slots, "slot").sortWithinPartitions("slot", "side", "no")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank; Spark cuts groups to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def nearest_lists(
    data: DataFrame,
    k: int,
    queries: DataFrame | None = None,
    scope: str | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``(scope, id, found)``: the k nearest other rows of ``data`` for each query row.

    Both inputs have ``id`` and ``x`` (array of double), and ``scope`` if named; a scope that is an array
    puts its row into all of them, and the answer has a row for each. ``found`` is ordered by distance and then id, and holds ``dist, nn_id`` and ``nn_<column>`` for each
    ``carry`` column (``x`` or an int column of ``data``), which saves a join on neighbours that
    very many rows may share. A row is never its own neighbour.
    """
    carry = carry or []
    extra = [c for c in carry if c != "x"]
    if scope and isinstance(data.schema[scope].dataType, ArrayType):
        return _shared_lists(data, k, data if queries is None else queries, scope, carry)

    def shape(df: DataFrame, *more: str) -> DataFrame:
        s = F.col(scope).cast("string") if scope else F.lit("")
        return df.select(s.alias("scope"), F.col("id").cast("long").alias("id"), "x", *more)

    keep = k + 1
    points, asked = shape(data, *extra), shape(queries if queries is not None else data)
    kept = stage(top_per(points, ["scope", "x"], [F.col("id")], keep, "copy").drop("copy"), "points")
    unique = stage(
        asked.groupBy("scope", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "asked"
    )
    lists = _search(kept, unique.select("scope", "id", "x"), keep, carry)
    return _owned(unique, lists, asked, k)


def _owned(unique: DataFrame, lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The lists of vectors as lists of rows, each without the row itself.

    Only copies have to find their vector's list; a vector that occurs once is its row.
    """
    again = F.col("copies") > 1
    slim = unique.select("scope", "id", "copies", F.when(again, F.col("x")).alias("x"))
    found = stage(slim.join(lists, ["scope", "id"]), "lists")
    own = F.slice(F.filter("found", lambda f: f["nn_id"] != F.col("id")), 1, k).alias("found")
    copies = lookup(asked, found.where(again).select("scope", "x", "found", "copies"), ["scope", "x"], "copies")
    return found.where(~again).select("scope", "id", own).unionByName(copies.select("scope", "id", own))


def _single(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``scopes``, ``x`` and others) whose vector occurs once in all scopes, and the rest with one ``scope`` a row."""
    others = [c for c in points.columns if c != "x"]
    per_vector = stage(
        points.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*others)).alias("first")), "points"
    )
    again = (F.col("n") > 1) & F.col("x").isNotNull()
    copies = lookup(points, per_vector.where(again).select("x", "n"), ["x"], "n")
    more = copies.unionByName(points.where(F.col("x").isNull()).select(*copies.columns))
    single = per_vector.where((F.col("n") == 1) & F.col("x").isNotNull()).select(*[f"first.{c}" for c in others], "x")
    rest = [c for c in points.columns if c != "scopes"]
    return single, stage(more.select(F.explode("scopes").alias("scope"), *rest), "copies")


def _groups(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``rows`` (``scopes`` and others) with ``scope``: the group of their scopes if ``common`` has one, else each scope by itself."""
    rest = [c for c in rows.columns if c != "scopes"]
    groups = F.when(F.col("grp").isNotNull(), F.array("grp")).otherwise(F.col("scopes"))
    return rows.join(F.broadcast(common), "scopes", "left").select(F.explode(groups).alias("scope"), *rest)


def _common(rows: DataFrame) -> DataFrame:
    """``scopes, grp``: the sets of scopes in which ``GROUP_LEAST`` rows or more lie; never more than ``SMALL_ROWS`` sets."""
    counts = rows.where(F.size("scopes") > 1).groupBy("scopes").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") >= GROUP_LEAST).orderBy(F.desc("n"), "scopes").limit(SMALL_ROWS)
    return pin_small(large.select("scopes", F.concat(F.lit("group "), F.md5(F.to_json("scopes"))).alias("grp")))


def _meets(common: DataFrame, scopes: DataFrame) -> DataFrame:
    """``scope, other, scopes``: which groups are compared, and for which of the ``scopes`` (scope) that both are part of."""
    alone = scopes.select("scope", F.col("scope").alias("member"))
    members = pin_small(common.select(F.col("grp").alias("scope"), F.explode("scopes").alias("member")).unionByName(alone))
    others = members.withColumnRenamed("scope", "other")
    return pin_small(
        members.join(others, "member").groupBy("scope", "other").agg(F.array_sort(F.collect_list("member")).alias("scopes"))
    )


def _shared_lists(data: DataFrame, k: int, queries: DataFrame, scope: str, carry: list[str]) -> DataFrame:
    """``nearest_lists`` for rows that name all their scopes in an array."""
    keep, extra = k + 1, [c for c in carry if c != "x"]

    def shape(df: DataFrame, *more: str) -> DataFrame:
        s = F.array_sort(F.array_distinct(F.col(scope).cast("array<string>"))).alias("scopes")
        return df.select(s, F.col("id").cast("long").alias("id"), "x", *more)

    single, copies = _single(shape(data, *extra))
    common = _common(single)
    kept = _groups(single, common).unionByName(
        top_per(copies, ["scope", "x"], [F.col("id")], keep, "copy").drop("copy")
    )
    alone, again = (single, copies) if queries is data else _single(shape(queries))
    per_vector = again.groupBy("scope", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    asked = _groups(alone.select("scopes", "id", "x"), common).unionByName(per_vector.select("scope", "id", "x"))
    scopes = single.select(F.explode("scopes").alias("scope")).union(copies.select("scope")).distinct()
    lists = _search(stage(kept, "points"), stage(asked, "asked"), keep, carry, _meets(common, scopes))
    unique = alone.select(F.explode("scopes").alias("scope"), "id", F.lit(1).cast("long").alias("copies"), "x")
    return _owned(unique.unionByName(per_vector.select("scope", "id", "copies", "x")), lists, again.select("scope", "id", "x"), k)


def _search(
    kept: DataFrame, unique: DataFrame, keep: int, carry: list[str], meets: DataFrame | None = None
) -> DataFrame:
    """``(scope, id, found)``: the ``keep`` nearest rows of ``kept`` for each row of ``unique``, itself included.

    ``meets`` tells which groups of rows are compared for which scopes; without it every scope by itself.
    """
    pivots = _pivots(kept)
    stored = stage(blocks(kept, pivots, ", ".join(f"{c} int" for c in carry if c != "x")), "blocks")
    # Any block of the own cell can bound the radius; without one the bound stays open.
    homes = stored.select(
        "scope", "cell", F.col("part").alias("home_part"), F.col("rows").alias("home")
    )
    parts = stored.groupBy("scope", "cell").agg(F.min("part").alias("home_part"))
    entry = "rows array<struct<id: bigint, x: array<double>>>"
    reach = stage(
        blocks(unique, pivots)
        .join(parts, ["scope", "cell"], "left")
        .join(homes, ["scope", "cell", "home_part"], "left")
        .select("scope", "cell", "part", "rows", "home")
        .mapInArrow(_reach(pivots, keep), f"{_BLOCK}, {entry}, bound array<double>, gap array<double>"),
        "reach",
    )
    # The cells in reach and their parts are listed before any vectors move.
    radii = pin_small(
        stored.groupBy(F.col("scope").alias("other_scope"), F.col("cell").alias("other_cell")).agg(
            F.max("radius").alias("far"), F.max("parts").alias("parts")
        )
    )
    asking = reach.select("scope", "cell", "part", F.posexplode("gap").alias("other_cell", "gap"))
    if meets is None:
        asking = asking.withColumn("other_scope", F.col("scope"))
    else:
        asking = asking.join(meets.select("scope", F.col("other").alias("other_scope")), "scope")
    pairs = (
        asking.join(radii, ["other_scope", "other_cell"])
        .where(F.col("gap") <= F.col("far") + 1e-9)
        .select("scope", "cell", "part", "other_scope", "other_cell", F.explode(_part_numbers()).alias("other_part"))
    )
    carried = "".join(f", nn_{c} {'array<double>' if c == 'x' else 'int'}" for c in carry)
    best = _meeting(reach.select("scope", "cell", "part", "rows", "bound"), stored, pairs).mapInArrow(
        _compare(keep, carry), f"scope string, other string, qid long, nn_id long, dist double{carried}"
    )
    if meets is not None:
        best = best.join(meets, ["scope", "other"]).withColumn("scope", F.explode("scopes"))
    merged = top_per(best, ["scope", "qid"], [F.col("dist"), F.col("nn_id")], keep, "place")
    # At most k + 1 entries per vector: one short list serves all its copies.
    entry = F.struct("dist", "nn_id", *[f"nn_{c}" for c in carry])
    return merged.groupBy("scope", F.col("qid").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("found"))


def nearest(
    data: DataFrame,
    k: int,
    queries: DataFrame | None = None,
    scope: str | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per neighbour: ``scope, id, nn_id, rank, dist`` and the carried columns."""
    lists = nearest_lists(data, k, queries, scope, carry)
    return lists.select("scope", "id", F.posexplode("found").alias("pos", "f")).select(
        "scope",
        "id",
        "f.nn_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        "f.dist",
        *[f"f.nn_{c}" for c in carry or []],
    )


# Tables of the approximate search, and sign bits that make a bucket.
HASH_TABLES, HASH_BITS = 12, 4


def _signs(width: int, tables: int, bits: int, seed: int):
    """Buckets of every row: in each table, on which side of ``bits`` random planes it lies."""
    axes = np.random.default_rng(seed).standard_normal((width, tables * bits))
    powers = 1 << np.arange(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            side = (_matrix(rows["x"]) @ axes > 0).reshape(len(rows), tables, bits)
            keys = (side * powers).sum(axis=2)
            names = [[f"{t}:{key}" for t, key in enumerate(row)] for row in keys.tolist()]
            yield rows.assign(bucket=names)

    return run


def nearest_approximate(
    data: DataFrame, k: int, tables: int = HASH_TABLES, bits: int = HASH_BITS, seed: int = 42
) -> DataFrame:
    """``id, nn_id, rank, dist``: the ``k`` nearest rows met in a common bucket of random planes.

    For callers that can do without certainty: rows at angle ``a`` share a table's bucket with probability
    ``(1 - a / pi) ** bits`` and are met in one of ``tables`` such tables. Inside a bucket, which
    is cut into blocks like any scope, the search is exact. The planes pass through the mean. Copies of a
    vector lie in the same buckets: they are collapsed before rows go into their ``tables`` buckets.
    """
    width = len(data.select("x").first()["x"])
    mean = data.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)])).first()[0]
    centred = data.select(
        F.col("id").cast("long").alias("id"),
        F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b).alias("x"),
    )
    keep = k + 1
    signs = _signs(width, tables, bits, seed)
    copies = top_per(centred, ["x"], [F.col("id")], keep, "copy").select("id", "x")
    kept = stage(copies.mapInPandas(signs, "id long, x array<double>, bucket array<string>"), "points")
    first = centred.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    unique = stage(
        first.mapInPandas(signs, "x array<double>, id long, copies long, bucket array<string>"), "asked"
    )
    dealt = [df.select(F.explode("bucket").alias("scope"), "id", "x") for df in (kept, unique)]
    lists = _search(*dealt, keep, [])
    found = lists.groupBy("id").agg(F.collect_list(F.struct("scope", "found")).alias("found"))
    own = F.filter("found", lambda t: F.array_contains("bucket", t["scope"]))
    per_vector = stage(
        unique.join(found, "id").select("x", F.transform(own, lambda t: t["found"]).alias("found"), "copies"), "lists"
    )
    others = F.flatten(
        F.transform("found", lambda t: F.slice(F.filter(t, lambda f: f["nn_id"] != F.col("id")), 1, k))
    )
    met = lookup(centred, per_vector, ["x"], "copies").select("id", F.explode(others).alias("f"))
    single = met.groupBy("id", "f.nn_id").agg(F.min("f.dist").alias("dist"))
    return top_per(single, ["id"], [F.col("dist"), F.col("nn_id")], k).select("id", "nn_id", "rank", "dist")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n, hits, recall``: how many of the exact neighbours were found."""
    both = exact.select("id", "nn_id").join(found.select("id", "nn_id", F.lit(1).alias("hit")), ["id", "nn_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).withColumn(
        "recall", F.col("hits") / F.col("n")
    )


def _part_numbers() -> Column:
    return F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))


def _distances(q: np.ndarray, d: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Distances of ``q`` to ``d`` by tiles; short ones, which a matrix product blurs, in full."""
    products = _products(q, d)
    if products is None:
        for at in _strips(q, d):
            yield at, slice(0, len(d)), np.sqrt(_squared(q[at], d))
        return
    left = products.left
    left[:, -1] = products.qn
    tiles = [
        (slice(i, i + TILE_ROWS), np.ascontiguousarray(products.right[:, i : i + TILE_ROWS]))
        for i in range(0, len(d), TILE_ROWS)
    ]
    for i in range(0, len(q), TILE_ROWS // 2):
        at = slice(i, i + TILE_ROWS // 2)
        near = 1e6 * products.slack[at]
        for to, right in tiles:
            d2 = left[at] @ right
            if d2.min() < near.max():
                place = np.flatnonzero(d2 < near[:, None])
                if len(place) * 8 > d2.size:
                    d2 = _squared(q[at], d[to])
                elif len(place):
                    row, col = np.divmod(place, d2.shape[1])
                    gap = q[row + i] - d[col + to.start]
                    short = np.zeros(len(row))
                    for j in range(q.shape[1]):
                        short += gap[:, j] * gap[:, j]
                    d2[row, col] = short
            yield at, to, np.sqrt(d2, out=d2)


class _Sums:
    """For each row of a block: summed distance to every class of the blocks met, times copies.

    Rows are held by class, so that a tile meets few of them.
    """

    def __init__(self, key: tuple, entries: pa.StructArray):
        label = entries.field("label").to_numpy(zero_copy_only=False)
        self.key, self.ids, self.order = key, _ids(entries), np.argsort(label, kind="stable")
        self.classes, self.place = np.unique(label[self.order], return_inverse=True)
        self.x = _vectors(entries)[self.order]
        self.copies = np.zeros((len(label), len(self.classes)))
        self.copies[np.arange(len(label)), self.place] = entries.field("copies").to_numpy(zero_copy_only=False)[self.order]
        self.total: dict[tuple[str, int], np.ndarray] = {}

    def _columns(self, at: slice) -> slice:
        return slice(self.place[at][0], self.place[at][-1] + 1)

    def _take(self, other: _Sums, total: np.ndarray) -> None:
        for i, c in enumerate(other.classes):
            place = (other.key[0], int(c))
            self.total[place] = self.total.get(place, 0.0) + total[:, i]

    def meet(self, other: _Sums, both: bool) -> None:
        """Sums for the own rows, and if asked for the other's too: every distance is computed once."""
        mine, theirs = np.zeros((len(self.x), len(other.classes))), np.zeros((len(other.x), len(self.classes)))
        for at, to, dist in _distances(self.x, other.x):
            own = other._columns(to)
            mine[at, own] += dist @ other.copies[to, own]
            if both:
                own = self._columns(at)
                theirs[to, own] += dist.T @ self.copies[at, own]
        self._take(other, mine)
        if both:
            other._take(self, theirs)

    def result(self) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        scope = pa.array([self.key[0]], pa.string()).take(pa.array(np.zeros(n, np.int64)))
        for (_, c), total in self._ordered():
            yield pa.RecordBatch.from_pydict(
                {"scope": scope, "id": _longs(self.ids), "other": pa.array(np.full(n, c, np.int32)), "total": pa.array(total)}
            )

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The same as a row for each scope and class met."""
        scope, _, part = self.key
        for (other, c), total in self._ordered():
            yield pa.RecordBatch.from_pydict(
                {
                    "scope": pa.array([scope], pa.string()),
                    "part": pa.array([part], pa.int32()),
                    "other": pa.array([other], pa.string()),
                    "label": pa.array([c], pa.int32()),
                    "total": pa.array([total], pa.list_(pa.float64())),
                }
            )

    def _ordered(self):
        for place, total in self.total.items():
            out = np.empty(len(total))
            out[self.order] = total
            yield place, out


def _class_sums(lists: bool = False):
    """Sums of each block held, by row or as ``lists``; of pairs in teams also those of the block met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, team = None, {}
        for here, key, number, held, met, members, _, _ in _moved(batches):
            if here != slot:
                for sums in team.values():
                    yield from sums.lists() if lists else sums.result()
                slot, team = here, {}
            if held is not None and number not in team:
                team[number] = _Sums(key, held)
            if met is not None:
                other = _Sums(key, met)
                for member in members:
                    team[member].meet(other, lists and team[member].key != key)
                if lists:
                    yield from other.lists()
        for sums in team.values():
            yield from sums.lists() if lists else sums.result()

    return run


def _block_silhouettes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``scope, value, rows`` of each block: its silhouettes summed. A block's own row comes before its sums."""

    def result(label, copies, sizes, sums):
        for scope, size in sizes.items():
            a, b, own_size = (np.full(len(label), v) for v in (np.nan, np.inf, 0.0))
            for c, n in size.items():
                own = label == c
                with np.errstate(invalid="ignore"):
                    a[own], own_size[own] = sums[scope, c][own] / max(n - 1, 1), n
                    b[~own] = np.fmin(b[~own], sums[scope, c][~own] / n)
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.maximum(a, b)
                value = np.where((most == 0) | (own_size <= 1) | (len(size) < 2), 0.0, (b - a) / most)
            yield pa.RecordBatch.from_pydict(
                {"scope": [scope], "value": [float(value @ copies)], "rows": [int(copies.sum())]}
            )

    block, sums = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            if batch["side"][i].as_py() == 0:
                if block:
                    yield from result(*block, sums)
                label, copies = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("labels", "copies"))
                sizes: dict[str, dict[int, int]] = {}
                for r in batch["sizes"][i].as_py():
                    sizes.setdefault(r["scope"], {})[r["label"]] = r["size"]
                block, sums = (label, copies, sizes), {(s, c): np.zeros(len(label)) for s in sizes for c in sizes[s]}
            else:
                total = batch["total"][i].values.to_numpy(zero_copy_only=False)
                for s in batch["scopes"][i].as_py():
                    sums[s, batch["label"][i].as_py()] += total
    if block:
        yield from result(*block, sums)


def silhouette(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Mean Euclidean silhouette per scope, over all rows; the work is quadratic in distinct rows.

    Equal (vector, label) rows are counted once with their multiplicity. Blocks are paired
    with all blocks of the same scope; a pair yields one sum per row and class for both its blocks. A scope that is an
    array puts its row into all of them; rows of the same scopes are met once.
    """
    count = F.count(F.lit(1)).alias("copies")
    label = F.col("label").cast("int").alias("label")
    if scope and isinstance(rows.schema[scope].dataType, ArrayType):
        scopes = F.array_sort(F.array_distinct(F.col(scope).cast("array<string>"))).alias("scopes")
        single, copies = _single(rows.select(scopes, label, "x"))
        single = single.withColumn("copies", F.lit(1).cast("long"))
        copies = copies.groupBy("scope", "label", "x").agg(count)
        common = _common(single)
        unique = _groups(single, common).unionByName(copies.select("scope", "label", "x", "copies"))
        counted = single.select(F.explode("scopes").alias("scope"), "label", "copies").unionByName(copies.drop("x"))
        sizes = pin_small(counted.groupBy("scope", "label").agg(F.sum("copies").alias("size")))
        meets = _meets(common, sizes.select("scope").distinct())
    else:
        s = F.col(scope).cast("string") if scope else F.lit("")
        unique = rows.select(s.alias("scope"), label, "x").groupBy("scope", "label", "x").agg(count)
        sizes, meets = None, None
    unique = stage(
        unique.select(
            "scope",
            F.xxhash64("scope", "label", "x").alias("id"),
            "x",
            "label",
            "copies",
        ),
        "unique",
    )
    if meets is None:
        sizes = pin_small(unique.groupBy("scope", "label").agg(F.sum("copies").alias("size")))
        each = sizes.select("scope").distinct()
        meets = pin_small(each.select("scope", F.col("scope").alias("other"), F.array("scope").alias("scopes")))
    # Every block meets every other, so cells would only make blocks small: one for each scope.
    stored = stage(blocks(unique, _pivots(unique)[:1], "label int, copies long"), "blocks")
    here = stored.select("scope", "cell", "part")
    there = stored.select(F.col("scope").alias("other"), F.col("cell").alias("other_cell"), F.col("part").alias("other_part"))
    pairs = (
        here.join(meets.select("scope", "other"), "scope")
        .join(there, "other")
        .where(F.struct("scope", "cell", "part") <= F.struct("other", "other_cell", "other_part"))
        .withColumnRenamed("other", "other_scope")
    )
    totals = _meeting(stored.select("scope", "cell", "part", "rows"), stored, pairs).mapInArrow(
        _class_sums(lists=True), "scope string, part int, other string, label int, total array<double>"
    )
    # The sums of a block come together behind its classes, copies and the sizes of all classes of its scopes.
    size = F.struct("scope", "label", "size").alias("size")
    member = meets.where(F.col("scope") == F.col("other")).select(F.col("scope").alias("grp"), F.explode("scopes").alias("scope"))
    per_group = pin_small(
        member.join(sizes, "scope").groupBy(F.col("grp").alias("scope")).agg(F.collect_list(size).alias("sizes"))
    )
    own = stored.join(per_group, "scope").select(
        "scope", "part", F.lit(0).alias("side"), F.col("rows.label").alias("labels"), F.col("rows.copies").alias("copies"), "sizes"
    )
    met = totals.join(meets, ["scope", "other"]).select("scope", "part", F.lit(1).alias("side"), "label", "total", "scopes")
    together = own.unionByName(met, allowMissingColumns=True).repartition("scope", "part")
    return (
        together.sortWithinPartitions("scope", "part", "side")
        .mapInArrow(_block_silhouettes, "scope string, value double, rows long")
        .groupBy("scope")
        .agg((F.sum("value") / F.sum("rows")).alias("silhouette"))
    )
