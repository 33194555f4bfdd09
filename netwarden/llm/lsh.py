"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``SLOTS`` Gaussian projections, each cut into slots of width ``WIDTH`` times the
typical distance of a k-th neighbour. A query does not only look into its own bucket: a neighbour at
distance ``r`` differs by a normal variable of deviation ``r`` in every projection, so the chance that
it lies a given number of slots aside is known, and the chance of a bucket is the product over its slots.
Buckets are visited in falling order of that chance until the chances add up to what a table must
contribute so that all ``TABLES`` tables together miss a neighbour with probability ``1 - TARGET``.
Candidates of all tables are merged and ranked by their exact distance.

Fitted are only the slot widths: the distance of the k-th neighbour of ``PILOTS`` rows, drawn by digest and
compared with all rows. Every row is indexed. A query whose ``PROBES`` best buckets do not reach the target,
or that found fewer than k rows, is compared with all rows instead.

Of equal vectors the ``k + 1`` smallest ids are indexed, as no others can be among anyone's k nearest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
null ids and vectors of another length than the most frequent one; of rows that share an id the one with the smallest vector counts;
ties go to the smaller id; a query with fewer than k others gets all of them; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.vectors import block_rows, finite, first_k, in_blocks, in_parts, matrix, meet, one_per_id
from netwarden.operators.neighbours import top_per
from netwarden.plans.scale import hash_hex, stage

NEAREST = 10
TABLES = 4
SLOTS = 8
WIDTH = 2.0
TARGET = 0.97
PROBES = 4096
PILOTS = 64
SEED = 11
# Slots aside that a probe may look at, and bits that hold a slot's number.
ASIDE = 3
SLOT_BITS = 7


def normal_share(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail *= np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return np.where(z > 0, 1 - tail, tail)


def probes(offset: np.ndarray, spread: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` likeliest perturbations per query, likeliest first: slots aside and their chances.

    ``offset`` (queries x slots) is where a query lies within its slots, from 0 to 1; ``spread`` is a
    neighbour's deviation in slots. The best sums over all slots only extend best sums over fewer of
    them, so cutting to ``most`` after each slot loses none.
    """
    aside = np.arange(-ASIDE, ASIDE + 1)
    low = (aside - offset[..., None]) / spread
    chance = np.maximum(normal_share(low + 1 / spread) - normal_share(low), 1e-300)
    best = np.ones((len(offset), 1))
    moves = np.zeros((len(offset), 1, 0), np.int8)
    for slot in range(offset.shape[1]):
        grown = (best[:, :, None] * chance[:, slot][:, None, :]).reshape(len(offset), -1)
        if grown.shape[1] > most:
            take = np.argpartition(-grown, most - 1, axis=1)[:, :most]
        else:
            take = np.tile(np.arange(grown.shape[1]), (len(offset), 1))
        best = np.take_along_axis(grown, take, 1)
        before = np.take_along_axis(moves, (take // len(aside))[:, :, None], 1)
        moves = np.concatenate([before, aside[take % len(aside)][:, :, None].astype(np.int8)], axis=2)
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(moves, order[:, :, None], 1), np.take_along_axis(best, order, 1)


class Tables:
    """The fitted hash functions; a few kilobytes that go with every task."""

    def __init__(self, dimension: int, width: float, reach: float, middle: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.width, self.reach = width, reach
        self.axes = draw.standard_normal((dimension, TABLES * SLOTS))
        # Slot numbers are centred on the pilots, so that they fit their bits.
        self.shift = draw.random(TABLES * SLOTS) * width - middle @ self.axes

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, slots): projections in units of slots."""
        return ((x @ self.axes + self.shift) / self.width).reshape(len(x), TABLES, SLOTS)

    @staticmethod
    def bucket(table: int, slots: np.ndarray) -> np.ndarray:
        """Table and slots packed in one long; far slots share the outermost numbers."""
        half = 1 << (SLOT_BITS - 1)
        clipped = np.clip(slots, -half, half - 1).astype(np.int64) + half
        out = np.full(slots.shape[:-1], table, np.int64)
        for k in range(SLOTS):
            out = (out << SLOT_BITS) | clipped[..., k]
        return out


TABLE_SHIFT = SLOTS * SLOT_BITS


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, quickly; good to ``SLACK`` of the squared lengths."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


SLACK = 1e-11


def closest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed, k: int):
    """The ``k`` nearest allowed rows per query by exact distance: positions in ``q`` and ``x``, distances."""
    rough = squared(q, x)
    rough[qid[:, None] == ids[None]] = np.inf
    if allowed is not None:
        rough[~allowed] = np.inf
    scale = (q * q).sum(1) + (x * x).sum(1).max(initial=0)
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
    row, col = np.nonzero((rough <= (edge + 4 * SLACK * scale)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((q[row] - x[col]) ** 2).sum(1))
    best = first_k(row, exact, ids[col], k)
    return row[best], col[best], exact[best]


def _fit(points: DataFrame, dimension: int, k: int) -> Tables | None:
    """Slot widths from the pilots' k-th neighbours among all points; None where nothing can be fitted."""
    drawn = points.orderBy(hash_hex("pilot", F.col("id")), "id").limit(PILOTS).collect()
    if len(drawn) < 2:
        return None
    qid = np.array([r["id"] for r in drawn])
    q = np.array([r["x"] for r in drawn], dtype=float)

    def scan(batches):
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            row, col, far = closest(q, qid, x, ids, None, k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[col]), pa.array(far)], ["q", "id", "far"])

    found = points.select("id", "x").mapInArrow(scan, "q long, id long, far double")
    kth = top_per(found, ["q"], [F.col("far"), F.col("id")], k).groupBy("q").agg(F.max("far").alias("far"))
    far = np.sort([r["far"] for r in kth.collect() if r["far"] > 0])
    if not len(far):
        return None
    typical, reach = far[len(far) // 2], far[min(len(far) - 1, int(0.9 * len(far)))]
    return Tables(dimension, WIDTH * typical, reach, q.mean(0))


def _indexed(points: DataFrame, tables: Tables, x_type: str) -> DataFrame:
    """A row per point and table: ``(bucket, id, x)``."""

    def run(batches):
        for batch in batches:
            slots = np.floor(tables.places(matrix(batch.column(1))))
            for t in range(TABLES):
                bucket = pa.array(Tables.bucket(t, slots[:, t]))
                yield pa.RecordBatch.from_arrays([bucket, batch.column(0), batch.column(1)], ["bucket", "id", "x"])

    return points.select("id", "x").mapInArrow(run, f"bucket long, id long, x {x_type}")


def _probed(queries: DataFrame, tables: Tables) -> DataFrame:
    """``(id, bucket)`` of what each query visits; bucket null where it must meet all rows."""
    share = 1 - (1 - TARGET) ** (1 / TABLES)

    def one(qid: int, places: np.ndarray):
        seen = []
        for t in range(TABLES):
            own = np.floor(places[t])
            for most in (PROBES // 8, PROBES):
                moves, chance = probes((places[t] - own)[None], tables.reach / tables.width, most)
                total = np.cumsum(chance[0])
                if total[-1] >= share:
                    break
            else:
                return None
            upto = int(np.searchsorted(total, share)) + 1
            seen.append(Tables.bucket(t, own + moves[0, :upto]))
        return np.unique(np.concatenate(seen))

    def run(batches):
        for batch in batches:
            places = tables.places(matrix(batch.column(1)))
            for i, qid in enumerate(batch.column(0).to_pylist()):
                seen = one(qid, places[i])
                buckets = pa.array([None], pa.int64()) if seen is None else pa.array(seen)
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(buckets), pa.int64()), buckets], ["id", "bucket"])

    return queries.select("id", "x").mapInArrow(run, "id long, bucket long")


def _compared(k: int):
    """The k nearest rows that each query finds in the buckets it visits of one block."""

    def compare(data: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(data) or not len(asked):
            return schema.empty_table()
        ids, bucket, x = data["id"].to_numpy(), data["bucket"].to_numpy(), matrix(data["x"])
        qid, q = asked["id"].to_numpy(), matrix(asked["qx"])
        wanted = asked["buckets"].combine_chunks()
        there, at = np.unique(bucket, return_inverse=True)
        out = []
        for t in np.unique(there >> TABLE_SHIFT):
            of_table = np.flatnonzero(bucket >> TABLE_SHIFT == t)
            visited = np.zeros((len(qid), len(there)), bool)
            for i in range(len(qid)):
                if wanted[i].as_py() is None:
                    visited[i] = t == 0
                    continue
                list_ = wanted[i].values.to_numpy()
                visited[i] = np.isin(there, list_)
            row, col, far = closest(q, qid, x[of_table], ids[of_table], visited[:, at[of_table]], k)
            out.append(pa.table([pa.array(qid[row]), pa.array(ids[of_table][col]), pa.array(far)], schema=schema))
        return pa.concat_tables(out)

    return compare


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A neighbour may be met in several tables; it counts once."""
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return top_per(single, ["query_id"], [F.col("score"), F.col("vec_id")], k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, row_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found rows of ``vectors`` for each row of ``queries``.

    Both have ``row_id`` and ``vector``; rows of ``vectors`` with a query's id are not its neighbours.
    """

    def taking_part(df: DataFrame, name: str):
        rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("x"))
        return one_per_id(rows.where(finite(F.col("x")) & F.exists("x", lambda v: v != 0)), name)

    points, dimension = taking_part(vectors, "points")
    asked = taking_part(queries, "queries")[0].where(F.size("x") == dimension)
    asked = stage(in_parts(asked, "id"), "asked")
    kept = stage(top_per(points, ["x"], [F.col("id")], k + 1, "copy").drop("copy"), "kept")
    x_type = points.schema["x"].dataType.simpleString()
    tables = _fit(kept, dimension, k)
    if tables is None:
        # All vectors are equal, or next to none are there: one bucket holds them.
        rows, visits = kept.withColumn("bucket", F.lit(0).cast("long")), None
    else:
        rows, visits = _indexed(kept, tables, x_type), _probed(asked, tables)
    blocks = in_blocks(stage(rows, "indexed"), ["bucket", "id"], block_rows(dimension), "blocks")
    directory = stage(blocks.select("bucket", "block").distinct(), "directory")
    # Blocks follow the order of the buckets, so those of the first table come first.
    last = directory.where(F.shiftright("bucket", TABLE_SHIFT) == 0).agg(F.max("block")).first()[0]

    def met(some: DataFrame) -> DataFrame:
        brought = some.join(asked.select("id", "part", F.col("x").alias("qx")), "id")
        return meet(blocks, brought, _compared(k), "query_id long, vec_id long, score double")

    def everywhere(some: DataFrame) -> DataFrame:
        """All blocks of the first table, by number, for queries that need them."""
        numbers = F.sequence(F.lit(0), F.lit(last or 0))
        return some.where(F.lit(last is not None)).select(
            "id", F.explode(numbers).alias("block"), F.lit(None).cast("array<long>").alias("buckets")
        )

    if visits is None:
        out = stage(_ranked(met(everywhere(asked.select("id"))), k), "ranked")
    else:
        visits = stage(visits, "visits")
        listed = visits.where(F.col("bucket").isNotNull()).join(directory, "bucket")
        some = listed.groupBy("id", "block").agg(F.collect_list("bucket").alias("buckets"))
        out = stage(_ranked(met(some), k), "ranked")
        others = points.count() - 1
        full = out.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, others)).select("id")
        short = stage(asked.select("id").join(full, "id", "left_anti"), "short")
        if short.head(1):
            rest = _ranked(met(everywhere(short)), k)
            out = out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return out.select("query_id", "rank", "vec_id", "score")
