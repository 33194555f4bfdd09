"""Vectors in bounded blocks: which rows take part, and how blocks of queries meet blocks of data.

Data rows are range-partitioned into blocks of about ``block_rows(d)`` rows, so that a bucket, label or
vector that holds a third of all rows is cut into as many blocks as it needs. Queries are dealt into
parts of about ``QUERY_ROWS``. A task gets one block and one part, both bounded whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import stage

QUERY_ROWS = 1024
BLOCK_ROWS = 4096
# Numbers a block of vectors holds at most, for long vectors.
BLOCK_VALUES = 1 << 21


def block_rows(dimension: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_VALUES // max(1, dimension)))


def finite(x: Column) -> Column:
    """A vector that is there, not empty, and holds finite numbers only."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))


def one_per_id(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``(id, x, ...)`` stored with one row per id, and the length of its vectors.

    Null ids take no part. Of rows that share an id the smallest stays. Vectors of another length than
    the most frequent one (of equally frequent lengths the smallest) take no part.
    """
    others = [c for c in rows.columns if c != "id"]
    known = rows.where(F.col("id").isNotNull())
    single = known.groupBy("id").agg(F.min(F.struct(*others)).alias("r")).select("id", "r.*")
    stored = stage(single, name)
    lengths = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return stored, 0
    return stored.where(F.size("x") == lengths[0]["d"]), lengths[0]["d"]


def in_blocks(rows: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """``rows`` stored in ``order`` with ``block``, the number of the stretch of about ``size`` rows."""
    parts = max(1, math.ceil(rows.count() / size))
    ranged = rows.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id())
    return stage(ranged, name)


def in_parts(queries: DataFrame, key: str) -> DataFrame:
    """``queries`` with ``part``, a number that about ``QUERY_ROWS`` of them share."""
    parts = max(1, math.ceil(queries.count() / QUERY_ROWS))
    return queries.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def meet(blocks: DataFrame, visits: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(data, queries)`` for every (block, part) that ``visits`` names.

    ``visits`` has ``block, part`` and what a query brings along; a query is only sent to blocks that it
    visits, a block only to parts with such a query.
    """
    visits = stage(visits, "visits")
    pairs = visits.select(F.col("block").alias("to_block"), F.col("part").alias("to_part")).distinct()
    data = blocks.join(pairs, F.col("block") == F.col("to_block")).drop("block")
    met = data.groupBy("to_block", "to_part").cogroup(visits.groupBy("block", "part"))
    return met.applyInArrow(compare, schema)


def matrix(column, kind=np.float64) -> np.ndarray:
    """A column of equally long lists as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def first_k(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` entries with the smallest (score, id) of every ``row``, in that order."""
    order = np.lexsort((ids, score, row))
    sorted_rows = row[order]
    nth = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
    return order[nth < k]
