"""Preprocessed tables, fitted artifacts, reports and generated sample data."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.plans.scale import hash_unit, hash_units

# Columns an artifact table must have, with their types.
ARTIFACT_SCHEMA = "feature string, ord int, kind string, data_min double, data_max double"


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a table once; an existing one is never overwritten."""
    writer = df.write.mode("errorifexists").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def save_artifacts(artifacts: DataFrame, path: str) -> str:
    return write_table(artifacts, path)


def load_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Fitted scaling artifacts; fails when a key is absent or has the wrong type."""
    found = spark.read.parquet(path)
    want = T.StructType.fromDDL(ARTIFACT_SCHEMA)
    have = {f.name: f.dataType for f in found.schema.fields}
    problems = [f.name for f in want.fields if have.get(f.name) != f.dataType]
    if problems:
        raise ValueError(f"artifact columns missing or mistyped: {problems}")
    return found


def artifact_checks(artifacts: DataFrame, expected_features: int) -> DataFrame:
    """``(check, passed)`` over a loaded artifact table."""
    stats = artifacts.agg(
        (F.count(F.lit(1)) == expected_features).alias("feature_count"),
        (F.count_distinct("feature") == F.count(F.lit(1))).alias("unique_names"),
        F.coalesce(F.bool_and(F.col("data_min") <= F.col("data_max")), F.lit(False)).alias("ranges"),
    )
    return stats.unpivot([], ["feature_count", "unique_names", "ranges"], "check", "passed")


def metric_rows(wide: DataFrame) -> DataFrame:
    """A one-row result as ``(metric, value)`` text rows."""
    texts = wide.select(*[F.col(c).cast("string").alias(c) for c in wide.columns])
    return texts.unpivot([], wide.columns, "metric", "value")


def write_report(wide: DataFrame, path: str, kind: str = "csv") -> str:
    """Key/value report as one small CSV or JSON file."""
    return write_table(metric_rows(wide).coalesce(1), path, kind)


def _normals(seeds: list[int], ids: np.ndarray) -> np.ndarray:
    """Standard normal draws per ``id``, a row per seed, from two digests: the same for any partitioning."""
    first = np.maximum(hash_units([f"{s}a" for s in seeds], ids), 2.0**-33)
    turn = hash_units([f"{s}b" for s in seeds], ids) * (2 * math.pi)
    return np.sqrt(np.log(first) * -2) * np.cos(turn)


def _labelled(normal: int, features: int, seed: int):
    """Rows of ids; those below ``normal`` are normal traffic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            label = (ids >= normal).astype(np.int32)
            centre = np.where(label == 1, 0.8, 0.2)
            spread = _normals([seed + i for i in range(features)], ids)
            noise = _normals([seed + 1000 + i for i in range(features)], ids)
            cells = np.clip(centre + 0.1 * spread + 0.05 * noise, 0.0, 1.0)
            yield pa.RecordBatch.from_pydict({**{f"feature_{i}": cells[i] for i in range(features)}, "Label": label})

    return run


def synthetic_labelled(spark: SparkSession, rows: int = 10_000, features: int = 20, seed: int = 42) -> DataFrame:
    """Half normal traffic around 0.2, half attacks around 0.8, with noise, clipped to [0, 1]."""
    columns = "".join(f"feature_{i} double, " for i in range(features))
    return spark.range(rows).mapInArrow(_labelled(rows // 2, features, seed), f"{columns}Label int")


# Uniform range of each leading feature; the second one is a protocol code.
SAMPLE_RANGES = {0: (0.1, 0.9), 2: (0.1, 0.8), 3: (0.1, 0.7), 4: (0.0, 1.0)}
SAMPLE_DEFAULT = (0.1, 0.9)
PROTOCOL_CODES = [0.0, 0.33, 0.66, 1.0]


def sample_rows(ids: DataFrame, features: int = 20, seed: int = 42) -> DataFrame:
    """One plausible feature row per ``id``, the same on every run."""

    def cell(i: int):
        u = hash_unit(seed, F.col("id"), F.lit(i))
        if i == 1:
            return F.element_at(
                F.array(*[F.lit(c) for c in PROTOCOL_CODES]),
                (F.floor(u * len(PROTOCOL_CODES)) + 1).cast("int"),
            )
        low, high = SAMPLE_RANGES.get(i, SAMPLE_DEFAULT)
        return F.lit(low) + u * F.lit(high - low)

    return ids.select("id", F.array(*[cell(i) for i in range(features)]).alias("x"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
