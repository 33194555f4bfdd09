"""Run-history files: JSON arrays whose element order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.plans.scale import running_totals
from netwarden.sources.json_arrays import read_arrays

RUN_JSON = "label string, timestamp string, command string, status string, duration double, error string"
DASHBOARD_JSON = (
    "timestamp string, data struct<status:string, health_score:double, duration_seconds:double, "
    "model_variants:double, cuda_available:boolean>"
)


def read_array(spark: SparkSession, path: str, element: str = RUN_JSON) -> DataFrame:
    """Elements of each file's JSON array with their position; one file is one array."""
    found = read_arrays(spark, path, f"struct<{_fields(element)}>").withColumn("one", F.lit(1).cast("long"))
    placed = running_totals(found, ["start", "n"], {"one": "upto"}, by=["file"])
    return placed.select((F.col("upto") - 1).alias("pos"), "item.*")


def _fields(ddl: str) -> str:
    depth, out = 0, []
    for part in ddl.split(","):
        name, kind = part.strip().split(" ", 1) if depth == 0 else (None, part.strip())
        out.append(f"{name}:{kind}" if name else kind)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def dashboard_rows(history: DataFrame) -> DataFrame:
    """Nested dashboard entries as flat history rows."""
    return history.select(
        "pos",
        "timestamp",
        F.col("data.status").alias("status"),
        F.col("data.health_score").alias("health_score"),
        F.col("data.duration_seconds").alias("duration"),
        F.col("data.model_variants").alias("model_variants"),
    )
