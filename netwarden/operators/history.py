"""Run-history rollups. ``pos`` is the append position of a run, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.functions.values import parse_time
from netwarden.plans.scale import running_totals

# Trend and grade limits.
HEALTH_TREND, DURATION_TREND = 1.0, 0.1
HISTORY_CAP, SHOWN = 50, 5
# Chunks in order that one window group of ``growth_guard`` holds.
STRETCH = 1 << 14


def latest_per_label(history: DataFrame) -> DataFrame:
    """The last appended run of each label, in original order; one aggregate per label."""
    rest = [c for c in history.columns if c != "label"]
    newest = history.groupBy("label").agg(F.max_by(F.struct(*rest), "pos").alias("run"))
    return newest.select("label", "run.*").orderBy("pos")


def retained(history: DataFrame, now: Column, days: int) -> DataFrame:
    """Runs newer than the cutoff, and runs whose time is missing or unreadable."""
    at = parse_time(F.col("timestamp"))
    return history.where(at.isNull() | (at > _cutoff(now, days)))


def _cutoff(now: Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86_400_000_000))


def retention_preview(history: DataFrame, now: Column, days: int) -> DataFrame:
    """What a clean-up would remove. ``action`` marks earlier clean-ups, if the column exists."""
    at = parse_time(F.col("timestamp"))
    action = F.col("action") if "action" in history.columns else F.lit(None).cast("string")
    cleanup = F.when(action.isin("started", "completed"), F.col("timestamp"))
    return history.select(
        at.alias("at"), F.col("pos"), cleanup.alias("cleanup")
    ).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("at") <= _cutoff(now, days)).alias("removable"),
        F.min("at").alias("oldest"),
        F.max("at").alias("newest"),
        F.floor((F.unix_micros(now) - F.unix_micros(F.min("at"))) / F.lit(86_400_000_000))
        .cast("long")
        .alias("age_days"),
        F.max_by("cleanup", F.when(F.col("cleanup").isNotNull(), F.col("pos"))).alias("last_cleanup"),
    )


def newest(history: DataFrame, n: int = HISTORY_CAP) -> DataFrame:
    """The last ``n`` appended runs in original order; a distributed top-k."""
    return history.orderBy(F.desc("pos")).limit(n).orderBy("pos")


def previous_entries(history: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` runs before the current one, newest first."""
    return history.orderBy(F.desc("pos")).limit(n + 1).orderBy(F.desc("pos")).offset(1)


def status_kind(status: Column) -> Column:
    low = F.lower(status)
    return (
        F.when(low == "success", "SUCCESS").when(low.isin("warning", "partial"), "WARNING").otherwise("ERROR")
    )


def averages(history: DataFrame) -> DataFrame:
    """Success rate and mean health, duration and model count; missing fields count as 0."""

    def mean(name: str) -> Column:
        return F.avg(F.coalesce(F.col(name), F.lit(0.0)))

    return history.agg(
        F.count(F.lit(1)).alias("entries"),
        (F.avg((F.lower("status") == "success").cast("double")) * 100).alias("success_rate"),
        mean("health_score").alias("avg_health"),
        mean("duration").alias("avg_duration"),
        mean("model_variants").alias("avg_models"),
    )


def _numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their 0-based rank in ``order`` as ``name``, by range partitions."""
    ranked = running_totals(rows.withColumn("__one", F.lit(1).cast("long")), [order], {"__one": name})
    return ranked.withColumn(name, F.col(name) - 1).drop("__one")


def trends(history: DataFrame) -> DataFrame:
    """Newer half minus older half by rank of the position; the older half is the smaller one."""
    half = F.expr("entries div 2")
    ranked = _numbered(history, "pos", "__nth")
    sized = ranked.withColumn("entries", history.agg(F.count(F.lit(1))).scalar())
    older, newer = F.col("__nth") < half, F.col("__nth") >= half

    def change(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0))
        return F.avg(F.when(newer, value)) - F.avg(F.when(older, value))

    health, duration = F.col("health_trend"), F.col("duration_trend")
    return sized.agg(
        change("health_score").alias("health_trend"), change("duration").alias("duration_trend")
    ).select(
        "*",
        F.when(health > HEALTH_TREND, "Improving")
        .when(health < -HEALTH_TREND, "Declining")
        .otherwise("Stable")
        .alias("health_text"),
        F.when(duration < -DURATION_TREND, "Getting Faster")
        .when(duration > DURATION_TREND, "Getting Slower")
        .otherwise("Consistent")
        .alias("duration_text"),
    )


def grade(value: Column, good: float, fair: float, lower_is_better: bool = False) -> Column:
    if lower_is_better:
        return F.when(value < good, "good").when(value < fair, "fair").otherwise("poor")
    return F.when(value > good, "good").when(value > fair, "fair").otherwise("poor")


def grades(rollup: DataFrame) -> DataFrame:
    """Grades of health (80/60), success rate (90/70) and duration (2/5)."""
    return rollup.select(
        "*",
        grade(F.col("avg_health"), 80, 60).alias("health_grade"),
        grade(F.col("success_rate"), 90, 70).alias("success_grade"),
        grade(F.col("avg_duration"), 2, 5, lower_is_better=True).alias("duration_grade"),
    )


def load_rollup(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.avg("throughput_rows_sec").alias("average_throughput"),
        F.max("actual_rows").alias("max_chunk_size"),
        F.min("mem_per_row").alias("min_memory_per_row"),
        F.max(F.coalesce("cpu_percent", F.lit(0.0))).alias("max_cpu_usage"),
        F.sum("load_time_sec").alias("total_processing_time"),
    )


def growth_guard(chunks: DataFrame, target_mb: float, cpu_limit: float = 85.0) -> DataFrame:
    """Whether chunk size may grow: throughput near the mean of the last three, RAM and CPU low.

    Chunks are numbered in the order of ``idx``, which may have gaps, and looked at in stretches of
    ``STRETCH`` numbers; the last two rows of a stretch are repeated in front of the next.
    """
    chunks = _numbered(chunks, "idx", "__nth")
    own = F.expr(f"__nth div {STRETCH}")
    both = F.when(F.col("__nth") % STRETCH >= STRETCH - 2, F.array(own, own + 1)).otherwise(F.array(own))
    last_three = Window.partitionBy("__stretch").orderBy("__nth").rowsBetween(-2, 0)
    ranked = (
        chunks.withColumn("__stretch", F.explode(both))
        .withColumn("recent", F.avg("throughput_rows_sec").over(last_three))
        .where(F.col("__stretch") == own)
    )
    may_grow = (
        (F.col("__nth") >= 3)
        & (F.col("throughput_rows_sec") > F.col("recent") * 0.9)
        & (F.col("ram_usage_mb") < F.lit(target_mb * 0.8))
        & (F.col("cpu_percent") < cpu_limit)
    )
    return ranked.select(
        "idx", "throughput_rows_sec", "recent", may_grow.alias("may_grow")
    )
