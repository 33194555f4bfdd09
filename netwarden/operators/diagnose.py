"""Robustness and diagnostics. Rows have ``id`` and ``x``; models are lists of ``Dense`` layers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.functions.values import argmax
from netwarden.operators.clean import repair
from netwarden.operators.score import Dense, run_layers, score
from netwarden.plans.scale import exact_quantiles, hash_unit

# Noise level, strong perturbation of every fifth feature, valid range, report size.
NOISE, STRONG, STRONG_EVERY = 0.1, 0.5, 5
LOW, HIGH = 0.1, 0.9
TOP_FEATURES = 10


def perturbed(x: Column, row_id: Column, noise: float = NOISE, seed: str = "adv") -> Column:
    """Gaussian noise on every cell, a uniform shift on every fifth, clipped to the valid range."""

    def cell(v: Column, i: Column) -> Column:
        # Box-Muller: two uniforms make one normal draw; 1 - u keeps the logarithm finite.
        radius = F.sqrt(-2 * F.ln(1 - hash_unit(f"{seed}1", row_id, i)))
        normal = radius * F.cos(F.lit(2 * math.pi) * hash_unit(f"{seed}2", row_id, i))
        shift = (hash_unit(f"{seed}3", row_id, i) - 0.5) * (2 * STRONG)
        moved = v + normal * noise + F.when(i % STRONG_EVERY == 0, shift).otherwise(0.0)
        return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), moved))

    return F.transform(x, cell)


def robustness(rows: DataFrame, layers: list[Dense], noise: float = NOISE) -> DataFrame:
    """Attack rate and confidence, clean against perturbed; both scored in the same row."""
    both = rows.select("id", "x", perturbed(F.col("x"), F.col("id"), noise).alias("y"))
    clean = score(both, layers).withColumnRenamed("probs", "clean").drop("logits", "prob")
    out = score(clean, layers, "y")
    rate = lambda c: F.avg(argmax(F.col(c)))
    return out.agg(
        rate("clean").alias("clean_attack_rate"),
        rate("probs").alias("adversarial_attack_rate"),
        (rate("probs") - rate("clean")).alias("rate_change"),
        F.avg(F.array_max("probs") - F.array_max("clean")).alias("confidence_change"),
    )


def profile(rows: DataFrame) -> DataFrame:
    """Statistics over all cells."""
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = F.when(finite, v)
    return rows.select(F.explode("x").alias("v")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.min(ok).alias("min"),
        F.max(ok).alias("max"),
        F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("std"),
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"),
        F.count_if(v == 0).alias("zero_count"),
        F.count_distinct(v).alias("distinct_values"),
    )


def probes(spark: SparkSession, width: int, seed: str = "probe") -> DataFrame:
    """Fixed input patterns, and uniform and normal random ones, as ``case, n, x``."""
    ones = lambda v: F.array_repeat(F.lit(float(v)), width)
    half = width // 2

    def drawn(low: float, high: float) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.lit(low) + hash_unit(seed, F.col("n"), i) * (high - low),
        )

    normal = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: 0.5
        + 0.1
        * F.sqrt(-2 * F.ln(1 - hash_unit(f"{seed}1", F.col("n"), i)))
        * F.cos(F.lit(2 * math.pi) * hash_unit(f"{seed}2", F.col("n"), i)),
    )
    alternating = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i % 2).cast("double"))
    halves = lambda a, b: F.concat(F.array_repeat(F.lit(a), half), F.array_repeat(F.lit(b), width - half))
    cases = [
        ("zeros", 1, ones(0)), ("ones", 1, ones(1)), ("small", 1, ones(0.1)), ("half", 1, ones(0.5)),
        ("large", 1, ones(0.9)), ("random_normal", 1, normal), ("random_low", 5, drawn(0.0, 0.3)),
        ("random_high", 5, drawn(0.7, 1.0)), ("low_then_high", 1, halves(0.0, 1.0)),
        ("high_then_low", 1, halves(1.0, 0.0)), ("alternating", 1, alternating),
    ]
    out = None
    for name, count, x in cases:
        part = spark.range(count).select(F.lit(name).alias("case"), F.col("id").alias("n")).withColumn("x", x)
        out = part if out is None else out.unionByName(part)
    return out


def probe_report(scored: DataFrame) -> DataFrame:
    """Class, confidence, range and health of scored probes."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return scored.select(
        "case",
        "n",
        F.when(argmax(F.col("probs")) == 1, "Attack").otherwise("Normal").alias("predicted"),
        F.array_max("probs").alias("confidence"),
        F.array_min("logits").alias("low"),
        F.array_max("logits").alias("high"),
        (~F.exists("logits", bad)).alias("success"),
    )


def _softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _impacts(layers: list[Dense]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.array(rows["x"].tolist(), dtype=float)
            base = _softmax_rows(run_layers(layers, x))[:, 1]
            totals = []
            for f in range(x.shape[1]):
                kept = x[:, f].copy()
                change = np.zeros(len(x))
                for value in (0.0, 1.0):
                    x[:, f] = value
                    change = np.maximum(change, np.abs(_softmax_rows(run_layers(layers, x))[:, 1] - base))
                x[:, f] = kept
                totals.append(change.sum())
            yield pd.DataFrame({"feature": range(x.shape[1]), "total": totals, "n": len(x)})

    return run


def importance(rows: DataFrame, layers: list[Dense], top: int = TOP_FEATURES) -> DataFrame:
    """Mean over rows of the largest change of P(attack) when a feature is set to 0 or 1.

    A batch sends one sum per feature, not one row per row and feature.
    """
    sums = rows.select("x").mapInPandas(_impacts(layers), "feature int, total double, n long")
    return (
        sums.groupBy("feature")
        .agg((F.sum("total") / F.sum("n")).alias("impact"))
        .orderBy(F.desc("impact"), "feature")
        .limit(top)
    )


def choose_repair(rows: DataFrame, features: list[str], layers: list[Dense], sample: int | None = None) -> DataFrame:
    """First input repair for which every output is finite: ``method, ord, clean, chosen``."""
    tested = rows.limit(sample) if sample else rows
    variants = [("original", tested)] + [
        (m, repair(tested, features, m)) for m in ("clip", "normalize", "standardize")
    ]
    out = None
    for order, (name, df) in enumerate(variants):
        scored = score(df.select(F.array(*features).alias("x")), layers)
        bad = F.exists("logits", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        one = scored.agg(F.coalesce(F.bool_and(~bad), F.lit(False)).alias("clean")).select(
            F.lit(name).alias("method"), F.lit(order).alias("ord"), "clean"
        )
        out = one if out is None else out.unionByName(one)
    best = out.agg(F.min(F.when(F.col("clean"), F.col("ord")))).scalar()
    return out.withColumn("chosen", F.coalesce(F.col("ord") == best, F.lit(False)))


def latency(rows: DataFrame) -> DataFrame:
    """Latency per batch size from ``batch, ms``; the 95th percentile is exact and interpolated."""
    stats = rows.groupBy("batch").agg(
        F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("std"), F.min("ms").alias("min"), F.max("ms").alias("max")
    )
    p95 = exact_quantiles(rows, "ms", [0.95], by=["batch"]).withColumnRenamed("q_0", "p95")
    per_second = F.try_divide(F.col("batch") * 1000.0, F.col("mean"))
    return stats.join(p95, "batch").withColumn("rows_per_sec", per_second)
