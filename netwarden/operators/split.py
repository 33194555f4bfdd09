"""Splits, samples and class weights. Rows carry a unique id; every choice follows its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import hash_unit, index_by_hash, mark_by_hash, pin_small, take_by_hash

# Held-out share and seed.
TEST_SHARE, SEED = 0.2, 42


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _counts(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Counts per class (checked to be few before they become local) and their sum."""
    counts = pin_small(class_counts(df, label))
    return counts, counts.agg(F.sum("n")).first()[0] or 0


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "id", share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """``df`` with ``is_test``: exactly ``round(share * n)`` rows of each class."""
    counts, rows = _counts(df, label)
    quotas = counts.select(label, F.round(F.col("n") * share).cast("long").alias("quota"))
    return mark_by_hash(df, label, row_id, quotas, seed, rows, "is_test")


def stratified_folds(
    df: DataFrame, k: int, label: str = "label", row_id: str = "id", seed: int = SEED
) -> DataFrame:
    """``df`` with ``fold``: classes are dealt out evenly over ``k`` folds."""
    _, rows = _counts(df, label)
    indexed = index_by_hash(df, label, row_id, seed, rows, "__i")
    return indexed.withColumn("fold", (F.col("__i") % k).cast("int")).drop("__i")


def balanced_sample(
    df: DataFrame, n: int, label: str = "label", row_id: str = "id", seed: int = SEED
) -> DataFrame:
    """Equally many rows of both classes, at most ``n`` together, chosen in hash order."""
    counts, rows = _counts(df, label)
    if counts.count() < 2:
        raise ValueError("both classes are needed")
    least = min(counts.agg(F.min("n")).first()[0], n // 2)
    if least == 0:
        raise ValueError("not enough rows of both classes")
    quotas = counts.select(label, F.lit(least).cast("long").alias("quota"))
    return take_by_hash(df, label, row_id, quotas, seed, rows)


def uniform_sample(df: DataFrame, n: int, row_id: str = "id", seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen uniformly without replacement."""
    rows = df.count()
    if rows <= n:
        return df
    quota = df.sparkSession.createDataFrame([(0, n)], "__all int, quota long")
    return take_by_hash(df.withColumn("__all", F.lit(0)), "__all", row_id, quota, seed, rows).drop("__all")


def weighted_sample(
    df: DataFrame, n: int, label: str = "label", row_id: str = "id", seed: int = SEED
) -> DataFrame:
    """``n`` draws with replacement where each row weighs 1 / (size of its class).

    All rows of a class weigh the same and every class weighs 1 in total, so a draw is a
    class and then an index inside it: an equi-join, not a range join over running weights.
    """
    counts, rows = _counts(df, label)
    classes = sorted((r[label], r["n"]) for r in counts.collect())
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.floor(hash_unit(f"{seed}c", F.col("id")) * len(classes)).cast("int").alias("__c"),
        hash_unit(f"{seed}r", F.col("id")).alias("__u"),
    )
    table = df.sparkSession.createDataFrame(
        [(i, c, m) for i, (c, m) in enumerate(classes)],
        f"__c int, {label} {dict(df.dtypes)[label]}, __m long",
    )
    picks = draws.join(table, "__c").select(
        "draw", label, F.floor(F.col("__u") * F.col("__m")).cast("long").alias("__i")
    )
    return index_by_hash(df, label, row_id, seed, rows, "__i").join(picks, [label, "__i"]).drop("__i")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: count, raw weight ``1/n`` and the weight normalised to sum to 1."""
    counts = class_counts(df, label)
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("n")).alias("inv"))).scalar()
    share = total["n"] / total["k"]
    raw = F.lit(1.0) / F.col("n")
    return counts.select(
        label, "n", raw.alias("raw_weight"), (raw * share / (total["inv"] * share)).alias("weight")
    )


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Every row with the weight of its class (a handful of classes, so no shuffle)."""
    return df.join(pin_small(class_weights(df, label).select(label, "weight")), label)
