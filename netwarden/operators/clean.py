"""Cleaning of flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.functions.values import clean_token, safe_cast
from netwarden.plans.scale import stage

# Bounds outside which a row is dropped, feature count, padding name, null share.
MAX_VALUE, MIN_VALUE = 1e6, -1e6
FEATURE_COUNT = 20
PADDING = "synthetic_feature_"
MAX_NULL_SHARE = 0.9


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def fill_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.fill(0, subset=features)


def null_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, null_share)`` from one aggregate."""
    names = columns or df.columns
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    return shares.unpivot([], names, "column", "null_share")


def drop_sparse_columns(df: DataFrame, limit: float = MAX_NULL_SHARE) -> DataFrame:
    """Drop columns that are null in more than ``limit`` of the rows."""
    sparse = [r["column"] for r in null_shares(df).where(F.col("null_share") > limit).collect()]
    return df.drop(*sparse)


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row per distinct row; nulls equal each other. Equal rows collapse map-side."""
    return df.dropDuplicates()


def to_numeric(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    """Text columns as numbers; missing tokens and unparsable cells become NULL."""
    return df.withColumns({c: safe_cast(F.col(c), kind) for c in columns})


def conversion_counts(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    """Per column: cells that hold text which is not a number."""
    failed = [
        F.count_if(clean_token(F.col(c)).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c)
        for c in columns
    ]
    return df.agg(*failed).unpivot([], columns, "column", "failed_cells")


def in_range(features: list[str], low: float = MIN_VALUE, high: float = MAX_VALUE) -> Column:
    """All features within the bounds; the bounds themselves are allowed."""
    return reduce(lambda a, b: a & b, [F.col(c).between(low, high) for c in features])


def clean(
    df: DataFrame,
    features: list[str],
    label: str = "Label",
    low: float = MIN_VALUE,
    high: float = MAX_VALUE,
    keep_extreme: bool = False,
) -> DataFrame:
    """Cast, de-duplicate, fill feature nulls, require the label, drop extreme rows.

    Equal rows are grouped with their count, and the row tests mention the count. That keeps
    them above the grouping: pushed below it they would parse every text cell again, several
    times over, to save shuffling the few rows they drop.
    """
    columns = [*features, label]
    grouped = to_numeric(df.select(*columns), columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast("float")) for c in features}
    wanted = F.col(label).isNotNull()
    if not keep_extreme:
        wanted = reduce(lambda a, b: a & b, [v.between(low, high) for v in filled.values()], wanted)
    kept = grouped.where(F.when(F.col("__n") > 0, wanted))
    return kept.select(*[v.alias(c) for c, v in filled.items()], label)


def cleaning_report(
    df: DataFrame,
    features: list[str],
    label: str = "Label",
    low: float = MIN_VALUE,
    high: float = MAX_VALUE,
) -> DataFrame:
    """Counts of every cleaning step from one grouping of equal rows.

    Equal rows are grouped once with their multiplicity, so totals before and after
    duplicate removal come from the same pass.
    """
    columns = [*features, label]
    failed = reduce(
        lambda a, b: a + b,
        [
            (clean_token(F.col(c)).isNotNull() & F.col(c).try_cast("float").isNull()).cast("long")
            for c in columns
        ],
    )
    cast_rows = to_numeric(df.select(*columns).withColumn("__failed", failed), columns)
    grouped = cast_rows.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__failed").alias("__failed")
    )
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    feature_nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in features])
    labelled = F.col(label).isNotNull()
    inside = reduce(
        lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0.0)).between(low, high) for c in features]
    )
    counts = grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("original"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"),
        F.count_if(any_null).alias("rows_with_null"),
        F.coalesce(F.sum(feature_nulls), F.lit(0)).alias("feature_nulls"),
        F.count_if(~labelled).alias("label_nulls"),
        F.count_if(labelled & ~inside).alias("invalid_values"),
        F.coalesce(F.sum("__failed"), F.lit(0)).alias("failed_conversions"),
        F.count_if(labelled & inside).alias("cleaned"),
    )
    share = F.try_divide(F.col("cleaned").cast("double"), F.col("original").cast("double")) * 100
    return counts.withColumn("clean_percent", share).withColumn(
        "flag",
        F.when(F.col("clean_percent") < 30, "critical").when(F.col("clean_percent") < 50, "low").otherwise("ok"),
    )


def select_and_pad(df: DataFrame, wanted: list[str], target: int = FEATURE_COUNT) -> DataFrame:
    """Exactly ``target`` feature columns: the first ones present, then zero padding."""
    present = [c for c in wanted if c in df.columns][:target]
    padding = [F.lit(0.0).alias(f"{PADDING}{i}") for i in range(target - len(present))]
    return df.select(*present, *padding)


def reorder(df: DataFrame, model_columns: list[str], fill: float = 0.0) -> DataFrame:
    """The model's columns in the model's order; absent ones are constant. Works on streams."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in model_columns]
    )


def repair(df: DataFrame, features: list[str], method: str = "clip") -> DataFrame:
    """Replace NaN, infinite and missing cells by 0.5, then clip or rescale all cells together."""
    finite = {
        c: F.when(
            F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(0.5)
        ).otherwise(F.col(c))
        for c in features
    }
    fixed = df.withColumns(finite)
    if method == "clip":
        return fixed.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in features})
    cells = fixed.select(F.explode(F.array(*features)).alias("v"))
    if method == "normalize":
        s = cells.agg(F.struct(F.min("v").alias("shift"), (F.max("v") - F.min("v")).alias("scale"))).scalar()
    elif method == "standardize":
        s = cells.agg(F.struct(F.avg("v").alias("shift"), F.stddev_pop("v").alias("scale"))).scalar()
    else:
        raise ValueError(f"unknown repair method: {method}")
    return fixed.withColumns(
        {
            c: F.when(s["scale"] > 0, (F.col(c) - s["shift"]) / s["scale"]).otherwise(F.col(c))
            for c in features
        }
    )


def class_count(df: DataFrame, label: str = "Label") -> DataFrame:
    """Number of classes and whether there are enough to train on."""
    return df.agg(F.count_distinct(label).alias("classes")).withColumn("ok", F.col("classes") >= 2)


def require_classes(df: DataFrame, label: str = "Label", least: int = 2) -> DataFrame:
    """``df`` itself, or an error if it has fewer than ``least`` classes."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct().limit(least).count()
    if found < least:
        raise ValueError(f"need at least {least} classes, found {found}")
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def column_sets(df: DataFrame, required: list[str]) -> dict[str, list[str]]:
    """Required columns that are present, and those that are missing, in the required order."""
    present = set(df.columns)
    return {
        "present": [c for c in required if c in present],
        "missing": [c for c in required if c not in present],
    }


def stage_clean(df: DataFrame, features: list[str], label: str = "Label") -> DataFrame:
    """The cleaned table written once for the many jobs that read it."""
    return stage(clean(df, features, label), "clean")
