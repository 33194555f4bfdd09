"""Fitted encodings: dictionaries, one-hot columns, scaling, and the whole preprocessing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.operators.clean import FEATURE_COUNT, PADDING, drop_null_rows
from netwarden.plans.scale import lookup, pin_small, running_totals, stage

# Target range of the scaler, address columns, label column.
SCALE_LOW, SCALE_HIGH = 0.1, 0.9
ADDRESS_COLUMNS = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]
LABEL = "Label"


def _dictionary(values: DataFrame) -> DataFrame:
    """Codes for distinct ``(value, rows)``."""
    small = pin_small(values)
    if small is not values:
        found = sorted((r["value"], r["rows"]) for r in small.collect())
        coded = [(value, code, rows) for code, (value, rows) in enumerate(found)]
        return values.sparkSession.createDataFrame(coded, "value string, code long, rows long")
    ranked = running_totals(values.withColumn("one", F.lit(1).cast("long")), ["value"], {"one": "rank"})
    return stage(ranked.select("value", (F.col("rank") - 1).alias("code"), "rows"), "dictionary")


def fit_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, code, rows)`` with codes 0.. in sorted order of the distinct values."""
    values = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return _dictionary(stage(values, "values"))


def encode(df: DataFrame, column: str, dictionary: DataFrame, target: str | None = None) -> DataFrame:
    """Replace a column by its dictionary code; unseen values get the next free code."""
    size = dictionary.count()
    codes = dictionary.select(F.col("value").alias("__value"), F.col("code").alias("__code"), "rows")
    out = lookup(df.withColumn("__value", F.col(column).cast("string")), codes, ["__value"], "rows", "left")
    return out.withColumn(target or column, F.coalesce(F.col("__code"), F.lit(size)).cast("long")).drop(
        "__value", "__code"
    )


def categories(df: DataFrame, columns: list[str], most: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values per column, or the first ``most`` of all columns together.

    Values become column names; whoever takes the leading columns only needs no more than those.
    ``one_hot_vectors`` serves columns with very many values.
    """
    found: dict[str, list[str]] = {}
    for c in columns:
        values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
        if most is not None:
            values = values.orderBy("v").limit(max(most, 0))
        found[c] = sorted(r["v"] for r in values.collect())
        most = None if most is None else most - len(found[c])
    return found


def one_hot(df: DataFrame, values: dict[str, list[str]], keep: bool = False) -> DataFrame:
    """One 0/1 column ``column_value`` per category; unseen values give zeros everywhere."""
    hot = {
        f"{c}_{v}": F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0)
        for c, vs in values.items()
        for v in vs
    }
    out = df.withColumns(hot) if hot else df
    return out if keep else out.drop(*values)


def one_hot_vectors(df: DataFrame, column: str, dictionary: DataFrame, target: str) -> DataFrame:
    """``target``: a sparse vector with a one at the value's code, for any number of values.

    One place more than the dictionary has stands for unseen and missing values.
    """
    last = df.sparkSession.createDataFrame([(dictionary.count(),)], "__code_of long")
    encoder = OneHotEncoder(inputCol="__code_of", outputCol=target, dropLast=False).fit(last)
    return encoder.transform(encode(df, column, dictionary, "__code_of")).drop("__code_of")


def label_codes(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Label column replaced by its code in the global sorted order."""
    return encode(df, label, fit_dictionary(df, label))


def fit_min_max(df: DataFrame, features: list[str]) -> DataFrame:
    """Artifact table ``(feature, ord, kind, data_min, data_max)`` from one aggregate."""
    bounds = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(features)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(i).alias("ord"),
                F.lit("minmax").alias("kind"),
                F.col(f"lo_{i}").cast("double").alias("data_min"),
                F.col(f"hi_{i}").cast("double").alias("data_max"),
            )
            for i, c in enumerate(features)
        ]
    )
    return bounds.select(F.explode(rows).alias("r")).select("r.*")


def min_max_column(value: Column, low: float, high: float) -> Column:
    """Fitted scaling into [0.1, 0.9]; a constant column maps to 0.1."""
    span = high - low
    factor = (SCALE_HIGH - SCALE_LOW) / (span if span else 1.0)
    return value * F.lit(factor) + F.lit(SCALE_LOW - low * factor)


def scale(df: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Apply fitted bounds (one row per feature). Works on streams."""
    fitted = {r["feature"]: r for r in artifacts.collect()}
    return df.withColumns(
        {
            c: min_max_column(F.col(c), r["data_min"], r["data_max"])
            for c, r in fitted.items()
            if c in df.columns and r["data_min"] is not None
        }
    )


def fit_standard(df: DataFrame, features: list[str]) -> DataFrame:
    """One row ``(fitted)`` with the mean and the population deviation of each feature."""
    parts = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"f{i}") for i, c in enumerate(features)]
    return df.agg(F.struct(*parts).alias("fitted"))


def standard_scale(df: DataFrame, features: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit population deviation; constant columns become 0.

    ``fitted`` comes from ``fit_standard`` on the training rows; without it ``df`` is fitted itself.
    """
    values = (fit_standard(df, features) if fitted is None else fitted).scalar()

    def cell(i: int, c: str) -> Column:
        one = values[f"f{i}"]
        return (F.col(c) - one["m"]) / F.when(one["s"] > 0, one["s"]).otherwise(1.0)

    return df.withColumns({c: cell(i, c) for i, c in enumerate(features)})


@dataclass
class Preprocessing:
    """What fitting learns; each part is a DataFrame or a short list of names."""

    addresses: dict[str, DataFrame]
    labels: DataFrame
    one_hot: dict[str, list[str]]
    features: list[str]
    bounds: DataFrame


def _encoded(df: DataFrame, addresses, labels, hot, label: str) -> DataFrame:
    rows = encode(drop_null_rows(df), label, labels)
    for c, dictionary in addresses.items():
        rows = encode(rows, c, dictionary)
    return one_hot(rows, hot)


def _values(rows: DataFrame, texts: list[str]) -> DataFrame:
    """``(column, value, rows)`` of all text columns from one scan and one grouping."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in texts])
    counted = (
        rows.select(F.explode(cells).alias("cell"))
        .groupBy("cell.column", "cell.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return pin_small(stage(counted, "values"))


def fit_preprocessing(df: DataFrame, label: str = LABEL, target: int = FEATURE_COUNT) -> Preprocessing:
    """Fit dictionaries, categories and bounds on all rows of the training table, in two scans.

    The bounds of codes and of 0/1 columns follow from the values: codes run from 0 without gaps, and a
    0/1 column is constant only where all rows share its value.
    """
    rows = drop_null_rows(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != label]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != label]
    values = _values(rows, [*texts, label])
    ranges = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{name}_{i}") for i, c in enumerate(numbers) for name, f in (("lo", F.min), ("hi", F.max))],
    ).first()

    def of(column: str) -> DataFrame:
        return values.where(F.col("column") == column).select("value", "rows")

    addresses = {c: _dictionary(of(c)) for c in ADDRESS_COLUMNS if c in texts}
    bounds = {c: (ranges[f"lo_{i}"], ranges[f"hi_{i}"]) for i, c in enumerate(numbers)}
    for c, dictionary in addresses.items():
        size = dictionary.count()
        bounds[c] = (0, size - 1) if size else (None, None)
    # Later columns would be cut off, so no more values are looked at.
    room = target - len(bounds)
    hot: dict[str, list[str]] = {}
    for c in [c for c in texts if c not in addresses]:
        found = of(c).orderBy("value").limit(max(room, 0)).collect()
        hot[c] = [r["value"] for r in found]
        bounds |= {f"{c}_{r['value']}": (float(r["rows"] == ranges["rows"]), 1.0) for r in found}
        room -= len(found)
    features = list(bounds)[:target]
    features += [f"{PADDING}{i}" for i in range(target - len(features))]
    fitted = []
    for i, c in enumerate(features):
        low, high = bounds.get(c, (0.0, 0.0) if ranges["rows"] else (None, None))
        fitted.append((c, i, "minmax", None if low is None else float(low), None if high is None else float(high)))
    artifacts = df.sparkSession.createDataFrame(
        fitted, "feature string, ord int, kind string, data_min double, data_max double"
    )
    return Preprocessing(addresses, _dictionary(of(label)), hot, features, artifacts)


def transform_preprocessing(df: DataFrame, fitted: Preprocessing, label: str = LABEL) -> DataFrame:
    """Exactly the fitted feature columns, scaled, plus the label code."""
    rows = _encoded(df, fitted.addresses, fitted.labels, fitted.one_hot, label)
    present = [c for c in fitted.features if c in rows.columns]
    padding = [F.lit(0.0).alias(c) for c in fitted.features if c not in rows.columns]
    return scale(rows.select(*present, *padding, label), fitted.bounds).select(*fitted.features, label)
