"""Flow CSV files: scans, bad lines, schema sampling, validation, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.functions.values import clean_token, safe_cast
from netwarden.plans.scale import stage_path

# What happens to malformed lines, and where they are kept.
BAD_LINES = {"warn": "PERMISSIVE", "skip": "PERMISSIVE", "error": "FAILFAST"}
CORRUPT = "_corrupt_record"


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: list[str] | None = None,
    max_rows: int | None = None,
    bad_lines: str = "warn",
) -> DataFrame:
    """Typed CSV scan. Files split across tasks.

    Whether a line is bad is decided on all its cells, whatever columns are used afterwards:
    the parser only converts columns that are asked for, so a condition asks for all of them.
    """
    reader = spark.read.option("header", True).option("mode", BAD_LINES[bad_lines])
    if bad_lines != "error":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.schema(schema).csv(path)
    # Always true, and not known to be so before the cells are read.
    df = df.where(F.xxhash64(*df.columns) >= F.lit(-(1 << 63)))
    if bad_lines == "skip":
        df = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if columns:
        extra = [CORRUPT] if bad_lines == "warn" else []
        df = df.select(*columns, *extra)
    return df.limit(max_rows) if max_rows else df


def bad_line_counts(df: DataFrame) -> DataFrame:
    """Good and malformed lines of a scan made with ``bad_lines='warn'``, and filled cells by column."""
    bad = F.col(CORRUPT).isNotNull()
    return df.agg(
        F.count_if(~bad).alias("good_lines"),
        F.count_if(bad).alias("bad_lines"),
        *[F.count(c).alias(f"filled_{c}") for c in df.columns if c != CORRUPT],
    )


def parse_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing-value tokens to NULL, then typed; unparsable cells become NULL as well."""
    return df.select(
        *[
            (safe_cast(F.col(c), types[c]) if c in types else clean_token(F.col(c))).alias(c)
            for c in df.columns
        ]
    )


def sampled_schema(spark: SparkSession, path: str, rows: int = 50_000, feature_type: str | None = None) -> T.StructType:
    """Column types inferred from the leading rows only; numeric ones optionally forced.

    The header line is read separately because only a slice of the lines reaches the parser.
    """
    lines = spark.read.text(path).limit(rows + 1)
    inferred = spark.read.option("header", True).option("inferSchema", True).csv(
        _leading_file(lines)
    )
    fields = []
    for field in inferred.schema.fields:
        numeric = isinstance(field.dataType, T.NumericType)
        kind = T.FloatType() if numeric and feature_type == "float" else field.dataType
        fields.append(T.StructField(field.name, kind))
    return T.StructType(fields)


def _leading_file(lines: DataFrame) -> str:
    """The leading lines as one small file in the shared folder (bounded by the sample size)."""
    path = stage_path(lines.sparkSession, "head")
    lines.coalesce(1).write.text(path)
    return path


def row_count(df: DataFrame) -> int:
    return df.count()


def list_datasets(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Matching files with size, sorted by path; file contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return found.select("path", "length").orderBy("path")


def validate(df: DataFrame, required: list[str], size_bytes: int | None = None, min_bytes: int = 1) -> DataFrame:
    """Structure checks of a table as ``(check, passed, detail)``."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    blank = [c for c in df.columns if not c.strip()]
    checks = [
        ("header", bool(df.columns) and not blank, f"{len(df.columns)} columns"),
        ("columns", len(df.columns) >= 2, f"{len(df.columns)} of at least 2"),
        ("required", not missing, "missing: " + ",".join(missing) if missing else "all present"),
    ]
    if size_bytes is not None:
        checks.append(("size", size_bytes >= min_bytes, f"{size_bytes} bytes"))
    static = spark.createDataFrame(checks, "check string, passed boolean, detail string")
    rows = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows").alias("check"),
        (F.col("n") > 0).alias("passed"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"),
    )
    return static.unionByName(rows)
