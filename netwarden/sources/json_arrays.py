"""Files that hold one JSON array of objects each, read in pieces.

A file is cut behind every ``}``, so Spark splits it like a file of lines and no task holds more than its
split. A piece is a whole object if its own quotes and braces close; that is the rule for flat objects.
A file whose pieces do not all parse between one ``[`` at the start and one ``]`` at the end (nested
objects, a brace inside a text, a torn or corrupt file) is read again as one text, which decides
what it holds: the same rows as a reader of whole files gives, none if it is corrupt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.plans.scale import lookup, stage

_PLACE = ["file", "start", "n"]


def _kind(value: Column, items: Column) -> Column:
    """How a piece begins, ``[`` or ``,``, if it is an object; ``]`` at the end of an array; else ``?``."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\\.", ""), r'"[^"]*"', "")
    return (
        F.when(bare.rlike(r"^\s*\]\s*$"), "]")
        .when(bare.rlike(r'^\s*[\[,]\s*\{[^{"]*$') & (F.size(items) == 1), F.substring(F.ltrim(bare), 1, 1))
        .otherwise("?")
    )


def _verdicts(pieces: DataFrame) -> DataFrame:
    """``(file, whole, pieces)``: whether the pieces of a file make up one array of objects."""
    place = F.struct("start", "n")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return pieces.groupBy("file").agg(
        (
            (F.min_by("kind", place) == "[") & (F.max_by("kind", place) == "]")
            & (count("[") == 1) & (count("]") == 1) & (count("?") == 0)
        ).alias("whole"),
        F.count(F.lit(1)).alias("pieces"),
    )


def read_arrays(spark: SparkSession, path: str, element: str) -> DataFrame:
    """``(file, start, n, item)``: the elements of every file's array, those of a file in order of ``(start, n)``.

    ``element`` is the type of an object, ``struct<...>``. A missing path is the caller's error.
    """
    many = f"array<{element}>"
    body = F.regexp_replace("value", r"^\s*[\[,]\s*", "")
    items = F.from_json(F.concat(F.lit("["), body, F.lit("}]")), many)
    pieces = stage(
        spark.read.option("lineSep", "}").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("n"),
            "value",
        )
        .select(*_PLACE, _kind(F.col("value"), items).alias("kind"), items.alias("items")),
        "json-pieces",
    )
    verdicts = stage(_verdicts(pieces), "json-files")
    found = (
        lookup(pieces.where(F.col("kind").isin("[", ",")), verdicts, ["file"], "pieces")
        .where("whole")
        .select(*_PLACE, F.col("items")[0].alias("item"))
    )
    # Paths of files, which the session's own listing holds too.
    other = [r["file"] for r in verdicts.where(~F.col("whole")).select("file").collect()]
    if not other:
        return found
    texts = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(other))
    return found.unionByName(
        texts.select(
            F.col("_metadata.file_path").alias("file"),
            F.lit(0).cast("long").alias("start"),
            F.posexplode(F.from_json("value", many)).alias("n", "item"),
        ).withColumn("n", F.col("n").cast("long"))
    )
