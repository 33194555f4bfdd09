"""Lines that many documents share: range-partitioned hashes, sorted by document and position.

Each line becomes ``(hash, document, position)`` without its text. The rows are range-partitioned by
hash *and* document, so a line that a third of the documents share spreads over many tasks, and
sorted by position inside. The first occurrence in a document streams out of that order and is summed
per hash, partial sums first. What returns per document is a run-length bitmap of the lines to keep.

Lines are equal if 96 hash bits are: among a billion different lines a false match has a chance of about
1 in 10 to the 11th. A document is known by its id and the hash of its text. Defined cases: a null or empty text is one
empty line; a key is the line without ASCII white space at both ends, A-Z in lower case, and empty
keys are never dropped; equal rows count as one document and get the same answer; null ids are ids
like any other; an empty table gives an empty result; columns besides id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import SPACES, ascii_lower, wrapped
from netwarden.plans.scale import stage

MIN_DOCS = 10


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(h1, h2, id, t, pos)`` of every line with a key; two hashes make 96 bits."""
    lines = docs.select(
        F.col(row_id).alias("id"),
        F.xxhash64(text).alias("t"),
        F.posexplode(_lines(ascii_lower(F.col(text)))).alias("pos", "line"),
    )
    key = F.btrim("line", F.lit(SPACES))
    keyed = lines.where(key != "").select(
        F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"), "id", "t", "pos"
    )
    return keyed


def keep_bitmaps(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    keep_first: bool = False,
) -> DataFrame:
    """``(id, t, runs)`` of every document that loses lines.

    ``runs`` are lengths of alternating runs of kept and dropped lines, beginning with kept ones,
    up to the last dropped line; the lines after it are kept. With ``keep_first`` the first
    occurrence of a line, by document and position, stays.
    """
    rows = stage(line_rows(docs, row_id, text), "lines")
    ranged = rows.repartitionByRange("h1", "h2", "id", "t").sortWithinPartitions("h1", "h2", "id", "t", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "id", "t").orderBy("pos"))
    firsts = ranged.withColumn("nth", nth).where("nth = 1")
    counted = firsts.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "t", "pos")).alias("first")
    )
    common = stage(counted.where(F.col("docs") >= min_docs).drop("docs"), "common")
    met = rows.join(common, ["h1", "h2"])
    if keep_first:
        met = met.where(~F.struct("id", "t", "pos").eqNullSafe(F.col("first")))
    lost = met.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    lost_at = F.col("lost")
    begins = F.filter(lost_at, lambda p, i: (i == 0) | (F.get(lost_at, i - 1) != p - 1))
    ends = F.filter(lost_at, lambda p, i: (i == F.size(lost_at) - 1) | (F.get(lost_at, i + 1) != p + 1))
    bounded = lost.select("id", "t", begins.alias("begins"), ends.alias("ends"))
    runs = F.flatten(
        F.transform(
            "begins",
            lambda b, i: F.array(
                b - F.when(i == 0, 0).otherwise(F.get(F.col("ends"), i - 1) + 1),
                F.get(F.col("ends"), i) - b + 1,
            ),
        )
    )
    return bounded.select("id", "t", runs.alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The kept lines of ``text``, joined again."""
    marks = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    stays = F.filter(
        F.arrays_zip(_lines(text).alias("line"), marks.alias("mark")),
        lambda x: x["line"].isNotNull() & F.coalesce(x["mark"], F.lit(True)),
    )
    return F.array_join(F.transform(stays, lambda x: x["line"]), "\n")


def with_bitmaps(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(row, runs)``: each row of ``docs`` as a struct; ``runs`` is null where nothing is lost."""
    maps = keep_bitmaps(docs, row_id, text, **how)
    met = F.col(f"row.{row_id}").eqNullSafe(F.col("id")) & (F.xxhash64(f"row.{text}") == F.col("t"))
    return wrapped(docs).join(maps, met, "left").select("row", "runs")


def dropped_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(row_id, n_lines, n_dropped, kept)`` per row of ``docs``; ``kept`` is the text of the lines that stay."""
    whole = F.col(f"row.{text}")
    # Every second run is dropped.
    lost = F.aggregate(
        F.filter("runs", lambda n, i: i % 2 == 1), F.lit(0).cast("int"), lambda a, n: a + n
    )
    marked = with_bitmaps(docs.select(row_id, text), row_id, text, **how)
    return marked.select(
        F.col(f"row.{row_id}"),
        F.size(_lines(whole)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), F.coalesce(whole, F.lit("")))
        .otherwise(kept_text(whole, F.col("runs")))
        .alias("kept"),
    )


def without_common_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the common lines cut out of ``text`` and ``n_chars`` brought up to date."""
    untouched = F.col("runs").isNull()
    cut = with_bitmaps(docs, **how).withColumn(
        "cut", F.when(untouched, F.col("row.text")).otherwise(kept_text(F.col("row.text"), F.col("runs")))
    )
    new = {
        "text": F.col("cut"),
        "n_chars": F.when(untouched, F.col("row.n_chars"))
        .otherwise(F.length("cut"))
        .cast(docs.schema["n_chars"].dataType),
    }
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
