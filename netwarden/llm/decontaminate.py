"""Benchmark passages inside documents: size-partitioned MinHash containment search, then exact proof.

An item with ``q`` distinct word shingles leaks into a document that holds at least ``threshold`` of
them. Items are partitioned by size; a partition's sketch length ``k`` follows from its largest
possible item: at most ``k - 1`` shingles may be missing, so one of the ``k`` smallest hashes of an
item must occur in every document that leaks it. The search for those minima thus finds every leak,
however long the document, and hands a few candidates to the exact comparison of shingles.

Only the sketches are joined with all documents' shingles. They are written first, so that Spark
knows their size: it broadcasts them below its threshold and shuffles both sides beyond it.

Words are runs of letters and digits in lower case, shingles are five words. Defined cases: an item
with fewer words is one shingle, its whole word sequence; null texts and texts without words neither
leak nor are leaked; items with equal words form a class known by its smallest id; a document is
known by its id and the hash of its text, so equal rows give one answer; null ids stay null; empty
tables give an empty result; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import wrapped
from netwarden.plans.scale import stage

SHINGLE = 5
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(pieces, lambda w: w != "")


def _shingles(words: Column, n: int, make) -> Column:
    """``make`` of each run of ``n`` words; null where there are fewer."""
    last = F.size(words) - n
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: make(*[F.get(words, i + k) for k in range(n)]),
        ),
    )


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _need(q: Column, threshold: float) -> Column:
    return F.ceil(F.round(q * F.lit(threshold), 9))


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, class)``: the smallest id of the items with the same words."""
    worded = items.select(F.col(item_id).alias("item"), F.array_join(_words(F.col(text)), " ").alias("w"))
    first = worded.groupBy("w").agg(F.min("item").alias("class"))
    return worded.join(first, "w").select("item", "class")


def _item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item, n, shingles)`` per class: words in a shingle and the distinct shingles."""
    worded = (
        items.select(F.col(item_id).alias("item"), _words(F.col(text)).alias("w"))
        .where(F.size("w") > 0)
        .groupBy("w")
        .agg(F.min("item").alias("item"))
    )
    w = F.col("w")
    whole = F.array(F.array_join("w", " "))
    grams = F.coalesce(_shingles(w, SHINGLE, _text), whole)
    return worded.select("item", F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), F.array_distinct(grams).alias("shingles"))


def _sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``(h, n, item)``: the smallest hashes of each item, as many as its size partition asks for."""
    # Partition by the binary length of the size; its largest size has all bits set.
    sized = items.withColumn("largest", (F.pow(F.lit(2), F.length(F.bin(F.size("shingles")))) - 1).cast("int"))
    k = F.col("largest") - _need(F.col("largest"), threshold) + 1
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return sized.select("item", "n", F.explode(F.slice(hashes, F.lit(1), k.cast("int"))).alias("h"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, t, item, n_shingles, n_shared, containment)``: item classes that documents contain."""
    known = stage(_item_shingles(items, item_id, item_text), "items")
    sketches = stage(_sketches(known, threshold), "sketches")
    # One to five values: how many words the shingles of an item have.
    lengths = sorted(r.n for r in known.select("n").distinct().collect())
    keyed = docs.select(F.col(row_id).alias("id"), F.xxhash64(text).alias("t"), _words(F.col(text)).alias("w"))
    if not lengths:
        lengths = [SHINGLE]

    def rows_of(table: DataFrame, make, name: str) -> DataFrame:
        each = [
            table.select(
                "id", "t", F.lit(n).alias("n"), F.explode(_shingles(F.col("w"), n, make)).alias(name)
            )
            for n in lengths
        ]
        return reduce(DataFrame.unionAll, each)

    hashes = rows_of(keyed, lambda *w: F.xxhash64(_text(*w)), "h")
    found = stage(hashes.join(sketches, ["n", "h"]).select("id", "t", "item").distinct(), "candidates")
    holders = stage(found.select("id", "t").distinct(), "holders").select(
        F.col("id").alias("__id"), F.col("t").alias("__t")
    )
    suspects = keyed.join(
        holders, keyed["id"].eqNullSafe(F.col("__id")) & (keyed["t"] == F.col("__t")), "left_semi"
    ).dropDuplicates(["id", "t"])
    texts = rows_of(suspects, _text, "s").distinct()
    wanted = known.select("item", "n", F.size("shingles").alias("q"), F.explode("shingles").alias("s"))
    shared = texts.join(wanted, ["n", "s"]).groupBy("id", "t", "item", "q").agg(F.count(F.lit(1)).alias("n_shared"))
    proven = shared.where(F.col("n_shared") >= _need(F.col("q"), threshold))
    # Every proven pair was a candidate; the candidates decide which documents are compared.
    return proven.select(
        "id",
        "t",
        "item",
        F.col("q").cast("long").alias("n_shingles"),
        "n_shared",
        (F.col("n_shared") / F.col("q")).alias("containment"),
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    held = stage(leaks(docs, items).select("id", "t").distinct(), "leaks")
    met = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("t"))
    return wrapped(docs).join(held, met, "left_anti").select("row.*")
