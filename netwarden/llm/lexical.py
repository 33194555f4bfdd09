"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

Documents are dealt into shards of about ``SHARD_ROWS``. In a shard every query term has a list of
``(document, contribution)`` with the largest contribution first. The lists of an item are read in
step, a stretch at a time. What has been read of a document is the lower end of its score; the upper
end adds, for every list in which it has not been met, the last contribution read there. A document
whose upper end is below the k-th largest lower end is out. Reading goes on until every document that
is not out has one score only, which settles membership, ties and final scores, and until no unread
document can come near. The best of all shards are then ranked together.

Texts are cut into terms once. A marker term per document carries its length, so document counts, total
length and document frequencies come from the same stored table as the lists. Only terms of items are
shuffled, one row per document and term.

Defined cases: a null or empty text, or one without terms, is no document; an item without known
terms has no result; repeated documents are documents of their own and repeated items count once per
id (the smallest text); null ids take no part; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import ascii_lower, sent
from netwarden.llm.vectors import meet
from netwarden.operators.neighbours import top_per
from netwarden.plans.scale import stage

TOP = 50
SHARD_ROWS = 8192
ITEM_ROWS = 256
# Entries of each list that are read at first; every later stretch is as long as all before.
STRETCH = 128
# Everything that separates terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# No term is empty, so the empty string can mark a document.
MARK = ""
# The score's fixed values: weights in thousandths, impacts scaled, saturation and length share.
WEIGHT, SCALE, SATURATION, SHARE = 1000, 1_000_000_000, 20, 50


def terms(text: Column) -> Column:
    """Maximal runs of letters, digits and everything beyond ASCII, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda t: t != "")


def _wanted(items: DataFrame) -> DataFrame:
    """``(item, term)``, each once."""
    known = items.where(F.col("item").isNotNull()).groupBy("item").agg(F.min("text").alias("text"))
    return stage(known.select("item", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "wanted")


def _counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc, id, n, term_id, tf)`` for the terms of items, and one row per document with the marker."""
    cut = docs.where(F.col("id").isNotNull()).select(
        F.monotonically_increasing_id().alias("doc"), "id", terms(F.coalesce("text", F.lit(""))).alias("t")
    )
    each = cut.where(F.size("t") > 0).select(
        "doc", "id", F.size("t").cast("long").alias("n"), F.explode(F.array_append("t", F.lit(MARK))).alias("term")
    )
    met = each.join(sent(vocabulary), "term")
    return stage(met.groupBy("doc", "id", "n", "term_id").agg(F.count(F.lit(1)).alias("tf")), "counts")


def _resolved(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int):
    """The ``top`` or more documents that may rank among the first, all with their full score.

    ``lists`` hold documents (numbers below ``n_docs``) and contributions, the largest first. Of equal
    scores none is cut: the caller decides by id.
    """
    lower = np.zeros(n_docs, np.int64)
    unseen = np.ones((len(lists), n_docs), bool)
    begin, upto = 0, STRETCH
    longest = max(len(docs) for docs, _ in lists)
    while True:
        for k, (docs, gains) in enumerate(lists):
            lower[docs[begin:upto]] += gains[begin:upto]
            unseen[k, docs[begin:upto]] = False
        # What an unread entry of each list can give at most.
        ahead = np.array([gains[upto - 1] if upto < len(docs) else 0 for docs, gains in lists], np.int64)
        bar = np.partition(lower, -top)[-top] if n_docs > top else 0
        bar = max(int(bar), 1)
        upper = lower + ahead @ unseen
        near = np.flatnonzero(upper >= bar)
        if upto >= longest or (upper[near] == lower[near]).all():
            near = near[lower[near] >= bar]
            return near, lower[near]
        begin, upto = upto, 2 * upto


def _searched(top: int):
    """The best documents of a shard for each item of a part."""

    def compare(data: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])
        if not len(data) or not len(asked):
            return schema.empty_table()
        term, gain = data["term_id"].to_numpy(), data["gain"].to_numpy()
        docs, at = np.unique(data["doc"].to_numpy(), return_inverse=True)
        names = np.empty(len(docs), np.int64)
        names[at] = data["id"].to_numpy()
        order = np.lexsort((at, -gain, term))
        term, gain, at = term[order], gain[order], at[order]
        here, first = np.unique(term, return_index=True)
        ends = np.append(first[1:], len(term))
        place = {t: (at[a:b], gain[a:b]) for t, a, b in zip(here.tolist(), first.tolist(), ends.tolist())}
        of_item: dict[int, list] = {}
        for item, t in zip(asked["item"].to_pylist(), asked["term_id"].to_pylist()):
            if t in place:
                of_item.setdefault(item, []).append(place[t])
        out = []
        for item, lists in of_item.items():
            near, score = _resolved(lists, len(docs), top)
            best = np.lexsort((docs[near], names[near], -score))[:top]
            near, score = near[best], score[best]
            out.append(pa.table([pa.array(np.full(len(near), item)), pa.array(names[near]), pa.array(docs[near]), pa.array(score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return compare


def search(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    row_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """``(item, rank, id, score)``: the ``top`` documents with the highest score above 0 for each item."""
    docs = documents.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = _wanted(items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")))
    mark = wanted.sparkSession.createDataFrame([(MARK, -1)], "term string, term_id long")
    numbered = wanted.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
    vocabulary = stage(numbered.unionByName(mark), "vocabulary")
    counts = _counts(docs, vocabulary)
    marks = counts.where("term_id = -1").agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs, length = marks["N"], marks["L"] or 1
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = (
        counts.where("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
        .select("term_id", weight.alias("w")).where("w > 0")
    )
    size = F.lit(100 - SHARE).cast("long") + F.expr(f"({SHARE}L * n * {n_docs}L) div {length}L")
    impact = F.expr(f"({SCALE}L * tf) div (1000L * tf + {SATURATION}L * m)")
    shards = max(1, math.ceil(n_docs / SHARD_ROWS))
    lists = (
        counts.join(sent(weights), "term_id")
        .withColumn("m", size)
        .select("doc", "id", "term_id", (F.col("w") * impact).alias("gain"))
        .where("gain > 0")
        .withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))
    )
    parts = max(1, math.ceil(wanted.select("item").distinct().count() / ITEM_ROWS))
    asked = wanted.join(vocabulary, "term").select(
        "item", "term_id", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part")
    )
    visits = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = meet(lists, visits, _searched(top), "item long, id long, doc long, score long")
    ranked = top_per(found, ["item"], [F.desc("score"), F.col("id"), F.col("doc")], top)
    return ranked.select("item", "rank", "id", "score")
