"""SimHash near-duplicates: pivot distance tables discard pairs before exact comparison.

Every distinct fingerprint gets a row of the pivot table: its Hamming distances to a fixed set
of reference fingerprints. By the triangle inequality two fingerprints within ``max_bits`` differ
by at most ``max_bits`` in every coordinate, so a pair whose largest coordinate difference is
greater is discarded unseen, and only survivors are compared bit by bit.

Pairs are only looked at where they can be close: the 64 bits are cut into ``max_bits + 6`` parts,
and close fingerprints agree in all but ``max_bits`` of them. Such a bucket differs in few bits and
holds each fingerprint once, so its size is bounded by the parts, not by the data; copies of a
text never meet as rows. Within a bucket rows are sorted by their first pivot distance and
compared only inside a window of ``max_bits``.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows
are kept, each with the same answer; null ids are ignored when the smallest id is chosen; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.common import connected, wrapped
from netwarden.plans.scale import stage

SHINGLE = 3
MAX_BITS = 2
# Reference fingerprints of the pivot table: digests of their numbers. Sixteen fill two longs.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(16)]
# Shingles whose bits are counted at once, so that a very long text needs no more memory.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the XXH64 hashes of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        if len(words) < shingle:
            grams = [words]
        else:
            grams = zip(*(part[k:] for k in range(shingle)))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(row_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    rows = docs.select(F.col(row_id), F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([docs.schema[row_id], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], [row_id, "fp"])

    return rows.mapInArrow(run, schema)


def _part_masks(max_bits: int) -> list[int]:
    """One mask per choice of parts that may differ, covering all the other parts' bits."""
    parts = max_bits + 6
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    whole = (1 << 64) - 1
    return [whole ^ sum(free) for free in combinations(masks, max_bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(fps: DataFrame) -> DataFrame:
    """``(fp, near, far)``: distances to the pivots, one per byte, the first in the highest byte of ``near``."""

    def packed(pivots: list[int]) -> Column:
        out = F.lit(0).cast("long")
        for p in pivots:
            out = F.shiftleft(out, 8) + F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))
        return out

    return fps.select("fp", packed(PIVOTS[:8]).alias("near"), packed(PIVOTS[8:]).alias("far"))


def close_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: all pairs of distinct fingerprints that differ in 1 to ``max_bits`` bits, perhaps repeated."""
    masks = _part_masks(max_bits)
    buckets = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]
    rows = pivot_table(fps).select(F.explode(F.array(*buckets)).alias("bucket"), "fp", "near", "far")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "near")

    def compare(bucket, fp, table):
        """Pairs in this stretch, shift by shift: each row against the next, the one after, and so on."""
        first = table[:, 0]
        for shift in range(1, len(fp)):
            same = bucket[shift:] == bucket[:-shift]
            at = np.flatnonzero(same & (first[shift:] - first[:-shift] <= max_bits))
            if not len(at):
                return
            table_gap = np.abs(table[at + shift] - table[at]).max(axis=1)
            at = at[table_gap <= max_bits]
            a, b = fp[at], fp[at + shift]
            gap = np.bitwise_count((a ^ b).view("<u8"))
            hit = (gap > 0) & (gap <= max_bits)
            yield a[hit], b[hit]

    def run(batches):
        left = None
        for batch in batches:
            new = [batch.column(k).to_numpy() for k in range(4)]
            if left is not None:
                new = [np.concatenate(x) for x in zip(left, new)]
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(new[0], new[0][-1], "left"))
            left = [x[cut:] for x in new]
            yield from emit([x[:cut] for x in new])
        if left is not None:
            yield from emit(left)

    def emit(columns):
        bucket, fp, near, far = columns
        if len(fp) < 2:
            return
        table = np.stack([near, far], axis=1).astype(">i8").view(np.uint8).reshape(len(fp), 16).astype(np.int16)
        for a, b in compare(bucket, fp, table):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(row_id, fp, component)``: the smallest id reachable over fingerprints within ``max_bits``."""
    marked = stage(fingerprints(docs, row_id, text, shingle), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min(row_id).alias("first")), "classes")
    roots = connected(close_pairs(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    joined = classes.join(roots, "fp")
    lowest = joined.groupBy("root").agg(F.min("first").alias("low"))
    linked = stage(joined.join(lowest, "root").select("fp", "low"), "linked")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("low", "first").alias("component"))
    return marked.join(named, "fp").select(row_id, "fp", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id stays.

    Among rows with the same id the text with the smaller hash wins; of equal rows one stays.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    groups = near_duplicates(keyed, "key")
    winners = stage(groups.select(F.col("component").alias("key")).distinct(), "winners")
    key = F.struct(F.col("row.doc_id"), F.xxhash64("row.text").alias("h")).cast(winners.schema["key"].dataType)
    rows = wrapped(docs).withColumn("key", key)
    # Joined and reduced by the same key, so that texts are shuffled once.
    return rows.join(winners, "key").dropDuplicates(["key"]).select("row.*")
