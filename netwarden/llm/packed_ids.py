"""Token ids as Simple-8b words in ordered files.

Four bits of a 64-bit word select how many ids of how many bits fill the other sixty. Ids are packed
greedily: the selector that takes the most of the coming ids wins. A value of more than sixty bits is
an escape: its word holds a place in the block's list of literals. A file record is a block of whole
documents with the offset of every ``STRIDE``-th word, so that a reader may begin at any of them and
decode all words of one selector at once.

Records are Parquet rows, sorted by document, written by Spark wherever the folder lies; a file is one
range of ids. Texts are range-partitioned before they are encoded, so that sampling the range bounds
costs no encoding.

Defined cases: a null or empty text has only the end id; null ids sort first; repeated rows are written
one by one; an empty table gives no records; other columns are not written.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from netwarden.llm.tokens import encoder
from netwarden.plans.scale import stage

# Selector -> (ids in a word, bits of each); fixed by the format. Selector 0 is an escape, 15 a run of zeros.
LAYOUT = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
    8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
ESCAPE, ZEROS, ZERO_RUN = 0, 15, 240
# Words between two stored offsets, and ids after which a record is closed.
STRIDE = 256
RECORD_IDS = 1 << 18


# Bits of every number below 2 to the 16th.
SHORT_BITS = np.ceil(np.log2(np.arange(1, (1 << 16) + 1))).astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each unsigned 64-bit number has."""
    if ids.max() < 1 << 16:
        return SHORT_BITS[ids.astype(np.uint16)]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = np.ceil(np.log2((ids & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1))
    return np.where(high > 0, np.floor(np.log2(np.maximum(high, 1))) + 33, low).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, literals)`` of unsigned 64-bit ids."""
    ids = ids.astype("<u8")
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u8")
    bits = _bits(ids)
    # widest[k][i]: bits of the widest of the k ids from i on; ids past the end are no obstacle.
    best = np.zeros(n, np.uint8)
    widest, span = bits, 1
    for selector in range(14, 0, -1):
        count, width = LAYOUT[selector]
        while span < count:
            step = min(span, count - span)
            later = np.full(n, 255, np.uint8)
            later[: max(0, n - step)] = widest[step:]
            widest = np.maximum(widest, later)
            span += step
        best[widest <= width] = selector
    counts = np.zeros(16, np.int64)
    for selector, (count, _) in LAYOUT.items():
        counts[selector] = count
    counts[ESCAPE], counts[ZEROS] = 1, ZERO_RUN
    if (bits == 0).any():
        ends = np.flatnonzero(np.diff(np.concatenate([[0], (bits == 0).view(np.int8), [0]])))
        for a, b in zip(ends[::2], ends[1::2]):
            best[a : max(a, b - ZERO_RUN + 1)] = ZEROS
    steps = counts[best].tolist()
    at, place = [], 0
    while place < n:
        at.append(place)
        place += steps[place]
    at = np.array(at)
    chosen = best[at]
    words = chosen.astype("<u8") << np.uint64(60)
    for selector, (count, width) in LAYOUT.items():
        rows = np.flatnonzero(chosen == selector)
        for k in range(count if len(rows) else 0):
            words[rows] |= ids[at[rows] + k] << np.uint64(k * width)
    rows = np.flatnonzero(chosen == ESCAPE)
    words[rows] |= np.arange(len(rows), dtype="<u8")
    return words, ids[at[rows]]


def unpack(words: np.ndarray, literals: np.ndarray) -> np.ndarray:
    """The ids again, one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *[LAYOUT[s][0] for s in range(1, 15)], ZERO_RUN])[selector]
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] if len(ends) else 0, "<u8")
    begins = ends - counts
    for s, (count, width) in LAYOUT.items():
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(rows) else 0):
            out[begins[rows] + k] = (words[rows] >> np.uint64(k * width)) & mask
    rows = np.flatnonzero(selector == ESCAPE)
    out[begins[rows]] = literals[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def word_counts(words: np.ndarray) -> np.ndarray:
    """How many ids each word holds."""
    return np.array([1, *[LAYOUT[s][0] for s in range(1, 15)], ZERO_RUN])[(words >> np.uint64(60)).astype(np.int64)]


def _record_schema(row_id: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("record", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.ArrayType(row_id.dataType)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("offsets", T.ArrayType(T.LongType())),
            T.StructField("words", T.BinaryType()),
            T.StructField("literals", T.BinaryType()),
        ]
    )


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, row_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode ``docs`` and write the records to ``path`` in ascending ``row_id`` order.

    ``start`` of a record counts the ids before it in its shard; shards are numbered in order.
    """
    schema = _record_schema(docs.schema[row_id])
    kind = to_arrow_type(docs.schema[row_id].dataType)
    ordered = (
        docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
        .repartitionByRange("id", F.xxhash64("text"))
        .sortWithinPartitions("id", "text")
    )

    def run(batches):
        library = encoder(vocabulary)
        shard, record, start = TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def close():
            ids = np.concatenate(parts)
            words, literals = pack(ids)
            counts = word_counts(words)
            offsets = np.concatenate([[0], np.cumsum(counts)])[:-1][::STRIDE]
            columns = [
                [shard], [record], [start], [names], [[len(p) for p in parts]], [offsets.tolist()],
                [words.tobytes()], [literals.tobytes()],
            ]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), library.encode(batch.column(1))):
                names.append(name)
                parts.append(np.append(ids, np.uint32(end_id)))
                held += len(parts[-1])
                if held >= RECORD_IDS:
                    yield close()
                    record, start, names, parts, held = record + 1, start + held, [], [], 0
        if parts:
            yield close()

    ordered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, tokens)`` of every document: the ids before it and its own, little-endian 32-bit."""
    records = spark.read.parquet(path)
    # A row per shard; shards are as many as the writer's partitions.
    totals = records.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    # Written first, so that its size is known and decides how it is joined.
    bases = stage(bases, "bases")
    placed = records.join(bases, "shard").select((F.col("base") + F.col("start")).alias("start"), "ids", "sizes", "words", "literals")
    element = records.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("id", element), T.StructField("start", T.LongType()), T.StructField("tokens", T.BinaryType())]
    )

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, words, literals = (batch.column(k)[row].as_py() for k in (0, 3, 4))
                sizes = np.array(batch.column(2)[row].as_py(), np.int64)
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(literals, "<u8")).astype("<u4")
                ends = np.cumsum(sizes)
                pieces = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[row].values, pa.array(start + ends - sizes), pa.array(pieces, pa.binary())],
                    schema.names,
                )

    return placed.mapInArrow(run, schema)


def digest(tokens: DataFrame) -> DataFrame:
    """``tokens`` with its ids counted and summed up: ``n_tokens`` and ``ids_crc32``."""
    return tokens.select(
        "id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


