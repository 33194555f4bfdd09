"""Sum-of-squares packing of tokenized documents into sequences of fixed length.

A document is its ids and an end id. Longer ones are cut into full pieces, the first of them shorter;
full pieces are sequences of their own. Every other piece is placed so that the sum, over all residual
gaps, of the squared number of open sequences with that gap becomes smallest. That keeps the open
gaps varied, so that later pieces find one that they fill exactly; among equal sums the tightest gap
wins. A sequence is only opened when no open one has room. Pieces are placed from long to short.

Placement needs lengths only. They are dealt into groups of about ``GROUP_PIECES`` by hash; groups grow
in number with the data, not in size, and a group wastes about one sequence. Ids stay where
they were written and are never shuffled for it.

Defined cases: a null or empty text is one piece with the end id alone; null ids and repeated rows are
packed like others, each row on its own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.tokens import encoder
from netwarden.plans.scale import remove_at_exit, stage_path

LENGTH = 2048
END_ID = 0
GROUP_PIECES = 1 << 14
# Ids after which a task hands its pieces on.
EMIT_IDS = 1 << 19


def token_pieces(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Written once: ``(place, id, piece, start, length, tokens)``; ``place`` numbers the pieces of all rows."""
    schema = T.StructType(
        [
            T.StructField("place", T.LongType()),
            T.StructField("id", docs.schema[row_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches):
        library = encoder(vocabulary)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, pieces, starts, sizes, tokens, held = [], [], [], [], [], 0
            for row, ids in enumerate(library.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(a)
                    sizes.append(b - a)
                    tokens.append(ids[a:b].tobytes())
                held += len(ids)
                if held >= EMIT_IDS or row == batch.num_rows - 1:
                    columns = [
                        pa.array(np.arange(place, place + len(rows))),
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.binary()),
                    ]
                    place += len(rows)
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    rows, pieces, starts, sizes, tokens, held = [], [], [], [], [], 0

    made = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    path = stage_path(docs.sparkSession, "pieces")
    # Ids of 32 bits hold many zero bytes; they compress to about half.
    made.write.option("compression", "zstd").parquet(path)
    remove_at_exit(docs.sparkSession, path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def place_by_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece, given its size below ``length``, in the given order."""
    open_gaps = np.zeros(length + 1)
    open_gaps[0] = -0.5  # filling a gap leaves no open sequence: its term below is zero
    with_gap: dict[int, list[int]] = {}
    sequences, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for nth, size in enumerate(sizes.tolist()):
        # Change of the sum: a sequence leaves gap g and joins gap g - size.
        change = 2 * (open_gaps[: length - size + 1] - open_gaps[size:]) + 2
        change[open_gaps[size:] <= 0] = np.inf
        best = int(change.argmin())
        gap = best + size
        if not np.isfinite(change[best]):
            gap, sequence, used = length, used, used + 1
        else:
            sequence = with_gap[gap].pop()
            open_gaps[gap] -= 1
        sequences[nth], offsets[nth] = sequence, length - gap
        left = gap - size
        if left:
            open_gaps[left] += 1
            with_gap.setdefault(left, []).append(sequence)
    return sequences, offsets


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(place, sequence_id, offset)`` of every piece."""
    sizes = pieces.select("place", "length")
    full = sizes.where(F.col("length") == length).select(
        "place", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts = sizes.where(F.col("length") < length)
    groups = max(1, math.ceil(parts.count() / GROUP_PIECES))

    def run(key, table):
        order = np.lexsort([table.column("place").to_numpy(), -table.column("length").to_numpy()])
        sequence, offset = place_by_squares(table.column("length").to_numpy()[order], length)
        group = key[0].as_py()
        return pa.table(
            {
                "place": table.column("place").to_numpy()[order],
                "sequence_id": (group << 40) + sequence,
                "offset": offset,
            }
        )

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group").applyInArrow(run, "place long, sequence_id long, offset long")
    return full.unionByName(packed)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``(sequence_id, tokens)``: the ids of each sequence, little-endian 32-bit."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["tokens"]))
    met = pieces.join(placed, "place").groupBy("sequence_id").agg(parts.alias("parts"))
    return met.select("sequence_id", joined.alias("tokens"))


def packed_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row per piece of ``docs``: where it lies in its document and in its sequence, and a sum of its ids."""
    pieces = token_pieces(docs, vocabulary)
    summed = pieces.select(
        "place", F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("tokens").alias("ids_crc32")
    )
    return summed.join(place(pieces), "place").drop("place")
