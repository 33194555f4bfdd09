"""Alert cooldown: keep a packet only if its source kept none in the last C seconds.

Suppressed packets do not extend the cooldown, so the kept times of a source form a chain:
the next kept time is the first one at least C after the last kept. Which times a long stretch
keeps depends on the stretch before only through the last kept time L. A stretch is therefore
summarised as a step function "earliest admissible time L + C -> last kept time", and
step functions of neighbouring stretches compose. Sources are cut into stretches of ``SPAN``
cooldowns, summarised in parallel, composed in a tree of bounded fan-out, and resolved from
the top down; no task reads the whole history of a busy source.

Times of a source are first reduced to distinct ones: of packets at the same instant only
the one with the smallest id can be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import stage

# Fixed value: seconds between processed packets of one source.
COOLDOWN_SECONDS = 5.0
# Cooldowns per stretch; distinct times in a stretch are bounded by the clock resolution.
SPAN = 16
# Stretches joined by one composition step.
FANOUT = 16
# Steps a source may have in total before its stretches are composed in a tree.
DIRECT_STEPS = 4_096

_NODE = "src_ip string, block long, upto array<long>, last array<long>"
# Arrow bytes made into Python objects at a time; those take many times as much.
PIECE_BYTES = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of about ``PIECE_BYTES``, however long their lists are."""
    for batch in batches:
        begin, size = 0, 0
        for i in range(batch.num_rows):
            size += batch.slice(i, 1).nbytes
            if size >= PIECE_BYTES or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin).to_pandas()
                begin, size = i + 1, 0


def _arrow(frame: pd.DataFrame) -> pa.RecordBatch:
    types = {"src_ip": pa.string(), "block": pa.int64(), "since": pa.int64()}
    schema = pa.schema([(c, types.get(c, pa.list_(pa.int64()))) for c in frame.columns])
    return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)


def _chain_end(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each time: the last time its chain keeps before it leaves the stretch."""
    n = len(times)
    ahead = np.searchsorted(times, times + cooldown)
    jump = np.where(ahead < n, ahead, np.arange(n))
    while True:
        doubled = jump[jump]
        if (doubled == jump).all():
            return times[jump]
        jump = doubled


def _compress(upto: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge neighbouring steps that lead to the same last kept time."""
    if len(upto) == 0:
        return upto, last
    keep = np.append(last[1:] != last[:-1], True)
    return upto[keep], last[keep]


def _admit(upto: np.ndarray, last: np.ndarray, since: int, cooldown: int) -> int:
    """Last kept time after a stretch entered with last kept time ``since``."""
    at = int(np.searchsorted(upto, since + cooldown))
    return int(last[at]) if at < len(upto) else since


def _trim(upto: np.ndarray, last: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Only entries before ``horizon`` and the first one after it can be asked for."""
    cut = int(np.searchsorted(upto, horizon)) + 1
    return upto[:cut], last[:cut]


def _summarise(cooldown: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            upto, last = [], []
            for block, times in zip(rows["block"], rows["times"]):
                times = np.asarray(times)
                u, v = _trim(times, _chain_end(times, cooldown), int(block) * width + cooldown)
                u, v = _compress(u, v)
                upto.append(u)
                last.append(v)
            yield _arrow(rows[["src_ip", "block"]].assign(upto=upto, last=last))

    return run


def _join_steps(nodes: list, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function for neighbouring stretches, given in order of time."""
    upto, last = (np.asarray(nodes[0][c]) for c in ("upto", "last"))
    horizon = int(upto[0]) + cooldown
    for node in nodes[1:]:
        u, v = np.asarray(node["upto"]), np.asarray(node["last"])
        at = np.searchsorted(u, last + cooldown)
        onward = np.where(at < len(u), v[np.minimum(at, len(u) - 1)], last)
        later = u > upto[-1]
        upto, last = np.concatenate([upto, u[later]]), np.concatenate([onward, v[later]])
        upto, last = _compress(*_trim(upto, last, horizon))
    return upto, last


def _compose(cooldown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            steps = [_join_steps(nodes, cooldown) for nodes in rows["nodes"]]
            yield _arrow(rows[["src_ip", "block"]].assign(upto=[u for u, _ in steps], last=[v for _, v in steps]))

    return run


def _resolve(cooldown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            out: dict[str, list] = {"src_ip": [], "block": [], "since": []}
            for source, since, nodes in zip(rows["src_ip"], rows["since"], rows["nodes"]):
                for node in nodes:
                    out["src_ip"].append(source)
                    out["block"].append(node["block"])
                    out["since"].append(since)
                    since = _admit(np.asarray(node["upto"]), np.asarray(node["last"]), since, cooldown)
            yield _arrow(pd.DataFrame(out))

    return run


def _in_order(nodes: DataFrame, *keys: Column) -> DataFrame:
    """Stretches of each key as one list in order of time; the list is short by construction."""
    entry = F.struct("block", "upto", "last")
    return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("nodes"))


def _entered(lists: DataFrame, cooldown: int) -> DataFrame:
    """``(src_ip, block, since)`` of every listed stretch; lists of one need no look-up."""
    lone = F.size("nodes") == 1
    return (
        lists.where(lone)
        .select("src_ip", F.col("nodes")[0]["block"].alias("block"), "since")
        .unionByName(
            lists.where(~lone)
            .select("src_ip", "since", "nodes")
            .mapInArrow(_resolve(cooldown), "src_ip string, block long, since long")
        )
    )


def _kept_in_stretch(points: Column, since: Column, cooldown: int) -> Column:
    """Ids kept in a stretch entered with last kept time ``since``; at most ``SPAN + 1`` of them."""
    start = F.struct(since.alias("since"), F.array().cast("array<long>").alias("ids"))

    def step(state: Column, point: Column) -> Column:
        keep = point["ts_us"] >= state["since"] + cooldown
        return F.struct(
            F.when(keep, point["ts_us"]).otherwise(state["since"]).alias("since"),
            F.when(keep, F.array_append(state["ids"], point["packet_id"]))
            .otherwise(state["ids"])
            .alias("ids"),
        )

    return F.aggregate(points, start, step, lambda state: state["ids"])


def _parent() -> Column:
    return F.floor(F.col("block") / F.lit(FANOUT)).cast("long").alias("parent")


# A last kept time before any packet; far enough back that adding a cooldown cannot overflow.
_NEVER = -(1 << 60)


def kept_ids(packets: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """``packet_id`` of the packets that pass the cooldown of their source."""
    cooldown = int(round(seconds * 1_000_000))
    width = cooldown * SPAN
    stretches = stage(
        packets.where(F.col("src_ip").isNotNull() & F.col("ts_us").isNotNull())
        .groupBy("src_ip", "ts_us")
        .agg(F.min("packet_id").alias("packet_id"))
        .groupBy("src_ip", F.floor(F.col("ts_us") / F.lit(width)).cast("long").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("ts_us", "packet_id"))).alias("points")),
        "times",
    ).withColumn("times", F.col("points.ts_us"))
    single = F.size("times") == 1
    nodes = (
        stretches.where(single)
        .select("src_ip", "block", F.col("times").alias("upto"), F.col("times").alias("last"))
        .unionByName(
            stretches.where(~single)
            .select("src_ip", "block", "times")
            .mapInArrow(_summarise(cooldown, width), _NODE)
        )
    )
    levels = [stage(nodes, "stretch")]
    while True:
        size = levels[-1].groupBy("src_ip").agg(
            F.sum(F.size("upto")).alias("steps"), F.count(F.lit(1)).alias("blocks")
        ).where((F.col("steps") > DIRECT_STEPS) & (F.col("blocks") > 1))
        if not size.limit(1).count():
            break
        above = _in_order(levels[-1], F.col("src_ip"), _parent())
        levels.append(
            stage(above.withColumnRenamed("parent", "block").mapInArrow(_compose(cooldown), _NODE), "stretch")
        )
    top = _in_order(levels[-1], F.col("src_ip")).withColumn("since", F.lit(_NEVER).cast("long"))
    since = _entered(top, cooldown)
    for lower in reversed(levels[:-1]):
        above = since.withColumnRenamed("block", "parent")
        since = _entered(_in_order(lower, F.col("src_ip"), _parent()).join(above, ["src_ip", "parent"]), cooldown)
    return stretches.join(since, ["src_ip", "block"]).select(
        F.explode(_kept_in_stretch(F.col("points"), F.col("since"), cooldown)).alias("packet_id")
    )


def after_cooldown(packets: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """The packets that pass the cooldown, with all their columns."""
    return packets.join(kept_ids(packets, seconds), "packet_id", "left_semi")
