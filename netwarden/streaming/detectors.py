"""Stateful detectors on event time.

Packets may arrive out of order. Each detector holds packets until the watermark has passed
them, so that its decision equals the batch operator's on the same rows. Rows later than the
watermark are dropped by Spark; ``late_rows`` tells how many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from netwarden.operators.cooldown import COOLDOWN_SECONDS
from netwarden.operators.portscan import SCAN_LABEL, SCAN_PORTS, SCAN_SECONDS, TCP
from netwarden.operators.signatures import MATCH_LABEL, matches_signature
from netwarden.operators.verdict import is_anomaly, supervised_attack

_FACTS = ["packet_id", "ts_us", "dst_ip", "proto", "signed", "flagged"]
_FACT_TYPES = "packet_id long, ts_us long, dst_ip string, proto int, signed boolean, flagged boolean"
KEPT = f"src_ip string, {_FACT_TYPES}"
SCANNED = f"src_ip string, {_FACT_TYPES}, n_ports long"


# What waits of a packet; the last column says whether its port counts.
_HELD = pa.schema(
    [
        ("packet_id", pa.int64()),
        ("ts_us", pa.int64()),
        ("dst_ip", pa.string()),
        ("proto", pa.int32()),
        ("signed", pa.bool_()),
        ("flagged", pa.bool_()),
        ("counted", pa.bool_()),
    ]
)
# Of a scan every packet waits with its source: a key holds many sources.
_SCANNED_HELD = pa.schema([("src_ip", pa.string()), *_HELD])
_SEEN = pa.schema([("src_ip", pa.string()), ("port", pa.int32()), ("first_us", pa.int64()), ("before_us", pa.int64())])
# Packets that a piece holds at least before it may end with its stretch.
PIECE_ROWS = 64
# Stretches that the packets of one scan slice are kept in.
SCAN_CELLS = 16
# Keys that the sources of one scan slice are spread over, and pieces of their ports before they are merged.
SCAN_BUCKETS, SEEN_PIECES = 64, 8
_NO_FIRST, _NO_LAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _ms(us: int) -> int:
    """First whole millisecond at or after a time in microseconds."""
    return -(-int(us) // 1000)


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    columns = [pa.array(rows[f.name], f.type, from_pandas=True) for f in schema]
    return (pa.RecordBatch.from_arrays(columns, schema=schema).serialize().to_pybytes(),)


def _unpacked(held: list[tuple], schema: pa.Schema) -> pd.DataFrame:
    parts = [pa.ipc.read_record_batch(pa.py_buffer(bytes(x[0])), schema) for x in held]
    return pa.Table.from_batches(parts, schema).to_pandas(integer_object_nulls=True)


class Waiting:
    """Packets of one key that the watermark has not passed, and the key's one pending timer.

    Packets lie in pieces by stretch of time. A piece is what one batch brought to a stretch: it is
    written once, read when the watermark reaches its stretch, and never grows. A timer
    touches only stretches it has reached, so a packet is read a bounded number of times however
    many micro-batches pass while it waits. Where a batch brings few packets to a stretch, a piece
    takes those of the next ones too, up to ``PIECE_ROWS`` packets and the end of their stretch:
    state is not addressed once for every packet of a quiet key.
    """

    def __init__(self, handle: StatefulProcessorHandle, cell: int, schema: pa.Schema = _HELD):
        self.handle, self.cell, self.schema = handle, max(int(cell), 1), schema
        self.pieces = handle.getMapState("pieces", "cell long, last long, piece long", "rows binary")
        self.numbered = handle.getValueState("numbered", "piece long")
        self.timer = handle.getValueState("timer", "at_ms long")

    def add(self, rows: pd.DataFrame) -> None:
        # A packet without a time is never due.
        rows = rows[rows["ts_us"].notna()].sort_values("ts_us", kind="stable")
        if rows.empty:
            return
        piece = self.numbered.get()[0] if self.numbered.exists() else 0
        cells = rows["ts_us"].to_numpy(np.int64) // self.cell
        ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells))
        begin = 0
        for end in ends:
            if end - begin >= PIECE_ROWS or end == len(cells):
                self._put(piece, rows.iloc[begin:end])
                begin, piece = end, piece + 1
        self.numbered.update((piece,))

    def _put(self, piece: int, rows: pd.DataFrame) -> None:
        """One piece of rows in order of time."""
        first, last = (int(t) // self.cell for t in rows["ts_us"].iloc[[0, -1]])
        self.pieces.updateValue((first, last, piece), _packed(rows, self.schema))

    def ready(self, done: int) -> Iterator[pd.DataFrame]:
        """Take out what lies at ``done`` or before, a stretch at a time and in order of time.

        ``self.next`` is then a time no later than the first packet left, or ``None``.
        """
        self.next = None

        def left(us: int) -> None:
            self.next = us if self.next is None else min(self.next, us)

        # Pieces that share a stretch are read together.
        together: list[list[tuple]] = []
        reach = None
        for key in sorted(tuple(k) for k in self.pieces.keys()):
            if key[0] * self.cell > done:
                left(key[0] * self.cell)
                break
            if reach is not None and key[0] <= reach:
                together[-1].append(key)
                reach = max(reach, key[1])
            else:
                together.append([key])
                reach = key[1]
        for keys in together:
            rows = _unpacked([self.pieces.getValue(key) for key in keys], self.schema)
            later = rows[rows["ts_us"] > done]
            if len(later) < len(rows):
                for key in keys:
                    self.pieces.removeKey(key)
                if len(later):
                    self._put(keys[0][2], later.sort_values("ts_us", kind="stable"))
                yield rows[rows["ts_us"] <= done].sort_values(["ts_us", "packet_id"], ignore_index=True)
            if len(later):
                left(int(later["ts_us"].min()))

    def wake(self, us: int) -> None:
        """Have the key called at ``us``, unless it is called earlier."""
        at = _ms(us)
        if self.timer.exists():
            pending = self.timer.get()[0]
            if pending <= at:
                return
            self.handle.deleteTimer(pending)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def woken(self) -> None:
        self.timer.clear()

    def clear(self) -> None:
        self.pieces.clear()
        self.numbered.clear()
        self.timer.clear()


class CooldownGate(StatefulProcessor):
    """Keeps a packet if the source kept none in the last ``cooldown`` microseconds.

    The last kept time is final, so packets inside its cooldown are not held at all.
    """

    def __init__(self, cooldown: int):
        # Packets of one instant are peers, of which one is kept even without a cooldown.
        self.cooldown = max(cooldown, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_us long")
        self.waiting = Waiting(handle, self.cooldown)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            part = part[part["ts_us"].notna()]
            if last is not None:
                part = part[part["ts_us"] >= last + self.cooldown]
            part = part.sort_values(["ts_us", "packet_id"]).drop_duplicates("ts_us")
            if len(part):
                self.waiting.add(part.assign(counted=False))
                self.waiting.wake(part["ts_us"].iloc[0])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        self.waiting.woken()
        last = self.last.get()[0] if self.last.exists() else None
        for rows in self.waiting.ready(done):
            times = rows["ts_us"].to_numpy(np.int64)
            kept, place = [], 0
            while True:
                if last is not None:
                    place = int(np.searchsorted(times, last + self.cooldown))
                if place >= len(times):
                    break
                kept.append(place)
                last = int(times[place])
            if kept:
                yield rows.iloc[kept].assign(src_ip=key[0])[["src_ip", *_FACTS]]
        left = self.waiting.next
        if left is None and (last is None or last + self.cooldown <= done):
            self.last.clear()
            self.waiting.clear()
            return
        if last is not None:
            self.last.update((last,))
        # An idle source comes back once its cooldown is over, to be forgotten.
        self.waiting.wake(left if left is not None else last + self.cooldown)

    def close(self) -> None:
        pass


class ScanCounter(StatefulProcessor):
    """Counts distinct ports in the trailing window for some sources and one window-long slice.

    A key sees the packets of its sources in its slice and, for the look-back, those of the slice before,
    so a busy source is in a different key in every slice. Of the ports of each source it keeps the first
    time in the slice and the last time in the one before. A batch adds what it saw as a piece of its
    own; pieces are merged when they have become ``SEEN_PIECES``. A packet is counted and let go
    when the watermark reaches it: first times up to there cannot change any more. All sources
    of a key are counted in one go, since most have only a few packets in a slice.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "piece long", "rows binary")
        self.waiting = Waiting(handle, self.width // SCAN_CELLS, _SCANNED_HELD)

    @staticmethod
    def _merged(seen: pd.DataFrame) -> pd.DataFrame:
        """One row for each source and port."""
        return seen.groupby(["src_ip", "port"], as_index=False, sort=False).agg({"first_us": "min", "before_us": "max"})

    def _known(self) -> pd.DataFrame:
        numbers = [k[0] for k in self.seen.keys()]
        known = self._merged(_unpacked([self.seen.getValue((n,)) for n in numbers], _SEEN))
        if len(numbers) >= SEEN_PIECES:
            self.seen.clear()
            self.seen.updateValue((max(numbers) + 1,), _packed(known, _SEEN))
        return known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = (int(key[1]) + 1) * self.width
        met: list[pd.DataFrame] = []
        for part in rows:
            back = part["look_back"].astype(bool)
            counted = ((part["proto"] == TCP) & part["dst_port"].notna()).fillna(False).astype(bool)
            seen = part[counted]
            old, times = back[counted].to_numpy(), seen["ts_us"].to_numpy(np.int64)
            met.append(
                self._merged(
                    pd.DataFrame(
                        {
                            "src_ip": seen["src_ip"].to_numpy(),
                            "port": seen["dst_port"].to_numpy(np.int32),
                            "first_us": np.where(old, _NO_FIRST, times),
                            "before_us": np.where(old, times, _NO_LAST),
                        }
                    )
                )
            )
            own = part[~back].assign(counted=counted[~back])
            if len(own):
                self.waiting.add(own)
                earliest = min(earliest, int(own["ts_us"].min()))
        new = self._merged(pd.concat(met)) if met else []
        if len(new):
            # Numbers grow, so that a piece never replaces another.
            self.seen.updateValue((max((k[0] for k in self.seen.keys()), default=-1) + 1,), _packed(new, _SEEN))
        self.waiting.wake(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        end = (int(key[1]) + 1) * self.width
        self.waiting.woken()
        count = self._steps()
        for rows in self.waiting.ready(done):
            counted = rows["counted"].to_numpy(bool)
            n_ports = np.where(counted, count(rows["src_ip"].to_numpy(), rows["ts_us"].to_numpy(np.int64)), 0)
            yield rows.assign(n_ports=n_ports)[["src_ip", *_FACTS, "n_ports"]]
        if done >= end:
            self.seen.clear()
            self.waiting.clear()
        else:
            self.waiting.wake(end if self.waiting.next is None else self.waiting.next)

    def _steps(self):
        """The number of ports in the window as a function of source and time."""
        known = self._known()
        first, before = known["first_us"].to_numpy(np.int64), known["before_us"].to_numpy(np.int64)
        old, new = before != _NO_LAST, first != _NO_FIRST
        gone = np.where(old, before, 0) + self.width + 1
        stays = old & new & (first < gone)
        rise, fall = new & ~stays, old & ~stays

        def count(source: np.ndarray, at: np.ndarray) -> np.ndarray:
            code, _ = pd.factorize(np.concatenate([known["src_ip"].to_numpy(), source]))
            mine, asked = code[: len(known)], code[len(known) :]
            codes = np.concatenate([mine[rise], mine[fall], asked])
            times = np.concatenate([first[rise], gone[fall], at])
            step = np.repeat([1, -1, 0], [rise.sum(), fall.sum(), len(at)])
            # In order of source and time, and steps before the packets of the same instant.
            order = np.lexsort((step == 0, times, codes))
            total = np.empty(len(step), np.int64)
            total[order] = np.cumsum(step[order])
            many = int(code.max(initial=-1)) + 1
            each = np.bincount(codes, step, many).astype(np.int64)
            base = np.bincount(mine[old], minlength=many) - (np.cumsum(each) - each)
            return base[asked] + total[len(step) - len(at) :]

        return count

    def close(self) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the progress the query remembers.

    A row that a scan also looks back at from the next slice counts once for each slice it is late for.
    """
    return sum(
        state.get("numRowsDroppedByWatermark", 0) for report in query.recentProgress for state in report["stateOperators"]
    )


def facts(packets: DataFrame, threshold: float | None = None) -> DataFrame:
    """What later decisions need of a packet, so that payloads are not kept in state."""
    names = packets.columns
    flagged = F.lit(False)
    if "prob" in names:
        flagged = flagged | F.coalesce(supervised_attack(F.col("prob")), F.lit(False))
    if "score" in names and threshold is not None:
        flagged = flagged | F.coalesce(is_anomaly(F.col("score"), threshold), F.lit(False))
    if "model_class" in names:
        flagged = flagged | F.coalesce(F.col("model_class") == 1, F.lit(False))
    return packets.select(
        "ts",
        "src_ip",
        "packet_id",
        "ts_us",
        "dst_ip",
        "proto",
        "dst_port",
        matches_signature(F.col("payload")).alias("signed"),
        flagged.alias("flagged"),
    )


def cooldown_stream(rows: DataFrame, seconds: float = COOLDOWN_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """Packets (as ``facts``) that pass the cooldown of their source."""
    return (
        rows.where(F.col("src_ip").isNotNull())
        .withWatermark("ts", delay)
        .groupBy("src_ip")
        .transformWithStateInPandas(
            statefulProcessor=CooldownGate(int(round(seconds * 1_000_000))),
            outputStructType=KEPT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def scan_stream(rows: DataFrame, seconds: float = SCAN_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """Every packet (as ``facts``) with the distinct ports its source used in the trailing window."""
    width = int(round(seconds * 1_000_000))
    counted = (F.col("proto") == TCP) & F.col("dst_port").isNotNull()
    # The slice a packet belongs to, and the next one if it can be looked back at from there.
    copies = F.filter(
        F.array(
            F.struct(F.lit(False).alias("look_back"), F.expr(f"ts_us div {width}").alias("slice")),
            F.when(counted, F.struct(F.lit(True).alias("look_back"), F.expr(f"ts_us div {width} + 1").alias("slice"))),
        ),
        lambda c: c.isNotNull(),
    )
    # Without a source nothing is scanned; such packets pass with no ports.
    unknown = rows.where(F.col("src_ip").isNull()).select("src_ip", *_FACTS, F.lit(0).cast("long").alias("n_ports"))
    sourced = rows.where(F.col("src_ip").isNotNull()).withWatermark("ts", delay)
    spread = sourced.select("*", F.explode(copies).alias("c")).select("*", "c.*").drop("c")
    bucket = F.pmod(F.xxhash64("src_ip"), F.lit(SCAN_BUCKETS))
    counted_ports = spread.withColumn("bucket", bucket).groupBy("bucket", "slice").transformWithStateInPandas(
        statefulProcessor=ScanCounter(width),
        outputStructType=SCANNED,
        outputMode="Append",
        timeMode="EventTime",
    )
    return counted_ports.unionByName(unknown)


def _alerts(rows: DataFrame, label) -> DataFrame:
    return rows.withColumn("attack_type", label).where(F.col("attack_type").isNotNull())


def sniffer_stream(kept: DataFrame) -> DataFrame:
    """Signature or classifier alerts among the packets that passed the cooldown."""
    label = F.when(F.col("signed"), MATCH_LABEL).when(F.col("flagged"), "Anomaly Detected")
    return _alerts(kept, label).select(
        "packet_id",
        F.timestamp_micros("ts_us").alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("proto").cast("string").alias("protocol"),
        "attack_type",
    )


def detector_stream(counted: DataFrame, ports: int = SCAN_PORTS) -> DataFrame:
    """Scan alerts first, then signature, then anomaly or classifier."""
    scan = F.col("n_ports") > ports
    label = F.when(scan, SCAN_LABEL).when(F.col("signed"), MATCH_LABEL).when(F.col("flagged"), "Anomaly Detected")
    return _alerts(counted, label).select(
        "packet_id",
        F.timestamp_micros("ts_us").alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        F.when(~scan, F.col("dst_ip")).alias("destination_ip"),
        F.when(~scan, F.col("proto").cast("string")).alias("protocol"),
        "attack_type",
    )
