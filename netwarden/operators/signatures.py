"""Payload signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import SMALL_ROWS, pin_small

# The attack patterns, in order of priority, and the label of a match.
PATTERNS = ["GET /etc/passwd", "SQL SELECT .* FROM", "admin.*password"]
MATCH_LABEL = "Potential Exploit Detected"


def matches_signature(payload: Column, patterns: list[str] = PATTERNS) -> Column:
    """True if any pattern occurs in the payload bytes.

    Bytes are read as ISO-8859-1, one character per byte; ``(?d)`` lets the dot cross every
    byte but a newline. One alternation means one scan of the payload.
    """
    text = F.decode(payload, "ISO-8859-1")
    either = "(?d)" + "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(text.rlike(either), F.lit(False))


def first_signature(payload: Column, patterns: list[str] = PATTERNS) -> Column:
    """The first pattern, in list order, that occurs in the payload."""
    text = F.decode(payload, "ISO-8859-1")
    tests = [F.when(text.rlike("(?d)" + p), F.lit(p)) for p in patterns]
    return F.coalesce(*tests)


def match_rules(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """``packet_id, rule_id, pattern, label``: of the rules that a packet's payload matches the one that comes first.

    ``rules`` has ``rule_id, priority, pattern, label``; the smallest priority and then the smallest id wins.
    A table of rules that was counted and found small is sent to the packets, so payloads are not shuffled;
    a pattern that does not compile is an error. In ``foreachBatch`` the table is read anew for each batch.
    """
    known = rules.where(F.col("pattern").isNotNull())
    pinned = pin_small(known)
    if pinned is known:
        raise ValueError(f"more than {SMALL_ROWS} rules; split the table by priority")
    text = packets.select("packet_id", F.decode("payload", "ISO-8859-1").alias("__text"))
    hit = F.rlike(F.col("__text"), F.concat(F.lit("(?d)"), F.col("pattern")))
    met = text.join(F.broadcast(pinned), hit).select("packet_id", "rule_id", "priority", "pattern", "label")
    first = F.min_by(F.struct("rule_id", "pattern", "label"), F.struct("priority", "rule_id")).alias("r")
    return met.groupBy("packet_id").agg(first).select("packet_id", "r.*")


def signature_alerts(packets: DataFrame) -> DataFrame:
    return packets.where(matches_signature(F.col("payload"))).withColumn(
        "attack_type", F.lit(MATCH_LABEL)
    )
