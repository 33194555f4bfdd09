"""Alert log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_time(ts: Column) -> Column:
    """ISO text with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )


def full_log(log: DataFrame) -> DataFrame:
    return log.select(
        "id", iso_time(F.col("timestamp")).alias("timestamp"), "source_ip", "destination_ip", "protocol", "attack_type"
    )


def latest(log: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` alerts as timestamp, event and source; a top-k, not a full sort."""
    newest = log.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return newest.select(
        "id",
        iso_time(F.col("timestamp")).alias("timestamp"),
        F.col("attack_type").alias("event"),
        F.col("source_ip").alias("source"),
    )


# Texts shown for missing fields.
DEFAULTS = {"timestamp": "Unknown Time", "event": "Unknown Event", "source": "Unknown Source"}


def with_defaults(events: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Missing fields, or fields absent altogether, get their display text."""
    present = {c for c in events.columns}
    return events.select(
        *[c for c in events.columns if c not in defaults],
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit(text)) if c in present else F.lit(text)).alias(c)
            for c, text in defaults.items()
        ],
    )


def score_card(attacks: DataFrame, log: DataFrame, answered: DataFrame) -> DataFrame:
    """Detection accuracy, log completeness and response time of a simulated campaign.

    ``attacks`` has ``attack_id``; ``answered`` has ``attack_id, response_time`` for detected
    attacks; ``log`` has ``attack_id`` for logged ones. No attacks gives NULLs.
    """
    seen = answered.groupBy("attack_id").agg(F.min("response_time").alias("response_time"))
    logged = log.select("attack_id").distinct().withColumn("logged", F.lit(1))
    joined = attacks.join(seen, "attack_id", "left").join(logged, "attack_id", "left")
    totals = joined.agg(
        F.count(F.lit(1)).alias("actual"),
        F.count("response_time").alias("detected"),
        F.count("logged").alias("logged"),
        F.avg("response_time").alias("mean_time"),
    )
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("actual").cast("double")) * 100
    scored = totals.select(
        share("detected").alias("accuracy_score"),
        F.coalesce("mean_time", F.lit(0.0)).alias("avg_response_time"),
        share("logged").alias("log_score"),
    )
    total = (
        F.col("accuracy_score") * 0.5 + (100 - F.col("avg_response_time")) * 0.3 + F.col("log_score") * 0.2
    )
    return scored.select(F.round(total, 2).alias("total_score"), "*")
