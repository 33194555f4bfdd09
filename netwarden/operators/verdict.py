"""Model rules and the verdicts built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.functions.values import argmax, array_sum, softmax
from netwarden.operators.cooldown import COOLDOWN_SECONDS, after_cooldown
from netwarden.operators.portscan import SCAN_LABEL, SCAN_PORTS, SCAN_SECONDS, TCP, scan_times, tcp_only
from netwarden.operators.signatures import MATCH_LABEL, matches_signature
from netwarden.plans.scale import lookup, stage

# Probability above which traffic is an attack; buffer over the anomaly threshold.
ATTACK_PROBABILITY = 0.7
ANOMALY_BUFFER = 1.1
FEATURES = 20


def supervised_attack(prob: Column, threshold: float = ATTACK_PROBABILITY) -> Column:
    return prob > F.lit(threshold)


def reconstruction_error(x: Column, reconstructed: Column) -> Column:
    """Mean squared difference of two arrays of equal length."""
    squares = F.zip_with(
        x, reconstructed, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    )
    return array_sum(squares) / F.size(x)


def is_anomaly(score: Column, threshold: float | Column, buffer: float = 1.0) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return score > limit * F.lit(buffer)


def input_error(features: Column, expected: int = FEATURES) -> Column:
    """Why a feature row cannot be scored; NULL when it can."""
    size = F.size(features)
    return (
        F.when(features.isNull(), F.lit("Features must be an array"))
        .when(
            size != expected,
            F.concat(F.lit(f"Expected {expected} features, got "), size.cast("string")),
        )
        .when(
            F.exists(features, lambda x: x.isNull() | F.isnan(x)), F.lit("Input contains NaN values")
        )
    )


def cascade(features: Column, prob: Column, score: Column, threshold: float, expected: int = FEATURES) -> Column:
    """Input errors first, then the classifier, then the reconstruction error."""
    error = input_error(features, expected)
    return (
        F.when(error.isNotNull(), F.concat(F.lit("Error: "), error))
        .when(prob.isNull() | F.isnan(prob), F.lit("Error: Invalid model output"))
        .when(supervised_attack(prob), F.lit("Known Attack"))
        .when(score.isNull() | F.isnan(score), F.lit("Error: Invalid autoencoder output"))
        .when(is_anomaly(score, threshold, ANOMALY_BUFFER), F.lit("Unknown Anomaly"))
        .otherwise(F.lit("Normal"))
    )


def margin_table(rows: DataFrame, threshold: float, tolerance: float = 0.1) -> DataFrame:
    """Verdict, distance to the anomaly threshold and alert state of scored rows.

    ``rows`` has ``id, features, prob, mse``.
    """
    return rows.select(
        "id",
        cascade(F.col("features"), F.col("prob"), F.col("mse"), threshold).alias("verdict"),
        "mse",
        (F.col("mse") - F.lit(threshold)).alias("threshold_diff"),
        F.when(F.col("mse") > F.lit(threshold * (1 + tolerance)), F.lit("ALERT"))
        .otherwise(F.lit("OK"))
        .alias("state"),
    )


def detector_verdicts(
    packets: DataFrame,
    threshold: float,
    seconds: float = SCAN_SECONDS,
    ports: int = SCAN_PORTS,
) -> DataFrame:
    """Alerts of the full detector: a port scan ends the checks; else anomaly, signature or class.

    ``packets`` carries ``score`` and ``model_class``. A scan alert has neither destination
    nor protocol. Payloads and scores are reduced to flags where they are read, so neither is
    shuffled; scans are found by source and time, not by packet.
    """
    tcp = tcp_only(packets)
    times = stage(scan_times(tcp, seconds, ports), "scans")
    counted = (F.col("proto") == TCP) & F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()
    anomaly = is_anomaly(F.col("score"), threshold) | (F.col("model_class") == 1)
    facts = packets.select(
        "packet_id",
        "ts",
        "ts_us",
        "src_ip",
        "dst_ip",
        "proto",
        F.coalesce(counted, F.lit(False)).alias("counted"),
        F.coalesce(matches_signature(F.col("payload")), F.lit(False)).alias("signed"),
        F.coalesce(anomaly, F.lit(False)).alias("anomaly"),
    )
    found = lookup(facts, times, ["src_ip", "ts_us"], "rows", "left")
    label = (
        F.when(F.col("scan"), F.lit(SCAN_LABEL))
        .when(F.col("signed"), F.lit(MATCH_LABEL))
        .when(F.col("anomaly"), F.lit("Anomaly Detected"))
    )
    return (
        found.withColumn("scan", F.when(F.col("counted") & F.col("n_ports").isNotNull(), True))
        .withColumn("attack_type", label)
        .where(F.col("attack_type").isNotNull())
        .select(
            "packet_id",
            "ts",
            F.col("src_ip").alias("source_ip"),
            F.when(F.col("scan").isNull(), F.col("dst_ip")).alias("destination_ip"),
            F.when(F.col("scan").isNull(), F.col("proto").cast("string")).alias("protocol"),
            "attack_type",
        )
    )


def label_processed(packets: DataFrame) -> DataFrame:
    """Signature or classifier alerts among packets that already passed the cooldown.

    ``packets`` carries ``signed``, or the payload to find it in.
    """
    signed = F.col("signed") if "signed" in packets.columns else matches_signature(F.col("payload"))
    return packets.where(signed | supervised_attack(F.col("prob"))).select(
        "packet_id",
        "ts",
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("proto").cast("string").alias("protocol"),
        F.when(signed, F.lit(MATCH_LABEL)).otherwise(F.lit("Anomaly Detected")).alias("attack_type"),
    )


def sniffer_verdicts(packets: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """Cooldown gate per source, then classifier or signature. ``packets`` carries ``prob``.

    Payloads are reduced to a flag where they are read, so the gate does not shuffle them.
    """
    signed = F.coalesce(matches_signature(F.col("payload")), F.lit(False))
    facts = packets.withColumn("signed", signed).drop("payload")
    return label_processed(after_cooldown(facts, seconds))


def prediction_scale(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Per-row scaled softmax and batch-wide magnitude warnings."""
    extremes = rows.select(F.explode(F.transform(logits, F.abs)).alias("a")).agg(
        F.struct(
            F.max("a").alias("top"), F.min(F.when(F.col("a") > 0, F.col("a"))).alias("low")
        ).alias("e")
    )
    e = extremes.scalar()
    top, low = e["top"], e["low"]
    ratio = F.try_divide(top, low)
    factor = F.col("factor")
    probs = softmax(F.transform(logits, lambda x: x / factor), clip=50, epsilon=1e-10)
    return (
        rows.withColumn("magnitude_ratio", ratio)
        .withColumn("scale_warning", (top > 1000) | F.coalesce(ratio > 1e6, F.lit(False)))
        .withColumn("factor", F.greatest(F.lit(1.0), top / 100))
        .withColumn("probs", probs)
        .drop("factor")
        .withColumn("predicted", F.when(F.col("probs")[1] > F.col("probs")[0], "Attack").otherwise("Normal"))
        .withColumn("confidence", F.array_max("probs"))
        .withColumn("confidence_warning", (F.col("confidence") > 0.99) | (F.col("confidence") < 0.6))
    )


def adjusted_class(probs: Column, threshold: float) -> Column:
    """Class of a probability array: own threshold for two classes, else the first maximum."""
    if threshold == 0.5:
        return argmax(probs)
    return F.when(F.size(probs) == 2, (probs[1] >= threshold).cast("int")).otherwise(argmax(probs))
