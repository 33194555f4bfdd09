"""Alert logs: append sink, exports, JSON and text readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from netwarden.operators.alerts import iso_time
from netwarden.sources.json_arrays import read_arrays

ALERT_JSON = "source_ip string, destination_ip string, protocol string, attack_type string"

# The two text layouts of an alert line.
ATTACK_LINE = r"^(\S+ \S+) - Attack from (.*?) to (.*?) \| Protocol: (.*?) \| Type: (.*)$"
ALERT_LINE = r"^(\S+ \S+) - (\w+) - \[ALERT\] (.*?) from (\S+) to (\S+)$"


def alert_id(*names: str):
    """Content hash that identifies an alert, so that a repeated write can be recognised."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), 256)


def with_alert_id(alerts: DataFrame) -> DataFrame:
    """The packet, if known, tells apart what one source did in the same instant."""
    packet = ["packet_id"] if "packet_id" in alerts.columns else []
    return alerts.withColumn(
        "alert_id", alert_id("timestamp", "source_ip", "destination_ip", "protocol", "attack_type", *packet)
    )


def _write(alerts: DataFrame, path: str, batch: str) -> None:
    """One layout for jobs and streams: folders by day and, below, by who wrote them."""
    rows = with_alert_id(alerts).withColumn("day", F.col("timestamp").try_cast("date")).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append to the Parquet log."""
    _write(alerts, path, f"job-{uuid.uuid4().hex}")


def append_batch(path: str, stream: str = "stream"):
    """``foreachBatch`` writer: a micro-batch owns its folders, so a replayed one replaces them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write(batch, path, f"{stream}-{batch_id:012d}")

    return write


def fan_out(path: str, stream: str = "stream"):
    """``foreachBatch`` writer to all three logs below ``path``: table, JSON lines and text lines.

    A micro-batch owns its folders in each of them, so a repeated batch replaces what it wrote, and a
    batch that failed between two logs is made whole by its repetition.
    """
    table = append_batch(f"{path}/table", stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # Written once and read back: all three logs hold the same rows, and the plan runs once.
        table(batch, batch_id)
        name = f"{stream}-{batch_id:012d}"
        rows = batch.sparkSession.read.parquet(f"{path}/table").where(F.col("batch") == name).drop("day", "batch")
        rows.withColumn("timestamp", iso_time(F.col("timestamp"))).write.mode("overwrite").json(f"{path}/json/batch={name}")
        format_lines(rows).write.mode("overwrite").text(f"{path}/text/batch={name}")

    return write


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day", "batch")


def export(log: DataFrame, path: str, kind: str = "json", single_file: bool = False) -> str:
    """Export as JSON lines or CSV with a header; an existing export is an error."""
    rows = log.select(
        *[iso_time(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in log.dtypes]
    )
    writer = (rows.coalesce(1) if single_file else rows).write.mode("errorifexists")
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown export kind: {kind}")
    return path


def read_json_log(spark: SparkSession, path: str, schema: str = ALERT_JSON) -> DataFrame:
    """JSON arrays of alerts, one per file and read in pieces; a missing or corrupt file gives no rows."""
    try:
        found = read_arrays(spark, path, f"struct<{schema}>")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found.select("item.*")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Alert fields from text lines of either layout; other lines are left out. Works on streams."""
    attack = F.col("value").rlike(ATTACK_LINE)

    def part(attack_group: int, alert_group: int | None):
        own = F.regexp_extract("value", ATTACK_LINE, attack_group)
        if alert_group is None:
            return F.when(attack, own)
        return F.when(attack, own).otherwise(F.regexp_extract("value", ALERT_LINE, alert_group))

    stamp = F.regexp_replace(part(1, 1), ",", ".")
    return lines.where(attack | F.col("value").rlike(ALERT_LINE)).select(
        stamp.try_cast("timestamp").alias("timestamp"),
        F.when(~attack, F.regexp_extract("value", ALERT_LINE, 2)).alias("level"),
        part(2, 4).alias("source_ip"),
        part(3, 5).alias("destination_ip"),
        part(4, None).alias("protocol"),
        part(5, 3).alias("attack_type"),
    )


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def format_lines(log: DataFrame) -> DataFrame:
    """Alerts as text lines in the attack layout."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS")

    def known(name: str):
        """A field that an alert lacks, as a scan's destination, leaves its place empty."""
        return F.coalesce(F.col(name), F.lit(""))

    return log.select(
        F.concat(
            stamp, F.lit(" - Attack from "), known("source_ip"), F.lit(" to "), known("destination_ip"),
            F.lit(" | Protocol: "), known("protocol"), F.lit(" | Type: "), F.col("attack_type"),
        ).alias("value")
    )
