"""Streams of packets and log lines, and bounded runs over them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.plans.scale import stage_path
from netwarden.sources.alert_logs import append_batch, fan_out, parse_lines

PACKET = (
    "packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, "
    "tcp_flags int, ttl int, packet_length int, payload binary"
)


def _timed(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts_us", F.unix_micros("ts"))


def packet_files(
    spark: SparkSession, path: str, kind: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Packet records from a folder that capture jobs write to."""
    reader = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", files_per_trigger)
    return _timed(reader.format(kind).load(path))


def packet_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10_000_000) -> DataFrame:
    """Packet records as JSON from a Kafka topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )
    return _timed(raw.select(F.from_json(F.col("value").cast("string"), PACKET).alias("p")).select("p.*"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Alerts parsed from text log files as they appear."""
    return parse_lines(spark.readStream.text(path))


def feed(alerts: DataFrame, kind: str, checkpoint: str, name: str | None = None, **options: str):
    """Live alert feed to any Spark sink (Kafka, files, memory)."""
    body = alerts
    if kind == "kafka":
        body = alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value"))
    writer = body.writeStream.format(kind).option("checkpointLocation", checkpoint).options(**options)
    return (writer.queryName(name) if name else writer).start()


def write_logs(alerts: DataFrame, path: str, checkpoint: str, available: bool = False):
    """Every alert to the table, the JSON log and the text log below ``path``; replays replace what they wrote."""
    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fan_out(path))
    return (writer.trigger(availableNow=True) if available else writer).start()


def append_log(alerts: DataFrame, path: str, checkpoint: str, available: bool = False):
    """Append alerts to the Parquet log; a repeated micro-batch replaces its own folder."""
    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append_batch(path))
    return (writer.trigger(availableNow=True) if available else writer).start()


# Event time of the row that ends a finite input: later than any watermark delay can hold back.
END_OF_INPUT = datetime.datetime(2200, 1, 1)


def closed(stream: DataFrame, **values) -> DataFrame:
    """``stream`` with one last row that moves the watermark past everything, for inputs that end.

    ``values`` mark the row, so that it can be told from the others afterwards.
    """
    spark = stream.sparkSession
    row = spark.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    )
    path = stage_path(spark, "end-of-input")
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def late_rows(query) -> int:
    """Rows that a finished or running query left out because they came behind the watermark."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into a table and return the table."""
    spark = stream.sparkSession
    path = stage_path(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", stage_path(spark, "progress"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
