"""Security-shaped views over the test tables (Spark side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.plans.scale import hash_unit
from netwarden.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _address(prefix: str, number: str) -> Column:
    return F.expr(
        f"concat('{prefix}', cast({number} div 256 as string), '.', cast({number} % 256 as string))"
    )


def as_packets(events: DataFrame) -> DataFrame:
    """Packet records from events, batch or stream."""
    payload = (
        F.when(F.expr("event_id % 50 = 0"), "GET /etc/passwd HTTP/1.1")
        .when(F.expr("event_id % 50 = 1"), "SQL SELECT * FROM users")
        .when(F.expr("event_id % 50 = 2"), "admin=1&password=x")
        .when(F.expr("event_id % 50 = 3"), "SQL SELECT x\n FROM y")
        .otherwise("GET /index.html")
    )
    return events.select(
        F.col("event_id").alias("packet_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"),
        _address("10.0.", "user_id").alias("src_ip"),
        F.expr("concat('10.1.0.', cast(event_id % 256 as string))").alias("dst_ip"),
        F.expr("cast(if(event_id % 3 = 0, 17, 6) as int)").alias("proto"),
        F.expr("cast(1024 + event_id % 64511 as int)").alias("src_port"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        F.expr("cast(event_id % 64 as int)").alias("tcp_flags"),
        F.expr("cast(32 + event_id % 224 as int)").alias("ttl"),
        F.expr("cast(40 + floor(value) as int)").alias("packet_length"),
        payload.cast("binary").alias("payload"),
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    return as_packets(table(spark, folder, "events"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scores: ``id, label, u, prob, logits``; rounding makes many scores equal."""
    base = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        hash_unit(42, F.col("event_id")).alias("u"),
    )
    return with_logits(
        base.withColumn("prob", F.round(F.lit(0.6) * F.col("u") + F.lit(0.4) * F.col("label"), 2))
    )


def with_logits(rows: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("prob")))
    return rows.withColumn("logits", F.array(F.lit(0.0), F.ln(p / (1 - p))))


def vectors(spark: SparkSession, folder: str, positive: int | None = 5) -> DataFrame:
    """``id, label, x``: the first 20 dimensions; label 1 for one class, or all ten classes."""
    return as_vectors(table(spark, folder, "embeddings"), positive)


def as_vectors(embeddings: DataFrame, positive: int | None = 5) -> DataFrame:
    label = F.col("label") if positive is None else (F.col("label") == positive).cast("int")
    x = F.transform(F.slice("embedding", 1, 20), lambda v: v.cast("double"))
    return embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), x.alias("x"))


FLOW_NUMERIC = ["quantity", "extendedprice", "discount", "tax", "linenumber", "partkey", "suppkey"]


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flow records from line items; two categorical columns, two addresses, a label."""
    return table(spark, folder, "lineitem").select(
        *[F.col(f"l_{c}").cast("double").alias(c) for c in FLOW_NUMERIC],
        F.col("l_linestatus").alias("linestatus"),
        _address("10.2.", "l_suppkey").alias("IPV4_SRC_ADDR"),
        _address("10.3.", "(l_partkey % 512)").alias("IPV4_DST_ADDR"),
        F.col("l_returnflag").alias("Label"),
    )


DIRTY_FEATURES = ["quantity", "discount", "tax", "linenumber"]


def dirty_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flow records as text with missing tokens, junk and extreme values; many equal rows."""
    mix = F.expr("(l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000")
    return table(spark, folder, "lineitem").withColumn("m", mix).select(
        F.when(F.col("m") < 4, "nan")
        .when(F.col("m") < 8, "inf")
        .when(F.col("m") < 12, "abc")
        .when(F.col("m") < 16, "2000000")
        .when(F.col("m") < 20, "")
        .when(F.col("m") < 24, "1000000")
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("quantity"),
        F.when(F.col("m").between(500, 509), "NULL")
        .otherwise(F.col("l_discount").cast("string"))
        .alias("discount"),
        F.col("l_tax").cast("string").alias("tax"),
        F.col("l_linenumber").cast("string").alias("linenumber"),
        F.when(F.col("m").between(700, 709), "null")
        .otherwise(F.when(F.col("l_returnflag") == "R", "1").otherwise("0"))
        .alias("Label"),
    )


def attack_log(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.expr("event_id % 3 = 0"), "Port Scan")
        .when(F.expr("event_id % 3 = 1"), "Potential Exploit Detected")
        .otherwise("Anomaly Detected")
    )
    return (
        table(spark, folder, "events")
        .select(
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            _address("10.0.", "user_id").alias("source_ip"),
            F.expr("concat('10.1.0.', cast(event_id % 256 as string))").alias("destination_ip"),
            F.expr("if(event_id % 3 = 0, '17', '6')").alias("protocol"),
            kind.alias("attack_type"),
        )
    )


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in append order: ``pos`` is the position; every 97th timestamp is unreadable."""
    status = (
        F.when(F.expr("event_id % 5 < 3"), "success")
        .when(F.expr("event_id % 5 = 3"), "Warning")
        .otherwise("failed")
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("label"),
        F.when(F.expr("event_id % 97 = 0"), "unknown")
        .when(F.expr("event_id % 89 = 0"), None)
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss:SSSSSS"))
        .alias("timestamp"),
        F.concat(F.lit("python "), "event_type").alias("command"),
        status.alias("status"),
        F.col("value").alias("duration"),
        F.expr("cast(50 + event_id % 51 as double)").alias("health_score"),
        F.expr("cast(if(event_id % 11 = 0, null, event_id % 7) as double)").alias("model_variants"),
    )


def chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Load metrics per chunk, one chunk per order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.expr("1000 + o_custkey % 1000").alias("actual_rows"),
        F.expr("cast(o_totalprice as double) / 2000").alias("ram_usage_mb"),
        F.expr("cast(o_totalprice as double) / (1000 + o_custkey % 1000)").alias("mem_per_row"),
        F.expr("cast(1 + o_orderkey % 17 as double) / 8").alias("load_time_sec"),
        F.expr("cast(1000 + o_custkey as double)").alias("throughput_rows_sec"),
        F.expr("cast(o_orderkey % 100 as double)").alias("cpu_percent"),
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "P", "partial")
        .otherwise("failed")
        .alias("status"),
    )
