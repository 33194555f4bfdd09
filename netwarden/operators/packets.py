"""Features of single packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions import address


def packet_features(packets: DataFrame) -> DataFrame:
    """Eight numeric fields; ports of TCP, else of UDP; zeros where a layer is missing."""
    has_ports = F.col("proto").isin(6, 17)

    def port(name: str):
        return F.when(has_ports, F.coalesce(F.col(name), F.lit(0))).otherwise(0).cast("long").alias(name)

    return packets.select(
        "packet_id",
        F.coalesce(address.ip_to_long(F.col("src_ip")), F.lit(0)).alias("ip_src"),
        F.coalesce(address.ip_to_long(F.col("dst_ip")), F.lit(0)).alias("ip_dst"),
        port("src_port"),
        port("dst_port"),
        F.when(F.col("proto") == 6, F.coalesce("tcp_flags", F.lit(0))).otherwise(0).cast("long").alias("tcp_flags"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("packet_length", "ttl", "proto")],
    )
