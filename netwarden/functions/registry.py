"""SQL names for the column expressions, as temporary SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from netwarden.functions.address import IPV4
from netwarden.functions.values import TRUE_WORDS
from netwarden.operators.signatures import PATTERNS
from netwarden.operators.verdict import ANOMALY_BUFFER, ATTACK_PROBABILITY


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Create the functions; they are inlined into plans like any built-in expression."""
    either = "(?d)" + "|".join(f"(?:{p})" for p in PATTERNS)
    words = ", ".join(_quoted(w) for w in TRUE_WORDS)
    bodies = {
        "ip_to_long(ip STRING) RETURNS BIGINT": f"""CASE WHEN ip RLIKE {_quoted(IPV4)} THEN
            aggregate(split(ip, '[.]'), 0L, (t, p) -> t * 256 + try_cast(p AS BIGINT)) END""",
        "cidr_network(cidr STRING) RETURNS BIGINT": """ip_to_long(substring_index(cidr, '/', 1))
            - pmod(ip_to_long(substring_index(cidr, '/', 1)), shiftleft(1L, 32 - CAST(substring_index(cidr, '/', -1) AS INT)))""",
        "dpi_match(payload BINARY) RETURNS BOOLEAN": f"coalesce(decode(payload, 'ISO-8859-1') RLIKE {_quoted(either)}, false)",
        "hybrid_verdict(prob DOUBLE, mse DOUBLE, threshold DOUBLE) RETURNS STRING": f"""CASE
            WHEN prob IS NULL OR isnan(prob) THEN 'Error: Invalid model output'
            WHEN prob > {ATTACK_PROBABILITY}D THEN 'Known Attack'
            WHEN mse IS NULL OR isnan(mse) THEN 'Error: Invalid autoencoder output'
            WHEN mse > threshold * {ANOMALY_BUFFER}D THEN 'Unknown Anomaly' ELSE 'Normal' END""",
        "softmax2(z0 DOUBLE, z1 DOUBLE) RETURNS DOUBLE": "exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))",
        "text_to_bool(v STRING) RETURNS BOOLEAN": f"coalesce(lower(v) IN ({words}), false)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
