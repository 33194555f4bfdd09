"""Signature, scan, cooldown and verdict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.catalog.views import unit, with_views
from netwarden.operators import cooldown, portscan, signatures, verdict
from netwarden.plans import standins
from netwarden.plans.scale import hash_unit, stage

HOUR, DAY = 3600.0, 86400.0
ALERT_COLUMNS = "packet_id, epoch_us(ts) AS ts_us"


def with_scores(packets: DataFrame) -> DataFrame:
    """Model outputs for packets, derived from the packet id."""
    return (
        packets.withColumn("prob", F.round(hash_unit(42, F.col("packet_id")), 3))
        .withColumn("score", F.round(hash_unit(7, F.col("packet_id")), 3))
        .withColumn("model_class", (hash_unit(9, F.col("packet_id")) < 0.02).cast("int"))
    )


PACKET_SCORES = f"""
ps AS (SELECT *, round({unit(42, 'packet_id')}, 3) AS prob, round({unit(7, 'packet_id')}, 3) AS score,
  ({unit(9, 'packet_id')} < 0.02)::INTEGER AS model_class FROM packets)"""

SIGNED = (
    "(payload LIKE '%GET /etc/passwd%' OR regexp_matches(payload, 'SQL SELECT .* FROM')"
    " OR regexp_matches(payload, 'admin.*password'))"
)


def scan_sql(seconds: float, threshold: int) -> str:
    us = int(seconds * 1e6)
    return f"""
sc AS (SELECT a.packet_id, a.src_ip, a.ts_us, count(DISTINCT b.dst_port) AS n_ports, list_sort(list(DISTINCT b.dst_port)) AS ports
  FROM packets a JOIN packets b ON a.src_ip = b.src_ip AND b.proto = 6 AND b.ts_us BETWEEN a.ts_us - {us} AND a.ts_us
  WHERE a.proto = 6 GROUP BY ALL HAVING count(DISTINCT b.dst_port) > {threshold})"""


def chain_sql(seconds: float) -> str:
    """Kept packets per source by following the chain one packet at a time."""
    us = int(seconds * 1e6)
    return f"""
d AS (SELECT src_ip, ts_us, min(packet_id) AS packet_id FROM packets GROUP BY ALL),
kept AS (SELECT src_ip, min(ts_us) AS ts_us FROM d GROUP BY src_ip
  UNION ALL
  SELECT k.src_ip, (SELECT min(d.ts_us) FROM d WHERE d.src_ip = k.src_ip AND d.ts_us >= k.ts_us + {us}) AS ts_us
  FROM kept k WHERE k.ts_us IS NOT NULL),
gate AS (SELECT d.packet_id FROM kept JOIN d ON kept.src_ip = d.src_ip AND kept.ts_us = d.ts_us)"""


def t1(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.signature_alerts(standins.packets(spark, folder)).select(
        "packet_id",
        "src_ip",
        "attack_type",
        signatures.first_signature(F.col("payload")).alias("pattern"),
    )


def t1r(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns as a table, with one more that only wins where no other matches."""
    rules = [(i, 10 * i, p, signatures.MATCH_LABEL) for i, p in enumerate(signatures.PATTERNS)]
    rules += [(7, 1000, "GET /", "Web Request"), (8, 2000, None, "never")]
    table = spark.createDataFrame(rules[::-1], "rule_id int, priority int, pattern string, label string")
    return signatures.match_rules(standins.packets(spark, folder), table).select("packet_id", "rule_id", "label")


def t2k(spark: SparkSession, folder: str) -> DataFrame:
    """Ports per source over all days, from stored daily sketches, against the exact count."""
    tcp = portscan.tcp_only(standins.packets(spark, folder))
    stored = stage(portscan.port_sketches(tcp, "1 day"), "sketches")
    merged = portscan.merged_ports(stored, "src_ip")
    exact = tcp.groupBy("src_ip").agg(F.count_distinct("dst_port").alias("exact"))
    # Four deviations of the sketch's relative error, and one port where counts are small.
    bound = F.greatest(F.lit(1.0), F.col("exact") * (4 * 0.8 / 2 ** (portscan.SKETCH_BITS / 2)))
    return exact.join(merged, "src_ip").select(
        "src_ip", F.col("exact").alias("n_ports"), "n_packets",
        (F.abs(F.col("n_ports") - F.col("exact")) <= bound).cast("int").alias("within"),
    )


def t2(seconds: float, threshold: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = portscan.scan_alerts(standins.packets(spark, folder), seconds, threshold)
        return found.select("packet_id", "src_ip", "ts_us", "n_ports")

    return run


def t2s(spark: SparkSession, folder: str) -> DataFrame:
    return portscan.windowed_ports(portscan.tcp_only(standins.packets(spark, folder)), "1 day").select(
        "src_ip", F.unix_micros("start").alias("start_us"), "n_ports", "n_packets"
    )


def t3(spark: SparkSession, folder: str) -> DataFrame:
    found = portscan.scan_port_sets(standins.packets(spark, folder), DAY, 3)
    return found.select(
        "src_ip", "ts_us", "n_ports", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports")
    )


def t4(seconds: float):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return cooldown.after_cooldown(standins.packets(spark, folder), seconds).select(
            "packet_id", "src_ip", "ts_us"
        )

    return run


def t5(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.scored(spark, folder)
    return rows.select("id", "prob", verdict.supervised_attack(F.col("prob")).cast("int").alias("attack"))


def reconstructed(spark: SparkSession, folder: str) -> DataFrame:
    """Feature arrays with a reconstruction that differs by a known amount per row."""
    rows = standins.vectors(spark, folder)
    return rows.withColumn(
        "xhat", F.transform("x", lambda v: v * (F.lit(1.0) - (F.col("id") % 7) / F.lit(10.0)))
    ).withColumn("prob", F.round(hash_unit(42, F.col("id")), 3))


RECON = f"""
r AS (SELECT *, list_transform(x, lambda v: v * (1.0::DOUBLE - (id % 7) / 10.0::DOUBLE)) AS xhat,
  round({unit(42, 'id')}, 3) AS prob FROM vectors),
e AS (SELECT *, list_sum(list_transform(list_zip(x, xhat), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(x) AS mse FROM r)"""


def t6(spark: SparkSession, folder: str) -> DataFrame:
    rows = reconstructed(spark, folder)
    return rows.select(
        "id", F.round(verdict.reconstruction_error(F.col("x"), F.col("xhat")), 9).alias("mse")
    )


def t7(spark: SparkSession, folder: str) -> DataFrame:
    score = verdict.reconstruction_error(F.col("x"), F.col("xhat"))
    return reconstructed(spark, folder).select(
        "id",
        verdict.is_anomaly(score, 0.001).cast("int").alias("over"),
        verdict.is_anomaly(score, 0.001, verdict.ANOMALY_BUFFER).cast("int").alias("over_buffered"),
    )


def broken_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Reconstructed rows of which some are short, hold NaN or have no valid model output."""
    rows = reconstructed(spark, folder)
    score = verdict.reconstruction_error(F.col("x"), F.col("xhat"))
    features = (
        F.when(F.col("id") % 50 == 1, F.slice("x", 1, 19))
        .when(F.col("id") % 50 == 2, F.transform("x", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v)))
        .otherwise(F.col("x"))
    )
    prob = F.when(F.col("id") % 50 == 3, F.lit(float("nan"))).otherwise(F.col("prob"))
    return rows.select("id", features.alias("features"), prob.alias("prob"), score.alias("mse"))


VERDICT_SQL = """CASE WHEN id % 50 = 1 THEN 'Error: Expected 20 features, got 19'
  WHEN id % 50 = 2 THEN 'Error: Input contains NaN values' WHEN id % 50 = 3 THEN 'Error: Invalid model output'
  WHEN prob > 0.7 THEN 'Known Attack' WHEN mse > 0.001::DOUBLE * 1.1::DOUBLE THEN 'Unknown Anomaly' ELSE 'Normal' END"""


def t8(spark: SparkSession, folder: str) -> DataFrame:
    rows = broken_rows(spark, folder)
    return rows.select(
        "id", verdict.cascade(F.col("features"), F.col("prob"), F.col("mse"), 0.001).alias("verdict")
    )


def t13(spark: SparkSession, folder: str) -> DataFrame:
    table = verdict.margin_table(broken_rows(spark, folder), 0.001)
    return table.withColumn("mse", F.round("mse", 9)).withColumn("threshold_diff", F.round("threshold_diff", 9))


def c13(spark: SparkSession, folder: str) -> DataFrame:
    return broken_rows(spark, folder).select(
        "id", verdict.input_error(F.col("features")).alias("error")
    )


def _alerts(found: DataFrame) -> DataFrame:
    return found.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


def t9(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_scores(standins.packets(spark, folder))
    return _alerts(verdict.detector_verdicts(rows, 0.97, DAY, 3))


def t10(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_scores(standins.packets(spark, folder))
    return _alerts(verdict.sniffer_verdicts(rows, HOUR))


def prediction_scale(spark: SparkSession, folder: str) -> DataFrame:
    out = verdict.prediction_scale(standins.scored(spark, folder))
    return out.select(
        "id",
        F.round("magnitude_ratio", 6).alias("magnitude_ratio"),
        F.col("scale_warning").cast("int").alias("scale_warning"),
        F.round(F.col("probs")[1], 6).alias("attack_prob"),
        "predicted",
        F.col("confidence_warning").cast("int").alias("confidence_warning"),
    )


def v11(spark: SparkSession, folder: str) -> DataFrame:
    probs = F.array(F.lit(1.0) - F.col("prob"), F.col("prob"))
    return standins.scored(spark, folder).select(
        "id",
        verdict.adjusted_class(probs, 0.35).alias("at_35"),
        verdict.adjusted_class(probs, 0.5).alias("at_50"),
    )


QUERIES = {
    "T1_signature_match": t1,
    "T1_rules_table": t1r,
    "T2S_merged_sketches": t2k,
    "T2_port_scan_hour": t2(HOUR, 2),
    "T2_port_scan_day": t2(DAY, 3),
    "T2_port_scan_default": t2(portscan.SCAN_SECONDS, portscan.SCAN_PORTS),
    "T2S_windowed_ports": t2s,
    "T3_scan_port_sets": t3,
    "T4_cooldown_default": t4(cooldown.COOLDOWN_SECONDS),
    "T4_cooldown_hour": t4(HOUR),
    "T4_cooldown_day": t4(DAY),
    "T5_supervised_rule": t5,
    "T6_reconstruction_error": t6,
    "T7_anomaly_rule": t7,
    "T8_cascade_verdict": t8,
    "T9_detector_verdict": t9,
    "T10_sniffer_verdict": t10,
    "T13_margin_table": t13,
    "C13_input_validation": c13,
    "E11_prediction_scale": prediction_scale,
    "V11_adjusted_class": v11,
}

_T2 = "WITH {} SELECT packet_id, src_ip, ts_us, n_ports FROM sc"
_T4 = "WITH RECURSIVE {} SELECT packet_id, src_ip, ts_us FROM packets WHERE packet_id IN (SELECT packet_id FROM gate)"

ORACLE = {
    "T1_rules_table": with_views(
        "packets",
        """SELECT * FROM (SELECT packet_id, CASE WHEN payload LIKE '%GET /etc/passwd%' THEN 0 WHEN regexp_matches(payload, 'SQL SELECT .* FROM') THEN 1
  WHEN regexp_matches(payload, 'admin.*password') THEN 2 WHEN payload LIKE '%GET /%' THEN 7 END AS rule_id,
  CASE rule_id WHEN 7 THEN 'Web Request' ELSE 'Potential Exploit Detected' END AS label FROM packets) WHERE rule_id IS NOT NULL""",
    ),
    "T2S_merged_sketches": with_views(
        "packets",
        """SELECT src_ip, count(DISTINCT dst_port) AS n_ports, count(*) AS n_packets, 1 AS within
FROM packets WHERE proto = 6 AND src_ip IS NOT NULL AND dst_port IS NOT NULL GROUP BY src_ip""",
    ),
    "T1_signature_match": with_views(
        "packets",
        f"""SELECT packet_id, src_ip, 'Potential Exploit Detected' AS attack_type,
  CASE WHEN payload LIKE '%GET /etc/passwd%' THEN 'GET /etc/passwd'
    WHEN regexp_matches(payload, 'SQL SELECT .* FROM') THEN 'SQL SELECT .* FROM' ELSE 'admin.*password' END AS pattern
FROM packets WHERE {SIGNED}""",
    ),
    "T2_port_scan_hour": with_views("packets", _T2.format(scan_sql(HOUR, 2))),
    "T2_port_scan_day": with_views("packets", _T2.format(scan_sql(DAY, 3))),
    "T2_port_scan_default": with_views("packets", _T2.format(scan_sql(5, 10))),
    "T2S_windowed_ports": with_views(
        "packets",
        """SELECT src_ip, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start_us, count(DISTINCT dst_port) AS n_ports, count(*) AS n_packets
FROM packets WHERE proto = 6 GROUP BY ALL""",
    ),
    "T3_scan_port_sets": with_views(
        "packets",
        f"WITH {scan_sql(DAY, 3)} SELECT DISTINCT src_ip, ts_us, n_ports, array_to_string(ports, ',') AS ports FROM sc",
    ),
    "T4_cooldown_default": with_views("packets", _T4.format(chain_sql(5))),
    "T4_cooldown_hour": with_views("packets", _T4.format(chain_sql(HOUR))),
    "T4_cooldown_day": with_views("packets", _T4.format(chain_sql(DAY))),
    "T5_supervised_rule": with_views("scored", "SELECT id, prob, (prob > 0.7::DOUBLE)::INTEGER AS attack FROM scored"),
    "T6_reconstruction_error": with_views("vectors", f"WITH {RECON} SELECT id, round(mse, 9) AS mse FROM e"),
    "T7_anomaly_rule": with_views(
        "vectors",
        f"""WITH {RECON} SELECT id, (mse > 0.001::DOUBLE)::INTEGER AS over,
  (mse > 0.001::DOUBLE * 1.1::DOUBLE)::INTEGER AS over_buffered FROM e""",
    ),
    "T8_cascade_verdict": with_views("vectors", f"WITH {RECON} SELECT id, {VERDICT_SQL} AS verdict FROM e"),
    "T13_margin_table": with_views(
        "vectors",
        f"""WITH {RECON} SELECT id, {VERDICT_SQL} AS verdict, round(mse, 9) AS mse, round(mse - 0.001::DOUBLE, 9) AS threshold_diff,
  CASE WHEN mse > 0.001::DOUBLE * 1.1::DOUBLE THEN 'ALERT' ELSE 'OK' END AS state FROM e""",
    ),
    "C13_input_validation": with_views(
        "vectors",
        """SELECT id, CASE id % 50 WHEN 1 THEN 'Expected 20 features, got 19' WHEN 2 THEN 'Input contains NaN values' END AS error
FROM vectors""",
    ),
    "T9_detector_verdict": with_views(
        "packets",
        f"""WITH {PACKET_SCORES}, {scan_sql(DAY, 3)}
SELECT p.packet_id, p.ts_us, p.src_ip AS source_ip,
  CASE WHEN sc.packet_id IS NULL THEN p.dst_ip END AS destination_ip,
  CASE WHEN sc.packet_id IS NULL THEN p.proto::VARCHAR END AS protocol,
  CASE WHEN sc.packet_id IS NOT NULL THEN 'Port Scan' WHEN {SIGNED} THEN 'Potential Exploit Detected'
    ELSE 'Anomaly Detected' END AS attack_type
FROM ps p LEFT JOIN sc ON p.packet_id = sc.packet_id
WHERE sc.packet_id IS NOT NULL OR {SIGNED} OR score > 0.97::DOUBLE OR model_class = 1""",
    ),
    "T10_sniffer_verdict": with_views(
        "packets",
        f"""WITH RECURSIVE {PACKET_SCORES}, {chain_sql(HOUR)}
SELECT packet_id, ts_us, src_ip AS source_ip, dst_ip AS destination_ip, proto::VARCHAR AS protocol,
  CASE WHEN {SIGNED} THEN 'Potential Exploit Detected' ELSE 'Anomaly Detected' END AS attack_type
FROM ps WHERE packet_id IN (SELECT packet_id FROM gate) AND ({SIGNED} OR prob > 0.7::DOUBLE)""",
    ),
    "E11_prediction_scale": with_views(
        "scored",
        """WITH m AS (SELECT max(abs(a)) AS top, min(CASE WHEN abs(a) > 0 THEN abs(a) END) AS low
  FROM (SELECT unnest(logits) AS a FROM scored)),
s AS (SELECT id, top, low, logits[2] / greatest(1.0, top / 100) AS z FROM scored, m),
p AS (SELECT *, exp(z - greatest(z, 0)) / (exp(z - greatest(z, 0)) + exp(0 - greatest(z, 0)) + 1e-10) AS p1,
  exp(0 - greatest(z, 0)) / (exp(z - greatest(z, 0)) + exp(0 - greatest(z, 0)) + 1e-10) AS p0 FROM s)
SELECT id, round(top / low, 6) AS magnitude_ratio, (top > 1000 OR top / low > 1e6)::INTEGER AS scale_warning,
  round(p1, 6) AS attack_prob, CASE WHEN p1 > p0 THEN 'Attack' ELSE 'Normal' END AS predicted,
  (greatest(p0, p1) > 0.99 OR greatest(p0, p1) < 0.6)::INTEGER AS confidence_warning FROM p""",
    ),
    "V11_adjusted_class": with_views(
        "scored",
        """SELECT id, (prob >= 0.35::DOUBLE)::INTEGER AS at_35, (prob > 1.0::DOUBLE - prob)::INTEGER AS at_50 FROM scored""",
    ),
}
