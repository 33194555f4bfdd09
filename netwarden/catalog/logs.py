"""Alert-log and run-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.catalog.prepare import as_double
from netwarden.catalog.views import unit, with_views
from netwarden.operators import alerts, history
from netwarden.plans import standins
from netwarden.plans.scale import hash_unit, stage_path
from netwarden.sources import alert_logs
from netwarden.sources import history as history_files

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def l1(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.full_log(standins.attack_log(spark, folder))


def l2(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.latest(standins.attack_log(spark, folder))


def l3(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.latest(standins.attack_log(spark, folder), 5)


def l4(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.attack_log(spark, folder).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.col("attack_type")).alias("event"),
        F.when(F.col("id") % 5 != 0, F.col("source_ip")).alias("source"),
    )
    return alerts.with_defaults(rows)


def l6(spark: SparkSession, folder: str) -> DataFrame:
    """Every error event is a simulated attack; nine in ten are answered, eight in ten logged."""
    attacks = standins.attack_log(spark, folder).select(F.col("id").alias("attack_id"))
    answered = attacks.where(hash_unit(1, F.col("attack_id")) < 0.9).withColumn(
        "response_time", (F.col("attack_id") % 16) / 4
    )
    logged = attacks.where(hash_unit(2, F.col("attack_id")) < 0.8)
    return as_double(
        alerts.score_card(attacks, logged, answered), ["accuracy_score", "avg_response_time", "log_score"]
    )


def s10(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to the partitioned log, read back."""
    log = standins.attack_log(spark, folder).drop("id")
    path = stage_path(spark, "alert-log")
    alert_logs.append_alerts(log.where(F.col("protocol") == "6"), path)
    alert_logs.append_alerts(log.where(F.col("protocol") != "6"), path)
    found = spark.read.parquet(path)
    return found.groupBy(F.col("day").cast("string").alias("day"), "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("alert_id").alias("ids")
    )


def s11(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        log = standins.attack_log(spark, folder)
        path = alert_logs.export(log, stage_path(spark, "export"), kind)
        schema = "id long, timestamp string, source_ip string, destination_ip string, protocol string, attack_type string"
        reader = spark.read.schema(schema)
        return reader.json(path) if kind == "json" else reader.option("header", True).csv(path)

    return run


def s12(spark: SparkSession, folder: str) -> DataFrame:
    """Alert arrays, one file per source; scan alerts lack destination and protocol."""
    log = standins.attack_log(spark, folder)
    scan = F.col("attack_type") == "Port Scan"
    record = F.struct(
        "source_ip",
        F.when(~scan, F.col("destination_ip")).alias("destination_ip"),
        F.when(~scan, F.col("protocol")).alias("protocol"),
        "attack_type",
    )
    # Files of a few hundred alerts each, as one session would write them.
    arrays = log.groupBy(F.expr("id div 1000").alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    path = stage_path(spark, "alert-json")
    arrays.select("value", "part").write.partitionBy("part").text(path)
    found = alert_logs.read_json_log(spark, f"{path}/part=*")
    return found.groupBy("source_ip", "protocol", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("destination_ip").alias("destinations")
    )


def s13(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_path(spark, "alert-text")
    alert_logs.format_lines(standins.attack_log(spark, folder)).write.text(path)
    found = alert_logs.read_text_log(spark, path)
    return found.select(
        F.unix_micros("timestamp").alias("at_us"), "source_ip", "destination_ip", "protocol", "attack_type"
    )


def s12h(spark: SparkSession, folder: str) -> DataFrame:
    """Run history as JSON arrays, one file per day of events, read back with positions."""
    runs = standins.run_history(spark, folder)
    record = F.struct("pos", F.struct("label", "timestamp", "command", "status", "duration").alias("run"))
    ordered = F.transform(F.array_sort(F.collect_list(record)), lambda r: r["run"])
    files = runs.groupBy(F.expr("pos div 1000").alias("part")).agg(F.to_json(ordered).alias("value"))
    path = stage_path(spark, "history")
    files.select("value", "part").write.partitionBy("part").text(path)
    found = history_files.read_array(spark, f"{path}/part=*")
    return found.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("duration"), F.count("timestamp").alias("stamps")
    )


def h1(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_per_label(standins.run_history(spark, folder)).select(
        "label", "pos", "status", "duration"
    )


def h2(spark: SparkSession, folder: str) -> DataFrame:
    return history.retained(standins.run_history(spark, folder), _now(), 10).select("pos", "label")


def h3(spark: SparkSession, folder: str) -> DataFrame:
    runs = standins.run_history(spark, folder).withColumn(
        "action", F.when(F.col("pos") % 1000 == 3, "completed")
    )
    out = history.retention_preview(runs, _now(), 10)
    return out.withColumns({c: F.unix_micros(c) for c in ("oldest", "newest")})


def h4(spark: SparkSession, folder: str) -> DataFrame:
    return history.newest(standins.run_history(spark, folder)).select("pos", "label", "status")


def h5(spark: SparkSession, folder: str) -> DataFrame:
    out = history.averages(standins.run_history(spark, folder))
    return as_double(out, [c for c in out.columns if c != "entries"])


def h6(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(history.trends(standins.run_history(spark, folder)), ["health_trend", "duration_trend"])


def h6r(spark: SparkSession, folder: str) -> DataFrame:
    """Positions begin late and have gaps once old runs are gone."""
    late = history.retained(standins.run_history(spark, folder), _now(), 10)
    return as_double(history.trends(late), ["health_trend", "duration_trend"])


def h7(spark: SparkSession, folder: str) -> DataFrame:
    runs = standins.run_history(spark, folder)
    out = history.grades(history.averages(runs))
    return out.select("health_grade", "success_grade", "duration_grade")


def h8(spark: SparkSession, folder: str) -> DataFrame:
    return history.previous_entries(standins.run_history(spark, folder)).select("pos", "label", "status")


def h9(spark: SparkSession, folder: str) -> DataFrame:
    out = history.load_rollup(standins.chunk_metrics(spark, folder))
    return as_double(out, [c for c in out.columns if c != "max_chunk_size"])


def h10(spark: SparkSession, folder: str) -> DataFrame:
    out = history.growth_guard(standins.chunk_metrics(spark, folder), 256.0)
    return as_double(out, ["recent"]).withColumn("may_grow", F.col("may_grow").cast("int"))


def h10g(spark: SparkSession, folder: str) -> DataFrame:
    chunks = standins.chunk_metrics(spark, folder).where("idx % 3 <> 1")
    return as_double(history.growth_guard(chunks, 256.0), ["recent"]).withColumn("may_grow", F.col("may_grow").cast("int"))


def h11(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.run_history(spark, folder)
    return rows.groupBy(history.status_kind(F.col("status")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "L1_full_log": l1,
    "L2_latest_alerts": l2,
    "L3_last_lines": l3,
    "L4_field_defaults": l4,
    "L6_score_card": l6,
    "S10_alert_append": s10,
    "S11_export_json": s11("json"),
    "S11_export_csv": s11("csv"),
    "S12_json_log": s12,
    "S13_text_log": s13,
    "D10_history_files": s12h,
    "H1_latest_per_label": h1,
    "H2_retention": h2,
    "H3_retention_preview": h3,
    "H4_newest": h4,
    "H5_averages": h5,
    "H6_trends": h6,
    "H6_trends_after_retention": h6r,
    "H7_grades": h7,
    "H8_previous_entries": h8,
    "H9_load_rollup": h9,
    "H10_growth_guard": h10,
    "H10_growth_guard_gaps": h10g,
    "H11_status_kinds": h11,
}

_ISO = (
    "strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(\"timestamp\") % 1000000 = 0 THEN '' "
    "ELSE '.' || lpad((epoch_us(\"timestamp\") % 1000000)::VARCHAR, 6, '0') END"
)
_LATEST = (
    f'SELECT id, {_ISO} AS "timestamp", attack_type AS event, source_ip AS source FROM attack_log '
    'ORDER BY attack_log."timestamp" DESC, id DESC LIMIT {n}'
)
_FULL = f'SELECT id, {_ISO} AS "timestamp", source_ip, destination_ip, protocol, attack_type FROM attack_log'
_CUT = f"(TIMESTAMP '{NOW}' - INTERVAL 10 DAY)"
_GRADE_IN = """SELECT avg(health_score) AS h, avg((lower(status) = 'success')::INTEGER) * 100 AS s, avg(duration) AS d FROM run_history"""

_LATE = f"(seen_at IS NULL OR seen_at > {_CUT})"

ORACLE = {
    "L1_full_log": with_views("attack_log", _FULL),
    "L2_latest_alerts": with_views("attack_log", _LATEST.format(n=10)),
    "L3_last_lines": with_views("attack_log", _LATEST.format(n=5)),
    "L4_field_defaults": with_views(
        "attack_log",
        """SELECT id, 'Unknown Time' AS "timestamp", CASE WHEN id % 3 <> 0 THEN attack_type ELSE 'Unknown Event' END AS event,
  CASE WHEN id % 5 <> 0 THEN source_ip ELSE 'Unknown Source' END AS source FROM attack_log""",
    ),
    "L6_score_card": with_views(
        "attack_log",
        f"""WITH a AS (SELECT id, {unit(1, 'id')} < 0.9 AS seen, {unit(2, 'id')} < 0.8 AS logged, (id % 16) / 4.0::DOUBLE AS rt FROM attack_log),
t AS (SELECT count(*) FILTER (seen)::DOUBLE / count(*)::DOUBLE * 100 AS acc, coalesce(avg(rt) FILTER (seen), 0) AS rt,
  count(*) FILTER (logged)::DOUBLE / count(*)::DOUBLE * 100 AS log FROM a)
SELECT round(acc * 0.5::DOUBLE + (100 - rt) * 0.3::DOUBLE + log * 0.2::DOUBLE, 2) AS total_score, round(acc, 6) AS accuracy_score,
  round(rt, 6) AS avg_response_time, round(log, 6) AS log_score FROM t""",
    ),
    "S10_alert_append": with_views(
        "attack_log",
        """SELECT strftime("timestamp", '%Y-%m-%d') AS day, attack_type, count(*) AS n,
  count(DISTINCT (epoch_us("timestamp"), source_ip, destination_ip, protocol)) AS ids FROM attack_log GROUP BY ALL""",
    ),
    "S11_export_json": with_views("attack_log", _FULL),
    "S11_export_csv": with_views("attack_log", _FULL),
    "S12_json_log": with_views(
        "attack_log",
        """SELECT source_ip, CASE WHEN attack_type = 'Port Scan' THEN NULL ELSE protocol END AS protocol, attack_type, count(*) AS n,
  count(*) FILTER (attack_type <> 'Port Scan') AS destinations FROM attack_log GROUP BY ALL""",
    ),
    "S13_text_log": with_views(
        "attack_log",
        """SELECT epoch_us(date_trunc('millisecond', "timestamp")) AS at_us, source_ip, destination_ip, protocol, attack_type FROM attack_log""",
    ),
    "D10_history_files": with_views(
        "run_history",
        """SELECT pos % 1000 AS pos, count(*) AS n, round(sum(duration), 4) AS duration, count("timestamp") AS stamps FROM run_history GROUP BY ALL""",
    ),
    "H1_latest_per_label": with_views(
        "run_history",
        """SELECT label, pos, status, duration FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos DESC) AS rn FROM run_history)
WHERE rn = 1""",
    ),
    "H2_retention": with_views("run_history", f"SELECT pos, label FROM run_history WHERE seen_at IS NULL OR seen_at > {_CUT}"),
    "H3_retention_preview": with_views(
        "run_history",
        f"""SELECT count(*) AS entries, count(*) FILTER (seen_at <= {_CUT}) AS removable, epoch_us(min(seen_at)) AS oldest, epoch_us(max(seen_at)) AS newest,
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(seen_at))) // 86400000000 AS age_days,
  (SELECT "timestamp" FROM run_history WHERE pos % 1000 = 3 AND "timestamp" IS NOT NULL ORDER BY pos DESC LIMIT 1) AS last_cleanup
FROM run_history""",
    ),
    "H4_newest": with_views("run_history", "SELECT pos, label, status FROM run_history ORDER BY pos DESC LIMIT 50"),
    "H5_averages": with_views(
        "run_history",
        """SELECT count(*) AS entries, round(avg((lower(status) = 'success')::INTEGER) * 100, 6) AS success_rate, round(avg(health_score), 6) AS avg_health,
  round(avg(duration), 6) AS avg_duration, round(avg(coalesce(model_variants, 0)), 6) AS avg_models FROM run_history""",
    ),
    **{
        name: with_views(
            "run_history",
            f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS nth FROM run_history WHERE {kept}),
n AS (SELECT count(*) // 2 AS half FROM r),
t AS (SELECT avg(health_score) FILTER (nth >= half) - avg(health_score) FILTER (nth < half) AS h,
  avg(duration) FILTER (nth >= half) - avg(duration) FILTER (nth < half) AS d FROM r, n)
SELECT round(h, 6) AS health_trend, round(d, 6) AS duration_trend,
  CASE WHEN h > 1 THEN 'Improving' WHEN h < -1 THEN 'Declining' ELSE 'Stable' END AS health_text,
  CASE WHEN d < -0.1 THEN 'Getting Faster' WHEN d > 0.1 THEN 'Getting Slower' ELSE 'Consistent' END AS duration_text FROM t""",
        )
        for name, kept in (("H6_trends", "true"), ("H6_trends_after_retention", _LATE))
    },
    "H7_grades": with_views(
        "run_history",
        f"""SELECT CASE WHEN h > 80 THEN 'good' WHEN h > 60 THEN 'fair' ELSE 'poor' END AS health_grade,
  CASE WHEN s > 90 THEN 'good' WHEN s > 70 THEN 'fair' ELSE 'poor' END AS success_grade,
  CASE WHEN d < 2 THEN 'good' WHEN d < 5 THEN 'fair' ELSE 'poor' END AS duration_grade FROM ({_GRADE_IN})""",
    ),
    "H8_previous_entries": with_views(
        "run_history", "SELECT pos, label, status FROM run_history ORDER BY pos DESC LIMIT 3 OFFSET 1"
    ),
    "H9_load_rollup": with_views(
        "chunk_metrics",
        """SELECT round(avg(throughput_rows_sec), 6) AS average_throughput, max(actual_rows) AS max_chunk_size, round(min(mem_per_row), 6) AS min_memory_per_row,
  round(max(cpu_percent), 6) AS max_cpu_usage, round(sum(load_time_sec), 6) AS total_processing_time FROM chunk_metrics""",
    ),
    **{
        name: with_views(
            "chunk_metrics",
            f"""WITH w AS (SELECT *, avg(throughput_rows_sec) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
  row_number() OVER (ORDER BY idx) AS nth FROM chunk_metrics WHERE {kept})
SELECT idx, throughput_rows_sec, round(recent, 6) AS recent,
  (nth > 3 AND throughput_rows_sec > recent * 0.9 AND ram_usage_mb < 256 * 0.8 AND cpu_percent < 85)::INTEGER AS may_grow FROM w""",
        )
        for name, kept in (("H10_growth_guard", "true"), ("H10_growth_guard_gaps", "idx % 3 <> 1"))
    },
    "H11_status_kinds": with_views(
        "run_history",
        """SELECT CASE lower(status) WHEN 'success' THEN 'SUCCESS' WHEN 'warning' THEN 'WARNING' WHEN 'partial' THEN 'WARNING' ELSE 'ERROR' END AS kind,
  count(*) AS n FROM run_history GROUP BY ALL""",
    ),
}
