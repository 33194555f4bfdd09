"""The stand-in views in DuckDB SQL; the Spark side is in ``plans/standins.py``."""

from __future__ import annotations


def unit(seed: str | int, *parts: str) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5('{seed}:' || {text}), 1, 8))::UBIGINT / 4294967296.0)"


def digest(seed: str | int, *parts: str) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"md5('{seed}:' || {text})"


VIEWS: dict[str, str] = {}

VIEWS["packets"] = """
SELECT event_id AS packet_id, ts, epoch_us(ts) AS ts_us,
  '10.0.' || (user_id // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS src_ip,
  '10.1.0.' || (event_id % 256)::VARCHAR AS dst_ip,
  CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END AS proto,
  (1024 + event_id % 64511)::INTEGER AS src_port,
  (props->>'$.k')::INTEGER AS dst_port,
  (event_id % 64)::INTEGER AS tcp_flags,
  (32 + event_id % 224)::INTEGER AS ttl,
  (40 + floor(value))::INTEGER AS packet_length,
  CASE event_id % 50 WHEN 0 THEN 'GET /etc/passwd HTTP/1.1' WHEN 1 THEN 'SQL SELECT * FROM users'
    WHEN 2 THEN 'admin=1&password=x' WHEN 3 THEN 'SQL SELECT x' || chr(10) || ' FROM y'
    ELSE 'GET /index.html' END AS payload
FROM events"""

VIEWS["scored"] = f"""
SELECT id, label, u, prob,
  [0.0::DOUBLE, ln(greatest(0.01, least(0.99, prob)) / (1 - greatest(0.01, least(0.99, prob))))] AS logits
FROM (SELECT *, round(0.6::DOUBLE * u + 0.4::DOUBLE * label, 2) AS prob
  FROM (SELECT event_id AS id, (event_type = 'error')::INTEGER AS label, {unit(42, 'event_id')} AS u FROM events))"""

VIEWS["vectors"] = """
SELECT vec_id AS id, (label = 5)::INTEGER AS label,
  list_transform(embedding[1:20], lambda v: v::DOUBLE) AS x FROM embeddings"""

VIEWS["vectors10"] = """
SELECT vec_id AS id, label, list_transform(embedding[1:20], lambda v: v::DOUBLE) AS x FROM embeddings"""

VIEWS["flows"] = """
SELECT l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS extendedprice, l_discount::DOUBLE AS discount,
  l_tax::DOUBLE AS tax, l_linenumber::DOUBLE AS linenumber, l_partkey::DOUBLE AS partkey, l_suppkey::DOUBLE AS suppkey,
  l_linestatus AS linestatus,
  '10.2.' || (l_suppkey // 256)::VARCHAR || '.' || (l_suppkey % 256)::VARCHAR AS IPV4_SRC_ADDR,
  '10.3.' || ((l_partkey % 512) // 256)::VARCHAR || '.' || ((l_partkey % 512) % 256)::VARCHAR AS IPV4_DST_ADDR,
  l_returnflag AS Label
FROM lineitem"""

VIEWS["dirty_flows"] = """
SELECT CASE WHEN m < 4 THEN 'nan' WHEN m < 8 THEN 'inf' WHEN m < 12 THEN 'abc' WHEN m < 16 THEN '2000000'
    WHEN m < 20 THEN '' WHEN m < 24 THEN '1000000' ELSE l_quantity::VARCHAR END AS quantity,
  CASE WHEN m BETWEEN 500 AND 509 THEN 'NULL' ELSE l_discount::VARCHAR END AS discount,
  l_tax::VARCHAR AS tax, l_linenumber::VARCHAR AS linenumber,
  CASE WHEN m BETWEEN 700 AND 709 THEN 'null' WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS Label
FROM (SELECT *, (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000 AS m FROM lineitem)"""

VIEWS["attack_log"] = """
SELECT event_id AS id, ts AS "timestamp",
  '10.0.' || (user_id // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS source_ip,
  '10.1.0.' || (event_id % 256)::VARCHAR AS destination_ip,
  CASE WHEN event_id % 3 = 0 THEN '17' ELSE '6' END AS protocol,
  CASE event_id % 3 WHEN 0 THEN 'Port Scan' WHEN 1 THEN 'Potential Exploit Detected' ELSE 'Anomaly Detected' END AS attack_type
FROM events"""

VIEWS["run_history"] = """
SELECT event_id AS pos, event_type AS label,
  CASE WHEN event_id % 97 = 0 THEN 'unknown' WHEN event_id % 89 = 0 THEN NULL
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S:%f') END AS "timestamp",
  CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN NULL ELSE date_trunc('second', ts) END AS seen_at,
  'python ' || event_type AS command,
  CASE WHEN event_id % 5 < 3 THEN 'success' WHEN event_id % 5 = 3 THEN 'Warning' ELSE 'failed' END AS status,
  value AS duration, (50 + event_id % 51)::DOUBLE AS health_score,
  (CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 END)::DOUBLE AS model_variants
FROM events"""

VIEWS["chunk_metrics"] = """
SELECT o_orderkey AS idx, 1000 + o_custkey % 1000 AS actual_rows, o_totalprice::DOUBLE / 2000 AS ram_usage_mb,
  o_totalprice::DOUBLE / (1000 + o_custkey % 1000) AS mem_per_row, (1 + o_orderkey % 17)::DOUBLE / 8 AS load_time_sec,
  (1000 + o_custkey)::DOUBLE AS throughput_rows_sec, (o_orderkey % 100)::DOUBLE AS cpu_percent,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status
FROM orders"""


def with_views(names: str, body: str) -> str:
    """``body`` with the named views in front of it as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    extra = body.lstrip()
    if extra.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + extra[len("WITH RECURSIVE "):]
    if extra.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + extra[len("WITH "):]
    return "WITH " + ", ".join(parts) + " " + extra
