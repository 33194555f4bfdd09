"""Scans, cleaning, encoding and scaling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.catalog.views import unit, with_views
from netwarden.functions import address, values
from netwarden.operators import clean, encode, packets
from netwarden.plans import standins
from netwarden.plans.scale import stage_path
from netwarden.sources import flows, tables

FEATURES = standins.DIRTY_FEATURES
LABEL = "Label"


def as_double(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# --- sources ---------------------------------------------------------------------------

FLOW_CSV = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("quantity", "extendedprice", "discount")]
    + [T.StructField("linestatus", T.StringType())]
)


def flow_csv(spark: SparkSession, folder: str, broken: bool = False) -> str:
    """The flow table as CSV files in the shared folder, some lines with a bad number if asked."""
    rows = standins.flows(spark, folder).select(*FLOW_CSV.names)
    if broken:
        bad = F.col("quantity") == 7
        rows = rows.withColumn("discount", F.when(bad, "none").otherwise(F.col("discount").cast("string")))
    path = stage_path(spark, "csv") + "/flows.csv"
    rows.write.option("header", True).csv(path)
    return path


def s1(spark: SparkSession, folder: str) -> DataFrame:
    df = flows.scan(spark, flow_csv(spark, folder), FLOW_CSV, ["quantity", "linestatus"], bad_lines="skip")
    return df.groupBy("linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


def s2(mode: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = flows.scan(spark, flow_csv(spark, folder, broken=True), FLOW_CSV, bad_lines=mode)
        if mode == "warn":
            return flows.bad_line_counts(df)
        return df.agg(F.count("discount").alias("good_lines"), F.round(F.sum("quantity"), 2).alias("quantity"))

    return run


def s2_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that are well-formed in every line, from a file with lines that are bad elsewhere."""
    path = flow_csv(spark, folder, broken=True)
    one = flows.scan(spark, path, FLOW_CSV, ["linestatus"], bad_lines="skip")
    rows = flows.scan(spark, path, FLOW_CSV, bad_lines="skip")
    return one.groupBy("linestatus").agg(F.count(F.lit(1)).alias("n")).withColumn("lines", F.lit(rows.count()))


def s3(spark: SparkSession, folder: str) -> DataFrame:
    df = flows.parse_cells(standins.dirty_flows(spark, folder), {c: "double" for c in FEATURES})
    return df.agg(
        *[F.count(c).alias(f"n_{c}") for c in [*FEATURES, LABEL]],
        F.round(F.sum("quantity"), 2).alias("quantity"),
    )


def s4(spark: SparkSession, folder: str) -> DataFrame:
    found = flows.sampled_schema(spark, flow_csv(spark, folder), 500, "float")
    rows = [(f.name, f.dataType.simpleString()) for f in found.fields]
    counted = flows.scan(spark, flow_csv(spark, folder), found, bad_lines="skip")
    types = spark.createDataFrame(rows, "feature string, type string")
    return types.withColumn("rows", counted.agg(F.count(F.lit(1))).scalar())


def s5(spark: SparkSession, folder: str) -> DataFrame:
    return flows.validate(standins.flows(spark, folder), ["quantity", "Label", "absent"])


def s6(spark: SparkSession, folder: str) -> DataFrame:
    df = flows.scan(spark, flow_csv(spark, folder), FLOW_CSV, bad_lines="skip")
    return df.agg(F.count(F.lit(1)).alias("n"))


def s7(spark: SparkSession, folder: str) -> DataFrame:
    found = flows.list_datasets(spark, folder, "*.parquet")
    return found.select(F.substring_index("path", "/", -1).alias("name"))


def s8(spark: SparkSession, folder: str) -> DataFrame:
    path = tables.write_table(standins.flows(spark, folder), stage_path(spark, "flows"), partition_by=[LABEL])
    return spark.read.parquet(path).groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("tax"), 2).alias("tax")
    )


def s9(spark: SparkSession, folder: str) -> DataFrame:
    fitted = encode.fit_min_max(standins.flows(spark, folder), standins.FLOW_NUMERIC)
    return tables.load_artifacts(spark, tables.save_artifacts(fitted, stage_path(spark, "artifacts")))


def s9_checks(spark: SparkSession, folder: str) -> DataFrame:
    return tables.artifact_checks(s9(spark, folder), len(standins.FLOW_NUMERIC))


def s14(spark: SparkSession, folder: str) -> DataFrame:
    totals = standins.flows(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), F.max("partkey").cast("long").alias("max_partkey")
    )
    path = tables.write_report(totals, stage_path(spark, "report"))
    return spark.read.schema("metric string, value string").option("header", True).csv(path)


def s15(spark: SparkSession, folder: str) -> DataFrame:
    """Generated rows, as many as there are flows; the class sizes are checked."""
    n = standins.flows(spark, folder).count()
    rows = tables.synthetic_labelled(spark, n)
    return rows.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.least(*[f"feature_{i}" for i in range(20)]) >= 0).cast("int").alias("above"),
        F.max(F.greatest(*[f"feature_{i}" for i in range(20)]) <= 1).cast("int").alias("below"),
        F.round(F.avg("feature_0"), 1).alias("centre"),
    )


def s16(spark: SparkSession, folder: str) -> DataFrame:
    ids = standins.packets(spark, folder).select(F.col("packet_id").alias("id"))
    x = F.col("x")
    return tables.sample_rows(ids).select(
        "id", *[F.round(x[i], 6).alias(f"x{i}") for i in (0, 1, 2, 3, 4, 19)]
    )


# --- cleaning --------------------------------------------------------------------------


def numeric(spark: SparkSession, folder: str) -> DataFrame:
    """The text table's content as already typed columns."""
    m = F.col("m")
    mix = F.expr("(l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000")
    return standins.table(spark, folder, "lineitem").withColumn("m", mix).select(
        F.when((m < 12) | m.between(16, 19), None)
        .when(m < 16, 2e6)
        .when(m < 24, 1e6)
        .otherwise(F.col("l_quantity"))
        .cast("float")
        .alias("quantity"),
        F.when(~m.between(500, 509), F.col("l_discount")).cast("float").alias("discount"),
        F.col("l_tax").cast("float").alias("tax"),
        F.col("l_linenumber").cast("float").alias("linenumber"),
        F.when(~m.between(700, 709), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
        .cast("float")
        .alias(LABEL),
    )


def c1(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(clean.drop_null_rows(numeric(spark, folder)))


def c2(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(clean.drop_null_rows(numeric(spark, folder), [LABEL]))


def c3(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(clean.fill_features(numeric(spark, folder), FEATURES))


def _sums(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in df.columns],
        *[F.round(F.sum(F.col(c).cast("double")), 2).alias(f"sum_{c}") for c in ("quantity", "linenumber")],
    )


def c4(spark: SparkSession, folder: str) -> DataFrame:
    rows = numeric(spark, folder).withColumn("mostly_null", F.when(F.col("quantity") == 1, 1.0))
    kept = clean.drop_sparse_columns(rows)
    shares = clean.null_shares(rows).withColumn("null_share", F.round("null_share", 9))
    return shares.withColumn("kept", F.col("column").isin(kept.columns).cast("int"))


def c5(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(clean.distinct_rows(numeric(spark, folder)), [*FEATURES, LABEL])


def c6(spark: SparkSession, folder: str) -> DataFrame:
    return clean.conversion_counts(standins.dirty_flows(spark, folder), [*FEATURES, LABEL])


def c7(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.fill_features(numeric(spark, folder), FEATURES)
    return _sums(rows.where(clean.in_range(FEATURES)))


def c8(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(clean.clean(standins.dirty_flows(spark, folder), FEATURES), [*FEATURES, LABEL])


def c9(spark: SparkSession, folder: str) -> DataFrame:
    report = clean.cleaning_report(standins.dirty_flows(spark, folder), FEATURES)
    return report.withColumn("clean_percent", F.round("clean_percent", 6))


def c10(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.select_and_pad(standins.flows(spark, folder), [*standins.FLOW_NUMERIC, "absent"], 9)
    return rows.groupBy("linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(c), 2).alias(c) for c in ("quantity", "synthetic_feature_0", "synthetic_feature_1")],
    )


def c11(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.reorder(standins.flows(spark, folder), ["tax", "absent", "quantity"])
    return rows.groupBy("quantity").agg(F.sum("absent").alias("absent"), F.round(F.sum("tax"), 2).alias("tax"))


def unclean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Three vector columns with NaN, infinite and missing cells."""
    x = F.col("x")
    rows = standins.vectors(spark, folder)
    return rows.select(
        "id",
        F.when(F.col("id") % 10 == 1, F.lit(float("nan"))).otherwise(x[0]).alias("a"),
        F.when(F.col("id") % 10 == 2, F.lit(float("inf"))).otherwise(x[1]).alias("b"),
        F.when(F.col("id") % 10 == 3, None).otherwise(x[2] * 4).alias("c"),
    )


def c12(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_double(clean.repair(unclean_vectors(spark, folder), ["a", "b", "c"], method), ["a", "b", "c"])

    return run


def c14(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.require_classes(standins.flows(spark, folder))
    return clean.class_count(rows).withColumn("ok", F.col("ok").cast("int"))


def c15(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.rename(standins.flows(spark, folder), {"quantity": "feature_0", "tax": "feature_1"})
    return rows.groupBy("feature_0").agg(F.round(F.sum("feature_1"), 2).alias("feature_1"))


def c16(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.flows(spark, folder)
    sets = clean.column_sets(rows, ["tax", "absent", "quantity"])
    listed = spark.createDataFrame([(k, ",".join(v)) for k, v in sets.items()], "kind string, columns string")
    return listed.withColumn("rows", rows.agg(F.count(F.lit(1))).scalar())


# --- encoding --------------------------------------------------------------------------


def e1(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.when(F.col("packet_id") % 100 == 0, F.concat("src_ip", F.lit(".9"))).otherwise(F.col("src_ip"))
    return standins.packets(spark, folder).select("packet_id", address.ip_to_long(ip).alias("ip"))


def e2(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses 2001:db8::<user>:<port> and, for every fourth packet, ::ffff:<port>."""
    low = F.lower(F.hex("dst_port"))
    text = F.when(F.col("packet_id") % 4 == 0, F.concat(F.lit("::ffff:"), low)).otherwise(
        F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.expr("packet_id % 4096"))), F.lit(":"), low)
    )
    rows = standins.packets(spark, folder).withColumn("v6", text)
    halves = address.ipv6_halves(F.col("v6"))
    return rows.select(
        "packet_id", address.ipv6_hex(F.col("v6")).alias("hex"), halves["high"].alias("high"), halves["low"].alias("low")
    )


def e3(spark: SparkSession, folder: str) -> DataFrame:
    cidr = F.concat("dst_ip", F.lit("/"), F.expr("cast(packet_id % 33 as string)"))
    return standins.packets(spark, folder).select("packet_id", address.cidr_network(cidr).alias("network"))


def e4(spark: SparkSession, folder: str) -> DataFrame:
    return packets.packet_features(standins.packets(spark, folder))


def e5(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.packets(spark, folder)
    known = encode.fit_dictionary(rows.where(F.col("proto") == 17), "src_ip")
    return encode.encode(rows, "src_ip", known, "code").select("packet_id", "code")


def e6(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.flows(spark, folder)
    values_ = encode.categories(rows.where(F.col(LABEL) != "N"), [LABEL, "linestatus"])
    out = encode.one_hot(rows, values_, keep=True)
    hot = [f"{c}_{v}" for c, vs in values_.items() for v in vs]
    return out.groupBy(LABEL, "linestatus").agg(*[F.sum(c).alias(c) for c in hot])


def e6v(spark: SparkSession, folder: str) -> DataFrame:
    """A column with very many values; the last place of the vector is for values not seen when fitting."""
    orders = standins.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    known = encode.fit_dictionary(orders.where("o_orderkey % 5 <> 0"), "o_custkey")
    out = encode.one_hot_vectors(orders, "o_custkey", known, "hot")
    # The places are read from the sparse form; the full one has as many cells as there are values.
    hot = F.unwrap_udt("hot")
    place = F.array_position(hot["values"], F.lit(1.0)).cast("int") - 1
    return out.select(
        "o_orderkey",
        F.coalesce(F.get(hot["indices"], place), F.lit(-1)).cast("long").alias("place"),
        hot["size"].alias("width"),
    )


def e7(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.flows(spark, folder).withColumn("text", F.col(LABEL))
    return encode.label_codes(rows).groupBy("text").agg(F.min(LABEL).alias("code"), F.count(F.lit(1)).alias("n"))


def e8(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.vectors(spark, folder).select(
        "id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.lit(7.0).alias("flat")
    )
    names = ["x0", "x1", "x2", "flat"]
    return as_double(encode.scale(rows, encode.fit_min_max(rows, names)), names)


def e9(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.vectors(spark, folder).select(
        "id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.lit(7.0).alias("flat")
    )
    names = ["x0", "x1", "x2", "flat"]
    return as_double(encode.standard_scale(rows, names), names)


def e10(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.vectors(spark, folder)
    plain = values.softmax(F.transform("x", lambda v: v * 100))
    clipped = values.softmax(F.transform("x", lambda v: v * 100), clip=50, epsilon=1e-10)
    return rows.select(
        "id",
        F.round(plain[0], 6).alias("p0"),
        F.round(F.array_max(plain), 6).alias("top"),
        F.round(F.array_max(clipped), 6).alias("top_clipped"),
        values.argmax(plain).alias("cls"),
    )


def e12(spark: SparkSession, folder: str) -> DataFrame:
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("true", "TRUE", "1", "yes", "Yes", "no", "0", "on", "")]),
        (F.expr("event_id % 9") + 1).cast("int"),
    )
    rows = standins.table(spark, folder, "events").select("event_id", word.alias("word"))
    return rows.select("event_id", values.text_to_bool(F.col("word")).cast("int").alias("flag"))


NOW = "2024-01-31 00:00:00"


def e13(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.packets(spark, folder)
    now = F.lit(NOW).cast("timestamp")
    return rows.select(
        "packet_id",
        values.relative_time(F.col("ts"), now).alias("ago"),
        values.relative_time_fine(F.col("ts"), now).alias("ago_fine"),
    )


def e14(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.col("ts")
    text = (
        F.when(F.col("packet_id") % 4 == 0, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss:SSSSSS"))
        .when(F.col("packet_id") % 4 == 1, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("packet_id") % 4 == 2, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("not a time")
    )
    return standins.packets(spark, folder).select(
        "packet_id", F.unix_micros(values.parse_time(text)).alias("at_us")
    )


def e15(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.flows(spark, folder)
    fitted = encode.fit_preprocessing(rows)
    out = encode.transform_preprocessing(rows, fitted)
    return out.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), 6).alias(c) for c in fitted.features],
    )


QUERIES = {
    "S1_csv_scan": s1,
    "S2_bad_lines_warn": s2("warn"),
    "S2_bad_lines_skip": s2("skip"),
    "S2_bad_lines_subset": s2_subset,
    "S3_na_tokens": s3,
    "S4_schema_sampling": s4,
    "S5_structure_validation": s5,
    "S6_row_count": s6,
    "S7_dataset_listing": s7,
    "S8_table_sink": s8,
    "S9_artifact_store": s9,
    "S9_artifact_checks": s9_checks,
    "S14_metric_report": s14,
    "S15_synthetic_table": s15,
    "S16_sample_rows": s16,
    "C1_drop_null_rows": c1,
    "C2_drop_null_labels": c2,
    "C3_fill_features": c3,
    "C4_sparse_columns": c4,
    "C5_distinct_rows": c5,
    "C6_failed_casts": c6,
    "C7_value_range": c7,
    "C8_clean": c8,
    "C9_cleaning_report": c9,
    "C10_select_and_pad": c10,
    "C11_reorder_columns": c11,
    "C12_repair_clip": c12("clip"),
    "C12_repair_normalize": c12("normalize"),
    "C12_repair_standardize": c12("standardize"),
    "C14_class_guard": c14,
    "C15_rename": c15,
    "C16_column_sets": c16,
    "E1_ip_to_long": e1,
    "E2_ipv6_halves": e2,
    "E3_cidr_network": e3,
    "E4_packet_features": e4,
    "E5_dictionary_encode": e5,
    "E6_one_hot": e6,
    "E6_one_hot_vectors": e6v,
    "E7_label_codes": e7,
    "E8_min_max_scale": e8,
    "E9_standard_scale": e9,
    "E10_softmax": e10,
    "E12_text_to_bool": e12,
    "E13_relative_time": e13,
    "E14_parse_time": e14,
    "E15_preprocessing": e15,
}

# --- SQL -------------------------------------------------------------------------------

_TOKENS = "('nan', 'NaN', 'null', 'NULL', '', 'inf', '-inf')"


def _num(c: str) -> str:
    return f"CASE WHEN trim({c}) IN {_TOKENS} THEN NULL ELSE TRY_CAST({c} AS FLOAT) END"


_ALL = [*FEATURES, LABEL]
_NUMERIC = "num AS (SELECT " + ", ".join(f"{_num(c)} AS {c}" for c in _ALL) + " FROM dirty_flows)"
_FILLED = (
    "filled AS (SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES) + f", {LABEL} FROM num)"
)
_INSIDE = " AND ".join(f"{c} BETWEEN -1e6 AND 1e6" for c in FEATURES)


def _sum_sql(source: str) -> str:
    counts = ", ".join(f"count({c}) AS n_{c}" for c in _ALL)
    return (
        f"SELECT count(*) AS n, {counts}, round(sum(quantity::DOUBLE), 2) AS sum_quantity, "
        f"round(sum(linenumber::DOUBLE), 2) AS sum_linenumber FROM {source}"
    )


def _doubles(columns: list[str]) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in columns)


_DISTINCT = f"SELECT DISTINCT {', '.join(_ALL)} FROM num"
_BAD_CELL = {c: f"(trim({c}) NOT IN {_TOKENS} AND TRY_CAST({c} AS FLOAT) IS NULL)" for c in _ALL}
_X = ", ".join(f"x[{i + 1}] AS x{i}" for i in range(3))


def _minmax(c: str, source: str) -> str:
    lo, hi = f"(SELECT min({c}) FROM {source})", f"(SELECT max({c}) FROM {source})"
    factor = f"(0.8::DOUBLE / CASE WHEN {hi} = {lo} THEN 1 ELSE {hi} - {lo} END)"
    return f"({c} * {factor} + (0.1::DOUBLE - {lo} * {factor}))"


def _codes(source: str, c: str) -> str:
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM {source}))"


_SAMPLE = {0: (0.1, 0.9), 2: (0.1, 0.8), 3: (0.1, 0.7), 4: (0.0, 1.0), 19: (0.1, 0.9)}
_LAYOUT = [*standins.FLOW_NUMERIC, "src", "dst", "status_F", "status_O"]
_REL_SECONDS = "((span % 86400000000) // 1000000)"


def _plural(n: str, word: str) -> str:
    return f"({n})::VARCHAR || ' {word}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END || ' ago'"


ORACLE = {
    "S1_csv_scan": with_views(
        "flows", "SELECT linestatus, count(*) AS n, sum(quantity) AS quantity FROM flows GROUP BY ALL"
    ),
    "S2_bad_lines_warn": with_views(
        "flows",
        "SELECT count(*) FILTER (quantity <> 7) AS good_lines, count(*) FILTER (quantity = 7) AS bad_lines, count(*) AS filled_quantity, count(*) AS filled_extendedprice, "
        "count(*) FILTER (quantity <> 7) AS filled_discount, count(*) AS filled_linestatus FROM flows",
    ),
    "S2_bad_lines_skip": with_views(
        "flows", "SELECT count(*) AS good_lines, round(sum(quantity), 2) AS quantity FROM flows WHERE quantity <> 7"
    ),
    "S2_bad_lines_subset": with_views(
        "flows",
        """SELECT linestatus, count(*) AS n, (SELECT count(*) FROM flows WHERE quantity <> 7) AS lines
FROM flows WHERE quantity <> 7 GROUP BY linestatus""",
    ),
    "S3_na_tokens": with_views(
        "dirty_flows",
        "WITH num AS (SELECT " + ", ".join(f"CASE WHEN trim({c}) IN {_TOKENS} THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in _ALL)
        + " FROM dirty_flows) SELECT " + ", ".join(f"count({c}) AS n_{c}" for c in _ALL) + ", round(sum(quantity), 2) AS quantity FROM num",
    ),
    "S4_schema_sampling": """SELECT feature, type, (SELECT count(*) FROM lineitem) AS rows FROM
(VALUES ('quantity', 'float'), ('extendedprice', 'float'), ('discount', 'float'), ('linestatus', 'string')) t(feature, type)""",
    "S5_structure_validation": """SELECT 'header' AS "check", true AS passed, '11 columns' AS detail
UNION ALL SELECT 'columns', true, '11 of at least 2' UNION ALL SELECT 'required', false, 'missing: absent'
UNION ALL SELECT 'rows', count(*) > 0, count(*)::VARCHAR || ' rows' FROM lineitem""",
    "S6_row_count": "SELECT count(*) AS n FROM lineitem",
    "S7_dataset_listing": "SELECT unnest(["
    + ", ".join(
        f"'{t}.parquet'"
        for t in (
            "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part "
            "region supplier"
        ).split()
    )
    + "]) AS name",
    "S8_table_sink": with_views(
        "flows", "SELECT Label, count(*) AS n, round(sum(tax), 2) AS tax FROM flows GROUP BY ALL"
    ),
    "S9_artifact_store": with_views(
        "flows",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {i} AS ord, 'minmax' AS kind, min({c}) AS data_min, max({c}) AS data_max FROM flows"
            for i, c in enumerate(standins.FLOW_NUMERIC)
        ),
    ),
    "S9_artifact_checks": """SELECT 'feature_count' AS "check", true AS passed UNION ALL SELECT 'unique_names', true
UNION ALL SELECT 'ranges', (SELECT min(l_tax) <= max(l_tax) FROM lineitem)""",
    "S14_metric_report": """SELECT 'rows' AS metric, count(*)::VARCHAR AS "value" FROM lineitem
UNION ALL SELECT 'max_partkey', max(l_partkey)::VARCHAR FROM lineitem""",
    "S15_synthetic_table": """SELECT c AS Label, CASE c WHEN 0 THEN n // 2 ELSE n - n // 2 END AS n, 1 AS above, 1 AS below,
  CASE c WHEN 0 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS centre
FROM (SELECT count(*) AS n FROM lineitem), (VALUES (0), (1)) t(c)""",
    "S16_sample_rows": with_views(
        "packets",
        "SELECT packet_id AS id, "
        + ", ".join(
            f"round({lo}::DOUBLE + {unit(42, 'packet_id', str(i))} * {hi - lo}::DOUBLE, 6) AS x{i}"
            for i, (lo, hi) in _SAMPLE.items()
        )
        + f", round([0.0, 0.33, 0.66, 1.0][(floor({unit(42, 'packet_id', '1')} * 4) + 1)::INTEGER]::DOUBLE, 6) AS x1 FROM packets",
    ),
    "C1_drop_null_rows": with_views(
        "dirty_flows",
        f"WITH {_NUMERIC}, k AS (SELECT * FROM num WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in _ALL) + ") " + _sum_sql("k"),
    ),
    "C2_drop_null_labels": with_views(
        "dirty_flows", f"WITH {_NUMERIC}, k AS (SELECT * FROM num WHERE Label IS NOT NULL) " + _sum_sql("k")
    ),
    "C3_fill_features": with_views("dirty_flows", f"WITH {_NUMERIC}, {_FILLED} " + _sum_sql("filled")),
    "C4_sparse_columns": with_views(
        "dirty_flows",
        f"WITH {_NUMERIC} "
        + " UNION ALL ".join(
            f"""SELECT '{n}' AS "column", round(avg(({e} IS NULL)::INTEGER), 9) AS null_share, (avg(({e} IS NULL)::INTEGER) <= 0.9)::INTEGER AS kept FROM num"""
            for n, e in [(c, c) for c in _ALL] + [("mostly_null", "CASE WHEN quantity = 1 THEN 1.0 END")]
        ),
    ),
    "C5_distinct_rows": with_views(
        "dirty_flows", f"WITH {_NUMERIC}, k AS ({_DISTINCT}) SELECT {_doubles(_ALL)} FROM k"
    ),
    "C6_failed_casts": with_views(
        "dirty_flows",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({e}) AS failed_cells FROM dirty_flows"""
            for c, e in _BAD_CELL.items()
        ),
    ),
    "C7_value_range": with_views(
        "dirty_flows",
        f"WITH {_NUMERIC}, {_FILLED}, k AS (SELECT * FROM filled WHERE {_INSIDE}) " + _sum_sql("k"),
    ),
    "C8_clean": with_views(
        "dirty_flows",
        f"WITH {_NUMERIC}, d AS ({_DISTINCT}), {_FILLED.replace('FROM num', 'FROM d')} "
        f"SELECT {_doubles(_ALL)} FROM filled WHERE Label IS NOT NULL AND {_INSIDE}",
    ),
    "C9_cleaning_report": with_views(
        "dirty_flows",
        f"""WITH {_NUMERIC}, d AS ({_DISTINCT}),
a AS (SELECT count(*) AS original, sum({' + '.join(f'coalesce({e}, false)::INTEGER' for e in _BAD_CELL.values())})::BIGINT AS failed_conversions FROM dirty_flows),
b AS (SELECT count(*) AS n, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in _ALL)}) AS rows_with_null,
  sum({' + '.join(f'({c} IS NULL)::INTEGER' for c in FEATURES)})::BIGINT AS feature_nulls,
  count(*) FILTER (Label IS NULL) AS label_nulls,
  count(*) FILTER (Label IS NOT NULL AND NOT ({_INSIDE.replace(' BETWEEN', ', 0) BETWEEN').replace('quantity,', 'coalesce(quantity,').replace('discount,', 'coalesce(discount,').replace('tax,', 'coalesce(tax,').replace('linenumber,', 'coalesce(linenumber,')})) AS invalid_values FROM d)
SELECT original, original - n AS duplicates, rows_with_null, feature_nulls, label_nulls, invalid_values, failed_conversions,
  n - label_nulls - invalid_values AS cleaned,
  round((n - label_nulls - invalid_values)::DOUBLE / original * 100, 6) AS clean_percent,
  CASE WHEN (n - label_nulls - invalid_values)::DOUBLE / original < 0.3 THEN 'critical'
    WHEN (n - label_nulls - invalid_values)::DOUBLE / original < 0.5 THEN 'low' ELSE 'ok' END AS flag
FROM a, b""",
    ),
    "C10_select_and_pad": with_views(
        "flows",
        """SELECT linenumber, count(*) AS n, round(sum(quantity), 2) AS quantity, 0.0::DOUBLE AS synthetic_feature_0,
  0.0::DOUBLE AS synthetic_feature_1 FROM flows GROUP BY linenumber""",
    ),
    "C11_reorder_columns": with_views(
        "flows", "SELECT quantity, 0.0::DOUBLE AS absent, round(sum(tax), 2) AS tax FROM flows GROUP BY quantity"
    ),
    "C14_class_guard": with_views(
        "flows", "SELECT count(DISTINCT Label) AS classes, (count(DISTINCT Label) >= 2)::INTEGER AS ok FROM flows"
    ),
    "C15_rename": with_views(
        "flows", "SELECT quantity AS feature_0, round(sum(tax), 2) AS feature_1 FROM flows GROUP BY quantity"
    ),
    "C16_column_sets": """SELECT 'present' AS kind, 'tax,quantity' AS columns, count(*) AS rows FROM lineitem
UNION ALL SELECT 'missing', 'absent', count(*) FROM lineitem""",
    "E1_ip_to_long": with_views(
        "packets",
        """SELECT packet_id, CASE WHEN packet_id % 100 <> 0 THEN split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536
  + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT END AS ip FROM packets""",
    ),
    "E2_ipv6_halves": with_views(
        "packets",
        """SELECT packet_id, CASE WHEN packet_id % 4 = 0 THEN repeat('0', 24) || 'ffff' || lpad(lower(to_hex(dst_port)), 4, '0')
    ELSE '20010db8' || repeat('0', 16) || lpad(lower(to_hex(packet_id % 4096)), 4, '0') || lpad(lower(to_hex(dst_port)), 4, '0') END AS hex,
  CASE WHEN packet_id % 4 = 0 THEN 0 ELSE 536939960 * 4294967296 END::BIGINT AS high,
  CASE WHEN packet_id % 4 = 0 THEN 65535::BIGINT * 65536 + dst_port ELSE (packet_id % 4096)::BIGINT * 65536 + dst_port END::BIGINT AS low
FROM packets""",
    ),
    "E3_cidr_network": with_views(
        "packets",
        """WITH n AS (SELECT packet_id, packet_id % 33 AS len, (10::BIGINT * 16777216 + 65536 + packet_id % 256) AS ip FROM packets),
m AS (SELECT packet_id, len, ip - ip % (2::BIGINT ** (32 - len))::BIGINT AS net FROM n)
SELECT packet_id, (net // 16777216)::VARCHAR || '.' || ((net // 65536) % 256)::VARCHAR || '.' || ((net // 256) % 256)::VARCHAR || '.'
  || (net % 256)::VARCHAR || '/' || len::VARCHAR AS network FROM m""",
    ),
    "E4_packet_features": with_views(
        "packets",
        """SELECT packet_id, 167772160 + user_part AS ip_src, 167837696 + packet_id % 256 AS ip_dst, src_port::BIGINT AS src_port,
  dst_port::BIGINT AS dst_port, CASE WHEN proto = 6 THEN tcp_flags ELSE 0 END::BIGINT AS tcp_flags,
  packet_length::BIGINT AS packet_length, ttl::BIGINT AS ttl, proto::BIGINT AS proto
FROM (SELECT *, split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS user_part FROM packets)""",
    ),
    "E5_dictionary_encode": with_views(
        "packets",
        f"""WITH udp AS (SELECT * FROM packets WHERE proto = 17), d AS {_codes('udp', 'src_ip')}
SELECT packet_id, coalesce(code, (SELECT count(*) FROM d)) AS code FROM packets LEFT JOIN d ON src_ip = v""",
    ),
    "E6_one_hot": with_views(
        "flows",
        """SELECT Label, linestatus, sum(CASE WHEN Label = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS Label_A,
  sum(CASE WHEN Label = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS Label_R, sum(CASE WHEN linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS linestatus_F,
  sum(CASE WHEN linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS linestatus_O FROM flows GROUP BY ALL""",
    ),
    "E6_one_hot_vectors": """WITH k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders WHERE o_orderkey % 5 <> 0)), n AS (SELECT count(*) AS n FROM k)
SELECT o_orderkey, coalesce(code, n) AS place, n + 1 AS width FROM orders LEFT JOIN k ON o_custkey::VARCHAR = v, n""",
    "E7_label_codes": with_views(
        "flows",
        f"WITH d AS {_codes('flows', 'Label')} SELECT Label AS text, min(code) AS code, count(*) AS n FROM flows JOIN d ON Label = v GROUP BY Label",
    ),
    "E8_min_max_scale": with_views(
        "vectors",
        f"WITH s AS (SELECT id, {_X}, 7.0::DOUBLE AS flat FROM vectors) SELECT id, "
        + ", ".join(f"round({_minmax(c, 's')}, 6) AS {c}" for c in ("x0", "x1", "x2", "flat")) + " FROM s",
    ),
    "E9_standard_scale": with_views(
        "vectors",
        f"WITH s AS (SELECT id, {_X} FROM vectors) SELECT id, "
        + ", ".join(f"round(({c} - (SELECT avg({c}) FROM s)) / (SELECT stddev_pop({c}) FROM s), 6) AS {c}" for c in ("x0", "x1", "x2"))
        + ", 0.0::DOUBLE AS flat FROM s",
    ),
    "E10_softmax": with_views(
        "vectors",
        """WITH z AS (SELECT id, list_transform(x, lambda v: v * 100) AS z FROM vectors),
e AS (SELECT id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS e,
  list_transform(z, lambda v: exp(greatest(-50, v - list_max(z)))) AS c FROM z)
SELECT id, round(e[1] / list_sum(e), 6) AS p0, round(1 / list_sum(e), 6) AS top, round(1 / (list_sum(c) + 1e-10), 6) AS top_clipped,
  (list_position(z, list_max(z)) - 1)::INTEGER AS cls FROM e""",
    ),
    "E12_text_to_bool": "SELECT event_id, (event_id % 9 < 5)::INTEGER AS flag FROM events",
    "E13_relative_time": with_views(
        "packets",
        f"""WITH s AS (SELECT packet_id, epoch_us(TIMESTAMP '{NOW}') - ts_us AS span FROM packets),
d AS (SELECT *, span // 86400000000 AS days, {_REL_SECONDS} AS secs FROM s)
SELECT packet_id, CASE WHEN days > 0 THEN {_plural('days', 'day')} WHEN secs > 3600 THEN {_plural('secs // 3600', 'hour')}
    WHEN secs > 60 THEN {_plural('secs // 60', 'minute')} ELSE 'Just now' END AS ago,
  CASE WHEN days > 0 THEN {_plural('days', 'day')} WHEN secs >= 3600 THEN {_plural('secs // 3600', 'hour')}
    WHEN secs >= 60 THEN {_plural('secs // 60', 'minute')}
    WHEN secs >= 5 AND secs % 5 = 0 THEN secs::VARCHAR || ' seconds ago'
    WHEN secs >= 5 THEN '~' || (round_even(secs / 5, 0) * 5)::BIGINT::VARCHAR || ' seconds ago'
    WHEN secs > 1 THEN secs::VARCHAR || ' seconds ago' ELSE 'just now' END AS ago_fine FROM d""",
    ),
    "E14_parse_time": with_views(
        "packets",
        "SELECT packet_id, CASE WHEN packet_id % 4 < 3 THEN epoch_us(date_trunc('second', ts)) END AS at_us FROM packets",
    ),
    "E15_preprocessing": with_views(
        "flows",
        f"""WITH a AS {_codes('flows', 'IPV4_SRC_ADDR')}, b AS {_codes('flows', 'IPV4_DST_ADDR')}, l AS {_codes('flows', 'Label')},
w AS (SELECT {', '.join(standins.FLOW_NUMERIC)}, a.code::DOUBLE AS src, b.code::DOUBLE AS dst, (linestatus = 'F')::INTEGER::DOUBLE AS status_F,
  (linestatus = 'O')::INTEGER::DOUBLE AS status_O, l.code AS Label
  FROM flows JOIN a ON IPV4_SRC_ADDR = a.v JOIN b ON IPV4_DST_ADDR = b.v JOIN l ON Label = l.v),
s AS (SELECT Label, {', '.join(f'{_minmax(c, "w")} AS {c}' for c in _LAYOUT)} FROM w)
SELECT Label, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in standins.FLOW_NUMERIC)}, round(avg(src), 6) AS IPV4_SRC_ADDR,
  round(avg(dst), 6) AS IPV4_DST_ADDR, round(avg(status_F), 6) AS linestatus_F, round(avg(status_O), 6) AS linestatus_O,
  {', '.join(f'0.1::DOUBLE AS synthetic_feature_{i}' for i in range(9))} FROM s GROUP BY Label""",
    ),
}

_CELLS = """u AS (SELECT id, CASE WHEN id % 10 = 1 THEN 0.5::DOUBLE ELSE x[1] END AS a, CASE WHEN id % 10 = 2 THEN 0.5::DOUBLE ELSE x[2] END AS b,
  CASE WHEN id % 10 = 3 THEN 0.5::DOUBLE ELSE x[3] * 4 END AS c FROM vectors),
cells AS (SELECT a AS v FROM u UNION ALL SELECT b FROM u UNION ALL SELECT c FROM u)"""
for _method, _cell in {
    "clip": "greatest(0, least(1, {c}))",
    "normalize": "({c} - (SELECT min(v) FROM cells)) / (SELECT max(v) - min(v) FROM cells)",
    "standardize": "({c} - (SELECT avg(v) FROM cells)) / (SELECT stddev_pop(v) FROM cells)",
}.items():
    ORACLE[f"C12_repair_{_method}"] = with_views(
        "vectors",
        f"WITH {_CELLS} SELECT id, " + ", ".join(f"round({_cell.format(c=c)}, 6) AS {c}" for c in "abc") + " FROM u",
    )
