"""Scoring, training, robustness and diagnostic queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.catalog.balance import vectors
from netwarden.catalog.prepare import as_double, unclean_vectors
from netwarden.catalog.views import unit, with_views
from netwarden.functions import registry
from netwarden.operators import diagnose, evaluate, resample, score, split
from netwarden.plans import standins
from netwarden.plans.scale import stage

HIDDEN = 6


def weight(i: int, j: int) -> float:
    return ((i * 7 + j * 3) % 11 - 5) / 10


def layer(outputs: int, inputs: int, activation: str = "linear") -> score.Dense:
    """A layer with a fixed weight pattern and small biases."""
    w = np.array([[weight(i, j) for j in range(inputs)] for i in range(outputs)])
    return score.Dense(w, np.array([i / 20 for i in range(outputs)]), activation)


CLASSIFIER = [layer(HIDDEN, 20, "relu"), layer(2, HIDDEN)]
ENCODER = score.autoencoder(
    layer(HIDDEN, 20).weights, layer(HIDDEN, 20).bias, layer(20, HIDDEN).weights, layer(20, HIDDEN).bias
)


def t11(spark: SparkSession, folder: str) -> DataFrame:
    out = score.reconstruct(vectors(spark, folder), ENCODER)
    return out.select(
        "id", F.round(F.col("xhat")[0], 6).alias("x0"), F.round(F.col("xhat")[19], 6).alias("x19"), F.round("mse", 6).alias("mse")
    )


def t12(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(score.calibrate(score.reconstruct(vectors(spark, folder), ENCODER)), ["threshold"])


def t8h(spark: SparkSession, folder: str) -> DataFrame:
    """Full cascade with both networks on shifted vectors."""
    rows = vectors(spark, folder).withColumn("x", F.transform("x", lambda v: v * 8))
    out = score.hybrid(rows, CLASSIFIER, ENCODER, 1.0)
    return out.select("id", "verdict")


def m1(spark: SparkSession, folder: str) -> DataFrame:
    out = score.score(vectors(spark, folder), CLASSIFIER)
    return out.select("id", F.round(F.col("logits")[1], 6).alias("logit"), F.round("prob", 6).alias("prob"))


def m2(variant: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """Split, oversample the training part, fit, and evaluate on the held-out part."""
        parts = stage(resample.split_and_rescue(vectors(spark, folder)), "parts")
        models = score.train(parts.where(~F.col("is_test")), variant)
        held = score.predict(models, parts.where("is_test"))
        return evaluate.performance(held).select("tn", "fp", "fn", "tp", F.round("accuracy", 4).alias("accuracy"))

    return run


def m2w(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(split.with_weights(vectors(spark, folder)), "weighted")
    model = score.train_weighted(rows)
    out = model.transform(score._points(rows, "id"))
    pred = out.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))
    return evaluate.confusion(pred)


def m3(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the logits of two networks."""
    rows = score.score(vectors(spark, folder), CLASSIFIER).withColumnRenamed("logits", "l0").drop("probs", "prob")
    rows = score.score(rows, [layer(2, 20)]).withColumnRenamed("logits", "l1").drop("probs", "prob")
    out = score.finish([F.col("l0"), F.col("l1")], rows)
    return out.select("id", F.round(F.col("logits")[1], 6).alias("logit"), F.round("prob", 6).alias("prob"))


def m4(spark: SparkSession, folder: str) -> DataFrame:
    score.check_width(CLASSIFIER, 20)
    rows = vectors(spark, folder).withColumn("x", F.when(F.col("id") % 50 == 1, F.slice("x", 1, 19)).otherwise(F.col("x")))
    return score.feature_widths(rows, 20).withColumn("ok", F.col("ok").cast("int"))


def g1(spark: SparkSession, folder: str) -> DataFrame:
    y = diagnose.perturbed(F.col("x"), F.col("id"))
    out = vectors(spark, folder).select("id", y.alias("y"))
    return out.select("id", *[F.round(F.col("y")[i], 6).alias(f"y{i}") for i in (0, 1, 5, 19)])


def g2(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).withColumn("x", F.transform("x", lambda v: v + 0.5))
    out = diagnose.robustness(rows, CLASSIFIER)
    return as_double(out, out.columns)


def g3(spark: SparkSession, folder: str) -> DataFrame:
    rows = unclean_vectors(spark, folder).select(F.array("a", "b", "c").alias("x"))
    out = diagnose.profile(rows)
    return as_double(out, ["min", "max", "mean", "std"]).withColumns(
        {c: F.col(c).cast("int") for c in ("has_nan", "has_inf")}
    )


def g4(spark: SparkSession, folder: str) -> DataFrame:
    """Probes against a linear detector whose weights are the class means' differences."""
    rows = vectors(spark, folder)
    means = rows.groupBy("label").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(20)]).alias("m")).collect()
    by = {r["label"]: np.array(r["m"]) for r in means}
    w = np.stack([np.zeros(20), by[1] - by[0]])
    scored = score.score(diagnose.probes(spark, 20), [score.Dense(w, np.zeros(2))])
    out = diagnose.probe_report(scored)
    return as_double(out, ["confidence", "low", "high"]).withColumn("success", F.col("success").cast("int"))


def g5(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(diagnose.importance(vectors(spark, folder), CLASSIFIER), ["impact"])


def g6(spark: SparkSession, folder: str) -> DataFrame:
    names = ["a", "b", "c"]
    out = diagnose.choose_repair(unclean_vectors(spark, folder), names, [layer(2, 3)])
    return out.withColumns({c: F.col(c).cast("int") for c in ("clean", "chosen")})


def g7(spark: SparkSession, folder: str) -> DataFrame:
    batch = F.element_at(F.array(*[F.lit(b) for b in (1, 8, 16, 32, 64)]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = standins.table(spark, folder, "events").select(batch.alias("batch"), F.col("value").alias("ms"))
    out = diagnose.latency(rows)
    return as_double(out, [c for c in out.columns if c != "batch"])


def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The registered SQL functions in one SQL query."""
    registry.register(spark)
    standins.packets(spark, folder).createOrReplaceTempView("nw_packets")
    return spark.sql(
        """SELECT packet_id, ip_to_long(src_ip) AS src, cidr_network(concat(dst_ip, '/24')) AS net,
        dpi_match(payload) AS hit, hybrid_verdict(ttl / 256D, ttl / 100D, 1D) AS verdict,
        round(softmax2(0D, ttl / 100D), 6) AS p, text_to_bool(if(ttl % 2 = 0, 'Yes', 'no')) AS even FROM nw_packets"""
    ).withColumns({c: F.col(c).cast("int") for c in ("hit", "even")})


QUERIES = {
    "T8_hybrid_networks": t8h,
    "T11_autoencoder": t11,
    "T12_threshold_calibration": t12,
    "M1_batch_inference": m1,
    "M2_train_simple": m2("simple"),
    "M2_train_stabilized": m2("stabilized"),
    "M2_train_standard": m2("standard"),
    "M2_train_weighted": m2w,
    "M3_ensemble_logits": m3,
    "M3_train_ensemble": m2("ensemble"),
    "M4_feature_widths": m4,
    "G1_perturb": g1,
    "G2_robustness": g2,
    "G3_input_profile": g3,
    "G4_probe_patterns": g4,
    "G5_feature_importance": g5,
    "G6_choose_repair": g6,
    "G7_latency": g7,
    "F_sql_functions": sql_functions,
}


def dense_sql(x: str, outputs: int, inputs: int, activation: str = "{z}") -> str:
    z = (
        f"list_sum(list_transform(range({inputs}), lambda j: {x}[j + 1] * (((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE)))"
        " + i / 20.0::DOUBLE"
    )
    return f"list_transform(range({outputs}), lambda i: {activation.format(z=z)})"


_RELU, _SIGMOID = "greatest(0.0::DOUBLE, {z})", "1 / (1 + exp(-({z})))"


def classifier_sql(name: str, source: str, x: str = "x") -> str:
    """CTEs ending in ``name(id, x, z)`` with the two logits."""
    return f"""{name}h AS (SELECT *, {dense_sql(x, HIDDEN, 20, _RELU)} AS h FROM {source}),
{name} AS (SELECT * EXCLUDE (h), {dense_sql('h', 2, HIDDEN)} AS z FROM {name}h)"""


def encoder_sql(name: str, source: str) -> str:
    return f"""{name}h AS (SELECT *, {dense_sql('x', HIDDEN, 20, _RELU)} AS h FROM {source}),
{name}r AS (SELECT * EXCLUDE (h), {dense_sql('h', 20, HIDDEN, _SIGMOID)} AS xhat FROM {name}h),
{name} AS (SELECT *, list_sum(list_transform(list_zip(x, xhat), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 20 AS mse FROM {name}r)"""


_P1 = "(exp(z[2] - greatest(z[1], z[2])) / (exp(z[1] - greatest(z[1], z[2])) + exp(z[2] - greatest(z[1], z[2]))))"
_TAU = f"{2 * math.pi!r}::DOUBLE"


def noisy_sql(x: str = "x") -> str:
    def u(s: str) -> str:
        return unit(s, "id", "i")

    moved = (
        f"{x}[i + 1] + sqrt(-2 * ln(1 - {u('adv1')})) * cos({_TAU} * {u('adv2')}) * 0.1::DOUBLE"
        f" + CASE WHEN i % 5 = 0 THEN ({u('adv3')} - 0.5) * 1.0::DOUBLE ELSE 0.0 END"
    )
    return f"list_transform(range(20)::INTEGER[], lambda i: greatest(0.1::DOUBLE, least(0.9::DOUBLE, {moved})))"


_VERDICT = f"""CASE WHEN {_P1} > 0.7::DOUBLE THEN 'Known Attack' WHEN mse > 1.0::DOUBLE * 1.1::DOUBLE THEN 'Unknown Anomaly' ELSE 'Normal' END"""
_REPAIRED = """u AS (SELECT id, CASE WHEN id % 10 = 1 THEN 'NaN'::DOUBLE ELSE x[1] END AS a, CASE WHEN id % 10 = 2 THEN 'Infinity'::DOUBLE ELSE x[2] END AS b,
  CASE WHEN id % 10 = 3 THEN NULL ELSE x[3] * 4 END AS c FROM vectors), cells AS (SELECT unnest([a, b, c]) AS v FROM u)"""


def _importance_sql() -> str:
    flip = "list_transform(range(20), lambda t: CASE WHEN t = f THEN v ELSE x[t + 1] END)"
    return f"""{classifier_sql('b', 'vectors')}, g AS (SELECT id, x, f, v FROM vectors, range(20) q(f), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) w(v)),
g2 AS (SELECT id, f, {flip} AS x FROM g), {classifier_sql('m', 'g2')},
pb AS (SELECT id, {_P1} AS p FROM b), pm AS (SELECT id, f, {_P1} AS p FROM m),
i AS (SELECT pm.id, f, max(abs(pm.p - pb.p)) AS d FROM pm JOIN pb USING (id) GROUP BY ALL)
SELECT f::INTEGER AS feature, round(avg(d), 6) AS impact FROM i GROUP BY f ORDER BY avg(d) DESC, f LIMIT 10"""


def _probes_sql() -> str:
    def drawn(low: float, high: float) -> str:
        return f"{low}::DOUBLE + {unit('probe', 'n', 'i')} * ({high}::DOUBLE - {low}::DOUBLE)"

    normal = f"0.5::DOUBLE + 0.1::DOUBLE * sqrt(-2 * ln(1 - {unit('probe1', 'n', 'i')})) * cos({_TAU} * {unit('probe2', 'n', 'i')})"
    cells = {
        "zeros": (1, "0.0::DOUBLE"), "ones": (1, "1.0::DOUBLE"), "small": (1, "0.1::DOUBLE"), "half": (1, "0.5::DOUBLE"),
        "large": (1, "0.9::DOUBLE"), "random_normal": (1, normal), "random_low": (5, drawn(0.0, 0.3)),
        "random_high": (5, drawn(0.7, 1.0)), "low_then_high": (1, "(i >= 10)::INTEGER::DOUBLE"),
        "high_then_low": (1, "(i < 10)::INTEGER::DOUBLE"), "alternating": (1, "(i % 2)::DOUBLE"),
    }
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "case", n, i, {cell} AS v FROM range({count}) p(n), range(20) q(i)"""
        for name, (count, cell) in cells.items()
    )


ORACLE = {
    "T8_hybrid_networks": with_views(
        "vectors",
        f"""WITH s AS (SELECT id, list_transform(x, lambda v: v * 8) AS x FROM vectors), {classifier_sql('k', 's')}, {encoder_sql('e', 'k')}
SELECT id, {_VERDICT} AS verdict FROM e""",
    ),
    "T11_autoencoder": with_views(
        "vectors",
        f"WITH {encoder_sql('e', 'vectors')} SELECT id, round(xhat[1], 6) AS x0, round(xhat[20], 6) AS x19, round(mse, 6) AS mse FROM e",
    ),
    "T12_threshold_calibration": with_views(
        "vectors", f"WITH {encoder_sql('e', 'vectors')} SELECT round(quantile_cont(mse, 0.95), 6) AS threshold FROM e WHERE label = 0"
    ),
    "M1_batch_inference": with_views(
        "vectors", f"WITH {classifier_sql('k', 'vectors')} SELECT id, round(z[2], 6) AS logit, round({_P1}, 6) AS prob FROM k"
    ),
    "M3_ensemble_logits": with_views(
        "vectors",
        f"""WITH {classifier_sql('k', 'vectors')}, o AS (SELECT id, z AS z0, {dense_sql('x', 2, 20)} AS z1 FROM k),
m AS (SELECT id, [(z0[1] + z1[1]) / 2, (z0[2] + z1[2]) / 2] AS z FROM o) SELECT id, round(z[2], 6) AS logit, round({_P1}, 6) AS prob FROM m""",
    ),
    "M4_feature_widths": with_views(
        "vectors",
        "SELECT CASE WHEN id % 50 = 1 THEN 19 ELSE 20 END AS width, count(*) AS n, max((id % 50 <> 1)::INTEGER) AS ok FROM vectors GROUP BY 1",
    ),
    "G1_perturb": with_views(
        "vectors",
        f"WITH p AS (SELECT id, {noisy_sql()} AS y FROM vectors) SELECT id, "
        + ", ".join(f"round(y[{i + 1}], 6) AS y{i}" for i in (0, 1, 5, 19)) + " FROM p",
    ),
    "G2_robustness": with_views(
        "vectors",
        f"""WITH s AS (SELECT id, list_transform(x, lambda v: v + 0.5) AS x FROM vectors), n AS (SELECT id, {noisy_sql()} AS x FROM s),
{classifier_sql('a', 's')}, {classifier_sql('b', 'n')}, pa AS (SELECT id, {_P1} AS p FROM a), pb AS (SELECT id, {_P1} AS p FROM b)
SELECT round(avg((pa.p > 1 - pa.p)::INTEGER), 6) AS clean_attack_rate, round(avg((pb.p > 1 - pb.p)::INTEGER), 6) AS adversarial_attack_rate,
  round(avg((pb.p > 1 - pb.p)::INTEGER) - avg((pa.p > 1 - pa.p)::INTEGER), 6) AS rate_change,
  round(avg(greatest(pb.p, 1 - pb.p) - greatest(pa.p, 1 - pa.p)), 6) AS confidence_change FROM pa JOIN pb USING (id)""",
    ),
    "G3_input_profile": with_views(
        "vectors",
        f"""WITH {_REPAIRED}, f AS (SELECT v, CASE WHEN isfinite(v) THEN v END AS ok FROM cells)
SELECT count(*) AS cells, round(min(ok), 6) AS min, round(max(ok), 6) AS max, round(avg(ok), 6) AS mean, round(stddev_pop(ok), 6) AS std,
  max(isnan(v))::INTEGER AS has_nan, max(isinf(v))::INTEGER AS has_inf, count(*) FILTER (v = 0) AS zero_count, count(DISTINCT v) AS distinct_values FROM f""",
    ),
    "G4_probe_patterns": with_views(
        "vectors",
        f"""WITH w AS (SELECT i, avg(x[i + 1]) FILTER (label = 1) - avg(x[i + 1]) FILTER (label = 0) AS w FROM vectors, range(20) q(i) GROUP BY i),
c AS ({_probes_sql()}), z AS (SELECT "case", n, sum(v * w) AS z FROM c JOIN w USING (i) GROUP BY ALL)
SELECT "case", n, CASE WHEN z > 0 THEN 'Attack' ELSE 'Normal' END AS predicted, round(1 / (1 + exp(-abs(z))), 6) AS confidence,
  round(least(0.0::DOUBLE, z), 6) AS low, round(greatest(0.0::DOUBLE, z), 6) AS high, isfinite(z)::INTEGER AS success FROM z""",
    ),
    "G5_feature_importance": with_views("vectors", "WITH " + _importance_sql()),
    "G6_choose_repair": with_views(
        "vectors",
        f"""WITH {_REPAIRED} SELECT 'original' AS method, 0 AS ord, (count(*) FILTER (v IS NULL OR NOT isfinite(v)) = 0)::INTEGER AS clean, 0 AS chosen FROM cells
UNION ALL SELECT 'clip', 1, 1, 1 UNION ALL SELECT 'normalize', 2, 1, 0 UNION ALL SELECT 'standardize', 3, 1, 0""",
    ),
    "G7_latency": """WITH r AS (SELECT [1, 8, 16, 32, 64][(event_id % 5 + 1)::INTEGER] AS batch, value AS ms FROM events)
SELECT batch, round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS std, round(min(ms), 6) AS min, round(max(ms), 6) AS max,
  round(quantile_cont(ms, 0.95), 6) AS p95, round(batch * 1000.0::DOUBLE / avg(ms), 6) AS rows_per_sec FROM r GROUP BY batch""",
    "F_sql_functions": with_views(
        "packets",
        f"""SELECT packet_id, 167772160 + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS src, 167837696::BIGINT AS net,
  (payload LIKE '%GET /etc/passwd%' OR regexp_matches(payload, 'SQL SELECT .* FROM') OR regexp_matches(payload, 'admin.*password'))::INTEGER AS hit,
  CASE WHEN ttl / 256.0::DOUBLE > 0.7::DOUBLE THEN 'Known Attack' WHEN ttl / 100.0::DOUBLE > 1.1::DOUBLE THEN 'Unknown Anomaly' ELSE 'Normal' END AS verdict,
  round(1 / (1 + exp(-(ttl / 100.0::DOUBLE))), 6) AS p, (ttl % 2 = 0)::INTEGER AS even FROM packets""",
    ),
}
