"""Evaluation, splitting and class-weight queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.catalog.prepare import as_double
from netwarden.catalog.views import digest, unit, with_views
from netwarden.functions.values import softmax
from netwarden.operators import evaluate, split
from netwarden.plans import standins
from netwarden.plans.scale import hash_unit


def with_pred(spark: SparkSession, folder: str) -> DataFrame:
    return standins.scored(spark, folder).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def multi(spark: SparkSession, folder: str) -> DataFrame:
    """Ten classes; the prediction is right except for some ids."""
    rows = standins.vectors(spark, folder, None)
    wrong = hash_unit(3, F.col("id")) < 0.3
    return rows.withColumn(
        "pred", F.when(wrong, (F.col("label") + 1 + F.col("id") % 3) % 10).otherwise(F.col("label")).cast("int")
    )


def v1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(with_pred(spark, folder))


def v2(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.performance(with_pred(spark, folder))
    return as_double(out, [c for c, t in out.dtypes if t == "double"])


def v3(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(evaluate.classification_report(multi(spark, folder)), ["precision", "recall", "f1"])


def v4(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.security_metrics(with_pred(spark, folder))
    return as_double(out, [c for c, t in out.dtypes if t == "double"])


def v5(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(evaluate.roc_auc(standins.scored(spark, folder)), ["auc"])


def v5m(spark: SparkSession, folder: str) -> DataFrame:
    """Class probabilities from the first ten dimensions."""
    rows = standins.vectors(spark, folder, None)
    probs = F.transform(softmax(F.slice("x", 1, 10)), lambda p: F.round(p, 3))
    out = evaluate.roc_auc_by_class(rows.select("label", probs.alias("probs")))
    return as_double(out, ["auc"])


def v6(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(evaluate.average_precision(standins.scored(spark, folder)), ["average_precision"])


def v7(metric: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_double(evaluate.threshold_search(standins.scored(spark, folder), metric), ["score"])

    return run


def v8(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.threshold_table(standins.scored(spark, folder))
    return as_double(out, out.columns)


def v8b(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.best_threshold(evaluate.threshold_table(standins.scored(spark, folder)))
    return as_double(out, out.columns)


def v9(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.confidence(standins.scored(spark, folder))
    return as_double(out, [c for c, t in out.dtypes if t == "double"])


def v10(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.advice(evaluate.performance(with_pred(spark, folder))).select("quality")


def m5(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(evaluate.security_loss(standins.scored(spark, folder), [0.25, 0.75]), ["loss"])


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return standins.scored(spark, folder).select("id", "label", "prob")


def p1(spark: SparkSession, folder: str) -> DataFrame:
    out = split.stratified_split(_labelled(spark, folder))
    return out.select("id", "label", F.col("is_test").cast("int").alias("is_test"))


def p2(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_folds(_labelled(spark, folder), 5).select("id", "label", "fold")


def p3(spark: SparkSession, folder: str) -> DataFrame:
    return split.balanced_sample(_labelled(spark, folder), 1000).select("id", "label")


def p4(spark: SparkSession, folder: str) -> DataFrame:
    return split.uniform_sample(_labelled(spark, folder), 2000).select("id", "label")


def p5(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    return split.weighted_sample(rows, rows.count()).select("draw", "id", "label")


def p6(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(split.class_weights(_labelled(spark, folder)), ["raw_weight", "weight"], 12)


def p6r(spark: SparkSession, folder: str) -> DataFrame:
    out = split.with_weights(_labelled(spark, folder))
    return as_double(out.select("id", "label", "weight"), ["weight"], 9)


QUERIES = {
    "V1_confusion": v1,
    "V2_performance": v2,
    "V3_classification_report": v3,
    "V4_security_metrics": v4,
    "V5_roc_auc": v5,
    "V5_roc_auc_by_class": v5m,
    "V6_average_precision": v6,
    "V7_threshold_search_f2": v7("f2"),
    "V7_threshold_search_recall": v7("recall"),
    "V7_threshold_search_precision": v7("precision"),
    "V8_threshold_table": v8,
    "V8_best_threshold": v8b,
    "V9_confidence": v9,
    "V10_advice": v10,
    "M5_security_loss": m5,
    "P1_stratified_split": p1,
    "P2_stratified_folds": p2,
    "P3_balanced_sample": p3,
    "P4_uniform_sample": p4,
    "P5_weighted_sample": p5,
    "P6_class_weights": p6,
    "P6_row_weights": p6r,
}

_CM = """c AS (SELECT count(*) FILTER (label = 0 AND NOT hit) AS tn, count(*) FILTER (label = 0 AND hit) AS fp,
  count(*) FILTER (label = 1 AND NOT hit) AS fn, count(*) FILTER (label = 1 AND hit) AS tp FROM (SELECT *, prob > 0.5::DOUBLE AS hit FROM scored))"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


_PER = f"""{_CM}, m AS (SELECT *, {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tn', 'tn + fn')} AS pn, {_div('tn', 'tn + fp')} AS rn,
  {_div('tp', 'tp + fp')} AS pa, {_div('tp', 'tp + fn')} AS ra, tn + fp AS sn, tp + fn AS sa FROM c),
f AS (SELECT *, {_div('2 * pn * rn', 'pn + rn')} AS fnn, {_div('2 * pa * ra', 'pa + ra')} AS fa FROM m)"""

_REPORT_MULTI = f"""WITH m AS (SELECT label, CASE WHEN {unit(3, 'id')} < 0.3 THEN ((label + 1 + id % 3) % 10)::INTEGER ELSE label END AS pred FROM vectors10),
k AS (SELECT DISTINCT label AS cls FROM m UNION SELECT DISTINCT pred FROM m),
t AS (SELECT cls, (SELECT count(*) FROM m WHERE label = cls) AS support, (SELECT count(*) FROM m WHERE pred = cls) AS predicted,
  (SELECT count(*) FROM m WHERE pred = cls AND label = cls) AS hits FROM k),
r AS (SELECT *, {_div('hits', 'predicted')} AS p, {_div('hits', 'support')} AS r FROM t),
f AS (SELECT *, {_div('2 * p * r', 'p + r')} AS f FROM r)
SELECT cls::VARCHAR AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM f"""

_AUC = """(SELECT sum((SELECT count(*) FROM {s} b WHERE b.label <> {c} AND b.p < a.p) + 0.5::DOUBLE * (SELECT count(*) FROM {s} b WHERE b.label <> {c} AND b.p = a.p))
  / (count(*) * (SELECT count(*) FROM {s} WHERE label <> {c})) FROM {s} a WHERE a.label = {c})"""

_GRID = """g AS (SELECT {unit}.i / {scale}::DOUBLE AS t FROM range({lo}, {hi}, {step}) {unit}(i)),
c AS (SELECT t, count(*) FILTER (label = 1 AND prob {op} t) AS tp, count(*) FILTER (label = 0 AND prob {op} t) AS fp,
  count(*) FILTER (label = 1 AND NOT prob {op} t) AS fn, count(*) FILTER (label = 0 AND NOT prob {op} t) AS tn FROM scored, g GROUP BY t)"""
_SEARCH = _GRID.format(unit="r", scale=100, lo=10, hi=90, step=5, op=">=")
_TABLE = _GRID.format(unit="r", scale=10, lo=1, hi=10, step=1, op=">")
_TABLE_OUT = f"""{_TABLE}, o AS (SELECT t AS threshold, {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
  CASE WHEN tp + fp = 0 THEN 1.0 WHEN tn + fn = 0 THEN 0.0 ELSE {_div('tn', 'tn + fp')} END AS normal_recall,
  CASE WHEN tp + fp = 0 THEN 0.0 WHEN tn + fn = 0 THEN 1.0 ELSE {_div('tp', 'tp + fn')} END AS attack_recall,
  CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE {_div('2 * tp', '2 * tp + fp + fn')} END AS f1_score FROM c)"""
_TABLE_COLS = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in ("threshold", "accuracy", "normal_recall", "attack_recall", "f1_score"))


def _search(score: str) -> str:
    return with_views(
        "scored",
        f"""WITH {_SEARCH}, s AS (SELECT t, {score} AS s FROM c ORDER BY s DESC, t LIMIT 1)
SELECT CASE WHEN s > 0 THEN t ELSE 0.5 END::DOUBLE AS threshold, round(s, 6) AS score FROM s""",
    )


_RANK = f"row_number() OVER (PARTITION BY label ORDER BY {digest(42, 'id')}, id)"

ORACLE = {
    "V1_confusion": with_views("scored", f"WITH {_CM} SELECT * FROM c"),
    "V2_performance": with_views(
        "scored",
        f"""WITH {_PER} SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(pn, 6) AS precision_normal, round(rn, 6) AS recall_normal,
  sn AS support_normal, round(pa, 6) AS precision_attack, round(ra, 6) AS recall_attack, sa AS support_attack,
  round(fnn, 6) AS f1_normal, round(fa, 6) AS f1_attack, round((pn * sn + pa * sa) / (sn + sa), 6) AS precision_avg,
  round((rn * sn + ra * sa) / (sn + sa), 6) AS recall_avg, round((fnn * sn + fa * sa) / (sn + sa), 6) AS f1_avg,
  round(rn, 6) AS true_negative_rate, round({_div('fp', 'fp + tn')}, 6) AS false_positive_rate, round(ra, 6) AS true_positive_rate,
  round({_div('fn', 'fn + tp')}, 6) AS false_negative_rate FROM f""",
    ),
    "V3_classification_report": with_views("vectors10", _REPORT_MULTI),
    "V4_security_metrics": with_views(
        "scored",
        f"""WITH {_PER} SELECT tn, fp, fn, tp, round(ra, 6) AS recall, round(pa, 6) AS precision, round({_div('5 * pa * ra', '4 * pa + ra')}, 6) AS f2_score,
  round(ra, 6) AS attack_detection_rate, round({_div('fp', 'fp + tn')}, 6) AS false_alarm_rate FROM f""",
    ),
    "V5_roc_auc": with_views(
        "scored",
        """WITH r AS (SELECT label, row_number() OVER (ORDER BY prob) AS rn, prob FROM scored),
a AS (SELECT label, avg(rn) OVER (PARTITION BY prob) AS rk FROM r),
n AS (SELECT count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS q, sum(rk) FILTER (label = 1) AS s FROM a)
SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM n""",
    ),
    "V5_roc_auc_by_class": with_views(
        "vectors10",
        "WITH z AS (SELECT id, label, list_transform(x[1:10], lambda v: exp(v - list_max(x[1:10]))) AS e FROM vectors10), "
        + ", ".join(f"s{c} AS (SELECT label, round(e[{c + 1}] / list_sum(e), 3) AS p FROM z)" for c in range(10))
        + ", per AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cls, {_AUC.format(s=f's{c}', c=c)} AS auc" for c in range(10))
        + ") SELECT cls, round(auc, 6) AS auc FROM per UNION ALL SELECT 'macro', round(avg(auc), 6) FROM per",
    ),
    "V6_average_precision": with_views(
        "scored",
        """WITH c AS (SELECT prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY prob),
w AS (SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp FROM c)
SELECT round(sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos), 6) AS average_precision FROM w""",
    ),
    "V7_threshold_search_f2": _search(_div("5 * tp", "5 * tp + 4 * fn + fp")),
    "V7_threshold_search_recall": _search(_div("tp", "tp + fn")),
    "V7_threshold_search_precision": _search(_div("tp", "tp + fp")),
    "V8_threshold_table": with_views("scored", f"WITH {_TABLE_OUT} SELECT {_TABLE_COLS} FROM o"),
    "V8_best_threshold": with_views(
        "scored", f"WITH {_TABLE_OUT}, b AS (SELECT * FROM o ORDER BY f1_score DESC, threshold LIMIT 1) SELECT {_TABLE_COLS} FROM b"
    ),
    "V9_confidence": with_views(
        "scored",
        """WITH k AS (SELECT greatest(prob, 1 - prob) AS c FROM scored), a AS (SELECT avg(c) AS mean, stddev_pop(c) AS std, min(c) AS min, max(c) AS max,
  count(*) FILTER (c > 0.9::DOUBLE) AS high, count(*) FILTER (c BETWEEN 0.7::DOUBLE AND 0.9::DOUBLE) AS medium, count(*) FILTER (c < 0.7::DOUBLE) AS low, count(*) AS n FROM k)
SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, high, medium, low, n,
  round(high * 100.0::DOUBLE / n, 6) AS high_percent, round(medium * 100.0::DOUBLE / n, 6) AS medium_percent, round(low * 100.0::DOUBLE / n, 6) AS low_percent FROM a""",
    ),
    "V10_advice": with_views(
        "scored",
        f"WITH {_PER} SELECT CASE WHEN ra < 0.1 THEN 'critical' WHEN accuracy < 0.7 THEN 'low' ELSE 'acceptable' END AS quality FROM f",
    ),
    "M5_security_loss": with_views(
        "scored",
        """WITH z AS (SELECT label, logits[2] AS z FROM scored),
l AS (SELECT label, z, ln(1 + exp(z)) - CASE WHEN label = 1 THEN z ELSE 0 END AS ce FROM z)
SELECT round(avg(CASE WHEN label = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * ce * CASE WHEN label = 1 AND z <= 0 THEN 2 ELSE 1 END), 6) AS loss FROM l""",
    ),
    "P1_stratified_split": with_views(
        "scored",
        f"""SELECT id, label, (rn <= round(n * 0.2::DOUBLE))::INTEGER AS is_test FROM
(SELECT id, label, {_RANK} AS rn, count(*) OVER (PARTITION BY label) AS n FROM scored)""",
    ),
    "P2_stratified_folds": with_views("scored", f"SELECT id, label, (({_RANK} - 1) % 5)::INTEGER AS fold FROM scored"),
    "P3_balanced_sample": with_views(
        "scored",
        f"""WITH r AS (SELECT id, label, {_RANK} AS rn FROM scored), m AS (SELECT least(min(n), 500) AS m FROM (SELECT count(*) AS n FROM scored GROUP BY label))
SELECT id, label FROM r, m WHERE rn <= m""",
    ),
    "P4_uniform_sample": with_views("scored", f"SELECT id, label FROM scored ORDER BY {digest(42, 'id')}, id LIMIT 2000"),
    "P5_weighted_sample": with_views(
        "scored",
        f"""WITH r AS (SELECT id, label, {_RANK} - 1 AS i, count(*) OVER (PARTITION BY label) AS m FROM scored),
d AS (SELECT i AS draw, floor({unit('42c', 'i')} * 2)::INTEGER AS c, {unit('42r', 'i')} AS u FROM range((SELECT count(*) FROM events)) t(i))
SELECT draw, id, label FROM d JOIN r ON label = c AND r.i = floor(u * m)::BIGINT""",
    ),
    "P6_class_weights": with_views(
        "scored",
        """WITH c AS (SELECT label, count(*) AS n FROM scored GROUP BY label)
SELECT label, n, round(1.0::DOUBLE / n, 12) AS raw_weight, round((1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM c), 12) AS weight FROM c""",
    ),
    "P6_row_weights": with_views(
        "scored",
        """WITH c AS (SELECT label, count(*) AS n FROM scored GROUP BY label), w AS (SELECT label, (1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM c) AS w FROM c)
SELECT id, label, round(w, 9) AS weight FROM scored JOIN w USING (label)""",
    ),
}
