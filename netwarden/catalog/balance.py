"""Class balance, neighbour and resampling-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.catalog.prepare import as_double
from netwarden.catalog.views import digest, unit, with_views
from netwarden.functions.values import array_sum
from netwarden.operators import margin, quality, resample
from netwarden.operators.neighbours import nearest, nearest_approximate, recall, silhouette
from netwarden.plans import standins
from netwarden.plans.scale import stage

vectors = standins.vectors


def points(df: DataFrame) -> DataFrame:
    """Vectors in comparable form: first and last dimension and the sum."""
    x = F.col("x")
    return df.select(
        "id",
        "label",
        F.round(x[0], 6).alias("x0"),
        F.round(x[19], 6).alias("x19"),
        F.round(array_sum(x), 5).alias("sx"),
    )


def r1(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(resample.class_distribution(vectors(spark, folder, None)), ["percent"])


def r2(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.imbalance(vectors(spark, folder))
    return as_double(out, ["ratio"]).withColumn("act", F.col("act").cast("int"))


def r3(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(vectors(spark, folder, None), 3)
    return as_double(near, ["dist"]).select("id", "nn_id", "rank", "dist")


def r3c(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(vectors(spark, folder, None), 3, scope="label")
    return as_double(near, ["dist"]).select(F.col("scope").alias("cls"), "id", "nn_id", "rank", "dist")


def r4(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.smote(vectors(spark, folder)))


def r4m(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.smote_rows(vectors(spark, folder, None), 3))


def r5(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.adasyn_rows(vectors(spark, folder)))


def r6(spark: SparkSession, folder: str) -> DataFrame:
    return resample.danger_rows(vectors(spark, folder)).select("id", "label", "foreign")


def r6s(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.borderline_rows(vectors(spark, folder, None)))


def r7(spark: SparkSession, folder: str) -> DataFrame:
    return resample.tomek_links(vectors(spark, folder, None))


def r7s(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.smote_tomek(vectors(spark, folder)))


def overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """Classes that overlap everywhere, so that neighbours often differ in class."""
    return vectors(spark, folder).withColumn("label", (F.col("id") % 11 == 3).cast("int"))


def r7l(spark: SparkSession, folder: str) -> DataFrame:
    return points(resample.smote_tomek(overlapping(spark, folder)))


def r8(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.split_and_rescue(vectors(spark, folder))
    return points(out).join(out.select("id", F.col("is_test").cast("int").alias("is_test")), "id")


def r9(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder, None)
    return as_double(resample.change_report(rows, resample.smote(rows, 3)), ["change_percent"])


def r10(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.choose_neighbours(vectors(spark, folder), "both", folds=3)
    return as_double(out, ["silhouette", "davies_bouldin", "score"]).withColumn("best", F.col("best").cast("int"))


_COMPARED: dict[tuple[str, str], DataFrame] = {}


def compared(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison of all methods, stored once per application: two queries read it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _COMPARED:
        _COMPARED[key] = stage(resample.compare_methods(vectors(spark, folder)), "compared")
    return _COMPARED[key]


def r11(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(compared(spark, folder), ["avg", "std"])


def r11_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison, significance against the first method, and selection, each from the one before."""
    results = compared(spark, folder)
    summary_ = resample.comparison_summary(results.where("metric <> 'time'"))
    tests = resample.significance(summary_, n=len(resample.COMPARED_SEEDS))
    differing = tests.groupBy("method").agg(F.count_if("significant").alias("n_significant"))
    chosen = resample.select_method(resample.comparison_results(results))
    return chosen.join(differing, "method", "left").select(
        "method",
        F.round("total_score", 6).alias("total_score"),
        *[F.col(c).cast("int").alias(c) for c in ("filtered", "selected")],
        F.coalesce("n_significant", F.lit(0)).alias("n_significant"),
    )


def q2m(spark: SparkSession, folder: str) -> DataFrame:
    """How the margin holds against plain facts: it is wrong on no more rows than the larger class would be."""
    rows = stage(resample.smote(vectors(spark, folder)).withColumn("scope", F.lit("all")), "margin")
    found = margin.errors(rows, margin.fit(rows)).first()
    least = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"), F.sum("n").alias("rows"))
    return least.select(F.col("rows"), (F.lit(found["wrong"]) <= F.col("n")).cast("int").alias("holds"))


def r3a(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the approximate search against the exact one, over all rows."""
    rows = vectors(spark, folder, None)
    found = recall(nearest_approximate(rows, 3), nearest(rows, 3)).select("n", "recall")
    return found.select("n", (F.col("recall") >= 0.9).cast("int").alias("enough"), F.round("recall", 4).alias("recall"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as methods, in alphabetical order, with two measured metrics."""
    events = standins.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    tall = events.select(
        F.col("event_type").alias("method"),
        F.explode(
            F.array(
                F.struct(F.lit("value").alias("metric"), F.col("value").alias("v")),
                F.struct(F.lit("k").alias("metric"), k.alias("v")),
            )
        ).alias("m"),
    )
    return tall.groupBy("method", F.col("m.metric").alias("metric")).agg(
        F.avg("m.v").alias("avg"), (F.stddev_pop("m.v") / 40).alias("std"), F.min("method").alias("ord")
    )


def r12(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.significance(summary(spark, folder))
    return as_double(out, ["p_value", "adj_p_value"]).withColumn("significant", F.col("significant").cast("int"))


def r13(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as methods; metrics are averages of what their events carry."""
    k = F.get_json_object("props", "$.k").cast("double")
    results = standins.table(spark, folder, "events").groupBy(F.col("event_type").alias("method")).agg(
        (F.avg(k) / 70).alias("val_acc"),
        (F.avg("value") / 100).alias("boundary_violation_rate"),
        F.when(F.min("event_type") != "click", F.avg(F.col("user_id") / 150)).alias("silhouette_score"),
        F.avg(F.col("event_id") % 7).alias("feature_correlation_diff"),
    )
    out = resample.select_method(results)
    return as_double(out, ["total_score"]).withColumns(
        {c: F.col(c).cast("int") for c in ("filtered", "selected")}
    )


def q1(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.neighbour_distance(vectors(spark, folder))
    return as_double(out, out.columns)


def q2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.boundary_violations(resample.smote(vectors(spark, folder)))


def shrunk(df: DataFrame) -> DataFrame:
    """A second table to compare with: every third vector moved towards zero."""
    return df.withColumn("x", F.transform("x", lambda v: F.when(F.col("id") % 3 == 0, v * 0.5).otherwise(v)))


def q3(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    return as_double(quality.divergence(rows, shrunk(rows)), ["distribution_divergence"])


def q4(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(quality.new_imbalance(vectors(spark, folder)), ["new_imbalance_ratio"])


def q5(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(silhouette(vectors(spark, folder, None)), ["silhouette"]).select("silhouette")


def q6(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.davies_bouldin(vectors(spark, folder, None))
    return as_double(out, ["davies_bouldin"]).select("davies_bouldin")


def q7(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    out = quality.correlation_difference(rows, shrunk(rows))
    return as_double(out, ["feature_correlation_diff"]).select("feature_correlation_diff")


def q8(spark: SparkSession, folder: str) -> DataFrame:
    return as_double(quality.projection(vectors(spark, folder, None)), ["pc1", "pc2"], 4)


QUERIES = {
    "R1_class_distribution": r1,
    "R2_imbalance_ratio": r2,
    "R3_nearest_neighbours": r3,
    "R3_neighbours_in_class": r3c,
    "R4_smote": r4,
    "R4_smote_multiclass": r4m,
    "R5_adasyn": r5,
    "R6_danger_rows": r6,
    "R6_borderline_smote": r6s,
    "R7_tomek_links": r7,
    "R7_smote_tomek": r7s,
    "R7_smote_tomek_links": r7l,
    "R8_split_and_rescue": r8,
    "R9_change_report": r9,
    "R10_choose_neighbours": r10,
    "R11_compare_methods": r11,
    "R11_to_R13_flow": r11_flow,
    "R3_approximate": r3a,
    "Q2_margin_holds": q2m,
    "R12_significance": r12,
    "R13_select_method": r13,
    "Q1_neighbour_distance": q1,
    "Q2_boundary_violations": q2,
    "Q3_divergence": q3,
    "Q4_new_imbalance": q4,
    "Q5_silhouette": q5,
    "Q6_davies_bouldin": q6,
    "Q7_correlation_difference": q7,
    "Q8_projection": q8,
}


def dist(a: str = "a.x", b: str = "b.x") -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def near_sql(name: str, source: str, k: int, same_class: bool = False, asked: str | None = None) -> str:
    match = "AND a.label = b.label" if same_class else ""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS rank
  FROM (SELECT a.id, a.label, b.id AS nn_id, b.label AS nn_label, {dist()} AS dist FROM {asked or source} a JOIN {source} b ON a.id <> b.id {match})) WHERE rank <= {k})"""


POINTS = "id, label, round(x[1], 6) AS x0, round(x[20], 6) AS x19, round(list_sum(x), 5) AS sx"
_MIX = "list_transform(list_zip(b.x, n.x), lambda p: p[1] + d.gap * (p[2] - p[1]))"


def smote_sql(source: str, k: int, seed: str = "smote42", bases: str | None = None) -> str:
    """CTEs ending in ``syn(id, label, x)``."""
    return f"""cnt AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
nd AS (SELECT label, (SELECT max(n) FROM cnt) - n AS need FROM cnt WHERE n < (SELECT max(n) FROM cnt)
  AND label IN (SELECT label FROM {bases or source})),
st AS (SELECT label, need, coalesce(sum(need) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM nd),
ix AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {digest(seed, 'id')}, id) - 1 AS i,
  count(*) OVER (PARTITION BY label) AS m FROM {bases or source} WHERE label IN (SELECT label FROM nd)),
{near_sql('nr', source, k, True)},
dr AS (SELECT label, first, j, {unit(seed + 'b', 'label', 'j')} AS ub, floor({unit(seed + 'n', 'label', 'j')} * {k}) + 1 AS rank,
  {unit(seed + 'g', 'label', 'j')} AS gap FROM st, LATERAL (SELECT unnest(range(need::BIGINT)) AS j)),
syn AS (SELECT (-1 - d.first - d.j)::BIGINT AS id, d.label, {_MIX} AS x FROM dr d JOIN ix ON ix.label = d.label AND ix.i = floor(d.ub * ix.m)
  JOIN nr ON nr.id = ix.id AND nr.rank = d.rank JOIN {source} b ON b.id = ix.id JOIN {source} n ON n.id = nr.nn_id)"""


_ADASYN = f"""cnt AS (SELECT label, count(*) AS n FROM vectors GROUP BY label),
nd AS (SELECT label, (SELECT max(n) FROM cnt) - n AS need FROM cnt WHERE n < (SELECT max(n) FROM cnt)),
{near_sql('al', 'vectors', 3)}, {near_sql('nr', 'vectors', 3, True)},
sh AS (SELECT id, label, count(*) FILTER (nn_label <> label) / 3.0::DOUBLE AS r FROM al WHERE label IN (SELECT label FROM nd) GROUP BY ALL),
mk AS (SELECT id, label, round_even(r / (SELECT sum(r) FROM sh s2 WHERE s2.label = sh.label) * need, 0)::BIGINT AS make FROM sh JOIN nd USING (label)),
of AS (SELECT *, sum(make) OVER (ORDER BY id) - make AS first FROM mk),
d AS (SELECT id AS base, label, first, j, floor({unit('ada42n', 'id', 'j')} * 3) + 1 AS rank, {unit('ada42g', 'id', 'j')} AS gap
  FROM of, LATERAL (SELECT unnest(range(make)) AS j)),
syn AS (SELECT (-1 - d.first - d.j)::BIGINT AS id, d.label, {_MIX} AS x FROM d JOIN nr ON nr.id = d.base AND nr.rank = d.rank
  JOIN vectors b ON b.id = d.base JOIN vectors n ON n.id = nr.nn_id)"""

_DANGER10 = f"""{near_sql('al', 'vectors10', 10)}, c10 AS (SELECT label, count(*) AS n FROM vectors10 GROUP BY label),
fg AS (SELECT id, label, count(*) FILTER (nn_label <> label) AS f FROM al WHERE label IN (SELECT label FROM c10 WHERE n < (SELECT max(n) FROM c10)) GROUP BY ALL),
dg AS (SELECT v.* FROM fg JOIN vectors10 v USING (id) WHERE f >= 5 AND f < 10)"""


def links_sql(source: str) -> str:
    return f"""{near_sql('n1', source, 1)},
lk AS (SELECT p.id AS id_a, p.nn_id AS id_b, p.label AS label_a, p.nn_label AS label_b FROM n1 p JOIN n1 q ON p.nn_id = q.id AND q.nn_id = p.id
  WHERE p.id < q.id AND p.label <> p.nn_label)"""


_SPLIT = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {digest(42, 'id')}, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM vectors),
tr AS (SELECT id, label, x FROM rk WHERE rn > round(n * 0.2::DOUBLE)), te AS (SELECT id, label, x FROM rk WHERE rn <= round(n * 0.2::DOUBLE))"""

_SHRUNK = "sh AS (SELECT id, label, list_transform(x, lambda v: CASE WHEN id % 3 = 0 THEN v * 0.5::DOUBLE ELSE v END) AS x FROM vectors)"
_PAIRS = [(i, j) for i in range(20) for j in range(i + 1, 20)]


def _corr(source: str) -> str:
    return ", ".join(f"corr(x[{i + 1}], x[{j + 1}]) AS r{i}_{j}" for i, j in _PAIRS) + f" FROM {source}"


_T = "(abs(b.avg - s.avg) / sqrt((b.std * b.std + s.std * s.std) / 2 * 0.4))"
_C2 = f"(8 / (8 + {_T} * {_T}))"
_P = f"(1 - {_T} / sqrt(8 + {_T} * {_T}) * (1 + 0.5 * {_C2} + 0.375 * {_C2} * {_C2} + 0.3125 * {_C2} * {_C2} * {_C2}))"
_NORM = {"val_acc": 0.5, "boundary_violation_rate": -0.3, "silhouette_score": 0.15, "feature_correlation_diff": -0.05}


def _score(m: str, w: float) -> str:
    lo, hi, mean = (f"(SELECT {f}({m}) FROM v)" for f in ("min", "max", "avg"))
    norm = f"((coalesce({m}, {mean}) - {lo}) / ({hi} - {lo} + 1e-10))"
    return f"{norm} * {w}::DOUBLE" if w > 0 else f"(1 - {norm}) * {-w}::DOUBLE"


ORACLE = {
    "R1_class_distribution": with_views(
        "vectors10",
        "SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM vectors10), 6) AS percent FROM vectors10 GROUP BY label",
    ),
    "R2_imbalance_ratio": with_views(
        "vectors",
        """WITH c AS (SELECT count(*) AS n FROM vectors GROUP BY label) SELECT max(n) AS largest, min(n) AS smallest,
  round(max(n)::DOUBLE / min(n), 6) AS ratio, (max(n)::DOUBLE / min(n) > 10)::INTEGER AS act FROM c""",
    ),
    "R3_nearest_neighbours": with_views(
        "vectors10",
        f"WITH {near_sql('nr', 'vectors10', 3)} SELECT id, nn_id, rank::INTEGER AS rank, round(dist, 6) AS dist FROM nr",
    ),
    "R3_neighbours_in_class": with_views(
        "vectors10",
        f"WITH {near_sql('nr', 'vectors10', 3, True)} SELECT label::VARCHAR AS cls, id, nn_id, rank::INTEGER AS rank, round(dist, 6) AS dist FROM nr",
    ),
    "Q2_margin_holds": with_views(
        "vectors",
        "WITH c AS (SELECT count(*) AS n FROM vectors GROUP BY label) SELECT (max(n) * count(*))::BIGINT AS rows, 1 AS holds FROM c",
    ),
    "R4_smote": with_views(
        "vectors",
        f"WITH {smote_sql('vectors', 3)} SELECT {POINTS} FROM (SELECT id, label, x FROM vectors UNION ALL SELECT id, label, x FROM syn)",
    ),
    "R4_smote_multiclass": with_views("vectors10", f"WITH {smote_sql('vectors10', 3)} SELECT {POINTS} FROM syn"),
    "R5_adasyn": with_views("vectors", f"WITH {_ADASYN} SELECT {POINTS} FROM syn"),
    "R6_danger_rows": with_views(
        "vectors",
        f"""WITH {near_sql('al', 'vectors', 10)}, f AS (SELECT id, label, count(*) FILTER (nn_label <> label) AS "foreign" FROM al WHERE label = 1 GROUP BY ALL)
SELECT * FROM f WHERE "foreign" >= 5 AND "foreign" < 10""",
    ),
    "R6_borderline_smote": with_views(
        "vectors10", f"WITH {_DANGER10}, {smote_sql('vectors10', 3, 'border42', 'dg')} SELECT {POINTS} FROM syn"
    ),
    "R7_tomek_links": with_views("vectors10", f"WITH {links_sql('vectors10')} SELECT * FROM lk"),
    # The class that was larger before, label 0, loses its members of links.
    **{
        name: with_views(
            "vectors",
            f"""WITH src AS (SELECT id, {label} AS label, x FROM vectors), {smote_sql('src', 3)},
al AS (SELECT id, label, x FROM src UNION ALL SELECT id, label, x FROM syn), {links_sql('al')}
SELECT {POINTS} FROM al WHERE NOT (label = 0 AND (id IN (SELECT id_a FROM lk) OR id IN (SELECT id_b FROM lk)))""",
        )
        for name, label in (("R7_smote_tomek", "label"), ("R7_smote_tomek_links", "(id % 11 = 3)::INTEGER"))
    },
    "R8_split_and_rescue": with_views(
        "vectors",
        f"""WITH {_SPLIT}, {smote_sql('tr', 5)}, al AS (SELECT id, label, x, 0 AS is_test FROM tr UNION ALL SELECT id, label, x, 0 FROM syn
  UNION ALL SELECT id, label, x, 1 FROM te) SELECT {POINTS}, is_test FROM al""",
    ),
    "R9_change_report": with_views(
        "vectors10",
        """WITH c AS (SELECT label, count(*) AS n FROM vectors10 GROUP BY label), m AS (SELECT max(n) AS t FROM c)
SELECT label, n AS before, t AS after, round((t - n)::DOUBLE / n * 100, 6) AS change_percent FROM c, m""",
    ),
    "R12_significance": f"""WITH s AS (SELECT event_type AS method, 'value' AS metric, avg(value) AS avg, greatest(stddev_pop(value) / 40, 0.01) AS std FROM events GROUP BY ALL
  UNION ALL SELECT event_type, 'k', avg((props->>'$.k')::DOUBLE), greatest(stddev_pop((props->>'$.k')::DOUBLE) / 40, 0.01) FROM events GROUP BY ALL),
t AS (SELECT s.method, s.metric, b.method AS baseline, greatest(0, {_P}) AS p FROM s JOIN s b ON s.metric = b.metric AND b.method = 'click' WHERE s.method <> 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, method) AS i, count(*) OVER (PARTITION BY metric) AS m FROM t),
a AS (SELECT *, least(1, min(p * m / i) OVER (PARTITION BY metric ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
SELECT method, metric, baseline, round(p, 6) AS p_value, round(q, 6) AS adj_p_value, (q <= 0.05)::INTEGER AS significant FROM a""",
    "R13_select_method": f"""WITH r AS (SELECT event_type AS method, avg((props->>'$.k')::DOUBLE) / 70 AS val_acc, avg(value) / 100 AS boundary_violation_rate,
  CASE WHEN event_type <> 'click' THEN avg(user_id / 150.0::DOUBLE) END AS silhouette_score, avg(event_id % 7) AS feature_correlation_diff FROM events GROUP BY event_type),
v AS (SELECT * FROM r WHERE val_acc >= 0.7), s AS (SELECT method, {' + '.join(_score(m, w) for m, w in _NORM.items())} AS t FROM v)
SELECT method, round(t, 6) AS total_score, 0 AS filtered, (t = (SELECT max(t) FROM s))::INTEGER AS selected FROM s
UNION ALL SELECT method, NULL, 1, 0 FROM r WHERE val_acc < 0.7""",
    "Q1_neighbour_distance": with_views(
        "vectors",
        f"WITH {near_sql('nr', 'vectors', 1)} SELECT round(avg(dist), 6) AS avg_neighbor_distance, round(stddev_pop(dist), 6) AS neighbor_std FROM nr",
    ),
    "Q3_divergence": with_views(
        "vectors",
        f"""WITH {_SHRUNK}, c AS (SELECT unnest(x) AS v FROM vectors), k AS (SELECT unnest(x) AS v FROM sh),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM c),
b AS (SELECT lo, hi, ceil((hi - lo) / least(2 * iqr / n ** (1.0::DOUBLE / 3), (hi - lo) / (log2(n) + 1)))::INTEGER AS nb FROM s),
g AS (SELECT unnest(range(nb)) AS bin FROM b),
p AS (SELECT least(floor((v - lo) / (hi - lo) * nb), nb - 1)::INTEGER AS bin, count(*) AS n FROM c, b GROUP BY 1),
q AS (SELECT least(floor((v - lo) / (hi - lo) * nb), nb - 1)::INTEGER AS bin, count(*) AS n FROM k, b WHERE v BETWEEN lo AND hi GROUP BY 1),
m AS (SELECT coalesce(p.n, 0) + 1e-10 AS p, coalesce(q.n, 0) + 1e-10 AS q FROM g LEFT JOIN p USING (bin) LEFT JOIN q USING (bin)),
t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM m)
SELECT round(sum(p / tp * ln((p / tp) / (q / tq))), 6) AS distribution_divergence FROM m, t""",
    ),
    "Q4_new_imbalance": with_views(
        "vectors",
        "WITH c AS (SELECT count(*) AS n FROM vectors GROUP BY label) SELECT round(max(n)::DOUBLE / min(n), 6) AS new_imbalance_ratio FROM c",
    ),
    "Q5_silhouette": with_views(
        "vectors10",
        f"""WITH p AS (SELECT a.id, a.label, b.label AS other, sum({dist()}) AS t FROM vectors10 a JOIN vectors10 b ON true GROUP BY ALL),
n AS (SELECT label AS other, count(*) AS n FROM vectors10 GROUP BY label),
ab AS (SELECT id, max(CASE WHEN label = p.other THEN t / (n - 1) END) AS a, min(CASE WHEN label <> p.other THEN t / n END) AS b FROM p JOIN n ON p.other = n.other GROUP BY id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""",
    ),
    "Q6_davies_bouldin": with_views(
        "vectors10",
        f"""WITH c AS (SELECT label, [{', '.join(f'avg(x[{i + 1}])' for i in range(20))}] AS x FROM vectors10 GROUP BY label),
s AS (SELECT a.label, b.x, avg({dist()}) AS s FROM vectors10 a JOIN c b ON a.label = b.label GROUP BY ALL),
w AS (SELECT a.label, max((a.s + b.s) / {dist()}) AS w FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
SELECT round(avg(w), 6) AS davies_bouldin FROM w""",
    ),
    "Q7_correlation_difference": with_views(
        "vectors",
        f"WITH {_SHRUNK}, o AS (SELECT {_corr('vectors')}), n AS (SELECT {_corr('sh')}) SELECT round(2 * ("
        + " + ".join(f"abs(o.r{i}_{j} - n.r{i}_{j})" for i, j in _PAIRS)
        + ") / 400, 6) AS feature_correlation_diff FROM o, n",
    ),
}
