"""Class balance: distribution, oversampling by interpolation, Tomek links, comparison of methods.

Rows have ``id`` (long), ``label`` (int) and ``x`` (array of double). Synthetic rows get
negative ids. Every random choice follows a digest, so results repeat exactly.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.operators import margin
from netwarden.operators.neighbours import nearest, nearest_lists, silhouette
from netwarden.operators.quality import correlation_difference, davies_bouldin, divergence
from netwarden.operators.split import class_counts, stratified_folds, stratified_split
from netwarden.plans.scale import hash_unit, index_by_hash, pin_small, repeat_rows, running_totals, stage

# Gate on the imbalance ratio, neighbours, and neighbours for the danger test.
RATIO_GATE = 10.0
MAX_NEIGHBOURS, DANGER_NEIGHBOURS = 3, 10
RESCUE_BELOW, RESCUE_NEIGHBOURS = 1000, 5
MAX_TESTED_NEIGHBOURS = 10
COMPARED_SEEDS = [42, 43, 44, 45, 46]
# Tables made at the same time: their many short jobs leave most cores idle.
SIDE_BY_SIDE = 5
METHODS = ["SMOTE", "ADASYN", "SMOTE+TOMEK", "Borderline-SMOTE"]


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") * 100.0 / total).alias("percent"))


def imbalance(df: DataFrame, label: str = "label", gate: float = RATIO_GATE) -> DataFrame:
    """Largest over smallest class, and whether that calls for oversampling."""
    return (
        class_counts(df, label)
        .agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
        .withColumn("ratio", F.col("largest") / F.col("smallest"))
        .withColumn("act", F.col("ratio") > gate)
    )


def _needs(rows: DataFrame) -> list[tuple[int, int, int]]:
    """``(label, n, rows to add)`` of every class below the majority; classes are few."""
    counts = [(r["label"], r["n"]) for r in pin_small(class_counts(rows)).collect()]
    top = max(n for _, n in counts)
    return sorted((c, n, top - n) for c, n in counts if n < top)


def default_neighbours(rows: DataFrame, most: int = MAX_NEIGHBOURS) -> int:
    least = class_counts(rows).agg(F.min("n")).first()[0]
    k = min(most, least - 1)
    if k < 1:
        raise ValueError(f"cannot oversample: the smallest class has {least} rows")
    return k


def _between(gap: Column) -> Column:
    """A point between ``x`` and the neighbour in place ``rank`` of ``found``."""
    end = F.get("found", F.col("rank") - 1)["nn_x"]
    return F.zip_with("x", end, lambda a, b: a + gap * (b - a))


def _draw(spark, needs: list[tuple[str, int, int]], seed: str) -> DataFrame:
    """Numbered draws per group: ``at`` counts over all groups, ``m`` is the number of bases."""
    parts, first = None, 0
    for group, bases, need in needs:
        part = spark.range(need).select(
            F.lit(group).alias("grp"),
            F.col("id").alias("j"),
            (F.col("id") + first).alias("at"),
            F.lit(bases).cast("long").alias("m"),
        )
        parts = part if parts is None else parts.unionByName(part)
        first += need
    g, j = F.col("grp"), F.col("j")
    return parts.select(
        "grp", "at", "m",
        hash_unit(f"{seed}b", g, j).alias("u_base"),
        hash_unit(f"{seed}n", g, j).alias("u_rank"),
        hash_unit(f"{seed}g", g, j).alias("gap"),
    )


def _synthetic(
    bases: DataFrame, pool: DataFrame, needs: list[tuple[str, int, int]], ks: list[int], seed: str
) -> DataFrame:
    """Draws from ``bases`` (grp, id, x) towards neighbours in ``pool`` (grp, id, x), for each k.

    ``needs`` has ``(grp, number of bases, rows to make)``. A draw that goes to the same neighbour for several
    k is one row, and ``ks`` tells which.
    """
    lists = nearest_lists(pool, max(ks), queries=bases, scope="grp", carry=["x"])
    indexed = index_by_hash(bases, "grp", "id", seed, sum(n for _, n, _ in needs), "i")
    ends = indexed.join(lists.withColumnRenamed("scope", "grp"), ["grp", "id"])
    return (
        _draw(bases.sparkSession, needs, seed)
        .withColumn("i", F.floor(F.col("u_base") * F.col("m")).cast("long"))
        .join(stage(ends, "ends"), ["grp", "i"])
        .withColumn("ranks", F.array(*[(F.floor(F.col("u_rank") * k) + 1).cast("int") for k in ks]))
        .withColumn("rank", F.explode(F.array_distinct("ranks")))
        .withColumn("ks", F.filter(F.array(*[F.lit(k) for k in ks]), lambda _, i: F.get("ranks", i) == F.col("rank")))
        .select("grp", "ks", "at", _between(F.col("gap")).alias("x"))
    )


def _numbered(synthetic: DataFrame) -> DataFrame:
    """Synthetic rows as ``id, label, x``; ids run downwards from -1 over the classes."""
    return synthetic.select((-1 - F.col("at")).alias("id"), F.col("grp").cast("int").alias("label"), "x")


def _grouped(rows: DataFrame, needs: list[tuple[int, int, int]]) -> DataFrame:
    wanted = [label for label, _, _ in needs]
    return rows.where(F.col("label").isin(wanted)).select(
        F.col("label").cast("string").alias("grp"), "id", "x"
    )


def _base(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "x")


def smote_rows(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Only the synthetic rows that bring every class up to the majority count."""
    needs = _needs(rows)
    if not needs:
        return _base(rows).limit(0)
    k = k or default_neighbours(rows)
    pool = _grouped(rows, needs)
    made = _synthetic(pool, pool, [(str(c), n, need) for c, n, need in needs], [k], f"smote{seed}")
    return _numbered(made)


def smote(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    return _base(rows).unionByName(smote_rows(rows, k, seed))


def _foreign_neighbours(rows: DataFrame, needs, k: int) -> DataFrame:
    """For each row of a class to grow: how many of its k neighbours are of another class."""
    wanted = [label for label, _, _ in needs]
    own = rows.where(F.col("label").isin(wanted))
    near = nearest_lists(rows, k, queries=own, carry=["label"])
    foreign = F.size(F.filter("found", lambda f: f["nn_label"] != F.col("label")))
    return near.join(own.select("id", "label"), "id").select("id", "label", foreign.cast("long").alias("foreign"))


def adasyn_rows(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Synthetic rows, more of them around rows with many neighbours of other classes."""
    rows = _base(rows)
    needs = _needs(rows)
    if not needs:
        return rows.limit(0)
    k = k or default_neighbours(rows)
    share = stage(_foreign_neighbours(rows, needs, k).withColumn("r", F.col("foreign") / F.lit(float(k))), "share")
    need = rows.sparkSession.createDataFrame([(c, m) for c, _, m in needs], "label int, need long")
    totals = share.groupBy("label").agg(F.sum("r").alias("total"))
    if totals.where(F.col("total") == 0).limit(1).count():
        raise ValueError("a class has no neighbours of another class; nothing to adapt to")
    per_row = (
        share.join(pin_small(totals), "label")
        .join(need, "label")
        .withColumn("make", F.bround(F.col("r") / F.col("total") * F.col("need"), 0).cast("long"))
        .select(F.col("label").cast("string").alias("grp"), F.col("id").alias("base_id"), "make")
    )
    pool = _grouped(rows, needs)
    lists = nearest_lists(pool, k, scope="grp", carry=["x"]).withColumnRenamed("scope", "grp")
    # Vectors are attached before rows repeat, so a row drawn very often joins only once.
    ends = per_row.join(lists.withColumnRenamed("id", "base_id"), ["grp", "base_id"]).join(
        pool.withColumnRenamed("id", "base_id"), ["grp", "base_id"]
    )
    placed = running_totals(ends, ["base_id"], {"make": "upto"})
    b, j = F.col("base_id"), F.col("j")
    return (
        repeat_rows(placed, "make", "j")
        .withColumn("rank", (F.floor(hash_unit(f"ada{seed}n", b, j) * k) + 1).cast("int"))
        .select(
            (-1 - (F.col("upto") - F.col("make") + j)).alias("id"),
            F.col("grp").cast("int").alias("label"),
            _between(hash_unit(f"ada{seed}g", b, j)).alias("x"),
        )
    )


def adasyn(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    return _base(rows).unionByName(adasyn_rows(rows, k, seed))


def danger_rows(rows: DataFrame, m: int = DANGER_NEIGHBOURS) -> DataFrame:
    """Rows of smaller classes with at least half, but not all, of ``m`` neighbours of other classes."""
    rows = _base(rows)
    foreign = _foreign_neighbours(rows, _needs(rows), m)
    return foreign.where((F.col("foreign") >= m / 2) & (F.col("foreign") < m))


def borderline_rows(rows: DataFrame, k: int | None = None, m: int = DANGER_NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Synthetic rows seeded only by rows in danger; a class without such rows gets none."""
    rows = _base(rows)
    k = k or default_neighbours(rows)
    danger = stage(danger_rows(rows, m), "danger")
    found = {r["label"]: r["n"] for r in class_counts(danger).collect()}
    needs = [(c, found[c], need) for c, _, need in _needs(rows) if c in found]
    if not needs:
        return rows.limit(0)
    pool = _grouped(rows, needs)
    bases = pool.join(danger.select("id"), "id", "left_semi")
    made = _synthetic(bases, pool, [(str(c), n, need) for c, n, need in needs], [k], f"border{seed}")
    return _numbered(made)


def borderline(rows: DataFrame, k: int | None = None, m: int = DANGER_NEIGHBOURS, seed: int = 42) -> DataFrame:
    return _base(rows).unionByName(borderline_rows(rows, k, m, seed))


def tomek_links(rows: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: mutual nearest neighbours of different classes.

    A mutual pair is named by both its members, so it is an unordered pair seen twice: one
    grouping by pair, no join on a neighbour that very many rows may share.
    """
    rows = _base(rows)
    near = nearest(rows, 1, carry=["label"])
    mine = F.col("id") < F.col("nn_id")
    return (
        near.groupBy(F.least("id", "nn_id").alias("id_a"), F.greatest("id", "nn_id").alias("id_b"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(~mine, F.col("nn_label"))).alias("label_a"),
            F.max(F.when(mine, F.col("nn_label"))).alias("label_b"),
        )
        .where((F.col("n") == 2) & (F.col("label_a") != F.col("label_b")))
        .select("id_a", "id_b", "label_a", "label_b")
    )


def smallest_class(rows: DataFrame):
    """Label of the class with fewest rows; of equal ones the smallest label."""
    return class_counts(rows).orderBy("n", "label").first()["label"]


def remove_tomek(rows: DataFrame, spared=None) -> DataFrame:
    """Drop the members of Tomek links that are not of the class to spare, by default the smallest."""
    rows = _base(rows)
    spared = smallest_class(rows) if spared is None else spared
    links = stage(tomek_links(rows), "links")
    ends = links.select(F.col("id_a").alias("id"), F.col("label_a").alias("l")).unionByName(
        links.select(F.col("id_b").alias("id"), F.col("label_b").alias("l"))
    )
    return rows.join(ends.where(F.col("l") != spared).select("id"), "id", "left_anti")


def smote_tomek(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Oversample, then clean the border at the cost of the classes that were not the smallest before."""
    return remove_tomek(stage(smote(rows, k, seed), "smote"), smallest_class(_base(rows)))


def oversample(rows: DataFrame, method: str, k: int | None = None, seed: int = 42) -> DataFrame:
    found = {"SMOTE": smote, "ADASYN": adasyn, "SMOTE+TOMEK": smote_tomek, "Borderline-SMOTE": borderline}
    if method not in found:
        raise ValueError(f"unknown method {method}; choose from {METHODS}")
    return found[method](rows, k, seed=seed)


def balance(rows: DataFrame, method: str = "SMOTE", gate: float = RATIO_GATE, seed: int = 42) -> DataFrame:
    """Oversample only if the imbalance ratio is above the gate."""
    if not imbalance(rows, gate=gate).first()["act"]:
        return _base(rows)
    return oversample(rows, method, seed=seed)


def split_and_rescue(rows: DataFrame, below: int = RESCUE_BELOW, seed: int = 42) -> DataFrame:
    """Stratified split; a training class below the limit is oversampled in the training part only."""
    parts = stage(stratified_split(_base(rows), seed=seed), "split")
    train = parts.where(~F.col("is_test")).drop("is_test")
    least = class_counts(train).agg(F.min("n")).first()[0]
    if least is not None and least < below:
        # A class of one row cannot be oversampled: an error, as everywhere else.
        train = smote(train, default_neighbours(train, RESCUE_NEIGHBOURS), seed)
    return train.withColumn("is_test", F.lit(False)).unionByName(
        parts.where("is_test").select("id", "label", "x", "is_test")
    )


def change_report(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Counts per class before and after, with the change in percent."""
    old = class_counts(before, label).withColumnRenamed("n", "before")
    new = class_counts(after, label).withColumnRenamed("n", "after")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return old.join(new, label, "full").select(
        label,
        zero("before").alias("before"),
        zero("after").alias("after"),
        (F.try_divide((zero("after") - zero("before")).cast("double"), zero("before").cast("double")) * 100).alias("change_percent"),
    )


def choose_neighbours(
    rows: DataFrame, metric: str = "silhouette", folds: int = 3, most: int = MAX_TESTED_NEIGHBOURS, seed: int = 42
) -> DataFrame:
    """Scores of SMOTE for k = 3..most over cross-validation folds; ``best`` marks the chosen k.

    All folds and all k run in the same jobs: a fold's neighbours are searched once for the
    largest k, and every (fold, k) table is a scope of one silhouette or scatter computation. Most rows lie in many of
    these tables: each is kept once with the list of them.
    """
    rows = _base(rows)
    counts = pin_small(class_counts(rows))
    most = min(most, counts.agg(F.min("n")).first()[0] - 1)
    if most < 3:
        raise ValueError("the smallest class is too small to compare neighbour counts")
    folded = stage(stratified_folds(rows, folds, seed=seed), "folds")
    train = folded.select(
        F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("out"), "fold", "id", "label", "x"
    ).where(F.col("fold") != F.col("out"))
    grp = F.concat_ws("/", F.col("out").cast("string"), F.col("label").cast("string"))
    train = stage(train.withColumn("grp", grp).drop("fold"), "train")
    sizes: dict[int, dict[int, int]] = {}
    for r in train.groupBy("out", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r["out"], {})[r["label"]] = r["n"]
    needs = [
        (f"{f}/{c}", n, max(by.values()) - n) for f, by in sorted(sizes.items()) for c, n in sorted(by.items()) if n < max(by.values())
    ]
    ks = list(range(3, min(most, min(n for _, n, _ in needs) - 1) + 1))
    pool = train.where(F.col("grp").isin([g for g, _, _ in needs])).select("grp", "id", "x")
    made = _synthetic(pool, pool, needs, ks, f"smote{seed}")
    every_scope = F.array(*[F.lit(f"{f}/{k}") for f in range(folds) for k in ks])
    out = lambda s: F.substring_index(s, "/", 1)
    every = stage(
        folded.select(
            F.filter(every_scope, lambda s: out(s) != F.col("fold").cast("string")).alias("scopes"), "label", "x"
        ).unionByName(
            made.select(
                F.transform("ks", lambda k: F.concat_ws("/", out("grp"), k.cast("string"))).alias("scopes"),
                F.substring_index("grp", "/", -1).cast("int").alias("label"),
                "x",
            )
        ),
        "tested",
    )
    tables = every.select(F.explode("scopes").alias("scope"), "label", "x")
    scores = silhouette(every, "scopes").join(davies_bouldin(tables, "scope"), "scope")
    k = F.substring_index("scope", "/", -1).cast("int").alias("k")
    means = scores.groupBy(k).agg(
        F.avg("silhouette").alias("silhouette"), F.avg("davies_bouldin").alias("davies_bouldin")
    )
    return _mark_best(pin_small(means), metric)


def _mark_best(means: DataFrame, metric: str) -> DataFrame:
    e = means.agg(
        F.struct(
            F.min("silhouette").alias("s0"), F.max("silhouette").alias("s1"),
            F.min("davies_bouldin").alias("d0"), F.max("davies_bouldin").alias("d1"),
        )
    ).scalar()
    norm_s = F.try_divide(F.col("silhouette") - e["s0"], e["s1"] - e["s0"])
    norm_d = 1 - F.try_divide(F.col("davies_bouldin") - e["d0"], e["d1"] - e["d0"])
    score = {
        "silhouette": F.col("silhouette"),
        "davies_bouldin": -F.col("davies_bouldin"),
        "both": 0.6 * norm_s + 0.4 * norm_d,
    }[metric]
    scored = means.withColumn("score", score)
    best = scored.agg(F.max_by("k", F.struct(F.col("score"), -F.col("k")))).scalar()
    return scored.withColumn("best", F.col("k") == best)


def _shared_rows(tables: DataFrame) -> DataFrame:
    """``scopes, id, label, x``: rows of many tables (``scope``), each once with the tables that have it."""
    keys = ["id", "label", "x"]
    # One shuffle serves both groupings. A row that a table has ``n`` times is ``n`` rows.
    counted = tables.repartition(*keys).groupBy(*keys, "scope").agg(F.count(F.lit(1)).alias("n"))
    shared = counted.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("scope")).alias("scopes"))
    return shared.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("scopes", *keys)


def compare_methods(
    rows: DataFrame, seeds: list[int] = COMPARED_SEEDS, methods: list[str] = METHODS, share_seed: int = 42
) -> DataFrame:
    """Each method over several seeds: ``method, metric, avg, std, n, error`` (population deviation).

    A stratified part of the rows is held out; the rest is oversampled by every method and seed. All
    resulting tables are scopes of one table, in which a row that several of them have is kept once with the list of these, and every
    metric is computed for all of them in the same jobs: the eight quality metrics against the rows before, the accuracy on the held-out part of the margin
    fitted to each table (``val_acc``), and the seconds that oversampling took (``time``). The seeds of a
    method run side by side and methods one after the other, so the seconds of all methods are taken under the same
    load. A method that fails for a seed loses that seed; one that fails for all has a row with its error instead.
    """
    parts = stage(stratified_split(_base(rows), seed=share_seed), "parts")
    train, held = parts.where(~F.col("is_test")).drop("is_test"), parts.where("is_test").drop("is_test")
    spark = rows.sparkSession
    made, taken, failed = [], [], {}

    def table(method: str, seed: int):
        begin = time.perf_counter()
        try:
            one = stage(oversample(train, method, seed=seed), "method")
        except (ValueError, PySparkException) as e:
            return None, str(e)
        return one, time.perf_counter() - begin

    with ThreadPoolExecutor(max(1, min(len(seeds), SIDE_BY_SIDE))) as pool:
        for method in methods:
            for seed, (one, found) in zip(seeds, pool.map(lambda seed: table(method, seed), seeds)):
                if one is None:
                    failed[method] = found
                    continue
                scope = f"{method}/{seed}"
                taken.append((scope, found))
                made.append(one.select(F.lit(scope).alias("scope"), "id", "label", "x"))
    error_rows = spark.createDataFrame(
        [(m, "error", None, None, 0, e) for m, e in failed.items()],
        "method string, metric string, avg double, std double, n long, error string",
    )
    if not made:
        return error_rows
    shared = stage(_shared_rows(reduce(DataFrame.unionByName, made)), "compared")
    tables = shared.select(F.explode("scopes").alias("scope"), "id", "label", "x")
    counts = tables.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("n"))
    weights = margin.fit(tables)
    judged = margin.errors(tables, weights)
    scopes = F.explode(F.array(*[F.lit(scope) for scope, _ in taken])).alias("scope")
    told = margin.errors(held.select(scopes, "label", "x"), weights)
    wide = (
        nearest(shared, 1, scope="scopes")
        .groupBy("scope")
        .agg(F.avg("dist").alias("avg_neighbor_distance"), F.stddev_pop("dist").alias("neighbor_std"))
        .join(
            judged.select(
                "scope",
                F.col("wrong").cast("double").alias("boundary_violations"),
                (F.col("wrong") / F.col("n")).alias("boundary_violation_rate"),
            ),
            "scope",
        )
        .join(divergence(train, tables, "scope"), "scope")
        .join(silhouette(shared, "scopes").withColumnRenamed("silhouette", "silhouette_score"), "scope")
        .join(counts.groupBy("scope").agg((F.max("n") / F.min("n")).alias("new_imbalance_ratio")), "scope")
        .join(correlation_difference(train, tables, "scope"), "scope")
        .join(told.select("scope", (1 - F.col("wrong") / F.col("n")).alias("val_acc")), "scope")
        .join(spark.createDataFrame(taken, "scope string, time double"), "scope")
    )
    names = [c for c in wide.columns if c != "scope"]
    tall = wide.unpivot(["scope"], names, "metric", "value")
    found = tall.groupBy(F.substring_index("scope", "/", 1).alias("method"), "metric").agg(
        F.avg("value").alias("avg"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")
    )
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(error_rows)


def comparison_summary(compared: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """What ``significance`` reads: the compared metrics with the methods' order."""
    order = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    return compared.where("error IS NULL").select("method", order.alias("ord"), "metric", "avg", "std")


def comparison_results(compared: DataFrame) -> DataFrame:
    """What ``select_method`` reads: a row per method with its metrics and its error, if any."""
    found = [F.max(F.when(F.col("metric") == m, F.col("avg"))).alias(m) for m in SELECT_WEIGHTS]
    return compared.groupBy("method").agg(*found, F.max("error").alias("error"))


def t_test_p(mean1: Column, std1: Column, mean2: Column, std2: Column, n: int) -> Column:
    """Two-sided p of a pooled t-test from summaries with ``n`` observations each.

    Both samples have the same size, so the degrees of freedom are even and Student's
    distribution has a finite series.
    """
    df = 2 * n - 2
    pooled = (std1 * std1 + std2 * std2) / 2
    t = (mean1 - mean2) / F.sqrt(pooled * (2.0 / n))
    cos2 = F.lit(float(df)) / (F.lit(float(df)) + t * t)
    sin = F.abs(t) / F.sqrt(F.lit(float(df)) + t * t)
    series, factor = F.lit(1.0), 1.0
    for i in range(1, df // 2):
        factor *= (2 * i - 1) / (2 * i)
        series = series + F.lit(factor) * F.pow(cos2, F.lit(i))
    return F.greatest(F.lit(0.0), F.lit(1.0) - sin * series)


def significance(summary: DataFrame, n: int = 5, alpha: float = 0.05, floor: float = 0.01) -> DataFrame:
    """Every method against the first one per metric, with Benjamini-Hochberg adjustment.

    ``summary`` has ``method, ord, metric, avg, std``: one row per method and metric, so a
    window group holds one row per method.
    """
    valid = summary.where(F.col("avg").isNotNull() & ~F.isnan("avg")).withColumn(
        "std", F.greatest(F.coalesce("std", F.lit(0.1)), F.lit(floor))
    )
    first = valid.groupBy("metric").agg(F.min_by(F.struct("method", "avg", "std"), "ord").alias("base"))
    tests = valid.join(first, "metric").where(F.col("method") != F.col("base.method")).select(
        "method",
        "metric",
        F.col("base.method").alias("baseline"),
        t_test_p(F.col("base.avg"), F.col("base.std"), F.col("avg"), F.col("std"), n).alias("p_value"),
    )
    by_metric = Window.partitionBy("metric")
    ranked = tests.withColumn("i", F.row_number().over(by_metric.orderBy("p_value", "method"))).withColumn(
        "m", F.count(F.lit(1)).over(by_metric)
    )
    upward = by_metric.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("i")).over(upward))
    return ranked.withColumn("adj_p_value", adjusted).select(
        "method", "metric", "baseline", "p_value", "adj_p_value", (F.col("adj_p_value") <= alpha).alias("significant")
    )


# Weights of the selection score and the accuracy a method must reach.
SELECT_WEIGHTS = {
    "val_acc": 0.5,
    "boundary_violation_rate": -0.3,
    "silhouette_score": 0.15,
    "feature_correlation_diff": -0.05,
}
MIN_ACCURACY = 0.7


def select_method(
    results: DataFrame, weights: dict[str, float] = SELECT_WEIGHTS, min_accuracy: float = MIN_ACCURACY
) -> DataFrame:
    """Weighted score per method; ``selected`` marks the best, ``filtered`` those not considered.

    ``results`` has ``method``, one column per metric and optionally ``error``.
    """
    ok = (F.col("val_acc") >= min_accuracy)
    if "error" in results.columns:
        ok = ok & F.col("error").isNull()
    valid = results.where(ok)
    stats = valid.agg(
        F.struct(
            *[
                F.struct(F.min(_real(m)).alias("lo"), F.max(_real(m)).alias("hi"), F.avg(_real(m)).alias("mean")).alias(m)
                for m in weights
            ]
        )
    ).scalar()
    score = F.lit(0.0)
    for metric, weight in weights.items():
        s = stats[metric]
        norm = (F.coalesce(_real(metric), s["mean"]) - s["lo"]) / (s["hi"] - s["lo"] + 1e-10)
        score = score + (norm if weight > 0 else 1 - norm) * abs(weight)
    scored = valid.withColumn("total_score", score).select("method", "total_score")
    best = scored.agg(F.max_by("method", "total_score")).scalar()
    dropped = results.select("method").exceptAll(scored.select("method")).withColumn(
        "total_score", F.lit(None).cast("double")
    )
    return (
        scored.withColumn("filtered", F.lit(False))
        .unionByName(dropped.withColumn("filtered", F.lit(True)))
        .withColumn("selected", F.coalesce(F.col("method") == best, F.lit(False)))
    )


def _real(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))
