"""Detector evaluation. Scored rows hold ``label`` and ``prob`` (probability of class 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import running_totals

# The threshold grids, as hundredths and tenths so that they are exact.
SEARCH_GRID = [i / 100 for i in range(10, 90, 5)]
TABLE_GRID = [i / 10 for i in range(1, 10)]
FALSE_NEGATIVE_COST = 2.0


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return rows.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _f(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return _ratio((1 + b) * precision * recall, b * precision + recall)


def performance(rows: DataFrame) -> DataFrame:
    """Accuracy, per-class and weighted precision/recall/F1, and the four rates."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    per_class = confusion(rows).select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tn, tn + fn).alias("precision_normal"),
        _ratio(tn, tn + fp).alias("recall_normal"),
        (tn + fp).alias("support_normal"),
        _ratio(tp, tp + fp).alias("precision_attack"),
        _ratio(tp, tp + fn).alias("recall_attack"),
        (tp + fn).alias("support_attack"),
    )
    c = F.col
    with_f = per_class.select(
        "*",
        _f(c("precision_normal"), c("recall_normal")).alias("f1_normal"),
        _f(c("precision_attack"), c("recall_attack")).alias("f1_attack"),
    )

    def weighted(name: str) -> Column:
        both = c(f"{name}_normal") * c("support_normal") + c(f"{name}_attack") * c("support_attack")
        return _ratio(both, c("support_normal") + c("support_attack"))

    return with_f.select(
        "*",
        *[weighted(m).alias(f"{m}_avg") for m in ("precision", "recall", "f1")],
        _ratio(tn, tn + fp).alias("true_negative_rate"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
        _ratio(tp, tp + fn).alias("true_positive_rate"),
        _ratio(fn, fn + tp).alias("false_negative_rate"),
    )


def advice(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn(
        "quality",
        F.when(F.col("recall_attack") < 0.1, "critical")
        .when(F.col("accuracy") < 0.7, "low")
        .otherwise("acceptable"),
    )


def classification_report(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """One row per class, then accuracy, macro and weighted averages. Any number of classes.

    Rows are first counted per (label, prediction); everything after works on that table.
    """
    cells = rows.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    per = per.select(
        F.col("cls").cast("string").alias("row"),
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        "support",
        "hits",
    ).withColumn("f1", _f(F.col("precision"), F.col("recall")))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = per.agg(
        total.alias("support"),
        _ratio(F.sum("hits"), total).alias("acc"),
        *[F.avg(m).alias(f"m_{m}") for m in names],
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"w_{m}") for m in names],
    )

    def line(name: str, cols: list[str]):
        return F.struct(
            F.lit(name).alias("row"), *[F.col(c).alias(m) for c, m in zip(cols, names)], F.col("support").alias("support")
        )

    extra = summary.select(
        F.explode(
            F.array(
                line("accuracy", ["acc"] * 3),
                line("macro avg", [f"m_{m}" for m in names]),
                line("weighted avg", [f"w_{m}" for m in names]),
            )
        ).alias("l")
    ).select("l.*")
    return per.select("row", *names, "support").unionByName(extra)


def security_metrics(rows: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    base = confusion(rows).select(
        "*", _ratio(tp, tp + fn).alias("recall"), _ratio(tp, tp + fp).alias("precision")
    )
    return base.select(
        "*",
        _f(F.col("precision"), F.col("recall"), 2.0).alias("f2_score"),
        F.try_divide(tp.cast("double"), (tp + fn).cast("double")).alias("attack_detection_rate"),
        F.try_divide(fp.cast("double"), (fp + tn).cast("double")).alias("false_alarm_rate"),
    )


def score_counts(rows: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score; equal scores collapse before any shuffle."""
    return rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def roc_auc(rows: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Area under the ROC curve; ties count half. NULL with one class only."""
    upto = running_totals(score_counts(rows, score, label), ["score"], {"neg": "neg_upto"})
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return upto.agg(
        F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")
    )


def average_precision(rows: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Step-wise sum of precision over the recall gained at each distinct score, from the top."""
    counts = score_counts(rows, score, label).withColumn("down", -F.col("score"))
    upto = running_totals(counts, ["down"], {"pos": "tp", "neg": "fp"})
    gained = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return upto.agg(F.try_divide(gained, F.sum("pos").cast("double")).alias("average_precision"))


def roc_auc_by_class(rows: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """One-vs-rest AUC per class and their macro mean, all classes in one pass."""
    each = rows.select(F.col(label).alias("y"), F.posexplode(probs).alias("cls", "score"))
    counts = each.groupBy("cls", "score").agg(
        F.count_if(F.col("y") == F.col("cls")).alias("pos"), F.count_if(F.col("y") != F.col("cls")).alias("neg")
    )
    upto = running_totals(counts, ["score"], {"neg": "neg_upto"}, by=["cls"])
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    per = upto.groupBy("cls").agg(
        F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")
    )
    macro = F.explode(F.array(F.col("cls").cast("string"), F.lit("macro")))
    return per.select(macro.alias("cls"), "auc").groupBy("cls").agg(F.avg("auc").alias("auc"))


def _grid_counts(rows: DataFrame, grid: list[float], reached) -> DataFrame:
    """Confusion counts per threshold: each row is placed once on the grid, then cells are summed."""
    position = sum((reached(F.col("prob"), F.lit(t)).cast("int") for t in grid[1:]), reached(F.col("prob"), F.lit(grid[0])).cast("int"))
    cells = rows.groupBy(position.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")
    )
    spread = cells.select(
        "p",
        "n",
        F.posexplode(F.transform(F.array(*[F.lit(t) for t in grid]), lambda t, i: F.struct(t.alias("threshold"), (F.col("reached") > i).alias("hit")))).alias("i", "g"),
    )
    hit = F.col("g.hit")
    return spread.groupBy(F.col("g.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("tn"),
    )


def threshold_search(rows: DataFrame, metric: str = "f2", grid: list[float] = SEARCH_GRID) -> DataFrame:
    """Threshold with the best score, ``prob >= t``, the lowest on ties; 0.5 and 0 if none scores."""
    counts = _grid_counts(rows, grid, lambda p, t: p >= t)
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    scores = {
        "f2": _ratio(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")),
        "recall": recall,
        "precision": precision,
    }
    scored = counts.withColumn("score", scores[metric])
    best = F.max_by(F.col("threshold"), F.struct(F.col("score"), -F.col("threshold")))
    return scored.agg(best.alias("t"), F.max("score").alias("s")).select(
        F.when(F.col("s") > 0, F.col("t")).otherwise(F.lit(0.5)).alias("threshold"),
        F.coalesce("s", F.lit(0.0)).alias("score"),
    )


def threshold_table(rows: DataFrame, grid: list[float] = TABLE_GRID) -> DataFrame:
    """Accuracy, recalls and F1 per threshold, ``prob > t``; constant predictions score F1 0."""
    c = _grid_counts(rows, grid, lambda p, t: p > t)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    all_normal, all_attack = (tp + fp) == 0, (tn + fn) == 0
    constant = all_normal | all_attack
    return c.select(
        "threshold",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.when(constant, all_normal.cast("double")).otherwise(_ratio(tn, tn + fp)).alias("normal_recall"),
        F.when(constant, all_attack.cast("double")).otherwise(_ratio(tp, tp + fn)).alias("attack_recall"),
        F.when(constant, 0.0).otherwise(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
    )


def best_threshold(table: DataFrame) -> DataFrame:
    best = F.max_by(F.struct(*table.columns), F.struct(F.col("f1_score"), -F.col("threshold")))
    return table.agg(best.alias("b")).select("b.*")


def confidence(rows: DataFrame) -> DataFrame:
    conf = F.greatest(F.col("prob"), 1 - F.col("prob"))
    n = F.count(F.lit(1))
    stats = rows.select(conf.alias("c")).agg(
        F.avg("c").alias("mean"),
        F.stddev_pop("c").alias("std"),
        F.min("c").alias("min"),
        F.max("c").alias("max"),
        F.count_if(F.col("c") > 0.9).alias("high"),
        F.count_if(F.col("c").between(0.7, 0.9)).alias("medium"),
        F.count_if(F.col("c") < 0.7).alias("low"),
        n.alias("n"),
    )
    return stats.select("*", *[(F.col(b) * 100 / F.col("n")).alias(f"{b}_percent") for b in ("high", "medium", "low")])


def security_loss(rows: DataFrame, weights: list[float], cost: float = FALSE_NEGATIVE_COST) -> DataFrame:
    """Mean class-weighted cross-entropy of ``logits``; missed attacks cost more."""
    z = F.col("logits")
    top = F.array_max(z)
    log_sum = top + F.ln(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("label") + 1)
    entropy = weight * (log_sum - F.element_at(z, F.col("label") + 1))
    missed = (F.col("label") == 1) & (F.array_position(z, top) == 1)
    return rows.agg(F.avg(entropy * F.when(missed, F.lit(cost)).otherwise(F.lit(1.0))).alias("loss"))
