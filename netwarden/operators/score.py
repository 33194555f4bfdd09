"""Model scoring and training.

Networks are given as plain weights and run on Arrow batches; the weights travel with the
function, once per Python worker. Training uses Spark's own fitters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.functions.values import softmax
from netwarden.operators.verdict import ATTACK_PROBABILITY, cascade, input_error, reconstruction_error
from netwarden.plans.scale import TASK_ROWS, exact_quantiles

# Hidden layers of the named variants, and members of the ensemble.
VARIANTS = {
    "standard": [512, 256, 128, 64],
    "simple": [64, 32],
    "stabilized": [128, 64, 32],
}
ENSEMBLE_MEMBERS = 3
# Rows below which a training partition is not worth a task of its own.
FIT_ROWS = 1024


@dataclass(frozen=True)
class Dense:
    """One layer: ``activation(x @ weights.T + bias)``."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "linear"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weights.T + self.bias
        if self.activation == "relu":
            return np.maximum(y, 0.0)
        if self.activation == "sigmoid":
            return 1.0 / (1.0 + np.exp(-y))
        return y


def run_layers(layers: list[Dense], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


def network(layers: list[Dense]):
    """Column function ``array -> array``; rows of the wrong length or without a value give NULL."""
    width = layers[0].weights.shape[1]

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        usable = [i for i, v in enumerate(x) if v is not None and len(v) == width]
        if usable:
            scores = run_layers(layers, np.array([x.iloc[i] for i in usable], dtype=float))
            for i, row in zip(usable, scores):
                out.iat[i] = row
        return out

    return forward


def autoencoder(encode_w, encode_b, decode_w, decode_b) -> list[Dense]:
    """Encoder with ReLU, decoder with sigmoid."""
    return [Dense(encode_w, encode_b, "relu"), Dense(decode_w, decode_b, "sigmoid")]


def check_width(layers: list[Dense], features: int) -> None:
    """Refuse a model whose layers do not fit the data or each other."""
    width = features
    for i, layer in enumerate(layers):
        if layer.weights.shape[1] != width:
            raise ValueError(f"layer {i} expects {layer.weights.shape[1]} inputs, got {width}")
        if layer.bias.shape != (layer.weights.shape[0],):
            raise ValueError(f"layer {i} has a bias of the wrong length")
        width = layer.weights.shape[0]


def feature_widths(rows: DataFrame, expected: int, features: str = "x") -> DataFrame:
    """How many rows have each feature count, and whether it is the model's."""
    width = F.size(features).alias("width")
    return rows.groupBy(width).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("width") == expected)


def score(rows: DataFrame, layers: list[Dense], features: str = "x") -> DataFrame:
    """Batch or stream inference: ``logits``, ``probs`` and ``prob`` of class 1."""
    scored = rows.withColumn("logits", network(layers)(F.col(features)))
    return scored.withColumn("probs", softmax(F.col("logits"))).withColumn("prob", F.col("probs")[1])


def reconstruct(rows: DataFrame, layers: list[Dense], features: str = "x") -> DataFrame:
    out = rows.withColumn("xhat", network(layers)(F.col(features)))
    return out.withColumn("mse", reconstruction_error(F.col(features), F.col("xhat")))


def hybrid(rows: DataFrame, classifier: list[Dense], encoder: list[Dense], threshold: float) -> DataFrame:
    """Full cascade. Rows the classifier already decided reach the autoencoder as NULL and cost nothing."""
    width = classifier[0].weights.shape[1]
    scored = score(rows, classifier)
    open_ = input_error(F.col("x"), width).isNull() & (F.col("prob") <= ATTACK_PROBABILITY)
    scored = scored.withColumn("__open", F.when(open_, F.col("x")))
    scored = scored.withColumn("__xhat", network(encoder)(F.col("__open")))
    mse = reconstruction_error(F.col("x"), F.col("__xhat"))
    verdict = cascade(F.col("x"), F.col("prob"), mse, threshold, width)
    return scored.withColumn("mse", mse).withColumn("verdict", verdict).drop("__open", "__xhat")


def calibrate(rows: DataFrame, share: float = 0.95, score_column: str = "mse", label: str = "label") -> DataFrame:
    """Anomaly threshold: a quantile of the scores of normal rows (a choice of this library)."""
    normal = rows.where(F.col(label) == 0)
    return exact_quantiles(normal, score_column, [share]).withColumnRenamed("q_0", "threshold")


def _points(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions of equal size, as many as there are cores if the rows suffice for that.

    A fitter passes over its partitions in every round, and a stored table may lie in very few.
    """
    n = rows.count()
    wanted = max(min(rows.sparkSession.sparkContext.defaultParallelism, n // FIT_ROWS), math.ceil(n / TASK_ROWS))
    return rows.repartition(wanted) if wanted > 1 else rows


def train(
    rows: DataFrame, variant: str = "simple", iterations: int = 60, seed: int = 42
) -> list[MultilayerPerceptronClassificationModel]:
    """Fit a named variant; the ensemble is three simple ones with different seeds."""
    if variant == "ensemble":
        return [m for i in range(ENSEMBLE_MEMBERS) for m in train(rows, "simple", iterations, seed + i)]
    width = len(rows.select("x").first()["x"])
    points = _spread(_points(rows))
    fitter = MultilayerPerceptronClassifier(
        layers=[width, *VARIANTS[variant], 2], maxIter=iterations, seed=seed
    )
    return [fitter.fit(points)]


def predict(models: list[MultilayerPerceptronClassificationModel], rows: DataFrame) -> DataFrame:
    """``id, label, logits, probs, prob, pred``; several models answer with their mean logits."""
    out = _points(rows, "id")
    for i, model in enumerate(models):
        out = (
            model.transform(out)
            .withColumn(f"l{i}", vector_to_array("rawPrediction"))
            .drop("rawPrediction", "probability", "prediction")
        )
    return finish([F.col(f"l{i}") for i in range(len(models))], out)


def mean_logits(members: list[Column]) -> Column:
    """Element-wise mean of equally long arrays."""
    total = members[0]
    for member in members[1:]:
        total = F.zip_with(total, member, lambda a, b: a + b)
    return F.transform(total, lambda v: v / len(members))


def finish(members: list[Column], out: DataFrame) -> DataFrame:
    probs = softmax(F.col("logits"))
    return (
        out.withColumn("logits", mean_logits(members))
        .select("id", F.col("label").cast("int").alias("label"), "logits", probs.alias("probs"))
        .withColumn("prob", F.col("probs")[1])
        .withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    )


def train_weighted(rows: DataFrame, weight: str = "weight", iterations: int = 50):
    """Logistic regression with a weight per row, for class-weighted training."""
    return LogisticRegression(weightCol=weight, maxIter=iterations).fit(_points(rows, weight))
