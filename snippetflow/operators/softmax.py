"""Epoch-wise training of a linear classifier with validation after each epoch.

Full-batch softmax regression: in each epoch every partition of the training rows sums its
gradient into one array of fixed size (classes x features), the arrays are added up in a
tree (square root of the partitions in between), and the driver, which holds the weights alone,
takes one step.  Weights of every epoch are kept; the earliest epoch
with the best validation macro-F1 is the model.  The training rows are narrow (label, weight,
feature array) and are written once before the first epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetflow.operators import labels as L
from snippetflow.operators import metrics as M
from snippetflow.operators.ensemble import best_candidate
from snippetflow.session import cut_lineage

WEIGHT_SCHEMA = "epoch int, label int, feature int, weight double"


@dataclass
class SoftmaxTraining:
    weights: DataFrame      # (epoch, label, feature, weight); feature -1 is the bias
    epochs: DataFrame       # (epoch, train_loss, val_macro_f1, val_accuracy)
    best: DataFrame         # the chosen row of epochs
    labels: list
    model: np.ndarray       # classes x (features + 1) of the best epoch


def gradient(rows: DataFrame, weights: np.ndarray, labels: list) -> tuple[np.ndarray, float, float]:
    """(sum of weighted gradients, weighted loss, sum of weights) of rows (label, weight, features)."""
    classes, width = np.array(labels), weights.shape[1]

    def add(batches):
        total = np.zeros(weights.size + 2)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            y, w = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = np.ones((n, width))
            x[:, :-1] = b.column(2).flatten().to_numpy().reshape(n, width - 1)
            z = x @ weights.T
            z -= z.max(axis=1, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            hot = (y[:, None] == classes).astype(float)
            total[:-2] += ((np.exp(log_p) - hot) * w[:, None]).T.dot(x).ravel()
            total[-2] -= float((log_p * hot).sum(axis=1) @ w)
            total[-1] += float(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    def merge(batches):
        total = None
        for b in batches:
            for g in b.column(0):
                g = np.array(g.as_py())
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = rows.select("label", "weight", "features").mapInArrow(add, "g array<double>")
    middle = max(1, int(np.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    got = [np.array(r.g) for r in parts.repartition(middle).mapInArrow(merge, "g array<double>").collect()]      # at most ``middle`` arrays
    total = np.sum(got, axis=0) if got else np.zeros(weights.size + 2)
    return total[:-2].reshape(weights.shape), float(total[-2]), float(total[-1])


def predicted(weights: np.ndarray, labels: list, features: str = "features") -> Column:
    """The label of the highest score, the lowest label among equal ones (``labels`` ascend)."""
    def score(w):
        products = F.zip_with(features, F.array(*[F.lit(float(x)) for x in w[:-1]]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(float(w[-1])), lambda a, b: a + b)
    scores = F.array(*[score(w) for w in weights])
    return F.element_at(F.array(*[F.lit(int(x)) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


def _rows(df: DataFrame, features: list, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("features"))


def train_softmax(train: DataFrame, val: DataFrame, features: list, label: str = "label", epochs: int = 4, learning_rate: float = 1.0,
                  l2: float = 0.0, class_weighted: bool = True, path: str | None = None) -> SoftmaxTraining:
    """Weights start at zero; each epoch takes one step of ``learning_rate`` along the mean
    weighted gradient plus ``l2`` times the weights (not the biases).  Rows without a label do not train; a null feature
    counts as 0.  ``path``: a folder where every epoch's weights are kept as a table."""
    spark = train.sparkSession
    rows = _rows(train, features, label)
    if class_weighted:
        rows = L.with_class_weight(rows, L.class_weights(rows, "label"), "label", "weight")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = cut_lineage(rows)
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]       # K rows
    if not labels:
        raise ValueError("no labelled training rows")
    w = np.zeros((len(labels), len(features) + 1))
    kept, losses, entries = [], [], []
    for epoch in range(1, epochs + 1):
        g, loss, total = gradient(rows, w, labels)
        reg = l2 * w
        reg[:, -1] = 0
        w = w - learning_rate * (g / total + reg)
        kept.append(w)
        losses.append((epoch, loss / total))
        own = [(epoch, int(k), j if j < len(features) else -1, float(x)) for k, r in zip(labels, w) for j, x in enumerate(r)]
        entries += own
        if path:
            spark.createDataFrame(own, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{epoch}")
    # the validation rows are read once for all epochs
    votes = F.array(*[predicted(x, labels) for x in kept])
    scored = _rows(val, features, label).select("label", F.posexplode(votes).alias("epoch", "predicted_label")).withColumn("epoch", F.col("epoch") + 1)
    table = M.grouped_summary(scored, "epoch").select("epoch", F.col("macro_f1").alias("val_macro_f1"), F.col("accuracy").alias("val_accuracy"))
    table = cut_lineage(spark.createDataFrame(losses, "epoch int, train_loss double").join(table, "epoch", "left"))
    best = best_candidate(table, "epoch", "val_macro_f1")
    chosen = best.first()
    return SoftmaxTraining(spark.createDataFrame(entries, WEIGHT_SCHEMA), table, best, labels, kept[(chosen.epoch if chosen else epochs) - 1])


def certificate(rows: DataFrame, coefficients: np.ndarray, intercepts: np.ndarray, labels: list, reg_param: float, standardized: bool = True) -> dict:
    """How far a fitted multinomial regression is from the optimum of its own objective: one
    aggregate over the training rows (label, weight, features) gives the gradient of mean weighted loss + reg_param / 2 * |weights|^2
    (weights in units of the features' standard deviations where the fit standardised them).

    ``gradient_norm`` is the largest absolute entry; at the optimum it is 0."""
    w = np.column_stack([coefficients, intercepts])
    g, loss, total = gradient(rows, w, labels)
    scale = np.ones(coefficients.shape[1])
    if standardized:
        # the weighted, unbiased variance that the fit scales by
        means = [F.sum(F.col("weight") * F.col("features")[j]) for j in range(len(scale))]
        squares = [F.sum(F.col("weight") * F.col("features")[j] * F.col("features")[j]) for j in range(len(scale))]
        r = rows.agg(F.sum("weight"), F.count(F.lit(1)), *means, *squares).first()
        s, n = r[0], len(scale)
        scale = np.array([max(0.0, (r[2 + n + j] / s - (r[2 + j] / s) ** 2)) for j in range(n)])
        scale = scale * r[1] / max(1, r[1] - 1)
    grad = g / total
    grad[:, :-1] += reg_param * scale * coefficients
    return {"gradient_norm": float(np.abs(grad).max()), "loss": loss / total, "total_weight": total}
