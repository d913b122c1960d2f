"""Small linear models on the driver, from bounded samples."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import whole_text
from feedloom.operators.ranking import top_per_key


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (the last row is the bias) of one logistic model per column of ``y`` (0 to 1), by accelerated gradient
    descent. Rows of ``x`` have a length of about one."""
    x = np.column_stack((x, np.ones(len(x)))).astype(np.float32)
    weight = np.ones(len(x)) if weight is None else weight
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    # The largest curvature, by power iteration on the weighted second moments.
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        v = x.T @ (weight[:, 0] * (x @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * top * 1.1 + ridge)
    w = ahead = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (weight * (p - y)) + ridge * ahead)
        ahead = (new + k / (k + 3) * (new - w)).astype(np.float32)
        w = new
    return w


def sample_by(docs: DataFrame, label: Column, per_label: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label): the ``per_label`` rows of each label whose ids hash lowest. Only ids are ranked, label by label
    in slices, and texts are fetched by the few ids chosen (``per_label`` times the number of labels)."""
    slim = docs.select(F.col(id_col).alias("id"), label.alias("label")).filter("label is not null and id is not null")
    chosen = top_per_key(slim.withColumn("h", F.xxhash64("id")), ["label"], [F.col("h"), F.col("id")], per_label, ["h"])
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return texts.join(F.broadcast(chosen.select("id", "label").distinct()), "id")


def logistic_newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of one logistic model for ``y`` (0 to 1), by Newton's method: for a few hundred
    columns of very different frequency."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
        bend[np.diag_indices_from(bend)] += ridge
        w = w - np.linalg.solve(bend, slope)
    return w
