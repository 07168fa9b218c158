"""Linear probes on vertex features, fold by fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .downstream import folds


def softmax_regression(x: np.ndarray, y: np.ndarray, k: int, iters: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    x = np.column_stack((x, np.ones(len(x))))
    w, hot = np.zeros((x.shape[1], k)), np.eye(k)[y]
    for _ in range(iters):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ (p - hot) / len(x) + decay * w)
    return w


def probe(rows: DataFrame, key: str, features: str, label: str, k: int = 10, seed: int = 0) -> DataFrame:
    """(fold, n, accuracy) of a linear classifier with unit-length features; each fold is a task.

    Training sets are gathered in tasks, so this is for labelled samples, not corpora.
    """
    folded = folds(rows.select(key, features, label), key, label, k, seed)
    copies = folded.withColumn("test", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part[features].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        names, y = np.unique(part[label].to_numpy(), return_inverse=True)
        test = (part["fold"] == part["test"]).to_numpy()
        w = softmax_regression(x[~test], y[~test], len(names))
        right = (np.column_stack((x[test], np.ones(test.sum()))) @ w).argmax(axis=1) == y[test]
        return pd.DataFrame({"fold": [int(part["test"].iloc[0])], "n": [int(test.sum())], "accuracy": [float(right.mean()) if test.any() else None]})

    return copies.groupBy("test").applyInPandas(run, "fold int, n long, accuracy double")
