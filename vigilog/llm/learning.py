"""Labelled rows for the classifiers: a bounded, repeatable sample, and joint figures."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents to learn from, chosen by id hash.

    A null label or id is no label; an id that is labelled twice counts once, with the larger
    label. The bound makes the result small enough to broadcast and to fit a model on.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                                x.T @ (y - p) - penalty @ w)
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
