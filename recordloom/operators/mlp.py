"""A 0/1 classifier of one hidden sigmoid layer, trained row by row; folds are trained in parallel.

Row-by-row descent is serial within a fold, so each fold is one task and its rows
must fit there; folds, and several runs, spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Network:
    """Inputs x, hidden h = s(Wx + b), output o = s(uh + c), with s the logistic function."""

    def __init__(self, width: int, hidden: int, seed: int | None = None):
        if seed is None:  # fixed start, to compare implementations
            self.w, self.u = np.full((hidden, width), 0.2, np.float32), np.full(hidden, 0.1, np.float32)
            self.b, self.c = np.full(hidden, 0.3, np.float32), np.float32(0.4)
        else:
            r = np.random.default_rng(seed)
            self.w, self.u = r.uniform(-1, 1, (hidden, width)).astype(np.float32), r.uniform(-1, 1, hidden).astype(np.float32)
            self.b, self.c = r.uniform(-1, 1, hidden).astype(np.float32), np.float32(r.uniform(-1, 1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = 1 / (1 + np.exp(-(x @ self.w.T + self.b)))
        return h, 1 / (1 + np.exp(-(h @ self.u + self.c)))

    def step(self, x: np.ndarray, y: float, rate: float) -> None:
        """The hidden bias' gradient is the output error times u alone, as in the model this follows."""
        h, o = self.forward(x)
        e = np.float32(y - o)
        back = e * self.u
        self.w += rate * np.outer(back * h * (1 - h), x)
        self.b += rate * back
        self.u += rate * e * h
        self.c += np.float32(rate) * e

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float) -> Network:
        for _ in range(epochs):
            for row, label in zip(x, y):
                self.step(row, label, np.float32(rate))
        return self


def fold_predictions(df: DataFrame, key: str, vector: str, label: str, fold: str, k: int, epochs: int = 25, rate: float = 0.1, hidden: int = 60, seed: int | None = 0) -> DataFrame:
    """(key, fold, label, score, predicted) of each row by the network trained on the other folds; of one fold, by its own."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        test_fold = rows["_test"].iloc[0]
        x, y = np.stack(rows["x"]).astype(np.float32), rows["y"].to_numpy(np.float32)
        test = (rows["f"] == test_fold).to_numpy()
        train = ~test if k > 1 else test
        net = Network(x.shape[1], hidden, seed).fit(x[train], y[train], epochs, rate)
        _, o = net.forward(x[test])
        return pd.DataFrame({key: rows[key].to_numpy()[test], "fold": rows["f"].to_numpy()[test], "label": rows["y"].to_numpy()[test], "score": o.astype("float64"), "predicted": (o >= 0.5).astype("int32")})

    each = df.select(F.col(key), F.col(vector).alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_test"))
    kind = dict(df.dtypes)[key]
    return each.groupBy("_test").applyInPandas(one, f"{key} {kind}, fold int, label int, score double, predicted int")
