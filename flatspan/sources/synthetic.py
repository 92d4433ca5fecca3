"""Synthetic inputs for tests, made by Spark in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def union_of_subspaces(spark: SparkSession, k: int = 5, dim: int = 100, width: int = 1, each: int = 100, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """(id, features, true_label): unit points near k random subspaces; noise is a variance."""
    rng = np.random.RandomState(seed)
    bases = [np.linalg.qr(rng.randn(dim, width))[0] for _ in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                own = np.random.default_rng([seed, int(i)])
                x = bases[i // each] @ own.standard_normal(width) + np.sqrt(noise) * own.standard_normal(dim)
                rows.append((int(i), x / np.linalg.norm(x), int(i // each)))
            yield pd.DataFrame(rows, columns=["id", "features", "true_label"])

    return spark.range(k * each).mapInPandas(run, "id long, features array<double>, true_label int")


def linear_data(spark: SparkSession, n: int = 10, coef: tuple[float, ...] = (1.0, -2.0, 0.5, 3.0, 1.5), seed: int = 0) -> DataFrame:
    """(id, features, label): centred unit columns, labels without noise; small by purpose."""
    x = np.random.RandomState(seed).randn(n, len(coef))
    x -= x.mean(axis=0)
    x /= np.linalg.norm(x, axis=0)
    y = x @ np.array(coef)
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "id long, features array<double>, label double")
