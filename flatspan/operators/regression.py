"""Linear regression with an ordered weighted L1 penalty, and linear support vector regression.

Both need one or two passes over the rows for sums of model size; what follows is on those sums alone, or, for the
support vectors, one pass an iteration.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import partial
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.frame import width_of
from flatspan.functions.kernels import fista, owl_weights
from flatspan.functions.vectors import dot, literal_vector
from flatspan.params import OwlParams


def means(df: DataFrame, width: int) -> tuple[int, np.ndarray, float]:
    """(rows, feature means, label mean), by built-in aggregates."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"), *[F.avg(F.col("features")[k]).alias(f"x{k}") for k in range(width)]).first()
    return r["n"], np.array([r[f"x{k}"] or 0.0 for k in range(width)]), r["y"] or 0.0


def centred_sums(df: DataFrame, x_mean: np.ndarray, y_mean: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'X, X'y, y'y) of centred rows: summed in each task, then by cell."""
    width = len(x_mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            if len(b):
                z = np.hstack([np.vstack(b["features"].to_list()) - x_mean, b["label"].to_numpy()[:, None] - y_mean])
                total += z.T @ z
        i, j = np.triu_indices(width + 1)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    total = np.zeros((width + 1, width + 1))
    for r in df.select("features", "label").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    return total[:width, :width], total[:width, width], float(total[width, width])


@dataclass
class OwlModel:
    params: OwlParams
    coef: np.ndarray
    intercept: float
    loss_history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """df and ``prediction``: a sum of products in the JVM. A vector of another width is an error."""
        x = F.col("features")
        sound = F.assert_true(F.size(x) == len(self.coef), F.lit(f"features must have {len(self.coef)} numbers"))
        return df.withColumn("prediction", F.when(sound.isNull(), dot(x, literal_vector(self.coef)) + float(self.intercept)))

    def save(self, spark, path: str) -> None:
        row = (self.params.to_json(), self.coef.tolist(), float(self.intercept), list(self.loss_history))
        spark.createDataFrame([row], "params string, coef array<double>, intercept double, loss_history array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> OwlModel:
        r = spark.read.parquet(path).first()
        return OwlModel(OwlParams.from_json(r["params"]), np.array(r["coef"]), r["intercept"], list(r["loss_history"]))


class OwlRegression:
    """Least squares with sorted-L1 weights, by accelerated proximal gradient on the Gram matrix."""

    def __init__(self, **params):
        self.params = OwlParams(**params)

    def fit(self, df: DataFrame, iterations: int | None = None) -> OwlModel:
        """df: features, label. Two passes over the rows in all, whatever the number of steps."""
        if iterations is not None and iterations < 1:
            raise ValueError("iterations must be 1 or more")
        p, width = self.params, width_of(df)
        if p.weight_min_off >= width:
            raise ValueError("weight_min_off must be below the number of features")
        n, x_mean, y_mean = means(df, width)
        if not p.fit_intercept:
            x_mean, y_mean = np.zeros(width), 0.0
        gram, xty, yty = centred_sums(df, x_mean, y_mean)
        scale = np.ones(width)
        if p.fit_intercept and p.normalize:
            scale = np.sqrt(np.diag(gram))
            scale[scale == 0] = 1.0  # a constant column
        gram, xty = gram / np.outer(scale, scale), xty / scale
        weights = owl_weights(width, p.weight_max_val, p.weight_max_off, p.weight_min_val, p.weight_min_off)
        beta, history = fista(gram, xty, yty, n, weights, p.learning_rate, p.tol, iterations or 100_000)
        coef = beta / scale
        return OwlModel(p, coef, float(y_mean - x_mean @ coef) if p.fit_intercept else 0.0, history)


@dataclass
class SvrModel:
    coef: np.ndarray
    intercept: float
    gap: float = float("nan")  # relative duality gap: how far the objective may be above the least one, as a share of it
    passes: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", dot(F.col("features"), literal_vector(self.coef)) + float(self.intercept))


class LinearSVR:
    """Linear regression with the epsilon-insensitive loss: (1/2)|w|^2 + c * sum max(0, |y - f(x)| - epsilon), on standardised columns.

    The loss is smoothed over a band beyond epsilon (``smooth`` label deviations at first), minimised by Newton steps, and the band made four
    times narrower until the duality gap is at most ``tol`` of the objective: a bound on what any other solution could
    gain, so the stop is proven and not a number of steps. A step is two passes over the rows: one sums gradient and Hessian, one
    weighs all step lengths at once; a task sends D x D numbers at most. ``iterations`` bounds the steps, with a warning
    where the gap is open then. Constant columns get weight 0; collinear ones share it.
    """

    def __init__(self, c: float = 1.0, epsilon: float = 0.0, tol: float = 1e-3, iterations: int = 100, smooth: float = 0.25):
        if not (c > 0 and epsilon >= 0 and tol > 0 and iterations >= 1 and smooth > 0):
            raise ValueError("SVR options out of bounds")
        self.c, self.epsilon, self.tol, self.iterations, self.smooth = c, epsilon, tol, iterations, smooth

    def fit(self, df: DataFrame) -> SvrModel:
        width = width_of(df)
        n, x_mean, y_mean = means(df, width)
        gram, _, yty = centred_sums(df, x_mean, y_mean)
        x_scale, y_scale = np.sqrt(np.diag(gram) / n), float(np.sqrt(yty / n)) or 1.0
        x_scale[x_scale == 0] = 1.0
        eps, ridge = self.epsilon / y_scale, np.append(np.full(width, 1 / (self.c * n)), 0.0)  # the objective divided by c * n
        corr = np.zeros((width + 1, width + 1))
        corr[:width, :width], corr[width, width] = gram / np.outer(x_scale, x_scale) / n, 1.0
        inverse = np.linalg.pinv(corr, hermitian=True)
        rows = df.select("features", "label").persist()

        def over(sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            """Means over all rows of what ``sums`` adds up for a batch of standardised rows (with a one) and labels; the last number is a maximum."""

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = None
                for b in batches:
                    if len(b):
                        x = np.column_stack([(np.vstack(b["features"].to_list()) - x_mean) / x_scale, np.ones(len(b))])
                        own = sums(x, (b["label"].to_numpy() - y_mean) / y_scale)
                        total = own if total is None else np.append(total[:-1] + own[:-1], max(total[-1], own[-1]))
                if total is not None:
                    yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": total})

            found = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"), F.max("v").alias("most")).orderBy("i").collect()
            return np.array([r["v"] / n for r in found[:-1]] + [found[-1]["most"]])

        z, band, gap, passes = np.zeros(width + 1), self.smooth, np.inf, 0
        try:
            for _ in range(self.iterations):
                found = over(partial(_newton_sums, z=z, eps=eps, band=band))
                passes += 1
                g = found[: width + 1] + ridge * z
                hessian = found[width + 1 : -1].reshape(width + 1, width + 1) + np.diag(ridge)
                if np.abs(g).max() <= 1e-7:  # this band is done
                    primal, dual = self._bounds(over(partial(_gap_sums, z=z, eps=eps, band=band, shift=inverse @ g)), z, ridge)
                    passes += 1
                    gap = (primal - dual) / primal if primal > 0 else 0.0
                    if gap <= self.tol:
                        break
                    band /= 4
                    continue
                turn = -np.linalg.solve(hessian + 1e-9 * (1 / band) * np.eye(width + 1), g)
                lengths = 0.5 ** np.arange(24)
                points = z + lengths[:, None] * turn
                costs = over(partial(_cost_sums, points=points, eps=eps, band=band))[:-1] + (points**2 @ ridge) / 2
                passes += 1
                z = points[costs.argmin()]
        finally:
            rows.unpersist()
        if not gap <= self.tol:
            warnings.warn(f"SVR: after {self.iterations} steps the duality gap is not proven to be below {self.tol}", stacklevel=2)
        coef = z[:-1] / x_scale * y_scale
        return SvrModel(coef, float(y_mean + z[-1] * y_scale - x_mean @ coef), float(gap), passes)

    @staticmethod
    def _bounds(found: np.ndarray, z: np.ndarray, ridge: np.ndarray) -> tuple[float, float]:
        """(objective, a lower bound on every objective) by a dual point: multipliers scaled into [-1, 1]."""
        loss, with_label, sizes, most = found
        scale = max(1.0, most)
        return loss + float(ridge @ z**2) / 2, -float(ridge @ z**2) / 2 / scale**2 - (with_label + sizes) / scale


def _bent(r: np.ndarray, eps: float, band: float) -> np.ndarray:
    """Slopes of the smoothed loss."""
    return np.sign(r) * np.clip((np.abs(r) - eps) / band, 0, 1)


def _newton_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, eps: float, band: float) -> np.ndarray:
    """Sums of gradient and Hessian of the smoothed loss at z."""
    r = x @ z - y
    inside = x[(np.abs(r) > eps) & (np.abs(r) < eps + band)]
    return np.concatenate([x.T @ _bent(r, eps, band), (inside.T @ inside / band).ravel(), [0.0]])


def _cost_sums(x: np.ndarray, y: np.ndarray, points: np.ndarray, eps: float, band: float) -> np.ndarray:
    """Sums of the smoothed loss at several points."""
    out = []
    for p in points:
        beyond = np.maximum(np.abs(x @ p - y) - eps, 0)
        out.append(np.where(beyond < band, beyond**2 / (2 * band), beyond - band / 2).sum())
    return np.array([*out, 0.0])


def _gap_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, eps: float, band: float, shift: np.ndarray) -> np.ndarray:
    """Sums of the loss itself, of multipliers times labels, of epsilon times their sizes; and the largest multiplier.

    Multipliers are the slopes, moved along the columns so that their means with all columns are what the dual asks.
    """
    r = x @ z - y
    a = _bent(r, eps, band) - x @ shift
    return np.array([np.maximum(np.abs(r) - eps, 0).sum(), a @ y, eps * np.abs(a).sum(), np.abs(a).max()])
