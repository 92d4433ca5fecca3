"""Affinity, Laplacian, spectral embedding and k-means, on coordinate tables (i, j, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flatspan.functions.vectors import EPS
from flatspan.operators.kmeans import kmeans_labels
from flatspan.operators.krylov import leading_vectors

#: k-means starts.
STARTS = 20


def adjacency(coefficients: DataFrame) -> DataFrame:
    """(i, j, value) from (row_id, col_id, coef): columns of |C| by their maximum, plus the transpose, without a diagonal.

    The machine epsilon that would make every other entry positive is left out: a sparse table has no room for a constant of
    the whole matrix, and a degree would change by 2e-16 a row.
    """
    size = F.abs("coef")
    scaled = coefficients.where("row_id <> col_id and coef <> 0").withColumn("value", size / (F.max(size).over(Window.partitionBy("col_id")) + EPS))
    return symmetric(scaled.select(F.col("row_id").alias("i"), F.col("col_id").alias("j"), "value"))


def symmetric(half: DataFrame) -> DataFrame:
    """A + A'."""
    return half.union(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def plain_affinity(coefficients: DataFrame) -> DataFrame:
    """|R| + |R'| without a diagonal and without scaling."""
    return symmetric(coefficients.where("row_id <> col_id").select(F.col("row_id").alias("i"), F.col("col_id").alias("j"), F.abs("coef").alias("value")))


def degrees(affinity: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree): sums of rows, and epsilon."""
    sums = affinity.groupBy(F.col("i").alias("id")).agg(F.sum("value").alias("sum"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("sum", F.lit(0.0)) + EPS).alias("degree"))


def normalized(affinity: DataFrame, degree: DataFrame) -> DataFrame:
    """(i, j, value) of D^-1/2 W D^-1/2; the Laplacian is the identity less this."""
    di, dj = degree.select(F.col("id").alias("i"), F.col("degree").alias("di")), degree.select(F.col("id").alias("j"), F.col("degree").alias("dj"))
    return affinity.join(di, "i").join(dj, "j").select("i", "j", (F.col("value") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))


def laplacian(affinity: DataFrame, degree: DataFrame) -> DataFrame:
    """Entries of I - D^-1/2 W D^-1/2 that aren't zero."""
    off = normalized(affinity, degree).select("i", "j", (-F.col("value")).alias("value"))
    return off.union(degree.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value")))


def distance(affinity: DataFrame) -> DataFrame:
    """1 - W where W is present; absent pairs, and every row with itself, are at distance 1."""
    return affinity.select("i", "j", (1 - F.col("value")).alias("value"))


def embedding(affinity: DataFrame, ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, vector): the k smallest singular directions of the Laplacian, each row scaled to norm 1."""
    return unit_rows(smallest_directions(affinity, ids, k, seed)[0])


def unit_rows(v: DataFrame) -> DataFrame:
    """(id, vector) with each row scaled to norm 1."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) + EPS
    return v.select("id", F.zip_with("vector", F.array_repeat(norm, F.size("vector")), lambda x, m: x / m).alias("vector"))


def smallest_directions(affinity: DataFrame, ids: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((id, vector), singular values) of the Laplacian: the largest eigenvectors of D^-1/2 W D^-1/2, whose values are at most 1."""
    v, values = leading_vectors(normalized(affinity, degrees(affinity, ids)), ids, k, seed)
    return v, 1 - values


def spectral_labels(affinity: DataFrame, ids: DataFrame, k: int, seed: int = 0, iterations: int = 200, starts: int = STARTS) -> DataFrame:
    return kmeans_labels(embedding(affinity, ids, k, seed), k, seed, iterations, starts)
