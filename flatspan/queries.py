"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspan.frame import vectors, with_roles
from flatspan.functions.kernels import owl_cost as owl_cost_of
from flatspan.functions.kernels import owl_gradient as owl_gradient_of
from flatspan.functions.kernels import owl_weights, prox_owl
from flatspan.functions.tracking import TrackerOptions, TrackerState
from flatspan.functions.vectors import dot, literal_vector, normalize, norm2, rounded, soft_threshold, step_sigmoid
from flatspan.operators import ksubspaces as ks
from flatspan.operators.keyed_tracking import track_by_key, tracked_stream
from flatspan.operators import regression, sparse_subspace, spectral, tabular, tracking
from flatspan.params import SscAdmmParams
from flatspan.plans import pipelines
from flatspan.runtime import cut_lineage
from flatspan.sources.bundles import read_table
from flatspan.streaming.tracker import TrackerStream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Searches ask for the rows whose id is divisible by 100, against all rows.
ASKED = "id % 100 = 0"
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
BETA = [1.5, -2.0, 3.0, 0.25]
E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
EPS = "2.220446049250313e-16"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, features, label): price in thousands by quantity, discount, tax and line number."""
    t = read_table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", F.col("l_linenumber").alias("line"), F.array(*[F.col(c).cast("double") for c in LINE_FEATURES]).alias("features"), (F.col("l_extendedprice") / 1000).alias("label"))


LINES = "l AS (SELECT l_orderkey, l_linenumber AS line, [l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def row_bases(df: DataFrame, first: int, count: int = 5) -> np.ndarray:
    """count one-dimensional subspaces, spanned by the rows with ids first, first + 1, ..."""
    rows = df.where((F.col("id") >= first) & (F.col("id") < first + count)).orderBy("id").collect()
    return np.array([r["features"] for r in rows])[:, :, None]


def _assign_sql(first: int = 0, name: str = "a") -> str:
    r2 = "list_dot_product(e.x, e.x) - list_dot_product(e.x, u.x) ** 2"
    return (
        f"{name} AS (SELECT id, cluster, residual FROM (SELECT e.id, CAST(u.id - {first} AS INTEGER) AS cluster, sqrt(greatest({r2}, 0.0)) AS residual, "
        f"row_number() OVER (PARTITION BY e.id ORDER BY sqrt(greatest({r2}, 0.0)), u.id) AS k FROM e, e AS u WHERE u.id BETWEEN {first} AND {first + 4}) WHERE k = 1)"
    )


# --- vectors


@query(f"WITH {E}, n AS (SELECT id, x, sqrt(list_dot_product(x, x)) + {EPS} AS n, unnest(generate_series(1, len(x))) AS k FROM e) SELECT id, CAST(k - 1 AS INTEGER) AS pos, {R6.format('x[k] / n')} AS value FROM n")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return df.select("id", F.posexplode(normalize(F.col("features"))).alias("pos", "value")).select("id", "pos", rounded(F.col("value")).alias("value"))


@query(f"WITH {E} SELECT id, CAST(rank AS INTEGER) AS rank, other, {R6.format('score')} AS score FROM (SELECT a.id, b.id AS other, abs(list_dot_product(a.x, b.x)) AS score, row_number() OVER (PARTITION BY a.id ORDER BY abs(list_dot_product(a.x, b.x)) DESC, b.id) AS rank FROM e AS a JOIN e AS b ON a.id <> b.id WHERE a.id % 100 = 0) WHERE rank <= 10")
def gram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_subspace.gram_top(embedded(spark, sf_dir), 10, ASKED).withColumn("score", rounded(F.col("score")))


@query("SELECT l_orderkey, l_linenumber, floor(sign(l_discount - 0.05) * greatest(abs(l_discount - 0.05) - 0.02, 0.0) * 1e6 + 0.5) / 1e6 AS value FROM lineitem")
def soft_threshold_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(soft_threshold(F.col("l_discount") - 0.05, 0.02)).alias("value"))


@query("SELECT event_id, floor(tanh(5.0 * (value / 1000)) * 1e4 + 0.5) / 1e4 AS step FROM events")
def tanh_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", rounded(step_sigmoid(F.col("value") / 1000), 4).alias("step"))


@query(
    f"WITH {E}, u AS (SELECT x AS u FROM e WHERE id = 0), p AS (SELECT e.id, e.x, u.u, unnest(generate_series(1, len(e.x))) AS k FROM e, u), "
    "s AS (SELECT id, k, x[k] AS x, u[k] AS u FROM p WHERE (id + k - 1) % 7 <> 0), w AS (SELECT id, sum(x * u) / sum(u * u) AS w FROM s GROUP BY id) "
    f"SELECT s.id, CAST(count(*) AS INTEGER) AS n_seen, {R6.format('sum(abs(s.x - w.w * s.u))')} AS sparse_l1 FROM s JOIN w ON s.id = w.id GROUP BY s.id"
)
def mask_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with unobserved coordinates against one direction: observed places, and the L1 size of what is left."""
    df = embedded(spark, sf_dir)
    u = literal_vector(row_bases(df, 0, 1)[0, :, 0])
    nan = F.lit(float("nan"))
    holed = df.select("id", F.transform("features", lambda v, k: F.when((F.col("id") + k) % 7 == 0, nan).otherwise(v)).alias("x"))
    seen = F.filter(F.arrays_zip(F.col("x").alias("x"), u.alias("u")), lambda s: ~F.isnan(s["x"]))
    pairs = holed.select("id", seen.alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, s: a + f(s))
    weighed = pairs.withColumn("w", total(lambda s: s["x"] * s["u"]) / total(lambda s: s["u"] * s["u"]))
    return weighed.select("id", F.size("s").alias("n_seen"), rounded(F.aggregate("s", F.lit(0.0), lambda a, s: a + F.abs(s["x"] - F.col("w") * s["u"]))).alias("sparse_l1"))


# --- k-subspaces


@query(f"WITH {E}, {_assign_sql()} SELECT id, cluster FROM a")
def ksub_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return ks.assign(df, row_bases(df, 0)).select("id", "cluster")


@query(f"WITH {E} SELECT e.id, CAST(u.id AS INTEGER) AS cluster, floor(sqrt(greatest(list_dot_product(e.x, e.x) - list_dot_product(e.x, u.x) ** 2, 0.0)) * 1e5 + 0.5) / 1e5 AS residual FROM e, e AS u WHERE u.id BETWEEN 0 AND 4")
def ksub_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    found = F.array(*ks.residual_columns(F.col("features"), row_bases(df, 0)))
    return df.select("id", F.posexplode(found).alias("cluster", "residual")).select("id", "cluster", rounded(F.col("residual"), 5).alias("residual"))


@query(f"WITH {E}, p AS (SELECT label AS cluster, x, unnest(generate_series(1, len(x))) AS i FROM e), q AS (SELECT cluster, x, i, unnest(generate_series(i, len(x))) AS j FROM p) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, {R6.format('sum(x[i] * x[j])')} AS value FROM q GROUP BY ALL")
def ksub_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "embeddings")
    return ks.scatter(vectors(t, "vec_id", "embedding").join(t.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cluster")), "id")).withColumn("value", rounded(F.col("value")))


@query(f"WITH {E}, {_assign_sql()} SELECT cluster, count(*) AS n FROM a GROUP BY cluster")
def ksub_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return ks.assign(df, row_bases(df, 0)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E}, {_assign_sql()} SELECT q.id AS i, a.id AS j, CASE WHEN q.cluster = a.cluster THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM a, a AS q WHERE q.id % 100 = 0")
def ksub_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return ks.label_distance(ks.assign(df, row_bases(df, 0)).select("id", "cluster"), ASKED)


@query()
def ksub_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return ks.KSubspaces(n_clusters=10, dim_subspaces=2).fit(df).transform(df)


#: Squarings of a scatter matrix until nothing but its leading direction is left.
_SQUARINGS = 16


def _leading_sql(labels: str, name: str) -> str:
    """SQL of the projectors on the leading direction of each cluster's scatter: the matrix squared again and again, scaled to trace 1."""
    at = f"{name}_0"
    out = (
        f"{name}_s AS (SELECT a.cluster AS c, e.x, unnest(generate_series(1, len(e.x))) AS i FROM {labels} AS a JOIN e ON e.id = a.id), "
        f"{name}_r AS (SELECT c, i, x, unnest(generate_series(1, len(x))) AS j FROM {name}_s), "
        f"{name}_m AS (SELECT c, i, j, sum(x[i] * x[j]) AS v FROM {name}_r GROUP BY c, i, j), "
        f"{at} AS (SELECT c, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY c) AS v FROM {name}_m)"
    )
    for k in range(_SQUARINGS):
        square = f"SELECT a.c, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} AS a JOIN {name}_{k} AS b ON a.c = b.c AND a.j = b.i GROUP BY a.c, a.i, b.j"
        out += f", {name}_{k + 1} AS MATERIALIZED (SELECT c, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY c) AS v FROM ({square}))"
    return out + f", {name} AS (SELECT c, i, list(v ORDER BY j) AS row FROM {name}_{_SQUARINGS} GROUP BY c, i)"


def _nearest_sql(projectors: str, name: str) -> str:
    """SQL of labels by projectors, the lowest cluster on ties."""
    inside = f"SELECT e.id, p.c, list_dot_product(any_value(e.x), any_value(e.x)) - sum(e.x[p.i] * list_dot_product(e.x, p.row)) AS r2 FROM e, {projectors} AS p GROUP BY e.id, p.c"
    return f"{name} AS (SELECT id, CAST(arg_min(c, (greatest(r2, 0.0), c)) AS INTEGER) AS cluster FROM ({inside}) GROUP BY id)"


@query(f"WITH {E}, {_assign_sql(name='a0')}, {_leading_sql('a0', 'p')}, {_nearest_sql('p', 'a1')}, {_leading_sql('a1', 'q')}, {_nearest_sql('q', 'a2')} SELECT id, cluster FROM a2")
def ksub_fit_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit from fixed lines: two rounds of assignment and leading eigenvectors, then the labels."""
    df = embedded(spark, sf_dir)
    return ks.KSubspaces(init=row_bases(df, 0), n_clusters=5, dim_subspaces=1).fit(df, iterations=2).transform(df)


# --- ensemble

_RUNS = (0, 5, 10, 15)
_COASSOC = f"WITH {E}, " + ", ".join(_assign_sql(f, f"a{f}") for f in _RUNS)
_COASSOC += ", v AS (SELECT q.id AS i, r.id AS j, (" + " + ".join(f"(q{f}.cluster = r{f}.cluster)::INTEGER" for f in _RUNS) + ") / 4.0 AS agree FROM e AS q JOIN e AS r ON q.id % 100 = 0 "
_COASSOC += " ".join(f"JOIN a{f} AS q{f} ON q{f}.id = q.id JOIN a{f} AS r{f} ON r{f}.id = r.id" for f in _RUNS) + "), w AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE agree END::DOUBLE AS value FROM v)"


def fixed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    runs = [ks.assign(df, row_bases(df, f)).select(F.lit(k).alias("run"), "id", "cluster") for k, f in enumerate(_RUNS)]
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return ks.gather_labels(out)


@query(f"{_COASSOC} SELECT i, j, value FROM w WHERE value > 0")
def ensemble_coassoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ks.coassociation(fixed_ensemble(spark, sf_dir), ASKED)


@query(f"{_COASSOC} SELECT i, j, value FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS k FROM w) WHERE k > 300 AND value > 0")
def ensemble_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ks.trimmed_rows(cut_lineage(fixed_ensemble(spark, sf_dir)), 300, ASKED)


_ALL = _COASSOC.replace("q.id % 100 = 0", "true")


@query(
    f"{_ALL}, r AS (SELECT i, j, value FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS k FROM w) WHERE k > 300 AND value > 0) "
    f"SELECT id, {R6.format('sum(v) / 2')} AS degree, count(DISTINCT j) AS n FROM (SELECT i AS id, j, value AS v FROM r UNION ALL SELECT j, i, value FROM r) GROUP BY id"
)
def ensemble_trim_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of the whole affinity after its rows and columns are trimmed."""
    return ks.trimmed_degrees(cut_lineage(fixed_ensemble(spark, sf_dir)), 300).withColumn("degree", rounded(F.col("degree")))


@query()
def eksub_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ks.EnsembleKSubspaces(n_clusters=10, dim_subspaces=2).transform(embedded(spark, sf_dir))


# --- sparse subspace clustering

_FIRST = "f AS (SELECT a.id, arg_max(b.id, (abs(list_dot_product(a.x, b.x)), -b.id)) AS atom FROM e AS a JOIN e AS b ON a.id <> b.id GROUP BY a.id)"
_UNIT = f"n AS (SELECT id, x, list_transform(x, lambda v: v / (sqrt(list_dot_product(x, x)) + {EPS})) AS u FROM e)"
_SECOND = "r AS (SELECT p.id, f.atom AS s1, list_dot_product(p.u, b.u) / list_dot_product(b.u, b.u) AS w, p.u AS u, b.u AS bu FROM n AS p JOIN f ON f.id = p.id JOIN n AS b ON b.id = f.atom), "
_SECOND += "g AS (SELECT r.id, r.s1, arg_max(b.id, (abs(list_dot_product(b.x, r.u) - r.w * list_dot_product(b.x, r.bu)), -b.id)) AS s2 FROM r JOIN n AS b ON b.id <> r.id GROUP BY r.id, r.s1)"
_COEF = "c AS (SELECT g.id, g.s1, g.s2, list_dot_product(a.x, a.x) AS aa, list_dot_product(a.x, b.x) AS ab, list_dot_product(b.x, b.x) AS bb, list_dot_product(a.x, p.x) AS ap, list_dot_product(b.x, p.x) AS bp FROM g JOIN n AS p ON p.id = g.id JOIN n AS a ON a.id = g.s1 JOIN n AS b ON b.id = g.s2), "
_COEF += "k AS (SELECT s1 AS row_id, id AS col_id, (ap * bb - bp * ab) / (aa * bb - ab * ab) AS coef FROM c UNION ALL SELECT s2, id, (bp * aa - ap * ab) / (aa * bb - ab * ab) FROM c)"


@query(f"WITH {E}, {_FIRST} SELECT id, atom FROM f")
def omp_first_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_subspace.omp_coefficients(embedded(spark, sf_dir), 1, 1e-6).select(F.col("col_id").alias("id"), F.col("row_id").alias("atom"))


@query(f"WITH {E}, {_FIRST}, {_UNIT}, {_SECOND} SELECT id, s1 AS atom FROM g UNION ALL SELECT id, s2 FROM g")
def omp_two_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_subspace.omp_coefficients(embedded(spark, sf_dir), 2, 1e-6).select(F.col("col_id").alias("id"), F.col("row_id").alias("atom"))


@query(f"WITH {E}, {_FIRST}, {_UNIT}, {_SECOND}, {_COEF} SELECT i, j, {R6.format('sum(v)')} AS value FROM (SELECT row_id AS i, col_id AS j, abs(coef) AS v FROM k UNION ALL SELECT col_id, row_id, abs(coef) FROM k) GROUP BY i, j")
def omp_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.plain_affinity(sparse_subspace.omp_coefficients(embedded(spark, sf_dir), 2, 1e-6)).withColumn("value", rounded(F.col("value")))


@query(f"WITH {E}, {_FIRST}, {_UNIT}, {_SECOND}, {_COEF} SELECT i, j, {R6.format('1 - sum(v)')} AS value FROM (SELECT row_id AS i, col_id AS j, abs(coef) AS v FROM k UNION ALL SELECT col_id, row_id, abs(coef) FROM k) GROUP BY i, j")
def omp_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.distance(spectral.plain_affinity(sparse_subspace.omp_coefficients(embedded(spark, sf_dir), 2, 1e-6)))
    return found.withColumn("value", rounded(F.col("value")))


_BEST = "m AS (SELECT a.id, max(abs(list_dot_product(a.x, b.x))) AS score FROM e AS a JOIN e AS b ON a.id <> b.id GROUP BY a.id)"
_L1 = "s AS (SELECT id, list_sum(list_transform(x, lambda v: abs(v))) AS n FROM e)"


@query(f"WITH {E}, {_BEST}, {_L1} SELECT {R6.format('(SELECT min(score) FROM m)')} AS lambda, {R6.format('20 / (SELECT max(n) FROM s)')} AS gamma, {R6.format('20 / (SELECT min(n) FROM (SELECT n FROM s ORDER BY n DESC LIMIT 2))')} AS le, {R6.format('20 / (SELECT min(score) FROM m)')} AS lz")
def ssc_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty scales of the sparse clusterings: the smallest best correlation, and scales by L1 norms."""
    df = embedded(spark, sf_dir)
    low, top, second = sparse_subspace.penalty_scale(df), sparse_subspace.largest_l1(df), sparse_subspace.outlier_scale(df)
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return one.select(rounded(F.lit(low)).alias("lambda"), rounded(F.lit(20 / top)).alias("gamma"), rounded(F.lit(20 / second)).alias("le"), rounded(F.lit(20 / low)).alias("lz"))


_COO = f"WITH {E}, t AS (SELECT id, other, score FROM (SELECT a.id, b.id AS other, abs(list_dot_product(a.x, b.x)) AS score, row_number() OVER (PARTITION BY a.id ORDER BY abs(list_dot_product(a.x, b.x)) DESC, b.id) AS rank FROM e AS a JOIN e AS b ON a.id <> b.id) WHERE rank <= 5), "
_COO += f"h AS (SELECT other AS i, id AS j, score / (max(score) OVER (PARTITION BY id) + {EPS}) AS v FROM t), w AS (SELECT i, j, sum(v) AS value FROM (SELECT i, j, v FROM h UNION ALL SELECT j, i, v FROM h) GROUP BY i, j)"


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row by its five most correlated others."""
    return sparse_subspace.gram_top(embedded(spark, sf_dir), 5).select(F.col("other").alias("row_id"), F.col("id").alias("col_id"), F.col("score").alias("coef"))


@query(f"{_COO} SELECT i, j, {R6.format('value')} AS value FROM w")
def ssc_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.adjacency(top_coefficients(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@query(f"{_COO} SELECT i, j, {R6.format('1 - value')} AS value FROM w")
def ssc_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.distance(spectral.adjacency(top_coefficients(spark, sf_dir))).withColumn("value", rounded(F.col("value")))


@query(f"{_COO}, d AS (SELECT i AS id, sum(value) + {EPS} AS degree FROM w GROUP BY i) SELECT w.i, w.j, {R6.format('-w.value / sqrt(a.degree * b.degree)')} AS value FROM w JOIN d AS a ON a.id = w.i JOIN d AS b ON b.id = w.j UNION ALL SELECT id, id, 1.0 FROM d")
def degree_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ids = spectral.adjacency(top_coefficients(spark, sf_dir)), embedded(spark, sf_dir).select("id")
    return spectral.laplacian(w, spectral.degrees(w, ids)).withColumn("value", rounded(F.col("value")))


@query("SELECT CAST(k AS INTEGER) AS pair, true AS settled, true AS unit FROM range(10) AS r(k)")
def spectral_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of the ten smallest directions solves the Laplacian's equation, |Lv - sv| <= 2e-5, by joins with its entries."""
    w, ids = spectral.adjacency(top_coefficients(spark, sf_dir)).persist(), embedded(spark, sf_dir).select("id")
    found, values = spectral.smallest_directions(w, ids, 10)
    v = found.select("id", F.posexplode("vector").alias("pair", "v"))
    moved = spectral.laplacian(w, spectral.degrees(w, ids)).join(v.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id"), "pair").agg(F.sum(F.col("value") * F.col("v")).alias("lv"))
    rest = F.col("lv") - F.col("v") * F.element_at(literal_vector(values), F.col("pair") + 1)
    sums = moved.join(v, ["id", "pair"]).groupBy("pair").agg(F.sqrt(F.sum(rest * rest)).alias("rest"), F.sum(F.col("v") * F.col("v")).alias("norm"))
    return sums.select("pair", (F.col("rest") <= 2e-5).alias("settled"), (F.abs(F.col("norm") - 1) <= 1e-6).alias("unit"))


@query()
def ssc_omp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    w = spectral.plain_affinity(sparse_subspace.omp_coefficients(df, 5, 1e-6))
    return spectral.spectral_labels(w.persist(), df.select("id"), 10)


@query()
def ssc_admm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_subspace.SparseSubspaceADMM(n_clusters=10).transform(embedded(spark, sf_dir))


#: The four variants of the ADMM: with or without outliers and the affine constraint.
_VARIANTS = {f"{'o' if o else '-'}{'a' if a else '-'}": (o, a) for o in (True, False) for a in (True, False)}


@query(f"SELECT e.vec_id AS id, v.variant, true AS apart, true AS sums FROM embeddings AS e, (SELECT unnest({list(_VARIANTS)}) AS variant) AS v")
def ssc_admm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no point of any variant is expressed by itself, and whether, with the affine constraint, its coefficients sum to 1 within a hundredth.

    The constraint is approached slowly beside outliers (200 steps leave up to 0.0123 on 500 vectors), so the affine variants take 1,000 steps at most.
    """
    df, out = embedded(spark, sf_dir), None
    solve = lambda o, a: lambda: sparse_subspace.admm_coefficients(df, SscAdmmParams(use_outliers=o, use_affine=a), 1000 if a else 200)
    found = pipelines.run_all(spark, {name: solve(*v) for name, v in _VARIANTS.items()}, len(_VARIANTS))  # side by side, so that one's last tasks leave no core idle
    for name, (_, affine) in _VARIANTS.items():
        c = found[name]
        if isinstance(c, Exception):
            raise c
        by = c.groupBy(F.col("col_id").alias("id")).agg(F.bool_and(F.col("row_id") != F.col("col_id")).alias("apart"), F.sum("coef").alias("total"))
        sums = (F.abs(F.col("total") - 1) <= 0.01) if affine else F.lit(True)
        one = df.select("id").join(by, "id", "left").select("id", F.lit(name).alias("variant"), F.coalesce("apart", F.lit(True)).alias("apart"), F.coalesce(sums, F.lit(False)).alias("sums"))
        out = one if out is None else out.union(one)
    return out


@query()
def ssc_convex_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_subspace.SparseSubspaceConvex(n_clusters=10).transform(embedded(spark, sf_dir))


#: The eight programs: with or without outliers, noise and the affine constraint.
_PROGRAMS = {f"{'o' if o else '-'}{'n' if n else '-'}{'a' if a else '-'}": (o, n, a) for o in (True, False) for n in (True, False) for a in (True, False)}


@query(f"SELECT e.vec_id AS id, p.program, true AS optimal FROM embeddings AS e, (SELECT unnest({list(_PROGRAMS)}) AS program) AS p WHERE e.vec_id % 100 = 0")
def ssc_convex_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each asked point's solution of each program is optimal among all points: no inner product with the dual vector above 1, and no gap."""
    from flatspan.operators.convex import largest_products, several_solutions
    from flatspan.params import SscConvexParams

    df = embedded(spark, sf_dir)
    scales = sparse_subspace.outlier_scale(df), sparse_subspace.penalty_scale(df)
    programs = [(*sparse_subspace.convex_scales(df, SscConvexParams(use_outliers=o, use_noise=n, use_affine=a), scales), a) for o, n, a in _PROGRAMS.values()]
    found = cut_lineage(several_solutions(df, programs, ASKED))
    told = found.join(largest_products(df, found, programs), ["id", "program"])
    name = F.element_at(F.array(*[F.lit(n) for n in _PROGRAMS]), F.col("program") + 1)
    return told.select("id", name.alias("program"), ((F.col("score") <= 1.001) & (F.col("gap") <= 1e-3)).alias("optimal"))


# --- regression


@query(f"WITH {LINES}, p AS (SELECT unnest(generate_series(1, 4)) AS k, x FROM l), m AS (SELECT k, avg(x[k]) AS mean FROM p GROUP BY k) SELECT CAST(p.k - 1 AS INTEGER) AS feature, floor(any_value(m.mean) * 1e8 + 0.5) / 1e8 AS mean, floor(sqrt(sum((p.x[p.k] - m.mean) ** 2)) * 1e4 + 0.5) / 1e4 AS scale FROM p JOIN m ON m.k = p.k GROUP BY p.k")
def owl_center_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    _, x, y = regression.means(df, 4)
    gram, _, _ = regression.centred_sums(df, x, y)
    return spark.createDataFrame([(k, float(x[k]), float(np.sqrt(gram[k, k]))) for k in range(4)], "feature int, mean double, scale double").select("feature", rounded(F.col("mean"), 8).alias("mean"), rounded(F.col("scale"), 4).alias("scale"))


_ERR = f"list_dot_product(x, {BETA}::DOUBLE[]) - y"


@query(f"WITH {LINES} SELECT floor((avg(({_ERR}) ** 2) + 3.0 * 0.4 + 2.0 * 0.3 + 1.5 * 0.2 + 0.25 * 0.1) * 1e3 + 0.5) / 1e3 AS cost FROM l")
def owl_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error and the sorted-L1 penalty of fixed coefficients."""
    df = lines(spark, sf_dir)
    gram, xty, yty = regression.centred_sums(df, np.zeros(4), 0.0)
    one = df.agg(F.count(F.lit(1)).alias("n"))
    cost = owl_cost_of(gram, xty, yty, one.first()["n"], owl_weights(4, 0.4, 0, 0.1, 3), np.array(BETA))
    return one.select(rounded(F.lit(cost), 3).alias("cost"))


@query(f"WITH {LINES}, p AS (SELECT unnest(generate_series(1, 4)) AS k, x, {_ERR} AS r FROM l) SELECT CAST(k - 1 AS INTEGER) AS feature, floor(2 * avg(x[k] * r) * 1e3 + 0.5) / 1e3 AS gradient FROM p GROUP BY k")
def owl_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    gram, xty, _ = regression.centred_sums(df, np.zeros(4), 0.0)
    g = owl_gradient_of(gram, xty, df.count(), np.array(BETA))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "feature int, g double").select("feature", rounded(F.col("g"), 3).alias("gradient"))


@query(
    f"WITH {E}, p AS (SELECT id, unnest(generate_series(1, len(x))) AS k, x FROM e), o AS (SELECT id, k, abs(x[k]) AS z, sign(x[k]) AS s, row_number() OVER (PARTITION BY id ORDER BY abs(x[k]) DESC, k) AS r FROM p), "
    "d AS (SELECT *, z - (0.1 - 0.09 * (r - 1) / 63) AS d FROM o), c AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY r) AS t FROM d), "
    "a AS (SELECT f.id, f.r AS a, l.r AS b, (l.t - f.t + f.d) / (l.r - f.r + 1) AS m FROM c AS f JOIN c AS l ON l.id = f.id AND l.r >= f.r), "
    "h AS (SELECT id, a, b AS r, max(m) OVER (PARTITION BY id, a ORDER BY b DESC) AS m FROM a), v AS (SELECT id, r, greatest(min(m), 0.0) AS v FROM h GROUP BY id, r) "
    "SELECT c.id, CAST(c.k - 1 AS INTEGER) AS pos, floor(c.s * v.v * 1e6 + 0.5) / 1e6 AS value FROM c JOIN v ON v.id = c.id AND v.r = c.r"
)
def owl_prox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted-L1 prox of every row."""
    from collections.abc import Iterator

    import pandas as pd

    weights = owl_weights(64, 0.1, 0, 0.01, 63)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "prox": [prox_owl(np.asarray(f), weights) for f in b["features"]]})

    out = embedded(spark, sf_dir).mapInPandas(run, "id long, prox array<double>")
    return out.select("id", F.posexplode("prox").alias("pos", "value")).select("id", "pos", rounded(F.col("value")).alias("value"))


@query(f"WITH {LINES} SELECT l_orderkey, line, floor((list_dot_product(x, {BETA}::DOUBLE[]) + 7.0) * 1e4 + 0.5) / 1e4 AS prediction FROM l")
def owl_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flatspan.params import OwlParams

    model = regression.OwlModel(OwlParams(), np.array(BETA), 7.0)
    return model.transform(lines(spark, sf_dir)).select("l_orderkey", "line", rounded(F.col("prediction"), 4).alias("prediction"))


@query(f"WITH {LINES} SELECT floor(regr_slope(y, x[1]) * 1e4 + 0.5) / 1e4 AS slope, floor(regr_intercept(y, x[1]) * 1e4 + 0.5) / 1e4 AS intercept FROM l")
def owl_ols_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With zero weights the regression is least squares."""
    df = lines(spark, sf_dir).select(F.slice("features", 1, 1).alias("features"), "label")
    n = df.count()
    model = regression.OwlRegression(weight_max_val=0.0, weight_min_val=0.0, normalize=True, learning_rate=0.45 * n, tol=1e-13).fit(df, iterations=3000)
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return one.select(rounded(F.lit(float(model.coef[0])), 4).alias("slope"), rounded(F.lit(model.intercept), 4).alias("intercept"))


_PAIR = "p AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice / 1000 + l_quantity + 100 * l_discount AS y FROM lineitem)"
_PAIR += ", m AS (SELECT avg(a) AS a, avg(b) AS b, avg(y) AS y, count(*) AS n FROM p)"
_PAIR += ", g AS (SELECT sqrt(sum((p.a - m.a) ** 2)) AS sa, sqrt(sum((p.b - m.b) ** 2)) AS sb, sum((p.a - m.a) * (p.b - m.b)) AS ab, sum((p.a - m.a) * (p.y - m.y)) AS ay, sum((p.b - m.b) * (p.y - m.y)) AS b_y, any_value(m.n) / 2.0 AS k FROM p, m)"
_PAIR += ", h AS (SELECT sa, sb, k, ab / (sa * sb) AS g, ay / sa AS c1, b_y / sb AS c2 FROM g), f AS (SELECT *, c1 - k * 0.002 * sign(c1) AS d1 FROM h)"
_PAIR += ", t AS (SELECT *, sign(c2 - g * d1) * greatest(abs(c2 - g * d1) - k * 0.001, 0.0) / (1 - g * g) AS b2 FROM f)"


@query(f"WITH {_PAIR} SELECT floor((d1 - g * b2) / sa * 1e5 + 0.5) / 1e5 AS quantity, floor(b2 / sb * 1e3 + 0.5) / 1e3 AS discount FROM t")
def owl_fit_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit with falling weights, where the first coefficient is the larger: its optimum has a closed form."""
    t = read_table(spark, sf_dir, "lineitem")
    label = F.col("l_extendedprice") / 1000 + F.col("l_quantity") + 100 * F.col("l_discount")
    df = t.select(F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("features"), label.alias("label"))
    n = df.count()
    model = regression.OwlRegression(normalize=True, learning_rate=0.2 * n, tol=1e-14, weight_max_val=0.002, weight_min_val=0.001, weight_min_off=1).fit(df, iterations=5000)
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return one.select(rounded(F.lit(float(model.coef[0])), 5).alias("quantity"), rounded(F.lit(float(model.coef[1])), 3).alias("discount"))


@query("SELECT true AS closed, count(*) AS n FROM lineitem")
def svr_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fitted support vector regression is proven to be within a thousandth of the least objective."""
    df = lines(spark, sf_dir).select("features", "label")
    m = regression.LinearSVR(epsilon=0.5).fit(df)
    return df.agg(F.lit(bool(0 <= m.gap <= 1e-3)).alias("closed"), F.count(F.lit(1)).alias("n"))


@query()
def owl_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    n = df.count()
    model = regression.OwlRegression(normalize=True, learning_rate=0.2 * n, tol=1e-6, weight_max_val=0.002, weight_min_val=0.001, weight_min_off=3).fit(df, iterations=2000)
    return model.transform(df).select("l_orderkey", "line", "label", "prediction")


# --- tables


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v FROM part) SELECT p_partkey, floor(coalesce(v, (SELECT avg(v) FROM p)) * 1e6 + 0.5) / 1e6 AS value FROM p")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("value"))
    return tabular.impute_mean(t, ["value"]).select("p_partkey", rounded(F.col("value")).alias("value"))


def _profile_sql(columns: tuple[str, ...], table: str) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(try_cast(CAST({c} AS VARCHAR) AS BIGINT)) AS n_long, min(CAST({c} AS VARCHAR)) AS low, max(CAST({c} AS VARCHAR)) AS high FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


_PROFILED = ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


@query(_profile_sql(_PROFILED, "customer"))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.profile(read_table(spark, sf_dir, "customer").select(*_PROFILED)).select("column", "n", "n_null", "n_long", "low", "high")


@query("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, try_cast(o_orderstatus AS BIGINT) AS status, try_cast(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS customer FROM orders")
def parse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("customer"))
    return tabular.parse(t, {"priority": "long", "status": "long", "customer": "double"})


@query(f"WITH {E}, {_assign_sql()} SELECT v.vec_id, v.label, a.cluster FROM embeddings AS v LEFT JOIN a ON a.id = v.vec_id AND a.id % 2 = 0")
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    found = ks.assign(df, row_bases(df, 0)).where("id % 2 = 0").select("id", "cluster")
    return tabular.attach(read_table(spark, sf_dir, "embeddings").select("vec_id", "label"), found, "vec_id")


@query(f"WITH {LINES}, t AS (SELECT {_ERR} AS r FROM l WHERE l_orderkey % 5 = 0) SELECT count(*) AS n, floor(avg(r * r) * 1e3 + 0.5) / 1e3 AS mse, floor(avg(abs(r)) * 1e4 + 0.5) / 1e4 AS mae FROM t")
def split_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = tabular.split(lines(spark, sf_dir), "l_orderkey")
    scored = tabular.regression_scores(test.withColumn("prediction", dot(F.col("features"), literal_vector(BETA))))
    return scored.select("n", rounded(F.col("mse"), 3).alias("mse"), rounded(F.col("mae"), 4).alias("mae"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def select_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and attributes, but for the attribute at one place."""
    t = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    marked = with_roles(t, {"c_custkey": "index", "c_name": "attribute", "c_mktsegment": "attribute", "c_acctbal": "attribute", "c_nationkey": "target"})
    return tabular.select_by_role(marked, "index", "attribute", exclude=(1,))


@query("SELECT c_nationkey FROM customer")
def select_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return tabular.select_by_role(with_roles(t, {"c_custkey": "index", "c_nationkey": "target"}), "target")


@query(f"WITH {E} SELECT id, x[1] AS f0, x[2] AS f1, x[3] AS f2 FROM e")
def spread_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.spread(embedded(spark, sf_dir), width=3)


@query(f"WITH {E}, {_assign_sql()}, p AS (SELECT a.cluster, e.label, count(*) AS n FROM a JOIN e ON e.id = a.id GROUP BY ALL), c AS (SELECT max(n) AS most, sum(n) AS n FROM p GROUP BY cluster) SELECT floor(sum(most) / sum(n) * 1e9 + 0.5) / 1e9 AS purity FROM c")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = read_table(spark, sf_dir, "embeddings"), embedded(spark, sf_dir)
    found = tabular.purity(ks.assign(df, row_bases(df, 0)), t.select(F.col("vec_id").alias("id"), "label"))
    return found.select(rounded(F.col("purity"), 9).alias("purity"))


# --- tracking and pipelines


def _tracked(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("id", *more, rounded(norm2(F.col("low_rank")), 4).alias("low_rank_norm"), rounded(norm2(F.col("sparse")), 4).alias("sparse_norm"))


_FROM_STATE = "d AS (SELECT list_transform(list_zip(a.x, b.x), lambda p: p[1] + p[2]) AS v FROM e AS a, e AS b WHERE a.id = 0 AND b.id = 1), u AS (SELECT list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) AS u FROM d)"
_FROM_STATE += ", r AS (SELECT id, 0 AS k, x, u, list_transform(x, lambda c: 0.0::DOUBLE) AS s, list_transform(x, lambda c: 0.0::DOUBLE) AS y, 1.8::DOUBLE AS mu, 0.0::DOUBLE AS w, list_transform(x, lambda c: 0.0::DOUBLE) AS h, 1.0::DOUBLE AS size FROM e, u"
_FROM_STATE += " UNION ALL SELECT id, k + 1, x, u, s2, list_transform(list_zip(y, h2), lambda p: p[1] + mu * p[2]), mu * 1.8, w2, h2, sqrt(list_dot_product(h2, h2)) FROM ("
_FROM_STATE += "SELECT *, list_transform(list_zip(fit, s2), lambda p: p[1] - p[2]) AS h2 FROM (SELECT *, list_transform(list_zip(fit, y), lambda p: sign(p[1] + p[2] / mu) * greatest(abs(p[1] + p[2] / mu) - 1 / mu, 0.0)) AS s2 FROM ("
_FROM_STATE += "SELECT *, list_transform(list_zip(x, u), lambda p: p[1] - w2 * p[2]) AS fit FROM (SELECT *, (list_dot_product(u, x) - list_dot_product(u, s) + list_dot_product(u, y) / mu) / list_dot_product(u, u) AS w2 FROM r WHERE k < 21 AND size >= 1e-8)))))"
_FROM_STATE += ", z AS (SELECT * FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), g AS (SELECT *, list_transform(list_zip(y, h), lambda p: p[1] + p[2]) AS g1 FROM z)"
_FROM_STATE += ", c AS (SELECT *, list_transform(list_zip(g1, u), lambda p: p[1] - p[2] * list_dot_product(u, g1)) AS gamma FROM g)"
_FROM_STATE += ", t AS (SELECT id, x, list_transform(list_zip(u, gamma), lambda p: w * (cos(pi() / 3) * p[1] + sin(pi() / 3) * sign(w) * p[2] / sqrt(list_dot_product(gamma, gamma)))) AS low FROM c)"


@query(f"WITH RECURSIVE {E}, {_FROM_STATE} SELECT id, floor(low[1] * 1e4 + 0.5) / 1e4 AS low_first, floor(sqrt(list_dot_product(low, low)) * 1e4 + 0.5) / 1e4 AS low_rank_norm, floor(sqrt(list_sum(list_transform(list_zip(x, low), lambda p: (p[1] - p[2]) ** 2))) * 1e4 + 0.5) / 1e4 AS sparse_norm FROM t")
def tracker_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's separation by one step from a fixed direction: weights and sparse part by ADMM, then the turn of the basis."""
    df = embedded(spark, sf_dir)
    line = row_bases(df, 0, 2).sum(axis=0)
    state = TrackerState(line / np.linalg.norm(line), 1.0, 20)
    found = tracking.SubspaceTrackerModel(TrackerOptions(rank=1), state).transform(df)
    return _tracked(found, rounded(F.col("low_rank")[0], 4).alias("low_first"))


@query()
def tracker_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir)
    return _tracked(tracking.SubspaceTracker(rank=3).fit(df).transform(df))


@query()
def tracker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a file stream: the tracker advances over micro-batches and scores them."""
    from flatspan.runtime import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark)}/tracker-{uuid4().hex}"
    df = embedded(spark, sf_dir)
    df.repartitionByRange(4, "id").write.parquet(f"{folder}/in")
    stream = TrackerStream(spark, TrackerOptions(rank=3), len(df.first()["features"]), folder)
    source = spark.readStream.schema("id long, features array<double>").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stream.start(source, once=True).awaitTermination()
    return _tracked(stream.scored())


def _by_user(events: DataFrame) -> DataFrame:
    """(key, time, id, features): an event's value, number and time of day, by its user."""
    number = F.get_json_object("props", "$.k").cast("double")
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), F.array(F.col("value"), number, F.hour("ts").cast("double"), F.minute("ts").cast("double")).alias("features"))


@query()
def tracker_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event separated by its user's own tracker."""
    found = track_by_key(_by_user(read_table(spark, sf_dir, "events")), rank=1)
    return found.select("id", "key", rounded(norm2(F.col("low_rank")), 4).alias("low_rank_norm"))


@query("SELECT event_id AS id, user_id AS key, true AS same FROM events")
def tracker_by_user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream in order of time, one tracker a user in keyed state: whether each separation is that of the table's trackers."""
    from flatspan.runtime import ensure_checkpoint_dir
    from flatspan.streaming.keyed import keyed_state

    keyed_state(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/trackers-{uuid4().hex}"
    vectors_of = _by_user(read_table(spark, sf_dir, "events"))
    ordered = vectors_of.repartitionByRange(4, "time", "id").withColumn("part", F.spark_partition_id()).persist()
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
    files = max(1, min(n for _, n in sizes) // 250_000) if sizes else 1  # of a part: as many as a batch takes, each with rows
    for part, _ in sizes:  # arrivals in order of time
        own = ordered.where(F.col("part") == part).drop("part")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    ordered.unpersist()
    source = spark.readStream.schema(vectors_of.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = tracked_stream(source, rank=1).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    streamed = spark.read.schema("key long, id long, low_rank array<double>").parquet(f"{folder}/out").withColumnRenamed("low_rank", "seen")
    away = norm2(F.zip_with("seen", "low_rank", lambda a, b: a - b))
    return track_by_key(vectors_of, rank=1).join(streamed, ["key", "id"]).select("id", "key", (away <= 1e-9).alias("same"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "lineitem")
    return t.withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("price", F.col("l_extendedprice") / 1000).withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))


@query()
def pipeline_owl(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = tabular.split(_numbered(spark, sf_dir), "l_orderkey")
    p = pipelines.presets("vec_id", "embedding", "row", LINE_FEATURES, "price")["owl"]
    return p.run(train, test).select("row", "price", "prediction")


@query()
def pipeline_ksubspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipelines.clustering("kss", "ksubspaces", "vec_id", "embedding", n_clusters=20, dim_subspaces=1)
    return p.run(read_table(spark, sf_dir, "embeddings")).select("vec_id", "label", "prediction")


def _tracked_prices(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    t = read_table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double"))).withColumn("key", F.col("p_partkey").cast("double") / 1000).withColumn("letters", F.length("p_name").cast("double"))
    p = pipelines.tracked_regression("tracked", "p_partkey", ["size", "key", "letters"], "p_retailprice", **params)
    return p.run(t).select("p_partkey", "p_retailprice", "prediction")


@query()
def pipeline_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked_prices(spark, sf_dir)


@query()
def pipeline_tracked_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's pipeline with steps of one size."""
    return _tracked_prices(spark, sf_dir, constant_step=0.1)


@query()
def pipeline_omp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipelines.clustering("omp", "ssc_omp", "vec_id", "embedding", n_clusters=20, sparsity_level=5)
    return p.run(read_table(spark, sf_dir, "embeddings")).select("vec_id", "label", "prediction")


def _clustered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A preset pipeline with 20 clusters, as the given tables have fewer vectors than its own number of clusters asks for."""
    p = pipelines.presets("vec_id", "embedding", "row", LINE_FEATURES, "price")[name]
    steps = [pipelines.Step(s.kind, {**s.params, "n_clusters": 20}) if "n_clusters" in s.params else s for s in p.steps]
    return replace(p, steps=steps).run(read_table(spark, sf_dir, "embeddings")).select("vec_id", "label", "prediction")


@query()
def pipeline_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "ekss")


@query()
def pipeline_admm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "ssc_admm")


@query()
def pipeline_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "ssc_convex")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ksub_fit(spark, sf_dir)


