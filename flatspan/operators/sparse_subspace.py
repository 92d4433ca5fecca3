"""Sparse subspace clustering: coefficients by ADMM, by convex programs and by orthogonal matching pursuit.

Every point is expressed by few others. Correlations, matching pursuit and convex programs compare packed blocks of points, at any
size. ADMM keeps few entries a point (``functions/admm.py``), in blocks of points whose state is stored from pass to pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatspan.frame import width_of
from flatspan.functions.admm import FewAdmm, FewState
from flatspan.functions.kernels import EPS, least_squares, left_over_all
from flatspan.operators.convex import convex_solutions
from flatspan.operators.pairing import HeldPoints, packed, top_partners
from flatspan.operators.spectral import adjacency, distance, plain_affinity, spectral_labels
from flatspan.params import SscAdmmParams, SscConvexParams, SscOmpParams
from flatspan.runtime import cut_lineage, stored_for_now

COEFFICIENTS = "row_id long, col_id long, coef double"
#: Points of one ADMM block at least, blocks at most, points that take their steps at once, and steps of a pass.
BLOCK, BLOCKS, BATCH, STEPS = 256, 24, 16, 50
#: Bytes of all points that an ADMM block's task holds in memory, and of a number for every point and every one that takes its steps at once.
HELD_BYTES, ROW_BYTES = 256 << 20, 64 << 20
#: Blocks of points that all are compared with first, where only the smallest of all is asked for, and points that are then compared with all.
SOME_BLOCKS, LOWEST = 2, 256


def _points(df: DataFrame, queries: Column | None) -> DataFrame:
    return (df.where(queries) if queries is not None else df).select("id", "features")


def gram_top(df: DataFrame, k: int, queries: Column | str | None = None) -> DataFrame:
    """(id, rank, other, score): for each query row the k others with the largest |inner product|, smallest id on ties."""
    return top_partners(_points(df, queries), packed(df, "features"), k)


def penalty_scale(df: DataFrame) -> float:
    """Smallest over points of the largest |inner product| with another point.

    Some blocks of points tell for each point how large its own is at least. The points with the least of these are compared with all; of the others,
    only those that may still be below the smallest so found.
    """
    points, atoms = df.select("id", "features"), packed(df, "features")
    least = lambda rows: top_partners(rows, atoms, 1).agg(F.min("score")).first()[0]
    if atoms.count() <= 2 * SOME_BLOCKS:
        return least(points)
    low = cut_lineage(top_partners(points, atoms.where(F.col("block") < SOME_BLOCKS), 1).select("id", "score"))
    found = least(points.join(low.orderBy("score", "id").limit(LOWEST).select("id"), "id", "left_semi"))
    below = points.join(low.where(F.col("score") < found).select("id"), "id", "left_semi")
    rest = least(below)
    return found if rest is None else min(found, rest)


def largest_l1(df: DataFrame) -> float:
    """Largest L1 norm of a point."""
    return df.agg(F.max(F.aggregate("features", F.lit(0.0), lambda s, v: s + F.abs(v)))).first()[0]


def outlier_scale(df: DataFrame) -> float:
    """Smallest over points of the largest L1 norm of another point: the second largest of all."""
    norms = df.select(F.aggregate("features", F.lit(0.0), lambda s, v: s + F.abs(v)).alias("n"))
    return norms.orderBy(F.desc("n")).limit(2).agg(F.min("n")).first()[0]


def omp_coefficients(df: DataFrame, level: int, thresh: float, queries: Column | str | None = None) -> DataFrame:
    """(row_id, col_id, coef): each point (col_id) by at most ``level`` others (row_id); duplicates of an atom are summed.

    A step is one comparison of packed blocks: atoms are chosen by their raw inner product with what is left of the
    normalised point, the lowest id on ties, and joined to their points. A point whose rest is below thresh takes no
    further atom. Coefficients fit the raw points. Each step's state is deleted after the next one is stored.
    """
    level, atom_blocks = min(level, df.count() - 1), packed(df, "features")
    own = df.select(F.col("id").alias("other"), F.col("features").alias("atom"))
    state = _points(df, queries).select("id", "features", F.expr("cast(array() as array<long>)").alias("chosen"), F.expr("cast(array() as array<double>)").alias("atoms"), F.lit(None).cast("array<double>").alias("rest"))
    state, drop = stored_for_now(_rests(state, thresh))
    for k in range(level):
        best = top_partners(state.where("rest is not null").select("id", F.col("rest").alias("features")), atom_blocks, 1).select("id", "other").join(own, "other")
        found = state.join(best, "id", "left")
        grown = F.col("other").isNotNull()
        found = found.select("id", "features", F.when(grown, F.concat("chosen", F.array("other"))).otherwise(F.col("chosen")).alias("chosen"), F.when(grown, F.concat("atoms", "atom")).otherwise(F.col("atoms")).alias("atoms"), F.when(grown, F.col("rest")).alias("rest"))
        if k + 1 < level:
            before = drop
            state, drop = stored_for_now(_rests(found, thresh))
            before()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, x, atoms in _by_size(b):
                n, coef = atoms.shape[1], least_squares(x, atoms)
                chosen = np.array(b["chosen"].iloc[at].to_list(), dtype=np.int64)
                order = np.argsort(chosen, axis=1, kind="stable")
                chosen, coef = (np.take_along_axis(m, order, axis=1).ravel() for m in (chosen, coef))
                first = np.flatnonzero((np.arange(len(chosen)) % n == 0) | np.append(True, chosen[1:] != chosen[:-1]))
                yield pd.DataFrame({"row_id": chosen[first], "col_id": np.repeat(b["id"].to_numpy()[at], n)[first], "coef": np.add.reduceat(coef, first)})

    out = cut_lineage((found if level > 0 else state).select("id", "features", "chosen", "atoms").mapInPandas(solve, COEFFICIENTS))
    drop()
    return out


def _by_size(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their points, their atoms) of those rows of b that have equally many atoms, for each number but none."""
    sizes = b["chosen"].map(len).to_numpy()
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = np.array(b["features"].iloc[at].to_list(), dtype=float)
        yield at, x, np.array(b["atoms"].iloc[at].to_list(), dtype=float).reshape(len(at), n, x.shape[1])


def _rests(state: DataFrame, thresh: float) -> DataFrame:
    """state with what the chosen atoms leave of each point; null where that is below thresh, or was already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)
        for b in batches:
            rest = pd.Series([None] * len(b), dtype=object)
            bare = np.flatnonzero(b["chosen"].map(len).to_numpy() == 0)
            if len(bare):
                rest.iloc[bare] = pd.Series(list(unit(np.array(b["features"].iloc[bare].to_list(), dtype=float))), index=bare)
            going = b[b["rest"].notna()].reset_index()
            for at, x, atoms in _by_size(going):
                last = left_over_all(unit(x), atoms)
                left = ~((last * last).sum(axis=1) < thresh)
                if left.any():
                    place = going["index"].to_numpy()[at][left]
                    rest.iloc[place] = pd.Series(list(last[left]), index=place)
            yield b.assign(rest=rest.to_numpy())

    return state.mapInPandas(run, "id long, features array<double>, chosen array<long>, atoms array<double>, rest array<double>")


def admm_scale(df: DataFrame, alpha: float, outliers: bool) -> float:
    """Smallest over points of the largest |inner product| with another point or, with outliers, a scaled unit vector."""
    best = gram_top(df, 1).select("id", "score")
    if outliers:
        gamma = alpha / largest_l1(df)
        best = best.join(df.select("id", (F.array_max(F.transform("features", F.abs)) / gamma).alias("unit")), "id").select(F.greatest("score", "unit").alias("score"))
    return best.agg(F.min("score")).first()[0]


def admm_coefficients(df: DataFrame, params: SscAdmmParams, iterations: int = 200, stop: str = "global") -> DataFrame:
    """(row_id, col_id, coef) of the four ADMM variants.

    Blocks of points take STEPS steps in a pass, from their stored state of the pass before, and report each step's largest error. All
    share one number of steps, the first at which no block's error is above epsilon: where that lies inside a pass, that pass alone is
    taken again as far as there. ``stop='block'`` lets each block stop by its own errors.

    A task holds the few coefficients of its block's points; all points stream into it, and stay in memory up to HELD_BYTES and in a nameless
    file beyond. The state of the pass before is deleted, and so are the points' shuffles.
    """
    width, n = width_of(df), df.count()
    alpha = params.alpha if params.alpha != -1 else (20 if params.use_outliers else 800)
    steps, eps = max(iterations if iterations >= 5 else 200, 2) - 1, params.epsilon
    args = (float(alpha), params.use_affine, params.use_outliers, admm_scale(df, alpha, params.use_outliers))
    blocks, held = max(1, min(BLOCKS, -(-n // BLOCK))), HELD_BYTES
    batch = int(np.clip(ROW_BYTES // (8 * n), 1, BATCH))
    points = packed(df, "features").select("ids", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    own = {"cols": "binary", "k": "binary", "i": "binary", "now": "binary", "before": "binary", "v": "binary", "errors": "array<double>"}
    schema = "block int, " + ", ".join(f"{c} {kind}" for c, kind in own.items())

    def begin(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": g["block"].iloc[:1], "cols": [np.sort(g["id"].to_numpy(dtype=np.int64)).tobytes()], **{k: [b""] for k in ("k", "i", "now", "before", "v")}, "errors": [np.zeros(0)]})

    def advance(r: dict, problem: FewAdmm, cols: np.ndarray, count: int, own_stop: bool) -> pd.DataFrame:
        if own_stop and len(r["errors"]) and r["errors"][-1] <= eps:
            return pd.DataFrame([r])  # this block has stopped
        state = FewState.from_row(r, len(cols)) if r["v"] else problem.begin(len(cols))
        new, worst = problem.advance(cols, state, count, eps, batch)
        if own_stop and (worst <= eps).any():
            count = int((worst <= eps).argmax()) + 1
            new, worst = problem.advance(cols, state, count, eps, batch)
        return pd.DataFrame([r | {"errors": worst} | new.to_row()])

    def with_points(state: DataFrame, work: Callable[[dict, HeldPoints], pd.DataFrame], out: str) -> DataFrame:
        """work(a block's state, all points), each block in a task of its own."""
        all_points = points.select("block", *[F.lit(None).cast(kind).alias(c) for c, kind in own.items()], "ids", "x")
        dealt = state.select("block", *own, F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("x")).union(all_points).repartitionById(blocks, "block")
        last = float(np.sqrt(args[3])) if params.use_affine else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            atoms, row = HeldPoints(width, held, last), None
            for b in batches:
                for r in b.to_dict("records"):
                    if r["ids"] is None:
                        row = r
                    else:
                        atoms.add(r["ids"], r["x"])
            if row is not None:
                atoms.close()
                yield work({c: row[c] for c in ("block", *own)}, atoms)

        return dealt.mapInPandas(run, out)

    def taken(state: DataFrame, count: int) -> tuple[DataFrame, Callable[..., None]]:
        def work(r: dict, atoms: HeldPoints) -> pd.DataFrame:
            return advance(r, FewAdmm(atoms.x[:, :width], *args, rows=atoms.x), np.searchsorted(atoms.ids, np.frombuffer(r["cols"], dtype=np.int64)), count, stop == "block")

        return stored_for_now(with_points(state, work, schema))

    state, drop = cut_lineage(df.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").applyInPandas(begin, schema)), None
    for done in range(0, steps, STEPS):
        count = min(STEPS, steps - done)
        after, drop_after = taken(state, count)
        if stop == "block":
            running = after.where(F.element_at("errors", -1) > eps).limit(1).count()
        else:
            worst = after.select(F.posexplode("errors").alias("step", "e")).groupBy("step").agg(F.max("e").alias("worst"))
            first = worst.where(F.col("worst") <= eps).agg(F.min("step")).first()[0]
            running = first is None
            if not running and first + 1 < count:
                drop_after()
                after, drop_after = taken(state, first + 1)
        if drop:
            drop()  # what this pass began with
        state, drop = after, drop_after
        if not running:
            break

    def entries(r: dict, atoms: HeldPoints) -> pd.DataFrame:
        cols = np.frombuffer(r["cols"], dtype=np.int64)
        found = FewState.from_row(r, len(cols))
        own = found.now != 0
        return pd.DataFrame({"row_id": atoms.ids[found.i[own]], "col_id": cols[found.k[own]], "coef": found.now[own]})

    found = cut_lineage(with_points(state, entries, COEFFICIENTS))
    drop()
    return found


def convex_scales(df: DataFrame, params: SscConvexParams, scales: tuple[float, float] | None = None) -> tuple[float, float]:
    """(le, lz): weights of the sparse and of the small rest; 0 leaves one out. scales: df's outlier_scale and penalty_scale, where they are known."""
    alpha = params.alpha if params.alpha != -1 else (20 if params.use_outliers else 800)
    outlier, penalty = scales or ((outlier_scale(df) if params.use_outliers else 0.0), (penalty_scale(df) if params.use_noise else 0.0))
    return (alpha / outlier if params.use_outliers else 0.0), (alpha / penalty if params.use_noise else 0.0)


def convex_coefficients(df: DataFrame, params: SscConvexParams, queries: Column | str | None = None, tol: float = 1e-9) -> DataFrame:
    """(row_id, col_id, coef) of the eight convex programs: with or without outliers, noise and the affine constraint."""
    found = cut_lineage(convex_solutions(df, *convex_scales(df, params), params.use_affine, queries, tol=tol).select("id", "chosen", "coef"))
    pairs = found.select(F.col("id").alias("col_id"), F.explode(F.arrays_zip(F.col("chosen").alias("row_id"), F.col("coef").alias("coef"))).alias("p"))
    return pairs.where(F.col("p.coef") != 0).select("p.row_id", "col_id", "p.coef")


class _SparseSubspace:
    """Coefficients are made once for a frame and used by labels and distances alike."""

    scaled = True

    def coefficients(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def affinity(self, df: DataFrame) -> DataFrame:
        c = self.coefficients(df)
        return adjacency(c) if self.scaled else plain_affinity(c)

    def transform(self, df: DataFrame, iterations: int | None = None) -> DataFrame:
        """(id, cluster)."""
        most = iterations if iterations and iterations >= 5 else self.kmeans_iterations
        return spectral_labels(self.affinity(df).persist(), df.select("id"), self.params.n_clusters, self.params.random_seed, most)

    def distance(self, df: DataFrame) -> DataFrame:
        """1 - affinity of the pairs that have one; a row's distance to itself is 1."""
        return distance(self.affinity(df))


class SparseSubspaceADMM(_SparseSubspace):
    kmeans_iterations = 1000

    def __init__(self, **params):
        self.params = SscAdmmParams(**params)

    def coefficients(self, df: DataFrame) -> DataFrame:
        return admm_coefficients(df, self.params)


class SparseSubspaceConvex(_SparseSubspace):
    kmeans_iterations = 1000

    def __init__(self, **params):
        self.params = SscConvexParams(**params)

    def coefficients(self, df: DataFrame) -> DataFrame:
        return convex_coefficients(df, self.params)


class SparseSubspaceOMP(_SparseSubspace):
    kmeans_iterations, scaled = 200, False

    def __init__(self, **params):
        self.params = SscOmpParams(**params)

    def coefficients(self, df: DataFrame) -> DataFrame:
        if self.params.sparsity_level > width_of(df):
            raise ValueError("sparsity_level is above the number of features")
        return omp_coefficients(df, self.params.sparsity_level, self.params.thresh)
