from __future__ import annotations

import time
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan import queries
from flatspan.frame import vectors, width_of
from flatspan.operators import ksubspaces as ks
from flatspan.operators import sparse_subspace as ssc
from flatspan.functions.kernels import AdmmProblem, convex_point, least_squares
from flatspan import runtime
from flatspan.operators import convex, kmeans, krylov, pairing, spectral
from flatspan.operators.regression import LinearSVR, OwlModel, OwlRegression
from flatspan.operators.tracking import SubspaceTracker, SubspaceTrackerModel
from flatspan.params import EnsembleParams, SscAdmmParams, SscConvexParams
from flatspan.sources.synthetic import linear_data, union_of_subspaces


@pytest.fixture(scope="module")
def union(spark):
    return union_of_subspaces(spark, k=3, dim=20, width=1, each=30, noise=0.001, seed=1).repartition(4).persist()


def accuracy(labels, union, k=3) -> float:
    pairs = labels.join(union.select("id", "true_label"), "id").collect()
    return max(np.mean([p[r.cluster] == r.true_label if r.cluster < k else False for r in pairs]) for p in permutations(range(k)))


def test_k_subspaces(spark, union, tmp_path):
    x = np.array([r.features for r in union.orderBy("id").collect()])
    init = np.stack([x[i][:, None] for i in (0, 30, 60)])
    model = ks.KSubspaces(init=init, n_clusters=3, dim_subspaces=1).fit(union)
    assert accuracy(model.transform(union), union) > 0.95
    assert all(a >= b - 1e-9 for a, b in zip(model.objective, model.objective[1:], strict=False))
    for n in (1, 7):
        again = ks.KSubspaces(init=init, n_clusters=3, dim_subspaces=1).fit(union.repartition(n))
        assert all(np.allclose(a @ a.T, b @ b.T) for a, b in zip(model.bases, again.bases, strict=True))
    model.save(spark, str(tmp_path / "m"))
    assert np.array_equal(ks.KSubspacesModel.load(spark, str(tmp_path / "m")).bases, model.bases)
    d = model.distance(union, F.col("id") < 2).collect()
    own = {r.id: r.cluster for r in model.transform(union).collect()}
    assert len(d) == 180 and all(r.value == (own[r.i] != own[r.j]) for r in d)


def test_k_subspaces_matches_numpy_from_the_seed(spark, union):
    x = np.array([r.features for r in union.orderBy("id").collect()])
    rng = np.random.RandomState(4)
    bases = [np.linalg.qr(rng.randn(20, 2))[0] for _ in range(3)]
    for _ in range(3):
        labels = np.array([np.argmin([np.linalg.norm(v - u @ u.T @ v) for u in bases]) for v in x])
        bases = [np.linalg.eigh(x[labels == c].T @ x[labels == c])[1][:, -2:] for c in range(3)]
    model = ks.KSubspaces(n_clusters=3, dim_subspaces=2, random_seed=4).fit(union, iterations=3)
    want = [int(np.argmin([np.linalg.norm(v - u @ u.T @ v) for u in bases])) for v in x]
    assert [r.cluster for r in model.transform(union).orderBy("id").collect()] == want
    with pytest.raises(ValueError):
        ks.KSubspaces().fit(union, iterations=0)
    with pytest.raises(ValueError):
        ks.KSubspaces(dim_subspaces=21).fit(union)


def test_ensemble(spark, union):
    e = ks.EnsembleKSubspaces(n_clusters=3, dim_subspaces=1, n_base=10, thresh=10)
    w = e.affinity(union)
    assert accuracy(spectral.spectral_labels(w.persist(), union.select("id"), 3, starts=3), union) > 0.9


def test_portions_of_a_step_change_nothing(spark, monkeypatch):
    """Scatter matrices held a few at a time: runs apart, then clusters of a run apart."""
    rng = np.random.default_rng(11)
    df = vectors(spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(200)], "k long, x array<double>"), "k", "x").repartition(3)
    bases = {r: np.stack([np.linalg.qr(rng.standard_normal((6, 2)))[0] for _ in range(7)]) for r in range(3)}
    before = {0: bases[1], 2: bases[2]}
    want = ks.step(df, bases, before)
    assert want[1][1] == 200 and want[1][2] == 0 and 0 < want[1][0] < 200
    for room, row in ((8 * 36 * 8, 8 * 36), (8 * 36 * 3, 8 * 36 * 2)):
        monkeypatch.setattr(ks, "HELD_BYTES", room)
        monkeypatch.setattr(ks, "ROW_BYTES", row)
        got = ks.step(df, bases, before)
        assert got[1] == want[1] and all(np.isclose(got[2][r], want[2][r]) for r in bases)
        spans = lambda u: u @ u.swapaxes(1, 2)
        assert all(np.allclose(spans(got[0][r]), spans(want[0][r])) for r in bases)
    assert len(ks.portions([0, 1, 2], 7, 6)) == 9


@pytest.mark.parametrize("mode", ["drop_smallest", "keep_top"])
def test_trimmed_coassociation_is_the_trim_of_all_pairs(spark, mode, monkeypatch):
    """Few labels, so that most entries tie; blocks of 16 rows, so that each row meets several."""
    rng = np.random.default_rng(4)
    labels = spark.createDataFrame([(i * 7 % 101, rng.integers(0, 3, 5).tolist()) for i in range(60)], "id long, labels array<int>")
    monkeypatch.setattr(ks, "packed", lambda df, column, dtype, rows: pairing.packed(df, column, dtype, 16))
    for thresh in (0, 9, 48, 60):
        want = {(r.i, r.j): r.value for r in ks.trim(ks.coassociation(labels), 60, thresh, mode).collect()}
        got = {(r.i, r.j): r.value for r in ks.trimmed_coassociation(labels, 60, thresh, mode).collect()}
        assert got == want, thresh
    assert ks.coassociation(labels, most=5).groupBy("i").count().agg({"count": "max"}).first()[0] <= 5 * 4


@pytest.mark.parametrize("kinds, thresh", [(3, 9), (3, 48), (2, 0), (2, 60), (7, 20)])
def test_trims_from_label_patterns_equal_those_of_all_pairs(spark, kinds, thresh, monkeypatch):
    """Few labels, so that rows share their patterns and most entries tie; no window over all pairs, and degrees without pairs of rows."""
    rng = np.random.default_rng(kinds + thresh)
    labels = spark.createDataFrame([(i * 7 % 101, rng.integers(0, kinds, 4).tolist()) for i in range(60)], "id long, labels array<int>").persist()
    monkeypatch.setattr(ks, "packed", lambda df, column, dtype, rows: pairing.packed(df, column, dtype, 16))
    whole = ks.coassociation(labels)
    want = {(r.i, r.j): r.value for r in ks.trim_rows(whole, 60, thresh).where("i % 5 = 0").collect()}
    rows = ks.trimmed_rows(labels, thresh, "id % 5 = 0")
    assert {(r.i, r.j): r.value for r in rows.collect()} == want
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    both = ks.trim(whole, 60, thresh).groupBy("i").agg(F.sum("value").alias("degree"), F.count(F.lit(1)).alias("n"))
    assert {r.id: (round(r.degree, 9), r.n) for r in ks.trimmed_degrees(labels, thresh).collect()} == {r.i: (round(r.degree, 9), r.n) for r in both.collect()}


@pytest.mark.parametrize("thresh", [-1, 9])
def test_coassociation_vectors_without_pairs_equal_dense_ones(spark, thresh):
    rng = np.random.default_rng(5)
    own = (np.arange(80)[:, None] // 27 + (rng.random((80, 12)) < 0.3)) % 4
    labels = spark.createDataFrame([(i * 3, own[i].tolist()) for i in range(80)], "id long, labels array<int>").repartition(3).persist()
    a = (own[:, None, :] == own[None, :, :]).mean(axis=2)
    if thresh > 0:
        kept = a.copy()
        for i in range(80):
            kept[i, np.lexsort((np.arange(80), a[i]))[:thresh]] = 0
        a = (kept + kept.T) / 2
    less = ks.trimmed_off(labels, thresh) if thresh > 0 else None
    assert less is None or less.count() > 0
    v, values = ks.coassociation_vectors(labels, 12, 4, less, 3)
    size = 1 / np.sqrt(a.sum(axis=1))
    want, vectors = np.linalg.eigh(size[:, None] * a * size)
    assert np.allclose(values, want[::-1][:3], atol=1e-8)
    got = np.array([r.vector for r in v.orderBy("id").collect()])
    assert np.allclose(np.abs(np.linalg.svd(got.T @ vectors[:, ::-1][:, :3])[1]), 1, atol=1e-6)


def test_trim_matches_dense(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5, (12, 12)) / 4
    a = np.triu(a, 1) + np.triu(a, 1).T + np.eye(12)
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "i long, j long, value double")
    want = a.copy()
    for i in range(12):
        want[i, np.lexsort((np.arange(12), a[i]))[:5]] = 0
    want = (want + want.T) / 2
    got = np.zeros((12, 12))
    for r in ks.trim(coo, 12, 5).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, want)
    assert ks.trim(coo, 12, -1) is coo


def coo(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(p), int(q), float(a[p, q])) for p, q in zip(i, j)], "i long, j long, value double")


def test_embedding_equals_dense_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(krylov, "ROWS", 16)
    rng = np.random.default_rng(0)
    a = rng.random((60, 60)) * np.where(np.arange(60)[:, None] // 20 == np.arange(60) // 20, 1.0, 0.03)
    a = np.triu(a, 1) + np.triu(a, 1).T
    a[59] = a[:, 59] = 0  # a row without entries
    w, ids = coo(spark, a).persist(), spark.range(60)
    found, values = spectral.smallest_directions(w, ids, 3)
    d = 1 / np.sqrt(a.sum(axis=1) + 2.3e-16)
    want, vectors = np.linalg.eigh(np.eye(60) - d[:, None] * a * d)
    got = np.array([r.vector for r in found.orderBy("id").collect()])
    assert np.abs(values - want[:3]).max() < 1e-8 and np.abs(got @ got.T - vectors[:, :3] @ vectors[:, :3].T).max() < 1e-4
    labels = [r.cluster for r in spectral.kmeans_labels(spectral.embedding(w, ids, 3), 3, starts=4).orderBy("id").collect()][:59]
    assert len({(c, i // 20) for i, c in enumerate(labels)}) == 3


def test_embedding_of_separate_parts_and_few_rows(spark):
    a = np.kron(np.eye(4), np.ones((15, 15)) - np.eye(15))
    found, values = spectral.smallest_directions(coo(spark, a), spark.range(60), 4)
    assert np.abs(values).max() < 1e-9 and found.count() == 60
    found, values = spectral.smallest_directions(coo(spark, np.array([[0, 1.0], [1.0, 0]])), spark.range(2), 5)
    assert np.allclose(values, [0, 2]) and found.count() == 2


def test_kmeans_finds_groups_and_takes_all_starts_in_a_pass(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 3)) * 20
    x = np.repeat(centers, 50, axis=0) + rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, vector array<double>")
    data = pairing.packed(rows, "vector", rows=64)
    found, cost = kmeans.kmeans_centers(data, 6, 0, 100, 8)
    own = ((x[:, None] - found) ** 2).sum(axis=2)
    assert np.isclose(cost, own.min(axis=1).sum()) and cost < 1.01 * ((x - np.repeat([x[50 * g : 50 * g + 50].mean(axis=0) for g in range(6)], 50, axis=0)) ** 2).sum()
    again, _ = kmeans.kmeans_centers(data, 6, 0, 100, 8)
    assert np.allclose(found, again)
    labels = [r.cluster for r in kmeans.kmeans_labels(rows, 6).orderBy("id").collect()]
    assert len({(c, i // 50) for i, c in enumerate(labels)}) == 6
    assert kmeans.kmeans_labels(rows.limit(2), 3, starts=2).count() == 2


def test_sparse_subspace_clusterings(spark):
    union = union_of_subspaces(spark, k=3, dim=20, width=2, each=25, noise=1e-4, seed=5).persist()
    df = union.select("id", "features")
    found = {"omp": ssc.omp_coefficients(df, 3, 1e-6), "admm": ssc.admm_coefficients(df, SscAdmmParams(n_clusters=3), 60), "convex": ssc.convex_coefficients(df, SscConvexParams(n_clusters=3))}
    for name, c in found.items():
        label = {r.id: r.true_label for r in union.collect()}
        size = {True: 0.0, False: 0.0}
        for r in c.collect():
            size[label[r.row_id] == label[r.col_id]] += abs(r.coef)
        assert size[True] > 5 * size[False]  # points are expressed by their own subspace
        if name == "admm":  # the few atoms of the pursuit may leave a subspace in several pieces
            w = spectral.adjacency(c).persist()
            assert accuracy(spectral.kmeans_labels(spectral.embedding(w, union.select("id"), 3), 3, starts=3), union) > 0.8


@pytest.mark.parametrize("outliers,noise,affine", [(True, True, False), (True, False, True), (False, True, True), (False, False, False)])
def test_convex_programs_by_few_atoms_equal_all_atoms(spark, monkeypatch, outliers, noise, affine):
    monkeypatch.setattr(convex, "FIRST", 4)
    monkeypatch.setattr(convex, "MORE", 3)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 6))
    df = spark.createDataFrame([(7 * i, x[i].tolist()) for i in range(60)], "id long, features array<double>").persist()
    params = SscConvexParams(use_outliers=outliers, use_noise=noise, use_affine=affine)
    got = np.zeros((60, 60))
    for r in ssc.convex_coefficients(df, params, "id % 35 = 0").collect():
        got[r.row_id // 7, r.col_id // 7] = r.coef
    for i in range(0, 60, 5):
        le, lz = ssc.convex_scales(df, params)
        want = convex_point(x, i, le, lz, affine)
        assert cost(x, i, got[:, i], le, lz) <= cost(x, i, want, le, lz) + 1e-6 and (not affine or abs(got[:, i].sum() - 1) < 1e-6)
        if not noise and not outliers:
            assert np.allclose(x.T @ got[:, i], x[i], atol=1e-6)


def test_convex_rounds_store_nothing(spark, monkeypatch):
    """Many rounds store no more than the packed points; atoms in a file, several programs at once and more parts give the same solutions."""
    monkeypatch.setattr(convex, "FIRST", 2)
    monkeypatch.setattr(convex, "MORE", 1)
    x = np.random.default_rng(9).standard_normal((70, 6))
    x[50] = x[3]
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").persist()
    stored, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: stored.append(1) or checkpoint(self, *a, **k))
    one = {r.id: r for r in convex.convex_solutions(df, 2.0, 30.0, False).collect()}
    assert len(one) == 70 and len(stored) <= 2 and all(r.gap < 1e-6 for r in one.values())
    for i, r in one.items():
        product = np.abs(x @ np.array(r.dual))
        product[i // 7] = 0
        assert product.max() <= 1 + 1e-4 and i not in r.chosen and 0 not in r.coef
    monkeypatch.setattr(convex, "HELD_BYTES", 100)
    programs = [(2.0, 30.0, False), (0.0, 30.0, True)]
    both = convex.several_solutions(df, programs, "id % 14 = 0").persist()
    for r in both.where("program = 0").collect():
        assert np.allclose(r.dual, one[r.id].dual, atol=1e-4)
    products = {(r.id, r.program): r.score for r in convex.largest_products(df, both, programs).collect()}
    for r in both.collect():
        product = np.abs(x @ np.array(r.dual[:6]) + (r.dual[6] if r.program else 0))
        product[r.id // 7] = 0
        assert np.isclose(products[r.id, r.program], product.max()) and product.max() <= 1 + 1e-4
    assert both.count() == len(products) == 70


@pytest.mark.parametrize("le", [0.0, 3.0])
def test_affine_programs_are_optimal_among_near_copies(spark, le):
    rng = np.random.default_rng(0)
    b = rng.standard_normal((20, 12))
    x = np.vstack([b + 1e-3 * rng.standard_normal(b.shape) for _ in range(3)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    found = convex.convex_solutions(df, le, 2e4, True).collect()
    assert len(found) == 60
    for r in found:
        product = np.abs(x @ np.array(r.dual[:-1]) + r.dual[-1])
        product[r.id] = 0
        assert product.max() <= 1 + 1e-4 and r.gap <= 1e-6 and abs(sum(r.coef) - 1) < 1e-6


@pytest.mark.parametrize("affine", [False, True])
def test_admm_points_beyond_memory_stay_in_a_file(spark, monkeypatch, affine):
    """No size of all points is refused, and what a task holds of them is bounded; the coefficients are the same."""
    x = np.random.default_rng(13).standard_normal((300, 6))
    df = spark.createDataFrame([(11 * i % 301, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3).persist()
    got = lambda: {(r.row_id, r.col_id): round(r.coef, 9) for r in ssc.admm_coefficients(df, SscAdmmParams(use_affine=affine), 60).collect()}
    monkeypatch.setattr(pairing, "BLOCK", 64)
    want = got()
    monkeypatch.setattr("flatspan.frame.MAX_BROADCAST_BYTES", 1000)
    monkeypatch.setattr(ssc, "HELD_BYTES", 1000)
    monkeypatch.setattr(ssc, "ROW_BYTES", 8 * 300 * 5)
    assert want and got() == want


def test_pursuit_keeps_one_state_only(spark, monkeypatch):
    """The atoms of a step go when the next step's are stored, and the last ones with the coefficients."""
    df = vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(14).standard_normal((80, 8)))], "k long, x array<double>"), "k", "x").persist()
    checkpoint, stored, live, most = DataFrame.checkpoint, [], set(), []
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: stored.append(self.columns) or checkpoint(self, *a, **k))
    put = ssc.stored_for_now

    def counted(frame):
        table, drop = put(frame)
        live.add(number := len(most))
        most.append(len(live))
        return table, lambda: live.discard(number) or drop()

    monkeypatch.setattr(ssc, "stored_for_now", counted)
    assert ssc.omp_coefficients(df, 5, 1e-6).count() >= 80
    assert len(most) == 5 and max(most) == 2 and not live and not any("atoms" in c for c in stored)


def test_stored_frames_leave_no_shuffles(spark):
    setting = spark.conf.get(runtime.RELEASE, None)
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: held.getAllFiles().mkString(",").count("shuffle_")
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = files()
    stored = runtime.cut_lineage(df)
    table, drop = runtime.stored_for_now(df)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(runtime.RELEASE, None) == setting
    assert stored.count() == table.count() == 7
    drop()


def test_penalty_scale_compares_few_points_with_all(spark, monkeypatch):
    x = np.random.default_rng(10).standard_normal((90, 5))
    x[60:] = x[:30]
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    score = np.abs(x @ x.T)
    np.fill_diagonal(score, 0)
    monkeypatch.setattr(pairing.packed, "__defaults__", ("f8", 10))
    monkeypatch.setattr(ssc, "LOWEST", 3, raising=False)
    asked, partners = [], ssc.top_partners
    monkeypatch.setattr(ssc, "top_partners", lambda q, a, k: asked.append(q.count() * a.count()) or partners(q, a, k))
    assert np.isclose(ssc.penalty_scale(df), score.max(axis=1).min()) and sum(asked) < 90 * 9 * 0.7


def cost(x, i, c, le, lz):
    r = x[i] - x.T @ c
    e = np.sign(r) * np.maximum(np.abs(r) - le / lz, 0) if le and lz else (r if le else 0 * r)
    return np.abs(c).sum() + le * np.abs(e).sum() + lz / 2 * ((r - e) ** 2).sum()


def test_pursuit_and_correlations_over_blocks(spark, monkeypatch):
    """Blocks of a few rows give what whole matrices give: partners, planted combinations, early stop, scales."""
    monkeypatch.setattr(pairing.packed, "__defaults__", ("f8", 7))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40], x[41], x[42] = 2 * x[3] - x[17], x[5], x[5]  # equal rows tie
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3)
    got = ssc.gram_top(df, 4).collect()
    score = np.abs(x @ x.T)
    np.fill_diagonal(score, -1)
    for i in range(60):
        own = sorted((r for r in got if r.id == i * 3), key=lambda r: r["rank"])
        want = np.sort(score[i])[::-1][:4]
        assert np.allclose([r.score for r in own], want) and all(np.isclose(score[i, r.other // 3], r.score) for r in own)
    tied = [r.other for r in sorted((r for r in got if r.id == 15), key=lambda r: r["rank"])][:2]
    assert tied == [123, 126]
    coef = {(r.row_id // 3, r.col_id // 3): r.coef for r in ssc.omp_coefficients(df, 5, 1e-10).collect()}
    assert {a: round(c, 9) for (a, p), c in coef.items() if p == 40} == {3: 2.0, 17: -1.0}  # stops after two atoms
    p = np.hstack([x.T, np.eye(30) * np.abs(x).sum(axis=1).max() / 20])
    corr = np.abs(p.T @ x.T)
    corr[np.arange(60), np.arange(60)] = 0
    assert np.isclose(ssc.admm_scale(df, 20, True), corr.max(axis=0).min()) and np.isclose(ssc.admm_scale(df, 20, False), score.max(axis=1).min())


def test_strongest_partner_found_in_single_precision(monkeypatch):
    """The best partner is the one that double precision gives: near ties, copies, the point itself, zeros, sizes far apart; few pairs need double precision."""
    rng = np.random.default_rng(11)
    y = rng.standard_normal((500, 16))
    y[100:130] = y[0] * (1 + 1e-10 * np.arange(30))[:, None]
    y[200], y[201], y[300] = y[7], y[7], 0
    x = np.vstack([y[:320], np.zeros((2, 16)), 1e-25 * y[3:5], 1e25 * y[5:6]])
    ids, other = np.arange(len(x)), rng.permutation(500)
    slow, whole = [], pairing._strongest
    monkeypatch.setattr(pairing, "_strongest", lambda i, *a: slow.append(len(i)) or whole(i, *a))
    got = pairing._strongest_one(ids, x, other, y[other]).sort_values("id")
    want = whole(ids, x, other, y[other], 1, False).sort_values("id")
    assert (got.id.to_numpy() == want.id.to_numpy()).all() and (got.other.to_numpy() == want.other.to_numpy()).all()
    assert np.allclose(got.score, want.score, rtol=1e-12) and sum(slow) < len(x) / 2


def test_pursuit_of_many_points_at_once():
    """Least squares of all points together are those of each, atoms that repeat or vanish included."""
    rng = np.random.default_rng(13)
    points, atoms = rng.standard_normal((20, 8)), rng.standard_normal((20, 3, 8))
    atoms[3, 2], atoms[4, 1] = atoms[3, 0], 0
    for p, a, c in zip(points, atoms, least_squares(points, atoms), strict=True):
        assert np.allclose(c, np.linalg.lstsq(a.T, p, rcond=None)[0])


def test_blocks_travel_a_bounded_number_of_times(spark):
    """Each pair of blocks meets once, and a task takes a whole part of either side, however many blocks there are."""
    assert [pairing.tiles(b, s) for b, s in ((3, 100), (150, 300 << 20), (10_000, 64 << 30))] == [3, pairing.SIDE, 1024]
    df = spark.createDataFrame([(i, [float(i)]) for i in range(60)], "id long, features array<double>")
    blocks = pairing.packed(df, "features", rows=3)
    assert blocks.count() >= 20 and blocks.select("block").distinct().count() == blocks.count()
    compare = lambda i, x, j, y: pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "same": (x == y.T).ravel()})
    found = pairing.against(blocks, blocks, compare, "i long, j long, same boolean").withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 3600 and all(r.same == (r.i == r.j) for r in found) and len({(r.i, r.j) for r in found}) == 3600
    assert len({r.task for r in found}) == pairing.SIDE**2


def test_ensemble_runs_match_single_runs(spark, union):
    """All runs at once give the labels that each run gives alone."""
    params = EnsembleParams(n_clusters=3, dim_subspaces=1, n_base=10)
    got = {r.id: r.labels for r in ks.base_labels(union, params).collect()}
    seeds = np.random.RandomState(0).randint(0, 2**32 - 1, 10, dtype=np.uint32)
    for k in (0, 7):
        alone = ks.KSubspaces(n_clusters=3, dim_subspaces=1, random_seed=int(seeds[k])).fit(union, iterations=100)
        assert {r.id: r.cluster for r in alone.transform(union).collect()} == {i: labels[k] for i, labels in got.items()}


def test_ensemble_runs_send_no_sums_from_step_to_step(spark, monkeypatch):
    """The runs take all steps in the tasks of their part, from memory or a file; runs whose sums are too many for a task give the same labels."""
    rng = np.random.default_rng(12)
    df = vectors(spark.createDataFrame([(3 * i, rng.standard_normal(6).tolist()) for i in range(300)], "k long, x array<double>"), "k", "x").repartition(3)
    params, steps, found = EnsembleParams(n_clusters=5, dim_subspaces=2, n_base=10), [], []
    step = ks.step
    monkeypatch.setattr(ks, "step", lambda *a: steps.append(1) or step(*a))
    for held in (64 << 20, 2000, 1000):
        monkeypatch.setattr(ks, "HELD_BYTES", held)
        found.append({r.id: r.labels for r in ks.base_labels(df, params).collect()})
        assert bool(steps) == (held == 1000)
    assert found[0] == found[1] == found[2]


def test_owl_closed_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], 2.0), (2, [2.0], 3.0)], "id long, features array<double>, label double")
    zero = dict(weight_max_val=0.0, weight_min_val=0.0, tol=1e-8)
    for extra, coef, intercept, rate in (({}, 1, 1, 0.5), ({"normalize": True}, 1, 1, 0.5), ({"fit_intercept": False}, 1.6, 0, 0.1)):
        m = OwlRegression(**zero, **extra, learning_rate=rate).fit(df)
        assert abs(m.coef[0] - coef) < 1e-2 and abs(m.intercept - intercept) < 1e-2
    new = spark.createDataFrame([(1, [0.0]), (2, [1.5]), (3, [3.0])], "id long, features array<double>")
    m = OwlRegression(**zero, learning_rate=0.5).fit(df)
    assert np.allclose([r.prediction for r in m.transform(new).orderBy("id").collect()], [1, 2.5, 4], atol=0.02)
    m.save(spark, str(tmp_path / "m"))
    assert OwlModel.load(spark, str(tmp_path / "m")).intercept == m.intercept
    with pytest.raises(Exception, match="features must have"):
        m.transform(spark.createDataFrame([(1, [0.0, 1.0])], "id long, features array<double>")).collect()


def test_owl_recovers_coefficients(spark):
    df = linear_data(spark)
    for w in ({}, {"weight_max_val": 0.01, "weight_min_val": 0.005, "weight_min_off": 4}):
        m = OwlRegression(**w, learning_rate=1.0, tol=1e-8).fit(df)
        want = np.array([1.0, -2.0, 0.5, 3.0, 1.5])
        assert np.linalg.norm(m.coef - want) < 0.2 * np.linalg.norm(want) and abs(m.intercept) < 0.1
        assert m.loss_history[-1] <= m.loss_history[0]
    with pytest.raises(FloatingPointError):
        OwlRegression(learning_rate=1e6).fit(df)


def test_svr_is_robust(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = x @ np.array([1.0, -2.0, 3.0]) + 4
    y[::10] += 100
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(400)], "features array<double>, label double")
    m = LinearSVR().fit(df)
    assert np.allclose(m.coef, [1, -2, 3], atol=0.3) and abs(m.intercept - 4) < 0.5 and 0 <= m.gap <= 1e-3


@pytest.mark.parametrize("epsilon", [0.0, 0.4])
def test_svr_gap_is_a_bound(spark, epsilon):
    """No point of a long descent on the objective itself, in the same standardised columns, is lower than the gap allows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3)) * [1, 5, 0.2] + 2
    y = x @ np.array([1.0, -0.4, 3.0]) + rng.standard_t(2, 300)
    df = spark.createDataFrame([(np.append(x[i], [7.0, x[i, 0]]).tolist(), float(y[i])) for i in range(300)], "features array<double>, label double")
    m = LinearSVR(epsilon=epsilon, tol=1e-4).fit(df)  # with a constant column and a repeated one
    assert 0 <= m.gap <= 1e-4 and np.isfinite(m.coef).all() and m.coef[3] == 0
    wide = np.column_stack([x, np.full(300, 7.0), x[:, 0]])
    scale, size = wide.std(axis=0), y.std()
    scale[3] = 1
    u, v = (wide - wide.mean(axis=0)) / scale, (y - y.mean()) / size
    cost = lambda w, b: w @ w / 2 / 300 + np.maximum(np.abs(u @ w + b - v) - epsilon / size, 0).mean()
    w, b = m.coef * scale / size, (m.intercept + wide.mean(axis=0) @ m.coef - y.mean()) / size
    own, best = cost(w, b), np.inf
    for k in range(20_000):
        r = u @ w + b - v
        d = np.sign(r) * (np.abs(r) > epsilon / size)
        w, b = w - 0.02 / (1 + k / 50) * (u.T @ d / 300 + w / 300), b - 0.02 / (1 + k / 50) * d.mean()
        best = min(best, cost(w, b))
    assert own * (1 - m.gap) <= best + 1e-12 and own <= best * (1 + 1e-4)


def test_tracker(spark, tmp_path):
    rng = np.random.default_rng(2)
    true = np.linalg.qr(rng.standard_normal((15, 2)))[0]
    rows = [(i, (true @ rng.standard_normal(2)).tolist()) for i in range(120)]
    rows[5][1][3] = float("nan")
    df = vectors(spark.createDataFrame(rows, "k long, x array<double>"), "k", "x")
    model = SubspaceTracker(rank=2, max_train_cycles=2).fit(df, chunk_rows=50)
    again = SubspaceTracker(rank=2, max_train_cycles=2).fit(df.repartition(6))
    assert np.allclose(model.state.basis, again.state.basis)  # chunks and partitions don't matter
    out = model.transform(df).collect()
    for r in out:
        assert np.allclose(np.add(r.low_rank, r.sparse), r.features, equal_nan=True)
    fit = np.mean([np.linalg.norm(r.sparse) / np.linalg.norm(r.features) for r in out if r.id != 5])
    assert fit < 0.35
    model.save(spark, str(tmp_path / "t"))
    assert np.allclose(SubspaceTrackerModel.load(spark, str(tmp_path / "t")).state.basis, model.state.basis)
    assert model.subspace(spark).count() == 15 and not np.allclose(model.advance(df).state.basis, model.state.basis)


def test_widths_must_agree(spark):
    with pytest.raises(ValueError):
        width_of(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>"))


@pytest.mark.parametrize("name", ["eksub_fit", "ssc_admm_fit", "ssc_convex_fit"])
def test_whole_learners_label_every_point(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    ids = queries.embedded(spark, sf).select("id").toPandas()["id"]
    assert sorted(got["id"]) == sorted(ids) and set(got["cluster"]) <= set(range(10)) and got["cluster"].nunique() > 1


@pytest.mark.parametrize("stop", ["global", "block"])
def test_admm_passes_equal_one_run(spark, monkeypatch, stop):
    monkeypatch.setattr(ssc, "BLOCK", 8)
    monkeypatch.setattr(ssc, "STEPS", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 5))
    df = spark.createDataFrame([(3 * i, x[i].tolist()) for i in range(30)], "id long, features array<double>").persist()
    params = SscAdmmParams(alpha=20, epsilon=0.02)
    problem = AdmmProblem(x, 20.0, False, True, ssc.admm_scale(df, 20, True))
    errors = problem.solve(np.arange(30), 199)[1].max(axis=1)
    want = problem.solve(np.arange(30), int((errors <= 0.02).argmax()) + 1 if (errors <= 0.02).any() else 199)[0]
    got = np.zeros((30, 30))
    for r in ssc.admm_coefficients(df, params, stop=stop).collect():
        got[r.row_id // 3, r.col_id // 3] = r.coef
    assert (errors <= 0.02).any() and np.allclose(got, want, atol=1e-9 if stop == "global" else 0.2)


def test_embedding_in_several_blocks_and_their_number(spark, monkeypatch):
    """Few blocks for sparse tables, more where their cells would be crowded; several give the eigenvectors of one."""
    assert [krylov.block_count(n, e) for n, e in ((0, 0), (10_256, 10**6), (615_384, 6 * 10**6), (4096, 2**24), (10_256, 10**8))] == [1, 1, 38, 2, 6]
    monkeypatch.setattr(krylov, "ROWS", 16)
    monkeypatch.setattr(krylov, "MOST_ROWS", 16)
    assert krylov.block_count(60, 500) == 4
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((60, 60)) * (rng.random((60, 60)) < 0.3), 1)
    a = a + a.T
    found, values = spectral.smallest_directions(coo(spark, a), spark.range(60), 3)
    d = 1 / np.sqrt(a.sum(axis=1) + 2.3e-16)
    want, vectors = np.linalg.eigh(np.eye(60) - d[:, None] * a * d)
    got = np.array([r.vector for r in found.orderBy("id").collect()])
    assert np.abs(values - want[:3]).max() < 1e-8 and np.abs(got @ got.T - vectors[:, :3] @ vectors[:, :3].T).max() < 1e-4


def test_a_pipeline_without_test_rows_learns_once(spark, monkeypatch):
    """Clusterings label one frame once, where train and test are the same."""
    from flatspan.plans import pipelines

    asked = []
    monkeypatch.setattr(ssc.SparseSubspaceOMP, "transform", lambda self, df: asked.append(1) or df.select("id", F.lit(0).alias("cluster")))
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    p = pipelines.clustering("omp", "ssc_omp", "vec_id", "embedding", n_clusters=2, sparsity_level=3)
    assert p.run(table).count() == 5 and len(asked) == 1
    assert p.run(table, table.limit(2)).count() == 2 and len(asked) == 3
