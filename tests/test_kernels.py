from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flatspan.functions import admm
from flatspan.functions import kernels as k
from flatspan.functions import tracking as tr
from flatspan.params import EnsembleParams, KSubspacesParams, OwlParams, SscAdmmParams, SscOmpParams

RNG = np.random.default_rng(0)


def test_params_are_checked_and_round_trip():
    for bad in (lambda: KSubspacesParams(n_clusters=1), lambda: EnsembleParams(n_base=9), lambda: SscAdmmParams(alpha=5), lambda: SscOmpParams(sparsity_level=2), lambda: OwlParams(weight_max_off=3, weight_min_off=1), lambda: OwlParams(weight_min_val=1.0)):
        with pytest.raises(ValueError):
            bad()
    p = EnsembleParams(n_clusters=7, thresh=-1)
    assert EnsembleParams.from_json(p.to_json()) == p


def test_residuals_and_bases():
    x = RNG.standard_normal((30, 6))
    bases = np.stack([k.orthonormal(np.random.RandomState(s), 6, 2) for s in range(3)])
    want = [[np.linalg.norm(v - u @ u.T @ v) for u in bases] for v in x]
    assert np.allclose(k.residuals(x, bases), want)
    s = x.T @ x
    u = k.top_eigenvectors(s, 2)
    assert np.allclose(u.T @ u, np.eye(2)) and np.isclose(np.trace(u.T @ s @ u), np.sort(np.linalg.eigvalsh(s))[-2:].sum())
    assert np.allclose(k.top_eigenvectors(np.zeros((4, 4)), 2), np.eye(4)[:, :2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8), st.integers(0, 5))
def test_prox_owl_is_the_minimiser(z, seed):
    z = np.array(z)
    w = np.sort(np.random.default_rng(seed).uniform(0, 2, len(z)))[::-1]
    cost = lambda b: 0.5 * ((b - z) ** 2).sum() + np.sort(np.abs(b))[::-1] @ w
    best = k.prox_owl(z, w)
    rng = np.random.default_rng(seed)
    for step in (1e-3, 1e-1, 1.0):
        for _ in range(30):
            assert cost(best) <= cost(best + step * rng.standard_normal(len(z))) + 1e-9
    d = np.sort(np.abs(z))[::-1] - w
    minimax = [max(0, min(max(d[s : e + 1].mean() for e in range(r, len(d))) for s in range(r + 1))) for r in range(len(d))]
    assert np.allclose(np.sort(np.abs(best))[::-1], minimax)


def test_owl_weights():
    assert np.allclose(k.owl_weights(6, 1.0, 1, 0.2, 4), [1, 1, 1 - 0.8 / 3, 1 - 1.6 / 3, 0.2, 0.2])
    assert np.allclose(k.owl_weights(3, 0.5, 0, 0.5, 0), 0.5)
    assert np.allclose(k.owl_weights(4, 1.0, 0, 0.1, 0), [1, 0.1, 0.1, 0.1])  # equal offsets: a step
    assert np.allclose(k.owl_weights(4, 1.0, 2, 0.1, 2), [1, 1, 1, 0.1])
    assert np.allclose(k.owl_weights(3, 1.0, 0, 0.1, 1), [1, 0.1, 0.1])


def test_what_atoms_leave_over():
    x = RNG.standard_normal((2, 30))
    y = 2 * x[0] - x[1]
    assert np.allclose(k.left_over(y / np.linalg.norm(y), x), 0)
    rest = k.left_over(y / np.linalg.norm(y), x[:1])
    assert abs(rest @ x[0]) < 1e-12 and rest @ rest > 0.01


def low(x, alpha, outliers):
    """The smallest of the largest correlations, from the whole dictionary."""
    y = x.T
    p = np.hstack([y, np.eye(len(y)) * np.abs(y).sum(axis=0).max() / alpha]) if outliers else y
    corr = np.abs(p.T @ y)
    corr[np.arange(len(x)), np.arange(len(x))] = 0
    return corr.max(axis=0).min()


def reference_admm(x, alpha, affine, outliers, steps):
    """The same iteration with the full inverse of the dictionary's size."""
    y = x.T
    d, n = y.shape
    gamma = alpha / np.abs(y).sum(axis=0).max() if outliers else 0
    p = np.hstack([y, np.eye(d) / gamma]) if outliers else y
    def zd(m):
        m = m.copy()
        m[np.arange(n), np.arange(n)] = 0
        return m
    mu1, mu2 = alpha / np.abs(zd(p.T @ y)).max(axis=0).min(), alpha
    one = np.concatenate([np.ones(n), np.zeros(p.shape[1] - n)])[:, None]
    a = np.linalg.pinv(mu1 * p.T @ p + mu2 * np.eye(p.shape[1]) + (mu2 * one @ one.T if affine else 0))
    c, l1, l2, l3 = np.zeros((p.shape[1], n)), np.zeros((d, n)), np.zeros((p.shape[1], n)), np.zeros((1, n))
    for _ in range(steps):
        right = mu1 * p.T @ (y + l1 / mu1) + mu2 * (c - l2 / mu2)
        if affine:
            right = right + mu2 * one @ (1 - l3 / mu2)
        z = zd(a @ right)
        c = zd(k.soft(z + l2 / mu2, 1 / mu2))
        if outliers:
            l1 = l1 + mu1 * (y - p @ z)
        l2 = l2 + mu2 * (z - c)
        if affine:
            l3 = l3 + mu2 * (one.T @ z - 1)
    return c[:n]


@pytest.mark.parametrize("affine", [False, True])
@pytest.mark.parametrize("outliers", [False, True])
def test_admm_matches_the_full_inverse(affine, outliers):
    x = RNG.standard_normal((25, 8))
    problem = k.AdmmProblem(x, 20.0, affine, outliers, low(x, 20.0, outliers))
    whole, errors = problem.solve(np.arange(25), 15)
    assert np.allclose(whole, reference_admm(x, 20.0, affine, outliers, 15), atol=1e-8)
    a, ea = problem.solve(np.arange(0, 10), 15)
    b, eb = problem.solve(np.arange(10, 25), 15)
    assert np.allclose(np.hstack([a, b]), whole) and np.allclose(np.maximum(ea, eb), errors)


@pytest.mark.parametrize("affine", [False, True])
@pytest.mark.parametrize("le,lz", [(0.0, 0.0), (0.0, 30.0), (2.0, 0.0), (2.0, 30.0)])
def test_convex_programs_are_optimal(le, lz, affine):
    """Feasible, and no feasible move lowers the cost."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 6))
    c = k.convex_point(x, 4, le, lz, affine, 1e-9, 20000)
    assert c[4] == 0 and (not affine or abs(c.sum() - 1) < 1e-4)
    if not le and not lz:
        assert np.allclose(x.T @ c, x[4], atol=1e-4)

    def cost(c):
        r = x[4] - x.T @ c
        if le and lz:  # best split of the rest into sparse and small parts
            e = k.soft(r, le / lz)
            return np.abs(c).sum() + le * np.abs(e).sum() + lz / 2 * ((r - e) ** 2).sum()
        return np.abs(c).sum() + (le * np.abs(r).sum() if le else 0) + (lz / 2 * (r**2).sum() if lz else 0)

    base = cost(c)
    basis = np.eye(20)[np.arange(20) != 4]
    for _ in range(400):
        move = rng.standard_normal(19) @ basis * 10.0 ** rng.uniform(-4, 0)
        if affine:
            move -= move.sum() / 19 * (np.arange(20) != 4)
        if not le and not lz:
            full = np.vstack([x[np.arange(20) != 4].T, np.ones((1, 19)) if affine else np.empty((0, 19))])
            own = move[np.arange(20) != 4]
            move[np.arange(20) != 4] = own - np.linalg.pinv(full) @ (full @ own)
        assert cost(c + move) >= base - 1e-4


def test_tracker_step_keeps_an_orthonormal_basis_and_finds_the_subspace():
    rng = np.random.default_rng(1)
    true = np.linalg.qr(rng.standard_normal((30, 2)))[0]
    o = tr.TrackerOptions(rank=2)
    s = tr.start(o, 30)
    for _ in range(300):
        x = true @ rng.standard_normal(2) * 3
        x[rng.integers(0, 30, 2)] += rng.choice([-8, 8], 2)
        s, low = tr.step(s, x, o, rng)
        assert np.allclose(s.basis.T @ s.basis, np.eye(2), atol=1e-8)
    x = true @ np.array([1.0, -2.0])
    assert np.linalg.norm(x - s.basis @ s.basis.T @ x) < 0.3 * np.linalg.norm(x)
    again = tr.TrackerState.from_row(s.to_row())
    assert np.allclose(again.basis, s.basis) and again.level == s.level


def test_tracker_guards():
    for rank in (1, 3):
        o = tr.TrackerOptions(rank=rank, subsampling=0.5)
        s = tr.start(o, 8)
        for x in (np.zeros(8), np.full(8, np.nan), np.array([1.0, np.nan, 2, 3, np.nan, 1, 0, 5])):
            s, low = tr.step(s, x, o, np.random.default_rng(0))
            assert s.basis.shape == (8, rank) and np.isfinite(s.basis).all() and np.isfinite(low).all()
    with pytest.raises(ValueError):
        tr.start(tr.TrackerOptions(rank=9), 8)


@pytest.mark.parametrize("affine", [False, True])
@pytest.mark.parametrize("outliers", [False, True])
@pytest.mark.parametrize("room", [48 << 20, 0])
def test_admm_of_few_entries_takes_the_same_steps(monkeypatch, affine, outliers, room):
    """The steps with all entries, in two passes of stored state, also where no view has room; errors are on the same side of epsilon."""
    monkeypatch.setattr(admm, "VIEW_BYTES", min(room, 8 << 20))
    monkeypatch.setattr(admm, "MOST_BYTES", room)
    x = np.random.default_rng(4).standard_normal((120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    args = (20.0 if outliers else 800.0, affine, outliers, low(x, 20.0 if outliers else 800.0, outliers))
    want, errors = k.AdmmProblem(x, *args).solve(np.arange(120), 40)
    few, got, told = admm.FewAdmm(x, *args), np.zeros((120, 120)), []
    state = few.begin(120)
    for steps in (15, 25):
        state, worst = few.advance(np.arange(120), state, steps, 1e-3, 32)
        state, told = admm.FewState.from_row(state.to_row(), 120), [*told, *worst]
    got[state.i, state.k] = state.now
    assert np.allclose(got, want, atol=1e-9) and (got != 0).any() and not got.diagonal().any()
    assert ((np.array(told) > 1e-3) == (errors.max(axis=1) > 1e-3)).all()
    assert few.begin(120).v.shape[0] <= 5 * 7 + 1  # no number for every other point


def weights_by_projection(u, x, rho, most, tol=1e-8):
    """The ADMM of the tracker as it is written down, with a projection from a decomposition of u."""
    left, size, right = np.linalg.svd(u, full_matrices=False)
    kept = size > 1e-15 * max(u.shape) * size.max(initial=0.0)
    span, back = left[:, kept], right[kept].T / size[kept]
    sparse, scaled = np.zeros_like(x), np.zeros_like(x)
    for penalty in rho ** np.arange(1.0, most + 2):
        inside = span.T @ (x - sparse + scaled)
        rest = x - span @ inside
        sparse = k.soft(rest + scaled, 1 / penalty)
        broken = rest - sparse
        scaled = (scaled + broken) / rho
        if np.linalg.norm(broken) < tol:
            break
    return back @ inside, sparse, scaled * penalty * rho


@pytest.mark.parametrize("d,r", [(3, 2), (4, 1), (6, 2), (8, 3), (64, 3), (2, 2), (1, 1)])
def test_tracker_weights_are_those_of_the_written_steps(d, r):
    rng = np.random.default_rng(d)
    for most in (1, 5, 20):
        u, x = np.linalg.qr(rng.standard_normal((d, d)))[0][:, :r], rng.standard_normal(d) * 3
        for part in (slice(None), slice(0, max(1, d - 1))):  # all coordinates, and all but one
            for got, want in zip(tr.l1_weights(u[part], x[part], 1.8, most), weights_by_projection(u[part], x[part], 1.8, most), strict=True):
                assert np.allclose(got, want, atol=1e-7 * max(1, np.abs(want).max()))
    zero, flat = np.zeros((4, 2)), np.tile(rng.standard_normal((4, 1)), 2)
    for u in (zero, flat):
        w, sparse, _ = tr.l1_weights(u, np.ones(4), 1.8, 20)
        assert np.allclose(w, weights_by_projection(u, np.ones(4), 1.8, 20)[0], atol=1e-6) and np.isfinite(sparse).all()
    assert tr.draws(tr.TrackerOptions(), 5) is None and tr.draws(tr.TrackerOptions(subsampling=0.5), -5) is not None


def test_nearest_point_within_all_rows_is_the_programs_dual():
    """The dual active set gives the dual vector and coefficients of the smooth programs, from nothing and from what held for fewer rows."""
    rng = np.random.default_rng(12)
    for le in (0.0, 1.5):
        a, y, lz = rng.standard_normal((40, 8)), rng.standard_normal(8), 12.0
        a[7] = a[3]
        rows = np.vstack([np.eye(8), a]) if le else a
        costs = np.concatenate([np.full(len(rows) - 40, le), np.ones(40)])
        few, at, size = k.nearest_within(rows[:20], costs[:20], lz * y)
        nu, at, size = k.nearest_within(rows, costs, lz * y, (at, np.sign(size)))
        assert np.allclose(nu, k.nearest_within(rows, costs, lz * y)[0]) and (np.abs(rows @ nu) <= costs + 1e-9).all() and np.allclose(nu, lz * y - size @ rows[at])
        want, dual, _ = k.weighted_l1(rows.T, costs, y, lz, None, 1e-10, 20000)
        v = np.zeros(len(rows))
        v[at] = size / lz
        assert np.allclose(nu, dual, atol=1e-6)
        assert np.isclose(costs @ np.abs(v) + ((y - v @ rows) ** 2).sum() * lz / 2, costs @ np.abs(want) + ((y - want @ rows) ** 2).sum() * lz / 2)


@pytest.mark.parametrize("constant", [0.0, 0.1])
def test_three_numbers_take_the_same_steps_in_plain_numbers(monkeypatch, constant):
    """Each step from the same state, with holes; later states differ only as rounding does. No step of a whole vector goes through the general way."""
    o, rng = tr.TrackerOptions(constant_step=constant), np.random.default_rng(15)
    x = rng.standard_normal((300, 3)) @ np.diag([20.0, 5.0, 9.0]) + [25, 10, 9]
    x[::50, 1] = np.nan
    state, calls, step = tr.start(o, 3), [], tr.step
    monkeypatch.setattr(tr, "step", lambda s, v, *a: calls.append(np.isnan(v).any()) or step(s, v, *a))
    for i, v in enumerate(x):
        want = step(state, v, o, None)[0]
        got = tr.advanced(state, [i], x[i : i + 1], o)
        assert np.allclose(got.basis, want.basis, atol=1e-8) and (got.level, got.budget) == (want.level, want.budget) and np.isclose(got.mu, want.mu, atol=1e-6)
        assert np.isclose(got.scale, want.scale) and np.allclose(got.w, want.w, atol=1e-7)
        state = want
    assert len(calls) == 6 and all(calls)
    whole = tr.advanced(tr.start(o, 3), list(range(60)), x[:60], o)
    halves = tr.advanced(tr.advanced(tr.start(o, 3), list(range(25)), x[:25], o), list(range(25, 60)), x[25:60], o)
    assert np.array_equal(whole.basis, halves.basis) and whole.mu == halves.mu
