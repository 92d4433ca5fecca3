"""Numerical kernels on small arrays, called inside tasks and on model-sized data."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps


def soft(x: np.ndarray, eta: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - eta, 0)


def orthonormal(rng: np.random.RandomState, dim: int, width: int) -> np.ndarray:
    """Orthonormal basis of the span of a random Gaussian matrix."""
    return np.linalg.qr(rng.randn(dim, width))[0]


def top_eigenvectors(scatter: np.ndarray, width: int) -> np.ndarray:
    """Leading eigenvectors; of a zero matrix (an empty cluster) the first standard basis vectors."""
    if not scatter.any():
        return np.eye(len(scatter))[:, :width]
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    return vectors[:, np.argsort(-values, kind="stable")[:width]]


def residuals(x: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Distance of each row of x to each subspace: bases is clusters x dimensions x width, orthonormal."""
    own = np.einsum("ij,ij->i", x, x)[:, None]
    inside = x @ np.concatenate(list(bases), axis=1)  # one product for all
    inside = (inside * inside).reshape(len(x), len(bases), -1).sum(axis=2)
    return np.sqrt(np.maximum(own - inside, 0))


def owl_weights(dim: int, max_val: float, max_off: int, min_val: float, min_off: int) -> np.ndarray:
    """max_val up to and with max_off, then a straight line to min_val at min_off, and min_val from there (equal offsets: a step)."""
    place = np.arange(dim)
    ramp = max_val + (min_val - max_val) * (place - max_off) / max(min_off - max_off, 1)
    return np.where(place <= max_off, max_val, np.where(place >= min_off, min_val, ramp)).astype(float)


def non_increasing(y: np.ndarray) -> np.ndarray:
    """Least-squares fit by a non-increasing sequence: blocks of means, merged while they rise."""
    means: list[float] = []
    sizes: list[int] = []
    for v in y:
        mean, size = float(v), 1
        while means and means[-1] <= mean:
            mean = (mean * size + means[-1] * sizes[-1]) / (size + sizes[-1])
            size += sizes.pop()
            means.pop()
        means.append(mean)
        sizes.append(size)
    return np.repeat(means, sizes)


def prox_owl(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Prox of the ordered weighted L1 norm with non-increasing weights."""
    size = np.abs(z)
    order = np.argsort(-size, kind="stable")
    out = np.empty_like(size)
    out[order] = np.maximum(non_increasing(size[order] - weights), 0)
    return np.sign(z) * out


def owl_cost(gram: np.ndarray, xty: np.ndarray, yty: float, n: int, weights: np.ndarray, b: np.ndarray) -> float:
    """(1/n)|y - Xb|^2 + OWL(b)."""
    return float((yty - 2 * b @ xty + b @ gram @ b) / n + np.sort(np.abs(b))[::-1] @ weights)


def owl_gradient(gram: np.ndarray, xty: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
    """Gradient of (1/n)|y - Xb|^2."""
    return (2 / n) * (gram @ b - xty)


def fista(gram: np.ndarray, xty: np.ndarray, yty: float, n: int, weights: np.ndarray, rate: float, tol: float, most: int) -> tuple[np.ndarray, list[float]]:
    """Accelerated proximal gradient on (1/n)|y - Xb|^2 + OWL(b), from the Gram matrix alone: (b, cost by step)."""
    old = z = np.zeros(len(gram))
    t_old, history = 1.0, []
    for _ in range(most):
        new = prox_owl(z - rate * owl_gradient(gram, xty, n, z), rate * weights)
        if not np.isfinite(new).all():
            raise FloatingPointError("the steps diverge; take a smaller learning_rate")
        t = (1 + np.sqrt(1 + 4 * t_old * t_old)) / 2
        z = new + (t_old - 1) / t * (new - old)
        change = np.linalg.norm(new - old) / (np.linalg.norm(old) + 1e-10)
        if change < tol:
            return new, history
        old, t_old = new, t
        history.append(owl_cost(gram, xty, yty, n, weights, new))
    warnings.warn(f"coefficients still changed by more than {tol} after {most} steps", stacklevel=2)
    return old, history


def left_over(unit: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """What the normalised atoms (rows) leave of a normalised point, by least squares."""
    return left_over_all(unit[None], atoms[None])[0]


def least_squares(points: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """Coefficients of each point (a row) by its own atoms (rows of a matrix a point), the smallest ones where atoms depend on each other."""
    inverse = np.linalg.pinv(atoms, rcond=max(atoms.shape[1:]) * EPS)
    return np.matmul(points[:, None, :], inverse)[:, 0]


def left_over_all(units: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """What the normalised atoms of each normalised point leave of it, by least squares."""
    b = atoms / (np.linalg.norm(atoms, axis=2, keepdims=True) + EPS)
    return units - np.matmul(least_squares(units, b)[:, None, :], b)[:, 0]


@dataclass
class AdmmState:
    """Coefficients and multipliers of some points: what a step needs of the step before."""

    c: np.ndarray
    l2: np.ndarray
    l1: np.ndarray
    l3: np.ndarray


class AdmmProblem:
    """Sparse self-expression of the rows of x by ADMM; points are independent given one factor of size D.

    With outliers, the dictionary is the points and a scaled identity. The affine variant adds the constraint
    that coefficients sum to 1. The linear system's inverse is applied through a matrix of the dimensions' size
    (Woodbury), and low, the smallest over points of the largest |inner product| with another entry of the dictionary,
    is given, so no matrix of the points' number squared is ever made.
    """

    def __init__(self, x: np.ndarray, alpha: float, affine: bool, outliers: bool, low: float):
        y = x.T
        self.d, self.n = y.shape
        self.affine, self.outliers = affine, outliers
        self.gamma = alpha / np.abs(y).sum(axis=0).max() if outliers else 0.0
        self.p = np.hstack([y, np.eye(self.d) / self.gamma]) if outliers else y
        self.mu1, self.mu2 = alpha / low, alpha
        self.y = y
        self.ones = np.concatenate([np.ones(self.n), np.zeros(self.p.shape[1] - self.n)])
        big = np.vstack([self.p, np.sqrt(self.mu2 / self.mu1) * self.ones]) if affine else self.p
        self.big, self.core = big, np.linalg.inv(self.mu2 / self.mu1 * np.eye(len(big)) + big @ big.T)

    def inverse(self, m: np.ndarray) -> np.ndarray:
        return (m - self.big.T @ (self.core @ (self.big @ m))) / self.mu2

    def begin(self, k: int) -> AdmmState:
        """The state of k points before the first step."""
        return AdmmState(*(np.zeros(shape) for shape in ((self.p.shape[1], k), (self.p.shape[1], k), (self.d, k), (k,))))

    def advance(self, cols: np.ndarray, state: AdmmState, steps: int) -> tuple[AdmmState, np.ndarray]:
        """The state of the points ``cols`` so many steps on, and the largest error of each step over them."""
        y, p, mu1, mu2, k = self.y[:, cols], self.p, self.mu1, self.mu2, len(cols)
        own = (cols, np.arange(k))
        c, l2, l1, l3 = (x.copy() for x in (state.c, state.l2, state.l1, state.l3))
        errors = np.zeros((steps, 3))
        pty = p.T @ y
        for step in range(steps):
            right = mu1 * pty + mu2 * c - l2
            if self.outliers:
                right += p.T @ l1
            if self.affine:
                right += mu2 * np.outer(self.ones, 1 - l3 / mu2)
            z = self.inverse(right)
            z[own] = 0
            c = soft(z + l2 / mu2, 1 / mu2)
            c[own] = 0
            l2 += mu2 * (z - c)
            errors[step, 0] = np.abs(z - c).max()
            if self.outliers:
                by_points = self.y @ z[: self.n]
                clean = y - p[:, self.n :] @ z[self.n :]
                l1 += mu1 * (clean - by_points)
                size = np.linalg.norm(clean, axis=0)
                size[size == 0] = 1
                errors[step, 1] = np.linalg.norm((clean - by_points) / size, axis=0).max()
            if self.affine:
                short = self.ones @ z - 1
                l3 += mu2 * short
                errors[step, 2] = np.abs(short).max()
        return AdmmState(c, l2, l1, l3), errors

    def solve(self, cols: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (points x cols) after ``steps`` steps, and the largest error of each step over cols."""
        state, errors = self.advance(cols, self.begin(len(cols)), steps)
        return state.c[: self.n], errors


def weighted_l1(a: np.ndarray, cost: np.ndarray, rhs: np.ndarray, lz: float, ones: np.ndarray | None, tol: float = 1e-9, most: int = 6000) -> tuple[np.ndarray, np.ndarray, float]:
    """min cost'|v| + lz/2 |rhs - a v|^2 (lz = 0: with a v = rhs), where ones'v = 1 if ones is given: (v, dual of a, dual of ones).

    ADMM over v and an exact projection, over-relaxed, its step balanced while residuals differ. At the end the scaled multipliers are the
    cost's slopes at v, and a' dual + dual of ones gives them back.
    """
    d, n = a.shape
    rho = max(1.0, lz / 10) if lz else 10.0
    v, u = np.zeros(n), np.zeros(n)

    def parts(rho: float):
        if lz:
            inner = np.linalg.inv(rho / lz * np.eye(d) + a @ a.T)
            inv = (np.eye(n) - a.T @ inner @ a) / rho
            shift = inv @ (lz * (a.T @ rhs))
            if ones is None:
                return rho * inv, shift
            ig = inv @ ones
            keep = np.eye(n) - np.outer(ig, ones) / (ones @ ig)
            return keep @ (rho * inv), keep @ shift + ig / (ones @ ig)
        full, target = (a, rhs) if ones is None else (np.vstack([a, ones]), np.append(rhs, 1.0))
        back = np.linalg.pinv(full)
        return np.eye(n) - back @ full, back @ target

    turn, shift = parts(rho)
    for step in range(most):
        w = turn @ (v - u) + shift
        old, mixed = v, 1.6 * w - 0.6 * v
        v = soft(mixed + u, cost / rho)
        u = u + mixed - v
        primal, dual = np.abs(w - v).max(initial=0.0), rho * np.abs(v - old).max(initial=0.0)
        if primal < tol and dual < tol * max(1.0, rho):
            break
        if step % 50 == 49 and (exact := smooth_corner(a, cost, rhs, lz, ones, v) if lz else _corner(a if ones is None else np.vstack([a, ones]), cost, rhs if ones is None else np.append(rhs, 1.0), v)):
            v, both = exact
            return v, both[:d], float(both[d]) if ones is not None else 0.0
        if not lz and step == 299 and (exact := _pivoted(a if ones is None else np.vstack([a, ones]), cost, rhs if ones is None else np.append(rhs, 1.0), v)):
            v, both = exact
            return v, both[:d], float(both[d]) if ones is not None else 0.0
        if step % 50 == 49 and step < most // 2 and not 0.1 < primal / max(dual, 1e-300) < 10:
            scale = 2.0 if primal > dual else 0.5
            rho, u = rho * scale, u / scale
            turn, shift = parts(rho)
    slope = rho * u
    if not lz:
        full = a if ones is None else np.vstack([a, ones])
        dual = np.linalg.lstsq(full.T, slope, rcond=None)[0]
        return v, dual[:d], float(dual[d]) if ones is not None else 0.0
    dual = lz * (rhs - a @ v)
    at = ones > 0 if ones is not None else None
    return v, dual, float(np.mean(slope[at] - (a.T @ dual)[at])) if at is not None and at.any() else 0.0


def _corner(full: np.ndarray, cost: np.ndarray, target: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(v, dual) if the largest entries make an optimal corner of min cost'|v| with full v = target, as both conditions prove."""
    at = np.sort(np.argsort(-np.abs(v), kind="stable")[: min(len(target), np.count_nonzero(v))])
    if not len(at):
        return None
    exact = np.linalg.lstsq(full[:, at], target, rcond=None)[0]
    dual = np.linalg.lstsq(full[:, at].T, cost[at] * np.sign(exact), rcond=None)[0]
    scale = 1e-8 * max(1.0, np.abs(target).max())
    if np.abs(full[:, at] @ exact - target).max() > scale or (np.abs(full.T @ dual) > cost * (1 + 1e-7)).any():
        return None
    out = np.zeros(len(v))
    out[at] = exact
    return out, dual


def _pivoted(full: np.ndarray, cost: np.ndarray, target: np.ndarray, v: np.ndarray, most: int = 3000) -> tuple[np.ndarray, np.ndarray] | None:
    """(v, dual) of min cost'|v| with full v = target by simplex steps from the largest independent entries of v on.

    A column may be used with either sign at the same cost, so any basis is feasible. None where columns don't span.
    """
    rows, basis = len(target), []
    q = np.zeros((rows, 0))
    for j in np.argsort(-np.abs(v), kind="stable"):
        rest = full[:, j] - q @ (q.T @ full[:, j])
        rest -= q @ (q.T @ rest)
        size = np.linalg.norm(rest)
        if size > 1e-7 * max(1.0, np.linalg.norm(full[:, j])):
            basis.append(int(j))
            q = np.column_stack([q, rest / size])
            if len(basis) == rows:
                break
    else:
        return None
    for pivot in range(most):
        own = full[:, basis]
        x = np.linalg.solve(own, target)
        sign = np.where(x < 0, -1.0, 1.0)
        dual = np.linalg.solve(own.T, cost[basis] * sign)
        slope = full.T @ dual
        over = np.abs(slope) / cost
        over[basis] = 0
        better = np.flatnonzero(over > 1 + 1e-9)
        if not len(better):
            out = np.zeros(len(v))
            out[basis] = x
            return out, dual
        j = better[0] if pivot > most // 2 else better[over[better].argmax()]  # late steps by lowest number, which can't go in circles
        fall = np.linalg.solve(own, full[:, j] * np.sign(slope[j])) * sign
        at = np.flatnonzero(fall > 1e-11)
        if not len(at):
            return None
        basis[at[(np.abs(x[at]) / fall[at]).argmin()]] = int(j)
    return None


def smooth_corner(a: np.ndarray, cost: np.ndarray, rhs: np.ndarray, lz: float, ones: np.ndarray | None, v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(v, dual) if the signs of v are those of the optimum of cost'|v| + lz/2 |rhs - a v|^2, which then solves a linear system."""
    at = np.flatnonzero(v)
    if not 0 < len(at) <= len(rhs) + (ones is not None):
        return None
    own, sign = a[:, at], np.sign(v[at])
    system, target = lz * own.T @ own, lz * own.T @ rhs - cost[at] * sign
    if ones is not None:
        system = np.block([[system, -ones[at][:, None]], [ones[at][None, :], np.zeros((1, 1))]])
        target = np.append(target, 1.0)
    found = np.linalg.lstsq(system, target, rcond=None)[0]
    out = np.zeros(len(v))
    out[at] = found[: len(at)]
    dual, tau = lz * (rhs - a @ out), float(found[-1]) if ones is not None else 0.0
    slope = a.T @ dual + (tau * ones if ones is not None else 0)
    if (np.sign(out[at]) != sign).any() or (np.abs(slope) > cost * (1 + 1e-7)).any() or np.abs(slope[at] - cost[at] * sign).max() > 1e-6 * cost[at].max():
        return None
    if ones is not None and abs(ones @ out - 1) > 1e-8:
        return None
    return out, np.append(dual, tau)


def nearest_within(a: np.ndarray, cost: np.ndarray, target: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, tol: float = 1e-9, most: int = 5000) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(nu, at, size): the point nearest to target whose inner products with the rows of a are within cost of 0; target = nu + size @ a[at].

    It starts at ``held`` (at, signs), what held it for fewer rows, and takes in the row that is most over, one after another, while rows
    whose pull ends are let go (the dual active set of Goldfarb and Idnani). None where rounding keeps it from what the conditions prove.
    """
    d = a.shape[1]
    at, sign, q = np.zeros(d + 1, dtype=np.int64), np.zeros(d + 1), 0
    own, inv, pull = np.zeros((d + 1, d)), np.zeros((d + 1, d + 1)), np.zeros(d + 1)
    if held is not None and len(held[0]):
        q = len(held[0])
        at[:q], sign[:q] = held
        own[:q] = a[at[:q]] * sign[:q, None]
    nu = target
    for turn in range(most):
        if turn % 64 == 0 and q:  # the inverse anew, as its updates drift
            try:
                inv[:q, :q] = np.linalg.inv(own[:q] @ own[:q].T)
            except np.linalg.LinAlgError:
                return None
            pull[:q] = inv[:q, :q] @ (own[:q] @ target - cost[at[:q]])
            nu = target - pull[:q] @ own[:q]
        slope = a @ nu
        over = np.abs(slope) / cost
        over[at[:q]] = 0
        p = int(over.argmax())
        if over[p] <= 1 + tol:
            break
        s = 1.0 if slope[p] > 0 else -1.0
        n, new = a[p] * s, 0.0
        while True:
            r = inv[:q, :q] @ (own[:q] @ n)
            z = n - r @ own[:q]
            size = z @ z
            whole = (n @ nu - cost[p]) / size if size > 1e-11 * (n @ n) else np.inf
            ratio = np.where(r > 1e-13, pull[:q] / np.where(r > 1e-13, r, 1), np.inf)
            k = int(ratio.argmin()) if q else 0
            part = max(ratio[k], 0.0) if q else np.inf
            t = min(whole, part)
            if not np.isfinite(t):
                return None
            if size > 1e-11 * (n @ n):
                nu = nu - t * z
            pull[:q] -= t * r
            new += t
            if whole <= part:
                if q > d:
                    return None
                inv[:q, :q] += np.outer(r, r / size)
                inv[q, :q] = inv[:q, q] = -r / size
                inv[q, q] = 1 / size
                own[q], at[q], sign[q], pull[q] = n, p, s, new
                q += 1
                break
            h = inv[:q, k].copy()
            inv[:q, :q] -= np.outer(h, h / h[k])
            q -= 1
            inv[k, : q + 1] = inv[q, : q + 1]
            inv[: q + 1, k] = inv[: q + 1, q]
            own[k], at[k], sign[k], pull[k] = own[q], at[q], sign[q], pull[q]
    else:
        return None
    if not q:
        return nu, at[:0], pull[:0]
    try:
        exact = np.linalg.solve(own[:q] @ own[:q].T, own[:q] @ target - cost[at[:q]])
    except np.linalg.LinAlgError:
        return None
    nu = target - exact @ own[:q]
    if exact.min() < -1e-7 * max(1.0, exact.max()) or (np.abs(a @ nu) > cost * (1 + 1e-7)).any():
        return None
    return nu, at[:q].copy(), np.maximum(exact, 0) * sign[:q]


def convex_point(x: np.ndarray, at: int, le: float, lz: float, affine: bool, tol: float = 1e-9, most: int = 6000) -> np.ndarray:
    """Coefficients of all rows of x for the point x[at], with all other rows as atoms: what the solver by few atoms must equal."""
    others = np.arange(len(x)) != at
    d, n = x.shape[1], int(others.sum())
    a = np.hstack([x[others].T, np.eye(d)]) if le else x[others].T
    cost = np.concatenate([np.ones(n), np.full(d, le)]) if le else np.ones(n)
    ones = np.concatenate([np.ones(n), np.zeros(a.shape[1] - n)]) if affine else None
    out = np.zeros(len(x))
    out[others] = weighted_l1(a, cost, x[at], lz, ones, tol, most)[0][:n]
    return out
