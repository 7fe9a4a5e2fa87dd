"""Application of a multilevel factorisation: solves, products, refinement, Krylov methods, for one system."""

from __future__ import annotations

import math

import numpy as np

from stratum.kernels.factor import Level, Rows


def _arrays(level: Level, name: str):
    """(row, column, value) arrays of a block, kept with the level."""
    if name not in level.cache:
        rows: Rows = getattr(level, name)
        count = [len(r) for r in rows]
        i = np.repeat(np.arange(len(rows)), count)
        j = np.array([c for r in rows for c in r], np.int64)
        v = np.array([x for r in rows for x in r.values()]) if i.size else np.zeros(0)
        level.cache[name] = (i, j, v, np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
    return level.cache[name]


def _times(level: Level, name: str, x: np.ndarray, size: int, trans: bool = False) -> np.ndarray:
    i, j, v, _ = _arrays(level, name)
    if trans:
        i, j, v = j, i, v.conj()
    out = np.zeros((size, *x.shape[1:]), np.result_type(x, v))
    np.add.at(out, i, (v * x[j].T).T)
    return out


def _triangle(level: Level, name: str, y: np.ndarray, trans: bool) -> np.ndarray:
    """(I + T)^-1 y or (I + T)^-H y; L is strictly lower, U strictly upper, both by rows."""
    _, cols, vals, starts = _arrays(level, name)
    y = y.astype(np.result_type(y, vals))
    n = level.m
    rows = range(n) if (name == "L") != trans else range(n - 1, -1, -1)
    for r in rows:
        a, b = starts[r], starts[r + 1]
        if a < b:
            if trans:
                y[cols[a:b]] -= (vals[a:b].conj() * np.broadcast_to(y[r], (b - a, *y.shape[1:])).T).T
            else:
                y[r] -= vals[a:b] @ y[cols[a:b]]
    return y


def _block_solve(level: Level, y: np.ndarray, trans: bool) -> np.ndarray:
    if not level.m:
        return y
    if trans:
        z = _triangle(level, "U", y, True)
        return _triangle(level, "L", (z.T / level.d.conj()).T, True)
    z = _triangle(level, "L", y, False)
    return _triangle(level, "U", (z.T / level.d).T, False)


def _block_times(level: Level, x: np.ndarray, trans: bool) -> np.ndarray:
    if not level.m:
        return x
    first, second = ("L", "U") if trans else ("U", "L")
    z = x + _times(level, first, x, level.m, trans)
    z = (z.T * (level.d.conj() if trans else level.d)).T
    return z + _times(level, second, z, level.m, trans)


def solve(levels: list[Level], b: np.ndarray, trans: bool = False, rank: int = 0, at: int = 0) -> np.ndarray:
    """M^-1 b, or M^-H b; columns of ``b`` are solved each."""
    f = levels[at]
    s, t, p, q = (f.t, f.s, f.q, f.p) if trans else (f.s, f.t, f.p, f.q)
    w = (s * b.T).T[p]
    top, low = w[: f.m], w[f.m :]
    lower, upper = ("F", "E") if trans else ("E", "F")
    rest = f.n - f.m
    if rest:
        if f.m:
            low = low - _times(f, lower, _block_solve(f, top, trans), rest, trans)
        low = f.solver.solve(low, rank, trans) if at == len(levels) - 1 else solve(levels, low, trans, rank, at + 1)
        if f.m:
            top = top - _times(f, upper, low, f.m, trans)
    top = _block_solve(f, top, trans)
    out = np.zeros(b.shape, np.result_type(top, low, t))
    out[q] = np.concatenate([top, low])
    return (t * out.T).T


def multiply(levels: list[Level], x: np.ndarray, trans: bool = False, rank: int = 0, at: int = 0) -> np.ndarray:
    """M x, or M^H x."""
    f = levels[at]
    s, t, p, q = (f.t, f.s, f.q, f.p) if trans else (f.s, f.t, f.p, f.q)
    z = (x.T / t).T[q]
    top, low = z[: f.m], z[f.m :]
    lower, upper = ("F", "E") if trans else ("E", "F")
    rest = f.n - f.m
    if rest:
        below = f.solver.multiply(low, rank, trans) if at == len(levels) - 1 else multiply(levels, low, trans, rank, at + 1)
        if f.m:
            fy = _times(f, upper, low, f.m, trans)
            below = below + _times(f, lower, top + _block_solve(f, fy, trans), rest, trans)
            top = _block_times(f, top, trans) + fy
        low = below
    else:
        top = _block_times(f, top, trans)
    out = np.zeros(x.shape, np.result_type(top, low, s))
    out[p] = np.concatenate([top, low])
    return (out.T / s).T


class Sparse:
    """A matrix for products inside a kernel."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray):
        self.n, self.i, self.j, self.v = n, i, j, v

    def times(self, x: np.ndarray, trans: bool = False) -> np.ndarray:
        i, j, v = (self.j, self.i, self.v.conj()) if trans else (self.i, self.j, self.v)
        out = np.zeros((self.n, *x.shape[1:]), np.result_type(x, v))
        np.add.at(out, i, (v * x[j].T).T)
        return out

    def rows(self) -> Rows:
        out: Rows = [{} for _ in range(self.n)]
        for i, j, v in zip(self.i.tolist(), self.j.tolist(), self.v.tolist()):
            out[i][j] = v
        return out


def null_filter(x: np.ndarray, first: int = 0, end: int = -1) -> np.ndarray:
    end = len(x) if end < first else end
    out = x.copy()
    out[first:end] -= x[first:end].mean(axis=0)
    return out


def refine(a: Sparse, levels: list[Level], b: np.ndarray, steps: int, bounds: tuple[float, float] | None = None, trans: bool = False, rank: int = -1, after=None) -> tuple[np.ndarray, int, int]:
    """(x, steps taken, flag): fixed steps, or until the residual passes a bound (0 below, 1 above, -1 neither)."""
    after = after or (lambda z: z)
    size = np.linalg.norm(b)
    if bounds is not None and not size:
        return np.zeros_like(b), 0, 0
    x = after(solve(levels, b, trans, rank))
    if bounds is None:
        for _ in range(max(0, steps - 1)):
            x = x + after(solve(levels, b - a.times(x, trans), trans, rank))
        return x, max(1, steps), 0
    for k in range(1, steps + 1):
        r = b - a.times(x, trans)
        rel = np.linalg.norm(r) / size
        if rel <= bounds[0]:
            return x, k, 0
        if rel > bounds[1]:
            return x, k, 1
        if k < steps:
            x = x + after(solve(levels, r, trans, rank))
    return x, steps, -1


def gmres(a: Sparse, levels: list[Level], b: np.ndarray, rtol: float = 1e-6, restart: int = 30, maxit: int = 500, flexible: bool = False, after=None, rank: int = 0):
    """(x, flag, iterations, relative residual, products): right-preconditioned restarted GMRES.

    Flexible: the preconditioner is a refinement with 1, 2, 4, ... steps over the outer cycles. Flags: 0 converged,
    1 stagnated, 2 out of iterations.
    """
    after = after or (lambda z: z)
    kind = np.result_type(a.v, b, float)
    x, size = np.zeros(len(b), kind), np.linalg.norm(b)
    if not size:
        return x, 0, 0, 0.0, 0
    count, products, outer, flag = 0, 0, 0, 2
    rel = 1.0
    while count < maxit:
        r = b - a.times(x) if outer else b.astype(kind)
        products += outer > 0
        beta = np.linalg.norm(r)
        start = beta / size
        if start <= rtol:
            rel, flag = start, 0
            break
        v, z, h = [r / beta], [], np.zeros((restart + 1, restart), kind)
        g, cs, sn = np.zeros(restart + 1, kind), np.zeros(restart), np.zeros(restart, kind)
        g[0], k, last = beta, 0, start
        for k in range(min(restart, maxit - count)):
            if flexible:
                w, did, _ = refine(a, levels, v[k], 2**outer, rank=rank, after=after)
                products += did - 1
            else:
                w = after(solve(levels, v[k], rank=rank))
            z.append(w)
            w = a.times(w)
            products += 1
            for i in range(k + 1):
                h[i, k] = np.vdot(v[i], w)
                w = w - h[i, k] * v[i]
            h[k + 1, k] = np.linalg.norm(w)
            exact = abs(h[k + 1, k]) < 1e-300
            v.append(w / h[k + 1, k] if not exact else w)
            for i in range(k):
                one, two = h[i, k], h[i + 1, k]
                h[i, k], h[i + 1, k] = cs[i] * one + sn[i] * two, -np.conj(sn[i]) * one + cs[i] * two
            one, two = h[k, k], h[k + 1, k]
            length = math.hypot(abs(one), abs(two))
            if not length:
                break
            cs[k] = abs(one) / length
            sn[k] = (one / abs(one) if one else 1.0) * np.conj(two) / length
            h[k, k], h[k + 1, k] = cs[k] * one + sn[k] * two, 0.0
            g[k + 1], g[k] = -np.conj(sn[k]) * g[k], cs[k] * g[k]
            count += 1
            rel = abs(g[k + 1]) / size
            if rel <= rtol or rel >= last * (1 - 1e-8) or exact:
                flag = 0 if rel <= rtol else 1
                break
            last = rel
        width = len(z)
        y = np.linalg.lstsq(h[:width, :width], g[:width], rcond=None)[0] if width else np.zeros(0)
        x = x + sum((c * w for c, w in zip(y, z)), np.zeros(len(b), kind))
        outer += 1
        if flag != 2:
            break
    rel = float(np.linalg.norm(b - a.times(x)) / size)
    return x, flag, count, rel, products
