"""Dense factorisations of the last level: rank-revealing QR, LU, and symmetric eigenvalues."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


class QRCP:
    """Householder QR with column pivoting; the rank is where the condition of R's leading block passes a bound."""

    def __init__(self, a: np.ndarray, rrqr_cond: float = 0.0, rank_norm: int = 2):
        a = np.array(a, complex if np.iscomplexobj(a) else float)
        n = len(a)
        q, perm = np.eye(n, dtype=a.dtype), np.arange(n)
        norms = (abs(a) ** 2).sum(axis=0) if n else np.zeros(0)
        for k in range(n):
            j = k + int(np.argmax(norms[k:]))
            if j != k:
                a[:, [k, j]], perm[[k, j]], norms[[k, j]] = a[:, [j, k]], perm[[j, k]], norms[[j, k]]
            x = a[k:, k].copy()
            size = np.linalg.norm(x)
            if size:
                x[0] += (x[0] / abs(x[0]) if x[0] else 1.0) * size
                x /= np.linalg.norm(x)
                a[k:, k:] -= 2 * np.outer(x, x.conj() @ a[k:, k:])
                q[:, k:] -= 2 * np.outer(q[:, k:] @ x, x.conj())
            norms[k + 1 :] = (abs(a[k + 1 :, k + 1 :]) ** 2).sum(axis=0)
        self.q, self.r, self.perm = q, np.triu(a), perm
        self.rank = self._rank(rrqr_cond or _EPS ** (-2 / 3), rank_norm)

    def _estimated(self, bound: float) -> int:
        """Leading columns of R while their estimated 1-norm condition stays under the bound."""
        sizes = np.maximum.accumulate(abs(self.r).sum(axis=0))
        grown = np.zeros(len(self.perm), self.r.dtype)  # solves R' x = +-1, signs chosen so that x grows
        for k, pivot in enumerate(np.diag(self.r)):
            if not pivot:
                return k
            known = grown[:k] @ self.r[:k, k]
            grown[k] = max(1 - known, -1 - known, key=abs) / pivot
            if abs(grown[: k + 1]).max() * sizes[k] >= bound:
                return k
        return len(grown)

    def _rank(self, bound: float, norm: int) -> int:
        n = len(self.perm)
        diag = abs(np.diag(self.r))
        if not n or not diag[0]:
            return 0
        if diag.min() >= np.sqrt(_EPS) * diag[0]:
            return n
        if norm == 1:
            return self._estimated(bound)

        def fits(k: int) -> bool:
            sizes = np.linalg.svd(self.r[:k, :k], compute_uv=False)
            return bool(sizes[0] <= sizes[-1] * bound)

        low, high = 1, n + 1  # the condition of leading blocks only grows
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    def _k(self, rank: int) -> int:
        return self.rank if rank == 0 else min(len(self.perm), rank if rank > 0 else len(self.perm))

    def solve(self, b: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        k, out = self._k(rank), np.zeros(b.shape, np.result_type(b, self.r))
        if trans:
            y = np.linalg.solve(self.r[:k, :k].conj().T, b[self.perm[:k]]) if k else b[:0]
            return self.q[:, :k] @ y
        y = self.q[:, :k].conj().T @ b
        out[self.perm[:k]] = np.linalg.solve(self.r[:k, :k], y) if k else y
        return out

    def multiply(self, x: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        k, out = self._k(rank), np.zeros(x.shape, np.result_type(x, self.r))
        if trans:
            out[self.perm[:k]] = self.r[:k, :k].conj().T @ (self.q[:, :k].conj().T @ x)
            return out
        return self.q[:, :k] @ (self.r[:k, :k] @ x[self.perm[:k]])


class LUP:
    """LU with row pivoting; a singular pivot ends the rank there."""

    def __init__(self, a: np.ndarray, rrqr_cond: float = 0.0):
        a = np.array(a, complex if np.iscomplexobj(a) else float)
        n, perm = len(a), np.arange(len(a))
        self.rank = n
        for k in range(n):
            j = k + int(np.argmax(abs(a[k:, k])))
            a[[k, j]], perm[[k, j]] = a[[j, k]], perm[[j, k]]
            if not a[k, k]:
                self.rank = min(self.rank, k)
                continue
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        self.l, self.u, self.perm = np.tril(a, -1) + np.eye(n), np.triu(a), perm

    def solve(self, b: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        if trans:
            y, k = np.zeros(b.shape, np.result_type(b, self.u)), self.rank
            y[:k] = np.linalg.solve(self.u[:k, :k].conj().T, b[:k])
            y = np.linalg.solve(self.l.conj().T, y)
            out = np.zeros_like(y)
            out[self.perm] = y
            return out
        return self._upper(np.linalg.solve(self.l, b[self.perm]))

    def _upper(self, y: np.ndarray) -> np.ndarray:
        """U^-1 y; of a singular U its leading block, and zeros beyond it."""
        k = self.rank
        if k < len(self.u):
            y = np.concatenate([y[:k], np.zeros_like(y[k:])])
        out = np.zeros(y.shape, np.result_type(y, self.u))
        out[:k] = np.linalg.solve(self.u[:k, :k], y[:k])
        return out

    def multiply(self, x: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        if trans:
            return self.u.conj().T @ (self.l.conj().T @ x[self.perm])
        y = self.l @ (self.u @ x)
        out = np.zeros_like(y)
        out[self.perm] = y
        return out


class SYEIG:
    """Eigenvalues of a Hermitian block, best first; tiny ones and, with ``spd``, those of the wrong sign are left out."""

    def __init__(self, a: np.ndarray, rrqr_cond: float = 0.0, spd: int = 0):
        a = np.array(a, complex if np.iscomplexobj(a) else float)
        w, v = np.linalg.eigh((a + a.conj().T) / 2) if len(a) else (np.zeros(0), a)
        good = w if spd > 0 else -w if spd < 0 else abs(w)
        order = np.argsort(-good, kind="stable")
        self.w, self.v = w[order], v[:, order]
        bound = _EPS ** (2 / 3) * (abs(w).max() if len(w) else 0.0)
        self.rank = int((good[order] > bound).sum())

    def _k(self, rank: int) -> int:
        return self.rank if rank == 0 else min(len(self.w), rank if rank > 0 else len(self.w))

    def solve(self, b: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        k = self._k(rank)
        y = self.v[:, :k].conj().T @ b
        return self.v[:, :k] @ ((y.T / self.w[:k]).T)

    def multiply(self, x: np.ndarray, rank: int = 0, trans: bool = False) -> np.ndarray:
        k = self._k(rank)
        return self.v[:, :k] @ ((self.w[:k] * (self.v[:, :k].conj().T @ x).T).T)
