"""Systems of all points, [K P; P' 0] [w; c] = [f; g], solved without their matrix.

K is a kernel of distances and P a polynomial of the places. The matrix has a row a place, so
it is never held: conjugate gradients need its products only, which tasks make block by block
from the places. They are preconditioned by solutions of small systems, each of a place and of
the nearest places before it in an order from coarse to fine (Faul and Powell's method, a sparse
factor of the inverse), so that their number hardly grows with the places. Memory is a few
vectors and a short row a place; the work is places squared a product, shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import SparkContext

NEAR = 40  # places in a small system
MOST = 300  # products; twenty or so are usual

Kernel = Callable[[np.ndarray], np.ndarray]  # of squared distances


class NotDefinite(ValueError):
    """The kernel isn't (conditionally) positive definite at these places."""


def spread(sc: SparkContext, work: Callable[[int, int], object], n: int) -> list:
    """work(begin, end) of ranges of n rows, by tasks, in order."""
    tasks = max(1, min(4 * sc.defaultParallelism, n // 256))
    ends = np.linspace(0, n, tasks + 1).astype(int).tolist()
    return sc.parallelize(list(zip(ends, ends[1:])), tasks).map(lambda r: work(*r)).collect()


def blocks(x: np.ndarray, y: np.ndarray, begin: int, end: int, at: tuple[np.ndarray, np.ndarray] | None = None):
    """(rows, columns, squared distances) of small blocks, of the rows begin to end (of the places, or of those ``at``) and all places."""
    gx, gy = at or (x, y)
    for a in range(begin, end, 32):
        i = slice(a, min(a + 32, end))
        for b in range(0, len(x), 1024):
            j = slice(b, min(b + 1024, len(x)))
            d, e = gx[i, None] - x[j], gy[i, None] - y[j]
            d *= d
            e *= e
            d += e
            yield i, j, d


def coarse_first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places in an order of which every beginning is spread over all of them: one of each cell of finer and finer grids."""
    unit = max(np.ptp(x), np.ptp(y)) * (1 + 1e-9) or 1.0
    u, v = (x - x.min()) / unit, (y - y.min()) / unit
    left, out = np.arange(len(x)), np.zeros(0, int)
    for level in range(31):
        k = 2**level
        cell = np.floor(u * k).astype(np.int64) * k + np.floor(v * k).astype(np.int64)
        free = left[~np.isin(cell[left], cell[out])]
        off = np.hypot(u[free] * k % 1 - 0.5, v[free] * k % 1 - 0.5)
        free = free[np.lexsort((off, cell[free]))]
        new = free[np.unique(cell[free], return_index=True)[1]]
        out, left = np.concatenate([out, new]), np.setdiff1d(left, new)
        if not len(left):
            break
    return np.concatenate([out, left])


def _base(p: np.ndarray) -> np.ndarray:
    """Rows of p, as many as its columns, that are far from dependent."""
    rest, rows = p.copy(), []
    for _ in range(p.shape[1]):
        i = int((rest**2).sum(1).argmax())
        d = rest[i] / np.linalg.norm(rest[i])
        rest -= np.outer(rest @ d, d)
        rows.append(i)
    return np.array(rows, int)


class System:
    """Of distinct places x and y, a kernel and the polynomial of a degree: None for none, 0 or 1."""

    def __init__(self, sc: SparkContext, x: np.ndarray, y: np.ndarray, kernel: Kernel, degree: int | None):
        n = len(x)
        p = np.column_stack([np.ones(n), x, y][: {None: 0, 0: 1, 1: 3}[degree]]) if degree is not None else np.zeros((n, 0))
        if p.shape[1]:
            _, s, t = np.linalg.svd(p, full_matrices=False)
            self.turn = t[s > 1e-10 * s[0]].T  # places on a line have a smaller polynomial
        else:
            self.turn = np.zeros((0, 0))
        p = p @ self.turn
        first, then = _base(p), coarse_first(x, y)
        self.order = np.concatenate([first, then[~np.isin(then, first)]])
        self.sc, self.n, self.r = sc, n, len(first)
        self.x, self.y, self.p = x[self.order], y[self.order], p[self.order]
        self.shared = sc.broadcast((self.x, self.y, self.p))
        self.kernel = kernel
        self._precondition()

    def _precondition(self) -> None:
        shared, kernel, r = self.shared, self.kernel, self.r
        width = NEAR + r + 1

        def work(begin: int, end: int):
            x, y, p = shared.value
            which, part = np.zeros((end - begin, width), np.int32), np.zeros((end - begin, width))
            for row, i in enumerate(range(begin + r, end + r)):
                if i < width:
                    s = np.arange(i + 1)
                else:
                    near = np.argpartition((x[:i] - x[i]) ** 2 + (y[:i] - y[i]) ** 2, NEAR)[:NEAR]
                    s = np.append(np.union1d(np.arange(r), near), i)
                m = len(s)
                a = np.zeros((m + r, m + r))
                a[:m, :m] = kernel((x[s, None] - x[s]) ** 2 + (y[s, None] - y[s]) ** 2)
                a[:m, m:], a[m:, :m] = p[s], p[s].T
                try:
                    w = np.linalg.solve(a, np.eye(m + r)[m - 1])[:m]
                except np.linalg.LinAlgError:
                    w = np.full(m, np.nan)
                if not (np.isfinite(w).all() and w[-1] > 0):
                    w = np.zeros(m)  # the place alone, less its polynomial at the first ones
                    w[-1] = 1.0
                    w[:r] = -np.linalg.solve(p[:r].T, p[i]) if r else 0.0
                    size = w @ a[:m, :m] @ w
                    w /= np.sqrt(size) if size > 0 else 1.0
                else:
                    w /= np.sqrt(w[-1])
                which[row, :m], part[row, :m] = s, w
            return which, part

        got = spread(self.sc, work, self.n - r)
        self.which, self.part = (np.concatenate(g) for g in zip(*got))

    def _smooth(self, f: np.ndarray) -> np.ndarray:
        """U U' f of the sparse factor U; U' P is zero."""
        mid = np.zeros((len(self.which), f.shape[1]))
        for k in range(self.which.shape[1]):
            mid += self.part[:, k, None] * f[self.which[:, k]]
        flat = self.which.ravel()
        return np.column_stack([np.bincount(flat, (self.part * mid[:, c, None]).ravel(), self.n) for c in range(f.shape[1])])

    def _product(self, w: np.ndarray) -> np.ndarray:
        shared, kernel = self.shared, self.kernel
        given = self.sc.broadcast(w)

        def work(begin: int, end: int):
            x, y, _ = shared.value
            w = given.value
            out = np.zeros((end - begin, w.shape[1]))
            for i, j, d in blocks(x, y, begin, end):
                out[i.start - begin : i.stop - begin] += kernel(d) @ w[j]
            return out

        out = np.concatenate(spread(self.sc, work, self.n))
        given.destroy()
        return out

    def _polynomial(self, left: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(self.p, left, rcond=None)[0]

    def solve(self, f: np.ndarray, g: np.ndarray | None = None, near: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """(w, c) for the columns of f and of g (zero if not given)."""
        f = f[self.order]
        w = np.zeros(f.shape)
        if g is not None and self.r:
            w[: self.r] = np.linalg.solve(self.p[: self.r].T, self.turn.T @ g)
        size = np.abs(f).max(0) + 1e-300
        off = lambda left: (np.abs(left - self.p @ self._polynomial(left)).max(0) / size).max()
        left = f - self._product(w) if w.any() else f.copy()
        products = 0
        for _ in range(4):  # what rounding left over is solved for again
            z = self._smooth(left)
            d, rz = z, (left * z).sum(0)
            while off(left) > near and products < MOST:
                kd = self._product(d)
                curve = (d * kd).sum(0)
                if (curve < 0).any() and (curve < -1e-9 * np.abs(d).max(0) * np.abs(kd).max(0)).any():
                    raise NotDefinite("the kernel is not positive definite at these places")
                a = np.where(curve > 0, rz / np.where(curve > 0, curve, 1), 0)
                w, left, products = w + a * d, left - a * kd, products + 1
                z = self._smooth(left)
                new = (left * z).sum(0)
                d, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0) * d, new
            left = f - self._product(w) if w.any() else f
            if off(left) <= 100 * near:
                break
        else:
            raise NotDefinite(f"the system did not settle: {off(left):.1e} of it is left after {products} products")
        self.products = products
        c = self._polynomial(left)
        back = np.empty_like(w)
        back[self.order] = w
        return back, self.turn @ c

    def close(self) -> None:
        self.shared.destroy()
