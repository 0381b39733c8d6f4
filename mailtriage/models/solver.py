"""A small dense-free optimiser for fits that are bounded and run inside one task.

Used for one user's refit. Larger sets go to Spark ML (``linear``).
"""

from __future__ import annotations

import numpy as np

# A fit stops when no entry of the mean gradient exceeds this.
MEAN_GRADIENT = 1e-7
# Coefficients up to which a fit takes Newton steps first: few, each with a matrix of that size.
NEWTON_SIZE = 256


def minimise(f, x, tol, max_iter=300, memory=10, unit=1.0):
    """Limited-memory BFGS with backtracking; stops when the largest gradient entry, in multiples of ``unit``, is below ``tol``.

    ``unit`` may also be a function that turns the gradient into the entries that count. A search without end, or without a finite value, raises.
    """
    entries = unit if callable(unit) else lambda g: g / unit
    fx, g = f(x)
    steps, diffs = [], []
    for _ in range(max_iter):
        if np.max(np.abs(entries(g))) <= tol:
            break
        d, alphas = -g, []
        for s, y in zip(reversed(steps), reversed(diffs)):
            a = s @ d / (y @ s)
            d = d - a * y
            alphas.append(a)
        if steps:
            d = d * (steps[-1] @ diffs[-1]) / (diffs[-1] @ diffs[-1])
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(zip(steps, diffs), reversed(alphas)):
            d = d + (a - y @ d / (y @ s)) * s
        slope, t = g @ d, 1.0
        if slope >= 0:
            d, slope, steps, diffs = -g, -(g @ g), [], []
        while True:
            new, gn = f(x + t * d)
            if new <= fx + 1e-4 * t * slope or t < 1e-12:
                break
            t /= 2
        gain, s, y = fx - new, t * d, gn - g
        if not gain > 1e-14 * max(1.0, abs(fx)):
            break
        x, fx, g = x + s, new, gn
        if y @ s > 1e-12 * (y @ y):
            steps.append(s)
            diffs.append(y)
            steps, diffs = steps[-memory:], diffs[-memory:]
    else:
        raise RuntimeError(f"the fit has not converged after {max_iter} steps")
    if not np.isfinite(fx):
        raise RuntimeError("the fit has no finite value")
    return x


class Rows:
    """Sparse rows from lists of index and value arrays."""

    def __init__(self, indices, values, dim):
        self.n, self.dim = len(indices), dim
        sizes = [len(i) for i in indices]
        self.row = np.repeat(np.arange(self.n), sizes)
        self.idx = np.concatenate([np.asarray(i, dtype=np.int64) for i in indices]) if self.n else np.zeros(0, np.int64)
        self.val = np.concatenate([np.asarray(v, dtype=float) for v in values]) if self.n else np.zeros(0)

    def times(self, w):
        return np.bincount(self.row, self.val * w[self.idx], self.n)

    def transposed(self, e):
        return np.bincount(self.idx, self.val * e[self.row], self.dim)

    def dense(self):
        return np.bincount(self.row * self.dim + self.idx, self.val, self.n * self.dim).reshape(self.n, self.dim)


class DenseRows:
    """The same for rows of few dimensions."""

    def __init__(self, X):
        self.X, (self.n, self.dim) = X, X.shape

    def times(self, w):
        return self.X @ w

    def transposed(self, e):
        return e @ self.X

    def dense(self):
        return self.X


def balanced(y, k):
    """Weight n / (k * n_c) per row; ``k`` counts the classes that occur."""
    n = np.bincount(y, minlength=k)
    return (len(y) / (np.count_nonzero(n) * np.maximum(n, 1)))[y]


def fit_classes(rows: Rows, y, weight, k, C, start=None):
    """Coefficients and intercepts; one row for two classes, else one row per class.

    ``start`` is an array of that shape with the intercept last; it only saves steps.
    """
    m = 1 if k == 2 else k
    hot = np.eye(k)[y][:, -m:]

    def f(x):
        B = x.reshape(m, rows.dim + 1)
        z = np.stack([rows.times(b[:-1]) + b[-1] for b in B], axis=1)
        if m == 1:
            loss = np.logaddexp(0, z[:, 0]) - hot[:, 0] * z[:, 0]
            p = 1 / (1 + np.exp(-z))
        else:
            top = z.max(axis=1, keepdims=True)
            e = np.exp(z - top)
            p = e / e.sum(axis=1, keepdims=True)
            loss = np.log(e.sum(axis=1)) + top[:, 0] - (hot * z).sum(axis=1)
        err = weight[:, None] * (p - hot)
        grad = np.stack([np.append(rows.transposed(err[:, c]), err[:, c].sum()) for c in range(m)])
        grad[:, :-1] += B[:, :-1] / C
        return (weight * loss).sum() + (B[:, :-1] ** 2).sum() / (2 * C), grad.ravel()

    x0 = np.zeros(m * (rows.dim + 1)) if start is None else np.asarray(start, dtype=float).ravel()
    if len(x0) <= NEWTON_SIZE:
        f, shares, X = _dense_objective(rows.dense(), hot, weight, m, C)
        x0 = _newton(X, f, shares, x0, weight, m, C, MEAN_GRADIENT * weight.sum())
    B = minimise(f, x0, MEAN_GRADIENT * weight.sum()).reshape(m, rows.dim + 1)
    return B[:, :-1], B[:, -1]


def _dense_objective(X, hot, weight, m, C):
    """The objective of ``fit_classes`` on dense rows, the shares of the classes (one row each), and the columns with a constant one last."""
    X = np.hstack([X, np.ones((len(X), 1))])
    columns, hot = np.ascontiguousarray(X.T), np.ascontiguousarray(hot.T)

    def shares(z):
        if m == 1:
            return 1 / (1 + np.exp(-z)), np.logaddexp(0, z[0])
        top = z.max(axis=0)
        e = np.exp(z - top)
        total = e.sum(axis=0)
        return e / total, np.log(total) + top

    def f(x):
        B = x.reshape(m, -1)
        z = B @ columns
        p, log = shares(z)
        grad = ((p - hot) * weight) @ X
        grad[:, :-1] += B[:, :-1] / C
        return weight @ (log - (hot * z).sum(axis=0)) + (B[:, :-1] ** 2).sum() / (2 * C), grad.ravel()

    return f, lambda x: shares(x.reshape(m, -1) @ columns)[0], columns


def _newton(columns, f, shares, x, weight, m, C, tol, max_iter=30):
    """Newton steps with backtracking on dense rows; ends where a step no longer helps, which leaves the rest to ``minimise``."""
    d = len(columns)
    penalty = np.tile(np.append(np.full(d - 1, 1 / C), 0.0), m)
    fx, g = f(x)
    for _ in range(max_iter):
        if np.max(np.abs(g)) <= tol:
            break
        p = shares(x)
        H = np.empty((m * d, m * d))
        for a in range(m):
            for b in range(a + 1):
                part = (columns * (weight * p[a] * ((a == b) - p[b]))) @ columns.T
                H[a * d:(a + 1) * d, b * d:(b + 1) * d] = H[b * d:(b + 1) * d, a * d:(a + 1) * d] = part
        # Equal shifts of all intercepts change nothing; the small term on the diagonal keeps steps free of them.
        step = np.linalg.solve(H + np.diag(penalty + 1e-12 * H.trace()), -g)
        slope, t = g @ step, 1.0
        while True:
            new, gn = f(x + t * step)
            if new <= fx + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        if not new < fx:
            break
        x, fx, g = x + t * step, new, gn
    return x


def square_sums(rows: Rows, y, weight):
    """Weighted sums of products of the columns, a constant one last, with each other and with the target."""
    X = np.hstack([rows.dense(), np.ones((rows.n, 1))])
    return X.T @ (X * weight[:, None]), X.T @ (weight * y)


def solve_squared(products, sums, alpha):
    """Ridge regression with a free intercept from its sums."""
    x = np.linalg.lstsq(products + np.diag(np.append(np.full(len(sums) - 1, alpha), 0.0)), sums, rcond=None)[0]
    if not np.isfinite(x).all():
        raise RuntimeError("the fit has no finite value")
    return x[None, :-1], x[-1:]


def fit_squared(rows: Rows, y, weight, alpha):
    """Ridge regression with a free intercept."""
    def f(x):
        e = rows.times(x[:-1]) + x[-1] - y
        grad = np.append(rows.transposed(weight * e) + alpha * x[:-1], (weight * e).sum())
        return 0.5 * (weight * e * e).sum() + 0.5 * alpha * (x[:-1] ** 2).sum(), grad

    x = np.append(np.zeros(rows.dim), np.average(y, weights=weight))
    if len(x) <= NEWTON_SIZE:
        X = np.hstack([rows.dense(), np.ones((rows.n, 1))])
        x = np.linalg.lstsq(X.T @ (X * weight[:, None]) + np.diag(np.append(np.full(rows.dim, alpha), 0.0)), X.T @ (weight * y), rcond=None)[0]
    x = minimise(f, x, MEAN_GRADIENT * weight.sum())
    return x[None, :-1], x[-1:]


def predict(rows: Rows, coefficients, intercepts):
    z = np.stack([rows.times(b) + c for b, c in zip(coefficients, intercepts)], axis=1)
    return (z[:, 0] > 0).astype(int) if len(intercepts) == 1 else z.argmax(axis=1)
