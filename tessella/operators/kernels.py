"""Row-local update rules in NumPy: rows of a factor are independent once the Gram matrix is given.

G is k x k, M holds the rows of data times the other factor, F the rows to be updated. Rules run on Arrow batches, so a
factor is updated where it lies.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-17


def mu(g, m, f, eps=TINY):
    """Multiplicative update."""
    return f * m / (f @ g + eps)


def hals(g, m, f):
    """One sweep over the columns, each with those before it already new; an empty column stays."""
    f = f.copy()
    for r in range(len(g)):
        if g[r, r] > 0:
            f[:, r] = np.maximum(f[:, r] + (m[:, r] - f @ g[:, r]) / g[r, r], TINY)
    return f


def als(g, m, f=None):
    """Least squares without a constraint."""
    return m @ np.linalg.pinv(g)


def _solve(g, m):
    try:
        return np.linalg.solve(g, m.T).T
    except np.linalg.LinAlgError:
        return m @ np.linalg.pinv(g)


def bpp(g, m, f=None):
    """Nonnegative least squares by block principal pivoting, rows grouped by equal passive sets.

    Rows that still cycle after 5 k exchanges are solved one by one with an active set, which ends always. f is only a
    start: its positive entries are the first passive set.
    """
    n, k = m.shape
    passive = np.zeros((n, k), bool)
    x, y = np.zeros((n, k)), -m.copy()  # three full exchanges, then one at a time: fixed values of the method
    spare, fewest = np.full(n, 3), np.full(n, k + 1)
    for _ in range(5 * k + 5):
        bad = np.where(passive, x < 0, y < 0)
        count = bad.sum(1)
        todo = np.flatnonzero(count)
        if not len(todo):
            return x
        less = todo[count[todo] < fewest[todo]]
        rest = todo[count[todo] >= fewest[todo]]
        fewest[less], spare[less] = count[less], 3
        again, single = rest[spare[rest] >= 1], rest[spare[rest] < 1]
        spare[again] -= 1
        whole = np.concatenate([less, again])
        passive[whole] ^= bad[whole]
        if len(single):
            last = k - 1 - bad[single][:, ::-1].argmax(1)
            passive[single, last] ^= True
        sets, group = np.unique(passive[todo], axis=0, return_inverse=True)
        x[todo] = 0
        for s, on in enumerate(sets):
            rows = todo[group.ravel() == s]
            if on.any():
                x[np.ix_(rows, np.flatnonzero(on))] = _solve(g[np.ix_(on, on)], m[np.ix_(rows, np.flatnonzero(on))])
        y[todo] = x[todo] @ g - m[todo]
        x[np.abs(x) < 1e-12] = 0
        y[np.abs(y) < 1e-12] = 0
    for i in np.flatnonzero(np.where(passive, x < 0, y < 0).any(1)):
        x[i] = active_set(g, m[i])
    return x


def active_set(g, m, tol=1e-12):
    """Nonnegative least squares of one row: one index enters at a time, and the way back is cut where it leaves."""
    x, on = np.zeros(len(m)), np.zeros(len(m), bool)
    for _ in range(30 * len(m)):
        y = m - x @ g
        if on.all() or y[~on].max() <= tol * max(1.0, np.abs(m).max()):
            break
        on[np.flatnonzero(~on)[y[~on].argmax()]] = True
        while True:
            z = np.zeros(len(m))
            z[on] = _solve(g[np.ix_(on, on)], m[None, on])[0]
            if (z[on] > 0).all():
                x = z
                break
            low = on & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = np.maximum(x + step * (z - x), 0)
            on &= x > 1e-300
            if not on.any():
                break
    return x


def nnls(a, b):
    """X >= 0 that minimizes |a X' - b|, a (n, k) and b (n, m): rows of X by bpp() on the normal equations."""
    return bpp(a.T @ a, b.T @ a)


def kkt(g, m, x):
    """How far rows are from optimal: the largest of negative entries, negative gradients and their products, by row."""
    y = x @ g - m
    return np.max(np.concatenate([np.maximum(-x, 0), np.maximum(-y, 0), np.abs(x * y)], 1), 1)


def rank2(g, m, f=None):
    """Closed form for two columns and nonnegative M, clipped at zero."""
    x = m @ np.linalg.pinv(g)
    u, v = m[:, 0] / max(g[0, 0], TINY), m[:, 1] / max(g[1, 1], TINY)
    first = np.sqrt(g[0, 0]) * u >= np.sqrt(g[1, 1]) * v
    one = np.stack([np.where(first, u, 0), np.where(first, 0, v)], 1)
    return np.maximum(np.where((x < 0).any(1)[:, None], one, x), 0)


def admm(g, m, f, u=None, steps=5, tol=0.01):
    """Alternating directions: (new rows, dual). At most five steps; a row stops when it is near its copy and has hardly
    moved, by its own norms, so that no result depends on which rows are together. u is the dual of the last call."""
    k = len(g)
    rho = np.trace(g) / k
    rho = rho if rho > 0 else 0.01
    factor = np.linalg.cholesky(g + rho * np.eye(k))
    f, u = f.copy(), np.zeros_like(f) if u is None else u.copy()
    todo = np.arange(len(f))
    for _ in range(steps):
        before = f[todo]
        aux = np.linalg.solve(factor.T, np.linalg.solve(factor, (m[todo] + rho * (before + u[todo])).T)).T
        f[todo] = np.maximum(aux - u[todo], 0)
        u[todo] += f[todo] - aux
        size = lambda x: np.sqrt((x**2).sum(1))
        done = (size(f[todo] - aux) < tol * size(f[todo])) & (size(f[todo] - before) < tol * size(u[todo]))
        todo = todo[~done]
        if not len(todo):
            break
    return f, u


def nesterov(g, m, f, steps=20):
    """Accelerated projected gradient with the proximal term chosen by the condition number, capped."""
    values = np.linalg.eigvalsh(g)
    top, low = max(values[-1], 1e-12), max(values[0], 1e-12)
    ratio = top / low  # bounds and shares of the proximal term: fixed values of the method
    lam = 10 * low if ratio > 1e6 else low if ratio > 1e3 else low / 10
    h, q = g + lam * np.eye(len(g)), (low + lam) / (top + lam)
    target, y, x, alpha = m + lam * f, f, f, 1.0
    for _ in range(steps):
        new = np.maximum(y - (y @ h - target) / (top + lam), 0)
        after = 0.5 * (q - alpha**2 + np.sqrt((q - alpha**2) ** 2 + 4 * alpha**2))
        y = new + alpha * (1 - alpha) / (alpha**2 + after) * (new - x)
        x, alpha = new, after
    return x


#: Rules by name; each takes (G, M, F) and returns the new rows.
RULES = {"MU": mu, "HALS": hals, "ANLSBPP": bpp, "NESTEROV": nesterov, "ALS": als, "CPALS": als, "R2": rank2}
#: Rules with a dual variable of the same shape: (G, M, F, U) to (F, U).
KEEP = {"AOADMM": admm}
