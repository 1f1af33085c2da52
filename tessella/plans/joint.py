"""Joint factorization of an attributed graph: |A - W H'|^2 + alpha |S - H H'|^2."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import matrix as R
from tessella.operators.kernels import bpp
from tessella.plans.factors import Factor
from tessella.plans.nmf import checked, index
from tessella.sources.generate import random_factor

#: Step sizes of a line search that are tried in one product.
AT_ONCE = 4


@dataclass
class Joint:
    w: DataFrame
    h: DataFrame
    metrics: DataFrame
    rows: list
    #: The copy of H that ANLSBPP ties to it.
    h2: DataFrame | None = None


def objective(na: float, ns: float, alpha: float, w, h, ah, sh) -> float:
    """From W, H, A H and S H, factors or arrays."""
    w, h, ah, sh = map(Factor.wrap, (w, h, ah, sh))
    gw, gh = w.gram(), h.gram()
    return float(na - 2 * w.dot(ah) + (gw * gh).sum() + alpha * (ns - 2 * h.dot(sh) + (gh * gh).sum()))


def gradients(alpha: float, w, h, ah, atw, sh) -> tuple[Factor, Factor]:
    """By W and by H."""
    w, h, ah, atw, sh = map(Factor.wrap, (w, h, ah, atw, sh))
    gw, gh = w.gram(), h.gram()
    by_h = lambda h, atw, sh: 2 * (h @ gw - atw) + 4 * alpha * (h @ gh - sh)
    return w.map(lambda w, ah: 2 * (w @ gh - ah), ah), h.map(by_h, atw, sh)


def _newton(gw_: Factor, gh_: Factor, w: Factor, h: Factor, alpha: float, bound_tol=1e-5, steps=20, tol=1e-8) -> list[Factor]:
    """Projected Gauss-Newton direction: entries at the bound that would leave it stay, conjugate gradients on the rest."""
    free = lambda x, g: (~((x <= bound_tol) & (g > 0))).astype(float)
    on_w, on_h = w.map(free, gw_), h.map(free, gh_)
    gw, gh = w.gram(), h.gram()
    r = [gw_.map(np.multiply, on_w), gh_.map(np.multiply, on_h)]
    x, p = [r[0].map(np.zeros_like), r[1].map(np.zeros_like)], r
    rs = sum(a.dot(a) for a in r)
    for _ in range(steps):
        if rs < tol:
            break
        ph, pw = p[1].cross(h), p[0].cross(w)
        hw = p[0].map(lambda p, w, on, c=ph: 2 * (p @ gh + w @ c) * on, w, on_w)
        hh = p[1].map(lambda p, h, on, c=pw, d=ph: (2 * (p @ gw + h @ c) + 4 * alpha * (p @ gh + h @ d)) * on, h, on_h)
        d = p[0].dot(hw) + p[1].dot(hh)
        if d <= 0:
            break
        a = rs / d
        x = [u.map(lambda u, v: u + a * v, v) for u, v in zip(x, p, strict=True)]
        r = [u.map(lambda u, v: u - a * v, v) for u, v in zip(r, (hw, hh), strict=True)]
        new = sum(q.dot(q) for q in r)
        p, rs = [u.map(lambda u, v, b=new / rs: u + b * v, v) for u, v in zip(r, p, strict=True)], new
    return x


def joint_nmf(a: DataFrame, s: DataFrame, k: int = 20, algo: str = "ANLSBPP", iterations: int = 20, shape: tuple[int, int] | None = None, alpha: float | None = None, beta: float | None = None, momentum: float = 0.9, momentum_sign: float = 1.0, seed: int = 193957, checks: int = 20, inner: int = 20) -> Joint:
    """Fit by ANLSBPP (with a second copy of H tied to it by beta), PGD or PGNCG.

    a (i, j, v) has the features, s (i, j, v) the symmetric connections of the ids j. alpha defaults to the ratio of
    squared norms, beta to alpha times the largest connection. Products with data are distributed jobs; factors are on the
    driver or, if they are large, tables. A line search halves the step up to `checks` times, AT_ONCE steps in one product
    each of A and S; a failed one takes a small step. PGNCG takes at most `inner` conjugate gradients a round. metrics: it, objective, seconds.
    """
    spark, algo = a.sparkSession, algo.upper()
    if algo not in ("ANLSBPP", "PGD", "PGNCG"):
        raise ValueError("algo is ANLSBPP, PGD or PGNCG")
    a, s = checked(a).persist(), checked(s).persist()
    try:
        m, n = shape or (None, None)
        rows_, columns = index(a, "i", m), index(a.select("j").unionByName(s.select("j")), "j", n)
        w, h, h2 = Factor.of(random_factor(rows_, k, seed + 17)), Factor.of(random_factor(columns, k, seed + 23)), None
        na, ns = R.norm_sq(a), R.norm_sq(s)
        alpha = (na / ns if ns else 0.0) if alpha is None else alpha
        beta = alpha * (s.agg(F.max("v")).first()[0] or 0.0) if beta is None else beta
        ah = lambda x: x.times(a, "j", "i", w)
        atw = lambda x: x.times(a, "i", "j", h)
        sh = lambda x: x.times(s, "j", "i", h)
        out, before, last, eye = [], None, 0.0, np.eye(k)
        pa_, ps = ah(h), sh(h)
        pt = None if algo == "ANLSBPP" else atw(w)
        cost = objective(na, ns, alpha, w, h, pa_, ps)
        for it in range(iterations):
            began = time.perf_counter()
            if algo == "ANLSBPP":
                g = h.gram()
                w = pa_.map(lambda m: bpp(g, m))
                h2 = ps.map(lambda m, h: bpp(alpha * g + beta * eye, alpha * m + beta * h), h)
                left = w.gram() + alpha * h2.gram() + beta * eye
                h = atw(w).map(lambda m, q, x: bpp(left, m + alpha * q + beta * x), sh(h2), h2)
                pa_, ps = ah(h), sh(h)
                cost = objective(na, ns, alpha, w, h, pa_, ps)
            else:
                gw_, gh_ = gradients(alpha, w, h, pa_, pt, ps)
                size = max(np.hypot(gw_.norm(), gh_.norm()), 1e-300)
                if algo == "PGD":
                    go = lambda g, d: g / size + momentum_sign * momentum * d
                    first = lambda g: g / size
                    xw, xh = (gw_.map(go, before[0]), gh_.map(go, before[1])) if before else (gw_.map(first), gh_.map(first))
                    t = np.hypot(w.norm(), h.norm())
                    t = min(t, 4 * last) if last else t  # a line search begins near the last step that did
                else:
                    xw, xh = _newton(gw_, gh_, w, h, alpha, steps=inner)
                    t = 1.0
                found = None
                for c in range(0, checks, AT_ONCE):
                    steps = [t / 2**i for i in range(c, min(c + AT_ONCE, checks))]
                    tried = h.map(lambda x, d, steps=steps: np.hstack([np.maximum(x - q * d, 0) for q in steps]), xh)
                    qa, qs = ah(tried), sh(tried)
                    for i, q in enumerate(steps):
                        nw, nh = w.map(lambda x, d, q=q: np.maximum(x - q * d, 0), xw), tried.part(i * k, k)
                        ra, rs = qa.part(i * k, k), qs.part(i * k, k)
                        new = objective(na, ns, alpha, nw, nh, ra, rs)
                        if new < cost:
                            found, last = (nw, nh, ra, rs, new), q
                            break
                    if found:
                        break
                if not found:
                    small = lambda x, g: np.maximum(x - 1e-8 * g / size, 0)
                    nw, nh = w.map(small, gw_), h.map(small, gh_)
                    ra, rs = ah(nh), sh(nh)
                    found = nw, nh, ra, rs, objective(na, ns, alpha, nw, nh, ra, rs)
                nw, nh, pa_, ps, cost = found
                if algo == "PGD":
                    before = nw.map(np.subtract, w), nh.map(np.subtract, h)
                w, h = nw, nh
                pt = atw(w)
            out.append((it, float(cost), time.perf_counter() - began))
        return Joint(w.df, h.df, spark.createDataFrame(out, "it int, objective double, seconds double"), out, h2.df if h2 is not None else None)
    finally:
        a.unpersist(), s.unpersist()
