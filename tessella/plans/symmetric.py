"""Symmetric factorization A near H H' by Gauss-Newton with conjugate gradients."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import matrix as R
from tessella.plans.factors import Factor
from tessella.plans.nmf import METRICS, Fit, index
from tessella.sources.generate import random_factor


def step(ah: Factor, h: Factor, tol: float = 1e-4) -> Factor:
    """H after one Gauss-Newton step, at most k conjugate gradients, projected. Only k x k values come to the driver if H
    is a table."""
    g = h.gram()
    r = h.map(lambda h, ah: -2 * (ah - h @ g), ah)
    x, p, rs = r.map(np.zeros_like), r, r.dot(r)
    for _ in range(h.width):
        if rs < tol:
            break
        c = p.cross(h)
        hp = p.map(lambda p, h, c=c: 2 * (p @ g + h @ c), h)
        denominator = p.dot(hp)
        if denominator <= 0:
            break
        a = rs / denominator
        x, r = x.map(lambda x, p, a=a: x + a * p, p), r.map(lambda r, hp, a=a: r - a * hp, hp)
        new = r.dot(r)
        p, rs = r.map(lambda r, p, b=new / rs: r + b * p, p), new
    return h.map(lambda h, x: np.maximum(h - x, 0), x)


def gnsym(a: DataFrame, k: int, iterations: int, shape, h0: DataFrame | None, seed: int) -> Fit:
    """The product A H is one distributed job a round; H is on the driver or, if it is large, a table."""
    if not R.symmetry_check(a).isEmpty():
        raise ValueError("GNSYM takes a symmetric matrix")
    spark = a.sparkSession
    every = index(a, "i", shape[0] if shape else None)
    if h0 is not None:
        h = Factor.of(h0)
    else:
        h = Factor.of(random_factor(every, k, seed))
        mean = (a.agg(F.sum("v")).first()[0] or 0.0) / max(h.rows, 1) ** 2
        h = h.scaled(np.full(k, 2 * np.sqrt(mean / k)))
    norm, rows = R.norm_sq(a), []
    ah = h.times(a, "j", "i", h)
    for it in range(iterations):
        began = time.perf_counter()
        h = step(ah, h)
        ah = h.times(a, "j", "i", h)
        g = h.gram()
        err = max(norm - 2 * h.dot(ah) + float((g * g).sum()), 0.0)
        size, l12 = float(np.sqrt(np.trace(g))), float(np.sqrt(g.sum()))
        rows.append((it, err, err, float(np.sqrt(err / norm)) if norm else 0.0, size, size, l12, l12, 0.0, time.perf_counter() - began))
    return Fit(h.df, h.df, spark.createDataFrame(rows, METRICS), rows)
