"""Nonnegative CP factorization of a coordinate tensor."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import tensor as X
from tessella.plans.factors import Factor
from tessella.session import written
from tessella.sources.generate import random_factor


@dataclass
class CP:
    factors: list[DataFrame]
    lam: list[float]
    metrics: DataFrame
    rows: list


def split_mode(sizes: list[int]) -> int:
    """Modes 0 .. s are the left side of the dimension tree: the cut that keeps the larger side smallest."""
    n = len(sizes)
    return min(range(n - 1), key=lambda s: (max(np.prod([float(x) for x in sizes[: s + 1]]), np.prod([float(x) for x in sizes[s + 1 :]])), s))


def _extrapolated(t: DataFrame, fs: list[Factor], lam: np.ndarray, before: list[Factor], by: float, norm: float) -> tuple[list[Factor], np.ndarray, float]:
    """Factors moved on from their last change, kept nonnegative and normalized, their lengths and their error."""
    n = len(fs)
    moved = [f.map(lambda x, b, s=lam if m == n - 1 else 1.0: np.maximum(b + (x * s - b) * by, 0), b) for m, (f, b) in enumerate(zip(fs, before, strict=True))]
    size = [np.sqrt(np.diag(x.gram())) for x in moved]
    new = [x.scaled(1 / np.where(s > 0, s, 1)) for x, s in zip(moved, size, strict=True)]
    length = np.prod(size, axis=0)
    dot = new[-1].scaled(length).dot(new[-1].filled(X.mttkrp(t, [f.df for f in new], n - 1)))
    whole = float(length @ X.gram_hadamard([f.gram() for f in new]) @ length)
    return new, length, float(np.sqrt(max(norm + whole - 2 * dot, 0.0) / norm)) if norm else 0.0


def ntf(t: DataFrame, k: int = 20, algo: str = "ANLSBPP", iterations: int = 20, factors: list[DataFrame] | None = None, seed: int = 193957, dimtree: bool = True, tol: float = -1.0, l2: float = 0.0, start: str = "scaled", accelerate: bool = False) -> CP:
    """Fit by MU, HALS, ANLSBPP, AOADMM, NESTEROV or CPALS (no constraint).

    With dimtree the tensor is read twice a round: one partial product serves all modes left of the cut, one those
    right of it. start is what rules that depend on the current factor begin from: the factor times lambda, or as
    normalized. accelerate extrapolates all factors after the sixth round by (it + 1) ** (1 / e) and keeps the result if
    the error falls; e grows after five failures. Metrics: it, rel_error,
    lambda_max, seconds.
    """
    spark, algo, n = t.sparkSession, algo.upper(), X.order(t)
    t = t.select(*(F.col(f"i{m}").cast("long").alias(f"i{m}") for m in range(n)), F.col("v").cast("double").alias("v")).persist()
    try:
        ids = [t.select(F.col(f"i{m}").alias("idx")).distinct() for m in range(n)]
        fs = [Factor.of(f) for f in (factors or [random_factor(ids[m], k, seed + 17 * m) for m in range(n)])]
        norm = t.agg(F.sum(F.col("v") ** 2)).first()[0] or 0.0
        lam = np.ones(k)
        for m in range(n):
            s = np.sqrt(np.diag(fs[m].gram()))
            s[s == 0] = 1
            fs[m] = fs[m].scaled(1 / s)
        cut, power, misses, before = split_mode([f.rows for f in fs]), 3, 0, None
        left, right, rows = list(range(cut + 1)), list(range(cut + 1, n)), []
        for it in range(iterations):
            began = time.perf_counter()
            partial = None
            for m in range(n):
                side, away = (left, right) if m in left else (right, left)
                frames = [f.df for f in fs]
                if dimtree and len(side) > 1:
                    if m == side[0]:
                        partial = written(X.partial_mttkrp(t, frames, away), "partial")
                    product = X.multi_ttv(partial, frames, m)
                else:
                    product = X.mttkrp(t, frames, m)
                g = X.gram_hadamard([f.gram() for f in fs], m) + l2 * np.eye(k)
                begin = fs[m].scaled(lam) if start == "scaled" else fs[m]
                new, dot = begin.update(product, algo, g)
                full = new.gram()
                lam = np.sqrt(np.diag(full))
                fs[m] = new.scaled(1 / np.where(lam > 0, lam, 1))
            whole = float(lam @ X.gram_hadamard([f.gram() for f in fs]) @ lam)
            err = np.sqrt(max(norm + whole - 2 * dot, 0.0) / norm) if norm else 0.0
            if accelerate:
                if it > 5:
                    tried = _extrapolated(t, fs, lam, before, (it + 1) ** (1 / power), norm)
                    if tried[2] < err:
                        fs, lam, err, misses = *tried, 0
                    else:
                        misses += 1
                        power, misses = (power + 1, 0) if misses > 5 else (power, misses)
                before = [f.scaled(lam) if m == n - 1 else f for m, f in enumerate(fs)]
            rows.append((it, float(err), float(lam.max()), time.perf_counter() - began))
            if tol > 0 and it and abs(rows[-2][1] - err) <= tol * max(err, 1e-300):
                break
        return CP([f.df for f in fs], lam.tolist(), spark.createDataFrame(rows, "it int, rel_error double, lambda_max double, seconds double"), rows)
    finally:
        t.unpersist()
