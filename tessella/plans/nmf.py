"""Nonnegative factorization of a coordinate matrix: A is near W H'."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import matrix as R
from tessella.plans.factors import Factor
from tessella.sources.generate import random_factor

METRICS = "it int, objective double, fit_err_sq double, rel_error double, norm_w double, norm_h double, l12_w double, l12_h double, symmdiff double, seconds double"


@dataclass
class Fit:
    w: DataFrame
    h: DataFrame
    metrics: DataFrame
    rows: list


def checked(a: DataFrame) -> DataFrame:
    """Reject nulls, non-finite and negative values before a fit."""
    bad = a.where(F.col("v").isNull() | F.isnan("v") | (F.col("v") < 0) | F.col("i").isNull() | F.col("j").isNull())
    if not bad.isEmpty():
        raise ValueError("a matrix to be factorized has no null, NaN or negative cell")
    return a


def index(a: DataFrame, column: str, size: int | None) -> DataFrame:
    """All ids of an index: 0 .. size - 1 if the size is given, so empty rows are kept, else those that occur."""
    spark = a.sparkSession
    return spark.range(size).select(F.col("id").alias("idx")) if size else a.select(F.col(column).cast("long").alias("idx")).distinct()


def _l12(f: Factor) -> float:
    return float(np.sqrt(np.sum(f.gram())))


def nmf(
    a: DataFrame,
    k: int = 20,
    algo: str = "ANLSBPP",
    iterations: int = 20,
    shape: tuple[int, int] | None = None,
    w0: DataFrame | None = None,
    h0: DataFrame | None = None,
    seed: int = 193957,
    reg_w: tuple[float, float] = (0.0, 0.0),
    reg_h: tuple[float, float] = (0.0, 0.0),
    alpha: float | None = None,
    symmetric: bool = False,
    tol: float = -1.0,
    normalization: str | None = None,
    warm_start: int = 0,
) -> Fit:
    """Fit by MU, HALS, ANLSBPP, AOADMM, NESTEROV, ALS, R2 (k = 2) or, for symmetric matrices, GNSYM.

    a has i, j, v without repeated cells; missing cells are zero. reg_* are (l2, l12) penalties. symmetric adds
    alpha |W - H|^2 to ANLSBPP, alpha by default the square of the largest value. tol ends a fit when the relative
    change of the objective falls below it. warm_start runs so many HALS rounds first. Metrics have one row a round.
    """
    spark, algo = a.sparkSession, algo.upper()
    a = checked(a.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")))
    if normalization == "l2":
        a = R.col_l2_normalize(a)
    elif normalization == "max":
        a = R.max_normalize(a)
    elif normalization:
        raise ValueError("normalization is l2 or max")
    if symmetric and algo not in ("ANLSBPP", "GNSYM"):
        raise ValueError("a symmetric fit takes ANLSBPP or GNSYM")
    if algo == "R2" and k != 2:
        raise ValueError("R2 has two columns")
    a = a.persist()
    try:
        if algo == "GNSYM":
            from tessella.plans.symmetric import gnsym

            return gnsym(a, k, iterations, shape, h0, seed)
        m, n = shape or (None, None)
        w = Factor.of(w0 if w0 is not None else random_factor(index(a, "i", m), k, seed))
        h = Factor.of(h0 if h0 is not None else random_factor(index(a, "j", n), k, seed + 17))
        norm = R.norm_sq(a)
        if symmetric:
            alpha = (a.agg(F.max("v")).first()[0] or 0.0) ** 2 if alpha is None else alpha
            w = h
        alpha = alpha or 0.0
        rows: list = []
        plan = ["HALS"] * warm_start + [algo] * iterations
        for it, rule in enumerate(plan):
            began = time.perf_counter()
            extra = alpha * np.eye(k)
            if rule in ("ANLSBPP", "ALS", "R2"):
                w, _ = w.update(R.a_h(a, h.df), rule, R.regularized(h.gram(), *reg_w) + extra, alpha, h if alpha else None)
                h, dot = h.update(R.at_w(a, w.df), rule, R.regularized(w.gram(), *reg_h) + extra, alpha, w if alpha else None)
            else:
                h, _ = h.update(R.at_w(a, w.df), rule, R.regularized(w.gram(), *reg_h))
                w, dot = w.update(R.a_h(a, h.df), rule, R.regularized(h.gram(), *reg_w))
            gw, gh = w.gram(), h.gram()
            err = max(norm - 2 * dot + float((gw * gh).sum()), 0.0)
            gap = _gap(w, h) if symmetric else 0.0
            cost = err + reg_w[0] * np.trace(gw) + reg_h[0] * np.trace(gh) + reg_w[1] * gw.sum() + reg_h[1] * gh.sum() + alpha * gap**2
            rows.append((it, float(cost), float(err), float(np.sqrt(err / norm)) if norm else 0.0, float(np.sqrt(np.trace(gw))), float(np.sqrt(np.trace(gh))), _l12(w), _l12(h), gap, time.perf_counter() - began))
            if tol > 0 and it and abs(rows[-2][1] - cost) <= tol * max(abs(cost), 1e-300):
                break
        if not symmetric:
            scale = np.sqrt(np.diag(w.gram()))
            scale[scale == 0] = 1
            w, h = w.scaled(1 / scale), h.scaled(scale)
        return Fit(w.df, h.df, spark.createDataFrame(rows, METRICS), rows)
    finally:
        a.unpersist()


def _gap(w: Factor, h: Factor) -> float:
    if w.values is not None and h.values is not None:
        return float(np.linalg.norm(w.values - h.values))
    return w.map(np.subtract, h).norm()


def timings(metrics: DataFrame) -> DataFrame:
    """One row: least, mean and greatest seconds of a round, and all of them."""
    return metrics.agg(F.min("seconds").alias("least"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"), F.sum("seconds").alias("total"))
