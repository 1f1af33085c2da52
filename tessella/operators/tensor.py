"""Tensors of any order as rows (i0 .. iN-1, v); a factor has wide rows (idx, f0 ..) as in matrix."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.matrix import gram, rank


def order(t: DataFrame) -> int:
    return sum(1 for c in t.columns if c[0] == "i" and c[1:].isdigit())


def _joined(t: DataFrame, factors: list[DataFrame], modes: list[int]) -> DataFrame:
    for m in modes:
        f = factors[m]
        t = t.join(f.select(F.col("idx").alias(f"i{m}"), *(F.col(f"f{r}").alias(f"f{m}_{r}") for r in range(rank(f)))), f"i{m}")
    return t


def _times(modes: list[int], r: int) -> Column:
    return reduce(lambda a, m: a * F.col(f"f{m}_{r}"), modes, F.lit(1.0))


def mttkrp(t: DataFrame, factors: list[DataFrame], mode: int) -> DataFrame:
    """(idx, m0 ..): a star join with the other factors and one grouped sum; no Khatri-Rao product is formed."""
    others = [m for m in range(order(t)) if m != mode]
    k = rank(factors[others[0]])
    return _joined(t, factors, others).groupBy(F.col(f"i{mode}").alias("idx")).agg(*(F.sum(F.col("v") * _times(others, r)).alias(f"m{r}") for r in range(k)))


def partial_mttkrp(t: DataFrame, factors: list[DataFrame], contract: list[int]) -> DataFrame:
    """The modes in `contract` multiplied away: (kept modes, p0 ..), shared by all updates of the kept modes."""
    keep = [f"i{m}" for m in range(order(t)) if m not in contract]
    k = rank(factors[contract[0]])
    return _joined(t, factors, contract).groupBy(*keep).agg(*(F.sum(F.col("v") * _times(contract, r)).alias(f"p{r}") for r in range(k)))


def multi_ttv(partial: DataFrame, factors: list[DataFrame], mode: int) -> DataFrame:
    """MTTKRP of a kept mode from a partial product: each column is contracted with its own factor columns."""
    kept = [int(c[1:]) for c in partial.columns if c[0] == "i" and c[1:].isdigit()]
    others = [m for m in kept if m != mode]
    k = rank(partial, "p")
    return _joined(partial, factors, others).groupBy(F.col(f"i{mode}").alias("idx")).agg(*(F.sum(F.col(f"p{r}") * _times(others, r)).alias(f"m{r}") for r in range(k)))


def gram_hadamard(grams: list[np.ndarray], without: int | None = None) -> np.ndarray:
    return reduce(np.multiply, [g for m, g in enumerate(grams) if m != without])


def reconstruct(pattern: DataFrame, factors: list[DataFrame], lam: list[float] | None = None) -> DataFrame:
    """Values of the factors' tensor at the cells of a pattern, as column x beside v."""
    modes = list(range(len(factors)))
    k = rank(factors[0])
    x = sum((_times(modes, r) * (lam[r] if lam else 1.0) for r in range(k)), F.lit(0.0))
    return _joined(pattern, factors, modes).select(*(f"i{m}" for m in modes), "v", x.alias("x"))


def khatri_rao(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ia, ib, f0 ..): products of all rows of two factors, which is the operator's result."""
    k = rank(a)
    right = b.select(F.col("idx").alias("ib"), *(F.col(f"f{r}").alias(f"g{r}") for r in range(k)))
    return a.withColumnRenamed("idx", "ia").crossJoin(right).select("ia", "ib", *((F.col(f"f{r}") * F.col(f"g{r}")).alias(f"f{r}") for r in range(k)))


def krp(factors: list[DataFrame], modes: list[int]) -> DataFrame:
    """(i<mode> .., f0 ..): the Khatri-Rao product of the factors of some modes; for all but one that of the others."""
    out = None
    for m in modes:
        f = factors[m].select(F.col("idx").alias(f"i{m}"), *(F.col(f"f{r}").alias(f"g{r}") for r in range(rank(factors[m]))))
        if out is None:
            out = f.withColumnsRenamed({f"g{r}": f"f{r}" for r in range(rank(factors[m]))})
            continue
        k, ids = rank(out), [c for c in out.columns if c[0] == "i"]
        out = out.crossJoin(f).select(*ids, f"i{m}", *((F.col(f"f{r}") * F.col(f"g{r}")).alias(f"f{r}") for r in range(k)))
    return out


def without(n: int, mode: int) -> list[int]:
    return [m for m in range(n) if m != mode]


def whole(factors: list[DataFrame], lam: list[float] | None = None) -> DataFrame:
    """The factors' tensor, all cells."""
    n, k = len(factors), rank(factors[0])
    return krp(factors, list(range(n))).select(*(f"i{m}" for m in range(n)), sum((F.col(f"f{r}") * (lam[r] if lam else 1.0) for r in range(k)), F.lit(0.0)).alias("v"))


def error_sq(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: squared distance of two tensors; cells that one lacks are zero there."""
    ids = [f"i{m}" for m in range(order(x))]
    j = x.join(y.withColumnRenamed("v", "w"), ids, "full")
    return j.agg(F.sum((F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) ** 2).alias("err_sq"))


def normalize_all(factors: list[DataFrame]) -> tuple[list[DataFrame], list[float]]:
    """All factors with columns of length one, and the products of the lengths."""
    done = [normalize_mode(f) for f in factors]
    return [f for f, _ in done], np.prod([lam for _, lam in done], axis=0).tolist()


def normalize_mode(factor: DataFrame) -> tuple[DataFrame, list[float]]:
    """Columns of length one, and the lengths; a zero column stays."""
    lam = [float(np.sqrt(x)) for x in np.diag(gram(factor))]
    return factor.select("idx", *((F.col(f"f{r}") / (x or 1.0)).alias(f"f{r}") for r, x in enumerate(lam))), lam


def kronecker(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, f0 ..): rows of khatri_rao() numbered with b's index fastest; b's ids are 0 .. n - 1."""
    n = b.agg(F.max("idx") + 1).first()[0] or 0
    return khatri_rao(a, b).withColumn("idx", F.col("ia") * n + F.col("ib")).drop("ia", "ib")
