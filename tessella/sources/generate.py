"""Generated matrices and tensors. Every value depends on seed and indices alone, so on no partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import adjust, ind2sub, nonneg, normal, uniform

#: Keys that tell a generator's draws apart: left and right factors, the pattern of cells, and noise.
LEFT, RIGHT, CELL, NOISE = 1, 2, 3, 4


def _cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    """All cells of a dense matrix, from one range of linear ids."""
    return spark.range(m * n).select(F.floor(F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))


def _walk(spark: SparkSession, m: int, n: int, seed: int, density: float, upper: bool) -> DataFrame:
    """(i, j) of a random pattern: each row is walked in jumps of geometric length, so empty cells cost nothing. Draws come
    from a counter-based generator keyed by seed and row. upper keeps to j >= i."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                draws, at = np.random.Generator(np.random.Philox(key=[seed, i])), i if upper else 0
                while at < n:
                    jumps = draws.geometric(density, size=max(64, min(1 << 16, math.ceil(1.2 * density * (n - at)))))
                    j = at - 1 + np.cumsum(jumps)
                    at = int(j[-1]) + 1
                    j = j[j < n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int64)), pa.array(j.astype(np.int64))], names=["i", "j"])

    return spark.range(m).mapInArrow(run, "i long, j long")


def _draw(kind: str, seed: int, i: Column, j: Column, portable: bool) -> Column:
    return uniform(seed, i, j, portable=portable) if kind == "uniform" else nonneg(normal(seed, i, j, portable=portable))


def random_matrix(spark: SparkSession, kind: str, m: int, n: int, k: int = 10, seed: int = 1210873, density: float = 1.0, symmetric: bool = False, adjusted: tuple[float, float] | None = None, portable: bool = False) -> DataFrame:
    """(i, j, v) of kind uniform, normal (negative values become zero) or lowrank (W H' of uniform factors).

    density below 1 keeps such a share of cells, walked row by row; symmetric takes both values of a pair from the ordered
    pair (low-rank: H H'); adjusted applies ceil(alpha v + beta). portable draws from digests that other engines have too
    and chooses cells one by one, for small matrices.
    """
    if kind not in ("uniform", "normal", "lowrank"):
        raise ValueError("kind is uniform, normal or lowrank")
    if symmetric and m != n:
        raise ValueError("a symmetric matrix is square")
    i, j = (F.least("i", "j"), F.greatest("i", "j")) if symmetric else (F.col("i"), F.col("j"))
    if density >= 1:
        cells = _cells(spark, m, n)
    elif portable:
        cells = _cells(spark, m, n).where(uniform(seed, i, j, F.lit(CELL), portable=True) < density)
    else:
        cells = _walk(spark, m, n, seed, density, symmetric)
        if symmetric:
            cells = cells.unionByName(cells.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j")))
    if kind == "lowrank":
        right = LEFT if symmetric else RIGHT
        v = sum((uniform(seed, F.col("i"), F.lit(r), F.lit(LEFT), portable=portable) * uniform(seed, F.col("j"), F.lit(r), F.lit(right), portable=portable) for r in range(k)), F.lit(0.0))
    else:
        v = _draw(kind, seed, i, j, portable)
    return cells.select("i", "j", (adjust(v, *adjusted) if adjusted else v).alias("v"))


def random_tensor(spark: SparkSession, kind: str, dims: list[int], k: int = 10, seed: int = 103, noise: float = 0.0, top: int = 100) -> DataFrame:
    """(i0 .., v), first index fastest, of kind uniform, normal, integer (0 to top - 1) or lowrank (rank k).

    noise adds a normal error whose expected norm is that share of the tensor's norm; negative sums become zero.
    """
    subs = [c.cast("long").alias(f"i{m}") for m, c in enumerate(ind2sub(F.col("id"), dims))]
    cells = spark.range(math.prod(dims)).select(*subs)
    keys = [F.col(f"i{m}") for m in range(len(dims))]
    if kind == "lowrank":
        v = F.lit(0.0)
        for r in range(k):
            p = F.lit(1.0)
            for m, c in enumerate(keys):
                p = p * uniform(seed, c, F.lit(r), F.lit(m), F.lit(LEFT))
            v = v + p
    else:
        kinds = {"uniform": uniform(seed, *keys), "normal": nonneg(normal(seed, *keys)), "integer": F.floor(uniform(seed, *keys) * top).cast("double")}
        if kind not in kinds:
            raise ValueError("kind is uniform, normal, integer or lowrank")
        v = kinds[kind]
    out = cells.select(*keys, v.alias("v"))
    if noise:
        size = out.agg(F.sqrt(F.avg(F.col("v") ** 2))).first()[0] or 0.0
        out = out.withColumn("v", nonneg(F.col("v") + normal(seed, *keys, F.lit(NOISE)) * (noise * size)))
    return out


def random_factor(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """Uniform rows for the ids of a frame (idx); a column's number is a key, so columns are independent."""
    return ids.select("idx", *(uniform(seed, F.col("idx"), F.lit(r)).alias(f"f{r}") for r in range(k)))
