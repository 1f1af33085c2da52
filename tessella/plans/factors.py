"""Factors during a fit: small ones on the driver, large ones as written tables. The same steps run on either."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import matrix as R
from tessella.operators.kernels import KEEP, RULES
from tessella.operators.matrix import cols, gram, rank
from tessella.session import written

#: A factor of at most so many bytes is held on the driver; a larger one stays distributed.
DRIVER_BYTES = 64 << 20


def frame(spark: SparkSession, ids: np.ndarray, values: np.ndarray) -> DataFrame:
    """Of known size, so that Catalyst broadcasts it below its threshold and no other."""
    names = cols(values.shape[1])
    rows = [pa.array(ids.astype(np.int64)), *(pa.array(np.ascontiguousarray(values[:, r], np.float64)) for r in range(len(names)))]
    return spark.createDataFrame(pa.Table.from_arrays(rows, names=["idx", *names]))


def _arrays(df: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of a small table (idx, name0 ..), as they come."""
    got = df.toArrow()
    values = [got.column(c).to_numpy() for c in cols(rank(df, name), name)]
    return got.column("idx").to_numpy(), np.stack(values, 1) if values else np.zeros((got.num_rows, 0))


def _schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("idx", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])


def _renamed(df: DataFrame, name: str) -> DataFrame:
    return df.select("idx", *(F.col(f"f{r}").alias(f"{name}{r}") for r in range(rank(df))))


class Factor:
    """Rows (idx, f0 ..): a table, or ids and values on the driver, of which a frame is made when one is asked for."""

    def __init__(self, spark: SparkSession | None, rows: int, df: DataFrame | None = None, ids: np.ndarray | None = None, values: np.ndarray | None = None, dual: "Factor | None" = None) -> None:
        self.spark, self.rows, self._df, self.ids, self.values, self.dual = spark, rows, df, ids, values, dual

    @classmethod
    def of(cls, df: DataFrame) -> Factor:
        """Settle a factor: its size is counted first and decides where it lives."""
        k, n = rank(df), df.count()
        if n * k * 8 <= DRIVER_BYTES:
            ids, values = _arrays(df.select(F.col("idx").cast("long").alias("idx"), *(F.col(c).cast("double").alias(c) for c in cols(k))), "f")
            order = np.argsort(ids, kind="stable")
            return cls.here(df.sparkSession, ids[order], values[order])
        return cls(df.sparkSession, n, written(df.select("idx", *cols(k)), "factor"))

    @classmethod
    def here(cls, spark: SparkSession | None, ids: np.ndarray, values: np.ndarray, dual: "Factor | None" = None) -> Factor:
        return cls(spark, len(ids), None, ids, values, dual)

    @classmethod
    def wrap(cls, values) -> Factor:
        """An array as a factor with ids 0, 1 ..; a factor stays."""
        return values if isinstance(values, Factor) else cls.here(None, np.arange(len(values)), values)

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = frame(self.spark, self.ids, self.values)
        return self._df

    @property
    def width(self) -> int:
        return self.values.shape[1] if self.values is not None else rank(self._df)

    def gram(self) -> np.ndarray:
        return gram(self.df) if self.values is None else self.values.T @ self.values

    def cross(self, other: Factor) -> np.ndarray:
        """This factor's transpose times another one of the same ids."""
        if self.values is not None:
            return self.values.T @ other.values
        out = np.zeros((self.width, other.width))
        for p, q, g in R.cross_gram(self.df, other.df).collect():
            out[p, q] = g or 0.0
        return out

    def dot(self, other: Factor) -> float:
        return float((self.values * other.values).sum()) if self.values is not None else R.dot(self.df, other.df)

    def norm(self) -> float:
        return float(np.sqrt(max(np.trace(self.gram()), 0.0)))

    def map(self, f: Callable, *others: Factor) -> Factor:
        """f of the rows of this factor and of others with the same ids, block by block; f gives an array of as many rows."""
        if self.values is not None:
            return Factor.here(self.spark, self.ids, f(self.values, *(o.values for o in others)))
        joined, widths = self.df, [self.width, *(o.width for o in others)]
        for n, o in enumerate(others):
            joined = joined.join(_renamed(o.df, f"x{n}_"), "idx")
        groups = [cols(widths[0]), *(cols(k, f"x{n}_") for n, k in enumerate(widths[1:]))]
        out = f(*(np.zeros((0, k)) for k in widths)).shape[1]

        def run(batches):
            for batch in batches:
                new = f(*(np.stack([batch.column(c).to_numpy() for c in g], 1) for g in groups))
                yield pa.RecordBatch.from_arrays([batch.column("idx"), *(pa.array(np.ascontiguousarray(new[:, r])) for r in range(out))], names=["idx", *cols(out)])

        return Factor(self.spark, self.rows, written(joined.mapInArrow(run, _schema(cols(out))), "factor"))

    def filled(self, product: DataFrame) -> Factor:
        """The rows (idx, m0 ..) of a product as a factor with this factor's ids: other rows go, ids without a row have zeros."""
        k = rank(product, "m")
        if self.values is not None:
            out, (ids, got) = np.zeros((len(self.ids), k)), _arrays(product, "m")
            own = np.isin(ids, self.ids)
            out[np.searchsorted(self.ids, ids[own])] = got[own]
            return Factor.here(self.spark, self.ids, out)
        rows = self.df.select("idx").join(product, "idx", "left").fillna(0.0)
        return Factor(self.spark, self.rows, written(rows.select("idx", *(F.col(f"m{r}").alias(f"f{r}") for r in range(k))), "product"))

    def times(self, a: DataFrame, on: str, to: str, ids: Factor) -> Factor:
        """Data contracted with this factor over index `on`, as a factor with the ids of another one."""
        return ids.filled(R.product(a, self.df, on, to))

    def beside(self, *others: Factor) -> Factor:
        """The columns of factors of the same ids in one."""
        return self.map(lambda *xs: np.hstack(xs), *others)

    def part(self, start: int, width: int) -> Factor:
        """Some columns in a row."""
        if self.values is not None:
            return Factor.here(self.spark, self.ids, self.values[:, start : start + width])
        return Factor(self.spark, self.rows, self.df.select("idx", *(F.col(f"f{start + r}").alias(f"f{r}") for r in range(width))))

    def scaled(self, s: np.ndarray) -> Factor:
        dual = self.dual.scaled(s) if self.dual is not None else None
        if self.values is not None:
            return Factor.here(self.spark, self.ids, self.values * s, dual)
        return Factor(self.spark, self.rows, self.df.select("idx", *((F.col(f"f{r}") * float(x)).alias(f"f{r}") for r, x in enumerate(s))), dual=dual)

    def update(self, product: DataFrame, rule: str, g: np.ndarray, extra: float = 0.0, other: Factor | None = None) -> tuple[Factor, float]:
        """New rows by a rule, and the inner product of new rows and product (the middle term of the objective).

        Rows without a product - empty rows of the data - take part with zeros. extra adds extra * other to the product. A
        rule that keeps a dual variable finds it in this factor and leaves it in the new one.
        """
        k = len(g)
        if self.values is not None:
            m = self.filled(product).values
            right = m + extra * other.values if other is not None and extra else m
            if rule in KEEP:
                new, u = KEEP[rule](g, right, self.values, self.dual.values if self.dual is not None else None)
                return Factor.here(self.spark, self.ids, new, Factor.here(self.spark, self.ids, u)), float((new * m).sum())
            new = RULES[rule](g, right, self.values)
            return Factor.here(self.spark, self.ids, new), float((new * m).sum())
        joined = self.df.join(product, "idx", "left").fillna(0.0)
        beside = {"o": other.df if other is not None and extra else None, "u": self.dual.df if rule in KEEP and self.dual is not None else None}
        for name, df in beside.items():
            joined = joined.join(_renamed(df, name), "idx") if df is not None else joined.select("*", *(F.lit(0.0).alias(f"{name}{r}") for r in range(k)))
        names = ["idx", *cols(k), *cols(k, "m"), *cols(k, "u")]

        def run(batches):
            for batch in batches:
                f, m, o, u = (np.stack([batch.column(c).to_numpy() for c in cols(k, n)], 1) for n in "fmou")
                new, u = KEEP[rule](g, m + extra * o, f, u) if rule in KEEP else (RULES[rule](g, m + extra * o, f), u)
                yield pa.RecordBatch.from_arrays([batch.column("idx"), *(pa.array(np.ascontiguousarray(x[:, r])) for x in (new, m, u) for r in range(k))], names=names)

        new = written(joined.mapInArrow(run, _schema(names[1:])), "factor")
        dot = new.agg(F.sum(sum((F.col(f"f{r}") * F.col(f"m{r}") for r in range(k)), F.lit(0.0)))).first()[0] or 0.0
        dual = Factor(self.spark, self.rows, new.select("idx", *(F.col(f"u{r}").alias(f"f{r}") for r in range(k)))) if rule in KEEP else None
        return Factor(self.spark, self.rows, new.select("idx", *cols(k)), dual=dual), dot
