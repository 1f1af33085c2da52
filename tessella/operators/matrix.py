"""Matrices as coordinate rows (i, j, v) and factors as wide rows (idx, f0 .. fk-1).

A product is an equi-join on the contracted index and a grouped sum with one column for each factor, so partial sums are
taken before the shuffle and Catalyst chooses between broadcast and sort-merge by the size of the factor. A Gram matrix
is one aggregate over a factor; k x k values are all that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import split_start
from tessella.session import written

#: Repeated ids of documents that are broadcast; more of them are met by sort and merge.
FEW_IDS = 1_000_000


def cols(k: int, name: str = "f") -> list[str]:
    return [f"{name}{r}" for r in range(k)]


def rank(factor: DataFrame, name: str = "f") -> int:
    return sum(1 for c in factor.columns if c.startswith(name) and c[len(name) :].isdigit())


def formula_factor(ids: DataFrame, k: int, a: int = 7, b: int = 13, m: int = 11) -> DataFrame:
    """A deterministic start: f_r(i) = (1 + (a i + b r) mod m) / m; ids has column idx."""
    return ids.select("idx", *((((F.col("idx") * a + b * r) % m + 1) / F.lit(float(m))).alias(c) for r, c in enumerate(cols(k))))


def long_form(factor: DataFrame, name: str = "f", digits: int | None = 6) -> DataFrame:
    """(idx, r, x)."""
    k = rank(factor, name)
    out = factor.select("idx", F.posexplode(F.array(*cols(k, name))).alias("r", "x"))
    return out if digits is None else out.select("idx", F.col("r").cast("long").alias("r"), F.round("x", digits).alias("x"))


def product(a: DataFrame, factor: DataFrame, on: str, to: str) -> DataFrame:
    """Rows (idx, m0 ..): a contracted with factor over column `on`, kept by column `to`; on and to are i or j."""
    k = rank(factor)
    joined = a.join(factor.withColumnRenamed("idx", on), on)
    return joined.groupBy(F.col(to).alias("idx")).agg(*(F.sum(F.col("v") * F.col(f"f{r}")).alias(f"m{r}") for r in range(k)))


def at_w(a: DataFrame, w: DataFrame) -> DataFrame:
    return product(a, w, "i", "j")


def a_h(a: DataFrame, h: DataFrame) -> DataFrame:
    return product(a, h, "j", "i")


def gram(factor: DataFrame, name: str = "f") -> np.ndarray:
    """k x k, from one aggregate of k (k + 1) / 2 sums."""
    c = cols(rank(factor, name), name)
    pairs = [(p, q) for p in range(len(c)) for q in range(p, len(c))]
    row = factor.agg(*(F.sum(F.col(c[p]) * F.col(c[q])).alias(f"g{p}_{q}") for p, q in pairs)).first()
    g = np.zeros((len(c), len(c)))
    for (p, q), x in zip(pairs, row, strict=True):
        g[p, q] = g[q, p] = x or 0.0
    return g


def gram_rows(factor: DataFrame) -> DataFrame:
    """(p, q, g) as rows."""
    k = rank(factor)
    sums = factor.agg(*(F.sum(F.col(f"f{p}") * F.col(f"f{q}")).alias(f"g{p}_{q}") for p in range(k) for q in range(k)))
    each = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.col(f"g{p}_{q}").alias("g")) for p in range(k) for q in range(k)))
    return sums.select(F.inline(each))


def cross_gram(x: DataFrame, y: DataFrame) -> DataFrame:
    """(p, q, g) of X'Y."""
    k, n = rank(x), rank(y)
    other = y.select("idx", *(F.col(f"f{q}").alias(f"y{q}") for q in range(n)))
    sums = x.join(other, "idx").agg(*(F.sum(F.col(f"f{p}") * F.col(f"y{q}")).alias(f"g{p}_{q}") for p in range(k) for q in range(n)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.col(f"g{p}_{q}").alias("g")) for p in range(k) for q in range(n)))))


def times_small(factor: DataFrame, g: np.ndarray) -> DataFrame:
    """factor times a k x k matrix, row by row."""
    k = len(g)
    return factor.select("idx", *(sum((F.col(f"f{p}") * float(g[p, r]) for p in range(k)), F.lit(0.0)).alias(f"f{r}") for r in range(k)))


def regularized(g: np.ndarray, l2: float = 0.0, l12: float = 0.0) -> np.ndarray:
    """Gram plus l2 on the diagonal and l12 everywhere; the latter penalises the squared norm of row sums."""
    return g + l2 * np.eye(len(g)) + l12


def on_pattern(pattern: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """(i, j, v, wh): values of W H' at the cells of a pattern."""
    k = rank(w)
    right = h.select(F.col("idx").alias("j"), *(F.col(f"f{r}").alias(f"h{r}") for r in range(k)))
    joined = pattern.join(w.withColumnRenamed("idx", "i"), "i").join(right, "j")
    return joined.select("i", "j", "v", sum((F.col(f"f{r}") * F.col(f"h{r}") for r in range(k)), F.lit(0.0)).alias("wh"))


def norm_sq(a: DataFrame) -> float:
    return a.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0


def fit_error_sq(a: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """One row: squared error of A - W H' by the cells that are there and the Gram identity, without the dense product."""
    seen = on_pattern(a, w, h).agg(F.sum((F.col("v") - F.col("wh")) ** 2).alias("on"), F.sum(F.col("wh") ** 2).alias("wh"))
    both = gram_rows(w).join(gram_rows(h).withColumnRenamed("g", "g2"), ["p", "q"]).agg(F.sum(F.col("g") * F.col("g2")).alias("all"))
    return seen.join(both).select((F.col("on") + F.col("all") - F.col("wh")).alias("err_sq"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetrize(a: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    return a.select("i", "j", "v").unionByName(transpose(a)).groupBy("i", "j").agg((F.sum("v") / 2).alias("v"))


def symmetry_check(a: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Cells whose mirror image is missing or differs."""
    b = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("mirror"))
    return a.join(b, ["i", "j"], "left").where(F.col("mirror").isNull() | (F.abs(F.col("v") - F.col("mirror")) > tol))


def col_l2_normalize(a: DataFrame) -> DataFrame:
    """Columns of length one. Norms are summed up before the shuffle and joined back: a long column is split over tasks."""
    norms = a.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return a.join(norms, "j").select("i", "j", F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(F.col("v")).alias("v"))


def max_normalize(a: DataFrame) -> DataFrame:
    return a.join(a.agg(F.max("v").alias("top"))).select("i", "j", (F.col("v") / F.col("top")).alias("v"))


def normalize_by_w(w: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of W of length one, their lengths carried into H."""
    k = rank(w)
    n = [float(np.sqrt(x)) or 1.0 for x in np.diag(gram(w))]
    scale = lambda f, s: f.select("idx", *((F.col(f"f{r}") * s[r]).alias(f"f{r}") for r in range(k)))
    return scale(w, [1 / x for x in n]), scale(h, n)


def col_subset(a: DataFrame, columns: DataFrame, relabel: bool = False) -> DataFrame:
    """Columns named by a frame (j), or (old j, new j) if they are to be renamed."""
    if not relabel:
        return a.join(columns, "j", "left_semi")
    return a.join(columns.select(F.col("j"), F.col("new_j")), "j").select("i", F.col("new_j").alias("j"), "v")


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with _n, the place 0, 1 .. of each row in an order, which should be total.

    Rows are parted into ranges of the order and counted by range; a row's place is that in its range plus the sizes of the
    ranges before, of which one number each comes to the driver.
    """
    spark = df.sparkSession
    parted = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    start, rows = 0, []
    for part, n in sorted(parted.groupBy("_part").count().collect()):
        rows.append((part, start))
        start += n
    starts = spark.createDataFrame(rows, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_at", place).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


def permutation(ids: DataFrame, column: str, seed: int) -> DataFrame:
    """(column, _new): new ids 0, 1 .. for the distinct ids of a frame, in the order of a digest of seed and id."""
    key = F.md5(F.concat_ws(",", F.lit(seed).cast("string"), F.col(column).cast("string")))
    return numbered(ids.select(column).distinct().withColumn("_key", key), "_key", column).select(column, F.col("_n").alias("_new"))


def permuted(a: DataFrame, columns: dict[str, int]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The matrix or tensor with new ids for some indices, each by a seed, and the permutations (old id, _new) used."""
    used = {}
    for column, seed in columns.items():
        used[column] = permutation(a, column, seed)
        a = a.join(used[column], column).withColumn(column, F.col("_new")).select(*a.columns)
    return a, used


def bag_of_words(docs: DataFrame, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, j, v): counts of the `vocabulary` terms in most documents; terms are runs of a-z, j their place in that order.

    A row whose id no other row has is a document, so its distinct terms are counted where they stand; only rows of repeated
    ids bring pairs of document and term together. Documents are then counted by the chosen terms alone.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    twice = written(rows.groupBy("i").count().where("count > 1").select(F.col("i").alias("id")), "repeated-ids")
    twice = F.broadcast(twice) if twice.count() <= FEW_IDS else twice.hint("merge")
    same = F.col("i").eqNullSafe(F.col("id"))
    once = rows.join(twice, same, "left_anti").select(F.explode(F.array_distinct(found)).alias("term"))
    more = rows.join(twice, same, "left_semi").select("i", F.explode(F.array_distinct(found)).alias("term")).distinct().select("term")
    top = once.unionByName(more).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(vocabulary)
    ranked = top.withColumn("j", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).cast("long")).select("term", "j")
    every = rows.select("i", F.explode(found).alias("term"))
    number = F.count(F.lit(1)).cast("double").alias("v")
    if vocabulary <= 100_000:
        return every.join(F.broadcast(ranked), "term").groupBy("i", "j").agg(number)
    return every.groupBy("i", "term").agg(number).join(ranked, "term").select("i", "j", "v")


def top_terms(factor: DataFrame, n: int) -> DataFrame:
    """(r, place, idx, x): the n largest entries of each column, each task's n first."""
    order = Window.partitionBy("r").orderBy(F.desc("x"), "idx")
    rows = long_form(factor, digits=None)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("r").cast("long").alias("r"), F.col("place").cast("long").alias("place"), "idx", "x")


def argmax_cluster(factor: DataFrame) -> DataFrame:
    """(idx, cluster): the first of the largest entries of each row."""
    f = F.array(*cols(rank(factor)))
    return factor.select("idx", (F.array_position(f, F.array_max(f)) - 1).cast("long").alias("cluster"))


def uneven_partition(a: DataFrame, m: int, n: int, pr: int, pc: int) -> DataFrame:
    """(bi, bj, i, j, v) on a grid whose first blocks have one row or column more, so that none is left over."""

    def of(x: str, size: int, parts: int) -> tuple:
        small, more = divmod(size, parts)
        wide = more * (small + 1)
        block = F.when(F.col(x) < wide, F.floor(F.col(x) / (small + 1))).otherwise(more + F.floor((F.col(x) - wide) / max(small, 1)))
        return block, F.col(x) - split_start(F.lit(size), F.lit(parts), block)

    (bi, i), (bj, j) = of("i", m, pr), of("j", n, pc)
    return a.select(bi.cast("long").alias("bi"), bj.cast("long").alias("bj"), i.cast("long").alias("i"), j.cast("long").alias("j"), "v")


def block_columns(a: DataFrame, n: int, blocks: int, block: int) -> DataFrame:
    """The columns of one of so many blocks of n columns (the last takes what is left), with their own ids from 0."""
    size = n // blocks
    start = block * size
    end = n if block == blocks - 1 else start + size
    return a.where((F.col("j") >= start) & (F.col("j") < end)).select("i", (F.col("j") - start).alias("j"), "v")


def dot(x: DataFrame, y: DataFrame) -> float:
    """Inner product of two vectors or factors of equal width, over all their cells."""
    k = rank(x)
    other = y.select("idx", *(F.col(f"f{r}").alias(f"y{r}") for r in range(k)))
    return float(x.join(other, "idx").agg(F.sum(sum((F.col(f"f{r}") * F.col(f"y{r}") for r in range(k)), F.lit(0.0)))).first()[0] or 0.0)


def exact_error_sq(a: DataFrame, w: DataFrame, h: DataFrame, block: int = 1024) -> DataFrame:
    """One row: squared error of A - W H' cell by cell, empty ones too, by blocks of rows that meet all of H.

    For checks of fit_error_sq(): its work is that of the dense product. H goes to blocks of rows in blocks of its own, so
    a task holds block x block values at a time.
    """
    k = rank(w)
    at = lambda f, name: f.select(F.floor(F.col("idx") / block).alias(name), F.col("idx"), F.array(*cols(k)).alias("f"))
    left = at(w, "bi").groupBy("bi").agg(F.collect_list(F.struct("idx", "f")).alias("w"))
    right = at(h, "bj").groupBy("bj").agg(F.collect_list(F.struct("idx", "f")).alias("h"))
    cells = a.groupBy(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj")).agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))
    last = right.agg(F.max("bj")).first()[0] or 0
    grid = left.withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(right, "bj").join(cells, ["bi", "bj"], "left")

    def run(batches):
        for batch in batches:
            for cell, x, y in zip(*(batch.column(c) for c in ("cells", "w", "h")), strict=True):
                ids, rows = _block(x.values)
                jds, columns = _block(y.values)
                diff = -(rows @ columns.T)
                if cell.is_valid and len(cell.values):
                    i, j, v = (cell.values.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    diff[np.searchsorted(ids, i), np.searchsorted(jds, j)] += v
                yield pa.RecordBatch.from_arrays([pa.array([float((diff**2).sum())])], names=["e"])

    return grid.select("cells", "w", "h").mapInArrow(run, "e double").agg(F.sum("e").alias("err_sq"))


def _block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their rows."""
    ids = rows.field(0).to_numpy(zero_copy_only=False)
    values = rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], values[order]


def block_partition(a: DataFrame, m: int, n: int, pr: int, pc: int) -> DataFrame:
    """(bi, bj, i, j, v) on a grid of even blocks with local indices; rows and columns beyond the even part go."""
    br, bc = m // pr, n // pc
    kept = a.where((F.col("i") < br * pr) & (F.col("j") < bc * pc))
    return kept.select(F.floor(F.col("i") / br).alias("bi"), F.floor(F.col("j") / bc).alias("bj"), (F.col("i") % br).alias("i"), (F.col("j") % bc).alias("j"), "v")


def with_columns_of(factor: DataFrame, exprs: Sequence) -> DataFrame:
    return factor.select("idx", *(e.alias(f"f{r}") for r, e in enumerate(exprs)))
