"""Queries of the library over the standard tables, and the SQL they are held against.

Start values are formulas, so that both sides compute the same; floating results are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions.text import terms
from tessella.operators import kernels
from tessella.operators import matrix as R
from tessella.operators import tensor as X
from tessella.plans.factors import Factor
from tessella.plans.hier import hier_nmf, power_sigma, score
from tessella.plans.joint import gradients, joint_nmf, objective
from tessella.plans.nmf import nmf
from tessella.plans.ntf import ntf
from tessella.sources import generate as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
K = 3


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = " ".join(sql.split())
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- inputs


def m1(spark: SparkSession, d: str) -> DataFrame:
    """Supplier x part bucket."""
    t = table(spark, d, "lineitem")
    return t.groupBy(F.col("l_suppkey").cast("long").alias("i"), (F.col("l_partkey") % 50).cast("long").alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))


def s1(spark: SparkSession, d: str) -> DataFrame:
    """Nation x nation, before it is made symmetric."""
    li, o, c, s = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))


def t1(spark: SparkSession, d: str) -> DataFrame:
    """Line number x return flag x month."""
    t = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    return t.groupBy(F.col("l_linenumber").cast("long").alias("i0"), flag.alias("i1"), F.month("l_shipdate").cast("long").alias("i2")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))


def w0(a: DataFrame, k: int = K) -> DataFrame:
    return R.formula_factor(a.select(F.col("i").alias("idx")).distinct(), k, 7, 13, 11)


def h0(a: DataFrame, k: int = K) -> DataFrame:
    return R.formula_factor(a.select(F.col("j").alias("idx")).distinct(), k, 5, 3, 7)


def fs(t: DataFrame, k: int = K) -> list[DataFrame]:
    return [R.formula_factor(t.select(F.col(f"i{m}").alias("idx")).distinct(), k, 7 - 2 * m, 13 - 5 * m, 11 - 2 * m) for m in range(X.order(t))]


def longer(df: DataFrame, name: str = "f", digits: int = 6) -> DataFrame:
    return R.long_form(df, name, digits)


A = "a AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey % 50 AS BIGINT) AS j, SUM(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2)"
RR = "rr AS (SELECT CAST(r AS BIGINT) AS r FROM (VALUES (0), (1), (2)) t(r))"
W = f"{RR}, w AS (SELECT i, r, ((i * 7 + r * 13) % 11 + 1) / CAST(11 AS DOUBLE) AS x FROM (SELECT DISTINCT i FROM a) u CROSS JOIN rr)"
H = "h AS (SELECT j, r, ((j * 5 + r * 3) % 7 + 1) / CAST(7 AS DOUBLE) AS x FROM (SELECT DISTINCT j FROM a) u CROSS JOIN rr)"
BASE = f"WITH {A}, {W}, {H}"
GW = "gw AS (SELECT p.r AS p, q.r AS q, SUM(p.x * q.x) AS g FROM w p JOIN w q ON p.i = q.i GROUP BY 1, 2)"
GH = "gh AS (SELECT p.r AS p, q.r AS q, SUM(p.x * q.x) AS g FROM h p JOIN h q ON p.j = q.j GROUP BY 1, 2)"
P = "p AS (SELECT a.j, w.r, SUM(a.v * w.x) AS x FROM a JOIN w ON a.i = w.i GROUP BY 1, 2)"
Q = "q AS (SELECT a.i, h.r, SUM(a.v * h.x) AS x FROM a JOIN h ON a.j = h.j GROUP BY 1, 2)"
S = """s0 AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
T = """t AS (SELECT CAST(l_linenumber AS BIGINT) AS i0, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS i1,
 CAST(month(l_shipdate) AS BIGINT) AS i2, SUM(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2, 3)"""
F3 = f"""{RR}, f0 AS (SELECT idx, r, ((idx * 7 + r * 13) % 11 + 1) / CAST(11 AS DOUBLE) AS x FROM (SELECT DISTINCT i0 AS idx FROM t) u CROSS JOIN rr),
 f1 AS (SELECT idx, r, ((idx * 5 + r * 8) % 9 + 1) / CAST(9 AS DOUBLE) AS x FROM (SELECT DISTINCT i1 AS idx FROM t) u CROSS JOIN rr),
 f2 AS (SELECT idx, r, ((idx * 3 + r * 3) % 7 + 1) / CAST(7 AS DOUBLE) AS x FROM (SELECT DISTINCT i2 AS idx FROM t) u CROSS JOIN rr)"""
TT = f"WITH {T}, {F3}"

# ---- products and reductions


@query(f"WITH {A} SELECT i, j, v FROM a")
def coo_matrix(spark, d):
    return m1(spark, d)


@query(f"{BASE}, {P} SELECT j AS idx, r, round(x, 4) AS x FROM p")
def at_w(spark, d):
    a = m1(spark, d)
    return longer(R.at_w(a, w0(a)), "m", 4)


@query(f"{BASE}, {Q} SELECT i AS idx, r, round(x, 4) AS x FROM q")
def a_h(spark, d):
    a = m1(spark, d)
    return longer(R.a_h(a, h0(a)), "m", 4)


@query(f"{BASE}, {GW} SELECT p, q, round(g, 5) AS g FROM gw")
def gram(spark, d):
    return R.gram_rows(w0(m1(spark, d))).select("p", "q", F.round("g", 5).alias("g"))


@query(f"{BASE} SELECT p.r AS p, q.r AS q, round(SUM(p.x * ((q.i * 5 + q.r * 3) % 7 + 1) / CAST(7 AS DOUBLE)), 5) AS g FROM w p JOIN w q ON p.i = q.i GROUP BY 1, 2")
def cross_gram(spark, d):
    a = m1(spark, d)
    ids = a.select(F.col("i").alias("idx")).distinct()
    return R.cross_gram(w0(a), R.formula_factor(ids, K, 5, 3, 7)).select("p", "q", F.round("g", 5).alias("g"))


@query(f"{BASE}, {GW} SELECT h.j AS idx, gw.q AS r, round(SUM(h.x * gw.g), 5) AS x FROM h JOIN gw ON h.r = gw.p GROUP BY 1, 2")
def factor_times_gram(spark, d):
    a = m1(spark, d)
    return longer(R.times_small(h0(a), R.gram(w0(a))), digits=5)


@query(f"{BASE} SELECT a.i, a.j, round(SUM(w.x * h.x), 6) AS wh FROM a JOIN w ON a.i = w.i JOIN h ON a.j = h.j AND w.r = h.r GROUP BY 1, 2")
def reconstruct(spark, d):
    a = m1(spark, d)
    return R.on_pattern(a, w0(a), h0(a)).select("i", "j", F.round("wh", 6).alias("wh"))


@query(f"WITH {A} SELECT round(sqrt(SUM(v * v)), 4) AS norm FROM a")
def frob_norm(spark, d):
    return m1(spark, d).agg(F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm"))


@query(f"{BASE}, {GW}, {GH} SELECT round(SUM(gw.g * gh.g), 3) AS trace FROM gw JOIN gh ON gw.p = gh.q AND gw.q = gh.p")
def trace_product(spark, d):
    a = m1(spark, d)
    other = R.gram_rows(h0(a)).select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("g").alias("g2"))
    return R.gram_rows(w0(a)).join(other, ["p", "q"]).agg(F.round(F.sum(F.col("g") * F.col("g2")), 3).alias("trace"))


@query(f"{BASE} SELECT round(sqrt(SUM(s * s)), 5) AS l12 FROM (SELECT i, SUM(x) AS s FROM w GROUP BY 1) u")
def l12_norm(spark, d):
    w = w0(m1(spark, d))
    return w.select(sum((F.col(c) for c in R.cols(K)), F.lit(0.0)).alias("s")).agg(F.round(F.sqrt(F.sum(F.col("s") ** 2)), 5).alias("l12"))


EXACT = f"""{BASE}, c AS (SELECT w.i, h.j, SUM(w.x * h.x) AS x FROM w JOIN h ON w.r = h.r GROUP BY 1, 2)
 SELECT round(SUM((COALESCE(a.v, 0) - c.x) * (COALESCE(a.v, 0) - c.x)) / 1000, 3) AS err_sq FROM c LEFT JOIN a ON a.i = c.i AND a.j = c.j"""


@query(EXACT)
def fast_error(spark, d):
    a = m1(spark, d)
    return R.fit_error_sq(a, w0(a), h0(a)).select(F.round(F.col("err_sq") / 1000, 3).alias("err_sq"))


@query(EXACT)
def exact_error(spark, d):
    a = m1(spark, d)
    return R.exact_error_sq(a, w0(a), h0(a)).select(F.round(F.col("err_sq") / 1000, 3).alias("err_sq"))


@query(EXACT.replace("round(SUM((COALESCE(a.v, 0) - c.x) * (COALESCE(a.v, 0) - c.x)) / 1000, 3) AS err_sq", "round(sqrt(SUM((COALESCE(a.v, 0) - c.x) * (COALESCE(a.v, 0) - c.x)) / (SELECT SUM(v * v) FROM a)), 8) AS rel_error"))
def nmf_rel_error(spark, d):
    a = m1(spark, d)
    both = R.fit_error_sq(a, w0(a), h0(a)).join(a.agg(F.sum(F.col("v") ** 2).alias("n")))
    return both.select(F.round(F.sqrt(F.col("err_sq") / F.col("n")), 8).alias("rel_error"))


@query(f"{BASE} SELECT round(SUM(w.x * ((w.i * 5 + w.r * 3) % 7 + 1) / CAST(7 AS DOUBLE)), 5) AS dot FROM w")
def dot_product(spark, d):
    a = m1(spark, d)
    other = R.formula_factor(a.select(F.col("i").alias("idx")).distinct(), K, 5, 3, 7)
    return spark.createDataFrame([(round(R.dot(w0(a), other), 5),)], "dot double")


@query(f"WITH {A} SELECT COUNT(CASE WHEN v > 0 THEN 1 END) / CAST((SELECT COUNT(DISTINCT i) FROM a) * (SELECT COUNT(DISTINCT j) FROM a) AS DOUBLE) AS density FROM a")
def density(spark, d):
    a = m1(spark, d)
    return a.agg((F.sum(F.when(F.col("v") > 0, 1).otherwise(0)) / (F.countDistinct("i") * F.countDistinct("j"))).alias("density"))


@query(f"{BASE} SELECT round(sqrt(SUM((x - y) * (x - y))), 5) AS gap FROM (SELECT i, r, x, ((i * 5 + r * 3) % 7 + 1) / CAST(7 AS DOUBLE) AS y FROM w) u")
def symmdiff(spark, d):
    a = m1(spark, d)
    x, y = R.long_form(w0(a), digits=None), R.long_form(R.formula_factor(a.select(F.col("i").alias("idx")).distinct(), K, 5, 3, 7), digits=None)
    j = x.join(y.withColumnRenamed("x", "y"), ["idx", "r"], "full")
    return j.agg(F.round(F.sqrt(F.sum((F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) ** 2)), 5).alias("gap"))


@query(f"WITH {A} SELECT round(MAX(v), 4) AS max_v, round(MIN(v), 4) AS min_v, round(SUM(v), 2) AS sum_v, round(AVG(v), 4) AS mean_v FROM a")
def reductions(spark, d):
    return m1(spark, d).agg(F.round(F.max("v"), 4).alias("max_v"), F.round(F.min("v"), 4).alias("min_v"), F.round(F.sum("v"), 2).alias("sum_v"), F.round(F.avg("v"), 4).alias("mean_v"))


# ---- projections and preparation

E5 = "e AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(p AS BIGINT) AS j, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS p) u)"


def m5(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def _projected(name: str, column, sql: str) -> None:
    query(f"WITH {E5} SELECT i, j, round({sql}, 9) AS v FROM e", name)(lambda spark, d: m5(spark, d).select("i", "j", F.round(column(F.col("v")), 9).alias("v")))


_projected("nonneg_project", C.nonneg, "greatest(v, 0.0)")
_projected("floor_small", lambda v: C.floor_small(v, 0.05, 0.001), "CASE WHEN v < 0.05 THEN 0.001 ELSE v END")
_projected("floor_abs", lambda v: C.floor_abs(v, 0.05, 0.001), "CASE WHEN abs(v) < 0.05 THEN 0.001 ELSE v END")
_projected("bound", lambda v: C.bound(v, -0.1, 0.1), "least(greatest(v, -0.1), 0.1)")
_projected("scale_shift", lambda v: v * 2.5 + 0.25, "v * 2.5 + 0.25")
_projected("absolute", F.abs, "abs(v)")
_projected("truncate_decimals", lambda v: C.truncate(v, 3), "floor(v * 1000.0) / 1000.0")
_projected("adjust_values", lambda v: C.adjust(v, 5.0, 10.0), "CASE WHEN v < 0 THEN CAST(10 AS DOUBLE) ELSE CAST(ceil(v * 5.0 + 10.0) AS DOUBLE) END")


@query(f"{BASE}, {P} SELECT h.j AS idx, h.r, round(h.x * h.x / (p.x + 1e-6), 9) AS x FROM h JOIN p ON h.j = p.j AND h.r = p.r")
def hadamard_div(spark, d):
    a = m1(spark, d)
    j = h0(a).join(R.at_w(a, w0(a)), "idx")
    return longer(R.with_columns_of(j, [C.safe_div(F.col(f"f{r}") ** 2, F.col(f"m{r}"), 1e-6) for r in range(K)]), digits=9)


@query(f"{BASE}, {GW} SELECT p, q, round(g + CASE WHEN p = q THEN 0.5 ELSE 0 END + 0.25, 5) AS g FROM gw")
def apply_reg(spark, d):
    g = R.gram_rows(w0(m1(spark, d)))
    return g.select("p", "q", F.round(F.col("g") + F.when(F.col("p") == F.col("q"), 0.5).otherwise(0.0) + 0.25, 5).alias("g"))


@query(f"{BASE}, {P} SELECT h.j AS idx, h.r, round(p.x + 0.3 * h.x, 4) AS x FROM h JOIN p ON h.j = p.j AND h.r = p.r")
def apply_sym_reg(spark, d):
    a = m1(spark, d)
    j = h0(a).join(R.at_w(a, w0(a)), "idx")
    return longer(R.with_columns_of(j, [F.col(f"m{r}") + 0.3 * F.col(f"f{r}") for r in range(K)]), digits=4)


@query(f"{BASE}, n AS (SELECT r, sqrt(SUM(x * x)) AS n FROM w GROUP BY 1) SELECT 'h' AS side, h.j AS idx, h.r, round(h.x * n.n, 5) AS x FROM h JOIN n ON h.r = n.r UNION ALL SELECT 'w', w.i, w.r, round(w.x / n.n, 6) FROM w JOIN n ON w.r = n.r")
def normalize_by_w(spark, d):
    a = m1(spark, d)
    w, h = R.normalize_by_w(w0(a), h0(a))
    return longer(h, digits=5).select(F.lit("h").alias("side"), "*").unionByName(longer(w).select(F.lit("w").alias("side"), "*"))


@query(f"WITH {A}, n AS (SELECT j, sqrt(SUM(v * v)) AS n FROM a GROUP BY 1) SELECT i, a.j, round(v / n, 8) AS v FROM a JOIN n ON a.j = n.j")
def col_l2_normalize(spark, d):
    return R.col_l2_normalize(m1(spark, d)).select("i", "j", F.round("v", 8).alias("v"))


@query(f"WITH {A} SELECT i, j, round(v / (SELECT MAX(v) FROM a), 8) AS v FROM a")
def max_normalize(spark, d):
    return R.max_normalize(m1(spark, d)).select("i", "j", F.round("v", 8).alias("v"))


@query(f"WITH {S} SELECT i, j, round(SUM(v) / 2, 4) AS v FROM (SELECT i, j, v FROM s0 UNION ALL SELECT j, i, v FROM s0) u GROUP BY 1, 2")
def symmetrize(spark, d):
    return R.symmetrize(s1(spark, d)).select("i", "j", F.round("v", 4).alias("v"))


@query(f"WITH {S} SELECT s0.i, s0.j, s0.v FROM s0 LEFT JOIN s0 b ON s0.i = b.j AND s0.j = b.i WHERE b.v IS NULL OR abs(s0.v - b.v) > 1e-9")
def symmetry_check(spark, d):
    return R.symmetry_check(s1(spark, d)).select("i", "j", "v")


@query(f"WITH {A} SELECT j AS i, i AS j, v FROM a")
def transpose(spark, d):
    return R.transpose(m1(spark, d))


@query(f"WITH {A} SELECT i, j, v FROM a WHERE j IN (SELECT j FROM a GROUP BY j HAVING SUM(v) > (SELECT SUM(v) / COUNT(DISTINCT j) FROM a))")
def col_subset(spark, d):
    a = m1(spark, d)
    mean = a.agg((F.sum("v") / F.countDistinct("j")).alias("mean"))
    return R.col_subset(a, a.groupBy("j").agg(F.sum("v").alias("s")).join(mean, F.col("s") > F.col("mean")).select("j")).select("i", "j", "v")


@query(f"""WITH {A}, c AS (SELECT j, SUM(v) AS s FROM a GROUP BY 1), n AS (SELECT j, row_number() OVER (ORDER BY s DESC, j) - 1 AS nj FROM c WHERE s > (SELECT AVG(s) FROM c))
 SELECT a.i, CAST(n.nj AS BIGINT) AS j, a.v FROM a JOIN n ON a.j = n.j""")
def col_relabel(spark, d):
    a = m1(spark, d)
    sums = a.groupBy("j").agg(F.sum("v").alias("s"))
    above = sums.join(sums.agg(F.avg("s").alias("mean")), F.col("s") > F.col("mean")).select("j", "s")
    return R.col_subset(a, R.numbered(above, F.desc("s"), F.col("j")).withColumnRenamed("_n", "new_j"), relabel=True)


def _sides(a: DataFrame) -> tuple[int, int]:
    row = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    return int(row[0]), int(row[1])


_SIZE = "z AS (SELECT MAX(i) + 1 AS m, MAX(j) + 1 AS n FROM a)"


@query(f"""WITH {A}, {_SIZE} SELECT i // (m // 9) AS bi, j // (n // 3) AS bj, i % (m // 9) AS i, j % (n // 3) AS j, v FROM a CROSS JOIN z WHERE i < m // 9 * 9 AND j < n // 3 * 3""")
def block_partition(spark, d):
    a = m1(spark, d)
    return R.block_partition(a, *_sides(a), 9, 3)


@query(f"""WITH {A}, {_SIZE}, s AS (SELECT *, m // 9 AS p, m % 9 AS x, n // 4 AS q, n % 4 AS y FROM a CROSS JOIN z),
 t AS (SELECT *, CASE WHEN i < x * (p + 1) THEN i // (p + 1) ELSE x + (i - x * (p + 1)) // p END AS bi, CASE WHEN j < y * (q + 1) THEN j // (q + 1) ELSE y + (j - y * (q + 1)) // q END AS bj FROM s)
 SELECT CAST(bi AS BIGINT) AS bi, CAST(bj AS BIGINT) AS bj, CAST(i - (bi * p + least(bi, x)) AS BIGINT) AS i, CAST(j - (bj * q + least(bj, y)) AS BIGINT) AS j, v FROM t""")
def uneven_partition(spark, d):
    a = m1(spark, d)
    return R.uneven_partition(a, *_sides(a), 9, 4)


@query(f"WITH {A}, {_SIZE} SELECT i, CAST(j - n // 4 * 3 AS BIGINT) AS j, v FROM a CROSS JOIN z WHERE j >= n // 4 * 3")
def block_columns(spark, d):
    a = m1(spark, d)
    return R.block_columns(a, _sides(a)[1], 4, 3)


@query("SELECT CAST(o_orderkey AS BIGINT) AS n, CAST(o_orderkey // 4 + CASE WHEN o_custkey % 4 < o_orderkey % 4 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST((o_custkey % 4) * (o_orderkey // 4) + least(o_custkey % 4, o_orderkey % 4) AS BIGINT) AS start FROM orders")
def itersplit(spark, d):
    n, r = F.col("o_orderkey").cast("long"), (F.col("o_custkey") % 4).cast("long")
    return table(spark, d, "orders").select(n.alias("n"), C.split_size(n, F.lit(4), r).cast("long").alias("size"), C.split_start(n, F.lit(4), r).cast("long").alias("start"))


@query(f"WITH {T} SELECT i0, i1, i2, i0 + 8 * (i1 + 3 * i2) AS ind, (i0 + 8 * (i1 + 3 * i2)) % 8 AS s0, ((i0 + 8 * (i1 + 3 * i2)) // 8) % 3 AS s1, ((i0 + 8 * (i1 + 3 * i2)) // 24) % 13 AS s2 FROM t")
def sub2ind(spark, d):
    t = t1(spark, d).select("i0", "i1", "i2", C.sub2ind([F.col("i0"), F.col("i1"), F.col("i2")], [8, 3, 13]).alias("ind"))
    return t.select("*", *(c.cast("long").alias(f"s{m}") for m, c in enumerate(C.ind2sub(F.col("ind"), [8, 3, 13]))))


_NEW = "SELECT {0} AS old, CAST(row_number() OVER (ORDER BY md5(concat_ws(',', {1}, {0})), {0}) - 1 AS BIGINT) AS new FROM (SELECT DISTINCT {0} FROM a) u"


@query(f"WITH {A}, n AS ({_NEW.format('i', 3)}), m AS ({_NEW.format('j', 5)}) SELECT n.new AS i, m.new AS j, v FROM a JOIN n ON a.i = n.old JOIN m ON a.j = m.old")
def permute(spark, d):
    return R.permuted(m1(spark, d), {"i": 3, "j": 5})[0]


@query(f"WITH {A} SELECT 'i' AS side, old, new FROM ({_NEW.format('i', 3)}) x UNION ALL SELECT 'j', old, new FROM ({_NEW.format('j', 5)}) y")
def permutation(spark, d):
    used = R.permuted(m1(spark, d), {"i": 3, "j": 5})[1]
    one = [p.select(F.lit(c).alias("side"), F.col(c).alias("old"), F.col("_new").alias("new")) for c, p in used.items()]
    return one[0].unionByName(one[1])


BAG = """x AS (SELECT doc_id AS i, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT i, term, CAST(COUNT(*) AS DOUBLE) AS v FROM x GROUP BY 1, 2),
 top AS (SELECT term, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, term) - 1 AS BIGINT) AS j FROM c GROUP BY term ORDER BY j LIMIT 500), b AS (SELECT i, j, v FROM c JOIN top ON c.term = top.term)"""


@query(f"WITH {BAG} SELECT i, j, v FROM b")
def bag_of_words(spark, d):
    return R.bag_of_words(table(spark, d, "documents"), 500)


@query(f"{BASE}, {P} SELECT r, place, idx, round(x, 4) AS x FROM (SELECT r, CAST(row_number() OVER (PARTITION BY r ORDER BY x DESC, j) AS BIGINT) AS place, j AS idx, x FROM p) u WHERE place <= 5")
def top_terms(spark, d):
    a = m1(spark, d)
    p = R.at_w(a, w0(a)).withColumnsRenamed({f"m{r}": f"f{r}" for r in range(K)})
    return R.top_terms(p, 5).withColumn("x", F.round("x", 4))


@query(f"{BASE} SELECT i AS idx, MIN(r) AS cluster FROM w x WHERE x.x = (SELECT MAX(y.x) FROM w y WHERE y.i = x.i) GROUP BY 1")
def argmax_cluster(spark, d):
    return R.argmax_cluster(w0(m1(spark, d)))


@query("""WITH p AS (SELECT doc_id AS i, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), 'https?://[^ \\t\\n\\r\\f]+', ' ', 'g')), '[a-z]+')) AS term
 FROM (SELECT page_id AS doc_id, html FROM pages) u) SELECT term, COUNT(*) AS n, COUNT(DISTINCT i) AS pages FROM p WHERE length(term) >= 2 AND term NOT IN ('the', 'of', 'and') GROUP BY 1""")
def clean_terms(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(terms(F.col("html"), ["the", "of", "and"], 2)).alias("term"))
    per_page = t.groupBy("term", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("term").agg(F.sum("n").cast("long").alias("n"), F.count("page_id").alias("pages"))


# ---- steps of the update rules


@query(f"{BASE}, {GW}, {P}, hg AS (SELECT h.j, gw.q AS r, SUM(h.x * gw.g) AS x FROM h JOIN gw ON h.r = gw.p GROUP BY 1, 2) SELECT h.j AS idx, h.r, round(h.x * p.x / (hg.x + 1e-17), 6) AS x FROM h JOIN p ON h.j = p.j AND h.r = p.r JOIN hg ON h.j = hg.j AND h.r = hg.r")
def mu_step_h(spark, d):
    a = m1(spark, d)
    w = w0(a)
    return longer(Factor.of(h0(a)).update(R.at_w(a, w), "MU", R.gram(w))[0].df)


@query(f"{BASE}, {GH}, {Q}, wg AS (SELECT w.i, gh.q AS r, SUM(w.x * gh.g) AS x FROM w JOIN gh ON w.r = gh.p GROUP BY 1, 2) SELECT w.i AS idx, w.r, round(w.x * q.x / (wg.x + 1e-17), 6) AS x FROM w JOIN q ON w.i = q.i AND w.r = q.r JOIN wg ON w.i = wg.i AND w.r = wg.r")
def mu_step_w(spark, d):
    a = m1(spark, d)
    h = h0(a)
    return longer(Factor.of(w0(a)).update(R.a_h(a, h), "MU", R.gram(h))[0].df)


def _g(name: str, k: int) -> str:
    return ", ".join(f"MAX(CASE WHEN p = {p} AND q = {q} THEN g END) AS g{p}{q}" for p in range(k) for q in range(k)) + f" FROM {name}"


def _wide(name: str, key: str, out: str, k: int) -> str:
    return f"SELECT {key}, " + ", ".join(f"MAX(CASE WHEN r = {r} THEN x END) AS {out}{r}" for r in range(k)) + f" FROM {name} GROUP BY 1"


_HALS = f"""{BASE}, {GW}, {P}, g AS (SELECT {_g('gw', 3)}), hw AS ({_wide('h', 'j', 'h', 3)}), pw AS ({_wide('p', 'j', 'm', 3)}), z AS (SELECT * FROM hw JOIN pw USING (j) CROSS JOIN g),
 z0 AS (SELECT *, greatest(h0 + (m0 - (h0 * g00 + h1 * g10 + h2 * g20)) / g00, 1e-17) AS n0 FROM z), z1 AS (SELECT *, greatest(h1 + (m1 - (n0 * g01 + h1 * g11 + h2 * g21)) / g11, 1e-17) AS n1 FROM z0),
 z2 AS (SELECT *, greatest(h2 + (m2 - (n0 * g02 + n1 * g12 + h2 * g22)) / g22, 1e-17) AS n2 FROM z1)
 SELECT j AS idx, CAST(0 AS BIGINT) AS r, round(n0, 6) AS x FROM z2 UNION ALL SELECT j, 1, round(n1, 6) FROM z2 UNION ALL SELECT j, 2, round(n2, 6) FROM z2"""


@query(_HALS)
def hals_step_h(spark, d):
    a = m1(spark, d)
    w = w0(a)
    return longer(Factor.of(h0(a)).update(R.at_w(a, w), "HALS", R.gram(w))[0].df)


_G2 = f"{BASE}, {GW}, {P}, g AS (SELECT {_g('gw', 2)}), pw AS ({_wide('p', 'j', 'm', 2)}), z AS (SELECT *, g00 * g11 - g01 * g10 AS det FROM pw CROSS JOIN g), y AS (SELECT *, (m0 * g11 - m1 * g01) / det AS a0, (m1 * g00 - m0 * g10) / det AS a1 FROM z)"
_R2 = f"{_G2}, b AS (SELECT *, CASE WHEN a0 < 0 OR a1 < 0 THEN CASE WHEN sqrt(g00) * (m0 / g00) >= sqrt(g11) * (m1 / g11) THEN m0 / g00 ELSE 0 END ELSE a0 END AS x0, CASE WHEN a0 < 0 OR a1 < 0 THEN CASE WHEN sqrt(g00) * (m0 / g00) >= sqrt(g11) * (m1 / g11) THEN 0 ELSE m1 / g11 END ELSE a1 END AS x1 FROM y)"


def _two(spark, d, rule):
    a = m1(spark, d)
    w = w0(a, 2)
    return longer(Factor.of(h0(a, 2)).update(R.at_w(a, w), rule, R.gram(w))[0].df, digits=4)


@query(f"{_R2} SELECT j AS idx, CAST(0 AS BIGINT) AS r, round(x0, 4) AS x FROM b UNION ALL SELECT j, 1, round(x1, 4) FROM b")
def rank2_nnls(spark, d):
    return _two(spark, d, "R2")


@query(f"{_R2} SELECT j AS idx, CAST(0 AS BIGINT) AS r, round(x0, 4) AS x FROM b UNION ALL SELECT j, 1, round(x1, 4) FROM b")
def bpp_two_columns(spark, d):
    return _two(spark, d, "ANLSBPP")


@query(f"WITH {A} SELECT DISTINCT j AS idx, TRUE AS optimal FROM a")
def bpp_kkt(spark, d):
    """Whether each row that block pivoting gives meets the conditions of the optimum, to 1e-8 of the product's size."""
    a = m1(spark, d)
    g, h = R.gram(w0(a)), Factor.of(h0(a))
    m = h.filled(R.at_w(a, w0(a)))
    x = m.map(lambda m: kernels.bpp(g, m))
    good = x.map(lambda x, m: (kernels.kkt(g, m, x) <= 1e-8 * np.maximum(np.abs(m).max(1) ** 2, 1))[:, None].astype(float), m)
    return good.df.select("idx", (F.col("f0") == 1).alias("optimal"))


@query(f"{_G2} SELECT j AS idx, CAST(0 AS BIGINT) AS r, round(a0, 4) AS x FROM y UNION ALL SELECT j, 1, round(a1, 4) FROM y")
def als_step(spark, d):
    return _two(spark, d, "ALS")


# ---- tensors


def _mttkrp(mode: int) -> None:
    o = [m for m in range(3) if m != mode]
    sql = f"{TT} SELECT t.i{mode} AS idx, a.r, round(SUM(t.v * a.x * b.x), 4) AS x FROM t JOIN f{o[0]} a ON t.i{o[0]} = a.idx JOIN f{o[1]} b ON t.i{o[1]} = b.idx AND a.r = b.r GROUP BY 1, 2"
    query(sql, f"mttkrp_mode{mode}")(lambda spark, d: longer(X.mttkrp(t1(spark, d), fs(t1(spark, d)), mode), "m", 4))


for _m in range(3):
    _mttkrp(_m)


@query(f"{TT} SELECT t.i0, t.i1, a.r, round(SUM(t.v * a.x), 4) AS x FROM t JOIN f2 a ON t.i2 = a.idx GROUP BY 1, 2, 3")
def partial_mttkrp(spark, d):
    t = t1(spark, d)
    p = X.partial_mttkrp(t, fs(t), [2])
    return p.select("i0", "i1", F.posexplode(F.array(*R.cols(K, "p"))).alias("r", "x")).select("i0", "i1", F.col("r").cast("long").alias("r"), F.round("x", 4).alias("x"))


@query(ORACLE["mttkrp_mode0"])
def multi_ttv(spark, d):
    t = t1(spark, d)
    return longer(X.multi_ttv(X.partial_mttkrp(t, fs(t), [2]), fs(t), 0), "m", 4)


_G3 = " ".join(f", g{m} AS (SELECT a.r AS p, b.r AS q, SUM(a.x * b.x) AS g FROM f{m} a JOIN f{m} b ON a.idx = b.idx GROUP BY 1, 2)" for m in range(3))


@query(f"{TT}{_G3} SELECT g1.p, g1.q, round(g1.g * g2.g, 5) AS g FROM g1 JOIN g2 ON g1.p = g2.p AND g1.q = g2.q")
def gram_hadamard(spark, d):
    t = t1(spark, d)
    g = X.gram_hadamard([R.gram(f) for f in fs(t)], 0)
    return spark.createDataFrame([(p, q, round(float(g[p, q]), 5)) for p in range(K) for q in range(K)], "p long, q long, g double")


@query(f"{TT} SELECT a.idx AS ia, b.idx AS ib, a.r, round(a.x * b.x, 8) AS x FROM f0 a JOIN f1 b ON a.r = b.r")
def khatri_rao(spark, d):
    f = fs(t1(spark, d))
    k = X.khatri_rao(f[0], f[1])
    return k.select("ia", "ib", F.posexplode(F.array(*R.cols(K))).alias("r", "x")).select("ia", "ib", F.col("r").cast("long").alias("r"), F.round("x", 8).alias("x"))


@query(f"{TT} SELECT t.i0, t.i1, t.i2, round(SUM(a.x * b.x * c.x), 6) AS x FROM t JOIN f0 a ON t.i0 = a.idx JOIN f1 b ON t.i1 = b.idx AND a.r = b.r JOIN f2 c ON t.i2 = c.idx AND a.r = c.r GROUP BY 1, 2, 3")
def cp_reconstruct(spark, d):
    t = t1(spark, d)
    return X.reconstruct(t, fs(t)).select("i0", "i1", "i2", F.round("x", 6).alias("x"))


@query(f"""{TT}, c AS (SELECT a.idx AS i0, b.idx AS i1, c.idx AS i2, SUM(a.x * b.x * c.x) AS x FROM f0 a JOIN f1 b ON a.r = b.r JOIN f2 c ON a.r = c.r GROUP BY 1, 2, 3)
 SELECT round(sqrt(SUM((COALESCE(t.v, 0) - c.x) * (COALESCE(t.v, 0) - c.x)) / (SELECT SUM(v * v) FROM t)), 6) AS rel_error FROM c LEFT JOIN t ON t.i0 = c.i0 AND t.i1 = c.i1 AND t.i2 = c.i2""")
def cp_fast_error(spark, d):
    t = t1(spark, d)
    f = fs(t)
    whole = float(X.gram_hadamard([R.gram(x) for x in f]).sum())
    dot = X.mttkrp(t, f, 2).join(f[2], "idx").agg(F.sum(sum((F.col(f"m{r}") * F.col(f"f{r}") for r in range(K)), F.lit(0.0))).alias("dot"))
    return t.agg(F.sum(F.col("v") ** 2).alias("n")).join(dot).select(F.round(F.sqrt((F.col("n") + whole - 2 * F.col("dot")) / F.col("n")), 6).alias("rel_error"))


@query(f"{TT} SELECT a.idx AS i0, b.idx AS i1, c.idx AS i2, a.r, round(a.x * b.x * c.x, 8) AS x FROM f0 a JOIN f1 b ON a.r = b.r JOIN f2 c ON a.r = c.r")
def krp_three_modes(spark, d):
    k = X.krp(fs(t1(spark, d)), [0, 1, 2])
    return k.select("i0", "i1", "i2", F.posexplode(F.array(*R.cols(K))).alias("r", "x")).select("i0", "i1", "i2", F.col("r").cast("long").alias("r"), F.round("x", 8).alias("x"))


@query(f"{TT} SELECT a.idx AS i0, c.idx AS i2, a.r, round(a.x * c.x, 8) AS x FROM f0 a JOIN f2 c ON a.r = c.r")
def krp_leave_one_out(spark, d):
    k = X.krp(fs(t1(spark, d)), X.without(3, 1))
    return k.select("i0", "i2", F.posexplode(F.array(*R.cols(K))).alias("r", "x")).select("i0", "i2", F.col("r").cast("long").alias("r"), F.round("x", 8).alias("x"))


@query(f"{TT} SELECT a.idx * 3 + b.idx AS idx, a.r, round(a.x * b.x, 8) AS x FROM f0 a JOIN f1 b ON a.r = b.r")
def kronecker(spark, d):
    f = fs(t1(spark, d))
    return longer(X.kronecker(f[0], f[1]), digits=8)


_WHOLE = "c AS (SELECT a.idx AS i0, b.idx AS i1, c.idx AS i2, SUM(a.x * b.x * c.x) AS x FROM f0 a JOIN f1 b ON a.r = b.r JOIN f2 c ON a.r = c.r GROUP BY 1, 2, 3)"


@query(f"{TT}, {_WHOLE} SELECT round(SUM((COALESCE(t.v, 0) - COALESCE(c.x, 0)) * (COALESCE(t.v, 0) - COALESCE(c.x, 0))) / 1000, 4) AS err_sq FROM c FULL JOIN t ON t.i0 = c.i0 AND t.i1 = c.i1 AND t.i2 = c.i2")
def tensor_error(spark, d):
    t = t1(spark, d)
    return X.error_sq(t, X.whole(fs(t))).select(F.round(F.col("err_sq") / 1000, 4).alias("err_sq"))


@query(f"""{TT}, n AS (SELECT r, sqrt(SUM(x * x)) AS n FROM f0 GROUP BY 1), m AS (SELECT r, sqrt(SUM(x * x)) AS n FROM f1 GROUP BY 1), o AS (SELECT r, sqrt(SUM(x * x)) AS n FROM f2 GROUP BY 1)
 SELECT n.r, round(n.n * m.n * o.n, 5) AS lam FROM n JOIN m ON n.r = m.r JOIN o ON n.r = o.r""")
def normalize_all_modes(spark, d):
    lam = X.normalize_all(fs(t1(spark, d)))[1]
    return spark.createDataFrame([(r, round(x, 5)) for r, x in enumerate(lam)], "r long, lam double")


@query(f"{TT} SELECT idx, f0.r, round(x / n, 7) AS x, round(n, 6) AS lam FROM f0 JOIN (SELECT r, sqrt(SUM(x * x)) AS n FROM f0 GROUP BY 1) u ON f0.r = u.r")
def normalize_mode(spark, d):
    f, lam = X.normalize_mode(fs(t1(spark, d))[0])
    each = spark.createDataFrame([(r, round(x, 6)) for r, x in enumerate(lam)], "r long, lam double")
    return longer(f, digits=7).join(each, "r").select("idx", "r", "x", "lam")


@query(f"""{TT}{_G3}, g AS (SELECT g1.p, g1.q, g1.g * g2.g AS g FROM g1 JOIN g2 ON g1.p = g2.p AND g1.q = g2.q), m AS (SELECT t.i0 AS idx, a.r, SUM(t.v * a.x * b.x) AS x FROM t JOIN f1 a ON t.i1 = a.idx JOIN f2 b ON t.i2 = b.idx AND a.r = b.r GROUP BY 1, 2),
 fg AS (SELECT f0.idx, g.q AS r, SUM(f0.x * g.g) AS x FROM f0 JOIN g ON f0.r = g.p GROUP BY 1, 2) SELECT f0.idx, f0.r, round(f0.x * m.x / (fg.x + 1e-17), 5) AS x FROM f0 JOIN m ON f0.idx = m.idx AND f0.r = m.r JOIN fg ON f0.idx = fg.idx AND f0.r = fg.r""")
def ntf_mu_step(spark, d):
    t = t1(spark, d)
    f = fs(t)
    return longer(Factor.of(f[0]).update(X.mttkrp(t, f, 0), "MU", X.gram_hadamard([R.gram(x) for x in f], 0))[0].df, digits=5)


# ---- rounds of whole fits, unrolled in SQL


def _mu(old: str, new: str, key: str, other: str, product: str) -> str:
    """CTEs of one multiplicative update of factor `old` (key, r, x) by factor `other`; product is SQL for data times other."""
    g = f"g_{new}"
    return f"""{g} AS (SELECT p.r AS p, q.r AS q, SUM(p.x * q.x) AS g FROM {other} p JOIN {other} q ON p.{'j' if key == 'i' else 'i'} = q.{'j' if key == 'i' else 'i'} GROUP BY 1, 2), m_{new} AS ({product}),
 d_{new} AS (SELECT f.{key}, {g}.q AS r, SUM(f.x * {g}.g) AS x FROM {old} f JOIN {g} ON f.r = {g}.p GROUP BY 1, 2),
 {new} AS (SELECT f.{key}, f.r, f.x * m.x / (d.x + 1e-17) AS x FROM {old} f JOIN m_{new} m ON f.{key} = m.{key} AND f.r = m.r JOIN d_{new} d ON f.{key} = d.{key} AND f.r = d.r)"""


def _hals(old: str, new: str, key: str, other: str, product: str) -> str:
    """The same for one sweep over three columns."""
    away = "j" if key == "i" else "i"
    z = [f"h{c}" for c in range(3)]
    steps, have = [], list(z)
    for r in range(3):
        steps.append(f"s{r}_{new} AS (SELECT *, greatest(h{r} + (m{r} - ({' + '.join(f'{have[c]} * g{c}{r}' for c in range(3))})) / g{r}{r}, 1e-17) AS n{r} FROM {f's{r - 1}_{new}' if r else f'z_{new}'})")
        have[r] = f"n{r}"
    return f"""g_{new} AS (SELECT p.r AS p, q.r AS q, SUM(p.x * q.x) AS g FROM {other} p JOIN {other} q ON p.{away} = q.{away} GROUP BY 1, 2), m_{new} AS ({product}),
 z_{new} AS (SELECT * FROM ({_wide(old, key, 'h', 3)}) a JOIN ({_wide(f'm_{new}', key, 'm', 3)}) b USING ({key}) CROSS JOIN (SELECT {_g(f'g_{new}', 3)}) c), {', '.join(steps)},
 {new} AS ({' UNION ALL '.join(f'SELECT {key}, CAST({r} AS BIGINT) AS r, n{r} AS x FROM s2_{new}' for r in range(3))})"""


def _rounds(half, rounds: int) -> str:
    """Metrics of so many rounds, H before W, from the formula's factors."""
    out, out_rows, w, h = [], [], "w", "h"
    for it in range(rounds):
        out.append(half(h, f"h{it}", "j", w, f"SELECT a.j, f.r, SUM(a.v * f.x) AS x FROM a JOIN {w} f ON a.i = f.i GROUP BY 1, 2"))
        h = f"h{it}"
        out.append(half(w, f"w{it}", "i", h, f"SELECT a.i, f.r, SUM(a.v * f.x) AS x FROM a JOIN {h} f ON a.j = f.j GROUP BY 1, 2"))
        w = f"w{it}"
        out.append(f"e{it} AS (SELECT p.i, q.j, SUM(p.x * q.x) AS x FROM {w} p JOIN {h} q ON p.r = q.r GROUP BY 1, 2)")
        out_rows.append(f"SELECT {it} AS it, round(sqrt(SUM((COALESCE(a.v, 0) - e.x) * (COALESCE(a.v, 0) - e.x)) / (SELECT SUM(v * v) FROM a)), 7) AS rel_error FROM e{it} e LEFT JOIN a ON a.i = e.i AND a.j = e.j")
    return f"{BASE}, {', '.join(out)} {' UNION ALL '.join(out_rows)}"


def _started(algo: str, rounds: int):
    def run(spark, d):
        a = m1(spark, d)
        return nmf(a, K, algo, rounds, w0=w0(a), h0=h0(a)).metrics.select("it", F.round("rel_error", 7).alias("rel_error"))

    return run


query(_rounds(_mu, 2), "nmf_mu_rounds")(_started("MU", 2))
query(_rounds(_hals, 2), "nmf_hals_rounds")(_started("HALS", 2))


def _ntf_rounds(rounds: int) -> str:
    """Multiplicative updates of three modes from the formula's factors, each normalized after its update and begun from
    the factor times the lengths of the update before."""
    out = [f"c{m} AS (SELECT idx, f.r, x / n AS x FROM f{m} f JOIN (SELECT r, sqrt(SUM(x * x)) AS n FROM f{m} GROUP BY 1) u ON f.r = u.r)" for m in range(3)]
    now, lam, rows = ["c0", "c1", "c2"], None, []
    for it in range(rounds):
        for m in range(3):
            t, (p, q) = f"{it}{m}", (o for o in range(3) if o != m)
            begin = f"SELECT f.idx, f.r, f.x{' * l.n' if lam else ''} AS x FROM {now[m]} f {f'JOIN {lam} l ON f.r = l.r' if lam else ''}"
            out += [
                f"b{t} AS ({begin})",
                f"p{t} AS (SELECT t.i{m} AS idx, y.r, SUM(t.v * y.x * z.x) AS x FROM t JOIN {now[p]} y ON t.i{p} = y.idx JOIN {now[q]} z ON t.i{q} = z.idx AND y.r = z.r GROUP BY 1, 2)",
                *(f"k{t}{o} AS (SELECT y.r AS p, z.r AS q, SUM(y.x * z.x) AS g FROM {now[o]} y JOIN {now[o]} z ON y.idx = z.idx GROUP BY 1, 2)" for o in (p, q)),
                f"d{t} AS (SELECT b.idx, y.q AS r, SUM(b.x * y.g * z.g) AS x FROM b{t} b JOIN k{t}{p} y ON b.r = y.p JOIN k{t}{q} z ON y.p = z.p AND y.q = z.q GROUP BY 1, 2)",
                f"n{t} AS (SELECT b.idx, b.r, b.x * p.x / (d.x + 1e-17) AS x FROM b{t} b JOIN p{t} p ON b.idx = p.idx AND b.r = p.r JOIN d{t} d ON b.idx = d.idx AND b.r = d.r)",
                f"l{t} AS (SELECT r, sqrt(SUM(x * x)) AS n FROM n{t} GROUP BY 1)",
                f"c{t} AS (SELECT f.idx, f.r, f.x / l.n AS x FROM n{t} f JOIN l{t} l ON f.r = l.r)",
            ]
            now[m], lam = f"c{t}", f"l{t}"
        out.append(f"w{it} AS (SELECT a.idx AS i0, b.idx AS i1, c.idx AS i2, SUM(a.x * b.x * c.x) AS x FROM {now[0]} a JOIN {now[1]} b ON a.r = b.r JOIN n{it}2 c ON a.r = c.r GROUP BY 1, 2, 3)")
        rows.append(f"SELECT {it} AS it, round(sqrt(SUM((COALESCE(t.v, 0) - w.x) * (COALESCE(t.v, 0) - w.x)) / (SELECT SUM(v * v) FROM t)), 6) AS rel_error FROM w{it} w LEFT JOIN t ON t.i0 = w.i0 AND t.i1 = w.i1 AND t.i2 = w.i2")
    return f"{TT}, {', '.join(out)} {' UNION ALL '.join(rows)}"


@query(_ntf_rounds(2))
def ntf_mu_rounds(spark, d):
    t = t1(spark, d)
    return ntf(t, K, "MU", 2, factors=fs(t)).metrics.select("it", F.round("rel_error", 6).alias("rel_error"))


A2 = """a AS (SELECT CAST(o_custkey AS BIGINT) AS i, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS j, SUM(CAST(o_totalprice AS DOUBLE)) / 1000 AS v FROM orders GROUP BY 1, 2)"""


@query(f"WITH {A2}, {W}, {H}, {_mu('h', 'u', 'j', 'w', 'SELECT a.j, f.r, SUM(a.v * f.x) AS x FROM a JOIN w f ON a.i = f.i GROUP BY 1, 2')} SELECT CAST((j - 1) // 12 AS BIGINT) AS year, r, round(AVG(x), 5) AS weight FROM u GROUP BY 1, 2")
def topic_over_time(spark, d):
    """Customers x months: the topics' weights of the months after an update, by year."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("i"), month.alias("j")).agg((F.sum(F.col("o_totalprice").cast("double")) / 1000).alias("v"))
    w = w0(a)
    rows = R.long_form(Factor.of(h0(a)).update(R.at_w(a, w), "MU", R.gram(w))[0].df, digits=None)
    year = F.floor((F.col("idx") - 1) / 12).cast("long").alias("year")
    return rows.groupBy(year, F.col("r").cast("long").alias("r")).agg(F.round(F.avg("x"), 5).alias("weight"))


# ---- trees and graphs

PS = f"WITH {A}, z AS (SELECT i, SUM(v) AS x FROM a GROUP BY 1), y AS (SELECT a.j, SUM(a.v * z.x) AS x FROM a JOIN z ON a.i = z.i GROUP BY 1)"


@query(f"{PS} SELECT j AS idx, round(x / (SELECT sqrt(SUM(x * x)) FROM y), 8) AS q FROM y")
def power_step(spark, d):
    a = m1(spark, d)
    ones = a.select(F.col("j").alias("idx")).distinct().withColumn("f0", F.lit(1.0))
    y = R.at_w(a, R.a_h(a, ones).withColumnRenamed("m0", "f0"))
    return y.join(y.agg(F.sqrt(F.sum(F.col("m0") ** 2)).alias("n"))).select("idx", F.round(F.col("m0") / F.col("n"), 8).alias("q"))


@query(f"{_R2} SELECT j AS idx, x0 >= x1 AS first FROM b")
def node_split(spark, d):
    a = m1(spark, d)
    w = w0(a, 2)
    h = Factor.of(h0(a, 2)).update(R.at_w(a, w), "R2", R.gram(w))[0].df
    return h.select("idx", (F.col("f0") >= F.col("f1")).alias("first"))


def _graph(spark, d):
    """Part bucket x nation of the supplier, and nation x nation."""
    li, sup = table(spark, d, "lineitem"), table(spark, d, "supplier")
    rows = li.join(sup, li.l_suppkey == sup.s_suppkey)
    a = rows.groupBy((F.col("l_partkey") % 50).cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return a, R.symmetrize(s1(spark, d))


GRAPH = f"""{S}, s AS (SELECT i, j, SUM(v) / 2 AS v FROM (SELECT i, j, v FROM s0 UNION ALL SELECT j, i, v FROM s0) u GROUP BY 1, 2),
 a AS (SELECT CAST(l_partkey % 50 AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(f"""WITH {GRAPH}
 SELECT round((SELECT SUM(v * v) FROM a) / (SELECT SUM(v * v) FROM s), 8) AS alpha, round((SELECT SUM(v * v) FROM a) / (SELECT SUM(v * v) FROM s) * (SELECT MAX(v) FROM s), 6) AS beta""")
def default_alpha_beta(spark, d):
    a, s = _graph(spark, d)
    one = a.agg(F.sum(F.col("v") ** 2).alias("na")).join(s.agg(F.sum(F.col("v") ** 2).alias("ns"), F.max("v").alias("top")))
    return one.select(F.round(F.col("na") / F.col("ns"), 8).alias("alpha"), F.round(F.col("na") / F.col("ns") * F.col("top"), 6).alias("beta"))


_JOINT = f"WITH {GRAPH}, {W}, {H.replace('SELECT DISTINCT j FROM a', 'SELECT j FROM a UNION SELECT j FROM s')}, {GW}, {GH}, sh AS (SELECT s.i AS j, h.r, SUM(s.v * h.x) AS x FROM s JOIN h ON s.j = h.j GROUP BY 1, 2)"


def _start(spark, d):
    a, s = _graph(spark, d)
    return a, s, Factor.of(w0(a)), Factor.of(h0(a.select("j").unionByName(s.select("j"))))


@query(f"""{_JOINT}, e AS (SELECT w.i, h.j, SUM(w.x * h.x) AS x FROM w JOIN h ON w.r = h.r GROUP BY 1, 2), f AS (SELECT p.j AS i, q.j, SUM(p.x * q.x) AS x FROM h p JOIN h q ON p.r = q.r GROUP BY 1, 2)
 SELECT round((SELECT SUM((COALESCE(a.v, 0) - e.x) * (COALESCE(a.v, 0) - e.x)) FROM e LEFT JOIN a ON a.i = e.i AND a.j = e.j) / 1e6 + 0.5 * (SELECT SUM((COALESCE(s.v, 0) - f.x) * (COALESCE(s.v, 0) - f.x)) FROM f LEFT JOIN s ON s.i = f.i AND s.j = f.j) / 1e6, 5) AS objective""")
def joint_objective(spark, d):
    a, s, w, h = _start(spark, d)
    value = objective(R.norm_sq(a), R.norm_sq(s), 0.5, w, h, h.times(a, "j", "i", w), h.times(s, "j", "i", h))
    return spark.createDataFrame([(round(value / 1e6, 5),)], "objective double")


@query(f"""{_JOINT}, {P}, hw AS (SELECT h.j, gw.q AS r, SUM(h.x * gw.g) AS x FROM h JOIN gw ON h.r = gw.p GROUP BY 1, 2), hh AS (SELECT h.j, gh.q AS r, SUM(h.x * gh.g) AS x FROM h JOIN gh ON h.r = gh.p GROUP BY 1, 2)
 SELECT h.j AS idx, h.r, round(2 * (hw.x - COALESCE(p.x, 0)) + 2 * (hh.x - COALESCE(sh.x, 0)), 2) AS x FROM h LEFT JOIN p ON h.j = p.j AND h.r = p.r LEFT JOIN sh ON h.j = sh.j AND h.r = sh.r JOIN hw ON h.j = hw.j AND h.r = hw.r JOIN hh ON h.j = hh.j AND h.r = hh.r""")
def grad_h(spark, d):
    a, s, w, h = _start(spark, d)
    return longer(gradients(0.5, w, h, h.times(a, "j", "i", w), w.times(a, "i", "j", h), h.times(s, "j", "i", h))[1].df, digits=2)


@query(f"{BASE}, {GH}, {Q}, wg AS (SELECT w.i, gh.q AS r, SUM(w.x * gh.g) AS x FROM w JOIN gh ON w.r = gh.p GROUP BY 1, 2) SELECT w.i AS idx, w.r, round(2 * (wg.x - q.x), 3) AS x FROM w JOIN q ON w.i = q.i AND w.r = q.r JOIN wg ON w.i = wg.i AND w.r = wg.r")
def grad_w(spark, d):
    a = m1(spark, d)
    w, h = Factor.of(w0(a)), Factor.of(h0(a))
    ah = h.times(a, "j", "i", w)
    return longer(gradients(0.0, w, h, ah, h, h)[0].df, digits=3)


_ONE = "(SELECT sqrt(SUM(x * x)) FROM (SELECT b.j, SUM(b.v * z.x) AS x FROM {0} b JOIN (SELECT i, SUM(v) AS x FROM {0} GROUP BY 1) z ON b.i = z.i GROUP BY 1) y)"


@query(f"{_R2}, l AS (SELECT a.* FROM a JOIN b ON a.j = b.j WHERE x0 >= x1), o AS (SELECT a.* FROM a JOIN b ON a.j = b.j WHERE x0 < x1) SELECT round((COALESCE({_ONE.format('l')}, 0) + COALESCE({_ONE.format('o')}, 0) - {_ONE.format('a')}) / 1e6, 5) AS score")
def node_score(spark, d):
    """One power step each for the node and its two groups of columns."""
    a = m1(spark, d)
    side = node_split(spark, d).withColumnRenamed("idx", "j").persist()
    sigma = [power_sigma(R.col_subset(a, side.where(F.col("first") == one).select("j")), 1) for one in (True, False)]
    return spark.createDataFrame([(round(score(power_sigma(a, 1), sigma) / 1e6, 5),)], "score double")


# ---- generators (the same integer arithmetic in SQL)


def _u(seed: int, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(',', {', '.join([str(seed), *keys])})), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


_CELLS = "SELECT CAST(x // 40 AS BIGINT) AS i, CAST(x % 40 AS BIGINT) AS j FROM (SELECT unnest(range(2400)) AS x) u"


@query(f"SELECT i, j, {_u(5, 'i', 'j')} AS v FROM ({_CELLS}) c")
def gen_uniform(spark, d):
    return G.random_matrix(spark, "uniform", 60, 40, seed=5, portable=True)


@query(f"SELECT i, j, round(greatest(sqrt(-2 * ln(1 - {_u(5, 'i', 'j')})) * cos({_u(5, 'i', 'j', '-1')} * 6.283185307179586), 0.0), 9) AS v FROM ({_CELLS}) c")
def gen_normal(spark, d):
    return G.random_matrix(spark, "normal", 60, 40, seed=5, portable=True).withColumn("v", F.round("v", 9))


@query(f"SELECT i, j, round({' + '.join(f'{_u(5, "i", str(r), str(G.LEFT))} * {_u(5, "j", str(r), str(G.RIGHT))}' for r in range(2))}, 9) AS v FROM ({_CELLS}) c")
def gen_lowrank(spark, d):
    return G.random_matrix(spark, "lowrank", 60, 40, k=2, seed=5, portable=True).withColumn("v", F.round("v", 9))


@query(f"SELECT i, j, {_u(5, 'i', 'j')} AS v FROM ({_CELLS}) c WHERE {_u(5, 'i', 'j', str(G.CELL))} < 0.1")
def gen_sparse_mask(spark, d):
    return G.random_matrix(spark, "uniform", 60, 40, seed=5, density=0.1, portable=True)


@query(f"SELECT i, j, {_u(9, 'least(i, j)', 'greatest(i, j)')} AS v FROM (SELECT CAST(x // 40 AS BIGINT) AS i, CAST(x % 40 AS BIGINT) AS j FROM (SELECT unnest(range(1600)) AS x) u) c")
def gen_symmetric(spark, d):
    return G.random_matrix(spark, "uniform", 40, 40, seed=9, symmetric=True, portable=True)


# ---- whole fits: data-dependent loops, held against invariants in tests


def _fit(algo: str):
    return lambda spark, d: nmf(m1(spark, d), 5, algo, 5).metrics


for _a in ("MU", "HALS", "ANLSBPP", "AOADMM", "NESTEROV", "ALS"):
    query(None, f"nmf_{_a.lower()}")(_fit(_a))


@query()
def nmf_gnsym(spark, d):
    return nmf(R.symmetrize(s1(spark, d)), 4, "GNSYM", 5).metrics


@query()
def nmf_symmetric_anls(spark, d):
    return nmf(R.symmetrize(s1(spark, d)), 4, "ANLSBPP", 5, symmetric=True).metrics


for _a in ("MU", "HALS", "ANLSBPP", "AOADMM", "NESTEROV", "CPALS"):
    query(None, f"ntf_{_a.lower()}")(lambda spark, d, _a=_a: ntf(t1(spark, d), 4, _a, 4).metrics)


query(None, "nmf_r2")(lambda spark, d: nmf(m1(spark, d), 2, "R2", 5).metrics)
query(None, "nmf_warm_start")(lambda spark, d: nmf(m1(spark, d), 5, "ANLSBPP", 3, warm_start=2).metrics)


@query()
def hier_tree(spark, d):
    return hier_nmf(m1(spark, d), 3, 4, power_iterations=4)[0]


for _a in ("ANLSBPP", "PGD", "PGNCG"):
    query(None, f"joint_{_a.lower()}")(lambda spark, d, _a=_a: joint_nmf(*_graph(spark, d), 4, _a, 4).metrics)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    a = m1(spark, d)
    return nmf(a, 5, "MU", 10, w0=w0(a, 5), h0=h0(a, 5)).metrics
