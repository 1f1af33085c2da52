"""Invariants of whole fits and of the kernels."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import kernels as K
from tessella.operators import matrix as R
from tessella.operators import tensor as X
from tessella.plans import factors
from tessella.plans.hier import hier_nmf, power_sigma
from tessella.plans.joint import gradients, joint_nmf, objective
from tessella.plans.nmf import nmf
from tessella.plans.ntf import ntf
from tessella.plans.run import run
from tessella.sources.generate import random_matrix, random_tensor


@pytest.fixture(scope="module")
def low(spark):
    return random_matrix(spark, "lowrank", 30, 20, k=3, seed=5).persist()


def falls(xs, slack=1e-9):
    return all(b <= a * (1 + slack) + 1e-9 for a, b in itertools.pairwise(xs))


@pytest.mark.parametrize("algo", ["MU", "HALS", "ANLSBPP"])
def test_nmf_error_falls(low, algo):
    fit = nmf(low, 3, algo, 6)
    assert falls([r[1] for r in fit.rows])
    assert fit.w.where(" OR ".join(f"f{r} < 0" for r in range(3))).isEmpty()


@pytest.mark.parametrize("algo", ["AOADMM", "NESTEROV", "ALS"])
def test_nmf_trend(low, algo):
    rows = nmf(low, 3, algo, 6).rows
    assert rows[-1][1] <= rows[0][1] * 1.01 + 1e-6


def test_lowrank_recovered(low):
    assert nmf(low, 3, "ANLSBPP", 30).rows[-1][3] < 0.02


def test_fast_error_is_exact(low):
    fit = nmf(low, 3, "ANLSBPP", 3)
    assert R.fit_error_sq(low, fit.w, fit.h).first()[0] == pytest.approx(fit.rows[-1][2], rel=1e-6, abs=1e-6)


def test_partitions_and_tiers_agree(low, monkeypatch):
    a = nmf(low, 3, "MU", 3).rows
    b = nmf(low.repartition(7), 3, "MU", 3).rows
    monkeypatch.setattr(factors, "DRIVER_BYTES", 0)
    c = nmf(low, 3, "MU", 3).rows
    for x, y in ((a, b), (a, c)):
        assert np.allclose([r[1] for r in x], [r[1] for r in y], rtol=1e-9)


def test_empty_row_stays(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (2, 1, 2.0)], "i long, j long, v double")
    fit = nmf(a, 1, "MU", 2, shape=(4, 2))
    assert fit.w.count() == 4 and fit.h.count() == 2


def test_bad_cells_rejected(spark):
    with pytest.raises(ValueError):
        nmf(spark.createDataFrame([(0, 0, -1.0)], "i long, j long, v double"), 1)


def test_symmetric(spark):
    a = random_matrix(spark, "lowrank", 16, 16, k=2, seed=3, symmetric=True)
    rows = nmf(a, 2, "GNSYM", 8).rows
    assert rows[-1][1] < rows[0][1]
    tied = nmf(a, 2, "ANLSBPP", 8, symmetric=True).rows
    assert tied[-1][8] <= tied[0][8] + 1e-9


def test_bpp_is_optimal():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4, 6):
        c = rng.normal(size=(12, k))
        g, m = c.T @ c, rng.normal(size=(60, 12)) @ c
        x = K.bpp(g, m)
        y = x @ g - m
        assert (x >= 0).all() and (y >= -1e-8).all() and abs(x * y).max() < 1e-8


def test_bpp_hand_case():
    assert np.allclose(K.bpp(np.array([[2.0, 1], [1, 2]]), np.array([[-1.0, 1]])), [[0, 0.5]])


def test_rank2_is_bpp():
    rng = np.random.default_rng(2)
    c = rng.random((9, 2))
    m = rng.random((200, 9)) @ c * rng.random((200, 2))
    assert np.allclose(K.rank2(c.T @ c, m), K.bpp(c.T @ c, m), atol=1e-8)


@pytest.fixture(scope="module")
def cube(spark):
    return random_tensor(spark, "lowrank", [6, 5, 4], k=2, seed=3).persist()


@pytest.mark.parametrize("algo", ["MU", "ANLSBPP", "HALS", "CPALS"])
def test_ntf_error_falls(cube, algo):
    assert falls([r[1] for r in ntf(cube, 2, algo, 5).rows], 1e-7)


@pytest.mark.parametrize("algo", ["AOADMM", "NESTEROV"])
def test_ntf_trend(cube, algo):
    rows = ntf(cube, 2, algo, 4).rows
    assert rows[-1][1] <= rows[0][1] * 1.05


def test_dimension_tree_is_direct(cube):
    a, b = (ntf(cube, 2, "ANLSBPP", 4, dimtree=t).rows for t in (True, False))
    assert np.allclose([r[1] for r in a], [r[1] for r in b], rtol=1e-6, atol=1e-9)


def test_four_ways(spark):
    t = random_tensor(spark, "uniform", [4, 3, 3, 2], seed=1)
    assert falls([r[1] for r in ntf(t, 2, "ANLSBPP", 3).rows], 1e-7)


def test_mttkrp_hand_case(spark):
    a, b, c = [1.0, 2.0], [1.0, 3.0], [2.0, 5.0]
    t = spark.createDataFrame([(i, j, k, a[i] * b[j] * c[k]) for i in range(2) for j in range(2) for k in range(2)], "i0 long, i1 long, i2 long, v double")
    f = [spark.createDataFrame([(0, x[0]), (1, x[1])], "idx long, f0 double") for x in (a, b, c)]
    assert [r.m0 for r in X.mttkrp(t, f, 0).orderBy("idx").collect()] == [290.0, 580.0]


def test_power(low):
    d = low.toPandas().pivot(index="i", columns="j", values="v").fillna(0).to_numpy()
    assert power_sigma(low, 15) == pytest.approx(np.linalg.svd(d)[1][0] ** 2, rel=1e-3)


def test_tree(low):
    nodes, members = hier_nmf(low, 3, 5, power_iterations=3)
    m = members.toPandas().groupby("index").j.agg(set)
    for n in nodes.collect():
        if n.parent >= 0:
            assert m[n["index"]] < m[n.parent] and n["index"] in (2 * n.parent + 1, 2 * n.parent + 2)
    assert m[1] | m[2] == m[0] and not m[1] & m[2]


@pytest.mark.parametrize("algo", ["ANLSBPP", "PGD", "PGNCG"])
def test_joint(spark, algo):
    a = random_matrix(spark, "lowrank", 8, 10, k=2, seed=1)
    s = random_matrix(spark, "lowrank", 10, 10, k=2, seed=2, symmetric=True)
    rows = joint_nmf(a, s, 2, algo, 5).rows
    assert rows[-1][1] < rows[0][1]


def test_joint_gradients():
    rng = np.random.default_rng(0)
    a, s, w, h = rng.random((5, 6)), rng.random((6, 6)), rng.random((5, 2)), rng.random((6, 2))
    s = s + s.T
    cost = lambda w, h: objective((a**2).sum(), (s**2).sum(), 0.7, w, h, a @ h, s @ h)
    gw, gh = (x.values for x in gradients(0.7, w, h, a @ h, a.T @ w, s @ h))
    for x, g in ((w, gw), (h, gh)):
        for at in ((0, 0), (3, 1)):
            e = np.zeros_like(x)
            e[at] = 1e-6
            d = (cost(w + e, h) - cost(w - e, h) if x is w else cost(w, h + e) - cost(w, h - e)) / 2e-6
            assert d == pytest.approx(g[at], rel=1e-4)


def test_acceleration_never_hurts(cube):
    rows = [r[1] for r in ntf(cube, 2, "NESTEROV", 9, accelerate=True).rows]
    assert rows[-1] <= ntf(cube, 2, "NESTEROV", 9).rows[-1][1] * 1.05


@pytest.mark.parametrize("algo", ["ANLSBPP", "PGD", "PGNCG"])
def test_joint_on_tables(spark, algo, monkeypatch):
    a = random_matrix(spark, "lowrank", 6, 7, k=2, seed=1)
    s = random_matrix(spark, "lowrank", 7, 7, k=2, seed=2, symmetric=True)
    here = joint_nmf(a, s, 2, algo, 1, inner=2)
    monkeypatch.setattr(factors, "DRIVER_BYTES", 0)
    there = joint_nmf(a, s, 2, algo, 1, inner=2)
    assert np.allclose([r[1] for r in here.rows], [r[1] for r in there.rows], rtol=1e-6)
    assert (here.h2 is None) == (algo != "ANLSBPP") and (algo != "ANLSBPP" or there.h2.count() == 7)


def test_gnsym_and_duals_on_tables(spark, low, monkeypatch):
    a = random_matrix(spark, "lowrank", 8, 8, k=2, seed=3, symmetric=True)
    fits = lambda: (nmf(a, 2, "GNSYM", 1).rows, nmf(low, 3, "AOADMM", 2).rows)
    here = fits()
    monkeypatch.setattr(factors, "DRIVER_BYTES", 0)
    for x, y in zip(here, fits(), strict=True):
        assert np.allclose([r[1] for r in x], [r[1] for r in y], rtol=1e-7)


def test_acceleration_on_tables(spark, monkeypatch):
    t = random_tensor(spark, "lowrank", [4, 3, 3], k=2, seed=3)
    here = ntf(t, 2, "MU", 7, accelerate=True).rows
    monkeypatch.setattr(factors, "DRIVER_BYTES", 0)
    assert np.allclose([r[1] for r in here], [r[1] for r in ntf(t, 2, "MU", 7, accelerate=True).rows], rtol=1e-6)


def test_active_set_is_bpp():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(12, 5))
    g, m = c.T @ c, rng.normal(size=(40, 12)) @ c
    x = K.bpp(g, m)
    assert np.allclose(np.stack([K.active_set(g, r) for r in m]), x, atol=1e-8) and K.kkt(g, m, x).max() < 1e-8
    a, b = rng.random((9, 3)), rng.random((9, 4))
    assert K.nnls(a, b).shape == (4, 3)


def test_node_factors_and_timings(low):
    from tessella.plans.hier import hier_fit
    from tessella.plans.nmf import timings

    tree = hier_fit(low, 3, 4, power_iterations=3)
    split = {r["index"] for r in tree.w.select("index").distinct().collect()}
    assert 0 in split and tree.w.where("index = 0").count() == 30 and tree.h.where("index = 0").count() == 20
    t = timings(nmf(low, 3, "MU", 3).metrics).first()
    assert 0 < t.least <= t.mean <= t.most <= t.total


def test_numbers_by_ranges(spark):
    df = spark.range(1000).repartition(7).withColumn("k", (F.col("id") * 7919) % 1000)
    assert [r["_n"] for r in R.numbered(df, "k").orderBy("k").collect()] == list(range(1000))
    a = spark.createDataFrame([(i, j, 1.0) for i in range(20) for j in range(3)], "i long, j long, v double")
    b, used = R.permuted(a, {"i": 4})
    back = b.join(used["i"].withColumnRenamed("i", "old"), F.col("i") == F.col("_new")).select("old", "j", "v")
    assert sorted(back.collect()) == sorted(a.collect()) and sorted(r["_new"] for r in used["i"].collect()) == list(range(20))


def test_runs_from_options(spark, tmp_path):
    out = run(spark, {"program": "nmf", "algo": 0, "k": 2, "iterations": 2, "dims": [8, 6], "output": str(tmp_path / "o")})
    assert out["W"].count() == 8 and spark.read.parquet(str(tmp_path / "o/H")).count() == 6
    assert len(spark.read.text(str(tmp_path / "o/W_text")).collect()) == 8
    assert set(run(spark, {"program": "ntf", "k": 2, "iterations": 1, "dims": [3, 4, 2]})) == {"mode0", "mode1", "mode2", "lambda", "metrics"}
    assert run(spark, {"program": "jointnmf", "k": 2, "iterations": 1, "dims": [5, 6]})["H"].count() == 6
    with pytest.raises(ValueError):
        run(spark, {"nonsense": 1})


@pytest.mark.parametrize("limit", [None, 0])
def test_power_of_groups(spark, low, monkeypatch, limit):
    """Groups of columns at once give what each gives alone, on the driver and on tables; an empty group gives zero."""
    from tessella.plans.hier import power_sigmas

    if limit is not None:
        monkeypatch.setattr(factors, "DRIVER_BYTES", limit)
    groups = factors.Factor.of(spark.range(20).select(F.col("id").alias("idx"), *((F.col("id") % 2 == r).cast("double").alias(f"f{r}") for r in range(2)), F.lit(0.0).alias("f2")))
    got = power_sigmas(low, groups, 15 if limit is None else 3)
    cells = low.toPandas()
    dense = np.zeros((30, 20))
    dense[cells.i, cells.j] = cells.v
    for r in range(2):
        q = np.ones(10)
        for _ in range(15 if limit is None else 3):
            y = dense[:, r::2].T @ (dense[:, r::2] @ q)
            q, sigma = y / np.linalg.norm(y), np.linalg.norm(y)
        assert got[r] == pytest.approx(sigma, rel=1e-9)
    assert got[2] == 0
    if limit is None:
        assert power_sigmas(low, groups, 40, 1e-12)[0] == pytest.approx(np.linalg.svd(dense[:, ::2])[1][0] ** 2, rel=1e-6)
