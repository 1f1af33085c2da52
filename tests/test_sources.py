"""Files and generators."""

import numpy as np
import pytest

from tessella.sources import files as S
from tessella.sources.generate import random_matrix, random_tensor


def cells(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0 1.5\n2 1 2\n\n")
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 2 2\n1 1 1.5\n3 2 2\n")
    want = {(0, 0): 1.5, (2, 1): 2.0}
    assert cells(S.matrix_source(spark, str(tmp_path / "a.txt"))) == want
    assert cells(S.matrix_source(spark, str(tmp_path / "a.mtx"))) == want
    (tmp_path / "d.txt").write_text("1 0 2\n0 3 0\n")
    assert cells(S.read_dense_text(spark, str(tmp_path / "d.txt"))) == {(0, 0): 1.0, (0, 2): 2.0, (1, 1): 3.0}


def test_blocks(spark, tmp_path):
    for r, c, line in ((0, 0, "0 0 1"), (1, 1, "1 0 2")):
        (tmp_path / f"a{r}_{c}").write_text(line + "\n")
    assert cells(S.read_blocks(spark, str(tmp_path / "a*"), 5, 3, 2, 2)) == {(0, 0): 1.0, (4, 2): 2.0}


def test_binary_formats(spark, tmp_path):
    x = np.arange(6, dtype=float).reshape(2, 3)
    x.ravel(order="F").tofile(tmp_path / "x.bin")
    want = {(i, j): x[i, j] for i in range(2) for j in range(3) if x[i, j]}
    assert cells(S.read_dense_binary(spark, str(tmp_path / "x.bin"), 2)) == want
    np.save(tmp_path / "x.npy", np.asfortranarray(x.astype("f4")))
    assert cells(S.read_npy(spark, str(tmp_path / "x.npy"))) == want


def test_tensor_round_trip(spark, tmp_path):
    t = random_tensor(spark, "uniform", [3, 4, 2], seed=2)
    S.write_tensor(t, str(tmp_path / "t"), [3, 4, 2])
    assert cells(S.read_tensor(spark, str(tmp_path / "t"))) == {k: v for k, v in cells(t).items() if v}


def test_tensor_parts_and_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)  # the tasks take it along
    t = random_tensor(spark, "integer", [3, 4, 5], seed=2, top=3)
    S.write_tensor(t, str(tmp_path / "t"), [3, 4, 5])
    x = np.zeros((3, 4, 5))
    for k, v in cells(t).items():
        x[k] = v
    S.merge_parts(str(tmp_path / "t.bin"), str(tmp_path / "one.bin"))
    assert np.array_equal(np.fromfile(tmp_path / "one.bin"), x.ravel(order="F"))
    got = cells(S.read_tensor(spark, str(tmp_path / "t"), [(1, 3), (0, 4), (2, 4)]))
    assert got == {(i - 1, j, k - 2): x[i, j, k] for i in range(1, 3) for j in range(4) for k in range(2, 4) if x[i, j, k]}


def test_npy_of_any_order(spark, tmp_path):
    x = np.arange(24, dtype="f4").reshape(2, 3, 4)
    for name, y in (("c", x), ("f", np.asfortranarray(x))):
        np.save(tmp_path / f"{name}.npy", y)
        assert cells(S.read_npy(spark, str(tmp_path / f"{name}.npy"))) == {k: x[k] for k in np.ndindex(2, 3, 4) if x[k]}
    S.npy_to_tensor(spark, str(tmp_path / "f.npy"), str(tmp_path / "t"))
    assert cells(S.read_tensor(spark, str(tmp_path / "t"))) == {k: x[k] for k in np.ndindex(2, 3, 4) if x[k]}


def test_ranges_splits_and_dense_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0 1.5\n2 1 2\n3 3 4\n")
    assert cells(S.matrix_source(spark, str(tmp_path / "a.txt"), rows=(2, 4), columns=(1, 4))) == {(0, 0): 2.0, (1, 2): 4.0}
    for p, line in enumerate(("0 5 1", "1 2 2", "0 0 3")):
        (tmp_path / f"rows_{p}").write_text(line + "\n")
    assert cells(S.read_split(spark, str(tmp_path / "rows_*"), "i", 7, 3)) == {(0, 5): 1.0, (4, 2): 2.0, (5, 0): 3.0}
    (tmp_path / "m.dense").write_text("1 0 2\n0 3 0\n")
    assert cells(S.matrix_source(spark, str(tmp_path / "m.dense"))) == {(0, 0): 1.0, (0, 2): 2.0, (1, 1): 3.0}


def test_factor_binary(spark, tmp_path):
    f = spark.createDataFrame([(1, 0.5, 0.0), (0, 2.0, 3.0), (2, 1.0, 7.0)], "idx long, f0 double, f1 double")
    S.write_factor_binary(f, str(tmp_path / "w.bin"))
    assert np.fromfile(tmp_path / "w.bin").tolist() == [2.0, 0.5, 1.0, 3.0, 0.0, 7.0]
    S.factor_binary_to_text(spark, str(tmp_path / "w.bin"), 3, str(tmp_path / "w.txt"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w.txt")).collect()] == ["2.0 3.0", "0.5 0.0", "1.0 7.0"]


def test_factor_text(spark, tmp_path):
    f = spark.createDataFrame([(1, 0.5, 1.0), (0, 2.0, 3.0)], "idx long, f0 double, f1 double")
    S.write_factor_text(f, str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["2.0 3.0", "0.5 1.0"]


@pytest.mark.parametrize("kind", ["uniform", "normal", "lowrank"])
def test_generators(spark, kind):
    a = cells(random_matrix(spark, kind, 12, 12, seed=4, symmetric=True))
    assert len(a) == 144 and all(v >= 0 for v in a.values()) and all(a[i, j] == a[j, i] for i, j in a)
    for symmetric in (False, True):
        sparse = random_matrix(spark, kind, 60, 60, seed=4, density=0.1, symmetric=symmetric)
        got = cells(sparse)
        assert 250 < len(got) < 480 and cells(sparse.repartition(7)) == got and sparse.count() == len(got)
        assert not symmetric or all(got[i, j] == got[j, i] for i, j in got)
    assert len(cells(random_matrix(spark, kind, 60, 50, seed=4, density=0.1, portable=True))) > 200


def numbers(spark, seed, keys, portable=False):
    from pyspark.sql import functions as F

    from tessella.functions.columns import uniform

    return np.array([r[0] for r in spark.range(4000).select(uniform(seed, *keys(F.col("id")), portable=portable)).collect()])


@pytest.mark.parametrize("portable", [False, True])
def test_random_numbers_are_independent(spark, portable):
    from pyspark.sql import functions as F

    u = [numbers(spark, s, lambda i, r=r: (i, F.lit(r)), portable) for s, r in ((1, 0), (2, 0), (1, 1), (1, 7919))]
    far = numbers(spark, 1, lambda i: (i + 1_000_003, F.lit(0)), portable)
    for x in (*u, far):
        assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.03 and abs(x.var() - 1 / 12) < 0.01 and len(set(x.tolist())) == 4000
        assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.06
    for x in (*u[1:], far):
        for lag in (0, 1, 2):  # neither the same numbers nor shifted ones
            assert abs(np.corrcoef(u[0][lag:], x[: 4000 - lag])[0, 1]) < 0.06
            assert len(np.intersect1d(u[0], x)) == 0


def test_factor_has_full_rank(spark):
    from tessella.sources.generate import random_factor

    f = random_factor(spark.range(200).withColumnRenamed("id", "idx"), 12, 5).toPandas().sort_values("idx").drop(columns="idx").to_numpy()
    assert np.linalg.matrix_rank(f) == 12 and np.linalg.cond(f) < 20
    low = random_matrix(spark, "lowrank", 40, 30, k=4, seed=2).toPandas().pivot(index="i", columns="j", values="v").to_numpy()
    s = np.linalg.svd(low)[1]
    assert s[3] > 1e-2 * s[0] and s[4] < 1e-9 * s[0]


def test_tensor_with_noise(spark):
    a, b = (np.array([r.v for r in random_tensor(spark, "lowrank", [8, 7, 6], k=3, seed=4, noise=x).orderBy("i0", "i1", "i2").collect()]) for x in (0.0, 0.1))
    assert 0.07 < np.linalg.norm(a - b) / np.linalg.norm(a) < 0.13
