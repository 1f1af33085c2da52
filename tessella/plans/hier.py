"""Hierarchical clustering of columns by rank-2 factorization."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import matrix as R
from tessella.plans.factors import Factor
from tessella.plans.nmf import Fit, nmf
from tessella.session import written

NODES = "index int, parent int, level int, n long, sigma double, score double, accepted boolean"


@dataclass
class Tree:
    """nodes; members (index, j); w (index, idx, f0, f1) and h of the rank-2 factors of every node that was split."""

    nodes: DataFrame
    members: DataFrame
    w: DataFrame
    h: DataFrame


def power_sigmas(a: DataFrame, groups: Factor, iterations: int = 20, tol: float = 0.0) -> np.ndarray:
    """Squares of the largest singular values of groups of columns by power iteration, all groups in one job a round.

    groups has a row for each j and a column for each group, 1 where j is in it, else 0; groups do not overlap. A group ends
    early if its value changes by less than tol, relatively.
    """
    q = groups
    sigma, ended = np.zeros(groups.width), np.zeros(groups.width, bool)
    for _ in range(iterations):
        product = R.a_h(a, q.df)
        y = q.filled(R.at_w(a, product.withColumnsRenamed({f"m{r}": f"f{r}" for r in range(groups.width)}))).map(np.multiply, groups)
        new = np.sqrt(np.maximum(np.diag(y.gram()), 0.0))
        close = (new == 0) | (tol * new >= np.abs(new - sigma)) & (tol > 0)
        sigma = np.where(ended, sigma, new)
        ended |= close
        if ended.all():
            break
        q = y.scaled(np.divide(1.0, new, out=np.zeros_like(new), where=new > 0))
    return sigma


def power_sigma(a: DataFrame, iterations: int = 20, tol: float = 0.0) -> float:
    """power_sigmas() of all columns together."""
    return float(power_sigmas(a, Factor.of(a.select(F.col("j").alias("idx")).distinct().select("idx", F.lit(1.0).alias("f0"))), iterations, tol)[0])


def split(sub: DataFrame, iterations: int, seed: int) -> tuple[list[tuple[DataFrame, int]], Factor | None, Fit]:
    """The two groups of columns (j) with their sizes, larger first - one group if all go together -, both as groups of
    power_sigmas(), and the factors."""
    fit = nmf(sub, 2, "R2", iterations, seed=seed)
    first = F.col("f0") >= F.col("f1")
    side = written(fit.h.select(F.col("idx").alias("j"), first.alias("first")), "side")
    sized = sorted(((n, not one, one) for one, n in side.groupBy("first").count().collect()), key=lambda x: (-x[0], x[1]))
    parts = [(side.where(F.col("first") == one).select("j"), n) for n, _, one in sized]
    groups = Factor.of(side.select(F.col("j").alias("idx"), *((F.col("first") == one).cast("double").alias(f"f{r}") for r, (_, _, one) in enumerate(sized)))) if len(sized) == 2 else None
    return parts, groups, fit


def score(sigma: float, children: list[float]) -> float:
    """How much a split explains: the children's sigma less the node's; without children nothing."""
    return sum(children) - sigma if children else 0.0


def hier_fit(a: DataFrame, nodes: int = 4, iterations: int = 20, seed: int = 193957, power_iterations: int = 10) -> Tree:
    """A tree with nodes.index 2i + 1 and 2i + 2 below i.

    A node's score is the sum of its children's sigma less its own; the best leaf is accepted next, and accepting splits
    its children to look ahead. A node's columns of the data are kept while it is worked on. The tree has a few rows;
    members and factors stay distributed.
    """
    spark = a.sparkSession
    a = a.persist()
    kept: dict[int, dict] = {}

    def look(node: dict) -> None:
        """Sigma of a node and its children, which are added without theirs."""
        node["children"] = []
        if node["n"] > 1:
            sub = R.col_subset(a, node["cols"]).persist() if node["index"] else a
            try:
                parts, groups, fit = split(sub, iterations, seed)
                node["fit"] = fit
                sigmas = power_sigmas(sub, groups, power_iterations).tolist() if groups else []
                for s, ((cols, n), sigma) in enumerate(zip(parts, sigmas)):
                    child = {"index": 2 * node["index"] + 1 + s, "parent": node["index"], "level": node["level"] + 1, "cols": cols, "n": n, "sigma": sigma, "accepted": False, "children": []}
                    kept[child["index"]] = child
                    node["children"].append(child)
            finally:
                if node["index"]:
                    sub.unpersist()
        node["score"] = score(node["sigma"], [c["sigma"] for c in node["children"]])

    try:
        columns = written(a.select("j").distinct(), "columns")
        root = kept[0] = {"index": 0, "parent": -1, "level": 0, "cols": columns, "n": columns.count(), "sigma": 0.0, "accepted": False}
        look(root)
        queue = [(-root["score"], 0)]
        for _ in range(max(nodes - 1, 1)):
            if not queue:
                break
            node = kept[heapq.heappop(queue)[1]]
            node["accepted"] = True
            for c in node["children"]:
                look(c)
                heapq.heappush(queue, (-c["score"], c["index"]))
        rows = [(x["index"], x["parent"], x["level"], x["n"], x["sigma"], float(x.get("score", 0.0)), x["accepted"]) for x in sorted(kept.values(), key=lambda x: x["index"])]
        every = lambda frames: reduce(DataFrame.unionByName, frames)
        members = every([x["cols"].select(F.lit(x["index"]).alias("index"), "j") for x in kept.values()])
        fits = [(x["index"], x["fit"]) for x in kept.values() if "fit" in x]
        empty = spark.createDataFrame([], "index int, idx long, f0 double, f1 double")
        w, h = (every([empty, *(f.select(F.lit(i).alias("index"), "*") for i, f in side)]) for side in ([(i, f.w) for i, f in fits], [(i, f.h) for i, f in fits]))
        return Tree(spark.createDataFrame(rows, NODES), members, w, h)
    finally:
        a.unpersist()


def hier_nmf(a: DataFrame, nodes: int = 4, iterations: int = 20, seed: int = 193957, power_iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """The nodes and members of hier_fit()."""
    tree = hier_fit(a, nodes, iterations, seed, power_iterations)
    return tree.nodes, tree.members
