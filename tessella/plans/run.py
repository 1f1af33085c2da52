"""Runs from a dictionary, a JSON file or the command line: `python -m tessella.plans.run --program nmf ...`."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.matrix import cols, rank
from tessella.plans.hier import hier_fit
from tessella.plans.joint import joint_nmf
from tessella.plans.nmf import nmf
from tessella.plans.ntf import ntf
from tessella.sources.files import matrix_source, read_tensor, write_factor_text
from tessella.sources.generate import random_tensor

#: Numbers by which algorithms are known on the command line (fixed values).
ALGORITHMS = {0: "MU", 1: "HALS", 2: "ANLSBPP", 4: "AOADMM", 5: "NESTEROV", 6: "CPALS", 7: "GNSYM", 8: "R2", 9: "PGD", 10: "PGNCG"}
DEFAULTS = {
    "program": "nmf", "algo": 2, "k": 20, "iterations": 20, "input": "rand_lowrank", "connections": "rand_lowrank", "dims": [], "output": None,
    "sparsity": 1.0, "regularizer": [0.0, 0.0, 0.0, 0.0], "seed": 193957, "normalization": None, "symmetric": False, "alpha": None, "beta": None,
    "momentum": 0.9, "tolerance": -1.0, "dimtree": True, "nodes": 4, "adjust": False,
}


def save(frames: Mapping[str, DataFrame], path: str) -> None:
    """Each frame as Parquet below path; factors as text lines beside it."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        if rank(df) and df.columns == ["idx", *cols(rank(df))]:
            write_factor_text(df, f"{path}/{name}_text")


def run(spark: SparkSession, options: Mapping) -> dict[str, DataFrame]:
    """Frames by name: metrics, and the factors or nodes of the program (nmf, ntf, hiernmf or jointnmf)."""
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    o = DEFAULTS | dict(options)
    algo = ALGORITHMS[int(o["algo"])] if str(o["algo"]).isdigit() else str(o["algo"]).upper()
    dims, k, its, seed = [int(x) for x in o["dims"]], int(o["k"]), int(o["iterations"]), int(o["seed"])
    reg = [float(x) for x in o["regularizer"]]
    if o["program"] == "ntf":
        name = o["input"]
        t = random_tensor(spark, name[5:], dims, k) if name.startswith("rand_") else read_tensor(spark, name)
        fit = ntf(t, k, algo, its, seed=seed, dimtree=o["dimtree"], tol=o["tolerance"], l2=reg[0])
        lam = spark.createDataFrame(list(enumerate(fit.lam)), "r int, lam double")
        out = {f"mode{m}": f for m, f in enumerate(fit.factors)} | {"lambda": lam, "metrics": fit.metrics}
    else:
        m, n = (dims + [0, 0])[:2]
        made = {"k": k, "density": float(o["sparsity"]), "symmetric": bool(o["symmetric"]), "adjusted": ((5.0, 10.0) if o["sparsity"] < 1 else (1.0, 0.0)) if o["adjust"] else None}
        a = matrix_source(spark, o["input"], m, n, **(made if o["input"].startswith("rand_") else {}))
        shape = (m, n) if m and n else None
        if o["program"] == "nmf":
            fit = nmf(a, k, "ALS" if algo == "CPALS" else algo, its, shape, seed=seed, reg_w=(reg[0], reg[1]), reg_h=(reg[2], reg[3]), alpha=o["alpha"], symmetric=o["symmetric"], tol=o["tolerance"], normalization=o["normalization"])
            out = {"W": fit.w, "H": fit.h, "metrics": fit.metrics}
        elif o["program"] == "hiernmf":
            tree = hier_fit(a, int(o["nodes"]), its, seed)
            out = {"nodes": tree.nodes, "members": tree.members, "node_W": tree.w, "node_H": tree.h}
        elif o["program"] == "jointnmf":
            made |= {"symmetric": True}
            s = matrix_source(spark, o["connections"], n, n, **(made if o["connections"].startswith("rand_") else {}))
            fit = joint_nmf(a, s, k, algo, its, shape, o["alpha"], o["beta"], o["momentum"], seed=seed)
            out = {"W": fit.w, "H": fit.h, "metrics": fit.metrics} | ({"H2": fit.h2} if fit.h2 is not None else {})
        else:
            raise ValueError("program is nmf, ntf, hiernmf or jointnmf")
    if o["output"]:
        save(out, o["output"])
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", help="a JSON file with options; those of the command line go first")
    for name, value in DEFAULTS.items():
        if isinstance(value, bool):
            parser.add_argument(f"--{name}", type=lambda x: x not in ("0", "false"), default=None)
        elif isinstance(value, list):
            parser.add_argument(f"--{name}", type=lambda x: [float(y) for y in x.replace(",", " ").split()], default=None)
        else:
            parser.add_argument(f"--{name}", type=str if value is None or isinstance(value, str) or name == "algo" else type(value), default=None)
    given = vars(parser.parse_args(args))
    options = {}
    if given.pop("config") or False:
        with open(parser.parse_args(args).config) as f:
            options = json.load(f)
    options |= {n: float(v) if n in ("alpha", "beta") else v for n, v in given.items() if v is not None}
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    for name, df in run(spark, options).items():
        if name in ("metrics", "nodes"):
            df.orderBy(F.col(df.columns[0])).show(1000, truncate=False)


if __name__ == "__main__":
    main()
