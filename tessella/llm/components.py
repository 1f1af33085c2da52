"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._session import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of u are linked to the least among u and its neighbours.

    The least is summed up before it is shuffled and joined back, so that a hub's links can be split over tasks.
    """
    if large:
        links = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    Large-star and small-star steps in turn, each pair written in the shared folder, until nothing changes: the number
    of rounds is logarithmic in the longest path. Only a count and a hash of all links come to the driver.
    """
    links = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        links = written(_stars(_stars(links, True), False), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
