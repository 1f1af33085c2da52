"""Operator 2: near duplicates by SimHash fingerprints and deletion-variant signatures.

Two fingerprints that differ in at most three bits, cut into two segments, have one segment in which they differ in at
most one. A segment with one bit left out (a wildcard) is a signature, so each fingerprint has 64; two such fingerprints
share one, and an equality join on signatures followed by verification finds all links.

A signature shared by very many fingerprints is cut further by the same argument: the other segment differs in at most
three bits, one of its halves in at most one; and once more. What then still shares a signature agrees in all but 11
bits, so a group holds at most 2,048 fingerprints by construction: nothing is capped and no group grows with the data.
Exact copies share a fingerprint and are one row throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._schema import schema
from tessella.llm._session import written
from tessella.llm.components import components

#: Fingerprints of one signature that a task verifies against each other; larger groups are cut further.
GROUP = 8192
_EDGE = schema("a long, b long")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; without words zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(width, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    ends = ends[k - 1 :].tolist()
    for i in range(0, n, 65536):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            fps = [fingerprint(t, width) for k in range(0, len(column), 256) for t in column.slice(k, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _wildcards(df: DataFrame, segment: str, bits: int, name: str) -> DataFrame:
    """Explode segment (a long of 2 * bits bits) into the signatures of its two halves with one bit left out each."""
    spots = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * bits - 1))).alias("_p"))
    half = f"CASE WHEN _p < {bits} THEN {segment} & {(1 << bits) - 1}L ELSE shiftrightunsigned({segment}, {bits}) & {(1 << bits) - 1}L END"
    spots = spots.withColumn("_h", F.expr(half)).withColumn("_b", F.expr(f"_p % {bits}"))
    left = "(_h & (shiftleft(1L, _b) - 1)) | shiftleft(shiftright(_h, _b + 1), _b)"
    return spots.withColumn(name, F.expr(f"shiftleft(CAST(_p AS LONG), {bits - 1}) | ({left})")).drop("_p", "_h", "_b")


def _counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose keys are shared, with their number, as a written table.

    Keys are counted before the shuffle and the counts joined back, so the rows of a hot key can be split over tasks.
    Catalyst takes exploded rows to be no larger than what they come from, so the hint keeps them out of a broadcast.
    """
    shared = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(df.join(shared.hint("merge"), keys), name)


def _verified(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Spanning links of the fingerprints of each group that differ in at most so many bits; groups are bounded."""
    sets = df.groupBy(*keys).agg(F.collect_set("fp").alias("fps")).select("fps").where(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                fps = np.sort(np.array(row.values.to_numpy(zero_copy_only=False), np.int64))
                x, m = fps.view(np.uint64), len(fps)
                root = np.arange(m)
                todo = np.ones(m, bool)
                for i in range(m):
                    if not todo[i]:
                        continue
                    todo[i] = False
                    front = np.array([i])
                    while len(front):  # all of i's component; each fingerprint is compared with the rest once
                        near = np.zeros(m, bool)
                        rest = np.flatnonzero(todo)
                        for k in range(0, len(front), 256):
                            d = np.bitwise_count(x[front[k : k + 256], None] ^ x[None, rest]) <= most
                            near[rest] |= d.any(0)
                        front = np.flatnonzero(near)
                        todo[front] = False
                        root[front] = i
                linked = np.flatnonzero(root != np.arange(m))
                a.append(fps[linked]), b.append(fps[root[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return sets.mapInArrow(run, _EDGE)


def near_links(fps: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that differ in at most three bits."""
    if most > 3:
        raise ValueError("two segments find at most three differing bits")
    first = _counted(_wildcards(fps.select("fp"), "fp", 32, "k1"), ["k1"], "signatures")
    out = _verified(first.where(F.col("n") <= group), ["k1"], most)
    hot = first.where(F.col("n") > group).drop("n")
    if hot.isEmpty():
        return out
    # the other segment, whole: k1 tells by its wildcard's place which one it was
    hot = hot.withColumn("_s", F.expr(f"CASE WHEN shiftright(k1, 31) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & {(1 << 32) - 1}L END"))
    second = _counted(_wildcards(hot, "_s", 16, "k2"), ["k1", "k2"], "signatures")
    out = out.unionByName(_verified(second.where(F.col("n") <= group), ["k1", "k2"], most))
    hot = second.where(F.col("n") > group).drop("n")
    if hot.isEmpty():
        return out
    hot = hot.withColumn("_s", F.expr("CASE WHEN shiftright(k2, 15) < 16 THEN shiftrightunsigned(_s, 16) ELSE _s & 65535L END"))
    third = _wildcards(hot, "_s", 8, "k3")
    return out.unionByName(_verified(third, ["k1", "k2", "k3"], most))


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and class_fp of every row.

    component_id is the least doc_id reachable over links of at most `most` differing bits; class_fp is the least
    fingerprint of the component and names it even where ids are null. Null and empty texts have fingerprint zero and
    are linked like any other; rows with null ids take part, and component_id is null if all its ids are; repeated rows
    stay; other columns are not read.
    """
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(fps, most), "a", "b")
    member = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("class_fp", F.coalesce("root", "fp"))
    named = member.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    of = written(member.select("fp", "class_fp").join(named, "class_fp"), "classes")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_fp")


def drop_near_duplicates(docs: DataFrame, width: int = 5, most: int = 3) -> DataFrame:
    """One document of each class of near duplicates: the row with the least doc_id (null ids last), then fingerprint.

    Rows that share the chosen id and fingerprint are one document, of which one row stays.
    """
    classes = written(near_duplicates(docs, width, most), "near-duplicates")
    first = classes.groupBy("class_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "fingerprint")).alias("s"))
    kept = first.select(F.col("s.doc_id").alias("_id"), F.col("s.fingerprint").alias("_fp"))
    if classes.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(kept.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi")
    # ids repeat or are null: a row is told by its own fingerprint as well, and one of equal rows stays
    named = written(docs.withColumn("_key", F.xxhash64("doc_id", "text")), "keyed")
    prints = fingerprints(named, width, id_col="_key").select(F.col("doc_id").alias("_key"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("_fp")).distinct()
    chosen = named.join(prints, "_key").join(kept, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (prints["_fp"] == kept["_fp"]), "left_semi")
    one = chosen.select("doc_id", "_fp", "_key").groupBy("doc_id", "_fp").agg(F.min("_key").alias("_key")).select("_key")
    return chosen.join(one, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, shingles of three words, at most three differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
