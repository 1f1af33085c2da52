"""Operator 6: approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; the nearest signed axis of a unit vector
is a hash. A table concatenates the hashes of one, two or three rotations into a bucket. A query probes its own bucket of
each table and the next best ones, in the order of how much nearer the best axes are. Rows met in any bucket are
candidates and are ranked by exact distance on the original vectors.

How many hashes a bucket has and how many buckets are probed is settled for each index: the neighbours of a bounded
sample of vectors are found by brute force, and of all choices that find the wanted share of them the one with fewest
candidates is taken. With more rows neighbours are nearer, buckets get finer and the share of rows that are candidates falls.

The index is read where it lies and never shuffled. Queries come in blocks whose probes, sorted by bucket, are broadcast;
a row looks its buckets up in them. Of equal vectors in a batch only the k + 1 smallest ids can be among a query's
nearest, so a very common vector costs little; queries with one vector are one search. Each task keeps the nearest of
each search and only those leave it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._schema import schema
from tessella.llm._session import written

#: Probes (table, bucket, search) that are broadcast at once, 12 bytes each; more searches take more passes.
PROBES_AT_ONCE = 6_000_000
#: Vectors whose neighbours are found by brute force to settle the parameters, rows that tell the share of candidates, and
#: the share of neighbours that the parameters must find.
SAMPLE, BACKGROUND, TARGET = 64, 4_000, 0.97
#: Probes a table that are tried at most, by the number of hashes in a bucket.
MOST_PROBES = {1: 128, 2: 1024, 3: 2048}
_HIT = schema("u long, vec_id long, score double")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    x, y, h = np.array(x, float), np.empty((n, d)), 1
    while h < d:
        a, b = x.reshape(n, d // (2 * h), 2, h), y.reshape(n, d // (2 * h), 2, h)
        np.add(a[:, :, 0], a[:, :, 1], out=b[:, :, 0])
        np.subtract(a[:, :, 0], a[:, :, 1], out=b[:, :, 1])
        x, y, h = y, x, 2 * h
    return x / math.sqrt(d)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so neither tiny nor huge ones are lost."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows; only where squares leave the range of doubles are they scaled."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        out = np.sqrt((diff**2).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-150)
        if odd.any():
            d = a[odd] / 4 - b[odd] / 4
            top = np.abs(d).max(1)
            out[odd] = np.where(top > 0, 4 * top * np.sqrt(((d / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1)), 0.0)
    return out


@dataclass
class Tables:
    """Pseudo-rotations of all tables, from a seed: `each` in a row make a table."""

    dims: int
    tables: int
    each: int
    seed: int = 7

    def __post_init__(self) -> None:
        self.width = 1 << max(0, (self.dims - 1).bit_length())
        self.signs = np.random.default_rng(self.seed).integers(0, 2, (self.tables * self.each, 3, self.width)) * 2.0 - 1.0

    def rotated(self, x: np.ndarray, r: int) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for s in self.signs[r]:
            x = hadamard(x * s)
        return x

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each unit vector in table t: nearest signed axes, an axis plus width if negative."""
        out = np.zeros(len(x), np.int64)
        for r in range(t * self.each, (t + 1) * self.each):
            y = self.rotated(x, r)
            axis = np.abs(y).argmax(1)
            out = out * (2 * self.width) + axis + self.width * (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, t: int, n: int) -> np.ndarray:
        """The n best buckets of each unit vector in table t, best first: a bucket's score is the sum over its axes of the
        squared gap to the best axis. Fewer than n if there are no more."""
        score = code = None
        for r in range(t * self.each, (t + 1) * self.each):
            y = self.rotated(x, r)
            both = np.concatenate([y, -y], 1)
            axes = np.argsort(-both, 1, kind="stable")[:, : min(n, 2 * self.width)]
            far = np.take_along_axis(both, axes, 1)
            gap = (far[:, :1] - far) ** 2
            if score is None:
                score, code = gap, axes.astype(np.int64)
                continue
            # of the n best sums the axis with rank j needs at most n / j partners
            some = [(i, j) for i in range(score.shape[1]) for j in range(gap.shape[1]) if (i + 1) * (j + 1) <= n]
            i, j = (np.array(s) for s in zip(*some, strict=True))
            total = score[:, i] + gap[:, j]
            best = np.argpartition(total, n - 1, 1)[:, :n] if n < total.shape[1] else np.tile(np.arange(total.shape[1]), (len(total), 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(total, best, 1), 1, kind="stable"), 1)
            score = np.take_along_axis(total, best, 1)
            code = np.take_along_axis(code, i[best], 1) * (2 * self.width) + np.take_along_axis(axes, j[best], 1)
        return code


class Searches:
    """A block of searches with their probes sorted by bucket, table by table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tables: Tables, probes: int) -> None:
        self.ids, self.vectors, self.tables = ids, vectors, tables
        self.by_bucket = []
        x = unit(vectors)
        for t in range(tables.tables):
            codes = tables.probes(x, t, probes)
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), codes.shape[1])
            order = np.argsort(codes.ravel(), kind="stable")
            buckets, first = np.unique(codes.ravel()[order], return_index=True)
            self.by_bucket.append((buckets, np.append(first, len(order)), owner[order]))

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, search) that any table brings together, each once."""
        x, met = unit(vectors), []
        for t, (buckets, first, owner) in enumerate(self.by_bucket):
            code = self.tables.buckets(x, t)
            at = np.searchsorted(buckets, code)
            at[at == len(buckets)] = 0
            row = np.flatnonzero(buckets[at] == code)
            a, n = first[at[row]], first[at[row] + 1] - first[at[row]]
            spots = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(row) else np.zeros(0, int)
            met.append(np.repeat(row, n) * len(self.ids) + owner[spots])
        both = np.unique(np.concatenate(met))
        return both // len(self.ids), both % len(self.ids)


class Everything:
    """Searches that meet every row: brute force."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(vectors)), len(self.ids)), np.tile(np.arange(len(self.ids)), len(vectors))


def _best(q: np.ndarray, d: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each search, ties to the smaller id."""
    order = np.lexsort((v, d, q))
    first = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _fewer(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Positions of rows, of equal vectors only those with the `most` smallest ids."""
    if len(ids) <= most:
        return np.arange(len(ids))
    same = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, 8 * vectors.shape[1]))).ravel()
    _, group, n = np.unique(same, return_inverse=True, return_counts=True)
    return np.arange(len(ids)) if n.max() <= most else np.sort(_best(group.ravel(), np.zeros(len(ids)), ids, most))


def _pass(index: DataFrame, block: Searches | Everything, k: int) -> DataFrame:
    """(u, vec_id, score): the k + 1 best rows of each partition for each search of a block."""
    held = index.sparkSession.sparkContext.broadcast(block)
    d, k = block.vectors.shape[1], k + 1

    def run(batches):
        b = held.value
        limit = np.full(len(b.ids), np.inf)
        q, s, v = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, d)
            some = _fewer(ids, vectors, k)
            for i in range(0, len(some), 512):
                x, own = vectors[some[i : i + 512]], ids[some[i : i + 512]]
                r, c = b.candidates(x)
                for j in range(0, len(r), 65536):
                    rr, cc = r[j : j + 65536], c[j : j + 65536]
                    far = distance(x[rr], b.vectors[cc])
                    ok = far <= limit[cc]
                    q, s, v = np.concatenate([q, cc[ok]]), np.concatenate([s, far[ok]]), np.concatenate([v, own[rr[ok]]])
                if len(q) > 4 * k * len(b.ids):
                    at = _best(q, s, v, k)
                    q, s, v = q[at], s[at], v[at]
                    full = np.bincount(q, minlength=len(b.ids)) >= k
                    worst = np.zeros(len(b.ids))
                    np.maximum.at(worst, q, s)
                    limit[full] = worst[full]
        at = _best(q, s, v, k)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[q[at]]), pa.array(v[at]), pa.array(s[at])], names=_HIT.names)

    return index.mapInArrow(run, _HIT)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (array<double>) of the rows that can be searched: no null, zero, non-finite or odd-sized vector, no null
    id; other columns are not read."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows], float)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def settle(index: DataFrame, asked: DataFrame, k: int, tables: int, target: float = TARGET) -> tuple[int, int]:
    """(hashes in a bucket, probes a table) with the fewest candidates that find the target share of the sample's neighbours.

    The sample is SAMPLE searches and, if these are fewer, as many vectors of the index; its neighbours come from one pass
    of brute force, the share of candidates from BACKGROUND rows; all of them are chosen by a hash of their id. (1, all
    buckets) if nothing reaches the target.
    """
    some = asked.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    spread = index.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(BACKGROUND).collect()
    ids, vectors = _arrays(some + spread[: SAMPLE - len(some)])
    _, apart = np.unique(vectors, axis=0, return_index=True)
    ids, vectors = ids[apart], vectors[apart]
    near = _top(_pass(index, Everything(np.arange(len(ids)), vectors), k).where("score > 0"), k).select("u", F.col("vec_id").alias("id"))
    near = index.join(F.broadcast(near), "id").select("u", "vec").collect()
    if not near:
        return 1, 1
    who, true = np.array([r.u for r in near]), np.array([r.vec for r in near], float)
    other = _arrays(spread)[1]
    x, y, z, choices, rows = unit(vectors), unit(true), unit(other), [], index.count()
    for each, most in MOST_PROBES.items():
        made = Tables(vectors.shape[1], tables, each)
        if (2 * made.width) ** (each - 1) > 16 * rows:  # buckets too fine for so few rows
            break
        found, met = np.full(len(y), most), np.full((len(z), len(x)), most)
        for t in range(tables):
            codes = made.probes(x, t, most)
            own, rest = made.buckets(y, t), made.buckets(z, t)
            for s in range(len(x)):
                order = np.argsort(codes[s], kind="stable")
                for bucket, out, at in ((own[who == s], found, who == s), (rest, met[:, s], slice(None))):
                    p = np.minimum(np.searchsorted(codes[s][order], bucket), len(order) - 1)
                    out[at] = np.minimum(out[at], np.where(codes[s][order[p]] == bucket, order[p], most))
        need = int(np.sort(found)[math.ceil(target * len(found)) - 1]) + 1
        if need <= most:
            choices.append(((met < need).mean() + need * tables / 1e8, each, need))
    if not choices:
        return 1, 1 << 30
    return min(choices)[1:]


def search(index: DataFrame, queries: DataFrame, k: int = 10, tables: int = 16, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query, ties to the smaller id.

    index and queries come from usable(). Rows with a query's own id are no candidates. A query for which fewer than k
    are found is searched again by brute force, so it gets all there are. An empty table gives no row; repeated rows of
    the index are found each, up to k + 1 for each vector and batch, and of repeated query ids the smallest vector counts.
    """
    spark = index.sparkSession
    own = written(queries.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    searches = written(own.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "searches")
    asked = own.join(searches.withColumnRenamed("id", "u"), "vec").select("u", F.col("id").alias("query_id"))
    total = searches.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each, probes = settle(index, searches, k, tables, target)
    made = Tables(len(searches.first().vec), tables, each)

    def passes(rows: DataFrame, block: int, make) -> DataFrame | None:
        """One written table of hits for each block of searches; its broadcast goes before the next one is made."""
        blocks, out = math.ceil(rows.count() / block), None
        for b in range(blocks):
            got = sorted(rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect())
            if got:
                some = written(_top(_pass(index, make(*_arrays(got)), k), k + 1).select(*_HIT.names), "hits")
                out = some if out is None else out.unionByName(some)
        return out

    def ranked(hits: DataFrame) -> DataFrame:
        """Hits of each search handed to its queries, each without its own row."""
        each_one = hits.join(asked, "u").where(F.col("vec_id") != F.col("query_id"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return each_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    hits = passes(searches, max(64, PROBES_AT_ONCE // (tables * min(probes, (2 * made.width) ** each))), lambda i, v: Searches(i, v, made, probes))
    full = hits.groupBy("u").count().where(F.col("count") > k).select(F.col("u").alias("id"))
    short = written(searches.join(full, "id", "left_anti"), "short-queries")
    more = passes(short, 4096, Everything)
    if more is not None:
        hits = hits.join(full.withColumnRenamed("id", "u"), "u", "left_semi").unionByName(more)
    return ranked(hits)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: every hundredth vector against all others."""
    index = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(index, index.where(F.col("id") % 100 == 0))
