"""Near duplicates by the Jaccard similarity of sets of word shingles: operator 2's index, carried on to lower similarity.

Fingerprints of the sets within three bits, found by the deletion-variant signatures of simhash, propose the first pairs.
They cannot propose all: two texts of similarity 0.8 differ in about ten of 64 bits and often more, and segments short
enough to find these are too short to tell texts apart. So MinHash signatures of BANDS bands of DEPTH values propose the
rest. A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 60 < 1e-10, a more similar one with less,
so at 0.8 and above no more is lost than hashes lose anyway. The sets themselves decide on every pair.

Pairs are not formed within a whole group. Its members are first compared with the least one; those that are then not in
the group's largest component are compared with one of its members, another one in each band; and only what is still
apart then is compared with the others, in blocks of bounded size, where histograms of the sets tell how much two can share
at most: a pair is verified only if that is enough. So a group of n near copies costs about n comparisons,
nothing is capped and no pair goes unchecked unless its two texts are connected already. Equal texts are one throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._session import written
from tessella.llm.components import components
from tessella.llm.simhash import near_links

BANDS, DEPTH = 60, 5
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * DEPTH, 1), np.uint64)
_A, _B = (_RANDOM[0] >> np.uint64(32)) | np.uint64(1), _RANDOM[1]
_MARKS = np.random.default_rng(12).integers(0, 1 << 64, BANDS, np.uint64)
#: Members of a group that are compared with so many others in one task.
BLOCK = 4096
#: Buckets of a set's histogram.
BUCKETS = 1024
_NO_PAIR = pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(width, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    low, high = own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)
    for i in range(0, len(own), 1024):
        h = (low[i : i + 1024] * _A + high[i : i + 1024] * (_A ^ _B | np.uint64(1)) + _B) >> np.uint64(32)
        least = np.minimum(least, h.min(1).astype(np.uint32))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Hashes of the bands of a signature."""
    rows = np.ascontiguousarray(least.reshape(BANDS, DEPTH))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), int(m)) for r, m in zip(rows, _MARKS, strict=True)], np.uint64)


def print_of(own: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes as a signed long; of an empty one zero."""
    ones = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def histogram(own: np.ndarray) -> bytes | None:
    """A byte for each bucket with the number of hashes in it; none of a set that overflows a byte."""
    n = np.bincount((own >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _banded(texts: DataFrame, width: int) -> DataFrame:
    """key, n (size of the set), fp (its fingerprint), bands and histogram of every row of (key, text)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                of = pa.array([bands(signature(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))
                spread = pa.array([histogram(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([print_of(s) for s in sets], pa.int64()), of, spread], names=["key", "n", "fp", "bands", "spread"])

    return texts.mapInArrow(run, "key long, n long, fp long, bands array<long>, spread binary")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t, width).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["key", "own"])

    return texts.mapInArrow(run, "key long, own binary")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""

    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            good = [jaccard(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) >= threshold - 1e-9 for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a")
    both = one.join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of one side of a block with the other, if roots, sizes and histograms allow the similarity: two
    sets share at most the sum over buckets of the lesser number, and as much as the threshold asks for.

    A block has few (key, n, root, spread) to be compared with each other and with its members.
    """
    none = np.full(BUCKETS, 255, np.uint8).tobytes()  # of a set without a histogram: shares anything

    def arrays(rows):
        key, n, root = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        given = rows.field(3).to_pylist()
        spread = np.frombuffer(b"".join(x or none for x in given), np.uint8).reshape(-1, BUCKETS)
        return key, n, root, spread, np.array([x is not None for x in given])

    def run(batches):
        for batch in batches:
            for few, members in zip(batch.column("few"), batch.column("members"), strict=True):
                if few.values is None or members.values is None or not len(few.values) or not len(members.values):
                    continue
                one, (key, n, root, spread, known) = arrays(few.values), arrays(members.values)
                for x, m, r, s, k in zip(*one, strict=True):
                    other = np.flatnonzero((root != r) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6))
                    both = np.minimum(spread[other], s).sum(1, dtype=np.int64)
                    other = other[(both >= threshold / (1 + threshold) * (n[other] + m) - 1e-6) | ~known[other] | (not k)]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, key[other])), pa.array(np.maximum(x, key[other]))], names=["a", "b"])
        yield _NO_PAIR

    return groups.mapInArrow(run, "a long, b long")


def _fits(threshold: float, m: str = "n", n: str = "lead_n"):
    return F.least(m, n) >= threshold * F.greatest(m, n) - 1e-6


def _rooted(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, major): the rows of groups that hold more than one component, with their roots; for each such group its
    largest component, a member of it, its size, and the numbers of members and of those outside it."""
    roots = components(links, "a", "b").withColumnRenamed("node", "key")
    rooted = written(groups.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    each = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("band", "key").alias("h"), "key", "n")).alias("s"))
    major = each.groupBy("band").agg(F.max(F.struct("m", "root", F.col("s.key").alias("lead"), F.col("s.n").alias("lead_n"))).alias("x"), F.sum("m").alias("members"), F.count(F.lit(1)).alias("roots"))
    major = major.where("roots > 1").select("band", F.col("x.root").alias("major"), "x.lead", "x.lead_n", "members", (F.col("members") - F.col("x.m")).alias("outside"))
    return rooted, written(major, "mixed")


def similar_links(texts: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Links (a, b) between keys, enough to connect all texts whose sets are at least so similar; texts: key, text."""
    if threshold < 0.8:
        raise ValueError("the bands are chosen for similarities of 0.8 and more")
    rows = _banded(texts, width).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "fp", "bands", "spread")))
    banded = written(rows, "banded")
    # operator 2: fingerprints within three bits, each told by its least text
    prints = banded.groupBy("fp").agg(F.min("key").alias("lead"))
    near = written(near_links(prints.select("fp")), "near-prints")
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("lead").alias("p")), "a").join(prints.select(F.col("fp").alias("b"), F.col("lead").alias("q")), "b")
    near = near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).unionByName(banded.join(prints, "fp").where("key != lead").select(F.col("lead").alias("a"), F.col("key").alias("b")))
    every = banded.select("key", "n", F.explode("bands").alias("band"))
    least = every.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "n")).alias("x")).where("m > 1")
    # Catalyst takes exploded bands to be no larger than what they come from: the hint keeps them out of a broadcast
    groups = every.join(least.select("band", F.col("x.key").alias("lead"), F.col("x.n").alias("lead_n")).hint("merge"), "band")
    groups = written(groups, "bands")
    first = groups.where(_fits(threshold) & (F.col("key") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("key").alias("b"))
    stars = written(first.unionByName(near).distinct(), "stars")
    shared = groups.select("key").unionByName(stars.select(F.col("a").alias("key"))).unionByName(stars.select(F.col("b").alias("key"))).distinct()
    sets = written(_sets(texts.join(shared, "key", "left_semi"), width).dropDuplicates(["key"]), "sets")
    links = written(_similar(stars, sets, threshold), "links")
    # what is outside a group's largest component meets one of its members
    rooted, mixed = _rooted(groups.select("band", "key", "n"), links)
    again = rooted.join(mixed, "band").where((F.col("root") != F.col("major")) & _fits(threshold))
    again = written(again.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct(), "pairs")
    links = written(links.unionByName(_similar(again, sets, threshold)), "links")
    # what is still outside meets all others, in blocks of bounded size
    rooted, mixed = _rooted(rooted.select("band", "key", "n"), links)
    whole = rooted.join(mixed, "band").join(banded.select("key", "spread"), "key")
    a, b = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    member = F.struct("key", "n", "root", "spread")
    few = whole.where("root != major").select("band", own(a).alias("ca"), F.explode(F.sequence(F.lit(0), b - 1)).alias("cb"), member.alias("few"), F.lit(None).cast(whole.select(member.alias("x")).schema["x"].dataType).alias("member"))
    many = whole.select("band", F.explode(F.sequence(F.lit(0), a - 1)).alias("ca"), own(b).alias("cb"), F.lit(None).cast(whole.select(member.alias("x")).schema["x"].dataType).alias("few"), member.alias("member"))
    blocks = few.unionByName(many).groupBy("band", "ca", "cb").agg(F.collect_list("few").alias("few"), F.collect_list("member").alias("members"))
    pairs = written(_across(blocks.select("few", "members"), threshold).distinct(), "pairs")
    return links.unionByName(_similar(pairs, sets, threshold))


def drop_similar(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each component of links between similar texts: the row with the least doc_id (null ids last).

    Texts are similar if the Jaccard similarity of their sets of shingles of `width` words (lower case) is at least
    `threshold`. Texts without words are similar to each other. Rows of the same id and text are one document.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    links = similar_links(docs.select(key.alias("key"), "text"), width, threshold)
    roots = components(links, "a", "b")
    rows = docs.select("doc_id", key.alias("key")).join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")).alias("s"))
    kept = written(least.select(F.col("s.doc_id").alias("_id"), F.col("s.key").alias("_key")), "kept")
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(kept.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi")
    named = docs.withColumn("_own", key)
    chosen = named.join(kept, named["doc_id"].eqNullSafe(kept["_id"]) & (named["_own"] == kept["_key"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
