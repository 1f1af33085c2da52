"""Operator 9: passages that repeat, by windows of doubling length.

Level 1 takes windows of half the wanted length. Of these only the minimiser of each full window is indexed: two equal
full windows choose the same one, so nothing is lost and a sixth of the rows suffices. Windows repeated at one length
alone are extended to twice that length: of the windows of twice the length whose minimiser repeats - from the second
step on all windows of half their length in them - hashes are grouped by that minimiser, and those that occur more than
once go on to the next length, until no candidate survives. Windows that started earlier elsewhere are marked: those of
the wanted length mark the words that go, the longer ones tell how far a document's repeats reach.

Every exchange is combined before it is shuffled: within a batch only the first of equal windows is sent to meet others,
the rest are known to repeat and go their own way by document, so a passage that a third of all documents share puts no
more than a row for each batch on one task. The same holds for whole copies of a document: a task sends the first it meets,
the later ones are known and are not cut into windows at all.

Each word has two hashes of 64 bits, by two functions. Minimisers come from the first and windows from the second, so windows taken for equal
agree in both; whole copies agree in 128 bits of both hashes of all their words. Words are split, numbered and hashed by
batch - each different word of a piece of it once -, and windows of all its documents are hashed together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._session import written
from tessella.llm._words import _M, mix, window_hashes

_LOWEST = -(1 << 63)
#: Documents of a batch within which equal windows are combined, and whole texts that a task remembers at a time.
ROWS, WHOLES = 2048, 200_000
#: Bytes of text whose words are held at a time, more only if one text has more.
PIECE = 4 << 20
#: Windows of one entry: as many bits as its masks have.
BITS = 31
_FLAGS = "doc_id long, row long, start int, later int, again int"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The first hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def other_hashes(words: list[bytes]) -> np.ndarray:
    """The second hash of each word, by another function."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pieces(text: pa.Array):
    """Places of texts in a row, from and to, of PIECE bytes or one text at most."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(size, PIECE + (size[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def _rows(batch: pa.RecordBatch, k: int):
    """The rows of a batch from k on, at most ROWS, in the order of their documents, a piece at a time."""
    part = batch.take(pa.array(np.argsort(batch.column(0).slice(k, ROWS).to_numpy(), kind="stable") + k))
    for at, end in _pieces(part.column(part.schema.get_field_index("text"))):
        yield part.slice(at, end - at)


class _Words:
    """The words of some texts, those of text i from offs[i] to offs[i + 1]."""

    def __init__(self, text: pa.Array):
        lists = pc.ascii_split_whitespace(text)
        self.values = lists.values
        full = pc.binary_length(self.values).to_numpy(zero_copy_only=False) > 0  # blanks at an end leave empty ones
        self.at = np.flatnonzero(full)
        self.offs = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]
        self.n = np.diff(self.offs)

    def hashes(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each word, or of some words by their places."""
        coded = self.values.take(pa.array(self.at if some is None else self.at[some])).dictionary_encode()
        words, ids = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        return word_hashes(words)[ids], other_hashes(words)[ids]

    def starts(self, length: int) -> np.ndarray:
        """True at words from which so many stand in their text."""
        place = np.arange(self.offs[-1]) - np.repeat(self.offs[:-1], self.n)
        return place <= np.repeat(self.n, self.n) - length

    def marked(self, packed: pa.Array, length: int) -> np.ndarray:
        """_marked() of lists of entries by text, without places from which fewer than so many words stand."""
        of = np.repeat(np.arange(len(self.n)), pc.fill_null(pc.list_value_length(packed), 0).to_numpy(zero_copy_only=False))
        x = packed.flatten().to_numpy(zero_copy_only=False)
        start, mask = (x >> BITS) + self.offs[of], x & (1 << BITS) - 1
        end = self.offs[of + 1] - length
        out = np.zeros(self.offs[-1], bool)
        for bit in range(int(mask.max()).bit_length() if len(mask) else 0):
            to = start[mask >> bit & 1 > 0] + bit
            out[to[to <= end[mask >> bit & 1 > 0]]] = True
        return out


def _wholes(offs: np.ndarray, h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """128 bits of the words of each text as two signed longs."""
    both = np.stack([h, other], 1)
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(both[a:b].tobytes(), 9) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)


def minimisers(h: np.ndarray, n: int) -> np.ndarray:
    """For each n values in a row the position of the least (the first of equal ones): the least of 2, 4, 8 .. values, then
    of two overlapping stretches."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    at, size, least = np.arange(len(h)), 1, h
    while size < n:
        step = min(size, n - size)
        a, b = least[:-step], least[step:]
        less = b < a
        at, least, size = np.where(less, at[step:], at[:-step]), np.minimum(a, b), size + step
    return at


def _firsts(order: list[np.ndarray]) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    if not len(order[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(order[0]), bool)
    new[0] = True
    for c in order:
        new[1:] |= c[1:] != c[:-1]
    return new


def _route(doc_ids: np.ndarray) -> np.ndarray:
    return mix(doc_ids.astype(np.int64).view(np.uint64)).view(np.int64)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """route, doc_id, code, whole: minimisers of length // 2 words, and as position -1 the hash of all words.

    route is the hash, or for what is known to repeat a hash of its document; code is 4 * position, plus 2 for an anchor
    that equals an earlier one of its batch or a copy of a whole document that the task has met, plus 1 for an anchor that
    a later one equals. whole is the second half of the hash of all words.
    """
    half = length // 2

    def run(batches):
        met: dict = {}  # whole texts, with the least document that has them
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                hs, ds, ps, alone = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                for part in _rows(batch, k):
                    words = _Words(part.column(1))
                    first_hash, other = words.hashes()
                    cut = words.n >= length
                    own, long = part.column(0).to_numpy(), np.flatnonzero(cut)
                    for i, whole, doc_id in zip(long.tolist(), map(tuple, _wholes(words.offs, first_hash, other)[long].tolist()), own[long].tolist(), strict=True):
                        first = met.get(whole)
                        if first is not None and first <= doc_id:
                            cut[i] = False
                            if first < doc_id:
                                alone.append((None, doc_id, -2, whole[1]))
                            continue
                        if len(met) >= WHOLES:
                            met.clear()
                        met[whole] = doc_id
                        alone.append((whole[0], doc_id, -4, whole[1]))
                    h = mix(window_hashes(first_hash, half))
                    of = np.repeat(np.arange(len(own)), words.n)
                    at = minimisers(h, length - half + 1)
                    at = at[(words.starts(length) & cut[of])[: len(at)]]
                    at = at[_firsts([at])]  # the minimisers of windows in a row do not go back
                    hs.append(h[at]), ps.append(at - words.offs[of[at]]), ds.append(own[of[at]])
                h, d, p = np.concatenate(hs).view(np.int64), np.concatenate(ds), np.concatenate(ps)
                order = np.argsort(h, kind="stable")  # by document and place within equal ones, as they come
                h, d, p = h[order], d[order], p[order]
                first = _firsts([h])
                code = 4 * p + 2 * ~first + np.append(~first[1:], False)[: len(h)]
                if alone:
                    own = np.array([x[1] for x in alone], np.int64)
                    h = np.concatenate([np.where(first, h, _route(d)), [r if x[0] is None else x[0] for x, r in zip(alone, _route(own).tolist(), strict=True)]])
                    d, code = np.concatenate([d, own]), np.concatenate([code, [x[2] for x in alone]])
                    whole = np.concatenate([np.zeros(len(h) - len(own), np.int64), np.array([x[3] for x in alone], np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, d, code, whole)], names=["route", "doc_id", "code", "whole"])

    return docs.mapInArrow(run, "route long, doc_id long, code long, whole long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """doc_id and spot of the anchors that occur more than once: a position, or for a later copy of a whole document
    -1 - its order is told by doc_id - with the second half of the hash of its words."""

    def run(batches):
        last = None  # the first row of the run that goes on, and whether it is out already
        for batch in batches:
            h, d, code, whole = (c.to_numpy() for c in batch.columns)
            known = code & 2 > 0
            docs, spots, wholes = [d[known]], [code[known] >> 2], [whole[known]]
            h, d, code, whole = (x[~known] for x in (h, d, code, whole))
            was = np.zeros(len(h), bool)
            if last is not None:
                h, d, code, whole, was = (np.append(x, y) for x, y in zip(last, (h, d, code, whole, was), strict=True))
            if not len(h):
                last = None
            else:
                pos = code >> 2
                new = _firsts([h, whole, pos < 0])
                begin, run_of = np.flatnonzero(new), np.cumsum(new) - 1
                out = np.where(pos < 0, d > d[begin][run_of], (np.bincount(run_of)[run_of] > 1) | (code & 1 > 0))
                some = out & ~was
                docs.append(d[some]), spots.append(pos[some]), wholes.append(np.where(pos[some] < 0, whole[some], 0))
                at = begin[-1]
                last = tuple(x[at : at + 1] for x in (h, d, code, whole, was | out))
            d, p, w = (np.concatenate(x) for x in (docs, spots, wholes))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p.astype(np.int32)), pa.array(w)], names=["doc_id", "spot", "whole"])

    rows = anchors.repartition("route").sortWithinPartitions("route", F.expr("code >= 0"), "whole", "doc_id", "code")
    return rows.mapInArrow(run, "doc_id long, spot int, whole long")


def _marked(packed: list[int], n: int) -> np.ndarray:
    """True at the n places that entries (start and mask in one number) have bits for."""
    out = np.zeros(n + BITS, bool)
    x = np.array(packed, np.int64)
    start, mask = x >> BITS, x & (1 << BITS) - 1
    start, mask = start[start < n], mask[start < n]
    if len(start):
        row, bit = np.nonzero(mask[:, None] >> np.arange(int(mask.max()).bit_length()) & 1)
        out[start[row] + bit] = True
    return out[:n]


def _windows(docs: DataFrame, length: int, first: bool) -> DataFrame:
    """route, doc_id, row, start, known, again, hashes: the windows of a length that may repeat, from (doc_id, row, text, hot).

    hot tells which windows of half the length repeat; at the first step only minimisers do. Windows of one minimiser that
    start in a row are an entry. Bit i of known tells that window i equals an earlier one of its batch, of again that it
    equals any; an entry of which all are known has no hashes and is routed by its document, any other by its minimiser.
    """
    half = length // 2

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                keys, hs, ds, rs, ss, es = [], [], [], [], [], []
                for part in _rows(batch, k):
                    words, span = _Words(part.column(2)), length - half + 1
                    hot = words.marked(part.column(3), half)
                    total = np.concatenate([[0], np.cumsum(hot)])
                    hits = total[span:] - total[:-span]
                    start = np.flatnonzero((hits > 0 if first else hits == span) & words.starts(length)[: len(hits)])
                    if not len(start):
                        continue
                    edge = np.zeros(len(hot) + 1, np.int64)
                    np.add.at(edge, start, 1), np.add.at(edge, start + length, -1)
                    some = np.flatnonzero(np.cumsum(edge)[:-1])  # words of such windows, in a row here as there
                    near = np.searchsorted(some, start)
                    one, other = words.hashes(some)
                    anchor = mix(window_hashes(one, half))
                    at = minimisers(anchor, span)[near]
                    if first:
                        kept = hot[some[at]]
                        start, near, at = start[kept], near[kept], at[kept]
                    of = np.searchsorted(words.offs, start, "right") - 1
                    keys.append(anchor[at]), hs.append(window_hashes(other, length)[near]), ss.append(start - words.offs[of]), es.append(at)
                    ds.append(part.column(0).to_numpy()[of]), rs.append(part.column(1).to_numpy()[of])
                if not keys or not sum(map(len, keys)):
                    continue
                key, h, d, r, s, e = (np.concatenate(x) for x in (keys, hs, ds, rs, ss, es))
                d, r, s = d.astype(np.int64), r.astype(np.int64), s.astype(np.int64)
                order = np.argsort(mix(key * _M ^ h), kind="stable")  # by document and place within equal ones, as they come
                fresh = _firsts([key[order], h[order]])
                lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))]
                later, more = np.zeros(len(h), bool), np.zeros(len(h), bool)
                later[order] = (d[order] > d[lead]) | (d[order] == d[lead]) & (s[order] > s[lead])
                more[lead[later[order]]] = True
                new = _firsts([d, r, e]) | np.append(True, s[1:] != s[:-1] + 1)
                begin = np.flatnonzero(new)
                place = np.arange(len(h)) - begin[np.cumsum(new) - 1]
                begin = np.flatnonzero(place % BITS == 0)  # long entries in parts
                end, place = np.append(begin[1:], len(h)), place % BITS
                known, again = (np.add.reduceat(x.astype(np.int64) << place, begin) for x in (later, later | more))
                full = known == (1 << (end - begin)) - 1
                route = np.where(full, _route(d[begin]).view(np.uint64), key[begin]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(full, 0, 8 * (end - begin)))]).astype(np.int32)
                sent = h[np.repeat(~full, end - begin)]
                hashes = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(sent)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), pa.array(d[begin]), pa.array(r[begin]), *(pa.array(x.astype(np.int32)) for x in (s[begin], known, again)), hashes],
                    names=["route", "doc_id", "row", "start", "known", "again", "hashes"],
                )

    return docs.mapInArrow(run, "route long, doc_id long, row long, start int, known int, again int, hashes binary")


def _judged(entries: DataFrame) -> DataFrame:
    """doc_id, row, start, later, again: of an entry's windows those whose words started earlier, and those whose words
    occur more than once; entries come by minimiser and in document order, so the first of equal windows is met first."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches):
        route, seen, open_ = None, {}, []  # of the minimiser that goes on: windows with their first place, entries with first ones
        for batch in batches:
            out = []
            for key, d, r, start, later, again, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashes:
                    if key != route:
                        out += (x for x in open_ if x[4])
                        route, seen, open_ = key, {}, []
                    entry, fresh = [d, r, start, later, again], False
                    for i, h in enumerate(memoryview(hashes).cast("Q")):
                        was = seen.get(h)
                        if was is None:
                            seen[h], fresh = (entry, i), True
                        elif (was[0][0], was[0][2] + was[1]) < (d, start + i):
                            was[0][4] |= 1 << was[1]
                            entry[3] |= 1 << i
                            entry[4] |= 1 << i
                    if fresh:
                        open_.append(entry)
                    elif entry[4]:
                        out.append(entry)
                else:
                    out.append((d, r, start, later, again))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "row", "start", "later", "again"])
        if out := [x for x in open_ if x[4]]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "row", "start", "later", "again"])

    rows = entries.repartition("route").sortWithinPartitions("route", "doc_id", "start")
    return rows.mapInArrow(run, _FLAGS)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, n_removed, longest, kept (text) of documents with windows that started earlier; flags null: a later
    whole copy."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 128):
                for doc_id, row, text, longest, flags in zip(*(batch.slice(k, 128).column(i).to_pylist() for i in range(5)), strict=True):
                    words = split_words(text)
                    if flags is None:
                        n, kept, longest = len(words), [], length * (1 << (len(words) // length).bit_length() - 1)
                    else:
                        starts = np.flatnonzero(_marked(flags, len(words) - length + 1))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, starts, 1), np.add.at(edge, starts + length, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        n, kept = int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    out.append((doc_id, row, n, longest, b" ".join(kept).decode("utf-8")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "row", "n_removed", "longest", "kept"])

    return docs.mapInArrow(run, "doc_id long, row long, n_removed long, longest long, kept string")


def _levels(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(marks, longest) of (doc_id, row, text, hot): doc_id, row, flags of documents with windows of the length that started
    earlier, and doc_id, row, longest: the greatest of length, twice length .. of which some window started earlier."""
    packed = lambda c: F.when(F.col(c) != 0, F.shiftleft(F.col("start").cast("long"), BITS) + F.col(c))
    marks = reach = None
    level = length
    while True:
        found = _judged(_windows(docs.select("doc_id", "row", "text", "hot"), level, level == length))
        found = found.groupBy("doc_id", "row").agg(F.collect_set(packed("later")).alias("flags"), F.collect_set(packed("again")).alias("hot"), F.sum(F.bit_count("again")).alias("n"))
        found = written(found, "repeats")
        told = found.where(F.size("flags") > 0).select("doc_id", "row", F.lit(level).cast("long").alias("longest"))
        marks = found.where(F.size("flags") > 0).select("doc_id", "row", "flags") if marks is None else marks
        reach = told if reach is None else reach.unionByName(told)
        # a window of twice the length has level + 1 of this one in it
        alive = found.where(F.col("n") > level).select("doc_id", "row", "hot")
        if alive.isEmpty():
            return marks, reach.groupBy("doc_id", "row").agg(F.max("longest").alias("longest"))
        docs, level = written(docs.select("doc_id", "row", "text").join(alive, ["doc_id", "row"]), "survivors"), 2 * level


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, changed). rows: doc_id, row, text, empty_id of every row of docs, row being a hash that tells texts of one id
    apart. changed: doc_id, row, n_removed, longest and kept (the words that stay, joined by blanks) of the documents that
    lose words; longest is the greatest of length, twice length, four times .. of which a window started earlier.

    A word goes if a window of `length` words that covers it starts earlier too: in a smaller doc_id, or earlier in the
    same document. Null ids come first, where the least long stands. Rows with equal id and text stand at one place, so
    neither is the earlier one; rows with equal id and other texts are compared by where the window starts. Null, empty
    and short texts lose nothing; other columns are not read; an empty table gives no row.
    """
    if length < 2 or length > 40 or length % 2:
        raise ValueError("length must be even, from 2 to 40")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("empty_id"))
    spots = _repeated(_anchors(rows.select("doc_id", "text"), length)).groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("spot") >= 0, F.shiftleft(F.col("spot").cast("long"), BITS) + 1)).alias("hot"), F.collect_set(F.when(F.col("spot") < 0, F.col("whole"))).alias("wholes")
    )
    spots = written(spots, "repeated-anchors")
    some = written(rows.select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"]).join(spots, "doc_id"), "documents-with-repeats")

    def whole(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            copied = np.flatnonzero(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            texts = batch.column(2).take(pa.array(copied))
            for at, end in _pieces(texts):
                words = _Words(texts.slice(at, end - at))
                own = _wholes(words.offs, *words.hashes())[:, 1].tolist()
                keep[copied[at:end]] = [x in w for x, w in zip(own, batch.column(4).take(pa.array(copied[at:end])).to_pylist(), strict=True)]
            yield batch.append_column("copy", pa.array(keep))

    told = some.mapInArrow(whole, "doc_id long, row long, text string, hot array<long>, wholes array<long>, copy boolean")
    copies = told.where("copy").select("doc_id", "row", "text", F.lit(0).cast("long").alias("longest"), F.lit(None).cast("array<long>").alias("flags"))
    marks, longest = _levels(told.where("NOT copy"), length)
    marked = some.select("doc_id", "row", "text").join(longest.join(marks, ["doc_id", "row"]), ["doc_id", "row"])
    return rows, _cut(copies.unionByName(marked.select(*copies.columns)), length)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, windows of 20 words; longest is the greatest length tried (20, 40, 80 ..) at which a window of the document
    starts earlier too, 0 if none does."""
    rows, changed = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batches):
        for batch in batches:
            n, sums = [], []
            for k in range(0, batch.num_rows, 128):
                for text in batch.column(3).slice(k, 128).to_pylist():
                    words = split_words(text)
                    n.append(len(words)), sums.append(_digest(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(sums)], names=["doc_id", "row", "empty_id", "n_words", "own"])

    every = rows.select("doc_id", "row", "empty_id", "text").mapInArrow(digest, "doc_id long, row long, empty_id boolean, n_words long, own string")
    less = written(changed.select("doc_id", "row", "n_removed", "longest", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "row"]), "changed")
    out = every.join(less, ["doc_id", "row"], "left")
    return out.select(F.when(~F.col("empty_id"), F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))
