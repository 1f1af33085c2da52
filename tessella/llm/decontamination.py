"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so resemblance says little and containment is wanted: the share of an item's
shingles that the document holds. Items are partitioned by their number of shingles, in powers of two, and each size class
has an index of its own. In a class of at most u shingles an item is sketched by its m = u - ceil(t u) + 1 smallest hashes
(bottom-m MinHash); a document is sketched for the class by its hashes up to the class's cutoff, the largest hash in any
of its items' sketches. If a document holds a share t of an item of n shingles, it misses at most n - ceil(t n) of them, so
at least m less that number stand in both sketches: a document with too few shingles for the class is not looked up in
it at all, and an item of which fewer hashes are met is no candidate. The search loses nothing; what it finds is verified
by exact shingle containment on the words themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._schema import schema
from tessella.llm._words import PLAIN, mix, window_hashes, word_hashes

#: Characters of test items that are broadcast at once; more items take more passes over the documents.
BLOCK_CHARS = 8_000_000
_FOUND = schema("doc_id long, item_id long, n_shingles long, n_matched long, containment double, first_word long, last_word long")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII signs other than letters and digits part words."""
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN).split()


def size_class(n: int) -> int:
    """The greatest size of the class of an item of n shingles."""
    return 1 << (n - 1).bit_length()


def sketch_size(upper: int, threshold: float) -> int:
    """Hashes in the sketches of a class."""
    return upper - math.ceil(threshold * upper - 1e-9) + 1


class SizeClass:
    """The index of a size class: sketch hashes in order with their items, the documents' cutoff, and what is needed."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], upper: int, threshold: float) -> None:
        m = sketch_size(upper, threshold)
        parts = [(h[:m], k, min(m, len(h)) - (len(h) - least)) for k, h, least in items]  # h is sorted
        hashes, owner = np.concatenate([p[0] for p in parts]), np.repeat([p[1] for p in parts], [len(p[0]) for p in parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.cutoff, self.fewest = self.hashes[-1], min(least for *_, least in items)
        self.need = {k: n for _, k, n in parts}

    def candidates(self, own: np.ndarray) -> list[int]:
        """Items whose sketches hold enough of a document's hashes; own are its distinct hashes in order."""
        if len(own) < self.fewest:
            return []
        sketch = own[: np.searchsorted(own, self.cutoff, "right")]
        at = np.searchsorted(self.hashes, sketch)
        hit = sketch[self.hashes[np.minimum(at, len(self.hashes) - 1)] == sketch]
        if not len(hit):
            return []
        a, b = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, "right")
        items, n = np.unique(np.concatenate([self.owner[x:y] for x, y in zip(a, b, strict=True)]), return_counts=True)
        return [k for k, c in zip(items.tolist(), n.tolist(), strict=True) if c >= self.need[k]]


class Items:
    """A block of test items: an index for each size class, and shingles for verification, by window length."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, width: int) -> None:
        self.items: list[tuple] = []
        found: dict[int, dict[int, list]] = {}
        for item_id, text in rows:
            words = words_of(text)
            w = min(width, len(words))
            if not w:
                continue
            h = np.unique(mix(window_hashes(word_hashes(words), w)))
            shingles = {b" ".join(words[i : i + w]) for i in range(len(words) - w + 1)}
            least = math.ceil(threshold * len(shingles) - 1e-9)
            found.setdefault(w, {}).setdefault(size_class(len(h)), []).append((len(self.items), h, least))
            self.items.append((item_id, h, shingles, least))
        self.index = {w: [SizeClass(items, upper, threshold) for upper, items in sorted(classes.items())] for w, classes in found.items()}

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, shingles, matched, containment, first word, last word) for each item found in a text."""
        words = words_of(text)
        if not words:
            return []
        hashes, out = word_hashes(words), []
        for w, classes in self.index.items():
            h = mix(window_hashes(hashes, w))
            distinct = np.unique(h)
            for k in sorted(k for c in classes for k in c.candidates(distinct)):
                item_id, own, shingles, least = self.items[k]
                places = np.flatnonzero(np.isin(h, own))
                seen: dict[bytes, None] = {}
                spots = []
                for p in places.tolist():
                    s = b" ".join(words[p : p + w])
                    if s in shingles:
                        seen[s] = None
                        spots.append(p)
                if len(seen) >= least:
                    out.append((item_id, len(shingles), len(seen), len(seen) / len(shingles), spots[0], spots[-1] + w - 1))
        return out


def blocks_of(items: DataFrame, threshold: float, width: int, item_col: str = "item_id", text_col: str = "text"):
    """Broadcasts of the items in blocks of about BLOCK_CHARS characters at most."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield items.sparkSession.sparkContext.broadcast(Items(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r)), threshold, width))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of document and test item with at least threshold of the item's shingles in the document.

    Returns doc_id, item_id, n_shingles (distinct, of the item), n_matched, containment, first_word and last_word (the
    range of words in which matches stand). Documents are read once for each block of items and never shuffled.
    Items of fewer words than width have their whole sequence as one shingle; items without words are never found;
    null texts are empty; items with equal text are found each; repeated rows give their pairs each; null ids stay null.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for held in blocks_of(items, threshold, width, item_col, item_text_col):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                ids, column, found = batch.column(0).to_pylist(), batch.column(1), []
                for k in range(0, len(ids), 256):
                    for doc_id, text in zip(ids[k : k + 256], column.slice(k, 256).to_pylist(), strict=True):
                        found += [(doc_id, *x) for x in index.search(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2, strict=True)], names=_FOUND.names)

        found = texts.mapInArrow(run, _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, text_col: str = "text") -> DataFrame:
    """docs without the rows in whose text a test item is found; one pass for each block of items, no join.

    Null, empty and short texts hold no item and stay, as do null ids and repeated rows without an item; columns stay as
    they are; an empty table of either kind takes nothing away.
    """
    at = docs.columns.index(text_col)
    for held in blocks_of(items, threshold, width):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                column = batch.column(at)
                keep = [not index.search(text) for k in range(0, len(column), 256) for text in column.slice(k, 256).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark, five words and a containment of 0.8."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
