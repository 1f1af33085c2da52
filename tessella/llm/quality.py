"""Operator 3: a quality classifier of boosted trees over statistics of whole documents."""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.boosting import Trees, fit

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "blank", "line_end", "stop", "comma", "exclaim", "bar", "symbol", "other_sign",
    "beyond_ascii", "byte_entropy", "distinct_words", "top_word", "word_again", "short_words", "long_words", "lines_again", "words_a_line",
)
_SYMBOLS = [ord(c) for c in "#$%&*@^~<>{}[]\\=+_`"]
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]


def statistics(text: str | None) -> list[float]:
    """Of one whole text; a null or empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = len(words) or 1
    lines = [x for x in raw.split(b"\n") if x]
    share = c[c > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    symbols = int(c[_SYMBOLS].sum())
    known = int(c[46] + c[44] + c[33] + c[124]) + symbols
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.sum() / w), c[65:91].sum() / n, c[48:58].sum() / n, c[32] / n, c[10] / n,
        c[46] / n, c[44] / n, c[33] / n, c[124] / n, symbols / n, (int(c[_SIGNS].sum()) - known) / n, c[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(operator.eq, words, words[1:])) / w, float((lengths <= 2).sum() / w), float((lengths > 14).sum() / w),
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(words) / (len(lines) or 1),
    ]


def matrix(column: pa.Array) -> np.ndarray:
    """Statistics of a column of texts."""
    rows = [statistics(t) for k in range(0, len(column), 256) for t in column.slice(k, 256).to_pylist()]
    return np.array(rows, float).reshape(-1, len(STATISTICS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most so many labelled documents, chosen by hash of their id.

    Labels are few and narrow; only the chosen ones, at most rows, are broadcast to find their documents.
    """
    chosen = labels.where(train & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the driver from the statistics of the sample (at most rows documents, a few megabytes)."""
    m = len(STATISTICS)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    got = labelled_sample(docs, labels, label, train, rows).mapInArrow(run, "id long, label int, x array<double>").toPandas()
    got = got.sort_values("id", kind="stable")
    x = np.stack(got.x.to_numpy()).astype(float) if len(got) else np.zeros((0, m))
    return fit(x, got.label.to_numpy(float))


def quality_scores(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, in one pass."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.probability(matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, trees: Trees, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores least or more."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(trees.probability(matrix(batch.column(at))) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Rows with a null id get a score and a null held_out; repeated rows a score each.

    Without labels every score is the prior of one half.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality_scores(docs, fit_quality(docs, labels, train_rows()))
    return scores.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
