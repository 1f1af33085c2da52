"""Operator 5: toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel compares two words by their common subsequences of four letters, word ends included, within six places; each
gap weighs a subsequence down, so an insult with inserted letters still resembles itself. The machine is trained on
sentences of labelled documents by multiple instances: a sentence is as toxic as its strongest word, its witness. All words
of clean documents' sentences lie on the fair side. Sentences of toxic documents in which a word stands that is far more
frequent in toxic documents lie on the toxic side: such a word is the first witness, then the machine chooses it anew, and
sentences that it finds well on the fair side go. Copies of toxic sentences with a letter put into the witness are
trained on as well. The landmarks are words, and their expansion is folded into one table of weights by subsequence, so a
word is weighed by looking up its subsequences. A document's score is a logistic function of its strongest sentence and of
how many witnesses it has.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.quality import labelled_sample

#: Labelled documents that are learnt from, at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 8_000
#: Words and stems that set toxic documents apart, at most, the best first; the words among them are all landmarks. Clean words
#: that are landmarks besides: the most frequent ones, those nearest to toxic ones, and any.
UNITS, LANDMARKS = 400, 160
#: Sentences that the machine is trained on, at most, and words of clean ones: the most frequent, those that begin like toxic
#: ones, and any.
CLEAN, TOXIC = 8_000, 4_000
FREQUENT, ALIKE, ANY = 3_000, 2_000, 4_000
#: The share of the toxic side's weight that copies with a letter put in have.
SPOILT = 0.5
#: A word is a witness from here; the machine's margin lies at 1.
STRONG = 0.75
#: Words in a sentence, at most; longer ones are cut.
WINDOW = 40
BITS = 18
DECAY = 0.6
PATTERNS = [(0, *c) for c in itertools.combinations(range(1, 6), 3)]
CACHE_WORDS = 300_000
_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]){3,}[^\W\d_](?!\S)")
_OTHER = re.compile(r"[\W\d_]+")


def clean(token: str) -> str:
    """Letters of a token in lower case."""
    return token if token.isalpha() else _OTHER.sub("", token)


def sentences(text: str | None) -> list[list[str]]:
    """Tokens between blanks in lower case, sentence by sentence, and words spelt letter by letter as sentences of their own."""
    text = (text or "").lower()
    parts = (p.split() for p in text.replace("\n", ". ").replace("! ", ". ").replace("? ", ". ").split(". "))
    out = [p[i : i + WINDOW] for p in parts for i in range(0, len(p), WINDOW)]
    return out + [[_OTHER.sub("", x)] for x in _SPELT.findall(text)]


def tokens_of(text: str | None) -> list[str]:
    """Tokens of all sentences of a text, taken at once."""
    text = (text or "").lower()
    return text.split() + [_OTHER.sub("", x) for x in _SPELT.findall(text)]


def pieces(word: str) -> list[str]:
    """A very long word in overlapping parts."""
    return [word] if len(word) <= 40 else [word[i : i + 40] for i in range(0, len(word) - 8, 32)]


def occurrences(words: list[str]):
    """For each gap pattern: word numbers, places in the weight table, weight."""
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    for a, b, c, d in PATTERNS:
        n = len(codes) - d
        if n <= 0:
            continue
        ok = owner[:n] == owner[d:]
        h = codes[a:][:n] * np.uint64(0x9E3779B1) + codes[b:][:n] * np.uint64(0x85EBCA77C2B2) + codes[c:][:n] * np.uint64(0xC2B2AE3D27D4) + codes[d:][:n] * np.uint64(0x165667B19E37)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield owner[:n][ok], (h[ok] >> np.uint64(64 - BITS)).astype(np.int64), DECAY ** (d - 3)


def embedded(word: str) -> np.ndarray:
    """A word's normalised weights by subsequence: the kernel with it is a lookup in this table."""
    v, norm = np.zeros(1 << BITS), 0.0
    for _, at, weight in occurrences([word]):
        np.add.at(v, at, weight)
        norm += weight**2 * len(at)
    return v / max(np.sqrt(norm), 1e-9)


def against(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with what a table holds."""
    total, norm = np.zeros(len(words)), np.zeros(len(words))
    for owner, at, weight in occurrences(words):
        total += np.bincount(owner, weight * table[at], len(words))
        norm += weight**2 * np.bincount(owner, minlength=len(words))
    return total / np.maximum(np.sqrt(norm), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, weights: np.ndarray, c: float = 4.0, rounds: int = 40) -> np.ndarray:
    """Linear machine with squared hinge loss in the primal, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        k = c * weights[on]
        new = np.linalg.solve(ridge + (x[on] * k[:, None]).T @ x[on], (x[on] * k[:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new if _ > 8 else new
    return w


@dataclass
class Machine:
    """Weights by subsequence, bias, and the logistic function of a document's three measures."""

    table: np.ndarray | None
    bias: float
    logistic: np.ndarray
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None if self.table is None else self.table.astype(np.float32)}

    def words(self, tokens: set[str]) -> None:
        """Weigh tokens that are not known yet; of a very long one the strongest part counts."""
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict(itertools.islice(self.known.items(), CACHE_WORDS // 2))
            new = [t for t in tokens if t not in self.known]
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            parts = [(i, p) for i, t in enumerate(some) for p in pieces(clean(t))]
            best = np.full(len(some), -1.0)
            np.maximum.at(best, [i for i, _ in parts], against([p for _, p in parts], self.table) + self.bias)
            self.known.update(zip(some, best.tolist(), strict=True))

    def values(self, text: str | None) -> list[float]:
        """The machine's value of each sentence of a text: that of its strongest word."""
        cut = sentences(text)
        self.words({t for s in cut for t in s})
        return [max(map(self.known.__getitem__, s)) for s in cut]

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """The strongest sentence's value - its strongest word's - and of the distinct witnesses the logarithms of their
        number and of their number in a hundred words."""
        out = np.zeros((len(texts), 3))
        out[:, 0] = -1
        if self.table is None:
            return out
        for a in range(0, len(texts), 32):
            some = [tokens_of(t) for t in texts[a : a + 32]]
            self.words(set().union(*some))
            for i, tokens in enumerate(some):
                if tokens:
                    own = set(tokens)
                    f = np.fromiter(map(self.known.__getitem__, own), float, len(own))
                    hits = int((f > STRONG).sum())
                    out[a + i] = (np.clip(f.max(), -1, 2), np.log1p(hits), np.log1p(100 * hits / len(tokens)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.measures(texts) @ self.logistic[:3] + self.logistic[3])))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
    return w


def _spoilt(word: str) -> list[str]:
    """Copies of a word with one letter put in or doubled."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in ("x", "h", word[i - 1])]


def _units(sample: DataFrame) -> DataFrame:
    """unit, t, n: in how many toxic and clean documents of the sample a word (=word) or stem (^stem) stands.

    The sample bounds their number, so a few partitions do, of which each sends its best to the driver.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, counts = batch.slice(k, 256), Counter()
                for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = {clean(t) for t in tokens_of(text)}
                    units = {"=" + w for w in words if w} | {"^" + w[:m] for w in words for m in range(3, 9) if len(w) >= m}
                    counts.update((u, bool(label)) for u in units)
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in counts]), pa.array([c if y else 0 for (_, y), c in counts.items()], pa.int64()), pa.array([0 if y else c for (_, y), c in counts.items()], pa.int64())], names=["unit", "t", "n"])

    return sample.mapInArrow(run, "unit string, t long, n long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).coalesce(8)


def _sentences(sample: DataFrame, own: set[str], stems: set[str]) -> DataFrame:
    """label, hit (whether a selected word or stem stands in it) and words of the sentences of the sample; as for _units(), a
    few partitions do, of which each sends its best to the driver."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for tokens in sentences(text):
                        words = [w for w in map(clean, tokens) if w]
                        if words:
                            rows.append((bool(label), any(w in own or any(w[:m] in stems for m in range(3, 9)) for w in words), " ".join(words)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["toxic", "hit", "words"])

    return sample.mapInArrow(run, "toxic boolean, hit boolean, words string").distinct().coalesce(8)


def _chosen(found: DataFrame, most: int) -> list[list[str]]:
    """At most so many sentences, chosen by a hash."""
    return [r.words.split() for r in found.orderBy(F.xxhash64("words"), "words").limit(most).collect()]


def train(toxic: list[list[str]], fair: list[list[str]], selected: dict[str, float], stems: set[str], others: list[str], rounds: int = 2) -> tuple[np.ndarray, float]:
    """(table, bias) of the machine that sets toxic sentences apart from fair ones.

    selected are words that may be witnesses and are landmarks, with how far labels set them apart; stems begin other
    such words; others are landmarks besides.
    """
    may = lambda w: w in selected or any(w[:m] in stems for m in range(3, 9))
    bags = [x for x in ([w for w in s if may(w)] for s in toxic) if x]
    counts = Counter(w for s in fair for w in set(s))
    frequent = sorted(counts, key=lambda w: (-counts[w], w))
    begin = {w[:3] for w in [*selected, *stems]}
    alike, rest = [w for w in frequent if w[:3] in begin], sorted(counts, key=lambda w: zlib.crc32(w.encode()))
    plain = list(dict.fromkeys(frequent[:FREQUENT] + alike[:ALIKE] + rest[:ANY]))
    spoilt = sorted({x for s in bags for w in s if w in selected and len(w) >= 4 for x in _spoilt(w)})
    words = list(dict.fromkeys([w for s in bags for w in s] + spoilt + plain))
    at = {w: i for i, w in enumerate(words)}
    marks = list(dict.fromkeys(sorted(selected) + others))
    k = np.stack([against([w[:40] for w in words] + marks, embedded(w)) for w in marks], 1).astype(np.float32)  # a landmark's table at a time
    k, own_k = k[: len(words)], k[len(words) :].astype(float)
    value, vector = np.linalg.eigh((own_k + own_k.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = k @ root
    copies, low = [at[w] for w in spoilt], [at[w] for w in plain]
    witness = [max(s, key=lambda w: (selected.get(w, 0.0), w)) for s in bags]
    for _ in range(rounds):
        own, n = np.unique([at[w] for w in witness], return_counts=True)
        n = np.minimum(n, 20) / np.minimum(n, 20).sum()
        share = SPOILT if copies else 0.0
        weight = np.concatenate([0.5 * (1 - share) * n, np.full(len(copies), 0.5 * share / max(len(copies), 1)), np.full(len(low), 0.5 / len(low))])
        y = np.concatenate([np.ones(len(own) + len(copies)), -np.ones(len(low))])
        w = svm(x[np.concatenate([own, copies, low]).astype(int)], y, weight * len(y) / 2)
        f = x @ w[:-1] + w[-1]
        best = [max(s, key=lambda v: f[at[v]]) for s in bags]
        witness = [v for v in best if f[at[v]] > -0.5] or witness
    table = np.zeros(1 << BITS)
    for beta, mark in zip(root @ w[:-1], marks, strict=True):
        table += beta * embedded(mark)
    return table, float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """The machine, from at most rows labelled documents; words, stems, sentences and measures that come to the driver are
    bounded by the constants above.

    With one label only, or nothing that sets toxic documents apart, every score is the share of toxic ones.
    """
    sample = labelled_sample(docs, labels, label, train_on, rows).persist()
    found = units = None
    try:
        tally = {bool(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
        n1, n0 = tally.get(True, 0), tally.get(False, 0)
        prior = (n1 + 0.5) / (n1 + n0 + 1)
        flat = Machine(None, -1.0, np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]))
        if not n1 or not n0:
            return flat
        units = _units(sample).persist()
        due = F.expr(f"(t + n) * {n1 / (n1 + n0)}D")
        marked = units.where((F.col("t") >= 3) & (F.col("t") * n0 > 6 * (F.col("n") + 0.5) * n1)).withColumn("z", (F.col("t") - due) / F.sqrt(due)).where("z >= 5")
        best = {r.unit: r.z for r in marked.orderBy(F.desc("z"), "unit").limit(UNITS).collect()}
        stems, own = {u[1:] for u in best if u[0] == "^"}, {u[1:]: z for u, z in best.items() if u[0] == "="}
        if not own:
            return flat
        is_word = F.col("unit").startswith("=") & (F.col("t") * n0 < 2 * (F.col("n") + 0.5) * n1)
        near = is_word & F.substring("unit", 2, 3).isin(sorted({s[:3] for s in stems}))
        third = LANDMARKS // 3
        others = units.where(is_word).orderBy(F.desc("n"), "unit").limit(third).collect() + units.where(near).orderBy(F.desc("n"), "unit").limit(third).collect()
        others += units.where(is_word).orderBy(F.xxhash64("unit"), "unit").limit(third).collect()
        found = _sentences(sample, set(own), stems).persist()
        toxic, fair = _chosen(found.where("toxic AND hit"), TOXIC), _chosen(found.where("NOT toxic"), CLEAN)
        if not toxic or not fair:
            return flat
        machine = Machine(*train(toxic, fair, own, stems, [r.unit[1:] for r in others]), np.zeros(4))

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    m = machine.measures(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(m[:, j]) for j in range(3))], names=["id", "label", "a", "b", "c"])

        got = sample.mapInArrow(run, "id long, label int, a double, b double, c double").toPandas().sort_values("id", kind="stable")
        machine.logistic = _logistic(got[["a", "b", "c"]].to_numpy(), (got.label.to_numpy() > 0).astype(float))
        return machine
    finally:
        for x in (sample, units, found):
            if x is not None:
                x.unpersist()


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one pass.

    Null and empty texts, and those without words, have one low score; a text is scored whole, however long; null ids and
    repeated rows get a score each; other columns are not read; an empty table gives no row.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            out = [held.value.scores(column.slice(k, 256).to_pylist()) for k in range(0, len(column), 256)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def train_rows(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents. Null and empty texts have no word and score low; rows with a null id get a score and a
    null held_out; repeated rows a score each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity_scores(docs, fit_toxicity(docs, labels, train_rows()))
    return scores.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
