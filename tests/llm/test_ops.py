"""The ten operators against plain versions, on odd texts, empty tables and clashing columns."""

import io
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tessella.llm import boosting, decontamination, licenses, neighbours, packing, quality, secrets, simhash, substrings, token_files, tokens, toxicity  # noqa: E402
from tessella.llm._session import scratch  # noqa: E402
from tessella.llm._words import window_hashes, word_hashes  # noqa: E402
from tessella.llm.components import components  # noqa: E402
from tessella.llm.seekable import Reader, Writer  # noqa: E402
from tessella.llm.tokens import Encoder  # noqa: E402

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def plain_tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "mode"), [(WORD, "drop"), (BYTE, "lead")])
def test_stops_at_the_begin(path, mode):
    coder, plain = Encoder(path, mode), plain_tokenizer(path)
    texts = [a + b + c + d for a in ("", "x", " ", "_", "!", ".", "\n") for b in ".," for c in (" ", "\n", "\t", "") for d in ("", "y", ".", ", z. w")]
    assert [np.frombuffer(c, "<u4").tolist() for c in coder.encode(texts)] == [plain(t) for t in texts]
    assert "^" not in tokens.ODD_STOP.pattern.replace("[^", "") + tokens.ODD_LEAD.pattern.replace("[^", "")  # else tried at every character


@pytest.mark.parametrize(("path", "mode"), [(WORD, "drop"), (BYTE, "lead")])
def test_encoder(path, mode):
    rng = random.Random(1)
    parts = ["a", "b", "The", "x  ", " ", "  ", "\n", "\n\n", "\t", " ", "é", "é", "Σ", "İ", "'s", "'ll", "don't", "1", "23", ".", ",", "!!", "", "", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "x , y", " . ", "日本", "\U0001f600", "́", "\r", "\x1c", "ſ", "(x)", "&&&", "_"]
    coder, plain = Encoder(path, mode), plain_tokenizer(path)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        for text, code in zip(texts, coder.encode(texts), strict=True):
            assert memoryview(code).cast("I").tolist() == plain(text), repr(text)


@pytest.mark.parametrize(("path", "mode"), [(WORD, "drop"), (BYTE, "lead")])
def test_special_tokens_at_start_middle_and_end(path, mode):
    from tokenizers import Tokenizer

    x = "<|endoftext|>"
    texts = [x, x + " a", "a " + x, f"a {x} b", f"a{x}b, c.", x * 3, f"A. {x.upper()} , b", f"long {'word ' * 500}{x} end"]
    plain = plain_tokenizer(path)
    assert [memoryview(c).cast("I").tolist() for c in Encoder(path, mode).encode(texts)] == [plain(t) for t in texts]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert [memoryview(c).cast("I").tolist() for c in Encoder(path, mode, True).encode(texts)] == [t.encode(y, add_special_tokens=False).ids for y in texts]


def test_token_files(spark, odd, odd_rows, none, clash):
    def made(docs):
        folder = scratch(spark, "t")
        shards = token_files.write_token_files(docs, WORD, "drop", 1, folder, frame_bytes=4096)
        return shards, token_files.read_token_files(shards, folder).toPandas()

    shards, got = made(odd)
    plain, start = plain_tokenizer(WORD), 0
    got = got.set_index("doc_id")
    for i, text, *_ in odd_rows:
        ids = np.array([*plain(text), 1], "<u4")
        assert (got.start[i], got.n_tokens[i], got.ids_crc32[i]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(made(none)[1]) == 0
    assert len(made(clash)[1]) == clash.count() and made(clash)[1].doc_id.isna().sum() == 2
    from pyarrow import fs

    for s in shards.collect():
        with fs.FileSystem.from_uri("file://" + s.file)[0].open_input_file(s.file) as f:
            reader = Reader(f)
            list(reader.ids([0]))
            assert reader.frames_read <= 1 or len(reader.sums) == reader.frames_read


def test_seekable_frames():
    out, docs = io.BytesIO(), [(i, np.arange(i * 37, dtype="<u4")) for i in range(60)]
    w = Writer(out, frame_bytes=1024)
    for i, x in docs:
        w.add(i, x.tobytes())
    w.close()
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"".join(x.tobytes() for _, x in docs)
    r = Reader(io.BytesIO(out.getvalue()))
    assert (next(r.ids(r.find(3))) == docs[3][1]).all() and r.frames_read <= 2 < len(r.sums)
    bad = bytearray(out.getvalue())
    bad[40] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(Reader(io.BytesIO(bytes(bad))).ids(range(60)))


def test_simhash(spark, odd, odd_rows, none, clash):
    got = simhash.near_duplicates(odd).toPandas().set_index("doc_id")
    fps = [brute.simhash(t) for _, t, *_ in odd_rows]
    root = brute.roots(len(fps), brute.near(fps))
    for i, fp in enumerate(fps):
        assert got.fingerprint[i] == f"{fp:016x}" and got.component_id[i] == root[i]
    assert simhash.near_duplicates(none).count() == 0
    rows = [(r.doc_id, r.text) for r in clash.collect()]
    own = brute.roots(len(rows), brute.near([brute.simhash(t) for _, t in rows]))
    ids = {r: min((rows[i][0] for i in range(len(rows)) if own[i] == r and rows[i][0] is not None), default=None) for r in set(own)}
    want = sorted((str(d), f"{brute.simhash(t):016x}", str(ids[own[i]])) for i, (d, t) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(clash).collect()) == want
    kept = simhash.drop_near_duplicates(odd, 3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == odd.columns
    assert simhash.drop_near_duplicates(clash, 3).columns == clash.columns


@pytest.mark.parametrize("group", [8192, 16, 3])
def test_links_when_signatures_are_hot(spark, group):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = [base] + [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(150)] + [int(x) for x in rng.integers(0, 1 << 62, 50)]
    fps = list(dict.fromkeys(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=group)
    root = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = brute.roots(len(fps), brute.near(fps))
    same = {}
    for i, x in enumerate(signed):
        same.setdefault(want[i], set()).add(root.get(x, x))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_signatures_are_not_broadcast(spark, monkeypatch):
    plans, write = [], simhash.written

    def planned(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(simhash, "written", planned)
    simhash.near_links(spark.range(24).select(F.col("id").alias("fp")), group=8)
    plans = [plan for name, plan in plans if name == "signatures"]
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)


def test_hot_signature_is_counted_before_the_shuffle(spark):
    """Half of the fingerprints share their lower half: a count of them leaves a task as one row."""
    rows = [(i << 32 | 7,) for i in range(1, 2000)] + [((i * 2654435761) & 0x7FFFFFFFFFFFFFFF,) for i in range(1, 2000)]
    got = simhash._counted(spark.createDataFrame(rows, "fp long").withColumn("k1", F.col("fp") % (1 << 32)), ["k1"], "t")
    assert got.count() == 1999 and got.select("n").distinct().collect()[0].n == 1999
    links = simhash.near_links(spark.createDataFrame(rows, "fp long"), group=64)
    fps = sorted({r[0] for r in rows})
    root = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = brute.roots(len(fps), brute.near(fps))
    assert len({root.get(x, x) for x in fps}) == len(set(want))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.5)).astype(float)
    t = boosting.fit(x[:1500], y[:1500])
    assert ((t.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert np.allclose(boosting.fit(x[:0], y[:0]).probability(x[:3]), 0.5)
    assert boosting.fit(x[:50], np.ones(50)).probability(x[:3]).min() > 0.9


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, none, clash):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit_quality(docs, labels, quality.train_rows())
    got = quality.quality_scores(docs, trees).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.9
    assert quality.quality_scores(clash, trees).count() == clash.count() and quality.quality_scores(none, trees).count() == 0
    flat = quality.fit_quality(docs, labels_of(spark, []), quality.train_rows())
    assert quality.quality_scores(clash, flat).where("score != 0.5").isEmpty()
    assert quality.keep_quality(clash, trees).columns == clash.columns


def test_quality_by_walking_the_trees(spark, odd, odd_rows, none, clash, tmp_path):
    """The query itself, over odd documents, against scalar walks; null and empty texts have the score of no statistics."""
    big = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shift = odd.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    big.select(odd.columns).unionByName(shift).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in quality.op3_quality(spark, str(tmp_path)).collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted((r.doc_id, r.text) for r in big.collect())
    learnt = [(d, t) for d, t in rows if d in marked and zlib.crc32(str(d).encode()) % 5]
    trees = boosting.fit(np.array([quality.statistics(t) for _, t in learnt]), np.array([float(marked[d]) for d, _ in learnt]))
    for d, t in [*rows, *((i + 1_000_000, t) for i, t, *_ in odd_rows)]:
        want = brute.walked(trees, quality.statistics(t))
        assert got[d].score == pytest.approx(want) and got[d].predicted == int(got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    assert got[1_000_000].score == got[1_000_001].score
    keep = {r.doc_id for r in quality.keep_quality(odd, trees).collect()}
    assert keep == {i for i, t, *_ in odd_rows if brute.walked(trees, quality.statistics(t)) >= 0.3}
    assert quality.keep_quality(none, trees).count() == 0 and quality.keep_quality(clash, trees).count() == sum(brute.walked(trees, quality.statistics(r.text)) >= 0.3 for r in clash.collect())


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_licenses(spark, odd, odd_rows, none, clash):
    notice = next(t for _, _, t in licenses.TEMPLATES if t.startswith("permission is hereby"))
    words = notice.split()
    more = ["released under the terms of the MIT license", "licensed under the bsd license", "x " * 50 + notice, " ".join(w + (" um" if i % 3 == 0 else "") for i, w in enumerate(words)), " ".join(words[: int(len(words) * 0.7)]), "This work is licensed under the GNU General Public License, version 3.", "(" + ") (".join(words) + ")"]
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100 + i, t) for i, t in enumerate(more)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    added = 0
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text, PHRASES)
        shares = [(label, brute.license_share(text, must, t)) for label, must, t in licenses.TEMPLATES]
        assert set(r.labels.split(",")) - {""} == set(r.base_labels.split(",")) - {""} | {x for x, s in shares if s}
        assert r.score == (1.0 if r.n_base else pytest.approx(max(s for _, s in shares)))
        added += r.labels != r.base_labels
    assert added >= 5  # without the method these have base labels alone
    assert got[100].labels == "mit" and got[100].base_labels == "" and got[101].labels == "" and "gpl-3" in got[105].labels
    assert licenses.scan(none).count() == 0
    assert sorted((str(r.doc_id), r.n_words, r.labels) for r in licenses.scan(clash).collect()) == sorted((str(r.doc_id), brute.licenses(r.text, PHRASES)[0], "") for r in clash.collect())


def test_license_blocks_with_gaps(spark):
    t = "this work is licensed under the gnu general public license version 3"
    texts = [t, t.replace("gnu", "great"), t.replace("gnu general", "x y"), t.replace("public", "p1 p2 p3 p4 p5 p6 p7 public"), "a b " + t + " c"]
    got = [r.score for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == pytest.approx([max(brute.license_share(x, must, y) for _, must, y in licenses.TEMPLATES) for x in texts])


def test_toxicity(spark, none, clash):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit_toxicity(docs, labels, toxicity.train_rows())
    got = toxicity.toxicity_scores(docs, machine).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).toPandas()
    assert ((got.score >= 0.7) == (got.toxic == 1)).mean() > 0.93
    assert machine.scores(["you are an idiot and so pathetic and a loser", "you are an idioxt and so patheetic", "the cat sat on the mat", None])[[0, 2, 3]].tolist()[0] > 0.7
    assert toxicity.toxicity_scores(clash, machine).count() == clash.count() and toxicity.toxicity_scores(none, machine).count() == 0
    flat = toxicity.fit_toxicity(docs, labels_of(spark, []), toxicity.train_rows())
    assert set(flat.scores(["x", None])) == {0.5}


def test_kernel_tolerates_gaps():
    near = toxicity.against(["stupid", "stuxpid", "table"], toxicity.embedded("stupid"))
    assert near[0] >= 1 and near[0] > near[1] > 0.3 > near[2]
    assert toxicity.tokens_of("an i d i o t here")[-1] == "idiot" and toxicity.sentences("a b. i d i o t here")[-1] == ["idiot"]


def test_kernel_by_all_subsequences():
    words = ["stupid", "stuxpid", "idiot", "a", "abc", "banana", "ünïcode", "x" * 30]
    for a in words:
        for b, got in zip(words, toxicity.against(words, toxicity.embedded(a)), strict=True):
            if len(a) > 1 and len(b) > 1:
                assert got == pytest.approx(brute.kernel(a, b), abs=1e-6)


def test_scores_of_whole_documents(spark, odd_rows):
    """Scores by hand from the machine's table and naive kernels: each word weighed alone, whole texts, null and empty ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit_toxicity(docs, labels, toxicity.train_rows())
    texts = [t for _, t, *_ in odd_rows] + ["fine words here " * 2000 + "you idiot", "the cat. You moron! No."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, machine).collect()}
    for i, text in enumerate(texts):
        tokens = toxicity.tokens_of(text)
        weigh = lambda w: max((float(toxicity.against([p], machine.table.astype(np.float32))[0]) + machine.bias for p in toxicity.pieces(toxicity.clean(w))), default=-1.0)
        f = {w: max(weigh(w), -1.0) for w in set(tokens)}
        hits = sum(v > toxicity.STRONG for v in f.values())
        x = [min(max(f.values()), 2), np.log1p(hits), np.log1p(100 * hits / len(tokens))] if tokens else [-1, 0, 0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.dot(x, machine.logistic[:3]) + machine.logistic[3]))), abs=1e-6)
    assert got[0] == got[1] == got[2] < 0.5 and max(machine.values("the cat. You moron! No.")) > toxicity.STRONG


def vectors(spark, sf):
    if sf == "made":  # ten thousand random directions
        x = np.random.default_rng(9).normal(size=(10_000, 64))
        rows = list(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()))
        return neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vec_id", "embedding").persist()
    return neighbours.usable(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), "vec_id", "embedding")


def recall(index, got, step):
    rows = index.collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.vec for r in rows])
    found, hit, n = got.groupby("query_id").vec_id.apply(set), 0, 0
    for i in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hit += len(found[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        n += 10
    return hit / n


@pytest.mark.parametrize(("sf", "step"), [("sf0.01", 100), ("sf0.01", 20), ("sf0.1", 100), ("sf0.1", 20), ("made", 100)])
def test_neighbours_recall(spark, sf, step):
    index = vectors(spark, sf)
    got = neighbours.search(index, index.where(F.col("id") % step == 0)).toPandas()
    assert recall(index, got, step) >= 0.9


def test_fewer_candidates_among_more_rows(spark):
    """The share of rows that are candidates falls as rows grow, at the parameters settled for each."""
    shares = []
    for sf in ("sf0.01", "sf0.1", "made"):
        index = vectors(spark, sf)
        each, probes = neighbours.settle(index, index.where("id % 100 = 0"), 10, 16)
        rows = index.orderBy("id").limit(3000).collect()
        ids, x = np.array([r.id for r in rows]), np.array([r.vec for r in rows])
        q = np.arange(len(ids)) % 60 == 0
        block = neighbours.Searches(ids[q], x[q], neighbours.Tables(64, 16, each), probes)
        shares.append(len(block.candidates(x)[0]) / len(ids) / q.sum())
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 16) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0] * 3), (None, [1.0] * 16)]
    clashing = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, u int, rank string, score double")
    index = neighbours.usable(clashing, "vec_id", "embedding")
    assert index.count() == 330
    got = neighbours.search(index, index.where("id % 100 = 0")).toPandas()
    x = {i: np.array(v) for i, v in rows[:330]}
    hit = 0
    for q in (0, 100, 200, 1000):
        want = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 10 and list(own["rank"]) == list(range(1, 11))
        assert list(zip(own.score, own.vec_id, strict=True)) == sorted(zip(own.score, own.vec_id, strict=True))
        hit += len({i for _, i in want} & set(own.vec_id))
    assert hit >= 36
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == list(range(1001, 1011))  # equal ones by id
    few = index.where("id < 4")
    assert neighbours.search(few, few.where("id = 0")).count() == 3
    assert neighbours.search(index.where("id < 0"), index.where("id < 0")).count() == 0
    twice = index.where("id < 4").unionByName(index.where("id = 1"))
    assert neighbours.search(twice, twice.where("id = 0 OR id = 1")).where("query_id = 0").count() == 4


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [5e-324, 0.0]), (1, [1e-310, 1e-310]), (2, [1.5e308, -1.5e308]), (3, [-1.5e308, 1.5e308]), (4, [1.0, 2.0])]
    index = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = neighbours.search(index, index).toPandas()
    assert len(got) == 20 and got.score.notna().all()
    assert got[(got.query_id == 0) & (got.vec_id == 4)].score.iloc[0] == pytest.approx(5**0.5)
    assert got[(got.query_id == 0) & (got.vec_id == 1)].score.iloc[0] == pytest.approx(2**0.5 * 1e-310, rel=1e-3)


def test_equal_vectors_are_kept_to_what_can_count():
    ids, x = np.arange(100)[::-1].copy(), np.ones((100, 4))
    x[:10] = np.arange(40).reshape(10, 4)
    keep = neighbours._fewer(ids, x, 11)
    assert sorted(ids[keep]) == list(range(11)) + list(range(90, 100))


def test_packing(odd, odd_rows, none, clash):
    got = packing.pack(odd, BYTE, "lead", 0, 64, with_ids=True).toPandas()
    plain = plain_tokenizer(BYTE)
    assert got.sequence_id.is_unique and (got.offset == 0).all() and got.length.isin([1 << k for k in range(7)]).all()
    for i, text, *_ in odd_rows:
        own = got[got.doc_id == i].sort_values("start")
        assert [x for ids in own.ids for x in ids] == [*plain(text), 0] and (own.doc_tokens == len(plain(text)) + 1).all()
        assert list(own.length) == sorted(own.length, reverse=True)
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == list(own.ids_crc32)
    assert packing.pack(none, BYTE, "lead", 0).count() == 0
    pieces = packing.pack(clash, BYTE, "lead", 0, with_ids=True).collect()
    want = sorted((str(r.doc_id), len(plain(r.text)) + 1) for r in clash.collect())
    firsts = [p for p in pieces if p.start == 0]
    assert sorted((str(p.doc_id), p.doc_tokens) for p in firsts) == want and sum(p.length for p in pieces) == sum(n for _, n in want)


def test_packing_query(spark, odd, odd_rows, tmp_path):
    """The query with its own parameters: pieces of up to 1,024 ids that are the document's in order."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got, plain = packing.op7_packing(spark, str(tmp_path)).toPandas(), plain_tokenizer(BYTE)
    for i, text, *_ in odd_rows:
        ids, own = np.array([*plain(text), 0], "<u4"), got[got.doc_id == i].sort_values("start")
        assert list(own.length) == packing.cuts(len(ids), 1024) and (own.doc_tokens == len(ids)).all()
        assert list(own.ids_crc32) == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]


KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
)


def test_secrets(odd, odd_rows, none, clash):
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(odd)).collect()}
    for i, text, *_ in odd_rows:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(text, KINDS)
        assert r.n_live + r.n_copied == len([x for x in r.spans.split(",") if x]) == len([x for x in r.classes.split(",") if x])
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    own = sorted((str(r.doc_id), r.base_sha256) for r in secrets.digest(secrets.scan(clash)).collect())
    assert own == sorted((str(r.doc_id), brute.secrets(r.text, KINDS)[3]) for r in clash.collect())
    assert sorted(str(r.text) for r in secrets.redact(clash).collect()) == sorted(str(r.text) for r in clash.collect())


def test_ownership(spark):
    key, shared, late = "Zq9xK2mW7pR4tY8uB3nV", "example0EXAMPLE1example2", "g" * 60 + "9"
    rows = [(i, f"see {shared} there password: hunter2hunter2", "en", f"s{i}", 1) for i in range(5)] + [(9, f"ours is {key} now", "en", "s1", 1), (10, f"ours is {key} too", "fr", "s1", 1), (11, f"so {late}", "fr", "s1", 1)]
    rows += [(20 + i, "token = onlyours1234 end", f"l{i % 2}", "s1", 1) for i in range(40)] + [(70 + i, "secret: inmanyrepos99", f"l{i}", "s2", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert got[9].spans == got[10].spans == "opaque:8:28" and got[0].spans == "assign:35:59" and got[11].spans == "opaque:3:64"
    values = [("hunter2hunter2", f"s{i}", "en") for i in range(5)] + [("onlyours1234", "s1", f"l{i % 2}") for i in range(40)] + [("inmanyrepos99", "s2", f"l{i}") for i in range(6)]
    live = brute.owned(values)
    for r in rows:
        v = next((x for x in live if x in r[1]), None)
        if v:
            assert got[r[0]].classes == ("live" if live[v] else "copied")
    assert set(live.values()) == {True, False} and not live["inmanyrepos99"]
    new = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert new[9] == ("ours is [secret] now", 20) and new[0][0] == f"see {shared} there [secret]"
    some = {r.doc_id: r.text for r in secrets.redact(docs, keep_copied=True).collect()}
    assert some[0] == rows[0][1] and some[20] == "[secret] end"


def test_redaction_of_overlaps(spark):
    docs = spark.createDataFrame([(1, "é token = \"" + "0a" * 20 + "\" end " + "AKIA" + "B" * 16, "en", "a", 1), (1, "other", None, None, None), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in secrets.redact(docs).collect() if r.text)
    assert got == [(1, 'other'), (1, 'é [secret]" end [secret]')]


def test_substrings(spark, odd, odd_rows, none, clash, tmp_path):
    def run(docs):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return substrings.op9_substrings(spark, str(tmp_path)).toPandas()

    def held(rows, docs):
        far = brute.longest(rows)
        want = {d: (*x, far[d]) for d, x in brute.repeats(rows).items()}
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.longest) for r in run(docs).itertuples()} == want
        return far

    held([r[:2] for r in odd_rows], odd)
    assert len(run(none)) == 0
    got = run(clash)
    words = sorted(len(brute.BLANK.findall(r.text or "")) for r in clash.collect())
    assert len(got) == clash.count() and sorted(got.n_words) == words and got.doc_id.isna().sum() == 2
    one = spark.createDataFrame([(-(1 << 63), "few words"), (None, "few words")], "doc_id long, text string")
    assert sorted(map(str, run(one).doc_id.astype("Int64"))) == [str(-(1 << 63)), "<NA>"]
    big = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held([(r.doc_id, r.text) for r in big.collect()], big.repartition(5))


def test_repeats_are_followed_until_none_survives(spark, tmp_path):
    words = [f"u{i}" for i in range(400)]
    rows = [(0, " ".join(words)), (1, "a b c " + " ".join(words[7:174]) + " d"), (2, " ".join(words[150:175]) + " z"), (3, "nothing here repeats at all"), (4, " ".join(words)), (5, "q " * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.longest for r in substrings.op9_substrings(spark, str(tmp_path)).collect()}
    assert got == brute.longest(rows) == {0: 0, 1: 160, 2: 20, 3: 0, 4: 320, 5: 80}


def test_whole_copies_meet_once_a_task(spark):
    """Half of the rows are copies of one text: each task sends one of them to meet the others'."""
    text = " ".join(f"u{i}" for i in range(50))
    rows = [(i, text if i % 2 else text + f" v{i} " * 30) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = substrings._anchors(docs, 20).where("code = -4").groupBy("route").count()
    assert sent.agg(F.max("count")).first()[0] <= 4
    changed = substrings.remove_repeats(docs)[1]
    assert changed.where("doc_id % 2 = 1 AND doc_id > 1 AND n_removed = 50").count() == 599


def test_window_hashes():
    w = word_hashes([b"a", b"b", b"c"] * 9)
    for n in (1, 2, 5, 10, 20):
        h = window_hashes(w, n)
        assert len(h) == 28 - n and h[0] == h[3 if n <= 24 else 0] and len(set(h.tolist())) == min(3, len(h))


def test_decontamination(spark, odd, odd_rows, none, clash):
    items = [(1, odd_rows[10][1]), (2, "two words"), (3, ""), (4, None), (5, "not there at all in any of these"), (6, odd_rows[10][1].upper())]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_matched) for r in decontamination.contaminated(odd, frame).collect()}
    want = brute.contained([r[:2] for r in odd_rows], items)
    assert got == want and want
    kept = {r.doc_id for r in decontamination.decontaminate(odd, frame).collect()}
    assert kept == {r[0] for r in odd_rows} - {x[0] for x in want}
    twice = odd.unionByName(odd).withColumn("doc_id", F.when(F.col("doc_id") > 12, F.lit(None)).otherwise(F.col("doc_id")))
    again = sorted((str(r.doc_id), r.item_id, r.first_word, r.last_word) for r in decontamination.contaminated(twice, frame).collect())
    once = [(str(None if r.doc_id > 12 else r.doc_id), r.item_id, r.first_word, r.last_word) for r in decontamination.contaminated(odd, frame).collect()]
    assert again == sorted(once * 2)  # repeated rows give their pairs each, null ids stay null
    assert decontamination.decontaminate(none, frame).count() == 0 and decontamination.decontaminate(odd, frame.limit(0)).count() == odd.count()
    assert decontamination.contaminated(none, frame).count() == 0 and decontamination.contaminated(odd, frame.limit(0)).count() == 0
    assert decontamination.decontaminate(clash, frame).columns == clash.columns


def test_size_classes_sketch_documents():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 9, 12, 30, 80, 300])))) for i in range(60)]
    index = decontamination.Items(items, 0.8, 5)
    assert {w: len(c) for w, c in index.index.items()}[5] >= 4
    docs = []
    for d in range(40):
        parts = [word() for _ in range(rng.randint(5, 800))]
        for _, t in rng.sample(items, 3):
            own = t.split()
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            at = rng.randrange(len(parts))
            parts[at:at] = own
        docs.append((d, " ".join(parts)))
    got = {(d, x[0], x[1], x[2]) for d, t in docs for x in index.search(t)}
    assert got == brute.contained(docs, items) and got
    for classes in index.index.values():  # a class's cutoff keeps only part of a document's hashes
        assert all(c.cutoff < np.iinfo(np.uint64).max for c in classes)
    assert decontamination.sketch_size(64, 0.8) == 13


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, r.text) for i, r in enumerate(odd.where("length(text) > 20").limit(8).collect())], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contaminated(odd, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontamination.contaminated(odd, items).collect())) == whole


def test_pipeline(spark):
    """Each stage on what the one before it kept, against plain versions."""
    import corpus_pipeline as C
    from test_similar import kept

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality":
            marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            learnt = [(d, t) for d, t in sorted(rows) if d in marked and zlib.crc32(str(d).encode()) % 5]
            trees = boosting.fit(np.array([quality.statistics(t) for _, t in learnt]), np.array([float(marked[d]) for d, _ in learnt]))
            assert ids == {d for d, t in rows if brute.walked(trees, quality.statistics(t)) >= 0.3}
        if name == "near_duplicates":
            assert sorted(ids) == kept(rows)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids == {i for i, _ in rows} - {x[0] for x in brute.contained(rows, items)}
        if name == "secrets":
            assert ids == {i for i, _ in rows}
            assert all(brute.secrets(r.text, KINDS)[:3] == (0, 0, 0) for r in out.collect())
        docs = out
    plain = plain_tokenizer(BYTE)
    pieces = C.run(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(pieces.doc_id) == set(texts)
    for d, own in pieces.groupby("doc_id"):
        assert [x for ids in own.sort_values("start").ids for x in ids] == [*plain(texts[d]), 0]
