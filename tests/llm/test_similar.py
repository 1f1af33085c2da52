"""The pipeline's near-duplicate stage against exact similarities of all pairs."""

import random
import sys
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from tessella.llm import similar  # noqa: E402


def shingled(text):
    words = brute.BLANK.findall(brute.lower(text))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def kept(rows):
    """Least ids of the components of pairs with similarity 0.8 or more."""
    rows = sorted(rows)
    sets = [shingled(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    return sorted({rows[r][0] for r in brute.roots(len(rows), links)})


def stage(spark, docs):
    return corpus_pipeline.near_duplicates(spark, docs, "")


def test_similar_texts(spark, odd, odd_rows, none, clash):
    rng = random.Random(8)
    rows = [r[:2] for r in odd_rows]
    for _ in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 300))]
        for _ in range(4):  # chains of copies, some on either side of the threshold
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 5000)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in stage(spark, docs).collect()) == kept(rows)
    assert stage(spark, none).count() == 0 and stage(spark, clash).columns == clash.columns
    assert stage(spark, clash).count() == len(kept([(i, r.text) for i, r in enumerate(clash.collect())]))


def test_bands_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, similar.written

    class Planned(Exception):
        pass

    def planned(df, name):
        if name == "bands":
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            raise Planned
        return write(df, name)

    monkeypatch.setattr(similar, "written", planned)
    with pytest.raises(Planned):
        similar.similar_links(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "key long, text string"))
    assert "explode" in plans["bands"] and "Broadcast" not in plans["bands"]


def test_similar_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r.doc_id for r in stage(spark, docs).collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])
