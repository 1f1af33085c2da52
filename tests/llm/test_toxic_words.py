"""Every selected toxic word teaches the machine, wherever it stands in the alphabet."""

import random
import string

from pyspark.sql import functions as F

from tessella.llm import toxicity


def test_all_toxic_words_have_copies_and_landmarks(spark, monkeypatch):
    rng = random.Random(4)
    toxic = [string.ascii_lowercase[i % 26] + "".join(rng.choice("aeioubdgkmpt") for _ in range(4)) for i in range(110)]
    toxic = sorted(set(toxic))
    fair = ["".join(rng.choice("cfhjlnrsvw") for _ in range(6)) for _ in range(300)]
    say = lambda words, n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(toxic[i % 11 :: 11] + say(fair, 20)), i, 1) for i in range(66)]
    rows += [(i, " ".join(say(fair, 30)), i, 0) for i in range(100, 760)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    copied, marks = set(), set()
    spoilt, embedded = toxicity._spoilt, toxicity.embedded
    monkeypatch.setattr(toxicity, "_spoilt", lambda w: copied.add(w) or spoilt(w))
    monkeypatch.setattr(toxicity, "embedded", lambda w: marks.add(w) or embedded(w))
    toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert set(toxic) <= copied and set(toxic) <= marks
