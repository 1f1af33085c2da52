"""Terms of marked-up text and bags of words on rows the tables do not have."""

import time

import duckdb
import pandas as pd
import pytest

from tessella.functions.text import terms
from tessella.operators import matrix
from tessella.plans.catalog import ORACLE, QUERIES


def held(spark, tmp_path, query: str, table: str, rows: list, schema: str) -> list:
    """What a query gives on a table of these rows, after comparing it with its SQL."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLE[query])
    names = [c[0] for c in want.description]
    order = lambda rows: sorted(rows, key=repr)
    got = order(tuple(r) for r in QUERIES[query](spark, str(tmp_path)).select(*names).collect())
    assert got == order(want.fetchall()) and got
    return got


def test_clean_terms_on_odd_pages(spark, tmp_path):
    html = "<p>The cat &amp; the hat</p> <a href='x'>of</a> see https://a.b/c?d\x0bfoo bar a I <unclosed tail"
    rows = [(1, html), (1, "cat cat"), (None, "cat hat"), (None, "only here"), (2, None), (3, ""), (4, "<<a> b>> ccc &#39;dd&nope e&x;f"), (5, "the of and")]
    got = held(spark, tmp_path, "clean_terms", "pages", rows, "page_id long, html string")
    assert ("cat", 4, 1) in got and ("only", 1, 0) in got and not {"the", "of", "and"} & {r[0] for r in got}


def test_terms_take_time_in_proportion(spark):
    """A long page: its terms are found once, not once for each of them."""
    page = " ".join(f"<b>{'abcdefghij'[i % 10] * (1 + i % 7)}</b>" for i in range(20_000))
    rows = spark.createDataFrame([(page,)], "html string")
    rows.select(terms(rows.html.substr(1, 100), ["b"], 2)).collect()
    began = time.perf_counter()
    (found,) = rows.select(terms(rows.html, ["bb"], 2)).first()
    assert time.perf_counter() - began < 20
    want = pd.Series(["abcdefghij"[i % 10] * (1 + i % 7) for i in range(20_000)])
    assert found == want[(want.str.len() >= 2) & (want != "bb")].tolist()
    assert rows.select(terms(rows.html)).first()[0] == want.tolist()


@pytest.mark.parametrize("few", [matrix.FEW_IDS, 0])
def test_bag_of_words_of_repeated_ids(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(matrix, "FEW_IDS", few)
    rows = [(i, " ".join(f"t{'abcdefghij'[(i * k) % 10]}{'xyz'[k % 3]}" for k in range(i))) for i in range(40)]
    rows += [(7, "ta ta TB9tb"), (7, "ta"), (8, None), (50, None), (51, ""), (51, "ta tb ta"), (None, "ta tb"), (None, "tb tc"), (52, "123 --")]
    held(spark, tmp_path, "bag_of_words", "documents", rows, "doc_id long, text string")
    few_terms = [sorted(map(tuple, matrix.bag_of_words(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()), key=repr) for n in (3, 100_001)]
    assert few_terms[0] == [r for r in few_terms[1] if r[1] < 3]


def test_bag_of_words_sends_chosen_terms_only(spark):
    """200 terms a document, of which three are asked for."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(i, " ".join(word((i + k) % 500) for k in range(200))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "i long, text string").repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def records() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    assert len(matrix.bag_of_words(docs, 3, "i").collect()) == 1500 // 500 * 600
    assert records() - before < 20_000  # 300,000 pairs
