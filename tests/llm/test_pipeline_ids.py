"""The pipeline's last stage gives the token ids themselves."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from tessella.llm import packing  # noqa: E402


def test_last_stage_has_ids(spark, odd, odd_rows, none, clash, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = corpus_pipeline.packing(spark, odd, "").toPandas()
    for i, text, *_ in odd_rows:
        own = got[got.doc_id == i].sort_values("start")
        assert [x for ids in own.ids for x in ids] == [*t.encode(text or "", add_special_tokens=False).ids, 0]
    assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in got.ids] == list(got.ids_crc32) and [len(x) for x in got.ids] == list(got.length)
    assert corpus_pipeline.packing(spark, none, "").count() == 0 and corpus_pipeline.packing(spark, clash, "").columns == list(got.columns)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert packing.op7_packing(spark, str(tmp_path)).columns == [c for c in got.columns if c != "ids"]
