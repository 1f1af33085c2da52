"""Operator 7: packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of the largest length as fit, and the rest into the binary digits of
what is left, longest first. Every piece is a sequence of its own, so none crosses documents, none has padding, and
sequences of one length form a bucket from which batches of one shape are drawn.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.tokens import encoder, groups

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids; longest is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, mode: str, end_id: int, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every text: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (binary
    logarithm of length) and, if asked for, ids (array<int>).

    One pass without a shuffle. sequence_id is partition, bucket and a count, so it is unique, and the sequences of one
    bucket and partition are numbered in a row. Null texts count as empty and give the end id alone; repeated rows give
    their pieces each; null ids stay null; other columns are not read; an empty table gives no piece.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    schema = T.StructType.fromDDL(_PIECES + (", ids array<int>" if with_ids else ""))

    def run(batches):
        coder = encoder(vocabulary, mode)
        end = end_id.to_bytes(4, "little")
        part, count = TaskContext.get().partitionId() << 40, [0] * longest.bit_length()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 1024):
                some = [t or "" for t in texts.slice(k, 1024).to_pylist()]
                for a, b in groups(some):
                    rows, codes = [], []
                    for doc_id, code in zip(ids[k + a : k + b], coder.encode(some[a:b]), strict=True):
                        code += end
                        codes.append(code)
                        n, start = len(code) // 4, 0
                        for length in cuts(n, longest):
                            bucket = length.bit_length() - 1
                            piece = code[4 * start : 4 * (start + length)]
                            rows.append((doc_id, start, length, zlib.crc32(piece), n, part | bucket << 34 | count[bucket], 0, bucket))
                            count[bucket] += 1
                            start += length
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.int32()], strict=True)]
                    if with_ids:  # the pieces of a document follow each other, so they are its ids in order
                        ends = np.cumsum([0, *(r[2] for r in rows)], dtype=np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as a table with one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def pack_documents(docs: DataFrame) -> DataFrame:
    """pack() with ids and the parameters of production: public vocabulary byte_bpe_50k, end id 0, at most 1024 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "lead", 0, with_ids=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed, the ids told by their checksums; sequences have a power of two as their length, so none is padded."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
