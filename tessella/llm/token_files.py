"""Operator 1: token ids of a corpus in seekable, checksummed binary shards."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._schema import schema
from tessella.llm._session import scratch
from tessella.llm.seekable import FRAME_BYTES, Reader, Writer
from tessella.llm.tokens import encoder, groups

#: Bytes of text in a shard, about; its index of documents is held in memory while it is written or read.
SHARD_BYTES = 256 << 20
_SHARDS = schema("shard int, file string, n_docs long, n_tokens long, n_bytes long")
_BACK = schema("doc_id long, start long, n_tokens long, ids_crc32 long, shard int, position long")


def write_token_files(docs: DataFrame, vocabulary: str, mode: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every text, append end_id and write the ids in ascending document order, one file for each range of ids.

    The ranges are Spark's, as many as keep a shard at about SHARD_BYTES of text and at least as many as a shuffle has; a
    shard's number follows the order. A file carries the number of the attempt that wrote it and only a finished attempt
    reports its file, so a task that is run again or lost leaves nothing wrong behind. Returns the shards (shard, file,
    n_docs, n_tokens, n_bytes) in order with start, the ids in all shards before; this is one row a file, so the driver
    may hold it. Null texts count as empty, null ids come first, rows with one id stand by a hash of their text, so that
    they may be dealt to several shards; other columns are not read. An empty table gives no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = rows.repartitionByRange(shards_, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches):
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        writer = None
        coder = encoder(vocabulary, mode)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if not ids:
                continue
            if writer is None:
                store.create_dir(base, recursive=True)
                name = f"{base}/ids-{task.partitionId():08d}-{task.taskAttemptId()}.zst"
                out = store.open_output_stream(name, compression=None)
                writer = Writer(out, frame_bytes)
            for k in range(0, len(ids), 2048):
                part = texts.slice(k, 2048).to_pylist()
                for a, b in groups(part):
                    for doc_id, code in zip(ids[k + a : k + b], coder.encode(part[a:b]), strict=True):
                        writer.add(doc_id, code + end)
        if writer is not None:
            writer.close()
            n_bytes = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_docs": [len(writer)], "n_tokens": [writer.tokens], "n_bytes": [n_bytes]})

    shards = sorted(rows.mapInArrow(write, _SHARDS).collect())
    start, out = 0, []
    for s in shards:
        out.append((*s, start))
        start += s.n_tokens
    return spark.createDataFrame(out, T.StructType([*_SHARDS, T.StructField("start", T.LongType())]))


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """A digest of every document, read back from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, shard and the position in the shard's index."""
    n = max(1, shards.count())

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["file"]) as file:
                    reader = Reader(file)
                    total = len(reader.docs)
                    for a in range(0, total, 20_000):
                        at = range(a, min(total, a + 20_000))
                        some = reader.docs[a : a + 20_000]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([None if d["null"] else int(d["doc_id"]) for d in some], pa.int64()),
                                "start": pa.array((some["start"].astype("i8") + row["start"]), pa.int64()),
                                "n_tokens": pa.array(some["n"].astype("i8"), pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in reader.ids(at)], pa.int64()),
                                "shard": pa.array([row["shard"]] * len(some), pa.int32()),
                                "position": pa.array(at, pa.int64()),
                            }
                        )

    return shards.repartitionByRange(n, "shard").mapInArrow(read, _BACK)


def read_documents(file, doc_ids: list[int]) -> dict[int, list]:
    """The ids of some documents of one open file, by document; only their frames are decompressed."""
    reader = Reader(file)
    return {d: [x.copy() for x in reader.ids(reader.find(d))] for d in doc_ids}


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as token files of public vocabulary word_bpe_49k with end id 1, read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "token-files")
    shards = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), "drop", 1, folder)
    return read_token_files(shards, folder)
