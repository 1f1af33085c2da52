"""Readers and writers of matrix, tensor and factor files."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import ind2sub, split_start, sub2ind
from tessella.operators.matrix import cols, numbered, rank

#: Doubles that a task reads or writes at a time.
BLOCK = 1 << 20


def _store(path: str):
    """A file system and a path in it, from a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _within(df: DataFrame, rows: tuple[int, int] | None, columns: tuple[int, int] | None) -> DataFrame:
    """Cells of a range of rows and of columns (from, to), counted from its start."""
    for c, r in (("i", rows), ("j", columns)):
        if r is not None:
            df = df.where((F.col(c) >= r[0]) & (F.col(c) < r[1])).withColumn(c, F.col(c) - r[0])
    return df


def _cells(value, base: int = 0) -> list:
    parts = F.split(F.trim(value), r"\s+")
    return [(parts[0].cast("long") - base).alias("i"), (parts[1].cast("long") - base).alias("j"), F.coalesce(F.try_element_at(parts, F.lit(3)).cast("double"), F.lit(1.0)).alias("v")]


def read_coordinates(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Text lines `i j v`, counted from zero; of a range of rows and columns if one is given."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _within(lines.select(*_cells(F.col("value"))), rows, columns)


def read_mtx(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Matrix Market coordinates, counted from one: comments go, and the size line, which is the first that is none and so
    stands in the file's first part."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def without_size(batches):
        seen = set()
        for batch in batches:
            keep = []
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = bool(value.strip()) and not value.startswith("%")
                keep.append(data and (start > 0 or file in seen))
                if data:
                    seen.add(file)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"]).filter(pa.array(keep, pa.bool_()))

    return _within(lines.mapInArrow(without_size, "value string").select(*_cells(F.col("value"), 1)), rows, columns)


def read_dense_text(spark: SparkSession, path: str) -> DataFrame:
    """One matrix row a line; lines are numbered in the order of files, parts of files and lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = numbered(lines, F.col("_file"), F.col("_block"), F.col("_line"))
    cells = rows.select(F.col("_n").cast("long").alias("i"), F.posexplode(F.split(F.trim("value"), r"[\s,]+")).alias("j", "x"))
    return cells.select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("v")).where("v != 0")


def _numbers(pattern: str) -> tuple:
    at = lambda k: F.regexp_extract(F.col("_metadata.file_path"), pattern, k).cast("long")
    return at(1), at(2) if pattern.count("(") > 1 else None


def read_blocks(spark: SparkSession, pattern: str, m: int, n: int, pr: int, pc: int) -> DataFrame:
    """Files `<name><r>_<c>` with local indices; offsets follow the uneven split of m and n over the grid."""
    r, c = _numbers(r"(\d+)_(\d+)$")
    lines = spark.read.text(pattern).select("value", r.alias("r"), c.alias("c")).where(F.trim("value") != "").select("r", "c", *_cells(F.col("value")))
    start = lambda size, parts, x: split_start(F.lit(size), F.lit(parts), F.col(x))
    return lines.select((F.col("i") + start(m, pr, "r")).cast("long").alias("i"), (F.col("j") + start(n, pc, "c")).cast("long").alias("j"), "v")


def read_split(spark: SparkSession, pattern: str, axis: str, size: int, parts: int) -> DataFrame:
    """Files `<name><part>`, each with a range of rows (axis i) or columns (axis j) counted from its start."""
    part, _ = _numbers(r"(\d+)$")
    lines = spark.read.text(pattern).select("value", part.alias("p")).where(F.trim("value") != "").select("p", *_cells(F.col("value")))
    return lines.withColumn(axis, (F.col(axis) + split_start(F.lit(size), F.lit(parts), F.col("p"))).cast("long")).select("i", "j", "v")


def _files(path: str) -> list[tuple[str, int, int]]:
    """(file, first byte in the whole, bytes) of a file, or of the parts of a folder in the order of their names."""
    from pyarrow import fs

    store, base = _store(path)
    info = store.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
    out, at = [], 0
    for f in found:
        out.append((f.path, at, f.size))
        at += f.size
    return out


def _numbers_of(spark: SparkSession, path: str, dtype: str = "<f8", skip: int = 0, first: int = 0, last: int | None = None) -> DataFrame:
    """(id, v) of the numbers of a binary file, or a folder of its parts, that are not zero: tasks read stretches of BLOCK
    numbers. first and last bound the ids."""
    width, files = np.dtype(dtype).itemsize, _files(path)
    total = (sum(f[2] for f in files) - skip) // width
    last = total if last is None else min(last, total)
    blocks = max(0, math.ceil((last - first) / BLOCK))

    def run(batches):
        store, _ = _store(path)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                a, z = first + b * BLOCK, min(last, first + (b + 1) * BLOCK)
                raw = b""
                for name, start, size in files:
                    lo, hi = max(start, skip + a * width), min(start + size, skip + z * width)
                    if lo < hi:
                        with store.open_input_file(name) as f:
                            raw += f.read_at(hi - lo, lo - start)
                x = np.frombuffer(raw, dtype).astype(float)
                some = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(some + a), pa.array(x[some])], names=["id", "v"])

    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, "id long, v double")


def read_dense_binary(spark: SparkSession, path: str, m: int) -> DataFrame:
    """Little-endian doubles, column by column."""
    return _numbers_of(spark, path).select((F.col("id") % m).alias("i"), F.floor(F.col("id") / m).cast("long").alias("j"), "v")


def read_tensor(spark: SparkSession, path: str, window: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """`path`.bin (a file, or a folder of its parts) with doubles, first index fastest, and `path`.info with the number of
    modes and a size a line. window has (from, to) for each mode: only that part is returned, counted from its start, and
    of the last mode only that part is read."""
    dims = [int(x.value) for x in spark.read.text(f"{path}.info").where(F.trim("value") != "").collect()][1:]
    step = math.prod(dims[:-1])
    bounds = (window[-1][0] * step, window[-1][1] * step) if window else (0, None)
    t = _numbers_of(spark, f"{path}.bin", first=bounds[0], last=bounds[1])
    t = t.select(*(c.cast("long").alias(f"i{m}") for m, c in enumerate(ind2sub(F.col("id"), dims))), "v")
    for m, (a, z) in enumerate(window or []):
        t = t.where((F.col(f"i{m}") >= a) & (F.col(f"i{m}") < z)).withColumn(f"i{m}", F.col(f"i{m}") - a)
    return t


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """A .npy file of any order, by stretches: (i, j, v) of a matrix, (i0 .., v) of anything else. The header is read on the
    driver; order and type are its own."""
    store, base = _store(path)
    with store.open_input_file(base) as f:
        head = io.BytesIO(f.read_at(min(4096, f.size()), 0))
    version = np.lib.format.read_magic(head)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    cells = _numbers_of(spark, path, dtype.str, skip=head.tell())
    subs = ind2sub(F.col("id"), list(shape)) if by_column else ind2sub(F.col("id"), list(shape)[::-1])[::-1]
    names = ["i", "j"] if len(shape) == 2 else [f"i{m}" for m in range(len(shape))]
    return cells.select(*(c.cast("long").alias(x) for c, x in zip(subs, names, strict=True)), "v")


def write_coordinates(a: DataFrame, path: str) -> None:
    a.select(F.concat_ws(" ", "i", "j", "v")).write.text(path)


def write_factor_text(factor: DataFrame, path: str) -> None:
    """A row a line in the order of idx; parts are ranges of idx."""
    line = F.array_join(F.transform(F.array(*cols(rank(factor))), lambda x: x.cast("string")), " ").alias("value")
    factor.repartitionByRange("idx").sortWithinPartitions("idx").select(line).write.text(path)


def _streamed(df: DataFrame) -> Iterator[float]:
    return (r[0] for r in df.toLocalIterator(prefetchPartitions=True))


def write_factor_binary(factor: DataFrame, path: str) -> None:
    """Doubles column by column in one file, streamed through the driver a partition at a time."""
    store, base = _store(path)
    rows = factor.repartitionByRange("idx").sortWithinPartitions("idx").persist()
    try:
        with store.open_output_stream(base, compression=None) as f:
            for c in cols(rank(factor)):
                part: list[float] = []
                for x in _streamed(rows.select(c)):
                    part.append(x)
                    if len(part) == BLOCK:
                        f.write(np.array(part, "<f8").tobytes())
                        part.clear()
                f.write(np.array(part, "<f8").tobytes())
    finally:
        rows.unpersist()


def factor_binary_to_text(spark: SparkSession, path: str, rows: int, out: str) -> None:
    """A binary factor as lines of text, a row each."""
    cells = read_dense_binary(spark, path, rows)
    k = sum(f[2] for f in _files(path)) // (8 * rows)
    wide = spark.range(rows).select(F.col("id").alias("idx")).join(cells.withColumnRenamed("i", "idx"), "idx", "left").groupBy("idx").agg(*(F.coalesce(F.max(F.when(F.col("j") == r, F.col("v"))), F.lit(0.0)).alias(f"f{r}") for r in range(k)))
    write_factor_text(wide, out)


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.partitionBy("bi", "bj").parquet(path)


def write_blocks_text(blocks: DataFrame, path: str) -> None:
    """Lines `i j v` of each block in a folder of its own."""
    blocks.select("bi", "bj", F.concat_ws(" ", "i", "j", "v").alias("value")).write.partitionBy("bi", "bj").text(path)


def write_tensor(t: DataFrame, path: str, dims: Sequence[int]) -> None:
    """The pair `path`.bin, a folder of parts of BLOCK doubles written by tasks, and `path`.info.

    A part is named by its place, so a task that is run again writes the same file; merge_parts() makes one file of them.
    """
    total, dims = math.prod(dims), list(dims)
    cells = t.select(sub2ind([F.col(f"i{m}") for m in range(len(dims))], dims).alias("id"), F.col("v").cast("double").alias("v"))
    every = t.sparkSession.range(0, total, BLOCK).select("id", F.lit(0.0).alias("v"))  # a cell of each part, so that none is missing
    parts = cells.unionByName(every).withColumn("part", F.floor(F.col("id") / BLOCK)).repartition("part").sortWithinPartitions("part")

    def run(batches):
        store, base = _store(f"{path}.bin")
        store.create_dir(base, recursive=True)

        def save(part, x):
            with store.open_output_stream(f"{base}/part-{part:08d}", compression=None) as f:
                f.write(x[: total - part * BLOCK].tobytes())

        now, x = None, None
        for batch in batches:
            ids, values, of = (c.to_numpy() for c in batch.columns)
            for part in np.unique(of).tolist():
                if part != now:
                    if now is not None:
                        save(now, x)
                    now, x = part, np.zeros(BLOCK, "<f8")
                some = of == part
                np.add.at(x, ids[some] - part * BLOCK, values[some])
        if now is not None:
            save(now, x)
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    parts.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    store, base = _store(f"{path}.info")
    with store.open_output_stream(base, compression=None) as f:
        f.write(("\n".join(map(str, [len(dims), *dims])) + "\n").encode())


def merge_parts(path: str, out: str) -> None:
    """The parts of a folder in one file, a part at a time."""
    store, _ = _store(path)
    with store.open_output_stream(_store(out)[1], compression=None) as f:
        for name, _, size in _files(path):
            with store.open_input_file(name) as part:
                f.write(part.read_at(size, 0))


def npy_to_tensor(spark: SparkSession, path: str, out: str) -> None:
    """A .npy file as the pair .bin and .info."""
    t = read_npy(spark, path)
    names = [c for c in t.columns if c != "v"]
    store, base = _store(path)
    with store.open_input_file(base) as f:
        head = io.BytesIO(f.read_at(min(4096, f.size()), 0))
    version = np.lib.format.read_magic(head)
    shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)[0]
    write_tensor(t.select(*(F.col(c).alias(f"i{m}") for m, c in enumerate(names)), "v"), out, shape)


def matrix_source(spark: SparkSession, name: str, m: int = 0, n: int = 0, dump: str | None = None, **more) -> DataFrame:
    """rand_uniform, rand_normal or rand_lowrank are generated, and written as coordinates to `dump` if it is given; any other
    name is a file, read by its suffix: .mtx, .npy, .bin, .dense for text with a row a line, else coordinates."""
    from tessella.sources.generate import random_matrix

    if name.startswith("rand_"):
        a = random_matrix(spark, name[5:], m, n, **more)
        if dump:
            write_coordinates(a, dump)
        return a
    if name.endswith(".mtx"):
        return read_mtx(spark, name, **more)
    if name.endswith(".npy"):
        return read_npy(spark, name)
    if name.endswith(".dense"):
        return read_dense_text(spark, name)
    return read_dense_binary(spark, name, m) if name.endswith(".bin") else read_coordinates(spark, name, **more)
