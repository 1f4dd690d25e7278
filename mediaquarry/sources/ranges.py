"""Byte ranges of files: planned as rows, then read in tasks; and files written from rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Bytes of one read, and of a gap between two samples that is read rather than skipped.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
BATCH_BYTES = 8 << 20


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows (a path or a URI), for reads at any place."""
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


class Windowed:
    """Reads of a file that go forward, by windows of a size; a miss moves the window to where it begins."""

    def __init__(self, file: pa.NativeFile, window: int):
        self.file, self.window, self.size = file, window, file.size()
        self.at, self.data = 0, b""

    def bytes(self, at: int, length: int) -> bytes:
        if not (self.at <= at and at + length <= self.at + len(self.data)):
            if at < 0 or at + length > self.size:
                raise ValueError(f"the file ends before byte {at + length}")
            self.at, self.data = at, self.file.read_at(min(max(length, self.window), self.size - at), at)
        return self.data[at - self.at : at - self.at + length]


def planned(samples: DataFrame, most: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """Reads (path, start, length, samples: array of the samples' columns) that hold all samples (path, at, size, ...) with some bytes.

    Samples that are at most gap bytes apart go into one read, and reads are cut where they would be over the size, between
    samples: samples that don't overlap are read once each. A file's samples are one group of the plan, its bytes aren't.
    """
    by_place = W.partitionBy("path").orderBy("at", "size")
    past = F.max(F.col("at") + F.col("size")).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    rows = samples.where((F.col("size") > 0) & (F.col("at") >= 0))
    rows = rows.withColumn("_new", F.when(F.col("at") - past <= gap, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_read", F.floor((F.col("at") - F.min("at").over(W.partitionBy("path", "_island"))) / most))
    each = F.array_sort(F.collect_list(F.struct("at", "size", *(c for c in samples.columns if c not in ("path", "at", "size")))))
    reads = rows.groupBy("path", "_island", "_read").agg(F.min("at").alias("start"), (F.max(F.col("at") + F.col("size")) - F.min("at")).alias("length"), each.alias("samples"))
    return reads.drop("_island", "_read")


def read(requests: DataFrame) -> DataFrame:
    """requests (path, start, length, ...) with their bytes; a range that the file doesn't have is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            names = batch.schema.names
            held, size, first = [], 0, 0
            for i, (name, start, length) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("path", "start", "length")), strict=True)):
                if name != path:
                    if file:
                        file.close()
                    path, file = name, opened(name)
                inside = 0 <= start and length >= 0 and start + length <= file.size()
                held.append(file.read_at(length, start) if inside else None)
                size += length if inside else 0
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "bytes"])
                    held, size, first = [], 0, i + 1
        if file:
            file.close()

    ordered = requests.repartition("path", F.floor(F.col("start") / (64 << 20))).sortWithinPartitions("path", "start")
    return ordered.mapInArrow(run, T.StructType([*ordered.schema, T.StructField("bytes", T.BinaryType())]))


def sample_bytes(samples: DataFrame, most: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """samples (path, at, size, ...) with data: their bytes, by planned reads. Samples without bytes or beyond the file's end aren't there."""
    found = read(planned(samples, most, gap)).where(F.col("bytes").isNotNull()).select("path", "start", "bytes", F.explode("samples").alias("s"))
    data = F.expr("substring(bytes, CAST(s.at - start + 1 AS INT), CAST(s.size AS INT))")
    return found.select("path", "s.*", data.alias("data"))


def written(files: DataFrame, folder: str) -> DataFrame:
    """Files (name, content) in a folder of any store: their path and size. A task that is run again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        for batch in batches:
            done = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with where.open_output_stream(f"{top}/{name}") as out:
                    out.write(content.as_buffer())
                done.append((f"{folder}/{name}", len(content.as_buffer())))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "size"])

    return files.select("name", "content").mapInArrow(run, "path string, size long")
