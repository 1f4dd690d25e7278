"""What the operators of this subpackage share: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of one Arrow batch that are Python objects at the same time.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on one machine where that is unset, one of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="mediaquarry-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows of df in the shared folder: later jobs neither recompute them nor lose them with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later job reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Runs:
    """Many short runs of ids in one array, known by number."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Runs of the given lengths whose ids follow one another; the number of the first."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)])
        if self.count + len(lengths) > len(self.starts):
            room = np.empty(self.count + 2 * len(lengths), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts[: self.count], room]), np.concatenate([self.lengths[: self.count], room])
        first, upto = self.count, self.count + len(lengths)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first:upto] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:upto] = lengths
        self.used, self.count = self.used + len(ids), upto
        return first

    def forget(self, first: int) -> None:
        """Runs from first on, the last that were added."""
        if first < self.count:
            self.used, self.count = int(self.starts[first]), first

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after another, and how many each has."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def by_size(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in a column have at most so many bytes together, or one row."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, upto - at)
        at, before = upto, int(sizes[upto - 1])


def by_rows(make: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one on columns of at most ROWS_AT_ONCE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = make(batch.slice(at, ROWS_AT_ONCE).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def rewritten(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """docs with change(text) for each text that isn't null; n_chars, if there, follows; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [None if x is None else change(x) for x in batch.column("text").to_pylist()]
                new = {"text": texts, "n_chars": [None if x is None else len(x) for x in texts]}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(rows, cuts) on whole groups of equal keys (not null), many at a time: group i is rows cuts[i] to cuts[i + 1].

    A task reads its groups in order and holds those of one Arrow batch and the one that goes on into the next, so groups must
    be of bounded size, which callers see to by cutting them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            cuts = changes(table)
            whole = int(cuts[-1])
            held = table.slice(whole).to_batches()
            if whole:
                yield from work(table.slice(0, whole).combine_chunks(), cuts)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, np.append(changes(table), table.num_rows))

    def changes(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            column = table.column(k)
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)))
        return np.flatnonzero(new)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and where each row's begin and end."""
    chunks = table.column(name).combine_chunks()
    column = pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with number: the place of a row, from 0, among the rows of its group by order; by ranges, so that no group meets in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    kept, _ = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    # At most a row for each part and one more for each group.
    counts = kept.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"))
    placed = kept.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("number", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_p", "_g", "_offset")
