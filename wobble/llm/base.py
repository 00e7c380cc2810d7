"""What the training-data operators share: tables, scratch space in the shared folder, words and Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # pa.compute is an attribute only once imported
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts: space, and tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table; all of them if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A folder of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Name a folder that the driver and all executors share in spark.checkpoint.dir.")
        found = "file://" + tempfile.mkdtemp(prefix="wobble-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, so that a batch of texts takes some 10 MB; a session that names a number of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "4000")


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive executors. free() and only() delete tables that nothing reads any more; what a result still reads stays.

    Spark deletes the files of a finished shuffle once the driver's garbage collector has found that nothing refers to it, so keep() asks for a collection, every SWEEP seconds at most.
    """

    SWEEP = 2.0

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: dict[str, DataFrame] = {}
        self.swept = time.monotonic()

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self.tables[path] = self.spark.read.schema(df.schema).parquet(path)
        if time.monotonic() - self.swept > self.SWEEP:
            self.spark.sparkContext._jvm.System.gc()
            self.swept = time.monotonic()
        return self.tables[path]

    def free(self, *frames: DataFrame) -> None:
        for path in [p for p, df in self.tables.items() if any(df is f for f in frames)]:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            del self.tables[path]

    def only(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        self.free(*[df for df in self.tables.values() if not any(df is f for f in frames)])


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most so many bytes (a single longer text stands alone), so that memory doesn't follow the longest texts times the batch size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system, as far as this one lets us."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable) -> Callable:
    """run, a function of Arrow batches, after which an idle Python worker doesn't hold on to what its task has freed."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
