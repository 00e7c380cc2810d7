"""Packed genotype files as a Spark data source: two bits a call, a record of fixed width a SNP, read and written by ranges of records.

Reading cuts the file into ranges of whole records, so a file of any size is read by many tasks, each of which opens it at its own place. Writing puts each record where its number
says, in one file that tasks fill in any order; a task that runs again writes the same bytes to the same places. The driver adds the header and gives the file its name once all
records are there, so nobody sees an unfinished file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from wobble.errors import ConfigError

SCHEMA = StructType([StructField("snp_idx", LongType()), StructField("g", ArrayType(DoubleType()))])
#: Bytes of a range, and calls that a task decodes at once.
RANGE_BYTES, CALLS = 32 << 20, 1 << 19


class Layout(NamedTuple):
    """Fixed values of a format: dosages of the codes 0 to 3 (NaN is missing), whether a byte's low bits come first, the least width of a record, and the header's bytes (None: as many as a record)."""

    dosages: tuple[float, float, float, float]
    low_first: bool
    least: int
    header: int | None

    def width(self, n: int) -> int:
        return max(self.least, -(-n // 4))

    def head(self, n: int) -> int:
        return self.width(n) if self.header is None else self.header

    def shifts(self) -> np.ndarray:
        return np.array([0, 2, 4, 6] if self.low_first else [6, 4, 2, 0], np.uint8)

    def decode(self, raw: np.ndarray, n: int) -> np.ndarray:
        """Dosages (records x n) of records' bytes."""
        return np.array(self.dosages)[((raw[:, :, None] >> self.shifts()) & 3).reshape(len(raw), -1)[:, :n]]

    def encode(self, g: np.ndarray) -> np.ndarray:
        """Bytes (records x width) of dosages; NaN is missing."""
        code = np.full(g.shape, 4, np.uint8)
        for c, v in enumerate(self.dosages):
            code[np.isnan(g) if v != v else g == v] = c
        if (code == 4).any():
            raise ConfigError(f"A dosage of {g[code == 4][0]} can't be packed: only 0, 1, 2 and missing can.")
        n = g.shape[1]
        calls = np.zeros((len(g), -(-n // 4) * 4), np.uint8)
        calls[:, :n] = code
        out = np.zeros((len(g), self.width(n)), np.uint8)
        out[:, : calls.shape[1] // 4] = np.bitwise_or.reduce(calls.reshape(len(g), -1, 4) << self.shifts(), axis=2)
        return out


LAYOUTS = {"bed": Layout((2.0, float("nan"), 1.0, 0.0), True, 1, 3), "packed": Layout((0.0, 1.0, 2.0, float("nan")), False, 48, None)}


def local_path(path: str) -> str | None:
    """The path in a mounted folder, or None if it is in a store."""
    if ":/" not in path:
        return os.path.abspath(path)
    u = urlparse(path)
    return unquote(u.path) if u.scheme == "file" else None


def store(path: str):
    """(file system, path) by Arrow: mounted folders, and the stores that Arrow knows."""
    from pyarrow import fs

    here = local_path(path)
    return (fs.LocalFileSystem(), here) if here is not None else fs.FileSystem.from_uri(path)


def readable(path: str) -> bool:
    """Whether Arrow can open the file; if not, only Spark can."""
    try:
        at, name = store(path)
        return at.get_file_info(name).is_file
    except (pa.ArrowException, OSError, ValueError):
        return False


@dataclass
class Records(InputPartition):
    first: int
    last: int


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout, self.n = options["path"], LAYOUTS[options["layout"]], int(options["samples"])
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", -1))

    def partitions(self) -> list[Records]:
        at, name = store(self.path)
        width, body = self.layout.width(self.n), at.get_file_info(name).size - self.layout.head(self.n)
        if body < 0 or body % width:
            raise ConfigError(f"{self.path} doesn't hold whole records of {width} bytes for {self.n} samples.")
        end = body // width if self.last < 0 else min(self.last + 1, body // width)
        step = max(1, self.range_bytes // width)
        return [Records(lo, min(lo + step, end)) for lo in range(self.first, end, step)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        at, name = store(self.path)
        width, step = self.layout.width(self.n), max(1, CALLS // max(1, self.n))
        with at.open_input_file(name) as f:
            for lo in range(partition.first, partition.last, step):
                hi = min(lo + step, partition.last)
                f.seek(self.layout.head(self.n) + lo * width)
                raw = np.frombuffer(f.read((hi - lo) * width), np.uint8).reshape(hi - lo, width)
                yield packed_batch(lo, self.layout.decode(raw, self.n))


def packed_batch(first: int, g: np.ndarray) -> pa.RecordBatch:
    values = pa.array(g.reshape(-1), mask=np.isnan(g).reshape(-1))
    ends = np.arange(len(g) + 1, dtype=np.int32) * np.int32(g.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(g))), pa.ListArray.from_arrays(pa.array(ends), values)], ["snp_idx", "g"])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: how many records, from which to which number, and the sums of their numbers and of the numbers' squares."""

    n: int
    least: int
    most: int
    total: int
    squares: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.layout, self.n = LAYOUTS[options["layout"]], int(options["samples"])
        self.header, self.records = bytes.fromhex(options["header"]), int(options["snps"])
        path = local_path(options["path"])
        if path is None:
            raise ConfigError(f"{options['path']}: packed files are written in place, so only to a mounted folder.")
        if len(self.header) != self.layout.head(self.n):
            raise ConfigError(f"A header of {self.layout.head(self.n)} bytes is needed, not of {len(self.header)}.")
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        width, head = self.layout.width(self.n), self.layout.head(self.n)
        n = total = squares = 0
        least, most = self.records, -1
        os.makedirs(os.path.dirname(self.part), exist_ok=True)
        fd = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for b in batches:
                number, calls = b.column(0).to_numpy(), b.column(1)
                step = max(1, CALLS // max(1, self.n))
                for lo in range(0, len(b), step):
                    at = number[lo : lo + step]
                    if (at < 0).any() or (at >= self.records).any():
                        raise ConfigError(f"A SNP's number isn't from 0 to {self.records - 1}.")
                    values = calls.slice(lo, len(at)).flatten()
                    if len(values) != len(at) * self.n:
                        raise ConfigError(f"A SNP doesn't have {self.n} calls.")
                    raw = self.layout.encode(values.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), self.n))
                    cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]  # neighbours are written together
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        os.pwrite(fd, raw[i:j].tobytes(), head + int(at[i]) * width)
                    n, least, most = n + len(at), min(least, int(at.min())), max(most, int(at.max()))
                    total, squares = total + sum(at.tolist()), squares + sum(v * v for v in at.tolist())
            os.fsync(fd)
        finally:
            os.close(fd)
        return Written(n, least, most, total, squares)

    def commit(self, messages: list[Written | None]) -> None:
        m, found = self.records, [x for x in messages if x is not None]
        # as many records as there are numbers, whose sums are those of all numbers
        whole = (m, m * (m - 1) // 2, (m - 1) * m * (2 * m - 1) // 6)
        if (sum(x.n for x in found), sum(x.total for x in found), sum(x.squares for x in found)) != whole:
            self.abort(messages)
            raise ConfigError(f"{self.path}: the SNPs aren't numbered from 0 to {m - 1}, each once.")
        os.makedirs(os.path.dirname(self.part), exist_ok=True)
        fd = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            os.pwrite(fd, self.header, 0)
            os.fsync(fd)
        finally:
            os.close(fd)
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class PackedGenotypes(DataSource):
    """Options: path; layout, bed or packed; samples. For reading, first and last record, range_bytes. For writing, header (hexadecimal) and snps, the number of records."""

    @classmethod
    def name(cls) -> str:
        return "packed_genotypes"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(dict(self.options))


def read_packed(spark: SparkSession, path: str, layout: str, n: int, first: int = 0, last: int = -1) -> DataFrame:
    """Packed features of a file, or of its records first to last. A file that only Spark can open is read as one value, so it is 2 GB at most."""
    if not readable(path):
        return _whole_file(spark, path, LAYOUTS[layout], n).where(f"snp_idx >= {first} and ({last} < 0 or snp_idx <= {last})")
    spark.dataSource.register(PackedGenotypes)
    return spark.read.format("packed_genotypes").options(layout=layout, samples=n, first=first, last=last).load(path)


def _whole_file(spark: SparkSession, path: str, layout: Layout, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CALLS // max(1, n))
        for b in batches:
            for content in b.column(0):
                raw = np.frombuffer(content.as_buffer(), np.uint8)[layout.head(n) :].reshape(-1, layout.width(n))
                for lo in range(0, len(raw), step):
                    yield packed_batch(lo, layout.decode(raw[lo : lo + step], n))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str, layout: str, n: int, snps: int, header: bytes) -> None:
    """Packed features, numbered from 0 to snps - 1, as one file."""
    packed.sparkSession.dataSource.register(PackedGenotypes)
    rows = packed.select("snp_idx", packed["g"].cast("array<double>").alias("g")).repartitionByRange("snp_idx").sortWithinPartitions("snp_idx")
    rows.write.format("packed_genotypes").options(layout=layout, samples=n, snps=snps, header=header.hex()).mode("overwrite").save(path)
