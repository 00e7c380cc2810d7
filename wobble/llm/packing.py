"""Packing by minimum bin slack: the fullest combinations of lengths, found by subset sums over the histogram of lengths, are dealt to pieces by their ranks.

File format: Parquet, one row per sequence:

  sequence_id long   from 0
  doc_ids array<long>, piece_nos array<int>, starts array<long>, lens array<int>   the pieces in order
  ids binary         their token ids, little-endian, width bytes each
  width int          2 or 4
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch, lean, pieces
from .decontaminate import maybe_broadcast
from .tokens import coder_for

PIECES = "shard int, doc_id long, piece int, start long, length int, place long, ids binary"
FILES = "sequence_id long, doc_ids array<long>, piece_nos array<int>, starts array<long>, lens array<int>, ids binary, width int"


class Plan(NamedTuple):
    """Runs of equal pieces, sorted by (length, first): pieces of a length with ranks from first on go mult to a sequence, into sequences from `sequence` on, at offset and after."""

    length: np.ndarray
    first: np.ndarray
    mult: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """A largest remaining length and the combination of others that leaves the least slack beside it, larger lengths first.

    reach is a bitset of sums; each length comes in powers of two up to its number, and the sums before each are kept to walk back."""
    seed = max(left)
    room = capacity - seed
    mask, full = (1 << room + 1) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted(left, reverse=True):
        if length > room:
            continue
        have = min(left[length] - (length == seed), room // length)
        size = 1
        while have > 0:
            take = min(size, have)
            new = (reach | reach << take * length) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            have -= take
            size *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            out[length] = out.get(length, 0) + take
    return out


def plan_sequences(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack over numbers of pieces by length. The fullest combination is taken as often as there are pieces for it: as long as there are, it stays the fullest, as pieces only get fewer.

    Each combination uses up a length or leaves less than half of one, so combinations number at most the sum over lengths of their counts' bits, however many pieces there are."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    runs, sequence = [], 0
    while left:
        mix = fullest(left, capacity)
        times = min(left[k] // m for k, m in mix.items())
        offset = 0
        for k in sorted(mix, reverse=True):
            runs.append((k, used[k], mix[k], sequence, offset))
            offset += k * mix[k]
            used[k] += mix[k] * times
            left[k] -= mix[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    runs.sort()
    return Plan(*(np.array([r[i] for r in runs], np.int64) for i in range(5)))


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and their rank among those of that length."""
    wide = np.int64(1) << 44
    run = np.searchsorted(plan.length * wide + plan.first, length * wide + rank, side="right") - 1
    t, m = rank - plan.first[run], plan.mult[run]
    return plan.sequence[run] + t // m, plan.offset[run] + t % m * length


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in flat; ends are in items."""
    offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """PIECES of docs (doc_id, text): ids of each text and end_id, cut at capacity. shard is the task, place a piece's number among the task's pieces of that length."""
    js = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(js.value)
        shard = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in pieces(batches, "text", 4 << 20):
            ids, each = coder.encode(b.column(1))
            ids = np.insert(ids, np.cumsum(each), end_id).astype(_dtype(coder, end_id))
            each = each + 1
            of = np.repeat(np.arange(len(each)), -(-each // capacity))
            k = np.arange(len(of)) - np.searchsorted(of, of)
            n = np.minimum(each[of] - k * capacity, capacity)
            by = np.argsort(n, kind="stable")
            at = np.empty(len(n), np.int64)
            at[by] = np.arange(len(n)) - np.searchsorted(n[by], n[by])
            at += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            ends = np.cumsum(n)
            doc_ids = b.column(0).take(pa.array(of))
            for lo in range(0, len(n), 2000):
                hi = min(lo + 2000, len(n))
                begin = ends[lo] - n[lo]
                body = _binaries(ids[begin : ends[hi - 1]], ends[lo:hi] - begin)
                cols = [pa.array(np.full(hi - lo, shard, np.int32)), doc_ids.slice(lo, hi - lo), pa.array(k[lo:hi].astype(np.int32)), pa.array(k[lo:hi] * capacity), pa.array(n[lo:hi].astype(np.int32)), pa.array(at[lo:hi]), body]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "piece", "start", "length", "place", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _dtype(coder, end_id: int) -> str:
    return "<u2" if max(len(coder.last) - 1, end_id) < 1 << 16 else "<u4"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FILES from pieces sorted by sequence and offset. A sequence that a batch leaves open goes on in the next."""
    names = ["doc_id", "piece", "start", "length"]
    held: pa.Table | None = None

    def rows(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], ends]).astype(np.int32)
        col = {c: pa.concat_arrays(t.column(c).chunks) for c in t.column_names}
        lists = [pa.ListArray.from_arrays(pa.array(starts), col[c]) for c in names]
        body = col["ids"]
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
        joined = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets[starts].copy()), body.buffers()[2]])
        tokens = np.add.reduceat(col["length"].to_numpy().astype(np.int64), starts[:-1])
        width = np.diff(offsets[starts]) // tokens
        seq = col["sequence_id"].take(pa.array(starts[:-1]))
        return pa.RecordBatch.from_arrays([seq, *lists, joined, pa.array(width.astype(np.int32))], ["sequence_id", "doc_ids", "piece_nos", "starts", "lens", "ids", "width"])

    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        seq = t.column("sequence_id").to_numpy()
        ends = np.flatnonzero(np.diff(seq)) + 1
        last = int(ends[-1]) if len(ends) else 0
        if len(ends):
            yield rows(t.slice(0, last), ends)
        held = t.slice(last)
    if held is not None and len(held):
        yield rows(held, np.array([len(held)]))


def write_packed(docs: DataFrame, path: str, tokenizer_json: str, capacity: int = 2048, end_id: int = 0) -> None:
    """Writes docs (doc_id, text) as packed sequences of at most capacity tokens under path.

    A document is its ids and end_id. Only longer ones are cut, into pieces of capacity tokens and a rest; pieces are never cut to fit. Null and empty texts are end_id alone.
    Repeated rows are packed each, a null doc_id stays null. No rows give no sequences. Other columns don't matter.

    Pieces are written once with their ids. Their numbers by length, at most `capacity` of them, are all that the plan needs, so it is as large for a petabyte as for a gigabyte: it is
    made in one place and broadcast. A piece's rank among those of its length is its place in its task and the sum of earlier tasks' pieces of that length, so a length that most
    pieces have spreads over tasks like any other. One shuffle brings sequences together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(token_pieces(docs, tokenizer_json, capacity, end_id))
    by_shard = scratch.keep(cut.groupBy("shard", "length").agg(F.count("*").alias("n")))
    before = by_shard.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(plan_sequences(counts, capacity))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            sequence, offset = place(plan.value, col("length").to_numpy().astype(np.int64), col("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(offset), *(col(c) for c in ("doc_id", "piece", "start", "length", "ids"))], ["sequence_id", "offset", "doc_id", "piece", "start", "length", "ids"])

    ranked = cut.join(maybe_broadcast(before, F.lit(0)), ["shard", "length"]).select("doc_id", "piece", "start", "length", (F.col("place") + F.col("before")).alias("rank"), "ids")
    dealt = ranked.mapInArrow(deal, "sequence_id long, offset long, doc_id long, piece int, start long, length int, ids binary")
    dealt.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(lean(_sequences), FILES).write.mode("overwrite").option("compression", "zstd").parquet(path)
    scratch.only()


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, doc_ids, piece_nos, starts, lens, ids array<int>) of written sequences."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))], [*b.schema.names[:5], "ids"])

    return spark.read.schema(FILES).parquet(path).mapInArrow(back, "sequence_id long, doc_ids array<long>, piece_nos array<int>, starts array<long>, lens array<int>, ids array<int>")


def packed_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per piece of written sequences: doc_id, piece, start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), sequence_id, offset."""

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc: list[int] = []
            lens = b.column(4)
            at = np.asarray(lens.offsets) - np.asarray(lens.offsets)[0]
            n = lens.flatten().to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(n)])
            own = np.diff(at)
            offset = total[:-1] - np.repeat(total[at[:-1]], own)
            for k, (raw, w) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                body = memoryview(np.frombuffer(raw, f"<u{w}").astype("<u4").tobytes())
                crc += [zlib.crc32(body[4 * o : 4 * (o + m)]) for o, m in zip(offset[at[k] : at[k + 1]].tolist(), n[at[k] : at[k + 1]].tolist(), strict=True)]
            cols = [b.column(1).flatten(), b.column(2).flatten(), b.column(3).flatten(), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), own)), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return spark.read.schema(FILES).parquet(path).mapInArrow(digest, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
