"""Exact removal of repeated byte strings, by suffix buckets.

Every window of `length` bytes has an anchor: the least of its `gram`-byte strings by hash, the leftmost of equal ones.
Equal windows have equal anchors at equal places, so a bucket of suffixes per anchor string holds all windows that can be
equal. A bucket of one occurrence has no repeats. In others, the windows that one anchor is the anchor of make a context, and contexts of equal bytes
a class. A class of two or more is repeated throughout; where a bucket has a class of one, one context of each class is sorted, bucket by bucket, as suffixes of a small block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean, pieces
from .near import groups
from .neardup import NULL_ID
from .setsketch import mix
from .suffixes import Block, repeated

LENGTH, GRAM = 400, 100
#: A bucket of more classes than the first number is cut by what its windows share besides the anchor, into so many slices of the places a window can begin at.
#: Windows of the last kind of slice begin at one place and share all bytes.
HOT = ((128, 3), (1024, 30), (16384, LENGTH - GRAM + 1))
#: Bytes of text that a scan looks at together.
SCAN = 1 << 20


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def anchors(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows within strings text[begin:end]: their places, hashes, and the first and last window start of each."""
    n = len(text)
    none = np.zeros(0, np.int64)
    starts_ok = end - begin >= length
    if n < length or not starts_ok.any():
        return none, none, none, none
    up, down = _powers(1 << max(20, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(text.astype(np.uint64) * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least, done, width = key, 1, length - gram + 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the anchor of the window that begins here
    valid = np.zeros(n + 1, np.int8)
    valid[begin[starts_ok]] += 1
    valid[end[starts_ok] - length + 1] -= 1
    s = np.flatnonzero(np.cumsum(valid[:-1])[: len(place)] > 0)
    p = place[s]
    first = np.ones(len(s), bool)
    first[1:] = p[1:] != p[:-1]
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(s)) - 1
    return p[lo], h[p[lo]].astype(np.int64), s[lo], s[hi]


def context_hash(view: memoryview, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(view, seed=seed)


def sliced_anchors(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors(), SCAN bytes of window starts at a time: memory doesn't follow the longest text."""
    if len(text) <= 2 * SCAN:
        return anchors(text, begin, end, length, gram)
    found = []
    for at in range(0, len(text), SCAN):
        stop = min(len(text), at + SCAN + length - 1)
        some = (begin < stop) & (end > at)
        p, h, lo, hi = anchors(text[at:stop], np.maximum(begin[some], at) - at, np.minimum(end[some], stop) - at, length, gram)
        found.append((p + at, h, lo + at, hi + at))
    p, h, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (lo[1:] != hi[:-1] + 1)
    return p[new], h[new], lo[new], hi[np.append(np.flatnonzero(new)[1:], len(p)) - 1] if len(p) else hi


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array<struct<start,end>> of bytes removed).

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same or another document.
    Null counts as empty; texts shorter than length lose nothing; equal texts of that length or more lose everything. Rows of equal id and text count as copies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("dk"), text.alias("text"))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SCAN):
            col = b.column(2).cast(pa.binary())
            flat = pa.concat_arrays([col])
            ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
            raw = flat.buffers()[2]
            buf = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.zeros(0, np.uint8)
            ends = ends - ends[0]
            p, g, lo, hi = sliced_anchors(buf, ends[:-1], ends[1:], length, gram)
            doc = np.searchsorted(ends[1:], p, "right")
            view = memoryview(np.ascontiguousarray(buf))
            c = np.fromiter((context_hash(view[x : y + length], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (p - lo).tolist(), strict=True)), np.uint64, len(p)).astype(np.int64)
            base = ends[:-1][doc]
            p, lo, hi = p - base, lo - base, hi - base
            # a context that one text holds several times is repeated wherever it stands; the text tells of it once
            order = np.lexsort((c, g, doc))
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])
            for k in np.flatnonzero(~new).tolist():
                x, y = order[k - 1], order[k]
                new[k] = p[x] - lo[x] != p[y] - lo[y] or bytes(view[base[x] + lo[x] : base[x] + hi[x] + length]) != bytes(view[base[y] + lo[y] : base[y] + hi[y] + length])
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            own = np.sort(order[np.repeat(times > 1, times)])
            joins = np.zeros(len(own), bool)
            joins[1:] = (doc[own][1:] == doc[own][:-1]) & (lo[own][1:] == hi[own][:-1] + 1)
            heads = np.flatnonzero(~joins)
            sure_doc, sure_lo, sure_hi = doc[own[heads]], lo[own[heads]], hi[own[np.append(heads[1:], len(own)) - 1]] if len(own) else lo[:0]
            one_of = order[new]
            at = np.argsort(one_of)
            one_of, times = one_of[at], times[at]

            small = [x.astype(np.int32) for x in (p[one_of], lo[one_of], hi[one_of], times, sure_lo, sure_hi)]
            of_doc = pa.array(np.searchsorted(doc[one_of], np.arange(len(b) + 1)).astype(np.int32))
            of_sure = pa.array(np.searchsorted(sure_doc, np.arange(len(b) + 1)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(of_doc, pa.array(v)) for v in (small[0], g[one_of], c[one_of], *small[1:4])] + [pa.ListArray.from_arrays(of_sure, pa.array(v)) for v in small[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *listed], ["doc_id", "dk", "p", "g", "c", "lo", "hi", "times", "sure_lo", "sure_hi"])

    found = rows.where(F.octet_length("text") >= length).mapInArrow(scan, "doc_id long, dk binary, p array<int>, g array<long>, c array<long>, lo array<int>, hi array<int>, times array<int>, sure_lo array<int>, sure_hi array<int>")
    arrays = ("p", "g", "c", "lo", "hi", "times", "sure_lo", "sure_hi")
    one = found.groupBy("dk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(x).alias(x) for x in arrays])
    one = scratch.keep(one.withColumn("id", F.monotonically_increasing_id()))  # written, and so fixed
    each = one.select("id", "copies", F.explode(F.arrays_zip("p", "g", "c", "lo", "hi", "times")).alias("a")).select("id", (F.col("copies") * F.col("a.times")).alias("copies"), "a.p", "a.g", "a.c", "a.lo", "a.hi")
    shared = each.groupBy("g").agg(F.sum("copies").alias("k")).where("k > 1").select("g")
    again = scratch.keep(each.join(shared, "g"))
    # documents with a shared anchor, and their texts once
    inside = one.where(F.size("sure_lo") > 0).select("id", F.explode(F.arrays_zip("sure_lo", "sure_hi")).alias("z")).select("id", F.col("z.sure_lo").alias("lo"), F.col("z.sure_hi").alias("hi"))
    where = again.select("id").distinct().join(one.select("id", "dk", "doc_id"), "id")
    work = scratch.keep(where.join(rows, ["dk", "doc_id"]).select("id", "dk", "text"))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of contexts."""
        for b in pieces(batches, "text", 1 << 20):
            for k in range(len(b)):
                raw = np.frombuffer(b.column(2)[k].as_buffer(), np.uint8)
                items = b.column(1)[k].values
                for at in range(0, len(items), 4096):
                    some = items.slice(at, 4096).flatten()  # g, c, p, lo, hi, copies
                    lo, hi = some[3].to_numpy().astype(np.int64), some[4].to_numpy().astype(np.int64)
                    size = hi + length - lo
                    ends = np.concatenate([[0], np.cumsum(size)])
                    flat = raw[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])]
                    held = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                    before = pa.array(some[2].to_numpy() - some[3].to_numpy(), pa.int32())
                    yield pa.RecordBatch.from_arrays([some[0], some[1], before, pa.array(np.full(len(lo), b.column(0)[k].as_py())), some[3], some[4], some[5], held], ["g", "c", "before", "id", "lo", "hi", "copies", "bytes"])

    one_text = work.select("id", F.col("text").cast("binary").alias("text")).dropDuplicates(["id"])

    def with_bytes(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("id").agg(F.collect_list(F.struct("g", "c", "p", "lo", "hi", "copies")).alias("a")).join(one_text, "id").select("id", "a", "text")
        return parts.mapInArrow(cut, "g long, c long, before int, id long, lo int, hi int, copies long, bytes binary")

    # classes; where one has a single context, id, lo and hi are that one's
    classes = with_bytes(again).groupBy("g", "c", "before", "bytes").agg(F.sum("copies").alias("k"), F.min("id").alias("id"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    classes = scratch.keep(classes)
    # (g, c) of two classes, by chance: their contexts are told apart by bytes once more
    clash = classes.groupBy("g", "c").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g", "c")
    more = classes.where("k > 1")
    twice = again.join(more.join(clash, ["g", "c"], "left_anti").select("g", "c"), ["g", "c"]).select("id", "lo", "hi")
    twice = twice.union(with_bytes(again.join(clash, ["g", "c"])).join(more.select("g", "c", "before", "bytes"), ["g", "c", "before", "bytes"]).select("id", "lo", "hi"))
    # buckets in which some context occurs once
    open_buckets = classes.groupBy("g").agg(F.count("*").alias("classes"), F.min("k").alias("least")).where("least = 1 and classes > 1")
    slices = F.lit(0)
    for most, number in HOT:
        slices = F.when(F.col("classes") > most, min(number, length - gram + 1)).otherwise(slices)
    to_sort = classes.join(open_buckets, "g").select("g", "id", (F.col("k") == 1).alias("single"), "before", "lo", "hi", "bytes", slices.alias("slices"))
    kinds = "k1 long, k2 long, id long, single boolean, before int, start int, last int, bytes binary"
    whole = to_sort.where("slices = 0").select(F.col("g").alias("k1"), F.lit(0).cast("long").alias("k2"), "id", "single", "before", F.col("lo").alias("start"), F.col("hi").alias("last"), "bytes")

    @lean
    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of contexts of hot buckets, by the bytes that all windows of the slice share."""
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        names = ["k1", "k2", "id", "single", "before", "start", "last", "bytes", "alone"]
        out: list[list] = [[] for _ in names]
        for b in pieces(batches, "bytes", 1 << 20):
            for r in b.to_pylist():
                # windows begin before - x bytes before the anchor; slices of that
                view, p, last = memoryview(r["bytes"]), r["before"], r["hi"] - r["lo"]
                width = -(-(length - gram + 1) // r["slices"])
                for k in range((p - last) // width, p // width + 1):
                    x, y = max(0, p - (k + 1) * width + 1), min(last, p - k * width)
                    key = xxhash.xxh3_128_intdigest(view[max(0, p - k * width) : p - (k + 1) * width + 1 + length], seed=k)
                    for column, v in zip(out, ((key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63), r["id"], r["single"], p - x, r["lo"] + x, r["lo"] + y, view[x : y + length].tobytes(), width == 1), strict=True):
                        column.append(v)
                    if len(out[0]) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)
                        out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    sliced = scratch.keep(to_sort.where("slices > 0").select("id", "single", "before", "lo", "hi", "bytes", "slices").mapInArrow(slice_up, kinds + ", alone boolean"))
    # where every slice has room for one window only, nothing is left to sort
    lone = sliced.where("alone")
    common = lone.groupBy("k1", "k2", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2", "bytes")
    lone_runs = lone.where("single").join(common, ["k1", "k2", "bytes"]).select("id", F.col("start").alias("lo"), F.col("last").alias("hi"))
    pieces_of = whole.union(sliced.where("not alone").drop("alone")).repartition("k1", "k2").sortWithinPartitions("k1", "k2")

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of repeated windows of contexts that occur once."""
        for t, at in groups(batches, ["k1", "k2"], 1024):
            size = np.diff(at)
            bucket_of = np.repeat(np.arange(len(size)), size)
            rows_in = np.flatnonzero(size[bucket_of] > 1)
            if not len(rows_in):
                continue
            t = t.take(pa.array(rows_in))
            bucket_of = bucket_of[rows_in]
            raw = t.column("bytes").combine_chunks()
            sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
            start, last, before = (t.column(x).to_numpy().astype(np.int64) for x in ("start", "last", "before"))
            # a string for each context, moved so that anchors of a bucket are at one residue
            pad = (-before) % 32
            room = pad + sizes
            room += -room % 32
            place = np.cumsum(room) - room + pad
            text = np.zeros(int(room.sum()), np.uint8)
            flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            begin = np.cumsum(sizes) - sizes
            text[np.repeat(place - begin, sizes) + np.arange(len(flat))] = flat
            # strings are told apart by their ends; what lies between is never read
            bounds = np.stack([place, place + sizes], 1).reshape(-1)
            ends = np.append(bounds, len(text)) if bounds[-1] < len(text) else bounds
            wins = last - start + 1
            owner = np.repeat(np.arange(len(wins)), wins)
            off = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
            hit = repeated(Block(text, ends), place[owner] + off, bucket_of[owner], length) & t.column("single").to_numpy()[owner]
            if not hit.any():
                continue
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            edge[1:-1][np.flatnonzero(owner[1:] != owner[:-1])] = 0
            # runs end where a context ends
            hits = np.flatnonzero(hit)
            new = np.ones(len(hits), bool)
            new[1:] = (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]])
            a = hits[new]
            z = hits[np.append(np.flatnonzero(new)[1:], len(hits)) - 1]
            ids = t.column("id").to_numpy()[owner[a]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((start[owner[a]] + off[a]).astype(np.int32)), pa.array((start[owner[z]] + off[z]).astype(np.int32))], ["id", "lo", "hi"])

    sorted_runs = pieces_of.mapInArrow(sort, "id long, lo int, hi int")
    runs = sorted_runs.union(lone_runs).union(twice).union(inside).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    @lean
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            out = []
            for dk, runs_, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2).cast(pa.binary()), strict=True):
                lo = runs_.values.field("lo").to_numpy().astype(np.int64)
                hi = runs_.values.field("hi").to_numpy().astype(np.int64) + length
                order = np.argsort(lo)
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.append(True, lo[1:] > hi[:-1])
                a, z = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
                view, h, at = memoryview(t.as_buffer()), hashlib.sha256(), 0
                for x, y in zip(a.tolist(), z.tolist(), strict=True):
                    h.update(view[at:x])
                    at = y
                h.update(view[at:])
                out.append((dk, int((z - a).sum()), len(a), h.hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist(), strict=True)]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), span), strict=True)], ["dk", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = runs.join(work, "id").select("dk", "runs", "text").mapInArrow(strip, "dk binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>").dropDuplicates(["dk"])
    done = scratch.keep(done)
    scratch.only(done)
    out = rows.select("doc_id", "dk", F.octet_length("text").cast("long").alias("n_bytes")).join(done, "dk", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("dk"))).alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )
