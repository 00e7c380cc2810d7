"""Near-duplicate paragraphs across documents: MinHash bands, exact Jaccard similarity, connected components, passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import near
from .base import Scratch, lean, pieces
from .extend import stretches
from .neardup import NULL_ID
from .setsketch import mix, shingle_sets, word_hashes

#: A paragraph begins where a word pair's hash is the least of REACH pairs on either side; longer ones than MOST words are halved, or cut in three, and so on.
REACH, MOST = 8, 32
#: Two linked paragraphs are part of a result if their passage has so many words. Strings about a paragraph are compared at every STRIDE-th place.
PASSAGE, STRIDE = 50, 3
#: Words on either side of a linked paragraph that are compared as well.
BESIDE = 32


def pair_hashes(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one of its text; the largest value for a text's last word."""
    h = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    if len(words) > 1:
        h[:-1] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> np.uint64(1)
        last = ends[ends > 0] - 1
        h[last] = np.iinfo(np.uint64).max
    return h


def cut_points(words: np.ndarray, ends: np.ndarray, reach: int = REACH, most: int = MOST) -> np.ndarray:
    """Where paragraphs begin, over all texts one after the other. Whether one begins at a word depends on at most reach + 1 words on either side of it, and on `most`."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    starts = np.unique(starts[starts < n])
    h = pair_hashes(words, ends)
    top = np.iinfo(np.uint64).max
    # texts lie `reach` places apart, so that no window holds words of two
    owner = np.searchsorted(starts, np.arange(n), "right") - 1
    at = np.arange(n) + reach * (owner + 1)
    laid = np.full(n + reach * (len(starts) + 2), top, np.uint64)
    laid[at] = h
    least, done = laid, 1
    while 2 * done <= reach:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < reach:
        least = np.minimum(least[: len(least) - (reach - done)], least[reach - done :])
    low = (h < least[at - reach]) & (h <= least[at + 1])
    low[starts] = True
    begin = np.flatnonzero(low)
    size = np.diff(np.append(begin, n))
    parts = -(-size // most)
    first = np.cumsum(parts) - parts
    k = np.arange(int(parts.sum())) - np.repeat(first, parts)
    return np.repeat(begin, parts) + np.repeat(size, parts) * k // np.repeat(parts, parts)


def set_digests(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two parts: sums of its elements' hashes."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.add.reduceat(mix(sets ^ np.uint64(c)), begin).astype(np.int64) for c in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95))


def lists(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.ListArray:
    """Arrow lists flat[begin : begin + length]."""
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    at = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[at].astype(np.int64)))


def duplicate_paragraphs(docs: DataFrame, percent: int = 80, shingle: int = 5, min_words: int = 5, passage: int = PASSAGE, reach: int = REACH, most: int = MOST, beside: int = BESIDE) -> DataFrame:
    """Rows of paragraphs that occur in another row of docs, alike or nearly so, within a passage of at least `passage` words: doc_id, start (first word, from 0), n_words,
    cluster_doc_id and cluster_start (the cluster's first member, by doc_id and place), cluster_rows, passage_start, passage_words, kept (is that first member).

    A paragraph is a run of words of the text whose bounds its own content sets (cut_points), so that a passage is cut alike wherever it stands, also within a line or over
    several. Two link if their sets of word shingles, in ASCII lower case, have a Jaccard similarity of percent / 100 or more; clusters are connected components of links.
    Paragraphs of fewer than min_words words take no part.

    Equal sets are one class. A class of n shingles has n - ceil(percent * n / 100) + 1 bands: its least hash values, one to a band. Two
    sets that link share so many shingles that one of these is common to both: no link is missed. Classes that share a band are compared on their full sets (near.set_links).

    Linked paragraphs are seeds. A changed word keeps a paragraph of some 20 words from linking, so the `beside` words on either side of a seed are compared with those beside the seed's partners, as bags of words at the same
    similarity, and make rows of their own where they lie between linked paragraphs (extend.stretches). In those rows start and n_words are the stretch's, cluster_doc_id and cluster_start the
    doc_id and first word of the first of the windows that are alike.

    Neighbouring paragraphs and stretches make a passage. The outer parts of one may lie in paragraphs that begin or end outside, so one of fewer than `passage` words stays as well if
    one of its paragraphs stands in a string of words that another row holds about a paragraph of the cluster: every string of `passage` words counts, and none of fewer than passage - STRIDE + 1.
    With passage=1, all linked paragraphs are rows.

    Null, empty and short texts have no paragraphs. A null doc_id sorts first. Repeated rows are partners of each other; those that equal the first member in id and place are all kept.
    A paragraph that recurs in its own row only is no result. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "paragraphs")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    needed = lambda n: n - (percent * n + 99) // 100 + 1

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            words, ends = word_hashes(b.column(2))
            begin = cut_points(words, ends, reach, most)
            n = np.diff(np.append(begin, len(words)))
            doc = np.searchsorted(ends, begin, "right")
            long = np.flatnonzero(n >= min_words)
            inside = np.repeat(n >= min_words, n)
            sets, set_ends = shingle_sets(words[inside], np.cumsum(n[long]), shingle)
            at = np.concatenate([[0], set_ends]).astype(np.int64)
            size = np.diff(at)
            c1, c2 = set_digests(sets, at[:-1])
            begin, n, doc = begin[long], n[long], doc[long]
            start = begin - np.concatenate([[0], ends])[doc]
            keys = lists(sets, at[:-1], needed(size))  # a set's hashes ascend
            d = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(3).take(d), b.column(0).take(d), b.column(1).take(d), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(c1), pa.array(c2), keys],
                ["row", "doc_id", "th", "start", "n_words", "n", "c1", "c2", "keys"],
            )

    numbered = keyed.withColumn("row", F.monotonically_increasing_id())
    p = scratch.keep(numbered.mapInArrow(cut, "row long, doc_id long, th long, start int, n_words int, n int, c1 long, c2 long, keys array<long>"))
    classes = p.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "start", "th", "n_words")).alias("first"), F.count("*").alias("rows"), F.min("row").alias("low"), F.max("row").alias("high"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))  # written, and so fixed
    wide, p = p, scratch.keep(p.drop("n", "keys"))
    scratch.free(wide)
    some: list[DataFrame] = []

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Sets of nodes that share a key. These classes, and those of several rows, are all that matters from here on."""
        some.append(scratch.keep(classes.drop("keys").join(nodes.withColumn("wanted", F.lit(True)).hint("shuffle_hash"), "node", "left").where("wanted or low < high")))
        scratch.free(classes)
        return _sets_of(some[0].where("wanted"), keyed, shingle)

    links = near.set_links(classes.select("node", "n", "keys"), sets_of, percent, scratch)
    comps = near.components(links, scratch)
    c = scratch.keep(some[0].select("c1", "c2", "node", "rows", "low", "high", F.struct("first.doc_id", "first.start").alias("first")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    scratch.free(*some)
    clusters = c.groupBy("component").agg(F.min("first").alias("head"), F.sum("rows").alias("cluster_rows"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    of_class = c.select("c1", "c2", "component").join(clusters.select("component", "head", "cluster_rows"), "component").select("c1", "c2", "component", "head", "cluster_rows")
    found = p.select("row", "doc_id", "th", "start", "n_words", "c1", "c2").join(of_class.hint("shuffle_hash"), ["c1", "c2"]).drop("c1", "c2")
    found = scratch.keep(found.withColumn("first", (F.col("doc_id") == F.col("head.doc_id")) & (F.col("start") == F.col("head.start"))))
    scratch.only(found)
    beside_them = stretches(found, keyed, percent, beside, scratch)
    scratch.only(found, beside_them)
    found = found.unionByName(beside_them.withColumn("component", F.lit(None).cast("long")))
    # neighbours with partners: passages
    in_row = Window.partitionBy("row").orderBy("start")
    runs = found.withColumn("new", F.coalesce((F.col("start") != F.lag(F.col("start") + F.col("n_words")).over(in_row)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of_run = Window.partitionBy("row", "run")
    runs = scratch.keep(runs.drop("new").withColumns({"passage_start": F.min("start").over(of_run), "passage_words": F.sum("n_words").over(of_run).cast("int")}))
    scratch.only(runs)
    enough = runs.where(F.col("passage_words") >= passage)
    short = runs.where(F.col("passage_words") < passage)
    about = runs.join(short.select("component").distinct(), "component", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("row", "run", "start", "n_words")).alias("parts"))
    repeated = _covered(about.join(keyed, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]), passage, scratch)
    out = scratch.keep(enough.union(short.join(repeated, ["row", "run"], "left_semi").select(*enough.columns)))
    scratch.only(out)
    real = lambda x: F.when(F.col(x) != NULL_ID, F.col(x))
    return out.select(
        real("doc_id").alias("doc_id"), "start", "n_words", real("head.doc_id").alias("cluster_doc_id"), F.col("head.start").alias("cluster_start"), "cluster_rows", "passage_start", "passage_words",
        F.col("first").alias("kept"),
    )


def _sets_of(classes: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """node, set (its hashes, 8 bytes each, ascending) of classes (node, first), cut from the texts of their first members."""
    wanted = classes.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("node", "first.start", "first.n_words")).alias("parts"))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            words, ends = word_hashes(b.column(1))
            parts = b.column(0)
            doc = np.repeat(np.arange(len(b)), pa.compute.list_value_length(parts).to_numpy())
            flat = parts.flatten()
            node, start, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            at = np.concatenate([[0], ends])[doc] + start
            stop = np.cumsum(n)
            sets, set_ends = shingle_sets(words[np.repeat(at - (stop - n), n) + np.arange(int(n.sum()))], stop, shingle)
            offsets = pa.py_buffer((8 * np.concatenate([[0], set_ends])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.Array.from_buffers(pa.binary(), len(node), [None, offsets, pa.py_buffer(np.ascontiguousarray(sets).tobytes())])], ["node", "set"])

    # rows of equal id and text give the same sets
    return wanted.join(keyed, ["doc_id", "th"]).select("parts", "text").mapInArrow(cut, "node long, set binary").dropDuplicates(["node"])


def _covered(texts: DataFrame, passage: int, scratch: Scratch) -> DataFrame:
    """(row, run) of passages with a paragraph in a string of words that another row holds at the same place about a paragraph. texts: parts (row, run, start, n_words), text.

    Strings are STRIDE - 1 words shorter than `passage` and begin 0, STRIDE, 2 * STRIDE ... words before a paragraph, so a common string of `passage` words about two equal paragraphs holds two of these.
    """
    size = max(1, passage - STRIDE + 1)

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(0x9E3779B97F4A7C15)
        for b in pieces(batches, "text", 2 << 20):
            words, ends = word_hashes(b.column(1))
            parts = b.column(0)
            doc = np.repeat(np.arange(len(b)), pa.compute.list_value_length(parts).to_numpy())
            flat = parts.flatten()
            row, run, start, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(4))
            base = np.concatenate([[0], ends])[doc]
            low = np.maximum(0, -(-(start + size - (ends[doc] - base)) // STRIDE))  # the string ends in the text
            high = np.minimum(np.maximum(0, passage - n), start) // STRIDE  # and begins in it
            count = np.maximum(0, high - low + 1)
            steps = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            at = np.repeat(base + start, count) - STRIDE * steps
            h1, h2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for k in range(size):
                w = words[at + k]
                h1, h2 = h1 * power + w, (h2 ^ w) * np.uint64(0xD6E8FEB86659FD93)
                h2 ^= h2 >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, count)), pa.array(np.repeat(run, count)), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64))], ["row", "run", "h1", "h2"])

    w = scratch.keep(texts.select("parts", "text").mapInArrow(windows, "row long, run long, h1 long, h2 long"))
    twice = w.groupBy("h1", "h2").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("h1", "h2")
    return w.join(twice, ["h1", "h2"], "left_semi").select("row", "run").distinct()
