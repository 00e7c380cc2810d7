"""Seeds and extensions: words beside linked paragraphs that other rows hold at the same place, but for some words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import near
from .base import Scratch, lean, pieces
from .setsketch import mix, word_hashes


def bags(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Rows of words as rows of ascending hashes, one for each word and number of its occurrence in the row, told apart by the row's salt."""
    w = np.sort(words, axis=1)
    place = np.broadcast_to(np.arange(w.shape[1]), w.shape)
    new = np.ones(w.shape, bool)
    new[:, 1:] = w[:, 1:] != w[:, :-1]
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return np.sort(mix(mix(w + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt[:, None]), axis=1)


def stretches(found: DataFrame, keyed: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """Stretches of words beside paragraphs of found (row, doc_id, th, start, n_words, component), in the gaps between them: row, doc_id, th, start, n_words, head, cluster_rows, first.

    The `size` words before a paragraph, and those after it, make a window, where the text holds so many. Two windows on the same side of paragraphs of one component
    link if their bags of words have a Jaccard similarity of percent / 100 or more (a bag's elements are words with the number of their occurrence); clusters
    are connected components, and count if they have two rows. A window gives the part of it that lies in the gap beside its paragraph; where the
    windows of a gap's two sides meet, the left paragraph's goes first. head is the doc_id and begin of the cluster's first window, first whether that is this one.
    """
    in_row = Window.partitionBy("row").orderBy("start")
    end = F.col("start") + F.col("n_words")
    gaps = found.select("row", "doc_id", "th", "start", "n_words", "component").withColumns({"before": F.col("start") - F.coalesce(F.lag(end).over(in_row), F.lit(0)), "after": F.lead("start").over(in_row) - end})
    gaps = scratch.keep(gaps)
    # a side of a component without a gap in any row has nothing to give
    sides = gaps.groupBy("component").agg(F.max(F.col("before") > 0).alias("before"), F.max(F.coalesce(F.col("after") > 0, F.lit(True))).alias("after")).where("before or after")
    of_rows = gaps.drop("before", "after").join(sides, "component").groupBy("doc_id", "th", "start", "n_words", "component", "before", "after").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("rows"))
    texts = of_rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n_words", "component", "before", "after", "low", "high", "rows")).alias("parts")).join(keyed, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            words, ends = word_hashes(b.column(3))
            parts = b.column(2)
            doc = np.repeat(np.arange(len(b)), pa.compute.list_value_length(parts).to_numpy())
            flat = parts.flatten()
            start, n, component = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            base = np.concatenate([[0], ends])[doc]
            for left in (True, False):
                begin = start - size if left else start + n
                ok = flat.field(3 if left else 4).to_numpy(zero_copy_only=False) & (begin >= 0) & (base + begin + size <= ends[doc])
                which = np.flatnonzero(ok)
                for at in range(0, len(which), 4096):
                    some = which[at : at + 4096]
                    salt = mix(component[some].astype(np.uint64) * np.uint64(2) + np.uint64(left))
                    bag = bags(words[(base + begin)[some][:, None] + np.arange(size)], salt)
                    c1, c2 = (mix(bag ^ np.uint64(c)).sum(axis=1, dtype=np.uint64).astype(np.int64) for c in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95))
                    held = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * size * np.arange(len(some) + 1)).astype(np.int32).tobytes()), pa.py_buffer(bag.tobytes())])
                    d, f = pa.array(doc[some]), flat.take(pa.array(some))
                    columns = [b.column(0).take(d), b.column(1).take(d), f.field(0), pa.array(begin[some].astype(np.int32)), f.field(2), pa.array(np.full(len(some), left)), f.field(5), f.field(6), f.field(7), pa.array(c1), pa.array(c2), held]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "start", "begin", "component", "left", "low", "high", "rows", "c1", "c2", "set"])

    w = scratch.keep(texts.select("doc_id", "th", "parts", "text").mapInArrow(cut, "doc_id long, th long, start int, begin int, component long, left boolean, low long, high long, rows long, c1 long, c2 long, set binary"))
    scratch_w = w
    classes = w.groupBy("component", "left", "c1", "c2").agg(F.min(F.struct("doc_id", "begin")).alias("head"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("set").alias("set"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))  # written, and so fixed
    w = scratch.keep(w.drop("set", "low", "high", "rows"))
    scratch.free(scratch_w)
    several = classes.groupBy("component", "left").agg(F.count("*").alias("k")).where("k > 1").select("component", "left")
    sets = classes.join(several, ["component", "left"]).select("node", "set")
    needed = size - (percent * size + 99) // 100 + 1

    @lean
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements, begin = near.stored_sets(pa.Table.from_batches([b]))
            least = elements[begin[:-1, None] + np.arange(needed)].astype(np.int64).reshape(-1)
            keys = pa.ListArray.from_arrays(pa.array((needed * np.arange(len(b) + 1)).astype(np.int32)), pa.array(least))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), size, np.int32)), keys], ["node", "n", "keys"])

    nodes = sets.mapInArrow(bands, "node long, n int, keys array<long>")
    links = near.set_links(nodes, lambda wanted: wanted.join(classes.select("node", "set"), "node"), percent, scratch)
    of_node = near.components(links, scratch).withColumnRenamed("component", "cluster")
    c = scratch.keep(classes.drop("set").join(of_node, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
    clusters = c.groupBy("cluster").agg(F.min("head").alias("head"), F.sum("rows").alias("cluster_rows"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("low", "high")
    of_class = c.select("component", "left", "c1", "c2", "cluster").join(clusters, "cluster").drop("cluster")
    hit = w.join(of_class, ["component", "left", "c1", "c2"]).select("doc_id", "th", "start", "left", F.struct("head", "cluster_rows", (F.struct("doc_id", "begin") == F.col("head")).alias("first")).alias("w"))
    hit = hit.groupBy("doc_id", "th", "start").agg(F.first(F.when(F.col("left"), F.col("w")), True).alias("lw"), F.first(F.when(~F.col("left"), F.col("w")), True).alias("rw"))
    ext = gaps.join(hit, ["doc_id", "th", "start"], "left")
    ext = ext.withColumn("rn", F.when(F.col("rw").isNotNull(), F.least(F.lit(size), F.coalesce("after", F.lit(size)))).otherwise(0))
    ext = ext.withColumn("ln", F.when(F.col("lw").isNotNull(), F.least(F.lit(size), F.col("before") - F.coalesce(F.lag("rn").over(in_row), F.lit(0)))).otherwise(0))
    sides = F.explode(F.array(F.struct((F.col("start") - F.col("ln")).alias("start"), F.col("ln").alias("n_words"), F.col("lw").alias("w")), F.struct(end.alias("start"), F.col("rn").alias("n_words"), F.col("rw").alias("w"))))
    out = ext.select("row", "doc_id", "th", sides.alias("s")).where("s.n_words > 0")
    return scratch.keep(out.select("row", "doc_id", "th", "s.start", "s.n_words", F.struct(F.col("s.w.head.doc_id").alias("doc_id"), F.col("s.w.head.begin").alias("start")).alias("head"), "s.w.cluster_rows", "s.w.first"))
