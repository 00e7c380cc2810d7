"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import words

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources. sizes: no_source boolean, source, source_size, a row for each source.

    Sources in code-point order (null last) weigh as `weights` say, in turn, and split `share` of all sizes. A target stops at
    `most` times its source's size, and the excess is shared among the rest by weight until none is above: sources fill
    up in order of size per weight, so a sorted prefix of them is capped and the rest split what remains.
    """
    in_order = Window.orderBy("no_source", "source")  # a row for each source
    filling = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("capped", F.col("cap") * F.sum("w").over(rest) <= (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) * F.col("w"))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    filled = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - filled) / free)).select("no_source", "source", "source_size", "target")


def mix_sources(docs: DataFrame, size: Column | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, whole_documents: bool = False, bucket_digits: int = 3) -> DataFrame:
    """docs with size, source_size, target, taken: how many of each document's words the mix takes.

    Within a source, documents follow each other by md5 of seed and doc_id. Their sizes are laid end to end; the target
    goes around as often as it can, and its last round ends at a word: the document there is taken in part. With
    whole_documents, that document is taken whole or not at all in the last round, whichever is nearer.

    Buckets of the key's leading hexadecimal digits sum up first; a bucket's offset is the sum of those before it, and
    only rows of one bucket are ever sorted together, so a source with most of the rows spreads like any other.

    Null and empty texts have size 0 and nothing is taken of them. A null source is a source. Repeated rows count each; rows of equal doc_id in
    a source share a place's order by size. No rows give no rows. Columns of docs named like those added are replaced.
    """
    size = F.size(words(F.col("text"))).cast("long") if size is None else size
    added = ("size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c.lower() not in added]
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = docs.select(*own, size.alias("size"), F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_src"), key.alias("_key"), F.substring(key, 1, bucket_digits).alias("_b"))
    buckets = d.groupBy("_no", "_src", "_b").agg(F.sum("size").alias("_n"))
    sizes = buckets.groupBy(F.col("_no").alias("no_source"), F.col("_src").alias("source")).agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("no_source").alias("_no"), F.col("source").alias("_src"), "source_size", "target")
    by_source = Window.partitionBy("_no", "_src").orderBy("_b")
    offsets = buckets.select("_no", "_src", "_b", (F.sum("_n").over(by_source) - F.col("_n")).alias("_at")).join(targets, ["_no", "_src"])
    within = Window.partitionBy("_no", "_src", "_b").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(offsets, ["_no", "_src", "_b"]).withColumn("_at", F.col("_at") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target").cast("long")
    once = F.greatest(F.col("source_size"), F.lit(1))
    rounds, left = F.floor(budget / once).cast("long"), budget % once
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_at")))
    if whole_documents:
        part = F.when((F.col("size") > 0) & (2 * F.col("_at") + F.col("size") <= 2 * left), F.col("size")).otherwise(0)
    return out.withColumn("taken", (rounds * F.col("size") + part).cast("long")).select(*own, "size", "source_size", "target", "taken")
