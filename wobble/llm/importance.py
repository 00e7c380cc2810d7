"""Importance resampling to a target distribution: a position table of words gives n-grams, hashed buckets give gains, and gains join back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch

#: ASCII characters that are not letters or digits separate words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The table of gains is broadcast up to so many buckets: 16 bytes each.
BROADCAST_BUCKETS = 1 << 18


def _lower(word: Column) -> Column:
    """A-Z to a-z, nothing else: lower() does just that to an ASCII word."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, small))


def position_table(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, w) of each word of each text. Words are lower-cased A-Z, a-z, digits and what isn't ASCII. A text's first or last row may have an empty word; a text without words has one such row."""
    at = texts.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), BETWEEN)).alias("pos", "w"))
    return at.withColumn("w", _lower(F.col("w")))


def ngram_table(texts: DataFrame, orders: int, *keys: str) -> DataFrame:
    """(keys, w, grams): at each position, the runs of 1 to orders words that begin there, joined by a space; null where the text ends before. lead() over a text's positions gives the words that follow; runs of one word need none. keys[0] tells texts apart."""
    at = position_table(texts, *keys)
    grams = [F.when(F.col("w") != "", F.col("w"))]
    if orders > 1:
        places = Window.partitionBy(keys[0]).orderBy("pos")
        for k in range(1, orders):
            at = at.withColumn(f"_{k}", F.lead("w", k).over(places))
        for k in range(1, orders):  # || and so on give null if any word isn't there
            grams.append(F.concat(grams[-1], F.lit(" "), F.when(F.col(f"_{k}") != "", F.col(f"_{k}"))))
    return at.select(*keys, "w", F.array(*grams).alias("grams"))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.crc32(F.encode(gram, "utf-8")) % buckets


def _rows(table: DataFrame, orders: int, buckets: int, *keys: str) -> DataFrame:
    """A row for each feature, with its bucket; a position without any keeps one row without a bucket."""
    if orders == 1:
        return table.select(*keys, "w", bucket_of(F.col("grams")[0], buckets).alias("bucket"))
    return table.select(*keys, "w", F.explode(F.filter("grams", lambda g: g.isNotNull() | (F.col("w") == ""))).alias("g")).select(*keys, "w", bucket_of(F.col("g"), buckets).alias("bucket"))


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sends its sums of buckets."""
    keyed = texts.select(F.monotonically_increasing_id().alias("_row"), "text")
    return _rows(ngram_table(keyed, orders, "_row"), orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share of the target's features over its share of the documents'."""
    s, t = (bucket_counts(x, orders, buckets) for x in (docs, target))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    totals = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    ratio = ((F.col("t") + 1) * (F.col("s_all") + F.lit(float(buckets)))) / ((F.col("s") + 1) * (F.col("t_all") + F.lit(float(buckets))))
    return both.join(F.broadcast(totals), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def ranked(df: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """df with rank (long, from 1) by order. One range shuffle; a row's place in its range, and the rows of earlier ranges, give its rank, so no task sees all rows."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.keep(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs, all long but doc_id.

    Features are the runs of 1 to orders consecutive words, repeats counted, in crc32 buckets. weight is the sum of the gains of a document's features; score adds
    Gumbel noise, a hash of seed and doc_id, so that the highest scores are a draw without replacement by weight. Of the rows with least_words words or more, floor(percent / 100) are drawn:
    highest scores first, ties to the smaller doc_id. rank is null for the others.

    Null and empty texts have no features, weight 0 and no rank. A null doc_id is hashed as an empty one, and is the last of equal scores. Repeated rows are
    documents each. An empty target, or no documents, is a distribution without counts. Other columns don't matter.

    Both passes explode whole texts where they are read. What is shuffled is a sum for each bucket and task, a sum for each document, and once the documents' scores in order.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    texts = docs.select("doc_id", "text")
    gain = scratch.keep(gains(texts, target.select("text"), orders, buckets))
    keyed = texts.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    features = _rows(ngram_table(keyed, orders, "_row", "doc_id"), orders, buckets, "_row", "doc_id")
    joined = features.join(F.broadcast(gain) if buckets <= BROADCAST_BUCKETS else gain, "bucket", "left")
    sums = joined.groupBy("_row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    sums = sums.withColumn("n_words", words_of("n_features", orders))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.keep(sums.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")))
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    first = ranked(scored.where(enough), scratch, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return first.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))


def words_of(n_features: str, orders: int) -> Column:
    """The number of words of a text with so many runs of 1 to orders words: n words have n + (n - 1) + ... of them."""
    f = F.col(n_features)
    whole = orders * (orders + 1) // 2  # runs of a text of `orders` words; each further word adds `orders`
    few = F.lit(0)
    for k in range(1, orders):
        few = few + F.when(f >= k * (k + 1) // 2, 1).otherwise(0)
    return F.when(f >= whole, (orders + F.floor((f - whole) / orders))).otherwise(few).cast("long")
