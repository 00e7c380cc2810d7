"""Benchmark decontamination: prefix-filtered set join and exact windows. Joins and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, ascii_lower

#: ASCII characters that are not letters or digits separate words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of words is broadcast if it holds at most so many bytes.
BROADCAST_BYTES = 8 << 20


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def maybe_broadcast(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its rows add up to at most BROADCAST_BYTES; otherwise Spark joins by shuffling."""
    total = df.agg(F.sum(size + F.lit(64))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Distinct windows of the items: wid, ws array<string>, items (ids as sorted strings). Items without words have none."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    w = w.select("item", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))).alias("at"), "ws").select("item", F.slice("ws", F.col("at"), window).alias("ws"))
    w = w.groupBy("ws").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return w.select(F.monotonically_increasing_id().alias("wid"), "ws", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs with n_words, n_hit, n_items, items array<string> and contaminated.

    A document word inside any occurrence of an item's window is hit; windows are `window` consecutive words, or a whole
    shorter item. contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null, empty and wordless texts have no words and no hits. An empty
    benchmark hits nothing. Repeated rows are judged each. Columns of docs named like those added are replaced.

    A window is the set of its words at their places. Its necessary prefix is its rarest word, by occurrences in all docs:
    an occurrence of the window must hold it. Documents' words join the prefixes; the place of the word bounds where the window
    begins, and its length must fit the document; what remains is compared word by word. Texts meet their
    candidates by two 64-bit hashes of the text, so that copies of a text need no candidates of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    own = [c for c in docs.columns if c.lower() not in added]
    wins = scratch.keep(benchmark_windows(benchmark, window))
    vocab = scratch.keep(wins.select(F.explode("ws").alias("w")).distinct())
    texts = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2"), item_words(F.col("text")).alias("ws"))
    seen = texts.select(F.explode("ws").alias("w")).join(maybe_broadcast(vocab, F.length("w")), "w").groupBy("w").agg(F.count("*").alias("df"))
    rare = vocab.join(seen, "w").select("w", "df")
    # a window with a word that no document has can't occur: the inner join with rare drops its word, and the count of words tells
    places = wins.select("wid", F.size("ws").alias("len"), F.posexplode("ws").alias("off", "w")).join(rare, "w")
    prefix = places.groupBy("wid", "len").agg(F.min(F.struct("df", "off", "w")).alias("p"), F.count("*").alias("n")).where("n = len").select(F.col("p.w").alias("w"), F.col("p.off").alias("off"), "len", "wid")
    prefix = scratch.keep(prefix)
    found = texts.select("k1", "k2", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w")).join(maybe_broadcast(prefix, F.length("w")), "w")
    found = found.where("pos >= off and pos - off + len <= n").select("k1", "k2", (F.col("pos") - F.col("off")).alias("at"), "wid").distinct()
    cands = found.join(maybe_broadcast(wins, F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x) + 16) + F.size("items") * 32), "wid").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "ws", "items")).alias("cands"))
    keyed = docs.select(*own, F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(7), F.col("text")).alias("_k2"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = keyed.join(cands.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "cands"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    # the words are bound as a lambda's argument: named as a column, they would be cut from the text again for each candidate
    matches = F.transform(F.array(item_words(F.col("text"))), lambda w: F.filter("cands", lambda c: F.slice(w, c["at"] + 1, F.size(c["ws"])) == c["ws"]))
    out = out.withColumn("_hits", F.when(F.col("cands").isNotNull(), F.get(matches, F.lit(0)))).drop("cands")
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda c: F.sequence(c["at"], c["at"] + F.size(c["ws"]) - 1))))
    out = out.withColumns({"n_hit": F.when(F.size("_hits") > 0, F.size(covered)).otherwise(0).cast("long"), "items": F.when(F.size("_hits") > 0, F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda c: c["items"]))))).otherwise(F.array().cast("array<string>"))})
    return out.select(*own, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
