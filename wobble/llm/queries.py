"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch, table
from .chat import format_reply_trees, read_loss, read_turns
from .decontaminate import contamination
from .divergence import source_divergence
from .importance import importance_resample
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import packed_digest, write_packed
from .paragraphs import duplicate_paragraphs
from .quality import quality
from .sql import ORACLE_SQL  # noqa: F401
from .substrings import remove_repeats
from .tokencount import load_pieces, token_counts
from .tokens import token_file_digest, write_token_files
from .toxicity import score, train_sample

#: A public tokenizer's file, beside the installed module public_tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op1").root
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_json())
    return token_file_digest(spark, path)


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op3_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, percent=85)


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), text_out=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train_sample(docs, labels.where(third != 1))
    s = score(docs, model)
    return s.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op8_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(odd).alias("text")) for k, role in enumerate(("user", "assistant"))]
    c = c.unionByName(spark.range(1).select(F.inline(F.array(*rows))))
    in_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    nodes = c.withColumn("node", F.row_number().over(in_turn)).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    out = Scratch(spark, "op9").keep(format_reply_trees(Scratch(spark, "nodes").keep(nodes)))
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op11").root
    write_packed(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_json())
    return packed_digest(spark, path)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simple8b_token_files, op2_trie_token_counts, op3_setsketch_near_duplicates, op4_paragraph_minhash, op5_distribution_divergence, op6_noisy_or_toxicity, op7_suffix_buckets, op8_prefix_filtered_decontamination, op9_reply_trees, op10_weighted_mix, op11_minimum_bin_slack, op12_importance_resampling, op13_source_divergence)
}
