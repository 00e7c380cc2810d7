"""From raw documents to token files: five stages over the operators of wobble.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Null and empty
texts fail the base rules and go in the first stage. Empty tables pass through all stages. Columns besides doc_id, text, lang and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.llm.base import Scratch, table
from wobble.llm.decontaminate import contamination
from wobble.llm.mixing import mix_sources
from wobble.llm.neardup import near_duplicates
from wobble.llm.quality import quality
from wobble.llm.queries import tokenizer_json
from wobble.llm.tokens import token_file_digest, write_token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't diverge from their language."""
    return quality(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.8. Rows that share a doc_id are one document and stay or go together."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).where("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Documents stay whole, so a source's last one is taken or left by what is nearer to the target."""
    mixed = mix_sources(docs, whole_documents=True).where("taken > 0")
    names = [F.col(c) for c in docs.columns]
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*names)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives."""
    path = Scratch(spark, "tokens").root
    write_token_files(docs, path, tokenizer_json())
    return token_file_digest(spark, path)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: SetSketch candidates and a tokenizer's ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
