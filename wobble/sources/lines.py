"""Text files by line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) of the lines of a text file, or of a folder of part files in order of their names.

    Spark splits files into blocks; within one, row ids ascend. Counts per block give each block's offset, so no line passes through a single task.
    """
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parts = df.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    offsets = parts.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))  # a row for each block
    return df.join(offsets, ["file", "block"]).select((F.col("before") + F.col("row") - F.col("first")).alias("idx"), "value")


def write_lines(df: DataFrame, path: str, order: str = "idx", value: str = "value") -> None:
    """Lines in order, in part files whose names ascend; numbered_lines reads them back in order."""
    df.select(order, value).repartitionByRange(order).sortWithinPartitions(order).select(value).write.mode("overwrite").text(path)
