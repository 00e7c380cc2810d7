"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from wobble.errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A folder of our own only in local mode, where none may be named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("Name a folder that the driver and all executors share in spark.checkpoint.dir.")
        found = "file://" + tempfile.mkdtemp(prefix="wobble-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, in_file: int = 0) -> DataFrame:
    """df, written and read again: what is read several times is computed once, and survives lost executors. in_file: rows of a file at most; 0: any."""
    path = f"{shared_folder(df.sparkSession)}/engine-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
