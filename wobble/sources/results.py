"""Files of embeddings, eigenvalues and fixation indices in the common text layouts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.errors import WobbleError

from .lines import numbered_lines


def read_evec(spark: SparkSession, evec: str, eval_: str, replicate: int = 0) -> DataFrame:
    """One row of wobble.operators.embed.EMBEDDED: samples by id, and shares of all eigenvalues."""
    lines = numbered_lines(spark, evec)
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    head = lines.where("idx = 0").select("value").first()
    if head is None or not head[0].strip().startswith("#eigvals"):
        raise WobbleError(f"{evec}: the first line must begin with #eigvals.")
    rows = lines.where("idx > 0").select(f.alias("f")).where("f[0] <> ''")
    k = rows.select(F.size("f")).first()[0] - 2
    bad = rows.where((F.size("f") != k + 2) | F.exists(F.slice("f", 2, k), lambda x: x.try_cast("double").isNull())).limit(1).count()
    if bad:
        raise WobbleError(f"{evec}: a row doesn't hold an id, {k} numbers and a population.")
    one = rows.select(F.struct(F.col("f")[0].alias("s"), F.element_at("f", -1).alias("p"), F.transform(F.slice("f", 2, k), lambda x: x.cast("double")).alias("c")).alias("z")).agg(F.sort_array(F.collect_list("z")).alias("z"))
    values = numbered_lines(spark, eval_).select("idx", F.trim("value").try_cast("double").alias("v")).where("v is not null").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("v"))
    share = F.transform(F.slice("v.v", 1, k), lambda x: x / F.aggregate("v.v", F.lit(0.0), lambda a, y: a + y))
    return one.join(values, F.lit(True)).select(F.lit(replicate).cast("int").alias("replicate_id"), F.col("z.s").alias("sample_ids"), F.col("z.p").alias("populations"), F.col("z.c").alias("coords"), share.alias("explained"))


def read_fst(spark: SparkSession, fst: str, log: str) -> DataFrame:
    """(p1, p2, fst) of a square text matrix, names from the log's population lines. A blank may be missing before a minus sign."""
    names = [m[1] for (v,) in numbered_lines(spark, log).where("value like 'population:%'").orderBy("idx").select("value").collect() if (m := re.match(r"population:\s+\d+\s+(\S+)", v))]
    f = F.split(F.trim(F.regexp_replace(F.regexp_replace("value", r"-(\d)", " -$1"), r"\s+", " ")), " ")
    rows = numbered_lines(spark, fst).where("idx > 0 and trim(value) <> ''").select((F.col("idx") - 1).cast("int").alias("i"), f.alias("f"))
    label = F.array(*[F.lit(n) for n in names])
    cells = rows.select("i", F.posexplode(F.expr(f"slice(f, greatest(1, size(f) - {len(names)} + 1), {len(names)})")).alias("j", "v"))
    return cells.where("i < j").select(F.get(label, F.col("i")).alias("p1"), F.get(label, F.col("j")).alias("p2"), F.col("v").cast("double").alias("fst"))


def write_embedding(spark: SparkSession, embedded: DataFrame, path: str) -> None:
    embedded.write.mode("overwrite").parquet(path)
