"""Genotype matrices as DataFrames: long (snp_idx, sample_idx, dosage) and packed (snp_idx, g array over samples); missing is NULL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wobble.errors import ConfigError, WobbleError


def normalise_missing(value: Column, missing: float | None) -> Column:
    """NULL for the missing value and for NaN."""
    out = F.when(F.isnan(value.cast("double")), None).otherwise(value)
    return out if missing is None or missing != missing else F.when(value == F.lit(missing), None).otherwise(out)


def matrix_to_packed(spark: SparkSession, matrix: np.ndarray, missing: float | None = None) -> DataFrame:
    """A samples x features array, packed by feature."""
    m = np.asarray(matrix)
    if m.ndim != 2:
        raise ConfigError("A matrix of samples x features is needed.")
    if m.dtype.kind not in "fiub" or m.dtype.kind == "b":
        raise ConfigError(f"Unsupported data type {m.dtype}: only integers and floats are.")
    x = m.astype(float)
    if missing is not None and missing == missing:
        x = np.where(m == missing, np.nan, x)
    rows = [(i, [None if v != v else float(v) for v in x[:, i]]) for i in range(x.shape[1])]
    return spark.createDataFrame(rows, "snp_idx long, g array<double>")


def to_long(packed: DataFrame) -> DataFrame:
    return packed.select("snp_idx", F.posexplode("g").alias("sample_idx", "dosage"))


def to_packed(long: DataFrame, n_samples: int) -> DataFrame:
    """Long rows, packed by feature; cells without a row are NULL. The array has a place per sample, so a feature's rows are at most n_samples."""
    cells = long.groupBy("snp_idx").agg(F.collect_list(F.struct("sample_idx", F.col("dosage").cast("double").alias("v"))).alias("s"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                s = batch.column("s")[k].values
                at = s.field("sample_idx").to_numpy(zero_copy_only=False)
                g = np.full(n_samples, np.nan)
                ok = (at >= 0) & (at < n_samples)
                if len(np.unique(at)) < len(at):
                    raise WobbleError(f"Feature {batch.column('snp_idx')[k].as_py()} has several values for a sample.")
                g[at[ok]] = s.field("v").to_numpy(zero_copy_only=False)[ok]
                rows.append(g)
            flat = np.concatenate(rows) if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * n_samples, pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("snp_idx"), lists], ["snp_idx", "g"])

    return cells.select("snp_idx", F.col("s")).mapInArrow(place, f"snp_idx {long.schema['snp_idx'].dataType.simpleString()}, g array<double>")


def snp_stats(long: DataFrame) -> DataFrame:
    """Per feature: present calls, mean and allele frequency."""
    return long.groupBy("snp_idx").agg(F.count("dosage").alias("n_present"), F.avg("dosage").alias("mean_dosage"), (F.avg("dosage") / 2).alias("allele_freq"))


def monomorphic(long: DataFrame) -> DataFrame:
    """Statistics of the features without variation: those whose present calls are all 0 or all 2, or that have none. What embed.standardised leaves out."""
    p = F.coalesce("allele_freq", F.lit(0.0))
    return snp_stats(long).where((p <= 0) | (p >= 1))


def missing_fraction(long: DataFrame, by: str = "sample_idx") -> DataFrame:
    return long.groupBy(by).agg((F.count_if(F.col("dosage").isNull()) / F.count("*")).alias("missing_fraction"))


def impute(data: DataFrame, how: str | None) -> DataFrame:
    """Packed features with missing values replaced by the feature's mean ('mean'; a feature without any value is dropped), without features that miss any ('remove'), or as they are (None)."""
    none = F.exists("g", lambda v: v.isNull())
    if how is None:
        return data
    if how == "remove":
        return data.where(~none)
    if how != "mean":
        raise ConfigError(f"Unrecognized imputation method {how}: use 'mean', 'remove' or None.")
    data = data.withColumn("g", F.col("g").cast("array<double>"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.asarray(g, float) for g in pdf["g"]]
            there = [~np.isnan(g) for g in rows]
            some = np.array([t.any() for t in there], bool)
            filled = [np.where(t, g, g[t].mean()) for g, t, any_ in zip(rows, there, some, strict=True) if any_]
            yield pdf[some].assign(g=pd.Series(filled, index=pdf.index[some], dtype=object))

    return data.mapInPandas(fill, data.schema)  # a feature's mean is taken once, not once for each of its missing values


def impute_long(long: DataFrame, how: str | None) -> DataFrame:
    """The same on long rows, by windows and semi-joins over the feature's key."""
    if how is None:
        return long
    if how == "remove":
        whole = long.groupBy("snp_idx").agg(F.count_if(F.col("dosage").isNull()).alias("k")).where("k = 0")
        return long.join(whole, "snp_idx", "left_semi")
    if how != "mean":
        raise ConfigError(f"Unrecognized imputation method {how}: use 'mean', 'remove' or None.")
    mean = F.avg("dosage").over(Window.partitionBy("snp_idx"))
    return long.withColumn("_m", mean).where("_m is not null").withColumn("dosage", F.coalesce(F.col("dosage").cast("double"), "_m")).drop("_m")


def require_data(packed: DataFrame) -> DataFrame:
    if not packed.limit(1).count():
        raise WobbleError("No data left after imputation.")
    return packed


def require_complete(packed: DataFrame) -> DataFrame:
    if packed.where(F.exists("g", lambda v: v.isNull())).limit(1).count():
        raise WobbleError("Imputation method cannot be None if the data has missing values.")
    return packed


def require_genotypes(packed: DataFrame) -> DataFrame:
    """Only 0, 1, 2 and NULL."""
    if packed.where(F.exists("g", lambda v: v.isNotNull() & ~v.isin(0, 1, 2))).limit(1).count():
        raise WobbleError("Genotype data may only have the values 0, 1, 2 or be missing.")
    return packed


def deduplicate_snp_ids(draws: DataFrame) -> DataFrame:
    """draws: replicate_id, draw_pos, snp_id. The second and later draws of an id become id_r1, id_r2, ..."""
    k = F.row_number().over(Window.partitionBy("replicate_id", "snp_id").orderBy("draw_pos")) - 1
    return draws.withColumn("_k", k).withColumn("dedup_id", F.when(F.col("_k") > 0, F.concat("snp_id", F.lit("_r"), F.col("_k").cast("string"))).otherwise(F.col("snp_id"))).drop("_k")


def projected_samples(samples: DataFrame, populations: DataFrame | None) -> DataFrame:
    """Samples whose population isn't listed; none if there is no list."""
    if populations is None:
        return samples.limit(0)
    some = populations.limit(1).select(F.lit(1).alias("_some"))
    return samples.join(populations.select("population").distinct(), "population", "left_anti").join(some, F.lit(True), "left_semi")


def drop_ignored(samples: DataFrame) -> DataFrame:
    """Without samples of a population called ignore, in any case."""
    return samples.where(F.coalesce(F.lower("population"), F.lit("")) != "ignore")


def pad_missing(superset: DataFrame, embedding: DataFrame, k: int) -> DataFrame:
    """A row for every sample_id of superset; those without coordinates get zeros and the population _dummy."""
    zeros = F.array(*[F.lit(0.0)] * k)
    return superset.select("sample_id").join(embedding, "sample_id", "left").select("sample_id", F.coalesce("population", F.lit("_dummy")).alias("population"), F.coalesce("coords", zeros).alias("coords"))
