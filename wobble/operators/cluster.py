"""Clusters of embeddings: labels, and the number of clusters by cross-validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wobble.functions import linalg


def held_out_criteria(embedded: DataFrame, ks: list[int], folds: int = 5, seed: int = 42) -> DataFrame:
    """(replicate_id, k, fold, bic) of every embedding, number of clusters and fold: each fit is a row, so fits spread over the cluster."""
    spark = embedded.sparkSession
    grid = spark.createDataFrame([(k, f) for k in ks for f in range(folds)], "k int, fold int")
    rows = grid.join(embedded.select("replicate_id", "coords"), F.lit(True)).repartition(len(ks) * folds, "replicate_id", "k", "fold")  # a row of the grid for each fit

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, k, f, coords in zip(pdf["replicate_id"], pdf["k"], pdf["fold"], pdf["coords"], strict=True):
                x = np.stack([np.asarray(c, float) for c in coords])
                yield pd.DataFrame({"replicate_id": [r], "k": [k], "fold": [f], "bic": [linalg.held_out_bic(x, int(k), int(f), folds, seed)]})

    return rows.mapInPandas(fit, "replicate_id int, k int, fold int, bic double")


def best_k(embedded: DataFrame, n_populations: int, bounds: tuple[int, int] | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """(replicate_id, k) with the least mean criterion over the folds, of equal ones the least. Rows of an embedding are in order of their ids, and folds are neighbours in it."""
    n = embedded.agg(F.min(F.size("coords"))).first()[0]
    means = held_out_criteria(embedded, linalg.cluster_numbers(n, n_populations, bounds), folds, seed).groupBy("replicate_id", "k").agg(F.avg("bic").alias("bic"))
    return means.groupBy("replicate_id").agg(F.min_by("k", F.struct("bic", "k")).alias("k"))


def kmeans_labels(embedded: DataFrame, k: int) -> DataFrame:
    """(replicate_id, sample_id, cluster): one clustering per embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, ids, coords in zip(pdf["replicate_id"], pdf["sample_ids"], pdf["coords"], strict=True):
                x = np.stack([np.asarray(c, float) for c in coords])
                yield pd.DataFrame({"replicate_id": r, "sample_id": list(ids), "cluster": linalg.kmeans(x, min(k, len(x)))})

    return embedded.select("replicate_id", "sample_ids", "coords").mapInPandas(run, "replicate_id int, sample_id string, cluster int")
