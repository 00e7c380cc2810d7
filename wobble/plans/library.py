"""The matrix interface: a numeric samples-by-features matrix, its embeddings and its replicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.errors import ConfigError, WobbleError
from wobble.operators import compare, embed, genotype, resample
from wobble.ship import ship
from wobble.streaming.convergence import run_batches
from wobble.types import EmbeddingAlgorithm


class MatrixDataset:
    """matrix: samples x features, a numpy array or a packed DataFrame (snp_idx from 0, g). missing: the value that stands for a missing one, besides NaN."""

    def __init__(self, spark: SparkSession, matrix: np.ndarray | DataFrame, sample_ids: Sequence[str], populations: Sequence[str], missing: float | None = None):
        ship(spark)
        if len(sample_ids) != len(populations):
            raise ConfigError("Provide a population for each sample.")
        if isinstance(matrix, np.ndarray):
            if len(matrix) != len(sample_ids):
                raise ConfigError("Provide a sample ID for each sample.")
            matrix = genotype.matrix_to_packed(spark, matrix, missing)
        if len(set(sample_ids)) != len(sample_ids):
            raise ConfigError("Duplicate sample ids.")
        self.spark, self.packed = spark, matrix
        self.names = [(str(s), str(p)) for s, p in zip(sample_ids, populations, strict=True)]
        self.n_features = matrix.count()
        self.samples = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(self.names)], "sample_idx int, sample_id string, population string")

    def _all(self) -> DataFrame:
        return self.spark.range(self.n_features).select(F.lit(0).cast("int").alias("replicate_id"), F.col("id").alias("snp_idx"), F.lit(1.0).alias("w"))

    def pca(self, k: int = 10, imputation: str | None = "mean") -> DataFrame:
        """One row of wobble.operators.embed.EMBEDDED."""
        return embed.pca(self.packed, self._all(), self.names, k, "matrix", imputation)

    def mds(self, k: int = 2, metric: str | Callable = "euclidean", imputation: str | None = "mean", by_population: bool | None = None) -> DataFrame:
        return embed.mds(self.packed, self.samples, k, metric, imputation, by_population=by_population)

    def _embed(self, weights: DataFrame, algorithm: EmbeddingAlgorithm, k: int, metric: str | Callable, imputation: str | None, by_population: bool | None) -> DataFrame:
        if algorithm is EmbeddingAlgorithm.PCA:
            # features are centred before they are weighted: a replicate's Gram matrix is a weighted sum of theirs
            return embed.pca(self.packed, weights, self.names, k, "matrix", imputation)
        return embed.mds(self.packed, self.samples, k, metric, imputation, weights, by_population)

    def bootstrap(self, keep: Callable[[DataFrame], DataFrame], n: int = 100, algorithm: EmbeddingAlgorithm = EmbeddingAlgorithm.PCA, k: int = 10, seed: int = 42, metric: str | Callable = "euclidean", imputation: str | None = "mean", check: bool = True, tolerance: float = 0.05, batch: int = 10, by_population: bool | None = None) -> "ReplicateComparison":
        """Embeddings of up to n bootstrap replicates, compared; stops early once converged. keep writes a table and reads it again; it may be given replicates again in another call."""
        seeds = resample.replicate_seeds(seed, n)
        build = lambda ids: self._embed(resample.bootstrap_weights(self.spark, self.n_features, {i: seeds[i] for i in ids}), algorithm, k, metric, imputation, by_population)
        return ReplicateComparison(*run_batches(n, max(10, batch), build, lambda e, ids: compare.compare_pairs(e, only_with=ids), lambda make, name: keep(make()), check, tolerance, seed))

    def windows(self, n: int = 100, algorithm: EmbeddingAlgorithm = EmbeddingAlgorithm.PCA, k: int = 10, metric: str | Callable = "euclidean", imputation: str | None = "mean", by_population: bool | None = None) -> "ReplicateComparison":
        e = self._embed(resample.window_weights(self.spark, self.n_features, n), algorithm, k, metric, imputation, by_population)
        return ReplicateComparison(e)


class ReplicateComparison:
    """Three embeddings or more, compared pair by pair."""

    def __init__(self, embedded: DataFrame, pairs: DataFrame | None = None):
        self.embedded = embedded
        self.n = embedded.count()
        if self.n < 3:
            raise WobbleError("At least three embeddings are needed.")
        self.pairs = compare.compare_pairs(embedded) if pairs is None else pairs

    def stability(self) -> float:
        return self.pairs.agg(F.avg("stability")).first()[0]

    def cluster_stability(self, kmeans_k: int) -> float:
        return compare.compare_pairs(self.embedded, kmeans_k).agg(F.avg("cluster_stability")).first()[0]

    def support_values(self) -> DataFrame:
        return compare.support_values(self.pairs, self.embedded)
