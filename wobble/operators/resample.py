"""Replicates of the features: bootstrap draws as multiplicities, and sliding windows."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.errors import ConfigError, WobbleError

from .genotype import deduplicate_snp_ids


def replicate_seeds(seed: int, n: int) -> list[int]:
    """A seed for each replicate, as Python's generator draws them."""
    rng = random.Random(seed)
    return [rng.randint(0, 1_000_000) for _ in range(n)]


def bootstrap_draws(spark: SparkSession, n_snps: int, seeds: dict[int, int]) -> DataFrame:
    """(replicate_id, seed, draw_pos, snp_idx): n_snps draws with replacement for each replicate, drawn where the replicate's task runs."""
    ids = spark.createDataFrame(sorted(seeds.items()), "replicate_id int, seed long").repartition(len(seeds), "replicate_id")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, s in zip(pdf["replicate_id"], pdf["seed"], strict=True):
                drawn = random.Random(int(s)).choices(range(n_snps), k=n_snps)
                yield pd.DataFrame({"replicate_id": r, "seed": s, "draw_pos": range(n_snps), "snp_idx": drawn})

    return ids.mapInPandas(draw, "replicate_id int, seed long, draw_pos long, snp_idx long")


def bootstrap_weights(spark: SparkSession, n_snps: int, seeds: dict[int, int]) -> DataFrame:
    """(replicate_id, snp_idx, w): how often each feature was drawn. All later statistics are weighted sums, so nothing is resampled."""
    ids = spark.createDataFrame(sorted(seeds.items()), "replicate_id int, seed long").repartition(len(seeds), "replicate_id")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, s in zip(pdf["replicate_id"], pdf["seed"], strict=True):
                c = Counter(random.Random(int(s)).choices(range(n_snps), k=n_snps))
                yield pd.DataFrame({"replicate_id": r, "snp_idx": list(c), "w": [float(x) for x in c.values()]})

    return ids.mapInPandas(draw, "replicate_id int, snp_idx long, w double")


class DrawStore:
    """Bootstrap draws on disk, told apart by what decides them: the number of features and the seed. A draw is looked for before it is made, in any run that names the folder, whatever its other settings.

    A draw is rows of CHUNK places, so it has no bound on features. One that isn't whole, as a task or a run was lost, is made anew. checkpoints: a path, or a pattern, of text files bootstrap_<replicate>.ckp that hold
    `seed;i0, i1, ...` as other tools write them; such a file decides its replicate's draw, whatever the seed.
    """

    CHUNK = 1 << 16

    def __init__(self, spark: SparkSession, folder: str, n_snps: int, checkpoints: str | None = None):
        self.spark, self.n_snps, self.path = spark, n_snps, f"{folder}/features={n_snps}"
        self.foreign = self._foreign(checkpoints) if checkpoints and self._there(checkpoints) else None
        self.decided = {r.replicate_id for r in self.foreign.select("replicate_id").distinct().collect()} if self.foreign is not None else set()

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))

    def _foreign(self, path: str) -> DataFrame:
        """(replicate_id, seed, draw_pos, snp_idx) of text checkpoints; all must draw as many features as there are, from these."""
        line = F.split(F.trim("value"), ";", 2)
        files = self.spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"bootstrap_(\d+)\.ckp$", 1).try_cast("int").alias("replicate_id"), line[0].try_cast("long").alias("seed"), F.get(line, F.lit(1)).alias("drawn"))
        out = files.select("replicate_id", "seed", F.posexplode_outer(F.split("drawn", r"\s*,\s*")).alias("draw_pos", "i")).select("replicate_id", "seed", F.col("draw_pos").cast("long").alias("draw_pos"), F.trim("i").try_cast("long").alias("snp_idx"))
        bad = F.col("snp_idx").isNull() | (F.col("snp_idx") < 0) | (F.col("snp_idx") >= self.n_snps) | F.col("seed").isNull()
        wrong = out.groupBy("replicate_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).where((F.col("n") != self.n_snps) | (F.col("bad") > 0) | F.col("replicate_id").isNull()).limit(1).collect()
        if wrong:
            raise ConfigError(f"{path}: the checkpoint of replicate {wrong[0].replicate_id} doesn't draw {self.n_snps} features from as many.")
        return out

    def whole(self, seeds: Sequence[int]) -> set[int]:
        """Which of the seeds have a whole draw here."""
        if not self._there(self.path):
            return set()
        rows = self._table().where(F.col("seed").isin(list(seeds))).groupBy("seed").agg(F.sum(F.size("drawn")).alias("n"), F.count_distinct("chunk").alias("chunks"))
        return {r.seed for r in rows.collect() if (r.n, r.chunks) == (self.n_snps, -(-self.n_snps // self.CHUNK))}

    def _table(self) -> DataFrame:
        return self.spark.read.schema("chunk int, drawn array<long>, seed long").parquet(self.path)

    def ensure(self, seeds: dict[int, int], anew: bool = False) -> int:
        """Makes the draws of replicates' seeds that aren't here; how many these were. anew: all of them, and text checkpoints decide nothing any more."""
        if anew:
            self.foreign, self.decided = None, set()
        wanted = sorted({s for r, s in seeds.items() if r not in self.decided})
        missing = sorted(set(wanted) - (set() if anew else self.whole(wanted)))
        if missing:
            n, size = self.n_snps, self.CHUNK

            def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for s in pdf["seed"]:
                        drawn = random.Random(int(s)).choices(range(n), k=n)
                        for c in range(0, n, size):
                            yield pd.DataFrame({"chunk": [c // size], "drawn": [drawn[c : c + size]], "seed": [s]})

            ids = self.spark.createDataFrame([(s,) for s in missing], "seed long").repartition(len(missing), "seed")
            ids.mapInPandas(draw, "chunk int, drawn array<long>, seed long").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed").parquet(self.path)
        return len(missing)

    def draws(self, seeds: dict[int, int]) -> DataFrame:
        """(replicate_id, seed, draw_pos, snp_idx) of replicates whose draws are here."""
        own = [(r, s) for r, s in sorted(seeds.items()) if r not in self.decided]
        out = None
        if own:
            of = self.spark.createDataFrame(own, "replicate_id int, seed long")
            stored = self._table().where(F.col("seed").isin([s for _, s in own])).join(of, "seed")
            out = stored.select("replicate_id", "seed", "chunk", F.posexplode("drawn").alias("at", "snp_idx")).select("replicate_id", "seed", (F.col("chunk").cast("long") * self.CHUNK + F.col("at")).alias("draw_pos"), "snp_idx")
        if self.foreign is not None:
            other = self.foreign.where(F.col("replicate_id").isin(list(seeds)))
            out = other if out is None else out.unionByName(other)
        return out

    def weights(self, seeds: dict[int, int]) -> DataFrame:
        """(replicate_id, snp_idx, w) of the same."""
        return self.draws(seeds).groupBy("replicate_id", "snp_idx").agg(F.count("*").cast("double").alias("w"))


def window_bounds(n_snps: int, n_windows: int) -> tuple[int, int]:
    """(stride, size) of overlapping windows."""
    stride, overlap = int(n_snps / n_windows), int((n_snps / n_windows) / 2)
    if stride < 1:
        raise WobbleError(f"{n_windows} windows can't be cut from {n_snps} features.")
    return stride, stride + overlap


def windows(snps: DataFrame, n_snps: int, n_windows: int) -> DataFrame:
    """snps with window_id: each feature once for each of the one or two windows that hold it; those past the last window in none."""
    stride, size = window_bounds(n_snps, n_windows)
    lo = F.greatest(F.lit(0), F.ceil((F.col("snp_idx") - size + 1) / stride)).cast("int")
    hi = F.least(F.lit(n_windows - 1), F.floor(F.col("snp_idx") / stride)).cast("int")
    return snps.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def window_weights(spark: SparkSession, n_snps: int, n_windows: int) -> DataFrame:
    """(replicate_id, snp_idx, w) of windows as replicates."""
    return windows(spark.range(n_snps).select(F.col("id").alias("snp_idx")), n_snps, n_windows).select(F.col("window_id").alias("replicate_id"), "snp_idx", F.lit(1.0).alias("w"))


def gather(packed: DataFrame, snps: DataFrame, draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and SNPs of one replicate as data of its own: a row per draw, in draw order, repeated ids told apart. Only for writing replicates out; statistics use weights."""
    d = draws.select("replicate_id", F.col("draw_pos").alias("_pos"), "snp_idx")
    g = d.join(packed, "snp_idx").select(F.col("_pos").alias("snp_idx"), "g")
    named = d.join(snps, "snp_idx").select("replicate_id", F.col("_pos").alias("draw_pos"), "snp_id", *[c for c in snps.columns if c not in ("snp_idx", "snp_id")])
    named = deduplicate_snp_ids(named).withColumn("snp_id", F.col("dedup_id")).drop("dedup_id", "replicate_id").withColumnRenamed("draw_pos", "snp_idx")
    return g, named


def window_slice(packed: DataFrame, snps: DataFrame, n_snps: int, n_windows: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Features and SNPs of one window, numbered from 0."""
    stride, size = window_bounds(n_snps, n_windows)
    lo = window * stride
    cut = lambda df: df.where((F.col("snp_idx") >= lo) & (F.col("snp_idx") < lo + size)).withColumn("snp_idx", F.col("snp_idx") - lo)
    return cut(packed), cut(snps)


def write_checkpoint(draws: DataFrame, path: str) -> None:
    """Draws as a table by replicate."""
    draws.write.mode("overwrite").partitionBy("replicate_id").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("replicate_id").cast("int").alias("replicate_id"), "seed", "draw_pos", "snp_idx")


def checkpoint_line(draws: DataFrame, replicate: int) -> str:
    """One replicate's draws in the text form `seed;i0, i1, ...`."""
    rows = draws.where(F.col("replicate_id") == replicate).orderBy("draw_pos").select("seed", "snp_idx").collect()
    return f"{rows[0].seed};" + ", ".join(str(r.snp_idx) for r in rows)


def parse_checkpoint_line(spark: SparkSession, line: str, replicate: int = 0) -> DataFrame:
    seed, _, idx = line.strip().partition(";")
    rows = [(replicate, int(seed), k, int(i)) for k, i in enumerate(idx.split(","))]
    return spark.createDataFrame(rows, "replicate_id int, seed long, draw_pos long, snp_idx long")
