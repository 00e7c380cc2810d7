"""A stability run: embed the data, embed replicates, compare all pairs, write results."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.config import RunConfig
from wobble.errors import ConfigError
from wobble.operators import cluster, compare, embed, genotype, resample
from wobble.ship import ship
from wobble.sources import genotypes as G
from wobble.streaming.convergence import batch_name, run_batches
from wobble.types import AnalysisMode, EmbeddingAlgorithm, FileFormat

from . import plotdata

log = logging.getLogger("wobble")


class StabilityRun:
    """Holds tables by name; embed(), replicates(), compare() and save() in this order, or all at once by run()."""

    def __init__(self, spark: SparkSession, config: RunConfig):
        config.check_settings()
        ship(spark)
        self.spark, self.config, self.began = spark, config, time.time()
        c = config
        prefix, self.content = c.dataset_prefix, None
        if c.file_format is not FileFormat.EIGENSTRAT:
            prefix = self._converted()
        self.prefix = prefix
        self.data = G.read_genotypes(spark, prefix)
        geno, snp, ind = G.filenames(prefix, FileFormat.EIGENSTRAT)
        self.n_snps = G.check_geno(spark, geno)
        n = G.check_ind(spark, ind)
        if G.check_snp(spark, snp) != self.n_snps:
            raise ConfigError("The genotype and SNP files differ in their number of SNPs.")
        if self.data.packed.where(F.size("g") != n).limit(1).count():
            raise ConfigError("The genotype file's lines don't have a call for each sample.")
        self.populations, whole = G.read_populations(spark, c.embedding_populations), self.data
        if c.embedding_algorithm is EmbeddingAlgorithm.MDS:
            self.data = self._without_ignored(n)
        samples = self.data.samples
        self.info = [(r.sample_id, r.population) for r in samples.orderBy("sample_idx").collect()]
        self.fit = None
        if self.populations is not None and c.embedding_algorithm is EmbeddingAlgorithm.PCA:
            listed = {r.population for r in self.populations.collect()}  # names of a list file
            self.fit = [i for i, (_, p) in enumerate(self.info) if p in listed]
            if len(self.fit) < 2:
                raise ConfigError("Fewer than two samples belong to the embedding populations.")
        self.n_populations = len({p for _, p in self.info})
        embedded = self.n_populations if c.embedding_algorithm is EmbeddingAlgorithm.MDS else len(self.info) if self.fit is None else len(self.fit)
        embed.check_components(c.n_components, self.n_snps, embedded)
        self.k = c.n_components
        self.content = self.content or G.content_digest(whole)
        self.fingerprint = self._fingerprint()

    #: Settings that no table depends on, and those whose files' content counts instead of their names.
    ANY = ("redo", "threads", "verbosity", "plot_results", "plot_dim_x", "plot_dim_y", "result_decimals", "support_value_rogue_cutoff", "keep_replicates", "convertf", "smartpca", "dataset_prefix", "result_dir", "file_format", "embedding_populations")

    def _fingerprint(self) -> str:
        """What the tables of a run depend on: the content of its inputs, wherever they are, and its settings."""
        listed = sorted(r.population for r in self.populations.collect()) if self.populations is not None else None  # names of a list file
        decided = None
        if self.config.analysis_mode is AnalysisMode.BOOTSTRAP:
            self.draws = resample.DrawStore(self.spark, self.tables("draws"), self.n_snps, self.config.path("bootstrap/bootstrap_*.ckp"))
            if self.draws.foreign is not None and not self.config.redo:
                rows = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("draw_pos", "snp_idx"))), lambda z: z["snp_idx"].cast("string")), ","), 256)
                decided = sorted(map(tuple, self.draws.foreign.groupBy("replicate_id", F.floor(F.col("draw_pos") / 4096).alias("b")).agg(rows).collect()))
        own = sorted((k, v) for k, v in self.config.as_mapping().items() if k not in self.ANY)
        return hashlib.sha256(repr((self.content, listed, decided, own)).encode()).hexdigest()[:16]

    def _converted(self) -> str:
        """The input as an EIGENSTRAT triple, made once for its content: a later run, or one with a copy of the input, finds it by its digest."""
        raw = G.read_genotypes(self.spark, self.config.dataset_prefix, self.config.file_format)
        data = G.Genotypes(raw.packed, G.clean_ids(raw.samples), raw.snps)
        self.content = G.content_digest(data)
        prefix = self.config.path(f"converted/{self.content[:16]}")
        if self.config.redo or not self._finished(G.filenames(prefix, FileFormat.EIGENSTRAT)[2]):  # the last of the three that are written
            G.write_eigenstrat(data, prefix)
        return prefix

    def _without_ignored(self, n: int) -> G.Genotypes:
        """The data without samples of the population Ignore, numbered anew."""
        kept = [r.sample_idx for r in genotype.drop_ignored(self.data.samples).select("sample_idx").orderBy("sample_idx").collect()]
        if len(kept) == n:
            return self.data
        place = F.create_map(*[F.lit(x) for i, s in enumerate(kept) for x in (s, i)])
        g = F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get("g", i))
        samples = self.data.samples.where(F.col("sample_idx").isin(kept)).withColumn("sample_idx", F.element_at(place, F.col("sample_idx")).cast("int"))
        return G.Genotypes(self.data.packed.withColumn("g", g), samples, self.data.snps)

    def tables(self, name: str) -> str:
        return self.config.path(f"tables/{name}")

    def keep(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """What make gives, as a table of this run's settings; one that an earlier run with the same settings finished is read instead, and nothing is made, unless redo is set."""
        path = self.tables(f"{self.fingerprint}/{name}")
        if self.config.redo or not self._finished(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _finished(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _embed(self, weights: DataFrame, name: str) -> DataFrame:
        if self.config.embedding_algorithm is EmbeddingAlgorithm.PCA:
            e, removed = embed.pca_without_outliers(self.data.packed, weights, self.info, self.k, self.config.outlier_rule(), fit=self.fit)
            self.keep(lambda: removed, f"{name}_removed")
            return e
        return embed.mds(self.data.packed, self.data.samples, self.k, weights=weights)

    def embed(self) -> DataFrame:
        one = self.spark.range(self.n_snps).select(F.lit(0).cast("int").alias("replicate_id"), F.col("id").alias("snp_idx"), F.lit(1.0).alias("w"))
        self.embedding = self.keep(lambda: self._embed(one, "embedding"), "embedding")
        self.kmeans_k = self.config.kmeans_k or self.keep(lambda: cluster.best_k(self.embedding, self.n_populations), "best_k").first().k
        return self.embedding

    def replicates(self) -> tuple[DataFrame, DataFrame]:
        c = self.config
        self.drawn = 0
        if c.analysis_mode is AnalysisMode.BOOTSTRAP:
            seeds = dict(enumerate(resample.replicate_seeds(c.seed, c.n_replicates)))

            def build(ids: list[int]) -> DataFrame:
                own = {i: seeds[i] for i in ids}
                self.drawn += self.draws.ensure(own, c.redo)
                return self._embed(self.draws.weights(own), batch_name(ids))

            batch, check = max(10, c.threads), c.bootstrap_convergence_check
        else:
            windows = resample.window_weights(self.spark, self.n_snps, c.n_replicates)
            build = lambda ids: self._embed(windows, batch_name(ids))
            batch, check = c.n_replicates, False
        e, p = run_batches(c.n_replicates, batch, build, lambda e, ids: compare.compare_pairs(e, self.kmeans_k, ids), self.keep, check, c.bootstrap_convergence_tolerance, c.seed)
        self.embeddings, self.pairs = e, p
        self.support = self.keep(lambda: compare.support_values(p, e), f"support_{e.count()}")
        done = [r.replicate_id for r in e.select("replicate_id").collect()]
        self.batches = [ids for lo in range(0, c.n_replicates, batch) if (ids := range(lo, min(c.n_replicates, lo + batch)))[0] in done]
        return e, p

    def run(self) -> dict[str, float]:
        Path(self.config.result_dir).mkdir(parents=True, exist_ok=True)
        Path(self.config.path("wobble.yaml")).write_text("# wobble settings\n" + yaml.safe_dump(self.config.as_mapping()))
        self.embed()
        log.info("embedded the data, %.0f s", time.time() - self.began)
        self.replicates()
        log.info("compared %d replicates, %.0f s", self.embeddings.count(), time.time() - self.began)
        return self.save()

    def save(self) -> dict[str, float]:
        """CSVs, the summary text and, if asked for, plots; the numbers of the summary."""
        c, d = self.config, self.config.result_decimals
        scores = compare.pair_scores(self.pairs).toPandas().sort_values(["i", "j"])
        scores.set_index("pair").rename_axis(None)[["stability", "cluster_stability"]].to_csv(c.path("wobble.replicates.csv"))
        self._csv(self.support, "wobble.supportValues.csv")
        projected = genotype.projected_samples(self.data.samples, self.populations)
        if self.populations is not None:
            self._csv(self.support.join(projected.select("sample_id"), "sample_id", "left_semi"), "wobble.supportValues.projected.csv")
        if c.embedding_algorithm is EmbeddingAlgorithm.PCA:
            self.outliers().toPandas().sort_values(["replicate_id", "round", "sample_id"], na_position="first").to_csv(c.path("wobble.outliers.csv"), index=False)
        s = compare.support_summary(self.support).first().asDict()
        out = {"stability": float(scores.stability.mean()), "cluster_stability": float(scores.cluster_stability.mean()), "n_replicates": self.embeddings.count(), **s}
        show = lambda k: "-" if out[k] is None or out[k] != out[k] else round(out[k], d)
        text = [f"Replicates: {out['n_replicates']}", f"Stability: {show('stability')}", f"Cluster stability: {show('cluster_stability')}", "", f"Support values: {show('mean')} ± {show('stdev')}, median {show('median')}, from {show('min')} to {show('max')}"]
        Path(c.path("wobble.txt")).write_text("\n".join(text) + "\n")
        if c.plot_results:
            self.plot()
        if c.keep_replicates:
            self.write_replicates()
        return out

    def outliers(self) -> DataFrame:
        """(replicate_id, round, sample_id, axis, deviation) of samples removed as outliers; replicate_id is null for the data themselves."""
        names = ["embedding", *map(batch_name, self.batches)]
        tables = [self.spark.read.parquet(self.tables(f"{self.fingerprint}/{n}_removed")) for n in names]
        out = tables[0].withColumn("replicate_id", F.lit(None).cast("int"))
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _csv(self, support: DataFrame, name: str) -> None:
        pdf = support.select("sample_id", "PSV").toPandas().sort_values("sample_id")
        pdf.set_index("sample_id").rename_axis(None).to_csv(self.config.path(name))

    def write_replicates(self) -> None:
        """Genotype files of each replicate that was embedded."""
        c, spark = self.config, self.spark
        ids = [r.replicate_id for r in self.embeddings.select("replicate_id").collect()]
        seeds = resample.replicate_seeds(c.seed, c.n_replicates)
        if c.analysis_mode is AnalysisMode.BOOTSTRAP:
            draws = self.draws.draws({i: seeds[i] for i in ids})
        for r in sorted(ids):
            if c.analysis_mode is AnalysisMode.BOOTSTRAP:
                g, snps, prefix = *resample.gather(self.data.packed, self.data.snps, draws.where(F.col("replicate_id") == r)), c.path(f"bootstrap/bootstrap_{r}")
            else:
                g, snps, prefix = *resample.window_slice(self.data.packed, self.data.snps, self.n_snps, c.n_replicates, r), c.path(f"windows/window_{r}")
            G.write_eigenstrat(G.Genotypes(g, self.data.samples, snps), prefix)

    def plot(self) -> None:
        c = self.config
        e = embed.per_sample(self.embedding)
        explained = self.embedding.first().explained
        dims = (c.plot_dim_x, c.plot_dim_y)
        plotdata.check_dimensions(len(explained), *dims)
        folder = Path(c.path("plots"))
        folder.mkdir(exist_ok=True)
        plots = {"populations": plotdata.populations(e, *dims), "clusters": plotdata.clusters(e, self.kmeans_k, *dims), "support_values": plotdata.support_values(e, self.support, c.support_value_rogue_cutoff, *dims)}
        if self.populations is not None:
            plots["projections"] = plotdata.projections(e, self.populations, *dims)
        for name, df in plots.items():
            (folder / f"{name}.html").write_text(plotdata.svg(df.toPandas(), name, explained, dims))
        for r in self.embeddings.select("replicate_id", "explained").collect():
            one = embed.per_sample(self.embeddings.where(F.col("replicate_id") == r.replicate_id))
            (folder / f"replicate_{r.replicate_id}.html").write_text(plotdata.svg(plotdata.populations(one, *dims).toPandas(), f"replicate {r.replicate_id}", r.explained, dims))
        # the two replicates that agree least, and the two that agree most
        for name, order in (("least", F.asc("stability")), ("most", F.desc("stability"))):
            pair = self.pairs.orderBy(order, "i", "j").first()
            if pair:
                points = plotdata.embedding_comparison(self.embeddings, pair.i, pair.j, self.support, c.support_value_rogue_cutoff, *dims)
                (folder / f"comparison_{name}_stable.html").write_text(plotdata.svg(points.toPandas(), f"replicates {pair.i} and {pair.j}", None, dims))

    def result_files(self) -> list[str]:
        """Files that this run leaves for its user, without its tables."""
        top = Path(self.config.result_dir)
        return sorted(str(f) for f in top.rglob("*") if f.is_file() and not f.name.startswith((".", "_")) and f.relative_to(top).parts[0] not in ("tables", "converted"))
