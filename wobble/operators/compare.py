"""Comparison of replicates: alignment of all pairs, stability, cluster stability and support values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wobble.errors import WobbleError
from wobble.functions import linalg
from wobble.shared import written

from .pairs import summed

PAIRS = "i int, j int, disparity double, stability double, cluster_stability double, clipped boolean, sample_ids array<string>, difference array<double>"
#: Replicates per block: a task aligns all pairs of two blocks, so an embedding is shipped once per block, not once per pair.
BLOCK = 8
#: Samples of a block's embeddings together. Where one has more, blocks are smaller, down to one embedding, so tasks are more and hold less.
BLOCK_SAMPLES = 1 << 16


class Compared:
    """Two embeddings on their shared samples, aligned, with rows of unit length."""

    def __init__(self, ids_a: list[str], a: np.ndarray, ids_b: list[str], b: np.ndarray):
        at = {s: k for k, s in enumerate(ids_b)}
        both = [(s, k, at[s]) for k, s in enumerate(ids_a) if s in at]
        self.ids = [s for s, _, _ in both]
        self.clipped = len(both) <= 0.8 * len(ids_a) or len(both) <= 0.8 * len(ids_b)
        if not both:
            raise WobbleError("No samples left for comparison after clipping.")
        k = max(a.shape[1], b.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, k - m.shape[1]))) for m in (a[[p for _, p, _ in both]], b[[q for _, _, q in both]]))
        ref, comp, self.disparity = linalg.procrustes(x, y)
        self.reference, self.comparable = linalg.normalise_rows(ref), linalg.normalise_rows(comp)

    def stability(self) -> float:
        return linalg.stability(self.disparity)

    def difference(self) -> np.ndarray:
        return np.linalg.norm(self.reference - self.comparable, axis=1)

    def cluster_stability(self, k: int) -> float:
        return linalg.fowlkes_mallows(linalg.kmeans(self.reference, k), linalg.kmeans(self.comparable, k))


def compare_pairs(embedded: DataFrame, kmeans_k: int | None = None, only_with: list[int] | None = None, block: int | None = None) -> DataFrame:
    """PAIRS of all replicates i < j. With only_with, just pairs that hold one of these replicates: what a new batch adds.

    One alignment gives stability, cluster stability (if kmeans_k is given) and each shared sample's difference. A pair whose shared samples
    are 80 % or less of either side's is marked clipped.
    """
    if block is None:
        n = embedded.agg(F.max(F.size("sample_ids"))).first()[0] or 1
        block = max(1, min(BLOCK, BLOCK_SAMPLES // n))
    e = embedded.select("replicate_id", "sample_ids", "coords").withColumn("b", F.floor(F.col("replicate_id") / block).cast("int"))
    ids = e.select("b").distinct()
    lo, hi = ids.select(F.col("b").alias("p")), ids.select(F.col("b").alias("q"))
    tasks = lo.join(hi, F.col("p") <= F.col("q"))  # of blocks, not of replicates
    if only_with is not None:
        fresh = sorted({i // block for i in only_with})
        tasks = tasks.where(F.col("p").isin(fresh) | F.col("q").isin(fresh))  # pairs of old blocks aren't shipped
    shipped = e.join(tasks, (e.b == F.col("p")) | (e.b == F.col("q"))).select("p", "q", "replicate_id", "sample_ids", "coords")
    new = None if only_with is None else set(only_with)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        rows = {int(r): (list(s), np.stack([np.asarray(c, float) for c in x])) for r, s, x in zip(pdf["replicate_id"], pdf["sample_ids"], pdf["coords"], strict=True)}
        out = []
        for i in sorted(rows):
            for j in sorted(rows):
                if i < j and (i // block, j // block) == (p, q) and (new is None or i in new or j in new):
                    c = Compared(*rows[i], *rows[j])
                    out.append((i, j, c.disparity, c.stability(), c.cluster_stability(kmeans_k) if kmeans_k else None, c.clipped, c.ids, c.difference()))
        return pd.DataFrame(out, columns=["i", "j", "disparity", "stability", "cluster_stability", "clipped", "sample_ids", "difference"])

    return shipped.groupBy("p", "q").applyInPandas(run, PAIRS)


def shared_stabilities(rows: DataFrame, replicates: int, k: int) -> DataFrame:
    """(i, j, stability) of each two replicates that all have the same samples, for any number of them. rows: x array<double>, a sample's coordinates in replicate 0, then in 1, and so on, k in each.

    An alignment is decided by products of the centred coordinates, summed over samples: tasks and driver hold (replicates times k) squared numbers, no embedding."""
    spark, width = rows.sparkSession, replicates * k
    rows = written(rows.select("x"))

    def stacked(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                yield np.stack(pdf["x"].iloc[lo : lo + 4096].to_numpy())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in stacked(batches):
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()]})

    parts = rows.mapInPandas(sums, "n long, s array<double>").select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg((F.sum("s") / F.sum("n")).alias("mean")).orderBy("at").collect()
    if not parts:
        raise WobbleError("No samples left for comparison after clipping.")
    mean = np.array([r["mean"] for r in parts])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for x in stacked(batches):
            total += (x - mean).T @ (x - mean)
        yield pd.DataFrame({"i": np.arange(width, dtype=np.int32), "row": list(total)}).assign(one=np.int32(0))[["one", "i", "row"]]

    got = summed(rows.mapInPandas(products, "one int, i int, row array<double>"), ["one", "i"]).toPandas().sort_values("i")
    m = np.stack(got["row"].to_numpy()).reshape(replicates, k, replicates, k)
    size = np.sqrt([np.trace(m[r, :, r]) for r in range(replicates)])
    if (size == 0).any():
        raise WobbleError("An embedding whose points all coincide can't be aligned.")
    out = [(i, j, linalg.stability(1 - float(np.linalg.svd(m[j, :, i], compute_uv=False).sum() / (size[i] * size[j])) ** 2)) for i in range(replicates) for j in range(i + 1, replicates)]
    return spark.createDataFrame(out, "i int, j int, stability double")


def row_norm(coords: str) -> Column:
    """Euclidean length of a sample's coordinates."""
    return F.sqrt(F.aggregate(coords, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """(pair, stability, cluster_stability) as the results file lists them: a row for each pair that has either score."""
    a, b = pairs.where("stability is not null").select("i", "j", "stability"), pairs.where("cluster_stability is not null").select("i", "j", "cluster_stability")
    return a.join(b, ["i", "j"], "full").select(F.format_string("(%d, %d)", "i", "j").alias("pair"), "i", "j", "stability", "cluster_stability")


def support_values(pairs: DataFrame, embedded: DataFrame) -> DataFrame:
    """(sample_id, PSV, n_present): one minus a Gini coefficient of the sample's aligned places. Replicates without the sample count as zero vectors in the norms and add no difference."""
    n = F.lit(1.0) * embedded.count()
    diff = pairs.select(F.explode(F.arrays_zip("sample_ids", "difference")).alias("z")).groupBy(F.col("z.sample_ids").alias("sample_id")).agg((2 * F.sum("z.difference")).alias("d"))
    norm = row_norm("z.coords")
    there = embedded.select(F.explode(F.arrays_zip("sample_ids", "coords")).alias("z")).groupBy(F.col("z.sample_ids").alias("sample_id")).agg(F.count("*").alias("n_present"), F.sum(F.when(norm > 0, 1.0).otherwise(0.0)).alias("norms"))
    return there.join(diff, "sample_id", "left").select("sample_id", (1 - F.coalesce("d", F.lit(0.0)) / (2 * n * F.col("norms") + 1e-6)).alias("PSV"), "n_present")


def support_summary(support: DataFrame) -> DataFrame:
    return support.agg(F.min("PSV").alias("min"), F.max("PSV").alias("max"), F.avg("PSV").alias("mean"), F.median("PSV").alias("median"), F.stddev_samp("PSV").alias("stdev"))


def fowlkes_mallows(labels: DataFrame) -> DataFrame:
    """Index of two labelings a, b by contingency counts; one row (fmi)."""
    cells = labels.groupBy("a", "b").agg(F.count("*").alias("c"))
    n = cells.agg((F.sum(F.col("c") * F.col("c")) - F.sum("c")).alias("t"), F.sum("c").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("q2"))
    cols = cells.groupBy("b").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("p2"))
    one = n.join(rows, F.lit(True)).join(cols, F.lit(True))  # a row each
    return one.select(F.when(F.col("t") == 0, 0.0).otherwise(F.sqrt(F.col("t") / (F.col("p2") - F.col("n"))) * F.sqrt(F.col("t") / (F.col("q2") - F.col("n")))).alias("fmi"))


def stability_2d(pairs: DataFrame) -> DataFrame:
    """Stability of aligned pairs of two-dimensional embeddings, in closed form. pairs: i, j, x1, y1, x2, y2, a row for each shared sample.

    With M the cross product of the centred, scaled matrices, the sum of its singular values squared is |M|^2 + 2 |det M|."""
    m = pairs.groupBy("i", "j").agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")], F.count("*").alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in (("x1", "x1"), ("y1", "y1"), ("x2", "x2"), ("y2", "y2"), ("x2", "x1"), ("x2", "y1"), ("y2", "x1"), ("y2", "y1"))],
    )
    c = lambda a, b: F.col(f"s_{a}{b}") - F.col("n") * F.col(f"m_{a}") * F.col(f"m_{b}")
    scale = (c("x1", "x1") + c("y1", "y1")) * (c("x2", "x2") + c("y2", "y2"))
    frob = F.pow(c("x2", "x1"), 2) + F.pow(c("x2", "y1"), 2) + F.pow(c("y2", "x1"), 2) + F.pow(c("y2", "y1"), 2)
    det = c("x2", "x1") * c("y2", "y1") - c("x2", "y1") * c("y2", "x1")
    return m.select("i", "j", F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (frob + 2 * F.abs(det)) / scale))).alias("stability"))
