"""Bootstrap batches with an early stop: the one incremental computation."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBSETS = 10


def converged(pairs: DataFrame, replicates: list[int], tolerance: float, seed: int = 42) -> bool:
    """Whether the mean stabilities of ten random halves of the replicates differ by at most the tolerance, relative to the first of each two.

    Means over pairs that are already compared: membership joined twice to the pair table.
    """
    spark = pairs.sparkSession
    rng = random.Random(seed)
    members = [(s, r) for s in range(SUBSETS) for r in rng.sample(sorted(replicates), len(replicates) // 2)]
    m = spark.createDataFrame(members, "subset int, r int")
    p = pairs.select("i", "j", "stability").join(m.select("subset", F.col("r").alias("i")), "i").join(m.select("subset", F.col("r").alias("j")), ["subset", "j"])
    means = p.groupBy("subset").agg(F.avg("stability").alias("s"))
    a, b = means.alias("a"), means.alias("b")
    gaps = a.join(b, F.col("a.subset") < F.col("b.subset")).select(F.round(F.abs(F.col("b.s") - F.col("a.s")) / (F.col("a.s") + 1e-6), 3).alias("g"))
    worst = gaps.agg(F.max("g")).first()[0]
    return worst is not None and worst <= tolerance


def batch_name(ids: Sequence[int]) -> str:
    return f"embeddings_{ids[0]}_{ids[-1]}"


def run_batches(n: int, batch: int, embed: Callable[[list[int]], DataFrame], compare: Callable[[DataFrame, list[int]], DataFrame], keep: Callable[[Callable[[], DataFrame], str], DataFrame], check: bool = True, tolerance: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(embeddings, pairs) of up to n replicates, batch by batch in order of their ids. After each batch but the last, stops if the replicates so far have converged. Only pairs with a new replicate are compared.
    keep writes the table that a function makes under a name, which tells the replicates that it holds, and reads it again, which cuts lineage between batches; a batch writes its own rows only."""
    embedded = pairs = None
    done: list[int] = []
    for lo in range(0, n, batch):
        ids = list(range(lo, min(n, lo + batch)))
        new = keep(partial(embed, ids), batch_name(ids))
        embedded = new if embedded is None else embedded.unionByName(new)
        fresh = keep(partial(compare, embedded, ids), f"pairs_{ids[0]}_{ids[-1]}")
        pairs = fresh if pairs is None else pairs.unionByName(fresh)
        done += ids
        if check and len(done) < n and len(done) >= 2 and converged(pairs, done, tolerance, seed):
            break
    return embedded, pairs
