"""MinHash near-duplicates of whole documents by SetSketch registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .base import Scratch, lean, pieces
from .setsketch import estimate_reaches, registers, shingle_sets, word_hashes

BANDS, ROWS = 32, 5
#: Standard deviations of the estimate by which a pair may fall short of the threshold and still be compared exactly.
SLACK = 6.0


def sketches(docs: DataFrame, shingle: int, lower: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, cls (128-bit digest of the set, null if empty), sig (registers, a band's side by side)."""

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets, ends = shingle_sets(*word_hashes(b.column(1), lower), shingle)
            begin = np.concatenate([[0], ends]).astype(np.int64)
            regs = registers(sets, ends, bands * rows).astype("<u2")
            cls = [xxhash.xxh3_128_digest(sets[x:y]) if y > x else None for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(begin)), pa.array(cls, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n_shingles", "cls", "sig"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, cls binary, sig binary")


#: Stands for a null doc_id: the least long.
NULL_ID = -(2**63)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Documents link if 100 * |intersection| >= percent * |union| of their sets of word shingles (ASCII lower case with
    `lower`). Equal sets link; they are one class, represented by its least doc_id, before any search. Candidates come from 32 bands of 5 registers:
    at a similarity of 0.85, one link in 10**8 shares no band (0.8: one in 3 * 10**5); they are confirmed on the full sets.

    Null, empty and wordless texts have an empty set and link with nothing; fewer words than a shingle make one. Null
    doc_ids sort before all others. Rows of one doc_id are one document to the links, so copies under one id are all kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    s = scratch.keep(sketches(docs, shingle, lower))
    classes = scratch.keep(s.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))

    def possible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        t = percent / 100
        a, b = np.ascontiguousarray(x).view("<u2"), np.ascontiguousarray(y).view("<u2")
        ok = np.minimum(nx, ny) >= t * np.maximum(nx, ny) - 1e-9
        out = np.zeros(len(ok), bool)
        where = np.flatnonzero(ok)
        if len(where):
            out[where] = estimate_reaches(a[where], b[where], nx[where].astype(float), ny[where].astype(float), t - SLACK * np.sqrt(t * (1 - t) / a.shape[1]))
        return out

    def linked(shared: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        return 100 * shared >= percent * (nx + ny - shared)

    edges = near.candidate_edges(classes.select("node", "n", "sig"), BANDS, 2 * ROWS, possible, scratch)
    families = scratch.keep(near.components(edges, scratch))
    members = families.select("node", F.col("component").alias("family")).join(classes.select("node", "n", "cls"), "node")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("node"), "text")
    links = near.exact_links(members.select("family", "node", "n").join(texts, "node"), linked, scratch, near.text_sets(shingle, lower))
    comps = scratch.keep(near.components(links, scratch))
    reach = scratch.keep(classes.select("cls", "node").join(comps, "node", "left").select("cls", F.coalesce("component", "node").alias("component")))
    scratch.only(s, reach)
    out = s.drop("sig").join(reach, "cls", "left").withColumn("component", F.coalesce("component", "doc_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
