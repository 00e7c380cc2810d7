"""Sums over features of sample-by-sample matrices, for replicates that weigh features: partial sums per task, then one row of the matrix per group; in tiles where the matrix is too large for a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wobble.shared import written

#: Features are stacked to blocks of at most so many cells before a kernel sees them.
BLOCK_CELLS = 1 << 21
#: Samples on a side of a tile. Up to so many, a task adds whole matrices up.
TILE = 2048
#: Matrices that a task adds up before it emits them.
HELD_BYTES = 256 << 20
#: Up to so many features, a task holds all values of the samples of a block, see strips.
FEW_FEATURES = 1024
#: Samples of a block at most, and on a side of the tiles that a kernel sees there.
SIDE, INNER = 4096, 512
#: Bytes of a block's values at most, and pairs that a task emits at a time.
BLOCK_BYTES, EMITTED = 8 << 20, 1 << 18

#: (features x samples, features x other samples, weights of features) -> samples x other samples; NaN is missing. Where both sides are the same samples, they are the same array.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: A kernel that takes two blocks once: the same arguments -> a function of a slice of either side's samples that gives that tile.
Tiles = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[slice, slice], np.ndarray]]


def blocks(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """(features x samples with NaN for missing, the rows) of bounded size."""
    step = max(1, BLOCK_CELLS // max(1, n))
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            part = pdf.iloc[lo : lo + step]
            yield np.array([np.asarray(g, dtype=float) for g in part["g"]]).reshape(len(part), n), part


def summed(rows: DataFrame, keys: list[str], together: int = 64) -> DataFrame:
    """Adds up rows of equal keys elementwise. row: array<double>; the last key, an int, is the row's number, and that many neighbouring rows are summed in one call."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    *outer, i = keys

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number, place = np.unique(pdf[i].to_numpy(), return_inverse=True)
        total = np.zeros((len(number), len(pdf["row"].iloc[0])))
        for k, row in zip(place, pdf["row"], strict=True):
            total[k] += row
        out = {k: v for k, v in zip(outer, key, strict=False)}
        return pd.DataFrame({**{k: [v] * len(number) for k, v in out.items()}, i: number, "row": list(total)})[[*keys, "row"]]

    return rows.groupBy(*outer, F.floor(F.col(i) / together).alias("_block")).applyInPandas(add, f"{schema}, row array<double>")


def replicate_lists(weights: DataFrame) -> DataFrame:
    """(snp_idx, rs, ws): the replicates that have a feature, and its weights there."""
    return weights.groupBy("snp_idx").agg(F.collect_list("replicate_id").alias("rs"), F.collect_list("w").alias("ws"))


def by_replicate(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(replicate, places of its features in part, their weights)."""
    row = np.repeat(np.arange(len(part)), [len(r) for r in part["rs"]])
    rep = np.concatenate([np.asarray(r) for r in part["rs"]])
    w = np.concatenate([np.asarray(x, float) for x in part["ws"]])
    for r in np.unique(rep).tolist():
        of = rep == r
        yield r, row[of], w[of]


ROWS = "replicate_id int, name string, j0 int, i int, row array<double>"


def pair_sums(packed: DataFrame, n: int, kernels: dict[str, Kernel], weights: DataFrame | None = None, partials: int | None = None, tile: int | None = None) -> DataFrame:
    """ROWS: row i of each kernel's n x n matrix from column j0 on, summed over the features that a replicate has, by weight. weights: replicate_id, snp_idx, w; without them, replicate 0 has each feature once.

    Up to TILE samples, rows are whole: a task adds its features up before it emits n rows per kernel and replicate, so what is shuffled grows with tasks times n squared, not
    with features. partials: at most so many tasks (default: the session's parallelism times four). Beyond, see few_sums and tiled_sums: rows are parts, on and above the diagonal.
    """
    most = partials or 4 * packed.sparkSession.sparkContext.defaultParallelism
    if n > (tile or TILE):
        packed = written(packed.select("snp_idx", "g"))
        if packed.count() <= FEW_FEATURES:
            return few_sums(packed, n, kernels, weights, tile or INNER, most)
        return tiled_sums(packed, n, kernels, weights, tile or TILE, most)
    rows = packed.select("snp_idx", "g")
    rows = rows.join(replicate_lists(weights), "snp_idx") if weights is not None else rows.withColumns({"rs": F.array(F.lit(0)), "ws": F.array(F.lit(1.0))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, str], np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for (r, name), m in acc.items():
                yield pd.DataFrame({"replicate_id": np.int32(r), "name": name, "j0": np.int32(0), "i": np.arange(n, dtype=np.int32), "row": list(m)})
            acc.clear()

        for g, part in blocks(batches, n):
            for r, of, w in by_replicate(part):
                x = g[of]
                for name, kernel in kernels.items():
                    m = kernel(x, x, w)
                    if (r, name) not in acc and (len(acc) + 1) * m.nbytes > HELD_BYTES:
                        yield from flush()
                    acc[r, name] = acc[r, name] + m if (r, name) in acc else m
        yield from flush()

    return summed(rows.coalesce(most).mapInPandas(run, ROWS), ["replicate_id", "name", "j0", "i"])


def tiled_sums(packed: DataFrame, n: int, kernels: dict[str, Kernel], weights: DataFrame | None, tile: int, most: int) -> DataFrame:
    """pair_sums by tiles of the matrix, for as many samples as a feature's row can hold.

    Each feature is cut into runs of `tile` samples, and a run goes to every tile of the matrix that it is a side of. A tile's features come sorted, both sides next to each other, so a task
    holds one tile and one block of features, however many features or samples there are. Features of a tile are dealt to so many groups that all tiles together keep `most` tasks busy.
    """
    tiles = -(-n // tile)
    groups = max(1, -(-most // (tiles * (tiles + 1) // 2)))
    rows = packed.select("snp_idx", "g")
    rows = rows.join(weights.select("snp_idx", "replicate_id", "w"), "snp_idx") if weights is not None else rows.withColumns({"replicate_id": F.lit(0), "w": F.lit(1.0)})
    cut = rows.select("replicate_id", "snp_idx", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.slice("g", t * tile + 1, tile))).alias("t", "part"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o")
    sides = cut.select("replicate_id", "snp_idx", "w", "t", "part", other).select("replicate_id", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), F.pmod(F.xxhash64("snp_idx"), F.lit(groups)).cast("int").alias("grp"), "snp_idx", "t", "w", "part")
    key = ["replicate_id", "a", "b", "grp"]
    dealt = sides.repartition(*key).sortWithinPartitions(*key, "snp_idx", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        acc: dict[str, np.ndarray] = {}
        held: pd.DataFrame | None = None

        def flush() -> Iterator[pd.DataFrame]:
            for name, m in acc.items():
                for lo in range(0, len(m), 256):
                    hi = min(lo + 256, len(m))
                    yield pd.DataFrame({"replicate_id": np.int32(now[0]), "name": name, "j0": np.int32(now[2] * tile), "i": np.arange(now[1] * tile + lo, now[1] * tile + hi, dtype=np.int32), "row": list(m[lo:hi])})
            acc.clear()

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            bounds = [0, *(np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = pdf.iloc[lo:hi]
                k = tuple(part[key].iloc[0])
                if hi == len(pdf) and k[1] != k[2] and len(part) % 2:  # the last feature's other side comes in the next batch
                    held, part = part.iloc[-1:], part.iloc[:-1]
                if not len(part):
                    continue
                if k != now:
                    yield from flush()
                    now = k
                pair = 1 if k[1] == k[2] else 2
                step = pair * max(1, BLOCK_CELLS // (pair * tile))
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    x = np.array([np.asarray(v, float) for v in some["part"].iloc[::pair]])
                    y = x if pair == 1 else np.array([np.asarray(v, float) for v in some["part"].iloc[1::2]])
                    w = some["w"].to_numpy()[::pair]
                    for name, kernel in kernels.items():
                        m = kernel(x, y, w)
                        acc[name] = acc[name] + m if name in acc else m
        yield from flush()

    return summed(dealt.mapInPandas(run, ROWS), ["replicate_id", "name", "j0", "i"])


def strips(packed: DataFrame, n: int, side: int, labels: DataFrame | None = None) -> DataFrame:
    """(t, x): the samples from t * side on, `side` of them at most, with all their values: features (ascending) x samples, as bytes of doubles; NaN is missing. For few features and any number of samples. With labels (sample_idx, label), a column `labels` of theirs."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(-(-n // side) - 1)), lambda t: F.slice("g", t * side + 1, side))
    parts = packed.select("snp_idx", F.posexplode(cut).alias("t", "part"))

    def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in pdf.sort_values("snp_idx")["part"]])
        return pd.DataFrame({"t": [key[0]], "x": [x.tobytes()]})

    made = parts.groupBy("t").applyInPandas(stack, "t int, x binary")
    if labels is not None:
        of = labels.groupBy(F.floor(F.col("sample_idx") / side).cast("int").alias("t")).agg(F.sort_array(F.collect_list(F.struct("sample_idx", "label"))).alias("s"))
        made = made.join(of.select("t", F.col("s.label").alias("labels")), "t")
    return written(made, 1)


def unpacked(x: bytes, width: int) -> np.ndarray:
    """A block of strips, or of points, with so many rows."""
    return np.frombuffer(x).reshape(width, -1)


def weight_vectors(packed: DataFrame, weights: DataFrame | None) -> dict[int, np.ndarray]:
    """Weights of each replicate in order of the features, of which there are few."""
    snps = sorted(r.snp_idx for r in packed.select("snp_idx").collect())
    if weights is None:
        return {0: np.ones(len(snps))}
    place = pd.Series(range(len(snps)), index=snps)
    got = weights.select("replicate_id", "snp_idx", "w").toPandas()
    got = got[got["snp_idx"].isin(snps)]
    out = {}
    for r, pdf in got.groupby("replicate_id"):
        out[int(r)] = np.zeros(len(snps))
        np.add.at(out[int(r)], place[pdf["snp_idx"]].to_numpy(), pdf["w"].to_numpy(float))
    return out


def block_side(n: int, tile: int, most: int, width: int) -> int:
    """Samples of a block: a multiple of tile, up to SIDE and so many that their values, width each, take BLOCK_BYTES, fewer where pairs of blocks would not keep so many tasks busy."""
    wanted = -(-n // max(1, int(np.ceil(np.sqrt(2 * most)))))
    return max(1, min(SIDE, BLOCK_BYTES // (8 * max(1, width)), wanted) // tile) * tile


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b, x, y, ...) of each two blocks, a <= b: columns of the first named as they are, x, of the second y. blocks: written, a file each.

    A task reads two runs of blocks where they are written and pairs them, so no block is shuffled or copied, however many there are: disk grows with the blocks, not with their pairs."""
    extra = [c for c in blocks.columns if c not in ("t", "x")]
    one = blocks.select(F.col("t").alias("a"), "x", *extra)
    two = blocks.select(F.col("t").alias("b"), F.col("x").alias("y"), *[F.col(c).alias(f"{c}_b") for c in extra])
    return one.hint("shuffle_replicate_nl").join(two, F.col("a") <= F.col("b"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {c: batch.column(c)[at].as_py() for c in batch.schema.names}


def few_sums(packed: DataFrame, n: int, kernels: dict[str, Kernel], weights: DataFrame | None, tile: int, most: int) -> DataFrame:
    """pair_sums of few features by tiles: a task holds two blocks of samples with all their features, so a tile is whole when it is made, and nothing of the size of the matrix is shuffled or added up."""
    w = weight_vectors(packed, weights)
    features = len(next(iter(w.values()))) if w else 0
    side = block_side(n, tile, most, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            a, b = row["a"], row["b"]
            x = unpacked(row["x"], features)
            y = x if a == b else unpacked(row["y"], features)
            for r, v in w.items():
                of = v > 0
                xs, ys, ws = x[of], y[of], v[of]
                for lo in range(0, x.shape[1], tile):
                    for name, kernel in kernels.items():
                        u = np.ascontiguousarray(xs[:, lo : lo + tile])
                        for at in range(lo if a == b else 0, y.shape[1], tile):
                            m = kernel(u, u if a == b and at == lo else np.ascontiguousarray(ys[:, at : at + tile]), ws)
                            yield tile_rows(r, name, b * side + at, a * side + lo, m)

    return block_pairs(strips(packed, n, side)).mapInArrow(run, ROWS)


def pair_values(packed: DataFrame, n: int, kernel: Kernel, tiles: Tiles, weights: DataFrame | None = None, tile: int | None = None, finish: Callable[[Column], Column] = lambda d: d, **shown) -> DataFrame:
    """`shown` of a kernel's matrix above its diagonal. tiles gives what finish makes of the kernel's sums: few features of many samples go through it, others through pair_sums or tiled_sums."""
    if n > (tile or TILE):
        packed = written(packed.select("snp_idx", "g"))
        if packed.count() <= FEW_FEATURES:
            return few_values(packed, n, tiles, weights, tile, **shown)
        rows = tiled_sums(packed, n, {"d": kernel}, weights, tile or TILE, 4 * packed.sparkSession.sparkContext.defaultParallelism)
    else:
        rows = pair_sums(packed, n, {"d": kernel}, weights)
    return as_shown(upper(rows).withColumn("d", finish(F.col("d"))), weights is not None, **shown)


def as_shown(d: DataFrame, replicates: bool, digits: int | None = None, labels: DataFrame | None = None, names: tuple[str, str] = ("i", "j")) -> DataFrame:
    """(i, j, d) of pairs, or other names for i and j, with replicate_id in front if there are replicates; d is rounded if digits are named. With labels (sample_idx, label), they stand for i and j."""
    d = d.withColumnsRenamed({"i": "_i", "j": "_j"})
    if labels is None:
        d = d.withColumnsRenamed(dict(zip(("_i", "_j"), names, strict=True)))
    else:
        for at, name in zip(("_i", "_j"), names, strict=True):  # a label is sent to n squared rows
            d = d.join(F.broadcast(labels.select(F.col("sample_idx").alias(at), F.col("label").alias(name))), at)
    return d.select(*(["replicate_id"] if replicates else []), *names, "d" if digits is None else F.round("d", digits).alias("d"))


def few_values(packed: DataFrame, n: int, tiles: Tiles, weights: DataFrame | None, tile: int | None = None, digits: int | None = None, labels: DataFrame | None = None, names: tuple[str, str] = ("i", "j")) -> DataFrame:
    """as_shown of few features. What tasks emit are the rows as they are wanted: above the diagonal, rounded and labelled; NaN becomes NULL."""
    tile, most = tile or INNER, 4 * packed.sparkSession.sparkContext.defaultParallelism
    w = weight_vectors(packed, weights)
    features = len(next(iter(w.values()))) if w else 0
    side = block_side(n, tile, most, features)
    wide = max(1, EMITTED // tile**2) * tile
    replicates, labelled = weights is not None, labels is not None
    kind = labels.schema["label"].dataType.simpleString() if labelled else "int"
    shown = [*(["replicate_id"] if replicates else []), *names, "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            a, b = row["a"], row["b"]
            x, y = unpacked(row["x"], features), unpacked(row["y"], features)
            i, j = (np.arange(t * side, t * side + z.shape[1], dtype=np.int32) for t, z in ((a, x), (b, y)))
            one, two = (np.asarray(row["labels"]), np.asarray(row["labels_b"])) if labelled else (i, j)
            for r, v in w.items():
                xs = x[v > 0]
                made = tiles(xs, xs if a == b else y[v > 0], v[v > 0])
                for lo in range(0, len(i), tile):
                    for start in range(lo if a == b else 0, len(j), wide):
                        end = min(start + wide, len(j))
                        m = rounded(np.hstack([made(slice(lo, lo + tile), slice(at, at + tile)) for at in range(start, end, tile)]), digits)
                        some = i[lo : lo + tile, None] < j[None, start:end] if a == b and start < lo + tile else None
                        columns = cells(one[lo : lo + tile], two[start:end], m, some)
                        if replicates:
                            columns.insert(0, np.full(len(columns[0]), r, np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], shown)

    return block_pairs(strips(packed, n, side, labels)).mapInArrow(run, ("replicate_id int, " if replicates else "") + f"{names[0]} {kind}, {names[1]} {kind}, d double")


def cells(i: np.ndarray, j: np.ndarray, m: np.ndarray, some: np.ndarray | None) -> list[np.ndarray]:
    """(i, j, value) of a tile's cells, or of some of them, as columns."""
    columns = [np.repeat(i, len(j)), np.tile(j, len(i)), m.ravel()]
    return columns if some is None else [c[some.ravel()] for c in columns]


def rounded(m: np.ndarray, digits: int | None) -> np.ndarray:
    """As SQL rounds, half away from zero; numbers that have no such digits stay as they are."""
    if digits is None:
        return m
    k = 10.0**digits
    out = np.floor(np.abs(m) * k + 0.5) / k
    return np.where(np.abs(m) < 2**52 / k, np.copysign(out, m) + 0.0, m)


def few_totals(packed: DataFrame, n: int, kernel: Kernel, weights: DataFrame | None, codes: np.ndarray, groups: int) -> DataFrame:
    """(replicate_id, i, row): sums of the roots of a symmetric kernel's matrix over each two groups of samples, which codes number. Blocks as in few_sums, but tiles are added up where they are made."""
    most = 4 * packed.sparkSession.sparkContext.defaultParallelism
    w = weight_vectors(packed, weights)
    features = len(next(iter(w.values()))) if w else 0
    side = block_side(n, INNER, most, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        acc = {r: np.zeros((groups, groups)) for r in w}
        for row in _each(batches):
            a, b = row["a"], row["b"]
            x, y = unpacked(row["x"], features), unpacked(row["y"], features)
            for r, v in w.items():
                of = v > 0
                for lo in range(0, x.shape[1], INNER):
                    u = np.ascontiguousarray(x[of, lo : lo + INNER])
                    own = np.eye(groups)[codes[a * side + lo : a * side + lo + u.shape[1]]]
                    for at in range(lo if a == b else 0, y.shape[1], INNER):
                        z = u if a == b and at == lo else np.ascontiguousarray(y[of, at : at + INNER])
                        total = own.T @ np.sqrt(np.maximum(kernel(u, z, v[of]), 0)) @ np.eye(groups)[codes[b * side + at : b * side + at + z.shape[1]]]
                        acc[r] += total if z is u else total + total.T
        for r, m in acc.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"replicate_id": np.full(groups, r, np.int32), "i": np.arange(groups, dtype=np.int32), "row": list(m)}), preserve_index=False)

    return summed(block_pairs(strips(packed, n, side)).mapInArrow(run, "replicate_id int, i int, row array<double>"), ["replicate_id", "i"])


def tile_rows(r: int, name: str, j0: int, i0: int, m: np.ndarray) -> pa.RecordBatch:
    """ROWS of one tile."""
    h, wide = m.shape
    values = pa.ListArray.from_arrays(np.arange(0, h * wide + 1, wide, dtype=np.int32), np.ascontiguousarray(m).ravel())
    return pa.RecordBatch.from_arrays([pa.array(np.full(h, r, np.int32)), pa.array([name] * h), pa.array(np.full(h, j0, np.int32)), pa.array(np.arange(i0, i0 + h, dtype=np.int32)), values], ["replicate_id", "name", "j0", "i", "row"])


def point_pairs(points: DataFrame, between: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int | None = None, names: tuple[str, str, str] = ("a", "b", "value")) -> DataFrame:
    """(a, b, value), or other names, a < b, of each two points, rounded to so many digits if any are named. points: id long, x array<double>. between: (columns x points, columns x other points) -> a symmetric function's matrix. A task holds two blocks of points."""
    points = written(points.select("id", "x"))
    n, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return points.select("id", "id", F.lit(0.0)).toDF(*names)
    most = 4 * points.sparkSession.sparkContext.defaultParallelism
    t = -(-n // block_side(n, 1, most, width))

    def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"t": [key[0]], "x": [np.stack(pdf["x"].to_numpy()).T.tobytes()], "ids": [pdf["id"].to_numpy().tobytes()]})

    grouped = points.groupBy(F.pmod(F.xxhash64("id"), F.lit(t)).cast("int").alias("t")).applyInPandas(stack, "t int, x binary, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            x, y = unpacked(row["x"], width), unpacked(row["y"], width)
            ids, others = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids_b"], np.int64)
            for lo in range(0, len(ids), INNER):
                u = np.ascontiguousarray(x[:, lo : lo + INNER])
                for at in range(lo if row["a"] == row["b"] else 0, len(others), INNER):
                    m = rounded(between(u, np.ascontiguousarray(y[:, at : at + INNER])), digits)
                    i, j = ids[lo : lo + INNER], others[at : at + INNER]
                    i, j, v = cells(i, j, m, i[:, None] < j[None] if row["a"] == row["b"] and at == lo else None)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(v)], list(names))

    return block_pairs(written(grouped, 1)).mapInArrow(run, "{} long, {} long, {} double".format(*names))


def upper(rows: DataFrame, value: str = "d") -> DataFrame:
    """(replicate_id, i, j, value) for i < j of matrix rows."""
    return rows.select("replicate_id", "i", "j0", F.posexplode("row").alias("j", value)).select("replicate_id", "i", (F.col("j") + F.col("j0")).alias("j"), value).where("i < j")
