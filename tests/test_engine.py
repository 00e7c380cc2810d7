"""The stability engine: formats, imputation, distances, resampling, embeddings, comparison, runs."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wobble.config import RunConfig, load_config
from wobble.errors import ConfigError, WobbleError
from wobble.functions import linalg
from wobble.operators import cluster, compare, distance, embed, genotype, pairs, resample
from wobble.plans import plotdata
from wobble.plans.run import StabilityRun
from wobble.sources import genotypes as G
from wobble.sources import packed
from wobble.sources.lines import numbered_lines
from wobble.sources.results import read_evec, read_fst
from wobble.streaming.convergence import converged
from wobble.types import AnalysisMode, EmbeddingAlgorithm, FileFormat

# A 5 x 7 genotype matrix, its individuals, its first two principal components and eigenvalues.
GENO = "11100 01212 21101 00122 21100 00111 22110".split()
IND = [("SAMPLE0", "F", "Pop1"), ("SAMPLE1", "M", "Pop2"), ("SAMPLE2", "F", "Pop3"), ("SAMPLE3", "M", "Pop4"), ("SAMPLE4", "F", "Pop4")]
SNP = ["m1 3 0.11 1200 T C", "m2 3 0.25 3400 C G", "m3 3 0.4 5600 G A", "m4 3 0.52 9100 A T", "m5 3 0.7 12000 T G", "m6 3 0.83 15500 C A", "m7 3 0.97 21000 A G"]
EVEC = np.array([[-0.6493, -0.0942], [-0.3599, -0.0754], [0.0780, 0.6092], [0.3980, -0.7286], [0.5333, 0.2890]])
EVAL = [3.144925, 0.479073, 0.278742, 0.097261]
# A 5 x 40 genotype matrix cut to ten windows, some of the 45 pairs' scores and the means of all.
WINDOWED = "20121 01021 02101 21000 10200 10000 12110 21020 00221 12022 20112 11211 20201 02120 22200 10212 01211 01122 22000 00101 10202 11022 01112 10221 11101 22011 10121 21002 02220 02111 21202 20120 22202 12011 21002 21022 01002 00202 20102 22111".split()
PAIR_SCORES = {(0, 1): (0.6711483643165574, 0.5), (0, 7): (0.8077393663661293, 0.25), (1, 4): (0.9165422867103808, 0.25), (2, 6): (0.801618308191487, 1.0)}

MATRIX = np.array([[int(c) for c in row] for row in GENO], float).T


@pytest.fixture
def prefix(tmp_path):
    (tmp_path / "ex.geno").write_text("\n".join(GENO) + "\n")
    (tmp_path / "ex.ind").write_text("".join(f"  {a}  {b}   {c}\n" for a, b, c in IND))
    (tmp_path / "ex.snp").write_text("\n".join(SNP) + "\n")
    return str(tmp_path / "ex")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = out[r.j, r.i] = np.nan if r.d is None else r.d
    return out


def cells(df):
    return {r.snp_idx: list(r.g) for r in df.collect()}


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "t").write_text("\n".join(str(i) for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert numbered_lines(spark, str(tmp_path / "t")).where("idx <> cast(value as long)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reading_and_checks(spark, prefix, tmp_path):
    g = G.read_genotypes(spark, prefix)
    assert cells(g.packed) == {i: [float(c) for c in row] for i, row in enumerate(GENO)}
    assert [(r.sample_id, r.sex, r.population) for r in g.samples.orderBy("sample_idx").collect()] == IND
    assert [r.snp_id for r in g.snps.orderBy("snp_idx").collect()] == [s.split()[0] for s in SNP]
    assert G.check_geno(spark, prefix + ".geno") == 7 and G.check_ind(spark, prefix + ".ind") == 5 and G.check_snp(spark, prefix + ".snp") == 7
    for name, text, check in (("a", "0125\n", G.check_geno), ("b", "01\n012\n", G.check_geno), ("c", "x F p\nx M p\n", G.check_ind), ("d", "x F\n", G.check_ind), ("e", "a 1 2\n", G.check_snp), ("f", "a 1 2 3\na 1 2 3\n", G.check_snp)):
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigError):
            check(spark, str(tmp_path / name))
    (tmp_path / "pops").write_text("Pop1\n Pop2\nPop3\n")
    p = G.read_populations(spark, str(tmp_path / "pops"))
    assert sorted(r.sample_id for r in genotype.projected_samples(g.samples, p).collect()) == ["SAMPLE3", "SAMPLE4"]
    assert genotype.projected_samples(g.samples, None).count() == 0 and genotype.projected_samples(g.samples, p.limit(0)).count() == 0


def test_formats_round_trip(spark, prefix, tmp_path):
    g = G.read_genotypes(spark, prefix)
    missing = g.packed.withColumn("g", F.transform("g", lambda v, i: F.when((F.col("snp_idx") == 2) & (i == 1), None).otherwise(v)))
    data = G.Genotypes(missing, g.samples, g.snps)
    want = cells(missing)
    for fmt, write in ((FileFormat.EIGENSTRAT, G.write_eigenstrat), (FileFormat.PED, G.write_ped), (FileFormat.ANCESTRYMAP, G.write_ancestrymap)):
        out = str(tmp_path / fmt.value)
        write(data, out)
        back = G.read_genotypes(spark, out, fmt)
        assert cells(back.packed) == want, fmt
        assert [r.sample_id for r in back.samples.orderBy("sample_idx").collect()] == [i[0] for i in IND]
    n = len(IND)
    codes = {0.0: 3, 1.0: 2, 2.0: 0, None: 1}
    bed = b"\x6c\x1b\x01" + b"".join(bytes(sum(codes[v] << (2 * k) for k, v in enumerate(row[b : b + 4])) for b in range(0, n, 4)) for _, row in sorted(want.items()))
    (tmp_path / "p.bed").write_bytes(bed)
    (tmp_path / "p.fam").write_text("".join(f"{k} {i[0]} 0 0 1 {i[2]}\n" for k, i in enumerate(IND)))
    (tmp_path / "p.bim").write_text("".join(f"11 {s.split()[0]} 0.0 1 {s[-3:]}\n" for s in SNP))
    assert cells(G.read_genotypes(spark, str(tmp_path / "p"), FileFormat.PACKEDPED).packed) == want
    packed = b"GENO 5 7".ljust(48, b"\0") + b"".join(bytes(sum((3 if v is None else int(v)) << (6 - 2 * k) for k, v in enumerate(row[b : b + 4])) for b in range(0, n, 4)).ljust(48, b"\0") for _, row in sorted(want.items()))
    (tmp_path / "q.geno").write_bytes(packed)
    (tmp_path / "q.ind").write_text("".join(f"fam:{a} {b} {c}\n" for a, b, c in IND))
    (tmp_path / "q.snp").write_text("\n".join(SNP) + "\n")
    G.convert(spark, str(tmp_path / "q"), FileFormat.PACKEDANCESTRYMAP, str(tmp_path / "conv"))
    back = G.read_genotypes(spark, str(tmp_path / "conv"))
    assert cells(back.packed) == want and [r.sample_id for r in back.samples.orderBy("sample_idx").collect()] == [i[0] for i in IND]


ROUTE = "EA EP EB EK AP AE PE BE KE AB AK PA BA KA PB PK BP KP BK KB"


def test_every_conversion(spark, prefix, tmp_path):
    """All twenty ordered pairs of formats, in one walk over them."""
    kinds = dict(zip("EAPBK", (FileFormat.EIGENSTRAT, FileFormat.ANCESTRYMAP, FileFormat.PED, FileFormat.PACKEDANCESTRYMAP, FileFormat.PACKEDPED), strict=True))
    g = G.read_genotypes(spark, prefix)
    missing = g.packed.withColumn("g", F.transform("g", lambda v, i: F.when((F.col("snp_idx") == 2) & (i == 1), None).otherwise(v)))
    want, pairs_left, at, here = cells(missing), {tuple(p) for p in ROUTE.split()}, "E", str(tmp_path / "0")
    assert len(pairs_left) == 20
    G.write_eigenstrat(G.Genotypes(missing, g.samples, g.snps), here)
    trail = []
    def walk(v):  # Hierholzer's circuit
        while (nxt := [b for a, b in sorted(pairs_left) if a == v]):
            pairs_left.discard((v, nxt[0]))
            walk(nxt[0])
        trail.append(v)
    walk("E")
    trail.reverse()
    assert len(trail) == 21 and len(set(zip(trail, trail[1:], strict=False))) == 20
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for k, (a, b) in enumerate(zip(trail, trail[1:], strict=False)):
        here = G.convert(spark, here, kinds[a], str(tmp_path / f"c{k}"), kinds[b])
        if k % 4 == 3:
            back = G.read_genotypes(spark, here, kinds[b])
            assert cells(back.packed) == want, (a, b)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.sample_id, r.sex, r.population) for r in back.samples.orderBy("sample_idx").collect()] == IND
    assert [(r.snp_id, r.ref, r.alt) for r in back.snps.orderBy("snp_idx").collect()] == [(s.split()[0], *s.split()[-2:]) for s in SNP]


def test_packed_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    for layout, n in (("bed", 9), ("packed", 9), ("packed", 401)):
        g = rng.choice([0.0, 1.0, 2.0, np.nan], (500, n))
        rows = [(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)]
        df = spark.createDataFrame(rows, "snp_idx long, g array<double>").repartition(5)
        path, head = str(tmp_path / f"{layout}{n}"), b"h" * packed.LAYOUTS[layout].head(n)
        packed.write_packed(df, path, layout, n, 500, head)
        assert cells(packed.read_packed(spark, path, layout, n)) == dict(rows)
        part = spark.read.format("packed_genotypes").options(layout=layout, samples=n, first=3, last=490, range_bytes=900).load(path)
        assert part.rdd.getNumPartitions() == -(-488 // max(1, 900 // packed.LAYOUTS[layout].width(n))) and cells(part) == dict(rows[3:491])
        assert cells(packed._whole_file(spark, path, packed.LAYOUTS[layout], n)) == dict(rows)
        # bad input leaves neither a file nor a part of one, and the old file stays
        before = sorted(p.name for p in tmp_path.iterdir())
        for bad in (df.where("snp_idx <> 7"), df.union(df.where("snp_idx = 7")), df.withColumn("snp_idx", F.col("snp_idx") + 1), df.withColumn("g", F.transform("g", lambda v: v + 1)), df.withColumn("g", F.slice("g", 1, n - 1))):
            with pytest.raises(Exception, match="numbered|number|packed|calls"):
                packed.write_packed(bad, path, layout, n, 500, head)
            assert sorted(p.name for p in tmp_path.iterdir()) == before
        assert cells(packed.read_packed(spark, path, layout, n)) == dict(rows)
    packed.write_packed(df.where("1 = 0"), str(tmp_path / "none"), "bed", 4, 0, b"\x6c\x1b\x01")
    assert (tmp_path / "none").read_bytes() == b"\x6c\x1b\x01" and packed.read_packed(spark, str(tmp_path / "none"), "bed", 4).count() == 0
    with pytest.raises(Exception, match="whole records"):
        packed.read_packed(spark, str(tmp_path / "bed9"), "bed", 28).count()


def test_large_packed_file(spark, tmp_path):
    """A sparse file of 3 GB: many ranges, and its last records without the others."""
    n, m = 400_000, 30_000
    width = n // 4
    with open(tmp_path / "large.bed", "wb") as f:
        f.write(b"\x6c\x1b\x01")
        f.seek(3 + width * m - 1)
        f.write(b"\xff")
    df = packed.read_packed(spark, str(tmp_path / "large.bed"), "bed", n)
    assert df.rdd.getNumPartitions() == -(-m // (packed.RANGE_BYTES // width))
    last = packed.read_packed(spark, str(tmp_path / "large.bed"), "bed", n, first=m - 2).select("snp_idx", F.size("g").alias("n"), F.element_at("g", 1).alias("a"), F.element_at("g", -1).alias("z"))
    assert sorted(map(tuple, last.collect())) == [(m - 2, n, 2.0, 2.0), (m - 1, n, 2.0, 0.0)]


def test_a_failed_task_writes_again(tmp_path):
    """In a session that retries tasks: the first attempt of each task fails after it has written some records."""
    script = f"""
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from wobble.sources import packed
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def fail(batches):
    for k, b in enumerate(batches):
        if k and not TaskContext.get().attemptNumber():
            raise RuntimeError("lost")
        yield b
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
rows = spark.range(200).selectExpr("id as snp_idx", "array(id % 3, null, 2) as g").selectExpr("snp_idx", "cast(g as array<double>) as g")
spark.dataSource.register(packed.PackedGenotypes)
broken = rows.repartitionByRange(2, "snp_idx").mapInPandas(fail, rows.schema)
broken.write.format("packed_genotypes").options(layout="bed", samples=3, snps=200, header="6c1b01").mode("overwrite").save({str(tmp_path / "x")!r})
got = packed.read_packed(spark, {str(tmp_path / "x")!r}, "bed", 3).orderBy("snp_idx").collect()
assert [(r.snp_idx, r.g) for r in got] == [(i, [float(i % 3), None, 2.0]) for i in range(200)]
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=200, cwd=Path(__file__).parents[1])
    assert done.returncode == 0, done.stderr[-2000:]
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_checksum_of_ids(spark):
    def by_hand(names):
        out = 0
        for s in names:
            own = 0
            for c in s:
                own = (own * 23 + ord(c)) & 0xFFFFFFFF
            out = (out * 17 & 0xFFFFFFFF) ^ own
        return out

    names = [f"rs{i * 7919}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(names)), "i long, s string").repartition(4)
    assert G.ids_hash(df, "i", "s") == by_hand(names) and G.ids_hash(df.limit(0), "i", "s") == 0


def test_imputation(spark):
    nan = np.nan
    m = np.array([[nan, 1, 1], [2, nan, 2], [3, 3, 3]])
    p = genotype.matrix_to_packed(spark, m)
    assert [v for _, v in sorted(cells(genotype.impute(p, "mean")).items())] == [[2.5, 2, 3], [1, 2, 3], [1, 2, 3]]
    assert cells(genotype.impute(p, "remove")) == {2: [1, 2, 3]}
    gone = genotype.matrix_to_packed(spark, np.array([[nan, 1], [nan, 2]]))
    assert cells(genotype.impute(gone, "mean")) == {1: [1, 2]}
    with pytest.raises(WobbleError, match="No data left"):
        genotype.require_data(genotype.impute(genotype.matrix_to_packed(spark, np.array([[nan], [1]])), "remove"))
    with pytest.raises(WobbleError):
        genotype.require_complete(p)
    with pytest.raises(ConfigError):
        genotype.impute(p, "other")
    with pytest.raises(ConfigError):
        genotype.matrix_to_packed(spark, np.array([["a"]]))
    coded = genotype.matrix_to_packed(spark, np.array([[0, 1], [2, 0]]), 0)
    assert cells(coded) == {0: [None, 2], 1: [1, None]}
    long = genotype.to_long(p)
    assert cells(genotype.to_packed(genotype.impute_long(long, "mean"), 3)) == cells(genotype.impute(p, "mean"))
    assert genotype.impute_long(long, "remove").count() == 3


def test_distances(spark):
    m = MATRIX.copy()
    p = genotype.matrix_to_packed(spark, m)
    d2 = ((m[:, None] - m[None]) ** 2).sum(2)
    assert np.allclose(dense(distance.euclidean(p, 5), 5), np.sqrt(d2))
    want = np.array([[0, 3, 7, 10, 11], [3, 0, 4, 7, 8], [7, 4, 0, 5, 4], [10, 7, 5, 0, 3], [11, 8, 4, 3, 0]], float)  # fixed values, by hand
    assert np.allclose(dense(distance.hamming(p, 5), 5), want) and np.allclose(dense(distance.manhattan(p, 5), 5), want)
    for at in ((0, 6), (1, 4), (1, 5), (2, 3), (2, 4)):
        m[at] = np.nan
    want = np.array([[0, 3.5, 7, 10.5, 10.5], [3.5, 0, 3.5, 7, 8.4], [7, 3.5, 0, 4.2, 2.8], [10.5, 7, 4.2, 0, 3], [10.5, 8.4, 2.8, 3, 0]])  # fixed values, by hand
    assert np.allclose(dense(distance.corrected_hamming(genotype.matrix_to_packed(spark, m), 5), 5), want)
    many = np.random.default_rng(1).normal(size=(4, 30))
    assert np.allclose(dense(distance.manhattan(genotype.matrix_to_packed(spark, many), 4), 4), np.abs(many[:, None] - many[None]).sum(2))
    none = np.array([[1, np.nan], [np.nan, 1]])
    assert np.isnan(dense(distance.corrected_hamming(genotype.matrix_to_packed(spark, none), 2), 2)[0, 1])
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(MATRIX)], "sample_idx int, x array<double>")
    own = distance.column_metric(x, lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v))
    assert np.allclose(dense(own, 5), np.abs(MATRIX[:, None] - MATRIX[None]).sum(2))


def test_populations_and_fst(spark):
    p = genotype.matrix_to_packed(spark, MATRIX)
    s = spark.createDataFrame([(i, f"S{i}", "Case" if i < 2 else "Control") for i in range(5)], "sample_idx int, sample_id string, population string")
    assert distance.fst_from_packed(p, s).first().fst == pytest.approx(0.41509, abs=1e-5)  # fixed value
    d = np.abs(MATRIX[:, None] - MATRIX[None]).sum(2)
    r = distance.population_distance(distance.manhattan(p, 5), s).first()
    assert (r.p1, r.p2) == ("Case", "Control") and r.d == pytest.approx(d[:2, 2:].mean())
    with pytest.raises(WobbleError):
        distance.fst_from_packed(genotype.matrix_to_packed(spark, MATRIX + 2), s)
    e = embed.mds(p, s, 1).first()
    assert len(e.coords) == 5 and e.coords[0] == e.coords[1] != e.coords[2]
    assert embed.mds(p, s, 2, "euclidean").first().sample_ids == [f"S{i}" for i in range(5)]
    assert embed.mds(p, s, 1, "manhattan_population", "mean").count() == 1


def test_resampling(spark):
    assert resample.replicate_seeds(42, 3) == [670487, 116739, 26225]  # fixed values of Python's generator
    d = {r.draw_pos: r.snp_idx for r in resample.bootstrap_draws(spark, 7, {0: 0}).collect()}
    assert [d[i] for i in range(7)] == [5, 5, 2, 1, 3, 2, 5] == random.Random(0).choices(range(7), k=7)
    w = {r.snp_idx: r.w for r in resample.bootstrap_weights(spark, 7, {0: 0}).collect()}
    assert w == {5: 3, 2: 2, 1: 1, 3: 1}
    snps = lambda k: spark.range(k).select(F.col("id").alias("snp_idx"))
    for k, n in ((7, 3), (40, 10), (200, 7), (13, 13), (101, 10)):
        stride, size = resample.window_bounds(k, n)
        got = sorted((r.window_id, r.snp_idx) for r in resample.windows(snps(k), k, n).collect())
        assert got == [(x, i) for x in range(n) for i in range(x * stride, min(k, x * stride + size))]
    assert resample.window_bounds(7, 3) == (2, 3)
    with pytest.raises(WobbleError):
        resample.window_bounds(3, 4)
    ids = spark.createDataFrame([(0, i, "snp_id") for i in range(5)], "replicate_id int, draw_pos int, snp_id string")
    assert [r.dedup_id for r in genotype.deduplicate_snp_ids(ids).orderBy("draw_pos").collect()] == ["snp_id", *[f"snp_id_r{k}" for k in range(1, 5)]]


def whole(spark, n):
    return spark.range(n).select(F.lit(0).cast("int").alias("replicate_id"), F.col("id").alias("snp_idx"), F.lit(1.0).alias("w"))


def test_genotype_pca(spark):
    names = [(i[0], i[2]) for i in IND]
    e = embed.pca(genotype.matrix_to_packed(spark, MATRIX), whole(spark, 7), names, 2).first()
    x = np.array(e.coords)
    assert np.allclose(np.abs(x), np.abs(EVEC), atol=1e-4) and np.allclose(e.explained, np.array(EVAL[:2]) / sum(EVAL), atol=1e-4)
    with pytest.raises(ConfigError):
        embed.pca(genotype.matrix_to_packed(spark, MATRIX), whole(spark, 7), names, 8)


def without_outliers(g, w, k, rule, fit):
    """Plain numpy: rounds of removal, then coordinates of who is left. g: features x samples."""
    live, report = list(range(g.shape[1])), []
    for n in range(rule.rounds + 1):
        making = [i for i in live if i in fit]
        p = np.nanmean(g[:, making], 1) / 2
        ok = (p > 0) & (p < 1)
        m = np.nan_to_num((g[ok][:, live] - 2 * p[ok, None]) / np.sqrt(p * (1 - p))[ok, None]) * np.sqrt(w[ok])[:, None]
        at = [live.index(i) for i in making]
        values, x = np.linalg.eigh(m[:, at].T @ m[:, at])
        values, x = values[::-1], x[:, ::-1]
        far = np.abs(x[:, : rule.axes] - x[:, : rule.axes].mean(0)) / x[:, : rule.axes].std(0, ddof=1)
        out = [(making[i], int(far[i].argmax()), far[i].max()) for i in range(len(making)) if far[i].max() > rule.sigma]
        if n == rule.rounds or not out:
            whole = m.T @ m[:, at] @ x[:, :k] / values[:k]
            whole[at] = x[:, :k]
            return live, whole, values[:k] / values.sum(), report
        report += [(n + 1, *o) for o in out]
        live = [i for i in live if i not in {o[0] for o in out}]


def test_outliers_leave_round_by_round(spark):
    rng = np.random.default_rng(7)
    n, m, k = 40, 300, 3
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[:60, 5], g[60:, 5] = 2, 0  # one sample far out, a second that shows once the first is gone, one that isn't in fit
    g[:, :30] = np.where(rng.random((m, 30)) < 0.9, np.minimum(g[:, :30], 1), g[:, :30])
    g[:150, 11] = 2
    g[:200, 39] = 2
    g[rng.random((m, n)) < 0.02] = np.nan
    packed = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(3)
    w = rng.integers(0, 4, (2, m)).astype(float)
    weights = spark.createDataFrame([(r, i, float(w[r, i])) for r in range(2) for i in range(m) if w[r, i]], "replicate_id int, snp_idx long, w double")
    samples = [(f"s{i:02d}", "x") for i in range(n)]
    for rule in (embed.OutlierRule(5, 4, 3.0), embed.OutlierRule(1, 2, 2.5), embed.OutlierRule(0, 4, 0.1)):
        for fit in (list(range(n)), list(range(36))):
            e, removed = embed.pca_without_outliers(packed, weights, samples, k, rule, fit=None if len(fit) == n else fit)
            rows, gone = {r.replicate_id: r for r in e.collect()}, removed.collect()
            assert sorted(rows) == [0, 1]
            for r in range(2):
                live, x, share, report = without_outliers(g, w[r], k, rule, fit)
                assert rows[r].sample_ids == [f"s{i:02d}" for i in live] and np.allclose(rows[r].explained, share)
                got = np.array(rows[r].coords)
                assert np.allclose(np.abs((got * x).sum(0)), np.sqrt((got**2).sum(0) * (x**2).sum(0))) and np.allclose(np.abs(got), np.abs(x), atol=1e-8)
                mine = sorted((z.round, z.sample_id, z.axis, round(z.deviation, 6)) for z in gone if z.replicate_id == r)
                assert mine == sorted((a, f"s{b:02d}", c, round(float(v), 6)) for a, b, c, v in report)
                assert bool(report) == (rule.rounds > 0)
    with pytest.raises(Exception, match="too few"):
        embed.pca_without_outliers(packed, weights, samples, k, embed.OutlierRule(3, 4, 0.01))


def test_subspace_is_that_of_the_dense_problem(spark):
    rng = np.random.default_rng(4)
    n, m, k = 70, 240, 4
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[:, :20] = np.where(rng.random((m, 20)) < 0.5, 2, g[:, :20])
    g[:100, 20:35] = 0
    g[rng.random((m, n)) < 0.03] = np.nan
    g[:40, 66] = 2
    packed_ = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(3)
    weights = spark.createDataFrame([(r, i, float(w)) for r in range(3) for i, w in enumerate(rng.integers(0, 4, m)) if w], "replicate_id int, snp_idx long, w double")
    samples = [(f"s{i:02d}", "x") for i in range(n)]
    for flavour in ("genotype", "matrix"):
        for fit, gone, rule in ((None, None, None), (list(range(5, 60)), {1: [7, 66], 2: [0]}, embed.OutlierRule(1, 3, 2.5))):
            args = (packed_, weights, samples, k, flavour, fit, gone, rule)
            a, b = ({r.replicate_id: r for r in embed.embed_replicates(*args, dense=d).collect()} for d in (n, n - 1))
            assert sorted(a) == sorted(b) == [0, 1, 2]
            for r in a:
                x, y = np.array(a[r].coords), np.array(b[r].coords)
                assert a[r].sample_ids == b[r].sample_ids and np.allclose(a[r].explained, b[r].explained, atol=1e-9)
                assert np.abs(x - y).max() < 1e-6 * np.abs(x).max()
                q, p = np.linalg.qr(x)[0], np.linalg.qr(y)[0]
                assert np.linalg.norm(q - p @ (p.T @ q), 2) < 1e-6  # sine of the largest angle
                if rule:
                    assert [(z.sample, z.axis) for z in a[r].removed] == [(z.sample, z.axis) for z in b[r].removed]
    flat = spark.createDataFrame([(0, [1.0] * 30), (1, [0.0, 2.0] * 15)], "snp_idx long, g array<double>")  # of rank one
    one = embed.embed_subspace(flat, spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "replicate_id int, snp_idx long, w double"), samples[:30], 2, "matrix").first()
    assert np.allclose(one.explained, [1, 0]) and np.allclose(np.abs(np.array(one.coords)[:, 0]), 1)


def test_tiles_are_the_whole(spark):
    rng = np.random.default_rng(6)
    n, m = 23, 57
    g = rng.choice([0.0, 1.0, 2.0, np.nan], (m, n), p=[0.4, 0.3, 0.2, 0.1])
    packed_ = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(4)
    w = rng.integers(0, 3, (2, m))
    weights = spark.createDataFrame([(r, i, float(w[r, i])) for r in range(2) for i in range(m) if w[r, i]], "replicate_id int, snp_idx long, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # so that batches end between a feature's sides
    try:
        kernels = {"a": distance.absolute, "b": distance.both_present}
        for tile, by in ((5, weights), (22, weights), (8, None)):
            got = {(r.replicate_id, r.name, r.i, r.j): r.d for r in pairs.pair_sums(packed_, n, kernels, by, tile=tile).transform(lambda m: pairs_with_names(m)).collect()}
            assert len(got) == (2 if by is not None else 1) * 2 * n * (n - 1) // 2
            for (r, name, i, j), d in got.items():
                v = np.ones(m) if by is None else w[r]
                both = ~np.isnan(g[:, i]) & ~np.isnan(g[:, j])
                assert d == pytest.approx((v * both).sum() if name == "b" else (v * np.nan_to_num(np.abs(g[:, i] - g[:, j]))).sum())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_few_features_of_many_samples(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n, m, k = 90, 24, 3
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[:, :30] = np.where(rng.random((m, 30)) < 0.6, 2, g[:, :30])
    g[rng.random((m, n)) < 0.03] = np.nan
    g[:12, 66] = 2
    packed_ = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(3)
    weights = spark.createDataFrame([(r, i, float(w)) for r in range(3) for i, w in enumerate(rng.integers(0, 4, m)) if w], "replicate_id int, snp_idx long, w double")
    samples = [(f"s{i:02d}", "x") for i in range(n)]
    for flavour in ("genotype", "matrix"):
        for fit, gone, rule in ((None, None, None), (list(range(5, 80)), {1: [7, 66], 2: [8]}, embed.OutlierRule(1, 3, 2.5))):
            args = (packed_, weights, samples, k, flavour, fit, gone, rule)
            monkeypatch.setattr(embed, "DENSE", n)
            whole_ = {r.replicate_id: r for r in embed.embed_replicates(*args).collect()}
            monkeypatch.setattr(embed, "DENSE", n - 1)
            monkeypatch.setattr(embed, "gram_times", None)  # no pass sends samples times components numbers to the driver
            for made in (embed.embed_replicates, embed.embed_subspace):
                got = {r.replicate_id: r for r in made(*args).collect()}
                assert sorted(got) == sorted(whole_) == [0, 1, 2]
                for r, want in whole_.items():
                    assert got[r].sample_ids == want.sample_ids and np.allclose(got[r].explained, want.explained) and np.allclose(got[r].coords, want.coords, atol=1e-9)
                    if rule:
                        assert [(z.sample, z.axis) for z in got[r].removed] == [(z.sample, z.axis) for z in want.removed]


def test_population_means_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(22)
    n, m = 41, 18
    g = rng.choice([0.0, 1.0, 2.0, np.nan], (m, n), p=[0.4, 0.3, 0.2, 0.1])
    packed_ = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(3)
    weights = spark.createDataFrame([(r, i, float(1 + (i + r) % 3)) for r in range(2) for i in range(m) if (i + r) % 5], "replicate_id int, snp_idx long, w double")
    s = spark.createDataFrame([(i, f"s{i}", "CAB"[i * i % 3]) for i in range(n)], "sample_idx int, sample_id string, population string")
    for metric in ("manhattan", "euclidean"):
        for w in (None, weights):
            want = {tuple(r)[:-1]: r.d for r in distance.population_distance(distance.SAMPLE_METRICS[metric](packed_, n, "mean", w), s).collect()}
            with monkeypatch.context() as few:
                few.setattr(distance, "TILE", 8)
                few.setattr(pairs, "INNER", 8)
                few.setattr(distance, "population_distance", None)  # no rows of pairs
                got = {tuple(r)[:-1]: r.d for r in distance.population_means(packed_, n, s, metric, "mean", w).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_stabilities_from_sums(spark):
    x = np.random.default_rng(24).normal(5, 1, (60, 4, 3))
    rows = spark.createDataFrame([([float(v) for v in r.ravel()],) for r in x], "x array<double>").repartition(3)
    got = {(r.i, r.j): r.stability for r in compare.shared_stabilities(rows, 4, 3).collect()}
    assert got == {(i, j): pytest.approx(linalg.stability(linalg.procrustes(x[:, i], x[:, j])[2])) for i in range(4) for j in range(i + 1, 4)}


def test_cells_find_their_places(spark):
    long = spark.createDataFrame([(5, 2, 1.0), (5, 0, 2.0), (7, 1, None), (7, 3, 0.0)], "snp_idx long, sample_idx int, dosage double")
    p = genotype.to_packed(long, 4)
    assert cells(p) == {5: [2, None, 1, None], 7: [None, None, None, 0]}
    assert "element_at" not in p._jdf.queryExecution().optimizedPlan().toString()  # which looks a feature's samples through for each of them
    with pytest.raises(Exception, match="several values"):
        genotype.to_packed(long.union(long), 4).collect()


def test_a_mean_is_taken_once(spark):
    p = genotype.impute(genotype.matrix_to_packed(spark, np.array([[1, np.nan, np.nan], [np.nan, np.nan, 4], [2, np.nan, 6]])), "mean")
    assert cells(p) == {0: [1, 1.5, 2], 2: [5, 4, 6]}
    assert "aggregate(" not in p._jdf.queryExecution().optimizedPlan().toString()  # the optimizer put the mean into the lambda, for each missing value


def test_all_pairs_of_points(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(50, 3))
    points = spark.createDataFrame([(3 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    monkeypatch.setattr(pairs, "INNER", 4)
    got = {(r.a, r.b): r.value for r in pairs.point_pairs(points, lambda a, b: a.T @ b).collect()}
    assert len(got) == 50 * 49 // 2 and all(a < b and got[a, b] == pytest.approx(x[a // 3] @ x[b // 3]) for a, b in got)
    assert pairs.point_pairs(points.limit(0), lambda a, b: a.T @ b).count() == 0
    g = rng.integers(0, 3, (12, 30)).astype(float)
    packed_ = genotype.matrix_to_packed(spark, g.T)
    s = spark.createDataFrame([(i, f"s{i:02d}", "x") for i in range(30)], "sample_idx int, sample_id string, population string")
    whole_ = embed.mds(packed_, s, 5, "euclidean", "mean").first()
    monkeypatch.setattr(embed, "DENSE", 10)
    monkeypatch.setattr(embed, "principal_coordinates", None)  # no matrix of distances
    few = embed.mds(packed_, s, 5, "euclidean", "mean").first()
    assert few.sample_ids == whole_.sample_ids and np.allclose(few.explained, whole_.explained) and np.allclose(few.coords, whole_.coords, atol=1e-6)


def test_few_features_make_whole_tiles(spark, monkeypatch):
    rng = np.random.default_rng(16)
    n, m = 37, 21
    g = rng.choice([0.0, 1.0, 2.0, np.nan], (m, n), p=[0.4, 0.3, 0.2, 0.1])
    g[:, 30] = g[:, 3]  # copies, in tiles of their own
    packed_ = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(g)], "snp_idx long, g array<double>").repartition(3)
    weights = spark.createDataFrame([(r, i, float(1 + (i + r) % 3)) for r in range(2) for i in range(m)], "replicate_id int, snp_idx long, w double")
    want = {name: f(packed_, n, how, weights).collect() for name, f, how in (("e", distance.euclidean, "mean"), ("m", distance.manhattan, "mean"), ("c", distance.corrected_hamming, None))}
    for module in (pairs, distance):
        monkeypatch.setattr(module, "TILE", 8)
    monkeypatch.setattr(pairs, "INNER", 8)
    for name, f, how in (("e", distance.euclidean, "mean"), ("m", distance.manhattan, "mean"), ("c", distance.corrected_hamming, None)):
        made = f(packed_, n, how, weights)
        got = {(r.replicate_id, r.i, r.j): r.d for r in made.collect()}
        assert len(got) == len(want[name]) == 2 * n * (n - 1) // 2
        assert all(got[r.replicate_id, r.i, r.j] == pytest.approx(r.d, abs=1e-9) for r in want[name])
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "SortMergeJoin [replicate_id" not in plan  # nothing of the matrix's size is shuffled
    monkeypatch.setattr(pairs, "FEW_FEATURES", 3)
    monkeypatch.setattr(distance, "FEW_FEATURES", 3)
    for r in distance.corrected_hamming(packed_, n, None, weights).collect():
        assert r.d == pytest.approx({(x.replicate_id, x.i, x.j): x.d for x in want["c"]}[r.replicate_id, r.i, r.j])
    one = np.linspace(1, 3, 200)[:, None] ** 7
    assert distance.squared(one, one.copy(), np.ones(200))[0, 0] == 0
    mean = rng.integers(0, 2, (30, 40)) * rng.random((30, 1))  # two values in each feature, many in all
    monkeypatch.setattr(np, "abs", None)  # no feature is taken alone
    assert distance.absolute(mean, mean, np.ones(30))[0, 1] == pytest.approx(sum(max(a, b) - min(a, b) for a, b in zip(mean[:, 0], mean[:, 1], strict=True)))


def pairs_with_names(rows):
    return rows.select("replicate_id", "name", "i", "j0", F.posexplode("row").alias("j", "d")).select("replicate_id", "name", "i", (F.col("j") + F.col("j0")).alias("j"), "d").where("i < j")


def test_mds_of_replicates_is_that_of_the_resampled_matrix(spark):
    rng = np.random.default_rng(8)
    m, n = 40, 9
    g = rng.integers(0, 3, (m, n)).astype(float)
    packed_ = genotype.matrix_to_packed(spark, g.T)
    samples = spark.createDataFrame([(i, f"s{i}", f"p{i % 3}") for i in range(n)], "sample_idx int, sample_id string, population string")
    seeds = {0: 5, 3: 8}
    weights = resample.bootstrap_weights(spark, m, seeds)

    def user(x, populations, imputation):
        return np.abs(x[:, None] - x[None]).sum(2) + np.abs(x.sum(1)[:, None] - x.sum(1)[None]), populations

    for metric in ("fst", "euclidean_population", "manhattan", "missing_corrected_hamming", user):
        how = None if metric == "fst" else "mean"
        got = {r.replicate_id: r for r in embed.mds(packed_, samples, 2, metric, how, weights, by_population=False if callable(metric) else None).collect()}
        assert sorted(got) == [0, 3]
        for r, seed in seeds.items():
            drawn = genotype.matrix_to_packed(spark, g[random.Random(seed).choices(range(m), k=m)].T)
            alone = embed.mds(drawn, samples, 2, metric, how, by_population=False if callable(metric) else None).first()
            assert got[r].sample_ids == alone.sample_ids and np.allclose(got[r].explained, alone.explained) and np.allclose(np.abs(got[r].coords), np.abs(alone.coords), atol=1e-6)


def test_number_of_clusters_by_cross_validation(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.3, (14, 2)) for c in ((0, 0), (4, 0), (0, 5), (6, 6))])[rng.permutation(56)]
    e = spark.createDataFrame([(r, [f"{i:02d}" for i in range(56)], x.tolist() if r == 0 else (x[:, :1] * 0 + rng.normal(0, 1, (56, 2))).tolist()) for r in range(2)], "replicate_id int, sample_ids array<string>, coords array<array<double>>")
    rows = cluster.held_out_criteria(e, [2, 3, 4, 5, 6]).collect()
    assert len(rows) == 2 * 5 * 5
    sizes = [12, 11, 11, 11, 11]
    means = {}
    for k in range(2, 7):  # five folds by hand
        at, found = 0, []
        for size in sizes:
            held = list(range(at, at + size))
            fit = linalg.Mixture(np.delete(x, held, 0), k)
            dens = sum(fit.weight[j] * np.exp(-0.5 * (np.linalg.solve(c := fit.chol[j] @ fit.chol[j].T, (x[held] - fit.mean[j]).T) * (x[held] - fit.mean[j]).T).sum(0)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for j in range(k))
            found.append(-2 * np.log(dens).sum() + (k - 1 + 2 * k + 3 * k) * np.log(size))
            at += size
        means[k] = np.mean(found)
        assert np.mean([r.bic for r in rows if r.replicate_id == 0 and r.k == k]) == pytest.approx(means[k])
    best = {r.replicate_id: r.k for r in cluster.best_k(e, 1, (2, 6)).collect()}
    assert best[0] == min(means, key=means.get) == 4 and 2 <= best[1] <= 6
    assert linalg.cluster_numbers(56, 1) == [3, 4, 5, 6, 7] and linalg.cluster_numbers(56, 2) == [2] and linalg.held_out_bic(x[:4], 4, 0) == float("inf")
    with pytest.raises(WobbleError):
        linalg.cluster_numbers(10, 3, (5, 4))


def test_weighted_gram_is_that_of_the_resampled_matrix(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, (6, 25)).astype(float)
    drawn = [r.snp_idx for r in resample.bootstrap_draws(spark, 25, {0: 9}).collect()]
    g = embed.weighted_grams(genotype.matrix_to_packed(spark, m), resample.bootstrap_weights(spark, 25, {0: 9}), 6)
    got = np.array([r.row for r in g.orderBy("i").collect()])
    x = embed.standardised(m.T[drawn])
    assert np.allclose(got, x.T @ x)
    s = pairs.pair_sums(genotype.matrix_to_packed(spark, m), 6, {"d": distance.squared}).orderBy("i").collect()
    assert np.allclose(np.array([r.row for r in s]), ((m[:, None] - m[None]) ** 2).sum(2))


def test_matrix_pca_is_the_svd(spark):
    m = np.random.default_rng(4).normal(size=(7, 20))
    e = embed.pca(genotype.matrix_to_packed(spark, m), whole(spark, 20), [(f"s{i}", "p") for i in range(7)], 3, "matrix").first()
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(e.coords), np.abs(u * s)[:, :3]) and np.allclose(e.explained, (s**2 / (s**2).sum())[:3])


def test_pcoa_gives_distances_back():
    x = np.random.default_rng(5).normal(size=(8, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    y, explained = linalg.pcoa(d, 3)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), d) and explained.sum() == pytest.approx(1)


def test_windowed_stability_matches_known_scores(spark):
    m = np.array([[int(c) for c in row] for row in WINDOWED], float).T
    e = embed.pca(genotype.matrix_to_packed(spark, m), resample.window_weights(spark, 40, 10), [(f"S{i}", f"P{i}") for i in range(5)], 2)
    rows = {(r.i, r.j): r for r in compare.compare_pairs(e, 2, block=3).collect()}
    assert len(rows) == 45
    for pair, (ps, pcs) in PAIR_SCORES.items():
        assert rows[pair].stability == pytest.approx(ps, abs=2e-4) and rows[pair].cluster_stability == pytest.approx(pcs)
    assert np.mean([r.stability for r in rows.values()]) == pytest.approx(0.6128, abs=1e-4)
    assert np.mean([r.cluster_stability for r in rows.values()]) == pytest.approx(0.3611, abs=1e-4)
    support = compare.support_values(compare.compare_pairs(e), e)
    assert {r.sample_id for r in support.collect()} == {f"S{i}" for i in range(5)} and support.where("PSV < 0 or PSV > 1").count() == 0
    # pairs of block size, and of a batch alone, are the same
    again = {(r.i, r.j): r.stability for r in compare.compare_pairs(e, only_with=[0]).collect()}
    assert len(again) == 9 and all(again[k] == pytest.approx(rows[k].stability) for k in again)


def frame(spark, *embeddings):
    rows = [(k, ids, ["p"] * len(ids), [[float(v) for v in r] for r in x], [0.5, 0.5]) for k, (ids, x) in enumerate(embeddings)]
    return spark.createDataFrame(rows, embed.EMBEDDED)


def test_alignment(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 2))
    turn = np.array([[0.0, -1], [1, 0]])
    ids = [str(i) for i in range(1, 7)]
    for y in (x, -x, x + 5, 3 * x @ turn, x * [1, -1]):
        c = compare.Compared(ids, x, ids, y)
        assert c.stability() == pytest.approx(1) and np.allclose(c.difference(), 0, atol=1e-7)
    a = np.array([[i, i] for i in range(1, 7)], float)
    b = np.array([[1, 1], [1, 2], [2, 1], [2, 2], [2, 3], [2, 4]], float)
    e = frame(spark, (ids, a), ([str(i) for i in range(2, 8)], b), (ids, a))
    p = compare.compare_pairs(e)
    got = {(r.i, r.j): r for r in p.collect()}
    assert got[0, 2].stability == pytest.approx(1) and 0 < got[0, 1].stability < 1 and len(got[0, 1].sample_ids) == 5
    s = {r.sample_id: r for r in compare.support_values(p, e).collect()}
    assert len(s) == 7 and all(0 <= r.PSV <= 1 for r in s.values()) and s["7"].n_present == 1
    with pytest.raises(WobbleError, match="No samples left"):
        compare.Compared(["a"], x[:1], ["b"], x[:1])
    assert compare.Compared(ids, x, ids[:4], x[:4]).clipped and not compare.Compared(ids, x, ids, x).clipped


def test_closed_form_in_two_dimensions(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for j in range(1, 5):
        a, b = rng.normal(size=(9, 2)), rng.normal(size=(9, 2))
        want[j] = linalg.stability(linalg.procrustes(a, b)[2])
        rows += [(0, j, *map(float, a[k]), *map(float, b[k])) for k in range(9)]
    df = spark.createDataFrame(rows, "i int, j int, x1 double, y1 double, x2 double, y2 double")
    assert {r.j: r.stability for r in compare.stability_2d(df).collect()} == pytest.approx(want)


def test_clustering(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    own = np.repeat([0, 1, 2], 30)
    labels = linalg.kmeans(x, 3)
    assert linalg.fowlkes_mallows(own, labels) == pytest.approx(1)
    one = lambda v: spark.createDataFrame([(0, v.tolist())], "replicate_id int, coords array<array<double>>")
    mixed = x[rng.permutation(90)]
    assert cluster.best_k(one(mixed), 5).first().k == 3 and cluster.best_k(one(mixed), 2, (2, 2)).first().k == 2
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(own, rng.integers(0, 2, 90), strict=True)], "a int, b int")
    pdf = df.toPandas()
    assert compare.fowlkes_mallows(df).first().fmi == pytest.approx(linalg.fowlkes_mallows(pdf.a.to_numpy(), pdf.b.to_numpy()))
    with pytest.raises(WobbleError):
        linalg.kmeans(x, 91)


def test_convergence(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8, 2))
    ids = [str(i) for i in range(8)]
    for n in (6, 9):
        assert converged(compare.compare_pairs(frame(spark, *[(ids, x)] * n)), list(range(n)), 0.05)
    e = frame(spark, *[(ids, x[rng.permutation(8)]) for _ in range(5)], (ids, x))
    assert not converged(compare.compare_pairs(e), list(range(6)), 0.01)


def test_padding(spark):
    s = spark.createDataFrame([("a",), ("new",)], "sample_id string")
    e = spark.createDataFrame([("a", "p", [1.0, 2.0])], "sample_id string, population string, coords array<double>")
    assert sorted(map(tuple, genotype.pad_missing(s, e, 2).collect())) == [("a", "p", [1.0, 2.0]), ("new", "_dummy", [0.0, 0.0])]
    pops = spark.createDataFrame([("a", "IGNORE"), ("b", "x"), ("c", None)], "sample_id string, population string")
    assert genotype.drop_ignored(pops).count() == 2


def test_result_files(spark, tmp_path):
    (tmp_path / "x.evec").write_text("  #eigvals:  3.1 0.4\n b 0.1 0.2 P1\n a -0.3 0.4 P2\n")
    (tmp_path / "x.eval").write_text("3\n1\n")
    r = read_evec(spark, str(tmp_path / "x.evec"), str(tmp_path / "x.eval")).first()
    assert r.sample_ids == ["a", "b"] and r.coords == [[-0.3, 0.4], [0.1, 0.2]] and r.explained == [0.75, 0.25]
    (tmp_path / "x.evec").write_text("#eigvals: 1\n b 0.1 zzz P1\n")
    with pytest.raises(WobbleError):
        read_evec(spark, str(tmp_path / "x.evec"), str(tmp_path / "x.eval"))
    (tmp_path / "x.log").write_text("population:  0  A  3\npopulation:  1  B  2\n")
    (tmp_path / "x.fst").write_text("2\nA 0.0-0.25\nB -0.25 0.0\n")
    assert [tuple(x) for x in read_fst(spark, str(tmp_path / "x.fst"), str(tmp_path / "x.log")).collect()] == [("A", "B", -0.25)]


def settings(prefix, tmp_path, **more):
    return RunConfig(**{"dataset_prefix": prefix, "result_dir": str(tmp_path / "out"), "n_replicates": 3, "threads": 2, "seed": 1, "n_components": 2, "kmeans_k": 3, "bootstrap_convergence_check": False} | more)


def test_run_bootstrap(spark, prefix, tmp_path):
    (tmp_path / "pops").write_text("Pop1\nPop2\nPop3\n")
    out = StabilityRun(spark, settings(prefix, tmp_path, plot_results=True, embedding_populations=str(tmp_path / "pops"))).run()
    assert 0 <= out["stability"] <= 1 and out["n_replicates"] == 3
    lines = lambda n: (tmp_path / "out" / n).read_text().splitlines()
    assert lines("wobble.replicates.csv")[0] == ",stability,cluster_stability" and len(lines("wobble.replicates.csv")) == 4
    assert lines("wobble.supportValues.csv")[0] == ",PSV" and len(lines("wobble.supportValues.csv")) == 6 and len(lines("wobble.supportValues.projected.csv")) == 3
    assert {p.name for p in (tmp_path / "out" / "plots").iterdir()} == {"populations.html", "clusters.html", "support_values.html", "projections.html", "replicate_0.html", "replicate_1.html", "replicate_2.html", "comparison_least_stable.html", "comparison_most_stable.html"}
    assert lines("wobble.outliers.csv") == ["replicate_id,round,sample_id,axis,deviation"]  # five samples can't be six deviations apart
    again = StabilityRun(spark, settings(prefix, tmp_path, result_dir=str(tmp_path / "two"), embedding_populations=str(tmp_path / "pops"))).run()
    assert again["stability"] == pytest.approx(out["stability"])


def test_run_windows_mds_and_early_stop(spark, prefix, tmp_path):
    w = StabilityRun(spark, settings(prefix, tmp_path, analysis_mode=AnalysisMode.SLIDING_WINDOW, n_replicates=2)).run()
    assert w["n_replicates"] == 2
    m = StabilityRun(spark, settings(prefix, tmp_path, embedding_algorithm=EmbeddingAlgorithm.MDS, kmeans_k=2, n_replicates=2, result_dir=str(tmp_path / "mds"))).run()
    assert m["n_replicates"] == 2
    s = StabilityRun(spark, settings(prefix, tmp_path, n_replicates=30, bootstrap_convergence_check=True, bootstrap_convergence_tolerance=10.0, result_dir=str(tmp_path / "stop"))).run()
    assert s["n_replicates"] == 10


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("dataset_prefix: a\nresult_dir: b\nanalysis_mode: sliding_window\nfile_format: ped\n")
    c = load_config(f)
    assert c.analysis_mode is AnalysisMode.SLIDING_WINDOW and c.file_format is FileFormat.PED and c.as_mapping()["dataset_prefix"].startswith("/")
    for bad in ("dataset_prefix: a\n", "dataset_prefix: a\nresult_dir: b\nother: 1\n", "dataset_prefix: a\nresult_dir: b\nthreads: -1\n", "- 1\n"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load_config(f)
    with pytest.raises(ConfigError):
        RunConfig(dataset_prefix="a", result_dir="b", smartpca_optional_settings={"shrinkmode": "YES"}).check_settings()
    RunConfig(dataset_prefix="a", result_dir="b", smartpca_optional_settings={"numoutlieriter": 0}).check_settings()
    rule = RunConfig(dataset_prefix="a", result_dir="b", smartpca_optional_settings={"numoutlieriter": 2, "outliersigmathresh": "4.5"})
    rule.check_settings()
    assert rule.outlier_rule() == (2, 10, 4.5) and RunConfig(dataset_prefix="a", result_dir="b").outlier_rule() == (5, 10, 6.0)
    for bad in ({"numoutlieriter": -1}, {"numoutlieriter": True}, {"numoutlierevec": 0}, {"outliersigmathresh": "wide"}, {"shrinkmode": True}):
        with pytest.raises(ConfigError, match="isn't supported"):
            RunConfig(dataset_prefix="a", result_dir="b", smartpca_optional_settings=bad).check_settings()


def test_plot_data(spark):
    e = spark.createDataFrame([(0, "a", "p", [0.0, 1.0]), (0, "b", "q", [1.0, 0.0]), (0, "c", "q", [1.0, 1.0])], "replicate_id int, sample_id string, population string, coords array<double>")
    s = spark.createDataFrame([("a", 0.3), ("b", 0.9), ("z", 0.1)], "sample_id string, PSV double")
    assert plotdata.populations(e).count() == 3 and plotdata.clusters(e, 2).select("group").distinct().count() == 2
    v = plotdata.support_values(e, s)
    assert {(r.label, r.group) for r in v.collect()} == {("a", "rogue"), ("b", "stable")}
    assert {tuple(r) for r in plotdata.unmatched(e, s).collect()} == {("z", "support"), ("c", "embedding")}
    assert "<svg" in plotdata.svg(v.toPandas(), "t", [0.6, 0.4], (0, 1)) and len(set(plotdata.distinct_colours(7))) == 7
    for bad in ((0, 0), (0, 5)):
        with pytest.raises(WobbleError):
            plotdata.check_dimensions(2, *bad)
    ids = ["a", "b", "c"]
    x = np.array([[0.0, 1], [1, 0], [1, 1]])
    c = plotdata.embedding_comparison(frame(spark, (ids, x), (ids, x * 2)), 0, 1, s)
    assert c.count() == 6 and c.where("rogue").count() == 2


def test_projection(spark):
    rng = np.random.default_rng(11)
    m = rng.integers(0, 3, (8, 60)).astype(float)
    names = [(f"s{i}", "in" if i < 6 else "out") for i in range(8)]
    fit = list(range(6))
    e = embed.pca(genotype.matrix_to_packed(spark, m), whole(spark, 60), names, 2, fit=fit).first()
    alone = embed.pca(genotype.matrix_to_packed(spark, m[:6]), whole(spark, 60), names[:6], 2).first()
    assert np.allclose(np.array(e.coords)[:6], alone.coords)
    x = embed.standardised(m.T, fit)
    u, s, vt = np.linalg.svd(x[:, :6].T, full_matrices=False)
    want = np.linalg.lstsq(vt[:2].T * s[:2], x[:, 6:], rcond=None)[0].T
    assert np.allclose(np.abs(np.array(e.coords)[6:]), np.abs(want))


def test_replicates_as_files(spark, prefix, tmp_path):
    g = G.read_genotypes(spark, prefix)
    draws = resample.bootstrap_draws(spark, 7, {3: 5})
    resample.write_checkpoint(draws, str(tmp_path / "ckp"))
    back = resample.read_checkpoint(spark, str(tmp_path / "ckp"))
    line = resample.checkpoint_line(back, 3)
    assert line == "5;" + ", ".join(map(str, random.Random(5).choices(range(7), k=7)))
    assert resample.checkpoint_line(resample.parse_checkpoint_line(spark, line, 3), 3) == line
    packed, snps = resample.gather(g.packed, g.snps, back)
    idx = random.Random(5).choices(range(7), k=7)
    assert cells(packed) == {k: [float(c) for c in GENO[i]] for k, i in enumerate(idx)}
    assert snps.select("snp_id").distinct().count() == 7
    p, s = resample.window_slice(g.packed, g.snps, 7, 3, 1)
    assert cells(p) == {k: [float(c) for c in GENO[2 + k]] for k in range(3)} and s.count() == 3


def test_finished_tables_are_reused(spark, prefix, tmp_path):
    a = StabilityRun(spark, settings(prefix, tmp_path, keep_replicates=True))
    first = a.run()
    assert G.check_geno(spark, str(tmp_path / "out" / "bootstrap" / "bootstrap_0.geno")) == 7
    when = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "tables").rglob("*.parquet")}
    assert StabilityRun(spark, settings(prefix, tmp_path)).run() == pytest.approx(first)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "tables").rglob("*.parquet")} == when
    StabilityRun(spark, settings(prefix, tmp_path, redo=True)).run()
    assert not set(when) & set((tmp_path / "out" / "tables").rglob("*.parquet"))


def test_draws_are_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resample.DrawStore, "CHUNK", 3)
    folder, seeds = str(tmp_path / "draws"), {0: 11, 1: 12, 5: 11}
    by_hand = lambda s: random.Random(s).choices(range(10), k=10)
    store = resample.DrawStore(spark, folder, 10)
    assert store.whole([11, 12]) == set() and store.ensure(seeds) == 2 and resample.DrawStore(spark, folder, 10).ensure(seeds) == 0
    rows = store.draws(seeds).collect()
    assert all([r.snp_idx for r in sorted((x for x in rows if x.replicate_id == k), key=lambda r: r.draw_pos)] == by_hand(s) for k, s in seeds.items())
    same = {(r.replicate_id, r.snp_idx): r.w for r in resample.bootstrap_weights(spark, 10, seeds).collect()}
    assert {(r.replicate_id, r.snp_idx): r.w for r in store.weights(seeds).collect()} == same
    assert resample.DrawStore(spark, folder, 9).ensure({0: 11}) == 1  # of other features
    for part in (tmp_path / "draws" / "features=10" / "seed=12").glob("part-*"):
        part.unlink()  # a lost draw is made again, the other stays
    assert store.ensure(seeds) == 1 and store.whole([11, 12, 13]) == {11, 12} and store.ensure(seeds, anew=True) == 2
    (tmp_path / "bootstrap_1.ckp").write_text("77;" + ", ".join(["3"] * 10) + "\n")
    other = resample.DrawStore(spark, str(tmp_path / "new"), 10, str(tmp_path / "bootstrap_*.ckp"))
    assert other.ensure({0: 11, 1: 12}) == 1 and {(r.replicate_id, r.snp_idx, r.seed) for r in other.draws({0: 11, 1: 12}).where("replicate_id = 1").collect()} == {(1, 3, 77)}
    assert [tuple(r) for r in other.weights({1: 12}).collect()] == [(1, 3, 10.0)]
    for text in ("77;1, 2", "77;" + ", ".join(["10"] * 10), "x;" + ", ".join(["1"] * 10), "77;" + ", ".join(["a"] * 10), "\n"):
        (tmp_path / "bootstrap_1.ckp").write_text(text)
        with pytest.raises(ConfigError, match="checkpoint"):
            resample.DrawStore(spark, folder, 10, str(tmp_path / "bootstrap_*.ckp"))


def test_content_decides_what_is_reused(spark, prefix, tmp_path):
    g = G.read_genotypes(spark, prefix)
    digest = G.content_digest(g, 3)
    assert G.content_digest(G.Genotypes(g.packed.repartition(3), g.samples.repartition(2), g.snps), 3) == digest
    for name, df in (("packed", g.packed.withColumn("g", F.reverse("g"))), ("samples", g.samples.withColumn("population", F.lit("x"))), ("snps", g.snps.withColumn("alt", F.lit(None).cast("string")))):
        assert G.content_digest(g._replace(**{name: df}), 3) != digest
    G.write_ped(g, str(tmp_path / "in"))
    first = StabilityRun(spark, settings(str(tmp_path / "in"), tmp_path, file_format=FileFormat.PED))
    first.run()
    assert first.drawn == 3
    files = {p: p.stat().st_mtime_ns for kind in ("tables", "converted") for p in (tmp_path / "out" / kind).rglob("part-*")}
    (tmp_path / "copy").mkdir()
    for kind in ("ped", "map", "fam"):
        shutil.copytree(tmp_path / f"in.{kind}", tmp_path / "copy" / f"in.{kind}")
    again = StabilityRun(spark, settings(str(tmp_path / "copy" / "in"), tmp_path, file_format=FileFormat.PED, plot_results=True))
    again.run()
    assert again.fingerprint == first.fingerprint and again.drawn == 0
    assert {p: p.stat().st_mtime_ns for kind in ("tables", "converted") for p in (tmp_path / "out" / kind).rglob("part-*")} == files
    other = StabilityRun(spark, settings(str(tmp_path / "in"), tmp_path, file_format=FileFormat.PED, n_components=1))
    other.embed()
    other.replicates()
    assert other.fingerprint != first.fingerprint and other.drawn == 0  # other settings, the same draws
    (tmp_path / "out" / "bootstrap").mkdir(exist_ok=True)
    (tmp_path / "out" / "bootstrap" / "bootstrap_0.ckp").write_text("1;0, 0, 1, 1, 2, 2, 3")
    assert StabilityRun(spark, settings(str(tmp_path / "in"), tmp_path, file_format=FileFormat.PED)).fingerprint != first.fingerprint


def test_matrix_interface(spark, tmp_path):
    from wobble.plans.library import MatrixDataset, ReplicateComparison

    rng = np.random.default_rng(12)
    m = rng.integers(0, 3, (6, 24)).astype(np.int8)
    ids, pops = [f"s{i}" for i in range(6)], list("aabbcc")
    for bad in ((m, ids[:5], pops[:5]), (m, ids, pops[:5]), (m, ["x"] * 6, pops)):
        with pytest.raises(ConfigError):
            MatrixDataset(spark, *bad)
    d = MatrixDataset(spark, m, ids, pops)
    n = [0]

    def keep(df):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    b = d.bootstrap(keep, 4, k=2, check=False)
    assert b.n == 4 and 0 < b.stability() <= 1 and 0 <= b.cluster_stability(2) <= 1 and b.support_values().count() == 6
    assert 0 < d.windows(3, k=2).stability() <= 1
    # a bootstrap replicate is what PCA of the resampled matrix gives
    seeds = resample.replicate_seeds(42, 4)
    drawn = random.Random(seeds[0]).choices(range(24), k=24)
    own = MatrixDataset(spark, m[:, drawn], ids, pops).pca(2).first()
    assert np.allclose(np.abs(own.coords), np.abs(b.embedded.where("replicate_id = 0").first().coords))
    w = d.windows(3, EmbeddingAlgorithm.MDS, 2, "manhattan")
    assert w.n == 3
    user = d.mds(2, lambda x, p, how: (np.abs(x[:, None] - x[None]).sum(2), p))
    assert np.allclose(np.abs(user.first().coords), np.abs(d.mds(2, "manhattan").first().coords))
    means = lambda x, p, how: (np.abs(np.subtract.outer(*[x.mean(1)[::2]] * 2)), list("abc"))
    assert d.mds(1, means, by_population=True).count() == 1
    with pytest.raises(WobbleError):
        d.mds(1, means)
    with pytest.raises(WobbleError):
        ReplicateComparison(d.pca(2))


def test_monomorphic_features_are_those_that_standardising_leaves_out(spark):
    m = np.array([[0, 0, 0], [2, 2, np.nan], [0, 1, 2], [np.nan, np.nan, np.nan], [1, 1, 1], [0, 2, np.nan]])
    rows = [(i, j, None if np.isnan(v) else int(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    found = {r.snp_idx for r in genotype.monomorphic(spark.createDataFrame(rows, "snp_idx int, sample_idx int, dosage int")).collect()}
    x = m / 2
    p = [np.nanmean(r) if not np.isnan(r).all() else 0 for r in x]
    assert found == {i for i, q in enumerate(p) if q in (0, 1)} == {0, 1, 3}
    left_out = np.flatnonzero(~embed.standardised(m).any(1)).tolist()
    assert found <= set(left_out)


def test_blocks_are_paired_where_they_are_written(spark, monkeypatch):
    def moved(plan):
        """Exchanges above the blocks' files."""
        return str(plan._jdf.queryExecution().executedPlan().toString()).count("Exchange")

    rng = np.random.default_rng(31)
    n, m = 40, 9
    packed_ = genotype.matrix_to_packed(spark, rng.integers(0, 3, (n, m)).astype(float))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(n, 3)))], "id long, x array<double>")
    for module in (pairs, distance):
        monkeypatch.setattr(module, "TILE", 8)
    monkeypatch.setattr(pairs, "INNER", 8)
    labels = spark.createDataFrame([(i, 1000 - i) for i in range(n)], "sample_idx int, label long")
    shown = {"digits": 3, "labels": labels, "names": ("p", "q")}
    for made in (distance.euclidean(packed_, n, **shown), distance.hamming(packed_, n, **shown), distance.corrected_hamming(packed_, n, **shown), pairs.point_pairs(points, lambda a, b: a.T @ b, 3, ("p", "q", "d"))):
        assert moved(made) == 0  # blocks were joined by sort and dealt once more before: each as often as there are blocks
        got = made.collect()
        assert made.columns == ["p", "q", "d"] and len({(r.p, r.q) for r in got}) == len(got) == n * (n - 1) // 2
        assert all(r.d == round(r.d, 3) for r in got)
    assert pairs.block_side(10**6, 512, 48, 200) == 4096 and pairs.block_side(10**6, 512, 48, 1024) == 1024  # a block's bytes are bounded


def test_tiles_of_two_blocks(spark):
    rng = np.random.default_rng(32)
    x, y = (rng.choice([0.0, 1.0, 2.0, np.nan], (30, k), p=[0.4, 0.3, 0.2, 0.1]) for k in (21, 34))
    x[7], y[7] = rng.normal(size=21), rng.normal(size=34)  # a feature of many values
    x[8], y[9] = np.nan, np.nan  # none on a side
    mean = np.where(np.isnan(x), np.arange(30)[:, None] / 7, x), np.where(np.isnan(y), np.arange(30)[:, None] / 7, y)
    for w in (np.ones(30), rng.integers(1, 4, 30).astype(float), rng.random(30)):
        for u, v in ((x, y), (x, x), (x[:, :1], y), mean):
            apart = distance.absolute_tiles(u, v, w)
            assert np.allclose(apart(slice(3, 17), slice(5, 30)), distance.absolute(u, v, w)[3:17, 5:30])
            both = distance.both_present(u, v, w)
            want = np.where(both > 0, distance.absolute(u, v, w) * w.sum() / np.where(both > 0, both, 1), np.nan)
            assert np.allclose(distance.corrected_tiles(u, v, w)(slice(None), slice(2, 9)), want[:, 2:9], equal_nan=True)
        assert np.allclose(distance.root_tiles(*mean, w)(slice(4, 9), slice(None)), np.sqrt(distance.squared(*mean, w))[4:9])
    whole = np.delete(x, 7, 0)
    assert (distance.absolute_tiles(whole, whole, np.ones(29))(slice(None), slice(None)) == distance.absolute(whole, whole, np.ones(29))).all()  # exact
    v = np.array([[0.5, -0.0000004, 1.0000005, -2.5, 2e12 + 0.123, np.nan, -1.23456789]])
    assert pairs.rounded(v, 6).tolist()[0][:5] == [0.5, 0.0, 1.000001, -2.5, 2e12 + 0.123] and np.isnan(pairs.rounded(v, 6)[0, 5]) and not np.signbit(pairs.rounded(v, 6)[0, 1])
    assert pairs.rounded(v, 0)[0, 3] == -3 and pairs.rounded(v, 6)[0, 6] == -1.234568
    d = rng.random(2000)
    got = [r.d for r in spark.createDataFrame([(float(z),) for z in d], "d double").select(F.round("d", 6).alias("d")).collect()]
    assert pairs.rounded(d[None], 6)[0].tolist() == got


def test_embeddings_by_samples(spark, monkeypatch):
    rng = np.random.default_rng(33)
    n, m, k = 50, 12, 4
    packed_ = genotype.matrix_to_packed(spark, rng.integers(0, 3, (n, m)).astype(float))
    weights = spark.createDataFrame([(r, i, float(w)) for r in range(2) for i, w in enumerate(rng.integers(0, 4, m)) if w], "replicate_id int, snp_idx long, w double")
    samples = [(f"s{i:02d}", "x") for i in range(n)]
    table = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(samples)], "sample_idx int, sample_id string, population string")
    calls = []
    for flavour in ("genotype", "matrix"):
        for fit in (None, list(range(5, 40))):
            calls.append(lambda flavour=flavour, fit=fit: embed.pca(packed_, weights, samples, k, flavour, fit=fit, by_sample=True))
    calls.append(lambda: embed.mds(packed_, table, k, "euclidean", "mean", by_sample=True))
    for call in calls:
        want = {(r.replicate_id, r.sample_id): r for r in call().collect()}
        with monkeypatch.context() as few:
            few.setattr(embed, "DENSE", 10)
            made = call()
            assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()  # no task holds a replicate
            got = {(r.replicate_id, r.sample_id): r for r in made.collect()}
        assert got.keys() == want.keys() and len(got) in (n, 2 * n)
        for key, r in want.items():
            assert np.allclose(got[key].coords, r.coords, atol=1e-6) and np.allclose(got[key].explained, r.explained)
