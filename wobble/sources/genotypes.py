"""Genotype file formats: EIGENSTRAT, ANCESTRYMAP, PACKEDANCESTRYMAP, PED and PACKEDPED, to packed features, samples and SNPs, and back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wobble.errors import ConfigError
from wobble.operators.genotype import to_packed
from wobble.types import FileFormat

from .lines import numbered_lines, write_lines
from .packed import LAYOUTS, read_packed, write_packed

SUFFIXES = {FileFormat.EIGENSTRAT: ("geno", "snp", "ind"), FileFormat.ANCESTRYMAP: ("geno", "snp", "ind"), FileFormat.PACKEDANCESTRYMAP: ("geno", "snp", "ind"), FileFormat.PED: ("ped", "map", "fam"), FileFormat.PACKEDPED: ("bed", "bim", "fam")}


class Genotypes(NamedTuple):
    """packed: snp_idx, g (dosages of the first allele; NULL is missing). samples and snps as in wobble.types."""

    packed: DataFrame
    samples: DataFrame
    snps: DataFrame


def filenames(prefix: str, fmt: FileFormat) -> tuple[str, str, str]:
    """Genotype, SNP and individual file."""
    return tuple(f"{prefix}.{s}" for s in SUFFIXES[fmt])


def _fields(value: Column, limit: int = -1) -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s", " ")), " +", limit)


def read_ind(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(F.col("value"), 3)
    return numbered_lines(spark, path).select(F.col("idx").cast("int").alias("sample_idx"), f[0].alias("sample_id"), F.get(f, F.lit(1)).alias("sex"), F.trim(F.get(f, F.lit(2))).alias("population"))


def read_snp(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(F.col("value"))
    at = lambda k: F.get(f, F.lit(k))
    return numbered_lines(spark, path).select(F.col("idx").alias("snp_idx"), at(0).alias("snp_id"), at(1).alias("chrom"), at(2).cast("double").alias("gpos"), at(3).cast("long").alias("ppos"), at(4).alias("ref"), at(5).alias("alt"), F.size(f).alias("n_fields"))


def read_populations(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    return numbered_lines(spark, path).select("idx", F.trim("value").alias("population"))


def read_geno(spark: SparkSession, path: str) -> DataFrame:
    """Packed features of an EIGENSTRAT .geno file; 9 is missing."""
    digits = F.transform(F.split(F.trim("value"), ""), lambda c: F.when(c != "9", c.cast("double")))
    return numbered_lines(spark, path).select(F.col("idx").alias("snp_idx"), digits.alias("g"))


def check_geno(spark: SparkSession, path: str) -> int:
    """Raises unless all lines are of one length and of 0, 1, 2 and 9 only. The number of lines."""
    v = F.trim("value")
    r = spark.read.text(path).agg(F.count("*").alias("n"), F.min(F.length(v)).alias("lo"), F.max(F.length(v)).alias("hi"), F.count_if(~F.regexp_like(v, F.lit("^[0129]+$"))).alias("bad")).first()
    if r.bad:
        raise ConfigError(f"{path} isn't in EIGENSTRAT format: {r.bad} lines hold other values than 0, 1, 2 and 9.")
    if r.lo != r.hi:
        raise ConfigError(f"{path}: lines differ in length, {r.lo} to {r.hi}.")
    return r.n


def check_ind(spark: SparkSession, path: str) -> int:
    r = read_ind(spark, path).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.count_if(F.col("population").isNull() | (F.col("population") == "")).alias("short")).first()
    if r.short:
        raise ConfigError(f"{path}: {r.short} lines have fewer than three fields.")
    if r.ids != r.n:
        raise ConfigError(f"{path}: duplicate sample ids.")
    return r.n


def check_snp(spark: SparkSession, path: str) -> int:
    r = read_snp(spark, path).agg(F.count("*").alias("n"), F.count_distinct("snp_id").alias("ids"), F.min("n_fields").alias("lo"), F.max("n_fields").alias("hi")).first()
    if r.n and not 4 <= r.lo == r.hi <= 6:
        raise ConfigError(f"{path}: lines must all have 4 to 6 fields, found {r.lo} to {r.hi}.")
    if r.ids != r.n:
        raise ConfigError(f"{path}: duplicate SNP ids.")
    return r.n


def clean_ids(samples: DataFrame) -> DataFrame:
    """Without `family:` before sample ids, if all ids have one."""
    if samples.where(~F.col("sample_id").contains(":")).limit(1).count():
        return samples
    return samples.withColumn("sample_id", F.regexp_replace("sample_id", "^[^:]*:", ""))


def _read_fam(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(F.col("value"))
    sex = F.when(f[4] == "1", "M").when(f[4] == "2", "F").otherwise("U")
    return numbered_lines(spark, path).select(F.col("idx").cast("int").alias("sample_idx"), f[1].alias("sample_id"), sex.alias("sex"), F.get(f, F.lit(5)).alias("population"))


def _read_map(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(F.col("value"))
    at = lambda k: F.get(f, F.lit(k))
    return numbered_lines(spark, path).select(F.col("idx").alias("snp_idx"), at(1).alias("snp_id"), at(0).alias("chrom"), at(2).cast("double").alias("gpos"), at(3).cast("long").alias("ppos"), at(4).alias("ref"), at(5).alias("alt"))


def _read_ped(spark: SparkSession, paths: tuple[str, str, str]) -> Genotypes:
    """A row per sample in the file; cells go to features by one shuffle."""
    letters = F.create_map(*[F.lit(x) for pair in zip("1234", "ACGT", strict=True) for x in pair])
    f = _fields(F.col("value"))
    rows = numbered_lines(spark, paths[0]).withColumn("f", f)
    name = lambda a: F.coalesce(F.element_at(letters, a), a)
    calls = F.transform(F.sequence(F.lit(0), ((F.size("f") - 6) / 2).cast("int") - 1), lambda k: F.struct(name(F.get("f", 6 + 2 * k)).alias("a"), name(F.get("f", 7 + 2 * k)).alias("b")))
    sex = F.when(F.col("f")[4] == "1", "M").when(F.col("f")[4] == "2", "F").otherwise("U")
    samples = rows.select(F.col("idx").cast("int").alias("sample_idx"), F.col("f")[1].alias("sample_id"), sex.alias("sex"), F.col("f")[5].alias("population"))
    long = rows.select(F.col("idx").cast("int").alias("sample_idx"), F.posexplode(calls).alias("snp_idx", "c")).select("sample_idx", F.col("snp_idx").cast("long").alias("snp_idx"), F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    snps = _read_map(spark, paths[1])
    # alleles not named by the map: the lesser seen comes first
    seen = long.select("snp_idx", F.explode(F.array("a", "b")).alias("x")).where("x <> '0'").groupBy("snp_idx").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    snps = snps.join(seen, "snp_idx", "left").select("snp_idx", "snp_id", "chrom", "gpos", "ppos", F.coalesce("ref", "lo").alias("ref"), F.coalesce("alt", F.when(F.col("hi") != F.col("lo"), F.col("hi"))).alias("alt"))
    calls = long.join(snps.select("snp_idx", "ref"), "snp_idx").withColumn("d", F.when((F.col("a") != "0") & (F.col("b") != "0"), (F.col("a") == F.col("ref")).cast("double") + (F.col("b") == F.col("ref")).cast("double")))
    g = calls.groupBy("snp_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "d"))).alias("s")).select("snp_idx", F.col("s.d").alias("g"))
    return Genotypes(g, samples, snps)


def read_genotypes(spark: SparkSession, prefix: str, fmt: FileFormat = FileFormat.EIGENSTRAT) -> Genotypes:
    paths = filenames(prefix, fmt)
    if fmt is FileFormat.EIGENSTRAT:
        return Genotypes(read_geno(spark, paths[0]), read_ind(spark, paths[2]), read_snp(spark, paths[1]).drop("n_fields"))
    if fmt is FileFormat.PED:
        return _read_ped(spark, paths)
    if fmt is FileFormat.PACKEDPED:
        samples = _read_fam(spark, paths[2])
        n = samples.count()
        return Genotypes(read_packed(spark, paths[0], "bed", n), samples, _read_map(spark, paths[1]))
    samples, snps = read_ind(spark, paths[2]), read_snp(spark, paths[1]).drop("n_fields")
    n = samples.count()
    if fmt is FileFormat.PACKEDANCESTRYMAP:
        return Genotypes(read_packed(spark, paths[0], "packed", n), samples, snps)
    f = _fields(F.col("value"))
    calls = spark.read.text(paths[0]).select(f[0].alias("snp_id"), f[1].alias("sample_id"), F.when(f[2] != "9", f[2].cast("double")).alias("d")).where("snp_id is not null and snp_id <> ''")
    long = calls.join(samples.select("sample_id", "sample_idx"), "sample_id").join(snps.select("snp_id", "snp_idx"), "snp_id")
    return Genotypes(to_packed(long.withColumnRenamed("d", "dosage"), n), samples, snps)


def write_eigenstrat(data: Genotypes, prefix: str) -> None:
    """An EIGENSTRAT triple; each of its three names is a folder of part files, as Spark writes them. read_genotypes reads it back."""
    geno, _, _ = filenames(prefix, FileFormat.EIGENSTRAT)
    digit = F.array_join(F.transform("g", lambda v: F.coalesce(v.cast("int").cast("string"), F.lit("9"))), "")
    write_lines(data.packed.select(F.col("snp_idx").alias("idx"), digit.alias("value")), geno)
    _write_snp_ind(data, prefix)


def _write_snp_ind(data: Genotypes, prefix: str) -> None:
    _, snp, ind = filenames(prefix, FileFormat.EIGENSTRAT)
    text = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    write_lines(data.snps.select(F.col("snp_idx").alias("idx"), text("snp_id", "chrom", "gpos", "ppos", "ref", "alt").alias("value")), snp)
    write_lines(data.samples.select(F.col("sample_idx").alias("idx"), text("sample_id", "sex", "population").alias("value")), ind)


def write_ped(data: Genotypes, prefix: str) -> None:
    """PED, map and fam. Alleles that the SNPs don't name are 1 and 2."""
    ped, map_, fam = filenames(prefix, FileFormat.PED)
    long = data.packed.select("snp_idx", F.posexplode("g").alias("sample_idx", "d")).join(data.snps.select("snp_idx", "ref", "alt"), "snp_idx")
    r, a = F.coalesce("ref", F.lit("1")), F.coalesce("alt", F.lit("2"))
    call = F.when(F.col("d") == 2, F.concat_ws(" ", r, r)).when(F.col("d") == 1, F.concat_ws(" ", r, a)).when(F.col("d") == 0, F.concat_ws(" ", a, a)).otherwise("0 0")
    rows = long.groupBy("sample_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("snp_idx", call.alias("c")))), lambda x: x["c"]), " ").alias("calls"))
    head = _fam(data.samples)
    write_lines(head.join(rows, "sample_idx").select(F.col("sample_idx").alias("idx"), F.concat_ws(" ", "head", "calls").alias("value")), ped)
    write_lines(head.select(F.col("sample_idx").alias("idx"), F.col("head").alias("value")), fam)
    write_lines(data.snps.select(F.col("snp_idx").alias("idx"), F.concat_ws(" ", "chrom", "snp_id", F.col("gpos").cast("string"), F.col("ppos").cast("string"), "ref", "alt").alias("value")), map_)


def _fam(samples: DataFrame) -> DataFrame:
    """(sample_idx, head): a sample's first six fields, its place as family and its population as phenotype."""
    sex = F.when(F.col("sex") == "M", "1").when(F.col("sex") == "F", "2").otherwise("0")
    return samples.select("sample_idx", F.concat_ws(" ", F.col("sample_idx").cast("string"), "sample_id", F.lit("0 0"), sex, F.regexp_replace("population", " ", "_")).alias("head"))


def write_ancestrymap(data: Genotypes, prefix: str) -> None:
    """A line of SNP, sample and dosage for each present call."""
    geno, _, _ = filenames(prefix, FileFormat.ANCESTRYMAP)
    _write_snp_ind(data, prefix)
    calls = data.packed.select("snp_idx", F.posexplode("g").alias("sample_idx", "d")).join(data.snps.select("snp_idx", "snp_id"), "snp_idx").join(data.samples.select("sample_idx", "sample_id"), "sample_idx")
    line = F.concat_ws(" ", "snp_id", "sample_id", F.coalesce(F.col("d").cast("int").cast("string"), F.lit("9")))
    write_lines(calls.select(F.struct("snp_idx", "sample_idx").alias("idx"), line.alias("value")), geno)


def content_digest(data: Genotypes, block: int = 4096) -> str:
    """A digest of calls, SNPs and samples in their order, the same for copies of a set wherever and in how many files they are. Rows are hashed where they are read, blocks of rows next, and the digest is that of the blocks' in order: the driver sees one for each block."""
    text = lambda *c: F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    calls = F.array_join(F.transform("g", lambda v: F.coalesce(v.cast("int").cast("string"), F.lit("9"))), "")
    out = hashlib.sha256()
    for df, order, value in ((data.packed, "snp_idx", calls), (data.snps, "snp_idx", text("snp_id", "chrom", "gpos", "ppos", "ref", "alt")), (data.samples, "sample_idx", text("sample_id", "sex", "population"))):
        rows = df.select(F.col(order).alias("i"), F.sha2(value, 256).alias("h"))
        blocks = rows.groupBy(F.floor(F.col("i") / block).alias("b")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda z: F.concat(z["i"].cast("string"), F.lit(":"), z["h"])), ","), 256).alias("h"))
        out.update(f"{order}\n".encode())
        for r in blocks.orderBy("b").collect():
            out.update(r.h.encode())
    return out.hexdigest()


def ids_hash(ids: DataFrame, order: str, name: str) -> int:
    """The checksum of ids in order that packed files carry: 32 bits, each id's own by Horner's rule in 23, folded in by 17 and exclusive or. Folding is sequential, so the driver runs through one number for each id."""
    own = F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda h, c: (h * 23 + F.ascii(c)) % (1 << 32))
    out = 0
    for r in ids.select(order, own.alias("h")).orderBy(order).toLocalIterator(prefetchPartitions=True):
        out = (out * 17 % (1 << 32)) ^ r.h
    return out


def write_packed_ancestrymap(data: Genotypes, prefix: str) -> None:
    """A packed .geno file with the usual header, and .snp and .ind as in an EIGENSTRAT triple."""
    geno, _, _ = filenames(prefix, FileFormat.PACKEDANCESTRYMAP)
    n, m = data.samples.count(), data.snps.count()
    head = f"GENO {n:7d} {m:7d} {ids_hash(data.samples, 'sample_idx', 'sample_id'):x} {ids_hash(data.snps, 'snp_idx', 'snp_id'):x}".encode()
    _write_snp_ind(data, prefix)
    write_packed(data.packed, geno, "packed", n, m, head.ljust(LAYOUTS["packed"].head(n), b"\0"))


def write_packed_ped(data: Genotypes, prefix: str) -> None:
    """bed (by SNP), bim and fam. Alleles that the SNPs don't name are 1 and 2."""
    bed, bim, fam = filenames(prefix, FileFormat.PACKEDPED)
    write_lines(_fam(data.samples).select(F.col("sample_idx").alias("idx"), F.col("head").alias("value")), fam)
    line = F.concat_ws(" ", "chrom", "snp_id", F.col("gpos").cast("string"), F.col("ppos").cast("string"), F.coalesce("ref", F.lit("1")), F.coalesce("alt", F.lit("2")))
    write_lines(data.snps.select(F.col("snp_idx").alias("idx"), line.alias("value")), bim)
    write_packed(data.packed, bed, "bed", data.samples.count(), data.snps.count(), b"\x6c\x1b\x01")


WRITERS: dict[FileFormat, Callable[[Genotypes, str], None]] = {
    FileFormat.EIGENSTRAT: write_eigenstrat, FileFormat.ANCESTRYMAP: write_ancestrymap, FileFormat.PACKEDANCESTRYMAP: write_packed_ancestrymap, FileFormat.PED: write_ped, FileFormat.PACKEDPED: write_packed_ped,
}


def convert(spark: SparkSession, prefix: str, fmt: FileFormat, out_prefix: str, to: FileFormat = FileFormat.EIGENSTRAT) -> str:
    """Any format to any other, under out_prefix."""
    data = read_genotypes(spark, prefix, fmt)
    WRITERS[to](Genotypes(data.packed, clean_ids(data.samples), data.snps), out_prefix)
    return out_prefix
