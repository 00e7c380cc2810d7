"""Enums and schemas."""

from enum import Enum

from pyspark.sql import types as T


class FileFormat(Enum):
    EIGENSTRAT = "EIGENSTRAT"
    ANCESTRYMAP = "ANCESTRYMAP"
    PACKEDANCESTRYMAP = "PACKEDANCESTRYMAP"
    PED = "PED"
    PACKEDPED = "PACKEDPED"


class EmbeddingAlgorithm(Enum):
    PCA = "PCA"
    MDS = "MDS"


class AnalysisMode(Enum):
    BOOTSTRAP = "BOOTSTRAP"
    SLIDING_WINDOW = "SLIDING_WINDOW"


#: One row per feature; the array runs over samples in order. Missing is NULL.
PACKED = T.StructType([T.StructField("snp_idx", T.LongType(), False), T.StructField("g", T.ArrayType(T.DoubleType()), False)])
SAMPLES = T.StructType([T.StructField("sample_idx", T.IntegerType()), T.StructField("sample_id", T.StringType()), T.StructField("sex", T.StringType()), T.StructField("population", T.StringType())])
SNPS = T.StructType([T.StructField(n, t) for n, t in (("snp_idx", T.LongType()), ("snp_id", T.StringType()), ("chrom", T.StringType()), ("gpos", T.DoubleType()), ("ppos", T.LongType()), ("ref", T.StringType()), ("alt", T.StringType()))])
#: One row per replicate and sample.
EMBEDDING = T.StructType([T.StructField("replicate_id", T.IntegerType()), T.StructField("sample_id", T.StringType()), T.StructField("population", T.StringType()), T.StructField("coords", T.ArrayType(T.DoubleType()))])
