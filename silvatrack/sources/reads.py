"""Aligned reads as tables: Parquet or CSV files, SAM text, and samples named by their files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "species string, mark string, rep int, chrom string, pos bigint, mpos bigint, rlen int, flag int, mapq int"


def read_reads(spark: SparkSession, path: str | list[str], format: str = "parquet", **options) -> DataFrame:
    """Reads in the schema READS."""
    return spark.read.format(format).schema(READS).options(**options).load(path)


def read_sam(spark: SparkSession, path: str | list[str], species: str, mark: str, rep: int = 1) -> tuple[DataFrame, DataFrame]:
    """(reads, chrom_sizes) of SAM text of one sample. Places count from 0; a mate on the same chromosome ("=", or by its
    name) has its place, any other 0; a read without an alignment has chrom "*"."""
    lines = spark.read.text(path)
    f = F.split("value", "\t")
    header = lines.filter(F.col("value").startswith("@SQ"))
    sizes = header.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    body = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    reads = body.select(
        F.lit(species).alias("species"), F.lit(mark).alias("mark"), F.lit(rep).alias("rep"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("pos"),
        F.when((f[7] != "0") & ((f[6] == "=") | (f[6] == f[2])), f[7].cast("long") - 1).otherwise(0).cast("long").alias("mpos"), F.length(f[9]).alias("rlen"), f[1].cast("int").alias("flag"), f[4].cast("int").alias("mapq"),
    )
    return reads, sizes.distinct()


def discover_samples(spark: SparkSession, paths: str | list[str], template: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of files whose names follow template, such as "{species}_{mark}_rep{rep}", with the parts of the name as
    columns. Files that do not follow it are left out. A template with / in it is held against as many folders above the file
    too: "{species}_{mark}_rep{rep}/" takes the names of the folders that the files are in."""
    pattern = re.escape(template)
    names = re.findall(r"\{(\w+)\}", template)
    for n in names:
        pattern = pattern.replace(re.escape("{" + n + "}"), r"(\d+)" if n == "rep" else r"([^_/.]+)")
    reader = spark.read.format(format)
    df = (reader.schema(schema) if schema else reader).load(paths)
    parts = F.split("_metadata.file_path", "/")
    name = F.array_join(F.slice(parts, F.size(parts) - template.count("/"), template.count("/") + 1), "/")
    df = df.withColumn("_name", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).filter(F.col("_name").rlike("^" + pattern))
    for i, n in enumerate(names, 1):
        part = F.regexp_extract("_name", "^" + pattern, i)
        df = df.withColumn(n, part.cast("int") if n == "rep" else part)
    return df.drop("_name")


def _pairs(species: DataFrame, marks: DataFrame) -> DataFrame:
    """Every species with every mark; the dimension tables are a few rows each."""
    all_marks = marks.agg(F.collect_set("mark").alias("marks"))  # one row
    return species.select("species").distinct().withColumn("mark", F.explode(all_marks.scalar()))


def missing_samples(samples: DataFrame, species: DataFrame, marks: DataFrame) -> DataFrame:
    """(species, mark) pairs without a sample; the dimension tables are a few rows each."""
    pairs = _pairs(species, marks)
    return pairs.join(samples.select("species", "mark").distinct(), ["species", "mark"], "left_anti")


def sample_table(reads: DataFrame, species: DataFrame, marks: DataFrame) -> DataFrame:
    """(species, mark, reps, n): replicates and reads of every pair of the dimension tables, 0 where there are none."""
    held = reads.groupBy("species", "mark", "rep").agg(F.count(F.lit(1)).alias("n")).groupBy("species", "mark").agg(F.count(F.lit(1)).alias("reps"), F.sum("n").alias("n"))
    pairs = _pairs(species, marks)
    zero = F.lit(0).cast("long")
    return pairs.join(held, ["species", "mark"], "left").select("species", "mark", F.coalesce("reps", zero).alias("reps"), F.coalesce("n", zero).alias("n"))


def require_samples(samples: DataFrame, species: DataFrame, marks: DataFrame) -> DataFrame:
    """samples, if every pair has one; else an error that names pairs without."""
    missing = missing_samples(samples, species, marks)
    some = [f"{r['species']}/{r['mark']}" for r in missing.orderBy("species", "mark").limit(20).collect()]
    if some:
        raise ValueError(f"{missing.count()} pairs of species and mark have no sample: {', '.join(some)}")
    return samples
