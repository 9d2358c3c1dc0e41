"""The jobs before a fit: convert, from files of reads to an observation set, and split, from observation sets to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert as steps
from ..operators import segment
from ..sources import reads, tables


def _numbered(spark: SparkSession, names: list[str], name: str, number: str) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{name} string, {number} int")


def convert(
    spark: SparkSession, paths: str | list[str], template: str, species: list[str], marks: list[str], chrom_sizes: DataFrame, out: str,
    window: int = 200, level: float = 1e-4, chroms: list[str] | None = None, format: str = "parquet", skip_qc: bool = False,
) -> DataFrame:
    """Reads the files whose names follow template, calls presence and writes the observation set out: calls (i, l, chrom, bin), the pairs
    with data, and what the set was made with. Species and marks are numbered as given; a pair of them without a file is an
    error, and files of others are left out. Returns the calls as written."""
    found = reads.discover_samples(spark, paths, template, format, None if format == "parquet" else reads.READS)
    species_dim, mark_dim = _numbered(spark, species, "species", "i"), _numbered(spark, marks, "mark", "l")
    found = found.join(F.broadcast(species_dim.select("species")), "species").join(F.broadcast(mark_dim.select("mark")), "mark")
    found = reads.require_samples(found, species_dim, mark_dim)
    sizes = steps.select_chroms(chrom_sizes, window, chroms)
    counts = tables.kept(steps.pool(steps.bin_reads(steps.pair_filter(steps.qc_filter(found, skip_qc)), sizes, window)), "counts")
    least = tables.kept(steps.thresholds(steps.rates(counts, sizes), level), "thresholds")
    calls = steps.index_calls(steps.call(counts, least, sizes), species_dim, mark_dim)
    meta = spark.createDataFrame([(window, level, species, marks)], "window int, level double, species array<string>, marks array<string>")
    tables.write_observations(calls, meta, out)
    steps.availability(least, species_dim, mark_dim).coalesce(1).write.mode("overwrite").parquet(f"{out}/avail")
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{out}/sizes")
    return tables.read_observations(spark, out)


def split(spark: SparkSession, *patterns: str, out: str, kernel: int = 200, min_reads: float = 0.5, min_size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(chunks, calls inside them) of the observation sets that the patterns match, written to the folder out; a pattern without a match is
    an error."""
    calls = tables.read_observations(spark, *patterns)
    sizes = spark.read.parquet(*[f"{p}/sizes" for p in patterns]).distinct()
    smooth = segment.smooth if kernel <= 16 else segment.smooth_blocks
    found = segment.chunks(segment.runs(smooth(segment.density(calls), sizes, kernel), min_reads), min_size)
    found.write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    segment.cut(calls, chunks).write.mode("overwrite").parquet(f"{out}/calls")
    return chunks, spark.read.parquet(f"{out}/calls")
