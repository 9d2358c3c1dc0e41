"""From reads to calls: filters, binning, pooled counts, background rates and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.poisson import threshold

# Bits of the flag.
PAIRED, PROPER = 0x1, 0x2
BAD = 0x4 | 0x100 | 0x200 | 0x400  # unmapped, secondary, failed quality control, duplicate
EXCLUDED = ("chrM", "chrY", "chrX")


def qc_filter(reads: DataFrame, skip: bool = False) -> DataFrame:
    """Reads that are mapped, primary, passed, no duplicate and of mapping quality over 0."""
    return reads if skip else reads.filter((F.col("flag").bitwiseAND(BAD) == 0) & (F.col("mapq") > 0))


def pair_filter(reads: DataFrame) -> DataFrame:
    """Unpaired reads, and properly paired ones."""
    return reads.filter((F.col("flag").bitwiseAND(PAIRED) == 0) | (F.col("flag").bitwiseAND(PROPER) != 0))


def select_chroms(chrom_sizes: DataFrame, window: int, chroms: list[str] | None = None, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(chrom, length, bins) of the chromosomes asked for (None: all), without excluded ones and those under a window."""
    kept = chrom_sizes.filter(~F.col("chrom").isin(*exclude))
    kept = kept if chroms is None else kept.filter(F.col("chrom").isin(*chroms))
    return kept.withColumn("bins", F.expr(f"length div {window}")).filter("bins > 0")


def bin_reads(reads: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """Reads on the chromosomes of sizes with their bin: of a fragment's middle if paired (both mates count), else of the
    place 100 on; places past the last full bin fall into it. sizes has a row for each chromosome."""
    mid = f"(CASE WHEN (flag & {PAIRED}) <> 0 THEN (pos + mpos + rlen) div 2 ELSE pos + 100 END) div {window}"
    return reads.join(F.broadcast(sizes.select("chrom", "bins")), "chrom").withColumn("bin", F.least(F.col("bins") - 1, F.expr(mid))).drop("bins")


def histogram(binned: DataFrame) -> DataFrame:
    """(species, mark, rep, chrom, bin, n): counts of reads, non-zero alone."""
    return binned.groupBy("species", "mark", "rep", "chrom", "bin").agg(F.count(F.lit(1)).alias("n"))


def pool(binned: DataFrame) -> DataFrame:
    """(species, mark, chrom, bin, n): replicates together."""
    return binned.groupBy("species", "mark", "chrom", "bin").agg(F.count(F.lit(1)).alias("n"))


def rates(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(species, mark, total, total_bins, rate): reads for each bin, over chromosomes on which the sample has a read."""
    by = counts.groupBy("species", "mark", "chrom").agg(F.sum("n").alias("n")).join(F.broadcast(sizes.select("chrom", "bins")), "chrom")
    sums = by.groupBy("species", "mark").agg(F.sum("n").alias("total"), F.sum("bins").alias("total_bins"))
    return sums.withColumn("rate", F.col("total") / F.col("total_bins"))


def thresholds(rate_table: DataFrame, level: float) -> DataFrame:
    """rates with least: the smallest count that is present."""
    return rate_table.withColumn("least", threshold(F.col("rate"), level))


def call(counts: DataFrame, least: DataFrame, sizes: DataFrame) -> DataFrame:
    """(species, mark, chrom, bin) where a sample is present. A sample whose threshold is 0 is present in every bin, those
    without reads too. least has a row for each sample."""
    some = counts.join(F.broadcast(least.select("species", "mark", "least")), ["species", "mark"]).filter((F.col("n") >= F.col("least")) & (F.col("least") > 0))
    chroms = sizes.groupBy().agg(F.collect_list(F.struct("chrom", "bins")).alias("chroms"))  # one row, as long as the header
    every = least.filter("least = 0").select("species", "mark", F.explode(chroms.scalar()).alias("c"))
    every = every.select("species", "mark", "c.chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.bins") - 1)).alias("bin"))
    return some.select("species", "mark", "chrom", "bin").unionByName(every)


def diagnostics(counts: DataFrame, least: DataFrame, upto: int = 20) -> DataFrame:
    """(species, mark, most, n, present): the largest count of a sample, and for counts under upto whether they are present."""
    most = counts.groupBy("species", "mark").agg(F.max("n").alias("most")).join(least.select("species", "mark", "least"), ["species", "mark"])
    return most.select("species", "mark", "most", F.explode(F.sequence(F.lit(0), F.lit(upto - 1))).alias("n"), "least").withColumn("present", F.col("n") >= F.col("least")).drop("least")


def index_calls(calls: DataFrame, species_dim: DataFrame, mark_dim: DataFrame) -> DataFrame:
    """(i, l, chrom, bin): sparse; what is not there is absent. The dimensions are a few rows each."""
    return calls.join(F.broadcast(species_dim), "species").join(F.broadcast(mark_dim), "mark").select("i", "l", "chrom", "bin")


def availability(counts: DataFrame, species_dim: DataFrame, mark_dim: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(i, l) pairs that have data; a table given takes their place."""
    if given is not None:
        return given.select("i", "l").distinct()
    return counts.select("species", "mark").distinct().join(F.broadcast(species_dim), "species").join(F.broadcast(mark_dim), "mark").select("i", "l")


def wide(calls: DataFrame, grid: DataFrame, species: int, marks: int) -> DataFrame:
    """A row for each bin of grid (chrom, bin) and a column c<i * marks + l> of 0 or 1 for each species and mark."""
    cells = list(range(species * marks))
    some = calls.withColumn("il", F.col("i") * marks + F.col("l")).groupBy("chrom", "bin").pivot("il", cells).agg(F.lit(1))
    return grid.join(some, ["chrom", "bin"], "left").select("chrom", "bin", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"c{c}") for c in cells])


def grid(sizes: DataFrame) -> DataFrame:
    """(chrom, bin) of every bin."""
    return sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
