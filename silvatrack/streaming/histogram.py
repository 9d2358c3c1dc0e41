"""Reads that arrive over time: the same filters and bins as a batch, counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convert


def stream_counts(reads: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """(species, mark, chrom, bin, n) of a stream of reads, for output mode update or complete. Its state is a row for each
    bin with reads, which the genome's length bounds."""
    return convert.pool(convert.bin_reads(convert.pair_filter(convert.qc_filter(reads)), sizes, window))


def add_batch(path: str):
    """A foreachBatch sink that keeps each batch's counts in a folder of its own: a batch that is written again replaces its
    rows, so that every read counts once."""

    def write(batch: DataFrame, number: int) -> None:
        convert.pool(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def total(batches: DataFrame) -> DataFrame:
    """The counts of all batches that add_batch wrote."""
    return batches.groupBy("species", "mark", "chrom", "bin").agg(F.sum("n").alias("n"))
