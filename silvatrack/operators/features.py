"""Continuous signal: scaled counts, smoothing and derivatives along the chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segment import smooth


def scaled(counts: DataFrame) -> DataFrame:
    """(species, mark, chrom, bin, value): asinh of counts for each million of the sample's reads."""
    totals = counts.groupBy("species", "mark").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), ["species", "mark"]).select("species", "mark", "chrom", "bin", F.asinh(F.col("n") / (F.col("total") / 1e6)).alias("value"))


def smooth_signal(signal: DataFrame, sizes: DataFrame, w: int = 3) -> DataFrame:
    return smooth(signal, sizes, w, "value", ("species", "mark", "chrom"))


def gradient(signal: DataFrame, sizes: DataFrame) -> DataFrame:
    """species, mark, chrom, bin, value, g, gg: the signal on every bin (0 where it has none) and its first and second
    derivative, by central differences, one-sided at the ends."""
    samples = signal.select("species", "mark", "chrom").distinct().join(F.broadcast(sizes.select("chrom", "bins")), "chrom")
    dense = samples.select("species", "mark", "chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    out = dense.join(signal, ["species", "mark", "chrom", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    order = Window.partitionBy("species", "mark", "chrom").orderBy("bin")
    for new, old in (("g", "value"), ("gg", "g")):
        before, after = F.lag(old).over(order), F.lead(old).over(order)
        both = before.isNotNull() & after.isNotNull()
        slope = F.when(both, (after - before) / 2).otherwise(F.coalesce(after - F.col(old), F.col(old) - before, F.lit(0.0)))
        out = out.withColumn(new, slope)
    return out
