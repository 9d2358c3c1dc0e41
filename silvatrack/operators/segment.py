"""From calls to chunks: density, smoothing, runs of kept bins, chunk numbers, cutting and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import gauss_kernel

#: Digits to which smoothed values are rounded before they meet a threshold, so that the order of a sum cannot turn it.
DIGITS = 9


def density(calls: DataFrame) -> DataFrame:
    """(chrom, bin, d): calls of all species and marks in a bin, non-zero alone."""
    return calls.groupBy("chrom", "bin").agg(F.count(F.lit(1)).cast("double").alias("d"))


def smooth(values: DataFrame, sizes: DataFrame, w: int, value: str = "d", by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """by, bin, s: zero-padded convolution with gauss_kernel(w); each value goes to the 2 * w + 1 bins around it."""
    taps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(v).alias("k")) for x, v in gauss_kernel(w)]))
    spread = values.select(*by, "bin", value, taps.alias("t")).select(*by, (F.col("bin") + F.col("t.x")).alias("bin"), (F.col(value) * F.col("t.k")).alias("s"))
    inside = spread.join(F.broadcast(sizes.select("chrom", "bins")), "chrom").filter("bin >= 0 AND bin < bins")
    return inside.groupBy(*by, "bin").agg(F.round(F.sum("s"), DIGITS).alias("s"))


def smooth_blocks(values: DataFrame, sizes: DataFrame, w: int, block: int = 1 << 20) -> DataFrame:
    """As smooth, for wide kernels: blocks of bins, with w bins more on either side, are convolved in tasks of their own."""
    at = F.expr(f"explode(sequence(greatest(0, (bin - {w}) div {block}), (bin + {w}) div {block}))").alias("block")
    kernel = np.array([v for _, v in gauss_kernel(w)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["block"].iloc[0]) * block - w
        at_ = pdf["bin"].to_numpy() - first
        low, high = int(at_.min()), int(at_.max()) + 1
        dense = np.zeros(high - low)
        dense[at_ - low] = pdf["d"].to_numpy()
        full = np.convolve(dense, kernel)
        bins = first + low - w + np.arange(len(full))
        keep = (full > 0) & (bins >= first + w) & (bins < first + w + block)
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "bin": bins[keep], "s": full[keep].round(DIGITS)})

    done = values.select("chrom", "bin", "d", at).groupBy("chrom", "block").applyInPandas(one, "chrom string, bin long, s double")
    return done.join(F.broadcast(sizes.select("chrom", "bins")), "chrom").filter("bin >= 0 AND bin < bins").select("chrom", "bin", "s")


def runs(values: DataFrame, least: float, value: str = "s", block: int = 1 << 16) -> DataFrame:
    """(chrom, start, end): maximal runs of bins of at least this value; end is past the last. Blocks of bins find their runs on their
    own; then runs that touch a block's border are joined to those that go on behind it, of which a block has two at most."""
    kept = values.filter(F.col(value) >= least).select("chrom", "bin", F.expr(f"bin div {block}").alias("block"))
    order = Window.partitionBy("chrom", "block").orderBy("bin")
    island = kept.select("chrom", "block", "bin", (F.col("bin") - F.row_number().over(order)).alias("island"))
    found = island.groupBy("chrom", "block", "island").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"))
    found = found.withColumn("touches", (F.col("start") == F.col("block") * block) | (F.col("end") == (F.col("block") + 1) * block))
    along = Window.partitionBy("chrom").orderBy("start")  # a row or two for each block
    goes_on = F.coalesce(F.lag("end").over(along) == F.col("start"), F.lit(False))
    joined = found.filter("touches").select("chrom", "start", "end", F.when(goes_on, 0).otherwise(1).alias("new")).withColumn("run", F.sum("new").over(along))
    joined = joined.groupBy("chrom", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.filter("NOT touches").select("chrom", "start", "end").unionByName(joined.select("chrom", "start", "end"))


def chunks(found: DataFrame, min_size: int, legacy_edge: bool = False) -> DataFrame:
    """(chunk_id, chrom, number, start, end): runs of at least min_size bins, numbered from 0 on each chromosome; chunk_id is
    the chromosome's rank times 2 ** 32, and the number. legacy_edge moves bounds one bin to the left."""
    kept = found.filter(F.col("end") - F.col("start") >= min_size)
    if legacy_edge:
        kept = kept.select("chrom", F.greatest(F.col("start") - 1, F.lit(0)).alias("start"), (F.col("end") - 1).alias("end"))
    number = (F.row_number().over(Window.partitionBy("chrom").orderBy("start")) - 1).cast("long")
    ranks = kept.select("chrom").distinct().withColumn("rank", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("long"))  # a row for each chromosome
    return kept.withColumn("number", number).join(F.broadcast(ranks), "chrom").select((F.col("rank") * 2**32 + F.col("number")).alias("chunk_id"), "chrom", "number", "start", "end")


def split_long(found: DataFrame, max_bins: int) -> DataFrame:
    """Chunks of more than max_bins are cut; the parts are then independent (an approximation) and numbered anew."""
    parts = found.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(max_bins).cast("long"))).alias("start"), "end")
    return chunks(parts.select("chrom", "start", F.least("end", F.col("start") + max_bins).alias("end")), 1)


def cut(calls: DataFrame, found: DataFrame, span: int = 4096) -> DataFrame:
    """(chunk_id, t, calls' columns): calls inside chunks, t counting from the chunk's start. Both sides meet by spans of bins, so
    that neither is broadcast."""
    spans = found.select("chunk_id", "chrom", "start", "end", F.expr(f"explode(sequence(start div {span}, (end - 1) div {span}))").alias("span"))
    return (
        calls.withColumn("span", F.expr(f"bin div {span}")).join(spans, ["chrom", "span"])
        .filter("bin >= start AND bin < end").withColumn("t", F.col("bin") - F.col("start")).drop("span", "start", "end")
    )


def coverage(found: DataFrame, kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: regions, total_bins, covered_bins, ratio, and kept_bins before short runs were dropped."""
    zero, length = F.lit(0).cast("long"), (F.col("end") - F.col("start")).cast("long")
    parts = (
        found.select(F.lit(1).cast("long").alias("regions"), length.alias("covered_bins"), zero.alias("kept_bins"), zero.alias("total_bins"))
        .unionAll(kept.select(zero, zero, length, zero)).unionAll(sizes.select(zero, zero, zero, "bins"))
    )
    sums = parts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in parts.columns])
    return sums.withColumn("ratio", F.col("covered_bins") / F.col("total_bins"))


def size_histogram(found: DataFrame, bars: int = 100) -> DataFrame:
    """(bar, n): chunks by size, in bars of equal width from the smallest to the largest."""
    size = found.select((F.col("end") - F.col("start")).alias("size"))
    low, high = size.agg(F.min("size"), F.max("size")).first()
    bar = F.lit(0) if high == low else F.least(F.floor((F.col("size") - low) / float(high - low) * bars), F.lit(bars - 1))
    return size.select(bar.cast("int").alias("bar")).groupBy("bar").agg(F.count(F.lit(1)).alias("n"))


def trim(sizes: DataFrame, calls: DataFrame) -> DataFrame:
    """(chrom, start, end): each chromosome's bins from the first to the last with a call."""
    return calls.groupBy("chrom").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end")).join(F.broadcast(sizes.select("chrom")), "chrom")


def regions_of_signal(signal: DataFrame, least: float, min_size: int) -> DataFrame:
    """Chunks where the signal's sum over species and marks is at least this, without smoothing."""
    total = signal.groupBy("chrom", "bin").agg(F.round(F.sum("value"), DIGITS).alias("s"))
    return chunks(runs(total, least), min_size)
