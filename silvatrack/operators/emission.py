"""Emission log-likelihoods and their statistics, as joins and sums; parameters are tables of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bernoulli_arrays(nodes: DataFrame, calls: DataFrame, emit: DataFrame, avail: DataFrame) -> DataFrame:
    """nodes (chrom, bin, i and more) with ll, an array of K: the sum over available marks of log e or log (1 - e) in each state. emit is
    (k, l, e), avail (i, l), calls (chrom, bin, i, l). Absent marks come from the base of each species, present ones add their odds:
    a row of K sums for each cell with calls is all that is shuffled. Nodes and cells both grow with the data, and neither is broadcast."""
    states = (emit.agg(F.max("k")).first()[0] or 0) + 1
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value])
    base = avail.join(F.broadcast(emit), "l").groupBy("i", "k").agg(F.sum(F.log(1 - F.col("e"))).alias("base")).groupBy("i").agg(in_order("base").alias("base"))
    odds = emit.withColumn("odds", F.log(F.col("e") / (1 - F.col("e")))).groupBy("l").agg(in_order("odds").alias("odds"))
    sums = [F.sum(F.get("odds", F.lit(k))).alias(f"odds{k}") for k in range(states)]
    present = calls.join(F.broadcast(avail), ["i", "l"]).join(F.broadcast(odds), "l").groupBy("chrom", "bin", "i").agg(*sums)
    ll = F.array(*[F.get("base", F.lit(k)) + F.coalesce(f"odds{k}", F.lit(0.0)) for k in range(states)])
    return nodes.join(F.broadcast(base), "i").join(present.hint("merge"), ["chrom", "bin", "i"], "left").select(*nodes.columns, ll.alias("ll"))


def bernoulli(nodes: DataFrame, calls: DataFrame, emit: DataFrame, avail: DataFrame) -> DataFrame:
    """(chrom, bin, i, k, ll) for each node (chrom, bin, i) and state."""
    return bernoulli_arrays(nodes.select("chrom", "bin", "i"), calls, emit, avail).select("chrom", "bin", "i", F.posexplode("ll").alias("k", "ll"))


def gaussian(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, k, ll): rows are (id, x array), centres (k, mean array, variance array), a row for each state: diagonal; not finite,
    or 0, is -100."""
    doubles = lambda v: F.array(*[F.lit(float(x)) for x in v])
    states = [F.struct(F.lit(c["k"]).alias("k"), doubles(c["mean"]).alias("mean"), doubles(c["variance"]).alias("variance")) for c in centres.orderBy("k").collect()]
    pairs = rows.select("id", "x", F.explode(F.array(*states)).alias("s")).select("id", "x", "s.*")
    terms = F.transform(F.arrays_zip("x", "mean", "variance"), lambda z: F.log(2 * F.pi() * z["variance"]) + F.pow(z["x"] - z["mean"], 2) / z["variance"])
    ll = -0.5 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return pairs.select("id", "k", F.when(F.isnan(ll) | ll.isNull() | (F.abs(ll) == float("inf")) | (ll == 0), -100.0).otherwise(ll).alias("ll"))


def normalize(q: DataFrame, calls: DataFrame, avail: DataFrame, pseudocount: float, states: int) -> DataFrame:
    """(k, l, e): posterior weight of present over that of available, with pseudocounts. q is (chrom, bin, i, q array of states): it meets
    the calls as one row for each cell. Both sides grow with the data, whatever a plan takes posteriors made from a few chunks for, so
    neither is broadcast."""
    ks = range(states)
    total = q.groupBy("i").agg(*[F.sum(F.get("q", F.lit(k))).alias(f"q{k}") for k in ks]).join(F.broadcast(avail), "i").groupBy("l").agg(*[F.sum(f"q{k}").alias(f"total{k}") for k in ks])
    cells = calls.join(F.broadcast(avail), ["i", "l"]).hint("merge").join(q, ["chrom", "bin", "i"])
    present = cells.groupBy("l").agg(*[F.sum(F.get("q", F.lit(k))).alias(f"present{k}") for k in ks])
    e = F.array(*[(F.coalesce(f"present{k}", F.lit(0.0)) + pseudocount) / (F.col(f"total{k}") + 2 * pseudocount) for k in ks])
    return total.join(F.broadcast(present), "l", "left").select("l", F.posexplode(e).alias("k", "e")).select("k", "l", "e")
