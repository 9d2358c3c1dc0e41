"""Steps of the inference as plain joins, windows and sums over posteriors q: (chunk_id, i, t, q array of K). The tree is
(i, parent), parent null for roots; parameters are numpy arrays, written into the expressions. Tables of posteriors take a byte or
less a row in files, by which Spark would take them for small: they meet by sorted merges, and are never broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.model import log


def _dot(weights: np.ndarray, *arrays: Column) -> Column:
    """Sum over all indices of weights times one entry of each array column."""
    terms = []
    for idx in np.ndindex(weights.shape):
        term = F.lit(float(weights[idx]))
        for a, i in zip(arrays, idx):
            term = term * F.get(a, F.lit(i))
        terms.append(term)
    return sum(terms[1:], terms[0])


def neighbours(q: DataFrame, tree: DataFrame) -> DataFrame:
    """q with parent, before and after (the same species' neighbouring bins), above (the parent's q) and above_after."""
    order = Window.partitionBy("chunk_id", "i").orderBy("t")
    own = q.join(F.broadcast(tree.select("i", "parent")), "i").withColumn("before", F.lag("q").over(order)).withColumn("after", F.lead("q").over(order))
    up = q.select("chunk_id", F.col("i").alias("parent"), "t", F.col("q").alias("above")).withColumn("above_after", F.lead("above").over(Window.partitionBy("chunk_id", "parent").orderBy("t")))
    return own.join(up.hint("merge"), ["chunk_id", "parent", "t"], "left")


def own_terms(near: DataFrame, params: dict[str, np.ndarray]) -> Column:
    """Expected log of each state's table entry: an array of K."""
    k = len(params["gamma"])
    g, a, b, th = (log(params[n]) for n in ("gamma", "alpha", "beta", "theta"))
    return F.array(*[
        F.when(F.col("parent").isNull() & F.col("before").isNull(), float(g[s])).when(F.col("parent").isNull(), _dot(a[:, s], F.col("before")))
        .when(F.col("before").isNull(), _dot(b[:, s], F.col("above"))).otherwise(_dot(th[:, :, s], F.col("above"), F.col("before")))
        for s in range(k)
    ])


def jacobi(q: DataFrame, ll: DataFrame, tree: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """(chunk_id, i, t, q): one sweep of the mean field in which every node sees the others' old posteriors. ll is (chunk_id, i,
    t, ll array of K)."""
    k = len(params["gamma"])
    a, b, th = (log(params[n]) for n in ("alpha", "beta", "theta"))
    near = neighbours(q, tree)
    after = F.array(*[
        F.when(F.col("after").isNull(), 0.0).when(F.col("parent").isNull(), _dot(a[s, :], F.col("after"))).otherwise(_dot(th[:, s, :], F.col("above_after"), F.col("after")))
        for s in range(k)
    ])
    to_parent = [
        F.when(F.col("before").isNull(), _dot(b[s, :], F.col("q"))).otherwise(_dot(th[s], F.col("before"), F.col("q"))).alias(f"m{s}") for s in range(k)
    ]
    kids = near.filter("parent IS NOT NULL").select("chunk_id", F.col("parent").alias("i"), "t", *to_parent).groupBy("chunk_id", "i", "t").agg(*[F.sum(f"m{s}").alias(f"m{s}") for s in range(k)])
    z = near.select("chunk_id", "i", "t", own_terms(near, params).alias("own"), after.alias("next")).join(kids.hint("merge"), ["chunk_id", "i", "t"], "left").join(ll.hint("merge"), ["chunk_id", "i", "t"])
    logits = F.array(*[F.get("own", F.lit(s)) + F.get("next", F.lit(s)) + F.coalesce(F.col(f"m{s}"), F.lit(0.0)) + F.get("ll", F.lit(s)) for s in range(k)])
    out = z.select("chunk_id", "i", "t", logits.alias("z")).select("chunk_id", "i", "t", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda x, y: x + y)
    return out.select("chunk_id", "i", "t", F.transform("e", lambda v: v / total).alias("q"))


def statistics(q: DataFrame, tree: DataFrame) -> DataFrame:
    """(name, idx array, value): the mean field's sums for gamma, alpha, beta and theta."""
    near = neighbours(q, tree)
    one = lambda c, i: F.posexplode(c).alias(i, f"w_{i}")
    root0 = near.filter("parent IS NULL AND before IS NULL").select(one("q", "k")).select(F.lit("gamma").alias("name"), F.array("k").alias("idx"), F.col("w_k").alias("w"))
    root = near.filter("parent IS NULL AND before IS NOT NULL").select("before", one("q", "k")).select("k", "w_k", one("before", "h"))
    kid0 = near.filter("parent IS NOT NULL AND before IS NULL").select("above", one("q", "k")).select("k", "w_k", one("above", "v"))
    kid = near.filter("parent IS NOT NULL AND before IS NOT NULL").select("above", "before", one("q", "k")).select("above", "k", "w_k", one("before", "h")).select("k", "w_k", "h", "w_h", one("above", "v"))
    rows = (
        root0.unionByName(root.select(F.lit("alpha").alias("name"), F.array("h", "k").alias("idx"), (F.col("w_h") * F.col("w_k")).alias("w")))
        .unionByName(kid0.select(F.lit("beta").alias("name"), F.array("v", "k").alias("idx"), (F.col("w_v") * F.col("w_k")).alias("w")))
        .unionByName(kid.select(F.lit("theta").alias("name"), F.array("v", "h", "k").alias("idx"), (F.col("w_v") * F.col("w_h") * F.col("w_k")).alias("w")))
    )
    return rows.groupBy("name", "idx").agg(F.sum("w").alias("value"))


def free_energy(q: DataFrame, ll: DataFrame, tree: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """(chunk_id, energy): the mean-field free energy of each chunk."""
    near = neighbours(q, tree)
    z = near.select("chunk_id", "i", "t", "q", own_terms(near, params).alias("own")).join(ll.hint("merge"), ["chunk_id", "i", "t"])
    terms = F.transform(F.arrays_zip("q", "own", "ll"), lambda s: s["q"] * (F.log(F.greatest(s["q"], F.lit(1e-150))) - s["own"] - s["ll"]))
    return z.select("chunk_id", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("e")).groupBy("chunk_id").agg(F.sum("e").alias("energy"))


def largest_change(old: DataFrame, new: DataFrame, limit: float = 1e-3) -> DataFrame:
    """One row: change, the largest change of a posterior, and converged, whether it is under limit."""
    both = old.select("chunk_id", "i", "t", F.col("q").alias("old")).join(new.hint("merge"), ["chunk_id", "i", "t"])
    change = F.array_max(F.transform(F.arrays_zip("old", "q"), lambda s: F.abs(s["old"] - s["q"])))
    return both.agg(F.max(change).alias("change")).withColumn("converged", F.col("change") < limit)


def gaussian_statistics(q: DataFrame, rows: DataFrame, pseudocount: float = 1e-6) -> DataFrame:
    """(k, l, mean, variance): weighted by posteriors in one pass. q is (id, q array), rows (id, x array); x is centred by its
    overall mean first, for the variance's sake."""
    n = rows.select(F.posexplode("x").alias("l", "v"))
    middle = n.groupBy("l").agg(F.avg("v").alias("middle"))
    cells = rows.join(q, "id").select("q", F.posexplode("x").alias("l", "v")).join(F.broadcast(middle), "l").select("l", (F.col("v") - F.col("middle")).alias("v"), "middle", F.posexplode("q").alias("k", "w"))
    s = cells.groupBy("k", "l").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"), F.max("middle").alias("middle"))
    mean = F.col("wv") / F.col("w")
    return s.select("k", "l", (mean + F.col("middle")).alias("mean"), (F.greatest(F.col("wvv") / F.col("w") - mean * mean, F.lit(0.0)) + pseudocount).alias("variance"))


def normalize_table(values: DataFrame) -> DataFrame:
    """(name, idx, value) with rows, that is all but the last index, summing to 1."""
    row = Window.partitionBy("name", F.slice("idx", 1, F.greatest(F.size("idx") - 1, F.lit(0))))
    return values.withColumn("value", F.col("value") / F.sum("value").over(row))
