"""Mean-field EM as joins, windows and sums alone: for chunks of any length, since no task ever has a whole chunk. A fixpoint driver
sweeps, tests, cuts the lineage, estimates and goes on; the driver gets a model's worth of numbers for each iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import log, row_normalize
from ..operators import emission, relational
from ..sources.tables import kept


@dataclass
class Iteration:
    """What an iteration came to: the sweeps it took, the last sweep's largest change, and the free energy summed over chunks."""

    number: int
    sweeps: int
    change: float
    energy: float


def likelihoods(nodes: DataFrame, calls: DataFrame, emit: np.ndarray, avail: DataFrame) -> DataFrame:
    """(chunk_id, i, t, ll array of K) of each node (chunk_id, chrom, bin, t, i)."""
    spark = nodes.sparkSession
    e = spark.createDataFrame([(k, l, float(v)) for (k, l), v in np.ndenumerate(emit)], "k int, l int, e double")
    return emission.bernoulli_arrays(nodes, calls, e, avail).select("chunk_id", "i", "t", "ll")


def settle(q: DataFrame, ll: DataFrame, tree: DataFrame, params: dict[str, np.ndarray], most: int, limit: float, cut_every: int = 2) -> tuple[DataFrame, int, float]:
    """Sweeps until no posterior changes by as much as limit, or most of them: the posteriors, how many sweeps, the last change. Every
    cut_every sweeps the posteriors are kept as a table, which cuts the lineage, and the last of these sweeps is tested."""
    done = 0
    while True:
        n = min(cut_every, most - done)
        for _ in range(n - 1):
            q = relational.jacobi(q, ll, tree, params)
        if n > 1:
            q = kept(q, "sweep")  # both of the sweeps that are compared come from it
        new = kept(relational.jacobi(q, ll, tree, params), "sweep")
        done += n
        change = relational.largest_change(q, new, limit).first()["change"] or 0.0
        q = new
        if change < limit or done >= most:
            return q, done, change


def estimate(q: DataFrame, nodes: DataFrame, calls: DataFrame, avail: DataFrame, tree: DataFrame, params: dict[str, np.ndarray], pseudocount: float = 1e-6) -> dict[str, np.ndarray]:
    """The M-step: tables from the posteriors' sums, the pseudocount added once. What has no sums keeps the pseudocount alone."""
    sums = {n: np.zeros_like(params[n]) for n in ("gamma", "alpha", "beta", "theta")}
    for r in relational.statistics(q, tree).collect():
        sums[r["name"]][tuple(r["idx"])] = r["value"]
    states = nodes.join(q.hint("merge"), ["chunk_id", "i", "t"]).select("chrom", "bin", "i", "q")
    emit = params["emit"].copy()
    for r in emission.normalize(states, calls, avail, pseudocount, len(params["gamma"])).collect():
        emit[r["k"], r["l"]] = np.clip(r["e"], 1e-9, 1 - 1e-9)
    return {n: row_normalize(a + pseudocount) for n, a in sums.items()} | {"emit": emit}


def fit(
    q: DataFrame, nodes: DataFrame, calls: DataFrame, avail: DataFrame, tree: DataFrame, params: dict[str, np.ndarray], iterations: int = 50,
    epsilon: float = 1e-4, most: int = 10, limit: float = 1e-3, pseudocount: float = 1e-6, cut_every: int = 2,
) -> tuple[dict[str, np.ndarray], DataFrame, list[Iteration]]:
    """Parameters, posteriors and what each iteration came to. q (chunk_id, i, t, q array) is where the first iteration's sweeps start;
    later ones take up the posteriors of the one before. It stops when the energy's relative change is under epsilon."""
    path: list[Iteration] = []
    for n in range(iterations):
        ll = kept(likelihoods(nodes, calls, params["emit"], avail), "likelihoods")
        q, sweeps, change = settle(q, ll, tree, params, most, limit, cut_every)
        energy = relational.free_energy(q, ll, tree, params).agg(F.sum("energy")).first()[0] or 0.0
        path.append(Iteration(n, sweeps, change, energy))
        params = estimate(q, nodes, calls, avail, tree, params, pseudocount)
        if n and abs(path[-2].energy - energy) <= epsilon * abs(path[-2].energy):
            break
    return params, q, path


def sweep_in_numpy(q: np.ndarray, o: np.ndarray, params: dict[str, np.ndarray], parent: list[int | None]) -> np.ndarray:
    """One sweep over one chunk in memory, q and emissions o (species, bins, states): what the joins are held against."""
    gamma, alpha, beta, theta = (log(params[n]) for n in ("gamma", "alpha", "beta", "theta"))
    z = o.copy()
    for i, p in enumerate(parent):
        if p is None:
            z[i, 0] += gamma
            z[i, 1:] += q[i, :-1] @ alpha
            z[i, :-1] += q[i, 1:] @ alpha.T
            continue
        z[i, 0] += q[p, 0] @ beta
        z[p, 0] += beta @ q[i, 0]
        z[i, 1:] += np.einsum("tv,th,vhk->tk", q[p, 1:], q[i, :-1], theta)
        z[i, :-1] += np.einsum("tv,tk,vhk->th", q[p, 1:], q[i, 1:], theta)
        z[p, 1:] += np.einsum("th,tk,vhk->tv", q[i, :-1], q[i, 1:], theta)
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)
