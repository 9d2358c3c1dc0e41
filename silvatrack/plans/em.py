"""Expectation-maximisation over chunks: chunks are packed once and kept; each iteration is one pass over them, in which every
task adds up its chunks' statistics, and one small sum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, stacks
from ..functions.model import Tree, normalize_stats, random_params
from ..operators import gaussian_init
from . import chains


#: Bins that a task handles, about, where there are partitions enough.
TASK_BINS = 20_000
#: Bins whose observations become rows at a time.
OBSERVED = 4096
#: Numbers of a stack's pair posteriors, about: chunks times species times bins times states squared.
STACK = 1 << 22


def pack(cut_calls: DataFrame, chunks: DataFrame, value: str | None = None) -> DataFrame:
    """(chunk_id, chrom, start, n, t, i, l), the last three arrays with an entry for each call: a row for each chunk, also those
    without calls. With value, the name of a column, there is an array value too; what has no row has 0."""
    names = ["t", "i", "l"] + (["value"] if value else [])
    fields = [F.col(value if n == "value" else n).cast("double" if n == "value" else "int").alias(n) for n in names]
    cells = cut_calls.groupBy("chunk_id").agg(F.collect_list(F.struct(*fields)).alias("c")).select("chunk_id", *[F.col(f"c.{n}").alias(n) for n in names])
    return chunks.select("chunk_id", "chrom", "start", (F.col("end") - F.col("start")).cast("int").alias("n")).join(cells, "chunk_id", "left")


def balanced(packed: DataFrame, tasks: int | None = None) -> DataFrame:
    """packed, dealt to tasks: chunks of each class of size (by powers of two) by a hash, so that tasks get about as many of each; units of one species (chains.pack_units) likewise.
    Without a number, there is a task for each TASK_BINS bins, at least as many as the session's parallelism where there are
    chunks enough, and at most as many as its shuffle partitions."""
    if tasks is None:
        spark = packed.sparkSession
        chunks, bins = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        least = min(chunks, spark.sparkContext.defaultParallelism)
        tasks = max(1, least, min(chunks, math.ceil(bins / TASK_BINS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = F.floor(F.log2(F.greatest("n", F.lit(1))))
    key = [c for c in ("chunk_id", "i", "block") if c in packed.columns and not dict(packed.dtypes)[c].startswith("array")]
    return packed.repartitionById(tasks, F.pmod(F.xxhash64(*key) + size, F.lit(tasks)).cast("int"))


def _chunk(row, shape: tuple[int, int]) -> np.ndarray:
    """Observations (species, bins, marks): presence, or values."""
    values = getattr(row, "value", None)
    x = np.zeros((shape[0], int(row.n), shape[1]), dtype=float if hasattr(row, "value") else np.int8)
    if row.t is not None:
        t, i, l = (np.asarray(c, dtype=np.int64) for c in (row.t, row.i, row.l))
        inside = (i < shape[0]) & (l < shape[1])
        x[i[inside], t[inside], l[inside]] = 1 if values is None else np.asarray(values)[inside]
    return x


def observations(packed: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(id, x array of marks): what each species shows in each bin of the packed chunks, cells without a row being 0. Rows are made
    while a pass reads the chunks, and never kept."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for pdf in batches:
            for row in pdf.itertuples():
                whole = _chunk(row, shape)
                for lo in range(0, int(row.n), OBSERVED):
                    x = whole[:, lo : lo + OBSERVED].astype(float)
                    i, t = np.indices(x.shape[:2])
                    ids = [f"{row.chunk_id}:{a}:{b}" for a, b in zip(i.ravel().tolist(), (t.ravel() + lo).tolist())]
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), cells], ["id", "x"])

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(b.to_pandas() for b in batches)

    return packed.mapInArrow(arrow, "id string, x array<double>")


def gaussian_start(packed: DataFrame, avail: np.ndarray, k: int, seed: int = 0, pseudocount: float = 1e-6) -> dict[str, np.ndarray]:
    """Means and variances that a fit of packed values starts from: spread-out rows, and the variances around them."""
    return gaussian_init.gaussian_start(observations(packed, avail.shape), k, seed, pseudocount)


def _stacks(pdf: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Parts of pdf, a chunk a row, whose chunks are at most half as long again as their shortest; size is how many numbers a bin takes."""
    pdf = pdf.sort_values("n", kind="stable")
    n, lo = pdf["n"].to_numpy(), 0
    for hi in range(1, len(n) + 1):
        if hi == len(n) or 2 * n[hi] > 3 * n[lo] or (hi + 1 - lo) * n[hi] * size > STACK:
            yield pdf.iloc[lo:hi]
            lo = hi


def _solved(pdf: pd.DataFrame, mode: str, params: dict, tree: Tree, avail: np.ndarray, how: dict) -> Iterator[tuple[list[int], list[int], np.ndarray, dict, np.ndarray]]:
    """(chunk_ids, numbers of bins, posteriors (chunks, species, bins, K), summed statistics, objectives) of the chunks of pdf: one by one, or
    in stacks where the mode has a step for them."""
    if mode != "poc":
        for row in pdf.itertuples():
            q, stats, value, _ = kernels.MODES[mode](_chunk(row, avail.shape), avail, params, tree, seed=int(row.chunk_id) % 2**32, **how)
            yield [row.chunk_id], [int(row.n)], q[None], stats, np.array([value])
        return
    for part in _stacks(pdf, avail.shape[0] * len(params["gamma"]) ** 2):
        ids, n = part["chunk_id"].to_numpy(), part["n"].to_numpy()
        for which, q, stats, value in stacks.product_of_chains([_chunk(r, avail.shape) for r in part.itertuples()], avail, params, tree, **how):
            yield ids[which].tolist(), n[which].tolist(), q, stats, value


def _flat(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([stats[n].ravel() for n in sorted(stats)])


def in_units(packed: DataFrame, mode: str) -> bool:
    """Whether packed is what chains.pack_units gives: blocks of bins of one species, for chains of their own."""
    if "n_blocks" not in packed.columns:
        return False
    if mode not in ("indep", "viterbi_chain"):
        raise ValueError(f"{mode} needs all species of a chunk together")
    return True


def expectation(packed: DataFrame, mode: str, params: dict, tree: Tree, avail: np.ndarray, **how) -> tuple[dict[str, np.ndarray], float]:
    """Statistics and objective summed over all chunks; the driver gets one vector, whose length the model sets."""
    if in_units(packed, mode):
        return chains.expectation(packed, params, avail)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for _, _, _, stats, value in _solved(pdf, mode, params, tree, avail, how):
                part = np.append(_flat(stats), value.sum())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    sums = packed.mapInPandas(each, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    empty = kernels.empty_stats(params)
    flat = np.zeros(len(_flat(empty)) + 1)
    for r in sums:
        flat[r["place"]] = r["value"]
    out, at = {}, 0
    for n in sorted(empty):
        out[n] = flat[at : at + empty[n].size].reshape(empty[n].shape)
        at += empty[n].size
    return out, float(flat[-1])


def posteriors(packed: DataFrame, mode: str, params: dict, tree: Tree, avail: np.ndarray, **how) -> DataFrame:
    """(chunk_id, i, t, q array): of every node of every chunk. mode may be "viterbi" or "viterbi_chain": one-hot of the
    likeliest path of all species together, or of each as a chain of its own."""
    shape, k = avail.shape, len(params["gamma"])
    if in_units(packed, mode):
        if mode == "indep":
            return chains.posteriors(packed, params, avail)
        one_hot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: (s == F.col("state")).cast("double"))
        return chains.best_paths(packed, params, avail).select("chunk_id", "i", "t", one_hot.alias("q"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if mode.startswith("viterbi"):
                found = ((r.chunk_id, np.eye(k)[kernels.viterbi(_chunk(r, shape), avail, params, tree, mode == "viterbi", **how)]) for r in pdf.itertuples())
            else:
                found = ((c, a[:, :m]) for ids, n, q, _, _ in _solved(pdf, mode, params, tree, avail, how) for c, m, a in zip(ids, n, q))
            for chunk_id, q in found:
                i, t = np.indices(q.shape[:2])
                yield pd.DataFrame({"chunk_id": chunk_id, "i": i.ravel().astype(np.int32), "t": t.ravel(), "q": list(q.reshape(-1, k))})

    return packed.mapInPandas(each, "chunk_id long, i int, t long, q array<double>")


def leaf_posteriors(packed: DataFrame, posterior: DataFrame, species: int, params: dict, tree: Tree, avail: np.ndarray) -> DataFrame:
    """(chunk_id, t, q array, value): the chain of a species without children, given its parent's posteriors; posterior is (chunk_id, i, t,
    q array) of all bins. value is the log of the sum over all paths, the same for all bins of a chunk."""
    parent, shape = tree.parent[species], avail.shape
    above = posterior.filter(F.col("i") == parent).groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "q"))), lambda s: s["q"]).alias("above"))
    beta, theta = kernels.log(params["beta"]), kernels.log(kernels.theta_of(params, tree, species))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                up = np.stack([np.asarray(v) for v in row.above])
                o = kernels.emission(_chunk(row, shape)[species : species + 1], avail[species : species + 1], params)[0]
                chain = kernels.given_parent(up, up[0] @ beta, o, theta)
                yield pd.DataFrame({"chunk_id": row.chunk_id, "t": np.arange(len(o)), "q": list(chain.q), "value": chain.value})

    return packed.join(above, "chunk_id").mapInPandas(each, "chunk_id long, t long, q array<double>, value double")


def objectives(packed: DataFrame, mode: str, params: dict, tree: Tree, avail: np.ndarray, **how) -> DataFrame:
    """(chunk_id, objective) of each chunk."""
    if in_units(packed, mode):
        return chains.objectives(packed, params, avail)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, _, _, _, value in _solved(pdf, mode, params, tree, avail, how):
                yield pd.DataFrame({"chunk_id": ids, "objective": value})

    return packed.mapInPandas(each, "chunk_id long, objective double")


def fit(
    packed: DataFrame, mode: str, tree: Tree, avail: np.ndarray, k: int, iterations: int = 50, epsilon: float = 1e-4, most: int = 10,
    epsilon_e: float = 1e-3, pseudocount: float = 1e-6, seed: int = 0, separate_theta: bool = False, start: dict | None = None, on_step=None, gaussian: bool = False,
) -> tuple[dict[str, np.ndarray], list[float]]:
    """Parameters and the objective of each iteration. packed should be persisted. It stops when the objective's relative change
    is under epsilon. start takes up parameters of an earlier run; on_step(iteration, parameters, objective) is called for each.
    gaussian: packed has values, and states have means and variances in place of presence; without a start, these come from
    the data (gaussian_start)."""
    params = start or random_params(k, avail.shape[1], seed, len(tree.branch()) if separate_theta else None, gaussian)
    if gaussian and not start:
        params |= gaussian_start(packed, avail, k, seed, pseudocount)
    how = {"most": most} | ({} if mode == "loopy" else {"epsilon": epsilon_e})
    path: list[float] = []
    for n in range(iterations):
        stats, value = expectation(packed, mode, params, tree, avail, **how)
        path.append(value)
        if on_step:
            on_step(n, params, value)
        params = normalize_stats(stats, pseudocount, params)
        if n and abs(path[-2] - path[-1]) <= epsilon * abs(path[-2]):
            break
    return params, path


def sweep(packed: DataFrame, mode: str, tree: Tree, avail: np.ndarray, states: list[int], **how) -> list[tuple[int, int, float]]:
    """(states, iteration, objective) of a fit for each number of states."""
    return [(k, n, v) for k in states for n, v in enumerate(fit(packed, mode, tree, avail, k, **how)[1])]


def compare(packed: DataFrame, tree: Tree, avail: np.ndarray, params: dict, modes: list[str], **how) -> list[tuple[str, str, float]]:
    """(mode, kind, objective) of several approximations under the same parameters; log-likelihoods are negated, so that all
    objectives are free energies or bounds of the same sign."""
    return [(m, kernels.KINDS[m], expectation(packed, m, params, tree, avail, **how)[1]) for m in modes]
