"""The relational fit against the same steps in memory."""

import re

import numpy as np
import pytest

from silvatrack.functions import kernels
from silvatrack.functions.model import Tree, normalize_stats, random_params
from silvatrack.operators import relational
from silvatrack.plans import relational_em as rel

SPECIES = Tree(list("abcd"), {"b": "a", "c": "a", "d": "c"})


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    sizes, marks, k = [1, 2, 9, 5], 2, 3
    x = [rng.integers(0, 2, (4, n, marks)).astype(np.int8) for n in sizes]
    q = [kernels.random_q((4, n, k), c) for c, n in enumerate(sizes)]
    cells = [(int(i), int(l), "c1", int(100 * c + t)) for c, a in enumerate(x) for i, t, l in np.argwhere(a)]
    nodes = [(c, "c1", 100 * c + t, t, i) for c, n in enumerate(sizes) for t in range(n) for i in range(4)]
    frames = {
        "q": spark.createDataFrame([(c, i, t, [float(v) for v in q[c][i, t]]) for c, n in enumerate(sizes) for i in range(4) for t in range(n)], "chunk_id long, i int, t long, q array<double>"),
        "nodes": spark.createDataFrame(nodes, "chunk_id long, chrom string, bin long, t long, i int"), "calls": spark.createDataFrame(cells, "i int, l int, chrom string, bin long"),
        "avail": spark.createDataFrame([(i, l) for i in range(4) for l in range(marks) if (i, l) != (1, 0)], "i int, l int"), "tree": spark.createDataFrame(SPECIES.rows(), "i int, parent int, is_root boolean"),
    }
    avail = np.ones((4, marks))
    avail[1, 0] = 0
    return frames, x, q, avail, random_params(k, marks, 3)


def posteriors(df):
    return {(r.chunk_id, r.i, r.t): r.q for r in df.collect()}


def same(got, q):
    return all(np.allclose(v, q[c][i, t], atol=1e-9) for (c, i, t), v in got.items())


def test_sweeps_equal_those_in_memory(data):
    f, x, q, avail, params = data
    ll = rel.likelihoods(f["nodes"], f["calls"], params["emit"], f["avail"]).persist()
    o = [kernels.emission(a, avail, params) for a in x]
    assert all(np.allclose(r.ll, o[r.chunk_id][r.i, r.t]) for r in ll.collect())
    for most, every in ((1, 2), (3, 2)):
        want, before = [a.copy() for a in q], None
        for _ in range(most):
            before, want = want, [rel.sweep_in_numpy(a, b, params, SPECIES.parent) for a, b in zip(want, o)]
        got, sweeps, change = rel.settle(f["q"], ll, f["tree"], params, most, 0.0, every)
        assert sweeps == most and same(posteriors(got), want)
        assert change == pytest.approx(max(np.abs(a - b).max() for a, b in zip(want, before)), abs=1e-9)
    got, sweeps, change = rel.settle(f["q"], ll, f["tree"], params, 20, 0.1, 1)
    assert sweeps < 20 and change < 0.1
    energy = sum(r.energy for r in relational.free_energy(got, ll, f["tree"], params).collect())
    settled = posteriors(got)
    there = [np.array([[settled[c, i, t] for t in range(a.shape[1])] for i in range(4)]) for c, a in enumerate(x)]
    assert energy == pytest.approx(sum(kernels.mean_field_energy(b, a, params, SPECIES) for a, b in zip(there, o)))


def test_fit_equals_em_in_memory(data):
    f, x, q, avail, params = data
    fitted, got, path = rel.fit(f["q"], f["nodes"], f["calls"], f["avail"], f["tree"], params, iterations=2, epsilon=0.0, most=2, limit=0.0)
    mine, held = dict(params), [a.copy() for a in q]
    for n in range(2):
        o = [kernels.emission(a, avail, mine) for a in x]
        for _ in range(2):
            held = [rel.sweep_in_numpy(a, b, mine, SPECIES.parent) for a, b in zip(held, o)]
        assert path[n].energy == pytest.approx(sum(kernels.mean_field_energy(b, a, mine, SPECIES) for a, b in zip(held, o)))
        stats = kernels.empty_stats(mine)
        for a, b in zip(held, x):
            kernels.tree_stats(stats, a, kernels._product(a), SPECIES)
            kernels.emission_stats(stats, a, b, avail, mine)
        mine = normalize_stats(stats, 1e-6)
    assert same(posteriors(got), held) and all(np.allclose(fitted[m], mine[m], atol=1e-9) for m in mine)
    assert path[1].energy < path[0].energy



def test_no_posteriors_are_broadcast(data):
    """Tables of posteriors look small by their files: joins of two tables that grow are sorted merges, whatever their estimates."""
    f, _, _, _, params = data
    ll = rel.likelihoods(f["nodes"], f["calls"], params["emit"], f["avail"])
    after = relational.jacobi(f["q"], ll, f["tree"], params)
    for df, merges in ((ll, 1), (after, 4), (relational.free_energy(f["q"], ll, f["tree"], params), 3), (relational.largest_change(f["q"], after), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"Broadcast\w*Join \[(?:chunk_id|chrom)", plan) and len(re.findall(r"SortMergeJoin", plan)) >= merges
