"""Kernels against enumeration of all states."""

import tracemalloc
from itertools import product

import numpy as np
import pytest

from silvatrack.functions import kernels as K
from silvatrack.functions import stacks
from silvatrack.functions.model import Tree, log, normalize_stats, random_params

CASES = {
    "one chain": (["a"], {}, 4, 2),
    "pair": (["a", "b"], {"b": "a"}, 3, 2),
    "chain of three": (["a", "b", "c"], {"a": "a", "b": "a", "c": "b"}, 3, 1),
    "star": (["a", "b", "c"], {"b": "a", "c": "a"}, 3, 1),
    "forest": (["a", "b"], {}, 3, 2),
    "root is not first": (["a", "b"], {"a": "b"}, 3, 2),
    "one bin": (["a", "b", "c"], {"b": "a", "c": "b"}, 1, 2),
}


def setting(name, seed=1, separate=False):
    species, parents, n, marks = CASES[name]
    tree = Tree(species, parents)
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (len(species), n, marks)).astype(np.int8)
    avail = np.ones((len(species), marks))
    if name == "pair":
        avail[1, 0] = 0  # a mark that is missing
    branches = max(1, len(tree.branch())) if separate else None
    return x, avail, random_params(2, marks, seed, branches), tree


def enumerate_all(x, avail, params, tree):
    species, n = x.shape[:2]
    o = K.emission(x, avail, params)
    q, weights, best = np.zeros(o.shape), [], (-np.inf, None)
    for flat in product(range(2), repeat=species * n):
        z = np.array(flat).reshape(species, n)
        s = 0.0
        for i, p in enumerate(tree.parent):
            for t in range(n):
                s += o[i, t, z[i, t]]
                if p is None:
                    s += log(params["gamma"])[z[i, 0]] if t == 0 else log(params["alpha"])[z[i, t - 1], z[i, t]]
                else:
                    s += log(params["beta"])[z[p, 0], z[i, 0]] if t == 0 else log(K.theta_of(params, tree, i))[z[p, t], z[i, t - 1], z[i, t]]
        weights.append(s)
        best = max(best, (s, flat))
        for i in range(species):
            for t in range(n):
                q[i, t, z[i, t]] += np.exp(s)
    total = np.exp(weights).sum()
    return q / total, np.log(total), np.array(best[1]).reshape(species, n)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("separate", [False, True])
def test_against_enumeration(name, separate):
    x, avail, params, tree = setting(name, separate=separate)
    q, loglik, path = enumerate_all(x, avail, params, tree)
    got, stats, value, _ = K.clique(x, avail, params, tree)
    assert np.allclose(got, q, atol=1e-10) and value == pytest.approx(-loglik, abs=1e-10)
    assert stats["gamma"].sum() + stats["beta"].sum() == pytest.approx(x.shape[0])
    assert (K.viterbi(x, avail, params, tree) == path).all()
    for mode in ("mf", "poc"):
        q2, stats2, energy, steps = K.MODES[mode](x, avail, params, tree, most=50, epsilon=1e-12)
        assert energy >= -loglik - 1e-9 and all(b <= a + 1e-8 for a, b in zip(steps, steps[1:]))
        assert np.allclose(q2.sum(axis=2), 1)
        for n in ("gamma", "alpha", "beta"):
            assert stats2[n].sum() == pytest.approx(stats[n].sum())
    if all(p is None for p in tree.parent):
        for mode in ("poc", "indep", "loopy"):
            q2, stats2, value2, _ = K.MODES[mode](x, avail, params, tree, **({"tolerance": 1e-13, "most": 200} if mode == "loopy" else {}))
            assert np.allclose(q2, q, atol=1e-8) and value2 == pytest.approx(-loglik, abs=1e-7)
            assert np.allclose(stats2["alpha"], stats["alpha"], atol=1e-7)
    if x.shape[1] == 1:
        q2, stats2, value2, _ = K.loopy(x, avail, params, tree, tolerance=1e-13, most=200)
        assert np.allclose(q2, q, atol=1e-8) and value2 == pytest.approx(-loglik, abs=1e-7) and np.allclose(stats2["beta"], stats["beta"], atol=1e-8)


def test_em_with_exact_steps_never_loses():
    x, avail, params, tree = setting("chain of three", 3)
    values = []
    for _ in range(15):
        _, stats, value, _ = K.clique(x, avail, params, tree)
        values.append(value)
        params = normalize_stats(stats)
    assert all(b <= a + 1e-6 for a, b in zip(values, values[1:]))


def test_gaussian_emission_and_limits():
    rng = np.random.default_rng(0)
    tree = Tree(["a"], {})
    x = rng.normal(0, 1, (1, 50, 2))
    params = random_params(2, 2, 0, means=True)
    q, stats, _, _ = K.independent(x, np.ones((1, 2)), params, tree)
    new = normalize_stats(stats, 0.0, params)
    w = q[0] / q[0].sum(axis=0)
    assert np.allclose(new["means"], w.T @ x[0])
    assert np.allclose(new["variances"] - 1e-3, w.T @ x[0] ** 2 - new["means"] ** 2)
    with pytest.raises(ValueError):
        K.clique(np.zeros((4, 2, 1)), np.ones((4, 1)), random_params(9, 1, 0), Tree(list("abcd"), {}), max_joint=6560)
    with pytest.raises(ValueError):
        Tree(["a", "b"], {"a": "b", "b": "a"})
    with pytest.raises(ValueError):
        Tree(["a"], {"a": "x"})


def loops(n=7, k=3, marks=2, seed=4):
    tree = Tree(list("abcde"), {"b": "a", "c": "a", "d": "c", "e": "c"})
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2, (5, n, marks)).astype(np.int8), np.ones((5, marks)), random_params(k, marks, seed), tree


def peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def joint_by_squares(x, avail, params, tree):
    """The same chain with a table of joint states squared: posteriors, sums of theta, the likelihood and the best path's score."""
    o, k, species = K.emission(x, avail, params), len(params["gamma"]), len(x)
    z = np.array(list(product(range(k), repeat=species)))
    start, step = np.zeros(len(z)), np.zeros((len(z), len(z)))
    for i, p in enumerate(tree.parent):
        start += log(params["gamma"])[z[:, i]] if p is None else log(params["beta"])[z[:, p], z[:, i]]
        own = z[:, i]
        step += log(params["alpha"])[own[:, None], own[None]] if p is None else log(K.theta_of(params, tree, i))[z[:, p][None], own[:, None], own[None]]
    nodes = sum(o[i][:, z[:, i]] for i in range(species))
    c = K.Chain(start, step, nodes)
    q = np.stack([np.stack([c.q[:, z[:, i] == s].sum(axis=1) for s in range(k)], axis=1) for i in range(species)])
    theta, both = np.zeros((k, k, k)), c.pair_sum()
    for i, p in enumerate(tree.parent):
        if p is not None:
            np.add.at(theta, (z[:, p][None] + 0 * z[:, i][:, None], z[:, i][:, None] + 0 * z[:, i][None], z[:, i][None] + 0 * z[:, i][:, None]), both)
    path = K.best_path(start, step, nodes)
    return q, theta, c.value, z[path].T


def test_elimination_equals_the_table_of_joint_states_squared():
    for n in (1, 2, 5, 10):
        x, avail, params, tree = loops(n)
        q, theta, value, path = joint_by_squares(x, avail, params, tree)
        got, stats, minus, _ = K.clique(x, avail, params, tree)
        assert np.allclose(got, q, atol=1e-10) and np.allclose(stats["theta"], theta, atol=1e-10) and -minus == pytest.approx(value, abs=1e-9)
        assert (K.viterbi(x, avail, params, tree) == path).all()


def test_exact_memory_grows_with_the_square_root_of_the_bins():
    tree = Tree(list("abc"), {"b": "a", "c": "b"})
    rng, params, avail = np.random.default_rng(0), random_params(16, 2, 1), np.ones((3, 2))
    of = lambda n: peak(lambda: K.clique(rng.integers(0, 2, (3, n, 2)).astype(np.int8), avail, params, tree))
    short, long = of(25), of(225)
    assert long < 3.5 * short and long < 5e6  # 4,096 joint states; a table of these squared has 134 MB
    assert peak(lambda: K.viterbi(rng.integers(0, 2, (3, 64, 2)).astype(np.int8), avail, params, tree)) < 5e6


def test_best_path_by_checkpoints():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 10, 40):
        start, step, nodes = rng.normal(size=4), rng.normal(size=(4, 4)), rng.normal(size=(n, 4))
        score, back = start + nodes[0], []
        for t in range(1, n):
            both = score[:, None] + step
            back.append(both.argmax(axis=0))
            score = both.max(axis=0) + nodes[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert K.best_path(start, step, nodes).tolist() == path[::-1]
    many = rng.normal(size=(40_000, 4))
    assert peak(lambda: K.best_path(start, step, many)) < 0.1 * many.size * 8 + 8 * len(many) + 50_000  # and the path itself


@pytest.mark.parametrize("block", [1, 2, 3])
def test_loopy_messages_do_not_depend_on_blocks(monkeypatch, block):
    x, avail, params, tree = loops(8)
    for how in ({"most": 2}, {"most": 200, "tolerance": 1e-12}):
        want = K.loopy(x, avail, params, tree, **how)
        with monkeypatch.context() as m:
            m.setattr(K, "MESSAGE_BLOCK", block)
            got = K.loopy(x, avail, params, tree, **how)
        assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[3], want[3], atol=1e-9)
        assert all(np.allclose(got[1][s], want[1][s], atol=1e-10) for s in want[1])


def test_loopy_statistics_are_those_of_its_beliefs():
    """Each bin of each species adds 1 to the tables, and to emissions; on a chain of one species theirs are exact."""
    x, avail, params, tree = loops(6)
    _, stats, _, _ = K.loopy(x, avail, params, tree, most=300, tolerance=1e-13)
    assert stats["gamma"].sum() == pytest.approx(1) and stats["beta"].sum() == pytest.approx(4)
    assert stats["alpha"].sum() == pytest.approx(5) and stats["theta"].sum() == pytest.approx(20)
    one = Tree(["a"], {})
    _, stats, value, _ = K.loopy(x[:1], avail[:1], params, one, most=300, tolerance=1e-13)
    _, exact, minus, _ = K.clique(x[:1], avail[:1], params, one)
    assert value == pytest.approx(minus, abs=1e-8) and all(np.allclose(stats[s], exact[s], atol=1e-8) for s in exact)


def test_loopy_memory_of_a_bin():
    tree = Tree(list("abc"), {"b": "a", "c": "b"})
    rng, params, avail = np.random.default_rng(0), random_params(15, 2, 1), np.ones((3, 2))
    of = lambda n: peak(lambda: K.loopy(rng.integers(0, 2, (3, n, 2)).astype(np.int8), avail, params, tree, most=3, tolerance=0))
    assert (of(3000) - of(1000)) / 2000 < 2000  # bytes; the tables of one bin have 81,000


@pytest.mark.parametrize("separate", [False, True])
@pytest.mark.parametrize("means", [False, True])
def test_stacks_of_chunks_equal_one_by_one(monkeypatch, separate, means):
    _, avail, _, tree = loops()
    avail = avail.copy()
    avail[1, 0] = 0
    rng = np.random.default_rng(2)
    params = random_params(3, 2, 1, 4 if separate else None, means)
    xs = [rng.normal(0, 2, (5, n, 2)) if means else rng.integers(0, 2, (5, n, 2)).astype(np.int8) for n in (1, 2, 5, 9, 9, 30, 7)]
    for block in (4, K.BLOCK):
        monkeypatch.setattr(stacks, "BLOCK", block)
        for how in ({}, {"most": 1}, {"most": 0}, {"most": 30, "epsilon": 1e-9}):
            one = [K.product_of_chains(x, avail, params, tree, **how) for x in xs]
            total, seen = K.empty_stats(params), []
            for which, q, stats, value in stacks.product_of_chains(xs, avail, params, tree, **how):
                for b, posterior, v in zip(which.tolist(), q, value):
                    n = xs[b].shape[1]
                    assert np.allclose(posterior[:, :n], one[b][0], atol=1e-9) and not posterior[:, n:].any() and v == pytest.approx(one[b][2], abs=1e-8)
                seen += which.tolist()
                total = {s: total[s] + stats[s] for s in total}
            assert sorted(seen) == list(range(len(xs)))
            assert all(np.allclose(total[s], sum(r[1][s] for r in one), atol=1e-7) for s in total)
