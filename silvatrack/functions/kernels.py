"""E-steps over one chunk. Each takes observations X (species, bins, marks), availability (species, marks), parameters and
the tree, and returns posteriors Q (species, bins, states), sufficient statistics and an objective to be made small (the
free energy, or minus the log-likelihood). Spark runs them on chunks that are independent given the parameters."""

from __future__ import annotations

import math

import numpy as np

from . import exact
from .model import FLOOR, Tree, log

#: Joint states of exact inference, by default: what is held is about twice the square root of the bins times as many numbers.
MAX_JOINT = 1 << 18
#: Transitions whose tables are held at a time: longer chunks take no more of these.
BLOCK = 1024
#: Bins whose messages are made at a time.
MESSAGE_BLOCK = 256


def emission(x: np.ndarray, avail: np.ndarray, params: dict) -> np.ndarray:
    """Log-likelihood (species, bins, states) of what is available."""
    if "means" in params:
        m, v = params["means"], np.maximum(params["variances"], FLOOR)
        total = np.stack([-0.5 * ((np.log(2 * np.pi * v[k]) + (x - m[k]) ** 2 / v[k]) * avail[:, None, :]).sum(axis=2) for k in range(len(m))], axis=2)
        return np.where(np.isfinite(total) & (total != 0), total, -100.0)
    on, off = log(params["emit"]), log(1 - params["emit"])
    base = np.einsum("il,kl->ik", avail, off)
    return base[:, None, :] + np.einsum("itl,il,kl->itk", x.astype(float), avail, on - off)


def theta_of(params: dict, tree: Tree, i: int) -> np.ndarray:
    theta = params["theta"]
    return theta if theta.ndim == 3 else theta[tree.branch()[i]]


class Chain:
    """Sum-product along a chain with log potentials: start (K), steps and nodes (T, K). steps is one table (K, K) for all
    transitions, or a function of lo and hi that gives those of transitions lo to hi - 1, (hi - lo, K, K), and always the
    same. q has the marginals, value the log of the sum over all paths; pair marginals are made when asked for, so that
    what is held grows with T * K alone."""

    def __init__(self, start: np.ndarray, steps, nodes: np.ndarray):
        self.n, shift = len(nodes), nodes.max(axis=1, keepdims=True)
        node = np.exp(nodes - shift)
        self.steps = steps
        if not callable(steps):
            self.top = float(steps.max())
            self.step = np.exp(steps - self.top)[None]
        self.forward, weighted, scale = np.empty_like(node), np.zeros_like(node), np.empty(self.n)
        first, tops = start.max(), 0.0
        f = np.exp(start - first) * node[0]
        scale[0] = f.sum()
        self.forward[0] = f / scale[0]
        for lo, hi in self.blocks():
            step, top = self._tables(lo, hi)
            tops += top
            for t in range(lo, hi):
                f = (self.forward[t] @ step[(t - lo) % len(step)]) * node[t + 1]
                scale[t + 1] = f.sum()
                self.forward[t + 1] = f / scale[t + 1]
        backward = np.ones_like(node)
        for lo, hi in reversed(self.blocks()):
            step, _ = self._tables(lo, hi)
            for t in range(hi - 1, lo - 1, -1):
                weighted[t + 1] = node[t + 1] * backward[t + 1] / scale[t + 1]
                backward[t] = step[(t - lo) % len(step)] @ weighted[t + 1]
        self.weighted = weighted
        self.q = self.forward * backward
        self.q /= self.q.sum(axis=1, keepdims=True)
        self.value = float(np.log(scale).sum() + shift.sum() + tops + first)

    def blocks(self) -> list[tuple[int, int]]:
        return blocks(self.n)

    def _tables(self, lo: int, hi: int) -> tuple[np.ndarray, float]:
        """Potentials of transitions lo to hi - 1 (one table if all are the same), and the sum of the logs they were divided by."""
        if not callable(self.steps):
            return self.step, self.top * (hi - lo)
        steps = self.steps(lo, hi)
        top = steps.max(axis=(1, 2), keepdims=True)
        return np.exp(steps - top), float(top.sum())

    def pairs(self, lo: int, hi: int) -> np.ndarray:
        """Pair marginals of transitions lo to hi - 1."""
        out = self.forward[lo:hi, :, None] * self._tables(lo, hi)[0] * self.weighted[lo + 1 : hi + 1, None, :]
        return out / np.maximum(out.sum(axis=(1, 2), keepdims=True), FLOOR)

    def pair_sum(self) -> np.ndarray:
        """The sum of all pair marginals; with one table, from sums over bins alone."""
        if not callable(self.steps):
            return self.step[0] * (self.forward[:-1].T @ self.weighted[1:])
        return sum((self.pairs(lo, hi).sum(axis=0) for lo, hi in self.blocks()), np.zeros((self.q.shape[1],) * 2))


def blocks(n: int) -> list[tuple[int, int]]:
    """The transitions of n bins, in blocks."""
    return [(lo, min(lo + BLOCK, n - 1)) for lo in range(0, n - 1, BLOCK)]


def best_path(start: np.ndarray, step: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Max-product along a chain with one table (K, K) for all transitions: the likeliest states, the lowest among equals. Scores are
    held for every square root of the bins, and pointers for as many at a time."""
    n = len(nodes)
    size = max(1, math.isqrt(n - 1) + 1)
    score, kept = start + nodes[0], []
    for t in range(n):
        score = score if t == 0 else (score[:, None] + step).max(axis=0) + nodes[t]
        if t % size == 0:
            kept.append(score)
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    back = np.empty((size, len(start)), dtype=np.int16 if len(start) < 2**15 else np.int32)
    for lo in range((n - 1) // size * size, -1, -size):
        score, hi = kept.pop(), min(lo + size, n - 1)
        for t in range(lo, hi):
            both = score[:, None] + step
            back[t - lo] = both.argmax(axis=0)
            score = both.max(axis=0) + nodes[t + 1]
        for t in range(hi - 1, lo - 1, -1):
            path[t] = back[t - lo][path[t + 1]]
    return path


def empty_stats(params: dict) -> dict[str, np.ndarray]:
    marks = params["means" if "means" in params else "emit"]
    names = ("gamma", "alpha", "beta", "theta")
    out = {n: np.zeros_like(params[n]) for n in names} | {"emit": np.zeros_like(marks), "emit_sum": np.zeros_like(marks)}
    return out | {"emit_x2": np.zeros_like(marks)} if "means" in params else out


def emission_stats(stats: dict, q: np.ndarray, x: np.ndarray, avail: np.ndarray, params: dict) -> None:
    """Adds the emissions; of Gaussians, moments around the present means, which keep their digits wherever the signal lies."""
    stats["emit_sum"] += np.einsum("itk,il->kl", q, avail)
    if "emit_x2" not in stats:
        stats["emit"] += np.einsum("itk,itl,il->kl", q, x.astype(float), avail)
        return
    for k, m in enumerate(params["means"]):
        away = (x - m) * avail[:, None, :]
        stats["emit"][k] += np.einsum("it,itl->l", q[:, :, k], away)
        stats["emit_x2"][k] += np.einsum("it,itl->l", q[:, :, k], away * away)


def tree_stats(stats: dict, q: np.ndarray, pairs: list, tree: Tree) -> None:
    """Adds the transitions; pairs[i](lo, hi), (hi - lo, h, k), are the joint posteriors of neighbouring bins."""
    for i, p in enumerate(tree.parent):
        if p is None:
            stats["gamma"] += q[i, 0]
        else:
            stats["beta"] += np.outer(q[p, 0], q[i, 0])
        for lo, hi in blocks(q.shape[1]):
            if p is None:
                stats["alpha"] += pairs[i](lo, hi).sum(axis=0)
            else:
                theta = stats["theta"] if stats["theta"].ndim == 3 else stats["theta"][tree.branch()[i]]
                theta += np.einsum("tv,thk->vhk", q[p, lo + 1 : hi + 1], pairs[i](lo, hi))


def random_q(shape: tuple[int, int, int], seed: int) -> np.ndarray:
    q = np.random.default_rng(seed).random(shape) + 0.1
    return q / q.sum(axis=2, keepdims=True)


def _expected(params: dict, tree: Tree, q: np.ndarray, pairs: list) -> float:
    """Expected log of all transitions."""
    total = 0.0
    for i, p in enumerate(tree.parent):
        total += q[i, 0] @ log(params["gamma"]) if p is None else q[p, 0] @ log(params["beta"]) @ q[i, 0]
        for lo, hi in blocks(q.shape[1]):
            if p is None:
                total += (pairs[i](lo, hi).sum(axis=0) * log(params["alpha"])).sum()
            else:
                total += np.einsum("tv,thk,vhk->", q[p, lo + 1 : hi + 1], pairs[i](lo, hi), log(theta_of(params, tree, i)), optimize=True)
    return float(total)


def _product(q: np.ndarray) -> list:
    return [lambda lo, hi, a=a: a[lo:hi, :, None] * a[lo + 1 : hi + 1, None, :] for a in q]


def _iterate(update, energy, most: int, epsilon: float) -> tuple[float, list[float]]:
    path = [energy()]
    for _ in range(most):
        update()
        path.append(energy())
        if abs(path[-2] - path[-1]) <= epsilon * abs(path[-2]):
            break
    return path[-1], path


def mean_field(x, avail, params, tree: Tree, most: int = 10, epsilon: float = 1e-3, seed: int = 0):
    """Every bin of every species on its own, updated in place by species: all even bins at once, which do not depend on each
    other, then all odd ones."""
    o = emission(x, avail, params)
    q = random_q(o.shape, seed)
    alpha, beta, gamma = (log(params[n]) for n in ("alpha", "beta", "gamma"))
    n = o.shape[1]
    thetas = [None if p is None else log(theta_of(params, tree, i)) for i, p in enumerate(tree.parent)]

    def update() -> None:
        for i, p in enumerate(tree.parent):
            for parity in range(min(2, n)):
                ts = np.arange(parity, n, 2)
                later, sooner = ts > 0, ts + 1 < n
                t, s = ts[later], ts[sooner] + 1
                z = o[i, ts].copy()
                if p is None:
                    z[~later] += gamma
                    z[later] += q[i, t - 1] @ alpha
                    z[sooner] += q[i, s] @ alpha.T
                else:
                    z[~later] += q[p, 0] @ beta
                    z[later] += np.einsum("tv,th,vhk->tk", q[p, t], q[i, t - 1], thetas[i], optimize=True)
                    z[sooner] += np.einsum("tv,tc,vkc->tk", q[p, s], q[i, s], thetas[i], optimize=True)
                for c in tree.children[i]:
                    z[~later] += beta @ q[c, 0]
                    z[later] += np.einsum("th,tv,khv->tk", q[c, t - 1], q[c, t], thetas[c], optimize=True)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                q[i, ts] = e / e.sum(axis=1, keepdims=True)

    def energy() -> float:
        return float((q * log(q)).sum() - (q * o).sum() - _expected(params, tree, q, _product(q)))

    value, path = _iterate(update, energy, most, epsilon)
    stats = empty_stats(params)
    tree_stats(stats, q, _product(q), tree)
    emission_stats(stats, q, x, avail, params)
    return q, stats, value, path


def given_parent(above: np.ndarray, start: np.ndarray, nodes: np.ndarray, theta: np.ndarray) -> Chain:
    """A species' chain given its parent's posteriors (bins, states): transitions are the expected logs of theta under them. start and
    theta are logs; nodes has what its emissions and children say."""
    above = above.copy()  # a chain's tables stay as they were when it was made
    return Chain(start, lambda lo, hi: np.einsum("tv,vhk->thk", above[lo + 1 : hi + 1], theta, optimize=True), nodes)


def product_of_chains(x, avail, params, tree: Tree, most: int = 10, epsilon: float = 1e-3, seed: int = 0):
    """Each species' chain exact, given its parent's and children's posteriors."""
    o = emission(x, avail, params)
    species, n, k = o.shape
    q, chains = np.empty_like(o), [None] * species
    thetas = [None if p is None else log(theta_of(params, tree, i)) for i, p in enumerate(tree.parent)]

    def put(i: int, chain: Chain) -> None:
        chains[i], q[i] = chain, chain.q

    for i, p in enumerate(tree.parent):  # start without neighbours: theta averaged over the parent's states
        step = params["alpha"] if p is None else theta_of(params, tree, i).mean(axis=0)
        put(i, Chain(log(params["gamma"] if p is None else params["beta"].mean(axis=0)), log(step), o[i]))

    def update() -> None:
        for i, p in enumerate(tree.parent):
            nodes = o[i].copy()
            for c in tree.children[i]:
                nodes[0] += log(params["beta"]) @ q[c, 0]
                for lo, hi in blocks(n):
                    nodes[lo + 1 : hi + 1] += np.einsum("thv,khv->tk", chains[c].pairs(lo, hi), thetas[c], optimize=True)
            if p is None:
                put(i, Chain(log(params["gamma"]), log(params["alpha"]), nodes))
            else:
                put(i, given_parent(q[p], q[p, 0] @ log(params["beta"]), nodes, thetas[i]))

    def energy() -> float:
        ent = 0.0
        for a, c in zip(q, chains):
            ent += (a[0] * log(a[0])).sum()
            for lo, hi in blocks(n):
                pair = c.pairs(lo, hi)
                ent += (pair * log(pair / np.maximum(a[lo:hi, :, None], FLOOR))).sum()
        return float(ent - (q * o).sum() - _expected(params, tree, q, [c.pairs for c in chains]))

    value, path = _iterate(update, energy, most, epsilon)
    stats = empty_stats(params)
    tree_stats(stats, q, [c.pairs for c in chains], tree)
    emission_stats(stats, q, x, avail, params)
    return q, stats, value, path


def independent(x, avail, params, tree: Tree, **_):
    """Every species a chain of its own, with gamma and alpha alone."""
    o = emission(x, avail, params)
    q, stats, total = np.empty_like(o), empty_stats(params), 0.0
    for i in range(len(o)):
        c = Chain(log(params["gamma"]), log(params["alpha"]), o[i])
        q[i] = c.q
        stats["gamma"] += q[i, 0]
        stats["alpha"] += c.pair_sum()
        total += c.value
    emission_stats(stats, q, x, avail, params)
    return q, stats, -total, [-total]


def clique(x, avail, params, tree: Tree, max_joint: int = MAX_JOINT, **_):
    """Exact: sum-product over the joint states of all species, a species at a time."""
    q, pairs, first, value = exact.sum_product(emission(x, avail, params), params, tree, max_joint)
    stats = empty_stats(params)
    for i, p in enumerate(tree.parent):
        if p is None:
            stats["gamma"] += first[i][0]
            stats["alpha"] += pairs[i][0]
        else:
            stats["beta"] += first[i]
            theta = stats["theta"] if stats["theta"].ndim == 3 else stats["theta"][tree.branch()[i]]
            theta += pairs[i]
    emission_stats(stats, q, x, avail, params)
    return q, stats, -value, [-value]


def viterbi(x, avail, params, tree: Tree, joint: bool = True, max_joint: int = MAX_JOINT, **_) -> np.ndarray:
    """The likeliest states (species, bins): of all species together, or of each one's own chain."""
    o = emission(x, avail, params)
    if not joint:
        return np.stack([best_path(log(params["gamma"]), log(params["alpha"]), a) for a in o])
    return exact.max_product(o, params, tree, max_joint)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=-1, keepdims=True), FLOOR)


class _Messages:
    """Messages of loopy belief propagation: down (to a node from its table), left (to the bin before) and up (to the parent), each
    (species, bins, states). Nothing larger is held but for MESSAGE_BLOCK bins at a time, and no table of three states for a bin."""

    def __init__(self, o: np.ndarray, params: dict, tree: Tree):
        self.tree, (species, self.n, self.k) = tree, o.shape
        self.local = np.exp(o - o.max(axis=2, keepdims=True))
        self.down, self.left, self.up = (np.full(o.shape, 1.0 / self.k) for _ in range(3))
        self.first = [params["gamma"] if p is None else params["beta"] for p in tree.parent]
        self.rest = [params["alpha"] if p is None else theta_of(params, tree, i) for i, p in enumerate(tree.parent)]

    def spans(self):
        return [(lo, min(lo + MESSAGE_BLOCK, self.n)) for lo in range(0, self.n, MESSAGE_BLOCK)]

    def window(self, lo: int, hi: int) -> tuple[int, dict[str, np.ndarray]]:
        """Copies of the messages of bins lo - 1 to hi, as far as there are such; and the first of them."""
        a = max(lo - 1, 0)
        return a, {m: getattr(self, m)[:, a : hi + 1].copy() for m in ("down", "left", "up")}

    def incoming(self, old: dict, a: int, lo: int, hi: int, i: int, but: str = "", child: int = -1) -> np.ndarray:
        """What comes in at bins lo to hi - 1 of species i but for one message; old begins at bin a."""
        b, at = self.local[i, lo:hi].copy(), slice(lo - a, hi - a)
        if but != "down":
            b *= old["down"][i, at]
        if but != "left":
            after = old["left"][i, lo + 1 - a : hi + 1 - a]
            b[: len(after)] *= after
        for c in self.tree.children[i]:
            if c != child:
                b *= old["up"][c, at]
        return _unit(b)

    def parts(self, old: dict, a: int, lo: int, hi: int, i: int):
        """What enters species i's tables at bins lo to hi - 1: from the node, from its parent (None for a root), and from the bin before
        at all bins but bin 0."""
        p = self.tree.parent[i]
        own = self.incoming(old, a, lo, hi, i, "down")
        above = None if p is None else self.incoming(old, a, lo, hi, p, child=i)
        before = self.incoming(old, a, max(lo - 1, 0), hi - 1, i, "left") if hi - 1 > max(lo - 1, 0) else np.empty((0, self.k))
        return own, above, before

    def through(self, i: int, own, above, before, skip: int):
        """Sums of the tables times what enters, for each of the node's, the bin before's and the parent's states; the first skip bins
        (bin 0) have no bin before."""
        k = self.k
        to_node, to_before, to_parent = np.empty_like(own), np.ones_like(own), np.ones_like(own)
        if above is None:
            to_node[:skip] = self.first[i]
            to_node[skip:] = before @ self.rest[i]
            to_before[skip:] = own[skip:] @ self.rest[i].T
            return to_node, to_before, to_parent
        to_node[:skip] = above[:skip] @ self.first[i]
        to_parent[:skip] = own[:skip] @ self.first[i].T
        given = (above[skip:] @ self.rest[i].reshape(k, k * k)).reshape(-1, k, k)  # (bin, before, node)
        to_node[skip:] = np.matmul(before[:, None, :], given)[:, 0]
        to_before[skip:] = np.matmul(given, own[skip:, :, None])[:, :, 0]
        given = (own[skip:] @ self.rest[i].reshape(k * k, k).T).reshape(-1, k, k)  # (bin, parent, before)
        to_parent[skip:] = np.matmul(given, before[:, :, None])[:, :, 0]
        return to_node, to_before, to_parent

    def round(self) -> float:
        """All messages at once, from those of the round before; the largest change."""
        change, last = 0.0, None
        for lo, hi in self.spans():
            a, old = self.window(lo, hi)
            if last is not None:
                for m in old:
                    old[m][:, 0] = last[m]  # bin lo - 1, as it was before this round
            last = {m: old[m][:, hi - 1 - a].copy() for m in old}
            for i in range(len(self.tree.parent)):
                parts = self.parts(old, a, lo, hi, i)
                for m, new in zip(("down", "left", "up"), self.through(i, *parts, skip=int(lo == 0))):
                    new = _unit(new)
                    change = max(change, float(np.abs(new - old[m][i, lo - a : hi - a]).max()))
                    getattr(self, m)[i, lo:hi] = new
        return change


def loopy(x, avail, params, tree: Tree, most: int = 60, tolerance: float = 1e-2, **_):
    """Loopy belief propagation: each node's table ties it to its parent and to the bin before; all messages of a round are
    sent at once, normalised, until none changes by as much as the tolerance. The objective is Bethe's free energy."""
    msg = _Messages(emission(x, avail, params), params, tree)
    for _ in range(most):
        if msg.round() < tolerance:
            break
    stats, value, k, q = empty_stats(params), 0.0, msg.k, np.empty_like(msg.local)
    for lo, hi in msg.spans():
        a, old = msg.window(lo, hi)
        skip, last = int(lo == 0), int(hi == msg.n)
        for i, p in enumerate(tree.parent):
            q[i, lo:hi] = msg.incoming(old, a, lo, hi, i)
            tables = np.full(hi - lo, 1 + len(tree.children[i]) + 1)  # that a node is in
            tables[len(tables) - last :] -= 1
            value -= float(((tables - 1)[:, None] * q[i, lo:hi] * log(q[i, lo:hi])).sum())
            own, above, before = msg.parts(old, a, lo, hi, i)
            to_node, to_before, to_parent = msg.through(i, own, above, before, skip)
            whole = np.maximum((to_node * own).sum(axis=1), FLOOR)
            share = 1 / whole
            # The log of a belief over that of its table is the sum of the logs of what enters, less that of the whole.
            value += float((to_node * own * share[:, None] * log(own)).sum() - np.log(whole).sum())
            value += float((to_before[skip:] * before * share[skip:, None] * log(before)).sum())
            if above is not None:
                value += float((to_parent * above * share[:, None] * log(above)).sum())
            pair = (before[:, :, None] * (own[skip:] * share[skip:, None])[:, None, :]).reshape(-1, k * k)
            if p is None:
                stats["gamma"] += (to_node * own * share[:, None])[:skip].sum(axis=0)
                stats["alpha"] += pair.sum(axis=0).reshape(k, k) * params["alpha"]
            else:
                stats["beta"] += (above[:skip].T @ (own[:skip] * share[:skip, None])) * params["beta"]
                theta = stats["theta"] if stats["theta"].ndim == 3 else stats["theta"][tree.branch()[i]]
                theta += (above[skip:].T @ pair).reshape(k, k, k) * theta_of(params, tree, i)
    del msg
    o = emission(x, avail, params)
    value -= float((q * o).sum())
    emission_stats(stats, q, x, avail, params)
    return q, stats, value, [value, mean_field_energy(o, q, params, tree)]


def mean_field_energy(o: np.ndarray, q: np.ndarray, params: dict, tree: Tree) -> float:
    """The mean-field free energy of given posteriors."""
    return float((q * log(q)).sum() - (q * o).sum() - _expected(params, tree, q, _product(q)))


MODES = {"mf": mean_field, "poc": product_of_chains, "indep": independent, "clique": clique, "loopy": loopy}
KINDS = {"mf": "free_energy", "poc": "free_energy", "indep": "loglik", "clique": "loglik", "loopy": "free_energy"}
