"""The product of chains over many chunks of like numbers of bins at once: one NumPy step for each bin does all of them. A chunk leaves
the stack when its own objective has settled, so that each gets the sweeps it would get alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import BLOCK, emission, emission_stats, empty_stats, theta_of
from .model import FLOOR, Tree, log


class Chains:
    """A chain for each chunk of a stack. Transitions are one table (K, K) for all, or the expected logs of theta (K, K, K) under the parent's
    posteriors above (chunks, bins, K). q has the marginals, 0 where a chunk has no bin; value the logs of the sums over paths."""

    def __init__(self, start: np.ndarray, nodes: np.ndarray, there: np.ndarray, step: np.ndarray | None = None, above: np.ndarray | None = None, theta: np.ndarray | None = None):
        self.step, self.above, self.theta, self.there = step, above, theta, there
        bins = nodes.shape[1]
        shift = nodes.max(axis=2, keepdims=True)
        node = np.exp(nodes - shift)
        first = start.max(axis=-1, keepdims=True)
        f = np.exp(start - first) * node[:, 0]
        scale, tops = np.ones(nodes.shape[:2]), np.zeros(len(nodes))
        scale[:, 0] = f.sum(axis=1)
        self.forward, self.weighted = np.empty_like(node), np.zeros_like(node)
        self.forward[:, 0] = f / scale[:, :1]
        for lo, hi in spans(bins):
            tables, top = self._tables(lo, hi)
            tops += (top * there[:, lo + 1 : hi + 1]).sum(axis=1)
            for t in range(lo, hi):
                f = self._times(self.forward[:, t], tables, t - lo) * node[:, t + 1]
                m, s = there[:, t + 1], f.sum(axis=1)
                self.forward[:, t + 1] = np.where(m[:, None], f / s[:, None], self.forward[:, t])
                scale[:, t + 1] = np.where(m, s, 1.0)
        back = np.ones_like(self.forward[:, 0])
        self.q = np.empty_like(node)
        self.q[:, -1] = self.forward[:, -1]
        for lo, hi in reversed(spans(bins)):
            tables, _ = self._tables(lo, hi)
            for t in range(hi - 1, lo - 1, -1):
                m = there[:, t + 1, None]
                w = np.where(m, node[:, t + 1] * back / scale[:, t + 1, None], 0.0)
                self.weighted[:, t + 1] = w
                back = np.where(m, self._times(w, tables, t - lo, turned=True), 1.0)
                self.q[:, t] = self.forward[:, t] * back
        self.q *= there[:, :, None]
        self.q /= np.maximum(self.q.sum(axis=2, keepdims=True), FLOOR)
        first = np.broadcast_to(first[..., 0], len(nodes))
        self.value = (np.log(scale) + shift[:, :, 0] * there).sum(axis=1) + tops + first

    def _tables(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of transitions lo to hi - 1, and the logs that they were divided by (chunks, transitions)."""
        if self.step is not None:
            top = self.step.max()
            return np.exp(self.step - top), np.full((len(self.there), hi - lo), top)
        k = self.theta.shape[0]
        steps = (self.above[:, lo + 1 : hi + 1] @ self.theta.reshape(k, k * k)).reshape(len(self.above), hi - lo, k, k)
        top = steps.max(axis=(2, 3))
        return np.exp(steps - top[:, :, None, None]), top

    @staticmethod
    def _times(v: np.ndarray, tables: np.ndarray, at: int, turned: bool = False) -> np.ndarray:
        if tables.ndim == 2:
            return v @ (tables.T if turned else tables)
        return np.matmul(tables[:, at], v[:, :, None])[:, :, 0] if turned else np.matmul(v[:, None, :], tables[:, at])[:, 0]

    def pairs(self, lo: int, hi: int) -> np.ndarray:
        """Pair marginals (chunks, transitions, before, state) of transitions lo to hi - 1, 0 where a chunk has none."""
        tables = self._tables(lo, hi)[0]
        out = self.forward[:, lo:hi, :, None] * (tables if tables.ndim == 4 else tables[None, None]) * self.weighted[:, lo + 1 : hi + 1, None, :]
        return out / np.maximum(out.sum(axis=(2, 3), keepdims=True), FLOOR)

    def take(self, which: np.ndarray) -> None:
        """Keeps these chunks alone."""
        for name in ("forward", "weighted", "q", "value", "there", "above"):
            if getattr(self, name) is not None:
                setattr(self, name, getattr(self, name)[which])


def spans(bins: int) -> list[tuple[int, int]]:
    """Transitions in blocks."""
    return [(lo, min(lo + BLOCK, bins - 1)) for lo in range(0, bins - 1, BLOCK)]


def product_of_chains(xs: list[np.ndarray], avail: np.ndarray, params: dict, tree: Tree, most: int = 10, epsilon: float = 1e-3, **_) -> Iterator[tuple[np.ndarray, np.ndarray, dict, np.ndarray]]:
    """kernels.product_of_chains of a stack of observations (species, bins, marks): for the chunks that settle together, their numbers,
    posteriors (chunks, species, bins, K), summed statistics and objectives."""
    species, bins = len(tree.parent), max(x.shape[1] for x in xs)
    n = np.array([x.shape[1] for x in xs])
    there = np.arange(bins)[None] < n[:, None]
    x = np.zeros((len(xs), species, bins, xs[0].shape[2]), dtype=xs[0].dtype)
    for b, one in enumerate(xs):
        x[b, :, : n[b]] = one
    o = np.stack([emission(a, avail, params) for a in x]) * there[:, None, :, None]
    number, thetas = np.arange(len(xs)), [None if p is None else log(theta_of(params, tree, i)) for i, p in enumerate(tree.parent)]
    gamma, alpha, beta = (log(params[m]) for m in ("gamma", "alpha", "beta"))
    chains = []
    for i, p in enumerate(tree.parent):
        step = params["alpha"] if p is None else theta_of(params, tree, i).mean(axis=0)
        chains.append(Chains(gamma if p is None else log(params["beta"].mean(axis=0)), o[:, i], there, log(step)))

    def energy() -> np.ndarray:
        total = np.zeros(len(o))
        for i, p in enumerate(tree.parent):
            q = chains[i].q
            total += (q[:, 0] * log(q[:, 0])).sum(axis=1) - (q * o[:, i]).sum(axis=(1, 2))
            total -= q[:, 0] @ gamma if p is None else np.einsum("bv,vk,bk->b", chains[p].q[:, 0], beta, q[:, 0])
            for lo, hi in spans(bins):
                pair = chains[i].pairs(lo, hi)
                total += (pair * log(pair / np.maximum(q[:, lo:hi, :, None], FLOOR))).sum(axis=(1, 2, 3))
                if p is None:
                    total -= (pair.sum(axis=1) * alpha).sum(axis=(1, 2))
                else:
                    k = len(gamma)
                    expected = (chains[p].q[:, lo + 1 : hi + 1] @ thetas[i].reshape(k, k * k)).reshape(pair.shape)
                    total -= (expected * pair).sum(axis=(1, 2, 3))
        return total

    def update() -> None:
        for i, p in enumerate(tree.parent):
            nodes = o[:, i].copy()
            for c in tree.children[i]:
                nodes[:, 0] += chains[c].q[:, 0] @ beta.T
                for lo, hi in spans(bins):
                    k = len(gamma)
                    nodes[:, lo + 1 : hi + 1] += chains[c].pairs(lo, hi).reshape(len(o), hi - lo, k * k) @ thetas[c].reshape(k, k * k).T
            if p is None:
                chains[i] = Chains(gamma, nodes, there, alpha)
            else:
                chains[i] = Chains(chains[p].q[:, 0] @ beta, nodes, there, above=chains[p].q, theta=thetas[i])

    def finished(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict, np.ndarray]:
        stats = empty_stats(params)
        q = np.stack([c.q[which] for c in chains], axis=1)
        for i, p in enumerate(tree.parent):
            if p is None:
                stats["gamma"] += q[:, i, 0].sum(axis=0)
            else:
                stats["beta"] += q[:, p, 0].T @ q[:, i, 0]
            for lo, hi in spans(bins):
                pair = chains[i].pairs(lo, hi)[which]
                if p is None:
                    stats["alpha"] += pair.sum(axis=(0, 1))
                else:
                    k = len(gamma)
                    theta = stats["theta"] if stats["theta"].ndim == 3 else stats["theta"][tree.branch()[i]]
                    theta += (q[:, p, lo + 1 : hi + 1].reshape(-1, k).T @ pair.reshape(-1, k * k)).reshape(k, k, k)
        emission_stats(stats, q.transpose(1, 0, 2, 3).reshape(species, -1, len(gamma)), x[which].transpose(1, 0, 2, 3).reshape(species, -1, x.shape[3]), avail, params)
        return number[which], q, stats, value[which]

    value = energy()
    for sweep in range(most + 1):
        if sweep == most:
            yield finished(np.arange(len(number)))
            return
        update()
        before, value = value, energy()
        done = np.abs(before - value) <= epsilon * np.abs(before)
        if done.any():
            yield finished(np.flatnonzero(done))
            stay = np.flatnonzero(~done)
            if not len(stay):
                return
            number, o, x, there, value = number[stay], o[stay], x[stay], there[stay], value[stay]
            for c in chains:
                c.take(stay)
