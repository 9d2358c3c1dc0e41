"""Exact inference over the joint states of all species, without a table of joint states squared.

A bin's joint states are an array with an axis for each species. A transition is applied to one species at a time, parents first:
the sum over a species' old state is taken, given its parent's new state, and its new state comes in. This costs states x
species x joint states for a bin. Backwards the same tables are applied children first; where both directions meet, a product of
two arrays has the joint posterior of a species' old and new state and its parent's new one. Of forward arrays only every
square root's is held, and the others are made again, a block at a time.
"""

from __future__ import annotations

import math

import numpy as np

from .model import FLOOR, Tree


class Joint:
    """Tables of the model for arrays of joint states: an axis for each species, species 0 first."""

    def __init__(self, params: dict, tree: Tree, species: int, most: int):
        self.k, self.species, self.order = len(params["gamma"]), species, tree.order
        if self.k**species > most:
            raise ValueError(f"{self.k} states of {species} species are {self.k**species} joint states; at most {most} are handled")
        self.shape = (self.k,) * species
        floor = lambda a: np.maximum(a, FLOOR)
        theta, branch = params["theta"], tree.branch()
        self.parent = tree.parent
        self.tables = [floor(params["alpha"])[None] if p is None else floor(theta if theta.ndim == 3 else theta[branch[i]]) for i, p in enumerate(tree.parent)]
        self.first = [floor(params["gamma"]) if p is None else floor(params["beta"]) for p in tree.parent]

    def along(self, a: np.ndarray, i: int) -> np.ndarray:
        """A vector of species i's states, shaped to multiply joint states."""
        return a.reshape((-1,) + (1,) * (self.species - 1 - i))

    def pull(self, f: np.ndarray, i: int) -> np.ndarray:
        """f as (parent's states, own states, rest); a root has one parent state."""
        p = self.parent[i]
        return np.moveaxis(f, i, 0).reshape(1, self.k, -1) if p is None else np.moveaxis(f, (p, i), (0, 1)).reshape(self.k, self.k, -1)

    def push(self, g: np.ndarray, i: int) -> np.ndarray:
        p = self.parent[i]
        return np.moveaxis(g.reshape(self.shape), 0, i) if p is None else np.moveaxis(g.reshape(self.shape), (0, 1), (p, i))

    def start(self) -> np.ndarray:
        f = np.ones(self.shape)
        for i, p in enumerate(self.parent):
            if p is None:
                f = f * self.along(self.first[i], i)
            else:
                f = self.push(self.pull(f, i) * self.first[i][:, :, None], i)
        return f

    def forward(self, f: np.ndarray, steps: list | None = None) -> np.ndarray:
        """One transition; steps gets the arrays before each species, as pull gives them."""
        for i in self.order:
            g = self.pull(f, i)
            if steps is not None:
                steps.append(g)
            f = self.push(np.matmul(self.tables[i].transpose(0, 2, 1), g), i)
        return f

    def marginal(self, f: np.ndarray, *keep: int) -> np.ndarray:
        out = f.sum(axis=tuple(a for a in range(self.species) if a not in keep))
        return out if len(keep) < 2 or keep[0] < keep[1] else out.T


def _spans(n: int) -> list[tuple[int, int]]:
    size = max(1, math.isqrt(n - 1) + 1) if n else 1
    return [(lo, min(lo + size, n)) for lo in range(0, n, size)]


def sum_product(o: np.ndarray, params: dict, tree: Tree, most: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], float]:
    """Of emissions o (species, bins, states): posteriors of the same shape, for each species the sum of the joint posteriors
    (parent's state, state before, state) over all transitions, and that of (parent's state, state) at bin 0, and the log-likelihood."""
    species, n, k = o.shape
    joint = Joint(params, tree, species, most)
    shift = o.max(axis=2, keepdims=True)
    e = np.exp(o - shift)
    scale, kept = np.empty(n), {}

    def step(f: np.ndarray | None, t: int) -> tuple[np.ndarray, float]:
        f = joint.start() if f is None else joint.forward(f)
        for i in range(species):
            f = f * joint.along(e[i, t], i)
        total = f.sum()
        return f / total, total

    spans = _spans(n)
    starts = {lo for lo, _ in spans}
    f = None
    for t in range(n):
        f, scale[t] = step(f, t)
        if t in starts:
            kept[t] = f
    q = np.empty_like(o)
    pairs = [np.zeros_like(t) for t in joint.tables]
    later = None  # what comes after bin t, at the new states of bin t + 1
    for lo, hi in reversed(spans):
        held = [kept.pop(lo)]
        for t in range(lo + 1, hi):
            held.append(step(held[-1], t)[0])
        for t in range(hi - 1, lo - 1, -1):
            f = held.pop()
            if later is None:
                back = np.ones(joint.shape)
            else:
                before: list[np.ndarray] = []
                joint.forward(f, before)
                back = later
                for i, g in zip(reversed(joint.order), reversed(before)):
                    b = joint.pull(back, i)
                    pairs[i] += np.matmul(g, b.transpose(0, 2, 1)) * joint.tables[i]
                    back = joint.push(np.matmul(joint.tables[i], b), i)
            here = f * back
            here /= here.sum()
            for i in range(species):
                q[i, t] = joint.marginal(here, i)
            later = back / scale[t]
            for i in range(species):
                later = later * joint.along(e[i, t], i)
    first = [joint.marginal(here, i)[None] if p is None else joint.marginal(here, p, i) for i, p in enumerate(tree.parent)]
    return q, pairs, first, float(np.log(scale).sum() + shift.sum())


def max_product(o: np.ndarray, params: dict, tree: Tree, most: int) -> np.ndarray:
    """The likeliest states (species, bins) together. Among equals the lowest old state is taken for one species after the other,
    from the last of the tree's order to the first."""
    species, n, k = o.shape
    joint = Joint(params, tree, species, most)
    tables = [np.log(t) for t in joint.tables]

    def emitted(f: np.ndarray, t: int) -> np.ndarray:
        for i in range(species):
            f = f + joint.along(o[i, t], i)
        return f

    def step(f: np.ndarray, t: int, pointers: list | None = None) -> np.ndarray:
        for i in joint.order:
            g = joint.pull(f, i)
            best = tables[i][:, 0, :, None] + g[:, 0, None, :]
            which = np.zeros(best.shape, dtype=np.int16 if k < 2**15 else np.int32)
            for h in range(1, k):
                new = tables[i][:, h, :, None] + g[:, h, None, :]
                better = new > best
                which[better] = h
                np.maximum(best, new, out=best)
            if pointers is not None:
                pointers.append(joint.push(which, i))
            f = joint.push(best, i)
        return emitted(f, t)

    spans, kept = _spans(n), {}
    starts, f = {lo for lo, _ in spans}, emitted(np.log(joint.start()), 0)
    for t in range(n):
        f = f if t == 0 else step(f, t)
        if t in starts:
            kept[t] = f
    state = list(np.unravel_index(int(f.argmax()), joint.shape))
    path = np.empty((species, n), dtype=np.int64)
    path[:, n - 1] = state
    for lo, hi in reversed(spans):
        f, back = kept.pop(lo), []
        for t in range(lo, min(hi, n - 1)):
            back.append([])
            f = step(f, t + 1, back[-1])
        for t in range(min(hi, n - 1) - 1, lo - 1, -1):
            for i, which in zip(reversed(joint.order), reversed(back[t - lo])):
                state[i] = int(which[tuple(state)])
            path[:, t] = state
    return path
