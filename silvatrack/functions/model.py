"""The model: a tree of species, and its parameters as small arrays."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-150


def log(a: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(a, FLOOR))


class Tree:
    """parent[i] is None for a root; order has parents before children. Parents are given by name; a species that is its
    own parent, or has none, is a root."""

    def __init__(self, species: list[str], parents: dict[str, str | None]):
        unknown = (set(parents) | {p for p in parents.values() if p is not None}) - set(species)
        if unknown:
            raise ValueError(f"not among the species: {sorted(unknown)}")
        number = {s: i for i, s in enumerate(species)}
        self.species = list(species)
        self.parent = [None if parents.get(s) in (None, s) else number[parents[s]] for s in species]
        self.children = [[c for c, p in enumerate(self.parent) if p == i] for i in range(len(species))]
        self.order, ready = [], [i for i, p in enumerate(self.parent) if p is None]
        while ready:
            i = ready.pop(0)
            self.order.append(i)
            ready += self.children[i]
        if len(self.order) < len(species):
            raise ValueError("the tree has a cycle: " + ", ".join(s for i, s in enumerate(species) if i not in self.order))

    def rows(self) -> list[tuple[int, int | None, bool]]:
        """(i, parent, is_root)."""
        return [(i, p, p is None) for i, p in enumerate(self.parent)]

    def branch(self) -> dict[int, int]:
        """The place of each child's table when every branch has a theta of its own."""
        return {i: n for n, i in enumerate(i for i, p in enumerate(self.parent) if p is not None)}


def row_normalize(a: np.ndarray) -> np.ndarray:
    """Rows, along the last index, that sum to 1; a row of zeros becomes uniform."""
    total = a.sum(axis=-1, keepdims=True)
    return np.where(total > 0, a, 1.0) / np.where(total > 0, total, a.shape[-1])


def random_params(k: int, marks: int, seed: int, branches: int | None = None, means: bool = False) -> dict[str, np.ndarray]:
    """Random tables whose rows sum to 1; with branches, a theta for each; with means, a Gaussian in place of presence."""
    rng = np.random.default_rng(seed)
    shapes = {"gamma": (k,), "alpha": (k, k), "beta": (k, k), "theta": ((branches,) if branches else ()) + (k, k, k)}
    out = {n: row_normalize(rng.random(s) + 0.1) for n, s in shapes.items()}
    if means:
        return out | {"means": rng.normal(0, 1, (k, marks)), "variances": np.ones((k, marks))}
    return out | {"emit": 0.1 + 0.8 * rng.random((k, marks))}


def normalize_stats(stats: dict[str, np.ndarray], pseudocount: float = 1e-6, params: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The M-step: tables from summed statistics, the pseudocount added once. Of Gaussians, params has the means that the
    statistics are taken around."""
    out = {n: row_normalize(stats[n] + pseudocount) for n in ("gamma", "alpha", "beta", "theta")}
    if "emit_x2" in stats:
        weight = np.maximum(stats["emit_sum"] + pseudocount, FLOOR)
        away = stats["emit"] / weight
        return out | {"means": params["means"] + away, "variances": np.maximum(stats["emit_x2"] / weight - away**2, 0) + pseudocount + 1e-3}
    return out | {"emit": np.clip((stats["emit"] + pseudocount) / (stats["emit_sum"] + 2 * pseudocount), 1e-9, 1 - 1e-9)}
