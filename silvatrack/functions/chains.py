"""Stacks of chains of one species each: many blocks of bins with like numbers of bins go through one NumPy step for each bin. A block
may be the whole chain, or a part of one that is told what enters it and what comes after it."""

from __future__ import annotations

import numpy as np

from .model import FLOOR, log


def live(n: np.ndarray, bins: int) -> np.ndarray:
    """(blocks, bins): which bins of a stack are any."""
    return np.arange(bins)[None, :] < n[:, None]


def block_tables(o: np.ndarray, n: np.ndarray, first: np.ndarray, params: dict) -> np.ndarray:
    """Log tables (blocks, K, K) of each block: from the state of the bin before it to that of its last bin. The first block of a chain
    begins with the start probabilities whatever the state before. o is (blocks, bins, K), 0 where a block has no bin."""
    step, gamma = np.maximum(params["alpha"], FLOOR), np.maximum(params["gamma"], FLOOR)
    top = o.max(axis=2, keepdims=True)
    e, there = np.exp(o - top), live(n, o.shape[1])
    table = np.where(first[:, None, None], gamma[None, None, :], step[None]) * e[:, 0, None, :]
    scale = np.zeros(table.shape[:2])
    for t in range(o.shape[1]):
        if t:
            table = np.where(there[:, t, None, None], np.matmul(table, step) * e[:, t, None, :], table)
        high = np.maximum(table.max(axis=2), FLOOR)
        table, scale = table / high[:, :, None], scale + np.log(high)
    return np.log(np.maximum(table, 1e-300)) + scale[:, :, None] + (top[:, :, 0] * there).sum(axis=1)[:, None, None]


def log_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of log tables, over the last two axes; no array of three states is made."""
    high = best_product(a, b)
    total = np.exp(a[..., :, 0, None] + b[..., 0, None, :] - high)
    for j in range(1, a.shape[-1]):
        total += np.exp(a[..., :, j, None] + b[..., j, None, :] - high)
    return high + np.log(total)


def forward_backward(o: np.ndarray, n: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray, params: dict):
    """Posteriors q of the blocks' shape, the sums of pair and start posteriors (K, K) and (K), and each block's part of the
    log-likelihood. enter has the probabilities of the bin before a block given all up to it (of no account for a first block), leave
    the likelihood of all after a block for each state of its last bin, to any scale. A block's first transition is its own."""
    step, gamma = np.maximum(params["alpha"], FLOOR), np.maximum(params["gamma"], FLOOR)
    blocks, bins, k = o.shape
    top, there = o.max(axis=2, keepdims=True), live(n, bins)
    e = np.exp(o - top)
    enter = np.where(first[:, None], 0.0, enter)
    f, scale = np.empty_like(o), np.ones((blocks, bins))
    for t in range(bins):
        before = f[:, t - 1] if t else enter
        g = (before @ step if t else np.where(first[:, None], gamma, enter @ step)) * e[:, t]
        s, m = np.maximum(g.sum(axis=1), 1e-300), there[:, t]
        f[:, t] = np.where(m[:, None], g / s[:, None], before)
        scale[:, t] = np.where(m, s, 1.0)
    back = leave / np.maximum((f[:, -1] * leave).sum(axis=1, keepdims=True), 1e-300)
    q, pair = np.zeros_like(o), np.zeros((k, k))
    for t in range(bins - 1, -1, -1):
        m = there[:, t, None]
        q[:, t] = np.where(m, f[:, t] * back, 0.0)
        weighted = np.where(m, e[:, t] * back / scale[:, t, None], 0.0)
        pair += (f[:, t - 1] if t else enter).T @ weighted
        back = np.where(m, weighted @ step.T, back)
    q /= np.maximum(q.sum(axis=2, keepdims=True), FLOOR)
    return q, pair * step, q[first, 0].sum(axis=0), ((np.log(scale) + top[:, :, 0]) * there).sum(axis=1)


def best_tables(o: np.ndarray, n: np.ndarray, first: np.ndarray, params: dict) -> np.ndarray:
    """As block_tables, of the best paths in place of all."""
    step, there = log(params["alpha"]), live(n, o.shape[1])
    table = np.where(first[:, None, None], log(params["gamma"])[None, None, :], step[None]) + o[:, 0, None, :]
    for t in range(1, o.shape[1]):
        table = np.where(there[:, t, None, None], best_product(table, step[None]) + o[:, t, None, :], table)
    return table


def best_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of tables, over the last two axes; no array of three states is made."""
    out = a[..., :, 0, None] + b[..., 0, None, :]
    for j in range(1, a.shape[-1]):
        np.maximum(out, a[..., :, j, None] + b[..., j, None, :], out=out)
    return out


def best_steps(o: np.ndarray, n: np.ndarray, first: np.ndarray, enter: np.ndarray, params: dict) -> tuple[np.ndarray, np.ndarray]:
    """(pointers of the blocks' shape, scores of each block's last bin): the state before for each state, the lowest among equals. enter
    has the best scores of the bin before a block."""
    step, there = log(params["alpha"]), live(n, o.shape[1])
    back = np.zeros(o.shape, dtype=np.int16 if o.shape[2] < 2**15 else np.int32)
    score = enter
    for t in range(o.shape[1]):
        both = score[:, :, None] + step[None]
        back[:, t] = both.argmax(axis=1)
        new = both.max(axis=1) + o[:, t]
        if t == 0:
            new = np.where(first[:, None], log(params["gamma"]) + o[:, 0], new)
        score = np.where(there[:, t, None], new, score)
    return back, score


def trace(back: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states (blocks, bins), state of the bin before): along the pointers from each block's last state."""
    blocks, bins, _ = back.shape
    path, state, at = np.zeros((blocks, bins), dtype=np.int64), last.copy(), np.arange(blocks)
    for t in range(bins - 1, -1, -1):
        m = t < n
        path[:, t] = state
        state = np.where(m, back[at, t, state], state)
    return path, state
