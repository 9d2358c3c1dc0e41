"""Kernels along a chromosome."""

from __future__ import annotations

import math


def gauss_kernel(w: int) -> list[tuple[int, float]]:
    """(x, weight) for x from -w to w: exp(-x * x / w), normalised to sum 1."""
    raw = [(x, math.exp(-x * x / w)) for x in range(-w, w + 1)]
    total = sum(v for _, v in raw)
    return [(x, v / total) for x, v in raw]
