"""Poisson background: the smallest count that is present at a level of significance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def smallest_present(rate: float, level: float) -> int:
    """The smallest c with P(X > c) < level for a Poisson X of this rate. The tail is summed in log space from above, so that
    neither large rates nor tiny levels underflow."""
    if rate <= 0:
        return 0
    log_rate = math.log(rate)
    pmf = lambda n: -rate + n * log_rate - math.lgamma(n + 1)

    def above(c: int) -> bool:  # P(X > c) < level
        total, top = 0.0, None
        n = c + 1
        while True:
            x = pmf(n)
            top = x if top is None else max(top, x)
            total += math.exp(x)
            if total >= level or (n > rate and x < top - 40):
                return total < level
            n += 1

    low, high = -1, max(1, int(rate))
    while not above(high):
        low, high = high, 2 * high + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return high


#: What lies outside the counts that are summed is less than exp(-FAR) of the level; and exp(-SURE) bounds what lies below them.
FAR, SURE = 40.0, 40.0


def threshold(rate: Column, level: float) -> Column:
    """smallest_present of each rate, for a level under 1. The tail is summed from a count so far above the mean that nothing beyond it
    matters down to the count where it comes to the level; both bounds follow from mean and variance (Bernstein), so that the
    counts looked at grow with the root of the rate."""
    t = FAR - math.log(level)
    high = F.ceil(rate + t / 3 + F.sqrt(t * t / 9 + 2 * t * rate)).cast("long") + 20
    low = F.greatest(F.lit(0).cast("long"), F.floor(rate - F.sqrt(2 * SURE * rate)).cast("long"))
    n = high.cast("double")
    # ln(high!) by its series, which is exact to the last digits from 20 on.
    factorial = (n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * F.pow(n, F.lit(3))) + 1 / (1260 * F.pow(n, F.lit(5)))
    log_rate = F.log(rate)
    start = F.struct((n * log_rate - rate - factorial).alias("p"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("least"))

    def step(held: Column, j: Column) -> Column:
        tail = held["tail"] + F.exp(held["p"])  # P(X >= j)
        reached = (held["least"] < 0) & (tail >= level)
        return F.struct((held["p"] + F.log(j) - log_rate).alias("p"), tail.alias("tail"), F.when(reached, j).otherwise(held["least"]).alias("least"))

    counts = F.sequence(high, F.greatest(low, F.lit(1).cast("long")), F.lit(-1).cast("long"))
    found = F.aggregate(counts, start, step, lambda held: F.greatest(held["least"], F.lit(0).cast("long")))
    return F.when(rate > 0, found).otherwise(F.lit(0).cast("long"))
