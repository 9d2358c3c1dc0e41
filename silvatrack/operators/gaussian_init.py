"""Centres for continuous signal: spread-out starting points, and the variance around each.

Starting points come from a few passes over all rows instead of one for each centre. A pass takes, from all rows at once, a
bounded number with chances in proportion to the square of their distance to what is taken already; a last pass counts the
rows next to each of these candidates; the candidates, weighed by their counts, are then reduced to the centres in the same
way. Chances come from hashes of ids, so that a run gives the same centres however rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

LEAST_VARIANCE = 0.1
#: Passes that take candidates, and how many each takes for a centre.
PASSES, OVERSAMPLE = 5, 2
#: Passes whose draws are told apart from those of the reduction by their number.
REDUCTION = 1000


def _l1(x: Column, centre: list[float]) -> Column:
    return sum((F.abs(F.get(x, F.lit(d)) - float(v)) for d, v in enumerate(centre)), F.lit(0.0))


def distances(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """rows (id, x) with distance: the least L1 distance to a centre, and nearest: which (the lowest among equals)."""
    d = F.array(*[_l1(F.col("x"), c) for c in centres])
    return rows.withColumn("distance", F.array_min(d)).withColumn("nearest", (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def nearest_of_many(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """As distances, for some hundred centres: a batch of rows meets them one after the other in NumPy."""
    held = np.asarray(centres, dtype=float)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, nearest = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int32)
            for j, c in enumerate(held):
                d = np.abs(x - c).sum(axis=1)
                closer = d < best
                best[closer], nearest[closer] = d[closer], j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(nearest)], [*batch.schema.names, "distance", "nearest"])

    return rows.mapInArrow(each, StructType([*rows.schema.fields, StructField("distance", DoubleType()), StructField("nearest", IntegerType())]))


def draw(number: int, seed: int) -> Column:
    """A number between 0 and 1 for each id: 52 bits of a hash of the id, the draw's number and the seed."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(number), F.lit(seed))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / 2.0**52


def draw_of(id_, number: int, seed: int) -> float:
    """The same number, on the driver."""
    return (int(hashlib.md5(f"{id_}:{number}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def candidates(rows: DataFrame, per_pass: int, passes: int = PASSES, seed: int = 0) -> list[tuple]:
    """(id, x) of the candidates, in order of id: the row with the least draw, and of each pass the per_pass rows with the least
    -log(draw) / distance ** 2. At most 1 + passes * per_pass rows reach the driver; a row on a candidate's place is none."""
    first = rows.orderBy(draw(0, seed), "id").first()
    held = [] if first is None else [(first["id"], list(first["x"]))]
    for n in range(1, passes + 1 if held else 0):
        far = nearest_of_many(rows, [x for _, x in held]).filter("distance > 0")
        key = -F.log(draw(n, seed)) / (F.col("distance") * F.col("distance"))
        picks = far.select("id", "x", key.alias("key")).orderBy("key", "id").limit(per_pass).collect()
        if not picks:
            break
        held += [(r["id"], list(r["x"])) for r in picks]
    return sorted(held, key=lambda c: c[0])


def reduce_candidates(held: list[tuple], weights: list[int], k: int, seed: int = 0) -> list[int]:
    """The places of k of the candidates: the first by its weight, each further one by its weight times the square of its distance to
    those before it. Where no candidate lies elsewhere, the last one is repeated."""
    x, w = np.array([c for _, c in held], dtype=float), np.array(weights, dtype=float)
    far, out = np.ones(len(w)), []
    for n in range(k):
        chance = w * far
        if not (chance > 0).any():
            out.append(out[-1])
            continue
        keys = [(-math.log(draw_of(held[i][0], REDUCTION + n, seed)) / chance[i], held[i][0], i) for i in range(len(w)) if chance[i] > 0]
        out.append(min(keys)[2])
        d = np.abs(x - x[out[-1]]).sum(axis=1) ** 2
        far = d if n == 0 else np.minimum(far, d)
    return out


def weighed_centres(rows: DataFrame, k: int, seed: int = 0, passes: int = PASSES, per_pass: int | None = None) -> list[tuple]:
    """(id, rows next to it, x) of k centres. rows is (id, x array); ids are unique, and x has numbers alone, as many in each row. A
    table with fewer than k different rows gives some of them again; an empty one gives none."""
    held = candidates(rows, per_pass or OVERSAMPLE * k, passes, seed)
    if not held:
        return []
    counts = {r["nearest"]: r["n"] for r in nearest_of_many(rows, [x for _, x in held]).groupBy("nearest").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [counts.get(i, 0) for i in range(len(held))]
    return [(held[i][0], weights[i], held[i][1]) for i in reduce_candidates(held, weights, k, seed)]


def spread_centres(rows: DataFrame, k: int, seed: int = 0, passes: int = PASSES, per_pass: int | None = None) -> list[list[float]]:
    """k centres among the rows, as weighed_centres chooses them."""
    return [x for _, _, x in weighed_centres(rows, k, seed, passes, per_pass)]


def cluster_variances(rows: DataFrame, centres: list[list[float]], pseudocount: float = 1e-6) -> DataFrame:
    """(k, l, variance): of the rows nearest to each centre, with the pseudocount, and 0.1 at least."""
    near = distances(rows, centres).select(F.col("nearest").alias("k"), F.posexplode("x").alias("l", "v"))
    return near.groupBy("k", "l").agg(F.greatest(F.var_pop("v") + pseudocount, F.lit(LEAST_VARIANCE)).alias("variance"))


def gaussian_start(rows: DataFrame, k: int, seed: int = 0, pseudocount: float = 1e-6, passes: int = PASSES, per_pass: int | None = None) -> dict[str, np.ndarray]:
    """means and variances (k, marks) for a fit of continuous signal: spread centres, and the variance of the rows nearest to each.
    A centre that is there twice has no rows of its own, and takes the least variance."""
    centres = spread_centres(rows, k, seed, passes, per_pass)
    if not centres:
        raise ValueError("no rows to start from")
    marks = len(centres[0])
    # One pass of partial moments: a column for each mark, no row.
    away = nearest_of_many(rows, centres).select("nearest", *[F.get("x", F.lit(l)).alias(f"v{l}") for l in range(marks)])
    found = away.groupBy("nearest").agg(*[F.var_pop(f"v{l}").alias(f"v{l}") for l in range(marks)]).collect()
    variances = np.full((k, marks), LEAST_VARIANCE)
    for r in found:
        variances[r["nearest"]] = [max(r[f"v{l}"] + pseudocount, LEAST_VARIANCE) for l in range(marks)]
    return {"means": np.array(centres, dtype=float), "variances": variances}
