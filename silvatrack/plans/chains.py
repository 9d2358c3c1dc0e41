"""Chains of one species each, as a parallel scan. The unit of work is a block of bins of a chunk and a species, so neither a long chunk
nor a single one is one task's. Blocks make log tables from the state before them to that of their last bin; a scan of the tables
tells each block what enters it and what comes after it; then every block finishes on its own. Chunks of one block need no scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains, kernels
from ..operators import scan
from ..sources.tables import kept

#: Bins of a block; a chunk of fewer is one.
BLOCK = 4096
#: Numbers of a stack: blocks times bins times states, about.
STACK = 1 << 20
#: Bins that become rows at a time.
ROWS = 16_384
#: Blocks of long chunks whose entries are broadcast at most: more are joined by a shuffle.
MAX_BROADCAST = 100_000
KEY = ["chunk_id", "i"]


def pack_units(cut_calls: DataFrame, chunks: DataFrame, species: int, block: int = BLOCK, value: str | None = None) -> DataFrame:
    """(chunk_id, i, block, n_blocks, first, n, t, l): a row for each block of bins of each chunk and species, also those without
    calls; first is the block's first bin in its chunk, n its number of bins, t (from the block's start) and l have an entry for
    each call. With value, the name of a column, there is an array value too."""
    fields = [(F.col("t") - F.expr(f"t div {block}") * block).cast("int").alias("t"), F.col("l").cast("int").alias("l")] + ([F.col(value).cast("double").alias("value")] if value else [])
    names = ["t", "l"] + (["value"] if value else [])
    cells = cut_calls.groupBy("chunk_id", F.col("i").cast("int").alias("i"), F.expr(f"t div {block}").cast("long").alias("block")).agg(F.collect_list(F.struct(*fields)).alias("c"))
    length = F.col("end") - F.col("start")
    n_blocks = F.expr(f"(end - start + {block - 1}) div {block}").cast("long")
    units = chunks.select("chunk_id", n_blocks.alias("n_blocks"), length.alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    units = units.select("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(species - 1))).alias("i"), "block", "n_blocks", (F.col("block") * block).alias("first"), F.least(F.lit(block), F.col("length") - F.col("block") * block).cast("int").alias("n"))
    return units.join(cells, [*KEY, "block"], "left").select("chunk_id", "i", "block", "n_blocks", "first", "n", *[F.col(f"c.{m}").alias(m) for m in names])


def _stacks(pdf: pd.DataFrame, states: int) -> Iterator[pd.DataFrame]:
    """Parts of pdf whose blocks are at most twice as long as their shortest."""
    pdf = pdf.sort_values("n", kind="stable")
    n, lo = pdf["n"].to_numpy(), 0
    for hi in range(1, len(n) + 1):
        if hi == len(n) or n[hi] > 2 * n[lo] or (hi + 1 - lo) * n[hi] * states > STACK:
            yield pdf.iloc[lo:hi]
            lo = hi


def _observed(part: pd.DataFrame, marks: int) -> np.ndarray:
    """Observations (blocks, bins, marks): presence, or values; 0 where nothing is."""
    values = "value" in part.columns
    x = np.zeros((len(part), int(part["n"].max()), marks), dtype=float if values else np.int8)
    for b, row in enumerate(part.itertuples()):
        if row.t is not None:
            l = np.asarray(row.l, dtype=np.int64)
            inside = l < marks
            x[b, np.asarray(row.t, dtype=np.int64)[inside], l[inside]] = np.asarray(row.value)[inside] if values else 1
    return x


def _prepared(pdf: pd.DataFrame, params: dict, avail: np.ndarray) -> Iterator[tuple]:
    """(part, observations, availability, emissions, numbers of bins, which are first blocks) of each stack."""
    for part in _stacks(pdf, len(params["gamma"])):
        x, own, n = _observed(part, avail.shape[1]), avail[part["i"].to_numpy()], part["n"].to_numpy()
        o = np.where(chains.live(n, x.shape[1])[:, :, None], kernels.emission(x, own, params), 0.0)
        yield part, x, own, o, n, (part["block"] == 0).to_numpy()


def _tables(units: DataFrame, params: dict, avail: np.ndarray, of) -> DataFrame:
    """(chunk_id, i, block, n_blocks, value): the tables of the blocks of chunks of more than one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, _, _, o, n, first in _prepared(pdf, params, avail):
                yield part[[*KEY, "block", "n_blocks"]].assign(value=list(of(o, n, first, params).reshape(len(part), -1)))

    return kept(units.filter("n_blocks > 1").mapInPandas(each, "chunk_id long, i int, block long, n_blocks long, value array<double>"), "tables")


def _backwards(table: DataFrame) -> DataFrame:
    return table.select(*KEY, (F.col("n_blocks") - 1 - F.col("block")).alias("at"), "value")


def _with(units: DataFrame, carried: DataFrame) -> DataFrame:
    """units with what is carried to their blocks, null where nothing is."""
    few = F.broadcast(carried) if carried.count() <= MAX_BROADCAST else carried
    return units.join(few, [*KEY, "block"], "left")


def entries(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> DataFrame:
    """units with enter and leave, as chains.forward_backward takes them: null at a chunk's ends."""
    none = F.lit(None).cast("array<double>")
    if units.filter("n_blocks > 1").isEmpty():
        return units.withColumns({"enter": none, "leave": none})
    k = len(params["gamma"])
    table = _tables(units, params, avail, chains.block_tables)
    square = lambda v: v.reshape(-1, k, k)
    before = scan.exclusive(table.select(*KEY, F.col("block").alias("at"), "value"), KEY, lambda a, b: chains.log_product(square(a), square(b)).reshape(a.shape), fan, stacked=True)
    after = scan.exclusive(_backwards(table), KEY, lambda a, b: chains.log_product(square(b), square(a)).reshape(a.shape), fan, stacked=True)
    both = table.select(*KEY, "block", (F.col("n_blocks") - 1 - F.col("block")).alias("back")).join(before.select(*KEY, F.col("at").alias("block"), F.col("before").alias("enter")), [*KEY, "block"])
    both = both.join(after.select(*KEY, F.col("at").alias("back"), F.col("before").alias("leave")), [*KEY, "back"])

    def spread(v: np.ndarray) -> np.ndarray:
        return np.exp(v - v.max(axis=1, keepdims=True))

    def enters(tables: np.ndarray) -> np.ndarray:
        v = spread(tables[:, 0])  # the rows are alike: they begin with a first block
        return v / v.sum(axis=1, keepdims=True)

    def leaves(tables: np.ndarray) -> np.ndarray:
        return spread(chains.log_product(tables, np.zeros((1, k, 1)))[:, :, 0])

    def where(column: pd.Series, make) -> list:
        """make of those that are there."""
        there = np.flatnonzero(column.notna())
        out: list = [None] * len(column)
        for b, v in zip(there, make(square(np.stack(list(column.iloc[there])))) if len(there) else ()):
            out[b] = v
        return out

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*KEY, "block"]].assign(enter=where(pdf["enter"], enters), leave=where(pdf["leave"], leaves))

    carried = kept(both.mapInPandas(vectors, "chunk_id long, i int, block long, enter array<double>, leave array<double>"), "entries")
    return _with(units, carried)


def _or(column: pd.Series, k: int, fill: float) -> np.ndarray:
    return np.stack([np.full(k, fill) if v is None else np.asarray(v) for v in column])


def _rows(part: pd.DataFrame, n: np.ndarray, **found: np.ndarray) -> Iterator[pd.DataFrame]:
    """(chunk_id, i, t and one column more): a row for each bin of a stack's blocks, ROWS at a time, however short the blocks."""
    (name, values), = found.items()
    block, t = np.nonzero(chains.live(n, values.shape[1]))
    chunk_id, i, first = (part[c].to_numpy() for c in ("chunk_id", "i", "first"))
    for lo in range(0, len(t), ROWS):
        b, at = block[lo : lo + ROWS], t[lo : lo + ROWS]
        cells = values[b, at]
        yield pd.DataFrame({"chunk_id": chunk_id[b], "i": i[b], "t": first[b] + at, name: list(cells) if cells.ndim > 1 else cells})


def _solved(units: DataFrame, params: dict, avail: np.ndarray, fan: int, make, schema: str) -> DataFrame:
    k = len(params["gamma"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x, own, o, n, first in _prepared(pdf, params, avail):
                yield from make(part, x, own, n, chains.forward_backward(o, n, first, _or(part["enter"], k, 0.0), _or(part["leave"], k, 1.0), params))

    return entries(units, params, avail, fan).mapInPandas(each, schema)


def posteriors(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> DataFrame:
    """(chunk_id, i, t, q array) of every bin of every unit."""

    def make(part, x, own, n, found):
        return _rows(part, n, q=found[0])

    return _solved(units, params, avail, fan, make, "chunk_id long, i int, t long, q array<double>")


def objectives(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> DataFrame:
    """(chunk_id, objective): minus the log-likelihood of each chunk, over its species and blocks."""

    def make(part, x, own, n, found):
        yield pd.DataFrame({"chunk_id": part["chunk_id"], "objective": -found[3]})

    return _solved(units, params, avail, fan, make, "chunk_id long, objective double").groupBy("chunk_id").agg(F.sum("objective").alias("objective"))


def sums(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> DataFrame:
    """(name, place, value): the statistics of kernels.independent, flat, and the objective, summed over all units."""

    def make(part, x, own, n, found):
        q, pair, start, value = found
        stats = kernels.empty_stats(params)
        stats["gamma"] += start
        stats["alpha"] += pair
        kernels.emission_stats(stats, q, x, own, params)
        flat = {**stats, "objective": np.array([-value.sum()])}
        yield pd.concat([pd.DataFrame({"name": m, "place": np.arange(a.size), "value": a.ravel()}) for m, a in flat.items() if a.any()])

    return _solved(units, params, avail, fan, make, "name string, place long, value double").groupBy("name", "place").agg(F.sum("value").alias("value"))


def expectation(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> tuple[dict[str, np.ndarray], float]:
    """Statistics and objective over all units; the driver gets one number for each of the model's."""
    stats, value = kernels.empty_stats(params), 0.0
    for r in sums(units, params, avail, fan).collect():
        if r["name"] == "objective":
            value = r["value"]
        else:
            stats[r["name"]].flat[r["place"]] = r["value"]
    return stats, value


def best_paths(units: DataFrame, params: dict, avail: np.ndarray, fan: int = scan.FAN) -> DataFrame:
    """(chunk_id, i, t, state): the likeliest path of every chunk and species; the lowest states among equals, going back from the end."""
    k = len(params["gamma"])
    many = not units.filter("n_blocks > 1").isEmpty()
    none = F.lit(None).cast("array<double>")
    given = units.withColumns({"enter": none, "ends": none})

    def steps(part, o, n, first):
        return chains.best_steps(o, n, first, _or(part["enter"], k, 0.0), params)

    if many:
        table = _tables(units, params, avail, chains.best_tables)
        square = lambda v: v.reshape(-1, k, k)
        before = scan.exclusive(table.select(*KEY, F.col("block").alias("at"), "value"), KEY, lambda a, b: chains.best_product(square(a), square(b)).reshape(a.shape), fan, stacked=True)
        carried = kept(before.select(*KEY, F.col("at").alias("block"), F.slice("before", 1, k).alias("enter")), "enter")

        def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, _, _, o, n, first in _prepared(pdf, params, avail):
                    back, score = steps(part, o, n, first)
                    ends = np.stack([chains.trace(back, n, np.full(len(n), s))[1] for s in range(k)], axis=1).astype(float)
                    last = (part["block"] == part["n_blocks"] - 1).to_numpy()
                    # Of the last block, every state leads where its best one does.
                    ends[last] = ends[last, score[last].argmax(axis=1)][:, None]
                    yield part[[*KEY, "block", "n_blocks"]].assign(value=list(ends))

        long = _with(units.filter("n_blocks > 1"), carried)
        back = kept(long.mapInPandas(maps, "chunk_id long, i int, block long, n_blocks long, value array<double>"), "maps")
        # What leads from the end of the chunk to the end of a block: later blocks' maps come first.
        ends = scan.exclusive(_backwards(back), KEY, lambda a, b: np.take_along_axis(b, a.astype(np.int64), axis=1), fan, stacked=True)
        ends = back.select(*KEY, "block", (F.col("n_blocks") - 1 - F.col("block")).alias("at")).join(ends, [*KEY, "at"]).select(*KEY, "block", F.col("before").alias("ends"))
        given = _with(units, kept(carried.join(ends, [*KEY, "block"]), "entries"))

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, _, _, o, n, first in _prepared(pdf, params, avail):
                back, score = steps(part, o, n, first)
                end = np.array([s.argmax() if e is None else int(e[0]) for s, e in zip(score, part["ends"])])
                states, _ = chains.trace(back, n, end)
                yield from _rows(part, n, state=states.astype(np.int32))

    return given.mapInPandas(paths, "chunk_id long, i int, t long, state int")
