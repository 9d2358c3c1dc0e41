"""A scan: of values in order within a key, what an associative operation makes of all before each one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Values that one group combines.
FAN = 256
#: Values that a task combines, about, where there are partitions enough.
TASK_VALUES = 4096

Op = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _each(op: Op) -> Op:
    """op of two values, on object arrays of values."""

    def many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _objects([op(x, y) for x, y in zip(a, b)])

    return many


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = [None if v is None else np.asarray(v) for v in values]
    return out


def _held(values: pd.Series, stacked: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there): as rows of an array if stacked, else as objects."""
    there = values.notna().to_numpy()
    if not stacked:
        return _objects(list(values)), there
    out = np.zeros((len(values), size))
    if there.any():
        out[there] = np.stack(list(values[there]))
    return out, there


def _fold(values: np.ndarray, first: np.ndarray, held: np.ndarray, there: np.ndarray, op: Op) -> tuple[np.ndarray, np.ndarray]:
    """(before, known) of each of values, which begin new groups at first, held and there being what the groups begin with: they are
    changed to what the groups come to. All groups go on by a value at a time."""
    length = np.diff(first, append=len(values))
    before, known = np.empty_like(values), np.zeros(len(values), dtype=bool)
    for s in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > s)
        at = first[live] + s
        now, have = held[live], there[live]
        before[at], known[at] = now, have
        new = values[at]
        if have.any():
            new[have] = op(now[have], new[have])
        held[live], there[live] = new, True
    return before, known


def _groups(batches: Iterator[pd.DataFrame], names: list[str], op: Op, stacked: bool) -> Iterator[tuple]:
    """(pdf, before, known, first, held, open) of each batch of rows in order of names, which tell groups apart, and place. held is what the
    groups that begin at first come to; open is whether the first group goes on from the batch before."""
    last, carried = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.ones(len(pdf), dtype=bool)
        new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in names])
        first = np.flatnonzero(new)
        values, _ = _held(pdf["value"], stacked, len(pdf["value"].iloc[0]))
        start = pdf["before"].iloc[first] if "before" in pdf.columns else pd.Series([None] * len(first), dtype=object)
        held, there = _held(start, stacked, len(pdf["value"].iloc[0]))
        goes_on = tuple(pdf[c].iloc[0] for c in names) == last
        if goes_on:
            held[0], there[0] = carried, True
        before, known = _fold(values, first, held, there, op)
        last, carried = tuple(pdf[c].iloc[-1] for c in names), held[-1]
        yield pdf, before, known, first, held, goes_on


def exclusive(table: DataFrame, key: list[str], op: Op, fan: int = FAN, stacked: bool = False) -> DataFrame:
    """(key, at, before): table is (key, at, value), at counting from 0 within a key and value an array of doubles; before is op of all
    values at smaller places in order, null for the first. Groups of fan values are combined on their own, their results in the same
    way, and so on: no group is larger, and a table of any length takes a few passes. A task goes over all its groups together, a batch
    of rows at a time. stacked: values are of one length, and op takes stacks of them (n, length)."""
    types, spark = dict(table.dtypes), table.sparkSession
    keys, names = ", ".join(f"{k} {types[k]}" for k in key), [*key, "group"]
    many = op if stacked else _each(op)
    last, count = table.agg(F.max("at"), F.count(F.lit(1))).first()
    tasks = max(1, min(math.ceil(count / TASK_VALUES), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf, _, _, first, held, goes_on in _groups(batches, names, many, stacked):
            rows = pdf[[*names, "at"]].iloc[first].assign(value=list(held), n=np.diff(first, append=len(pdf)))
            if goes_on:
                rows.iloc[0, rows.columns.get_loc("n")] += rest["n"].iloc[0]
            elif rest is not None:
                yield wanted(rest)
            yield wanted(rows.iloc[:-1])
            rest = rows.iloc[-1:]
        if rest is not None:
            yield wanted(rest)

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        """Without the keys of one group that is not full, which nothing comes after."""
        rows = rows[(rows["group"] > 0) | (rows["n"] >= fan)]
        return rows[[*key, "group", "value"]].rename(columns={"group": "at"})

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, before, known, *_ in _groups(batches, names, many, stacked):
            yield pdf[[*key, "at"]].assign(before=[v if k else None for v, k in zip(before, known)])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, *names).sortWithinPartitions(*names, "at")

    carried = table.withColumn("group", F.expr(f"at div {fan}"))
    if (last or 0) >= fan:
        sums = kept(dealt(carried).mapInPandas(totals, f"{keys}, at long, value array<double>"), "totals")
        carried = carried.join(exclusive(sums, key, op, fan, stacked).withColumnRenamed("at", "group"), names, "left")
    return kept(dealt(carried).mapInPandas(inside, f"{keys}, at long, before array<double>"), "scan")
