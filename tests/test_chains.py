"""Chains in blocks against the same chains in one piece."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvatrack.functions import chains as C
from silvatrack.functions import kernels
from silvatrack.functions.model import Tree, log, random_params
from silvatrack.operators import scan
from silvatrack.plans import chains, em

SPECIES, MARKS, K = 3, 2, 3


def made(spark, sizes, seed=0, values=False):
    """(cut calls, chunks) with some calls of every second cell or so."""
    rng = np.random.default_rng(seed)
    name = ", value double" if values else ""
    cells = [(c, t, i, l, *([float(rng.normal(i + 4 * ((t // 5) % 2), 1))] if values else [])) for c, n in enumerate(sizes) for t in range(n) for i in range(SPECIES) for l in range(MARKS) if rng.random() < 0.5 and c != 1]
    chunks = [(c, "c1", 10_000 * c, 10_000 * c + n) for c, n in enumerate(sizes)]
    return spark.createDataFrame(cells, f"chunk_id long, t long, i int, l int{name}"), spark.createDataFrame(chunks, "chunk_id long, chrom string, start long, end long")


def params_of(values, seed=1):
    params = random_params(K, MARKS, seed, means=values)
    return params | {"means": np.array([[0.0, 0], [2, 2], [5, 5]])} if values else params


@pytest.mark.parametrize("block, values", [(1, False), (7, True), (4096, False)])
def test_blocks_change_nothing(spark, block, values):
    cut, found = made(spark, [1, 2, 7, 40, 23], values=values)
    tree, params = Tree(list("abc"), {"b": "a"}), params_of(values)
    avail = np.array([[1.0, 1], [1, 0], [1, 1]])
    value = "value" if values else None
    packed, units = em.pack(cut, found, value).persist(), chains.pack_units(cut, found, SPECIES, block, value).persist()
    assert units.agg(F.sum("n")).first()[0] == SPECIES * 73
    want = {(r.chunk_id, r.i, r.t): r.q for r in em.posteriors(packed, "indep", params, tree, avail).collect()}
    got = {(r.chunk_id, r.i, r.t): r.q for r in chains.posteriors(em.balanced(units, 5), params, avail, fan=2).collect()}
    assert set(got) == set(want) and all(np.allclose(got[n], want[n], atol=1e-9) for n in want)
    stats, total = em.expectation(packed, "indep", params, tree, avail)
    mine, value = em.expectation(units, "indep", params, tree, avail)
    assert value == pytest.approx(total, abs=1e-7) and all(np.allclose(mine[n], stats[n], atol=1e-8) for n in stats)
    each = {r.chunk_id: r.objective for r in em.objectives(packed, "indep", params, tree, avail).collect()}
    assert {r.chunk_id: pytest.approx(r.objective, abs=1e-8) for r in em.objectives(units, "indep", params, tree, avail).collect()} == each
    path = {(r.chunk_id, r.i, r.t): list(r.q).index(1) for r in em.posteriors(packed, "viterbi_chain", params, tree, avail).collect()}
    assert {(r.chunk_id, r.i, r.t): r.state for r in chains.best_paths(units, params, avail, fan=2).collect()} == path
    one_hot = em.posteriors(units, "viterbi_chain", params, tree, avail)
    assert {(r.chunk_id, r.i, r.t): list(r.q).index(1) for r in one_hot.collect()} == path


def test_a_fit_is_the_same_in_blocks(spark):
    cut, found = made(spark, [30, 12, 51], seed=3)
    tree, avail = Tree(list("abc"), {}), np.ones((SPECIES, MARKS))
    whole, path = em.fit(em.pack(cut, found).persist(), "indep", tree, avail, 2, iterations=3, epsilon=0.0)
    blocks, mine = em.fit(em.balanced(chains.pack_units(cut, found, SPECIES, 8)).persist(), "indep", tree, avail, 2, iterations=3, epsilon=0.0)
    assert mine == pytest.approx(path) and all(np.allclose(blocks[n], whole[n]) for n in whole)
    with pytest.raises(ValueError, match="all species"):
        em.expectation(chains.pack_units(cut, found, SPECIES), "poc", whole, tree, avail)


def test_one_long_chunk_is_many_tasks(spark):
    """A chunk of 60,000 bins: 30 blocks for each species, dealt to all tasks, with the sequential result."""
    n = 60_000
    cut = spark.range(n).selectExpr("0L AS chunk_id", "id AS t", "explode(sequence(0, 1)) AS i", "0 AS l").filter("pmod(xxhash64(t, i), 3) = 0 OR t div 1000 % 2 = 0")
    found = spark.createDataFrame([(0, "c1", 0, n)], "chunk_id long, chrom string, start long, end long")
    units = em.balanced(chains.pack_units(cut, found, 2, 2000)).persist()
    assert units.count() == 60 and units.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 4
    params, avail, tree = random_params(2, 1, 5), np.ones((2, 1)), Tree(["a", "b"], {})
    x = np.zeros((2, n, 1), dtype=np.int8)
    for r in cut.collect():
        x[r.i, r.t, r.l] = 1
    want = kernels.independent(x, avail, params, tree)
    stats, value = chains.expectation(units, params, avail)
    assert value == pytest.approx(want[2], rel=1e-10) and all(np.allclose(stats[s], want[1][s], rtol=1e-8, atol=1e-6) for s in want[1])
    states = kernels.viterbi(x, avail, params, tree, False)
    paths = chains.best_paths(units, params, avail).groupBy("i").agg(F.sum("state").alias("s"), F.sum(F.col("state") * (F.col("t") % 97)).alias("w")).collect()
    assert {r.i: (r.s, r.w) for r in paths} == {i: (int(states[i].sum()), int((states[i] * (np.arange(n) % 97)).sum())) for i in range(2)}


def test_a_state_that_loses_for_long_can_still_win():
    """Tables keep a scale for each row, so that a block does not forget states it makes unlikely."""
    o = np.zeros((1, 600, 2))
    o[0, :300, 1], o[0, 300:, 0] = -5.0, -10.0
    params = {"gamma": np.array([0.5, 0.5]), "alpha": np.array([[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]])}
    whole = kernels.Chain(log(params["gamma"]), log(params["alpha"]), o[0])
    tables = [C.block_tables(o[:, lo : lo + 100], np.array([100]), np.array([lo == 0]), params)[0] for lo in range(0, 600, 100)]
    before = tables[0]
    for t in tables[1:]:
        before = C.log_product(before, t)
    top = before[0].max()
    assert top + np.log(np.exp(before[0] - top).sum()) == pytest.approx(whole.value, rel=1e-12)


def test_scan_of_any_operation(spark):
    words = {k: [float(v) for v in np.random.default_rng(k).integers(0, 9, n)] for k, n in ((1, 1), (2, 50), (3, 7))}
    table = spark.createDataFrame([(k, f"s{k}", i, [v]) for k, vs in words.items() for i, v in enumerate(vs)], "a long, b string, at long, value array<double>")
    got = scan.exclusive(table, ["a", "b"], lambda a, b: np.concatenate([a, b]), fan=3).collect()  # joining keeps the order visible
    assert all((list(r.before) if r.before is not None else []) == words[r.a][: r.at] and r.b == f"s{r.a}" for r in got)
    assert len(got) == 58


def test_a_scan_goes_over_all_short_keys_together(spark):
    """Thousands of keys of a few values: the operation is called for stacks of them, not for each; groups may go on in the next batch."""
    calls = spark.sparkContext.accumulator(0)

    def add(a, b):
        assert a.shape == b.shape and a.shape[1] == 2
        calls.add(1)
        return a + b

    table = spark.range(12_000).selectExpr("id div 4 AS c", "id % 4 AS at", "array(CAST(id AS double), 1D) AS value")
    table = table.unionByName(spark.range(700).selectExpr("-1L AS c", "id AS at", "array(CAST(id AS double), 1D) AS value"))
    for rows, upto in (("10000", 3000), ("7", 90)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = scan.exclusive(table.filter(F.col("c") < upto), ["c"], add, fan=4, stacked=True).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        if rows == "10000":
            assert 0 < calls.value < 400
        assert len(got) == 700 + 4 * upto
        for r in got:
            before = range(r["at"]) if r["c"] < 0 else range(4 * r["c"], 4 * r["c"] + r["at"])
            assert (r["before"] is None) == (r["at"] == 0) and list(r["before"] or [0, 0]) == [sum(before), len(before)]


def test_short_blocks_become_rows_together():
    n = np.array([3] * 5000 + [2] * 1000)
    part = pd.DataFrame({"chunk_id": np.arange(len(n)), "i": 1, "first": 7, "n": n})
    frames = list(chains._rows(part, n, state=np.arange(len(n))[:, None] * 10 + np.arange(3)))
    assert len(frames) == 2
    rows = pd.concat(frames)
    assert len(rows) == n.sum() and (rows["state"] == rows["chunk_id"] * 10 + rows["t"] - 7).all() and rows.groupby("chunk_id").size().tolist() == n.tolist()


def test_a_product_of_stacks_is_that_of_each():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 200, (2, 9, 4, 4))
    got = C.log_product(a, b)
    want = np.logaddexp.reduce(a[:, :, :, None] + b[:, None, :, :], axis=2)
    assert np.allclose(got, want, rtol=1e-13) and np.allclose(C.log_product(a[0], b[0]), got[0])
