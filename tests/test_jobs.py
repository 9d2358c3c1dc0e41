import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatrack.functions.model import Tree, random_params, row_normalize
from silvatrack.functions.poisson import smallest_present, threshold
from silvatrack.functions.signal import gauss_kernel
from silvatrack.operators import convert, decode, emission, features, gaussian_init, relational, segment
from silvatrack.functions import kernels
from silvatrack.plans import convert_split, em, jobs
from silvatrack.sources import reads as sources
from silvatrack.sources import tables
from silvatrack.streaming import histogram as streaming


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


@pytest.fixture(scope="module")
def sizes(spark):
    return convert.select_chroms(spark.createDataFrame([("c1", 1050), ("c2", 700), ("tiny", 99), ("chrM", 5000)], "chrom string, length bigint"), 100)


def test_thresholds_against_direct_sums():
    for rate in (0.05, 0.11, 1.0, 3.7, 40.0):
        for level in (0.1, 1e-4):
            sf = lambda c: 1 - sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(c + 1))  # noqa: E731, B023
            assert smallest_present(rate, level) == next(c for c in range(200) if sf(c) < level)
    assert smallest_present(5000.0, 1e-12) > 5000 and smallest_present(0.0, 0.1) == 0


def test_thresholds_in_the_jvm_are_the_same(spark):
    rates = [0.0, 1e-9, 0.01, 0.05, 0.105, 0.11, 0.5, 1.0, 3.7, 17.0, 40.0, 333.3, 5000.0, 250_000.5]
    for level in (0.5, 0.1, 1e-4, 1e-12, 1e-40):
        df = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", threshold(F.col("rate"), level).alias("least"))
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.rate: r.least for r in df.collect()} == {r: smallest_present(r, level) for r in rates}


def test_runs_in_blocks(spark):
    rng = np.random.default_rng(8)
    kept = {c: sorted(int(b) for b in np.flatnonzero(rng.random(60) < p)) for c, p in (("c1", 0.5), ("c2", 0.93), ("c3", 1.0), ("c4", 0.1))}
    values = spark.createDataFrame([(c, b, 1.0 + (b in bins)) for c, bins in kept.items() for b in range(60)], "chrom string, bin long, s double")
    want = []
    for c, bins in kept.items():
        for b in bins:
            if b - 1 not in bins:
                want.append((c, b, next(e for e in range(b, 62) if e not in bins)))
    for block in (1, 2, 7, 20, 60, 1000):
        assert rows(segment.runs(values, 2.0, block=block), "chrom", "start", "end") == sorted(want)


def test_convert_and_split_jobs(spark, tmp_path):
    made = [(s, m, r, "c1", 100 * b + 3 * n, 0, 36, 0, 37) for s, m, r in (("A", "k4", 1), ("A", "k4", 2), ("A", "k9", 1), ("B b", "k4", 1), ("B b", "k9", 1), ("C", "k4", 1)) for b in (*range(3, 9), 15) for n in range(6)]
    df = spark.createDataFrame(made, sources.READS)
    df.withColumn("sample", F.concat_ws("_", "species", "mark", F.concat(F.lit("rep"), "rep"))).drop("species", "mark", "rep").write.partitionBy("sample").parquet(str(tmp_path / "in"))
    header = spark.createDataFrame([("c1", 2050), ("chrX", 900)], "chrom string, length bigint")
    how = {"template": "sample={species}_{mark}_rep{rep}/", "chrom_sizes": header, "window": 100, "level": 0.05}
    calls = convert_split.convert(spark, str(tmp_path / "in/*"), species=["B b", "A"], marks=["k9", "k4"], out=str(tmp_path / "set-1"), **how)
    assert {(r.i, r.l) for r in calls.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)} and {r.bin for r in calls.collect()} == {4, 5, 6, 7, 8, 9, 16}
    meta = spark.read.parquet(str(tmp_path / "set-1/meta")).first()
    assert (meta.window, meta.species, meta.marks) == (100, ["B b", "A"], ["k9", "k4"])
    with pytest.raises(ValueError, match="C/k9"):
        convert_split.convert(spark, str(tmp_path / "in/*"), species=["A", "C"], marks=["k4", "k9"], out=str(tmp_path / "no"), **how)
    chunks, inside = convert_split.split(spark, str(tmp_path / "set-*"), out=str(tmp_path / "split"), kernel=1, min_reads=2.0, min_size=3)
    assert rows(chunks, "start", "end") == [(4, 10)] and inside.count() == 24 and rows(inside.agg(F.max("t").alias("t")), "t") == [(5,)]
    convert_split.convert(spark, str(tmp_path / "in/*"), species=["A"], marks=["k4"], out=str(tmp_path / "set-2"), **how)
    assert tables.read_observations(spark, str(tmp_path / "set-*")).count() == calls.count() + 7
    with pytest.raises(FileNotFoundError):
        convert_split.split(spark, str(tmp_path / "none*"), out=str(tmp_path / "x"))


def test_reads_to_calls(spark, sizes):
    cols = sources.READS
    made = [
        ("s", "m", 1, "c1", 10, 0, 36, 0, 37), ("s", "m", 2, "c1", 5, 0, 36, 0, 37),  # bin 1, both replicates
        ("s", "m", 1, "c1", 1049, 0, 36, 0, 37),  # past the last full bin
        ("s", "m", 1, "c1", 100, 250, 36, 3, 37), ("s", "m", 1, "c1", 100, 250, 36, 1, 37),  # proper pair, improper pair
        ("s", "m", 1, "c1", 10, 0, 36, 4, 37), ("s", "m", 1, "c1", 10, 0, 36, 0, 0),  # unmapped, no quality
        ("s", "m", 1, "tiny", 10, 0, 36, 0, 37), ("s", "m", 1, "chrM", 10, 0, 36, 0, 37),
    ]
    df = spark.createDataFrame(made, cols)
    binned = convert.bin_reads(convert.pair_filter(convert.qc_filter(df)), sizes, 100)
    counts = convert.pool(binned)
    assert rows(counts, "chrom", "bin", "n") == [("c1", 1, 3), ("c1", 9, 1)]
    assert rows(convert.histogram(binned), "rep", "bin", "n") == [(1, 1, 2), (1, 9, 1), (2, 1, 1)]
    rate = convert.rates(counts, sizes).first()
    assert (rate.total, rate.total_bins, rate.rate) == (4, 10, 0.4)
    least = convert.thresholds(convert.rates(counts, sizes), 0.1)
    assert least.first().least == smallest_present(0.4, 0.1) == 1
    assert rows(convert.call(counts, least, sizes), "chrom", "bin") == [("c1", 1), ("c1", 9)]
    every = least.withColumn("least", F.lit(0).cast("long"))
    assert convert.call(counts, every, sizes).count() == 17
    assert convert.qc_filter(df, skip=True).count() == len(made)
    assert convert.select_chroms(spark.createDataFrame([("c1", 1050), ("chrX", 900)], "chrom string, length bigint"), 100, ["chrX"]).count() == 0


def test_smoothing_and_chunks(spark, sizes):
    rng = np.random.default_rng(0)
    dense = {"c1": rng.integers(0, 4, 10).astype(float), "c2": np.array([5, 5, 0, 0, 0, 6, 6.0])}
    values = spark.createDataFrame([(c, i, float(v)) for c, a in dense.items() for i, v in enumerate(a) if v], "chrom string, bin long, d double")
    kernel = np.array([v for _, v in gauss_kernel(3)])
    assert kernel.sum() == pytest.approx(1) and len(kernel) == 7
    want = sorted((c, i, round(v, 6)) for c, a in dense.items() for i, v in enumerate(np.convolve(a, kernel)[3:-3]) if v > 0)
    for got in (segment.smooth(values, sizes, 3), segment.smooth_blocks(values, sizes, 3, 4), segment.smooth_blocks(values, sizes, 3)):
        assert sorted((r.chrom, r.bin, round(r.s, 6)) for r in got.collect() if r.s > 0) == want
    found = segment.runs(values.withColumnRenamed("d", "s").filter("chrom = 'c2'"), 5.0)
    assert rows(found, "chrom", "start", "end") == [("c2", 0, 2), ("c2", 5, 7)]  # runs that touch either end
    assert segment.chunks(found, 3).count() == 0
    assert rows(segment.chunks(found, 2), "chunk_id", "number", "start", "end") == [(0, 0, 0, 2), (1, 1, 5, 7)]
    assert rows(segment.chunks(found, 2, legacy_edge=True), "start", "end") == [(0, 1), (4, 6)]
    assert rows(segment.split_long(segment.chunks(found, 2), 1), "start", "end") == [(0, 1), (1, 2), (5, 6), (6, 7)]
    cut = segment.cut(values.select("chrom", "bin"), segment.chunks(found, 2), span=2)
    assert rows(cut, "chunk_id", "bin", "t") == [(0, 0, 0), (0, 1, 1), (1, 5, 0), (1, 6, 1)]
    cover = segment.coverage(segment.chunks(found, 2), found, sizes).first()
    assert (cover.regions, cover.covered_bins, cover.total_bins) == (2, 4, 17)
    assert rows(segment.size_histogram(segment.chunks(found, 2)), "bar", "n") == [(0, 2)]
    assert rows(segment.trim(sizes, values.filter("chrom = 'c2'")), "chrom", "start", "end") == [("c2", 0, 7)]


def test_features(spark, sizes):
    counts = spark.createDataFrame([("s", "m", "c2", 1, 3), ("s", "m", "c2", 4, 1)], "species string, mark string, chrom string, bin long, n long")
    signal = features.scaled(counts)
    value = [0, np.arcsinh(3 / 4e-6), 0, 0, np.arcsinh(1 / 4e-6), 0, 0]
    got = {r.bin: r for r in features.gradient(signal, sizes).collect()}
    assert [got[i].g for i in range(7)] == pytest.approx(list(np.gradient(value)))
    assert [got[i].gg for i in range(7)] == pytest.approx(list(np.gradient(np.gradient(value))))


def test_sources(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\n@SQ\tSN:c1\tLN:1000\nr1\t0\tc1\t11\t37\t4M\t*\t0\t0\tACGT\tIIII\nr2\t3\tc1\t21\t9\t4M\t=\t101\t90\tACGT\tIIII\n")
    got, sizes = sources.read_sam(spark, str(tmp_path / "x.sam"), "s", "m", 2)
    assert rows(got, "species", "mark", "rep", "chrom", "pos", "mpos", "rlen", "flag", "mapq") == [("s", "m", 2, "c1", 10, 0, 4, 0, 37), ("s", "m", 2, "c1", 20, 100, 4, 3, 9)]
    assert rows(sizes, "chrom", "length") == [("c1", 1000)]
    for name in ("A_k4_rep1", "A_k9_rep1", "B_k4_rep2"):
        (tmp_path / f"{name}.csv").write_text("c1,5\n")
    (tmp_path / "other.csv").write_text("c1,5\n")
    samples = sources.discover_samples(spark, str(tmp_path / "*.csv"), "{species}_{mark}_rep{rep}", "csv", "chrom string, pos long")
    assert rows(samples, "species", "mark", "rep", "pos") == [("A", "k4", 1, 5), ("A", "k9", 1, 5), ("B", "k4", 2, 5)]
    species, marks = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("species", "AB"), ("mark", ["k4", "k9"])))
    assert rows(sources.missing_samples(samples, species, marks), "species", "mark") == [("B", "k9")]
    with pytest.raises(ValueError, match="B/k9"):
        sources.require_samples(samples, species, marks)
    assert sources.require_samples(samples, species.filter("species = 'A'"), marks) is samples
    spark.createDataFrame([("s", "m", 1, "c", 1, 2, 3, 4, 5)], sources.READS).write.parquet(str(tmp_path / "r"))
    assert sources.read_reads(spark, str(tmp_path / "r")).count() == 1


def test_tables(spark, tmp_path):
    calls = spark.createDataFrame([(0, 1, "c1", 5), (2, 0, "c1", 7), (1, 0, "c2", 900)], "i int, l int, chrom string, bin long")
    meta = spark.createDataFrame([(100,)], "window int")
    for part in ("one", "two"):
        tables.write_observations(calls, meta, str(tmp_path / part))
    assert tables.read_observations(spark, str(tmp_path / "o*"), str(tmp_path / "two")).count() == 6
    with pytest.raises(FileNotFoundError):
        tables.read_observations(spark, str(tmp_path / "none*"))
    assert rows(tables.restrict(calls, 100, 2), "i", "bin") == [(0, 5)]
    params = random_params(2, 3, 1)
    for n in (0, 1):
        tables.save_params(spark, params if n else {**params, "gamma": params["gamma"] * 0}, str(tmp_path / "p"), "run", n)
    back = tables.load_params(spark, str(tmp_path / "p"), "run")
    assert all(np.array_equal(back[k], v) for k, v in params.items())
    assert tables.load_params(spark, str(tmp_path / "p"), "run", 0)["gamma"].sum() == 0
    assert tables.load_params(spark, str(tmp_path / "p"), "run", children=3)["theta"].shape == (3, 2, 2, 2)
    with pytest.raises(FileNotFoundError):
        tables.load_params(spark, str(tmp_path / "p"), "other")
    q = spark.createDataFrame([("c1", 1, 0, [0.5, 0.5]), ("c1", 0, 0, [0.2, 0.8])], "chrom string, bin long, i int, q array<double>")
    for level, kept in ((0, 0), (1, 1), (2, 3), (3, 3)):
        path = str(tmp_path / f"q{level}")
        stitched = [tables.save_posteriors(q, path, level, n, n == 2) for n in range(3)][-1]
        assert len(list((tmp_path / f"q{level}").glob("iter=*"))) == kept
        assert (stitched is not None) == (level == 3)
    assert [r["bin"] for r in stitched.collect()] == [0, 1]
    bed = decode.bed(q, spark.createDataFrame([(0, "A")], "i int, species string"), 100)
    assert rows(bed, "start", "end", "name", "score") == [(0, 100, "A.state1", 0.8), (100, 200, "A.state0", 0.5)]  # a tie: the lowest
    tables.write_bed(bed, str(tmp_path / "bed"))
    assert rows(tables.read_bed(spark, str(tmp_path / "bed")), "name", "score") == rows(bed, "name", "score")
    assert decode.bed_probabilities(q, spark.createDataFrame([(0, "A")], "i int, species string"), 100).count() == 4


def test_one_chromosome_is_written_by_many_tasks(spark, tmp_path):
    n = 3000
    q = spark.range(n).select(F.lit("c1").alias("chrom"), F.pmod(F.col("id") * 7, F.lit(n)).alias("bin"), F.lit(0).alias("i"), F.array(F.lit(0.9), F.lit(0.1)).alias("q"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stitched = tables.save_posteriors(q, str(tmp_path / "q"), 3, 0, True)
        held = stitched.withColumn("task", F.spark_partition_id()).collect()
        bed = decode.bed(q, spark.createDataFrame([(0, "A")], "i int, species string"), 100)
        tables.write_bed(bed, str(tmp_path / "bed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["bin"] for r in held] == list(range(n))
    assert max(Counter(r["task"] for r in held).values()) < n / 2
    files = [[int(line.split("\t")[1]) for line in f.read_text().splitlines()] for f in (tmp_path / "bed").rglob("part-*")]
    assert len(files) > 1 and all(f == sorted(f) for f in files) and sum(map(len, files)) == n


def test_gaussian_start(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>")
    centres = gaussian_init.spread_centres(df, 3, seed=2)
    assert sorted(int(round(c[0] / 4.5)) for c in centres) == [0, 1, 2]
    assert centres == gaussian_init.spread_centres(df.repartition(3), 3, seed=2)
    assert {r.variance for r in gaussian_init.cluster_variances(df, centres).collect()} == {0.1}
    one = spark.createDataFrame([(0, [1.0]), (1, [float("nan")])], "id long, x array<double>")
    ll = {r.id: r.ll for r in emission.gaussian(one, spark.createDataFrame([(0, [0.0], [2.0])], "k int, mean array<double>, variance array<double>")).collect()}
    assert ll[0] == pytest.approx(-0.5 * (math.log(4 * math.pi) + 0.5)) and ll[1] == -100.0


def centres_by_hand(held, k, passes, per_pass, seed):
    """The same choice in plain Python: held is {id: x}."""
    far = lambda x, c: sum(abs(a - b) for a, b in zip(x, c))
    u = gaussian_init.draw_of
    chosen = [min(held, key=lambda i: (u(i, 0, seed), i))]
    for n in range(1, passes + 1):
        d = {i: min(far(x, held[c]) for c in chosen) for i, x in held.items()}
        chosen += sorted((i for i in held if d[i] > 0), key=lambda i: (-math.log(u(i, n, seed)) / d[i] ** 2, i))[:per_pass]
    chosen.sort()
    weights = dict.fromkeys(chosen, 0)
    for x in held.values():
        weights[min(chosen, key=lambda c: (far(x, held[c]), c))] += 1
    out = []
    for n in range(k):
        chance = {c: weights[c] * (min(far(held[c], held[o]) for o in out) ** 2 if out else 1) for c in chosen}
        out.append(min((c for c in chosen if chance[c] > 0), key=lambda c: (-math.log(u(c, 1000 + n, seed)) / chance[c], c)))
    return [(c, weights[c]) for c in out]


def test_centres_take_few_passes_and_do_not_depend_on_tasks(spark):
    rng = np.random.default_rng(5)
    blobs = np.array([[0.0, 0, 0], [50, 0, 9], [0, 80, -7], [90, 90, 40]])
    held = {i: [round(float(v), 3) for v in blobs[i % 4] + rng.normal(0, 1, 3)] for i in range(400)}
    held[400] = held[7]  # the same place again
    df = spark.createDataFrame(list(held.items()), "id long, x array<double>")
    for seed in range(3):
        got = gaussian_init.weighed_centres(df.repartition(5), 4, seed, passes=3, per_pass=5)
        assert [(i, w) for i, w, _ in got] == centres_by_hand(held, 4, 3, 5, seed)
        assert got == gaussian_init.weighed_centres(df.coalesce(1), 4, seed, passes=3, per_pass=5)
        found = gaussian_init.spread_centres(df, 4, seed)
        assert {int(np.abs(blobs - c).sum(axis=1).argmin()) for c in found} == {0, 1, 2, 3}  # one in each
    start = gaussian_init.gaussian_start(df, 4)
    assert start["means"].shape == start["variances"].shape == (4, 3) and start["variances"].max() < 2.5
    near = {(r.k, r.l): r.variance for r in gaussian_init.cluster_variances(df, start["means"].tolist()).collect()}
    assert all(start["variances"][k, l] == pytest.approx(v) for (k, l), v in near.items())
    same = spark.createDataFrame([(i, [1.0]) for i in range(9)], "id long, x array<double>")
    assert gaussian_init.spread_centres(same, 3) == [[1.0]] * 3 and gaussian_init.spread_centres(same.limit(0), 3) == []
    assert (gaussian_init.gaussian_start(same, 3)["variances"] == 0.1).all()
    with pytest.raises(ValueError):
        gaussian_init.gaussian_start(same.limit(0), 2)


@pytest.fixture(scope="module")
def signal(spark):
    """Chunks of continuous signal of three states, far from 0 and of unlike scale."""
    tree = Tree(["a", "b"], {"b": "a"})
    rng = np.random.default_rng(2)
    means, rows, chunks = np.array([[100.0, 5.0], [140.0, 5.0], [140.0, 60.0]]), [], []
    for c in range(6):
        n = int(rng.integers(30, 60))
        chunks.append((c, "c1", c * 100, c * 100 + n))
        z = np.cumsum(rng.random(n) < 0.15) % 3
        rows += [(c, t, i, l, float(means[z[t], l] + rng.normal(0, 2.0))) for t in range(n) for i in range(2) for l in range(2)]
    packed = em.pack(spark.createDataFrame(rows, "chunk_id long, t long, i int, l int, value double"), spark.createDataFrame(chunks, "chunk_id long, chrom string, start long, end long"), "value").persist()
    return packed, tree, means


def test_gaussian_fits_start_from_the_data(signal, monkeypatch):
    packed, tree, means = signal
    avail = np.ones((2, 2))
    seen = {r["id"]: r["x"] for r in em.observations(packed, (2, 2)).collect()}
    assert len(seen) == 2 * packed.agg(F.sum("n")).first()[0]
    with monkeypatch.context() as m:
        m.setattr(em, "OBSERVED", 7)
        assert {r["id"]: r["x"] for r in em.observations(packed, (2, 2)).collect()} == seen
    fitted, path = em.fit(packed, "poc", tree, avail, 3, iterations=3, gaussian=True)
    _, by_chance = em.fit(packed, "poc", tree, avail, 3, iterations=3, gaussian=True, start=random_params(3, 2, 0, means=True))
    assert len(path) == 3 and path[-1] < by_chance[-1] - 100
    assert max(np.abs(fitted["means"] - m).sum(axis=1).min() for m in means) < 2  # a state for each


@pytest.fixture(scope="module")
def tracks(spark):
    """Chunks sampled from known parameters."""
    tree = Tree(["a", "b", "c"], {"b": "a", "c": "a"})
    rng = np.random.default_rng(7)
    true = {"gamma": np.array([0.5, 0.5]), "alpha": np.array([[0.9, 0.1], [0.1, 0.9]]), "beta": np.array([[0.9, 0.1], [0.1, 0.9]]), "emit": np.array([[0.9, 0.8, 0.1], [0.1, 0.2, 0.9]])}
    true["theta"] = row_normalize(np.einsum("vk,hk->vhk", true["beta"], true["alpha"]))
    cells, chunks = [], []
    for c in range(12):
        n, z = int(rng.integers(10, 60)), {}
        chunks.append((c, "c1", c * 100, c * 100 + n))
        for t in range(n):
            for i, p in enumerate(tree.parent):
                w = (true["gamma"] if t == 0 else true["alpha"][z[i, t - 1]]) if p is None else (true["beta"][z[p, t]] if t == 0 else true["theta"][z[p, t], z[i, t - 1]])
                z[i, t] = int(rng.choice(2, p=w))
                cells += [(c, t, i, l) for l in range(3) if rng.random() < true["emit"][z[i, t], l]]
    packed = em.pack(spark.createDataFrame(cells, "chunk_id long, t long, i int, l int"), spark.createDataFrame(chunks, "chunk_id long, chrom string, start long, end long"))
    return packed.persist(), tree, true


@pytest.mark.parametrize("mode", ["poc", "indep", "clique", "mf", "loopy"])
def test_em_recovers_and_does_not_depend_on_tasks(tracks, mode):
    packed, tree, true = tracks
    avail = np.ones((3, 3))
    params = random_params(2, 3, 3)
    one, many = (em.expectation(em.balanced(packed, n), mode, params, tree, avail) for n in (1, 7))
    assert one[1] == pytest.approx(many[1]) and all(np.allclose(one[0][n], many[0][n]) for n in one[0])
    seen = []
    start = {**params, "emit": np.array([[0.6, 0.6, 0.4], [0.4, 0.4, 0.6]]), "alpha": true["alpha"], "beta": true["beta"], "theta": true["theta"]}
    fitted, path = em.fit(packed, mode, tree, avail, 2, iterations=8, start=start, on_step=lambda n, p, v: seen.append(n))
    assert seen == list(range(len(path))) and path[-1] < path[0]
    assert np.abs(fitted["emit"] - true["emit"]).max() < 0.15
    if mode == "clique":
        assert all(b <= a + 1e-6 for a, b in zip(path, path[1:]))


def test_gaussian_em_recovers_the_means(spark):
    tree = Tree(["a", "b"], {"b": "a"})
    rng = np.random.default_rng(11)
    means, rows, chunks = np.array([[1000.0, -2.0], [1006.0, 3.0]]), [], []  # far from 0: variances must keep their digits
    for c in range(8):
        n = int(rng.integers(30, 80))
        chunks.append((c, "c1", c * 100, c * 100 + n))
        z = np.cumsum(rng.random(n) < 0.1) % 2
        rows += [(c, t, i, l, float(means[z[t], l] + rng.normal(0, 0.5))) for t in range(n) for i in range(2) for l in range(2)]
    packed = em.pack(spark.createDataFrame(rows, "chunk_id long, t long, i int, l int, value double"), spark.createDataFrame(chunks, "chunk_id long, chrom string, start long, end long"), "value").persist()
    start = {**random_params(2, 2, 3, means=True), "means": means + [[1.0, 1.0], [-1.0, -1.0]], "variances": np.full((2, 2), 4.0)}
    for mode in ("mf", "poc", "indep", "clique"):
        fitted, path = em.fit(em.balanced(packed), mode, tree, np.ones((2, 2)), 2, iterations=12, start=start, gaussian=True)
        assert path[-1] < path[0] and np.abs(fitted["means"] - means).max() < 0.2
        assert np.abs(fitted["variances"] - 0.25).max() < 0.06
    with_random, path = em.fit(packed, "indep", tree, np.ones((2, 2)), 2, iterations=2, gaussian=True)
    assert set(with_random) == {"gamma", "alpha", "beta", "theta", "means", "variances"} and np.isfinite(path).all()


def test_a_leaf_given_its_parent_is_its_chain_in_the_product(spark, tracks):
    """One more update of a leaf's chain changes nothing once the chains have settled."""
    packed, tree, true = tracks
    avail = np.ones((3, 3))
    q = em.posteriors(packed, "poc", true, tree, avail, most=200, epsilon=0.0).persist()
    want = {(r.chunk_id, r.t): r.q for r in q.filter("i = 2").collect()}
    got = em.leaf_posteriors(packed, q, 2, true, tree, avail).collect()
    assert len(got) == len(want) and all(np.allclose(r.q, want[r.chunk_id, r.t], atol=1e-6) for r in got)


def test_infer_keeps_and_resumes(spark, tracks, tmp_path):
    packed, tree, _ = tracks
    chunks, out = packed.select("chunk_id", "chrom", "start"), str(tmp_path / "fit")
    first, stitched = jobs.infer(packed, chunks, "indep", tree, np.ones((3, 3)), 2, out, "one", iterations=2, epsilon=0.0)
    assert stitched is None and all(np.array_equal(tables.load_params(spark, f"{out}/params", "one")[n], v) for n, v in first.items())
    more, stitched = jobs.infer(packed, chunks, "indep", tree, np.ones((3, 3)), 2, out, "two", resume="one", save_q=3, iterations=2, epsilon=0.0)
    whole, _ = em.fit(packed, "indep", tree, np.ones((3, 3)), 2, iterations=4, epsilon=0.0)
    assert all(np.allclose(more[n], whole[n]) for n in more)
    assert stitched.count() == 3 * packed.agg(F.sum("n")).first()[0]
    gains = [r.gain for r in jobs.progress(spark, out).orderBy("step").collect()]
    assert len(gains) == 4 and all(b >= a for a, b in zip(gains, gains[1:]))


def test_long_chunks_in_blocks(monkeypatch):
    """Blocks of transitions change nothing."""
    rng = np.random.default_rng(0)
    tree, params = Tree(["a", "b", "c"], {"a": "b", "c": "b"}), random_params(3, 2, 1)
    x = rng.integers(0, 2, (3, 41, 2)).astype(np.int8)
    for mode in ("mf", "poc", "indep", "clique"):
        one = kernels.MODES[mode](x, np.ones((3, 2)), params, tree)
        monkeypatch.setattr(kernels, "BLOCK", 7)
        two = kernels.MODES[mode](x, np.ones((3, 2)), params, tree)
        monkeypatch.undo()
        assert np.allclose(one[0], two[0]) and one[2] == pytest.approx(two[2]) and all(np.allclose(one[1][n], two[1][n]) for n in one[1])


def test_modes_side_by_side(tracks):
    packed, tree, true = tracks
    got = {m: v for m, _, v in em.compare(packed, tree, np.ones((3, 3)), true, ["clique", "poc", "mf", "indep"], most=20)}
    assert got["clique"] <= got["poc"] + 1e-6 and got["clique"] <= got["mf"] + 1e-6
    assert {k for k, _, _ in em.sweep(packed, "indep", tree, np.ones((3, 3)), [2, 3], iterations=2)} == {2, 3}
    q = em.posteriors(packed, "viterbi", true, tree, np.ones((3, 3)))
    assert q.filter(F.array_max("q") != 1).count() == 0 and q.count() == 3 * packed.agg(F.sum("n")).first()[0]
    separate, _ = em.fit(packed, "poc", tree, np.ones((3, 3)), 2, iterations=2, separate_theta=True)
    assert separate["theta"].shape == (2, 2, 2, 2) and np.allclose(separate["theta"].sum(axis=-1), 1)


def test_statistics_and_reports(spark):
    table = spark.createDataFrame([("theta", [v, h, k], float(1 + v + 2 * h + k)) for v in range(2) for h in range(2) for k in range(2)] + [("gamma", [k], 1.0 + k) for k in range(2)], "name string, idx array<int>, value double")
    got = relational.normalize_table(table)
    assert {r.value for r in got.groupBy("name", F.slice("idx", 1, F.size("idx") - 1)).agg(F.round(F.sum("value"), 9).alias("value")).collect()} == {1.0}
    cut = decode.slice_report(table, "theta", 0, 1, 2)
    assert rows(cut, "from", "state0", "state1") == [(0, 2.0, 3.0), (1, 4.0, 5.0)]
    energy = spark.createDataFrame([("r1", 0, 9.0, "free_energy"), ("r1", 1, 8.0, "free_energy"), ("r2", 0, -7.0, "loglik")], "run_id string, iter int, objective double, kind string")
    assert rows(decode.trajectory(energy), "step", "gain") == [(0, -9.0), (1, -8.0), (2, -7.0)]


def test_stream_counts_like_a_batch(spark, sizes, tmp_path):
    made = [("s", "m", 1, "c1", p, 0, 36, 0, 37) for p in (1, 50, 120, 130, 900)]
    for n in (0, 1):
        spark.createDataFrame(made[n::2], sources.READS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sources.READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.stream_counts(stream, sizes, 100).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    binned = convert.bin_reads(stream, sizes, 100)
    sink = binned.writeStream.foreachBatch(streaming.add_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    sink.processAllAvailable()
    sink.stop()
    want = rows(convert.pool(convert.bin_reads(spark.createDataFrame(made, sources.READS), sizes, 100)), "chrom", "bin", "n")
    assert rows(spark.table("counts"), "chrom", "bin", "n") == want
    assert rows(streaming.total(spark.read.parquet(str(tmp_path / "out"))), "chrom", "bin", "n") == want


def test_posteriors_of_many_chromosomes_are_few_files(spark, tmp_path):
    """An iteration is a file for each task, sorted, not one for each task and chromosome."""
    q = spark.range(2000).select(F.concat(F.lit("c"), F.pmod(F.col("id") * 7, F.lit(400))).alias("chrom"), F.expr("id div 400").alias("bin"), F.lit(0).alias("i"), F.array(F.lit(0.9), F.lit(0.1)).alias("q")).repartition(3)
    path = str(tmp_path / "q")
    for n in (0, 1):
        tables.save_posteriors(q, path, 3, n, n == 1)
    files = list((tmp_path / "q").rglob("part-*.parquet"))
    assert 2 <= len(files) <= 6 and {f.parent.name for f in files} == {"iter=0", "iter=1"}
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.filter("iter = 1").select("chrom", "bin").collect())) == sorted(map(tuple, q.select("chrom", "bin").collect()))
    for f in files:
        held = [(r["chrom"], r["i"], r["bin"]) for r in spark.read.parquet(str(f)).collect()]
        assert held == sorted(held)


def test_emissions_from_posteriors_of_cells(spark):
    """A row for each cell meets the calls, without a broadcast, however few rows the posteriors are made from."""
    marks, k = 3, 3
    q = spark.createDataFrame([("c1", 0, 40), ("c2", 7, 19)], "chrom string, start long, end long").select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("bin"))
    q = q.select("chrom", "bin", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    q = q.withColumn("q", F.array(*[((1 + (F.col("bin") * 3 + F.col("i") + s * 5) % 7) / 21.0).cast("double") for s in range(k)]))
    calls = q.select("i", F.expr("explode(sequence(0, 1))").alias("l"), "chrom", "bin").filter("(bin + l + i) % 3 = 0").unionAll(spark.createDataFrame([(0, 2, "c3", 5)], "i int, l int, chrom string, bin long"))
    avail = spark.createDataFrame([(i, l) for i in range(2) for l in range(marks) if (i, l) != (1, 0)], "i int, l int")
    got = emission.normalize(q, calls, avail, 1e-6, k)
    held = {(r["chrom"], r["bin"], r["i"]): r["q"] for r in q.collect()}
    seen = [tuple(r) for r in calls.select("i", "l", "chrom", "bin").collect() if (r["i"], r["l"]) != (1, 0)]
    want = {}
    for l in range(marks):
        for s in range(k):
            total = sum(v[s] for (_, _, i), v in held.items() if (i, l) != (1, 0))
            present = sum(held[c, b, i][s] for i, m, c, b in seen if m == l and (c, b, i) in held)
            want[s, l] = (present + 1e-6) / (total + 2e-6)
    assert got.columns == ["k", "l", "e"] and {(r["k"], r["l"]): pytest.approx(r["e"], abs=1e-12) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [chrom" in plan and "BroadcastHashJoin [chrom" not in plan
