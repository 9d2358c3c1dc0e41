"""A query for each job, over the tables of a folder; doubles are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Tree, row_normalize
from ..operators import convert, decode, emission, features, gaussian_init, relational, segment
from ..sources import reads as sources
from ..sources import tables
from . import chains, convert_split, em, jobs
from . import fixtures as fx
from . import relational_em
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(f: Callable[[fx.Data], DataFrame]) -> Callable[[fx.Data], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fx.Data(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _states(df: DataFrame, value: str = "q") -> DataFrame:
    return df.select(*[c for c in df.columns if c != "q"], F.posexplode("q").alias("k", value))


@register
def a1_reads(d):
    return d.reads


def _sample_files(d: fx.Data) -> str:
    """The reads as files, in a folder for each sample that has its name."""
    path = fx.folder(d.spark, "samples")
    named = d.reads.withColumn("sample", F.concat_ws("_", "species", "mark", F.concat(F.lit("rep"), "rep")))
    named.drop("species", "mark", "rep").repartition("sample").write.partitionBy("sample").parquet(path)
    return path


TEMPLATE = "sample={species}_{mark}_rep{rep}/"


@register
def a2_samples(d):
    """Replicates and reads of every pair of species and mark, found by the names of their files; it fails where one has none."""
    found = sources.discover_samples(d.spark, f"{_sample_files(d)}/*", TEMPLATE)
    return sources.sample_table(sources.require_samples(found, d.species_dim, d.mark_dim), d.species_dim, d.mark_dim)


@register
def a4_glob_round_trip(d):
    """The calls of two observation sets, of even and odd bins, read together by one pattern."""
    path, meta = fx.folder(d.spark, "sets"), d.spark.createDataFrame([(fx.WINDOW,)], "window int")
    for half in (0, 1):
        tables.write_observations(d.cells.filter(F.col("bin") % 2 == half), meta, f"{path}/set-{half}")
    return tables.read_observations(d.spark, f"{path}/set-*").select("i", "l", "chrom", "bin")


def _marks(d: fx.Data) -> list[str]:
    return [r["mark"] for r in d.mark_dim.orderBy("l").collect()]


@register
def w_convert_split(d):
    """The jobs from files to chunks: reads found by name are converted to an observation set, which is read by a pattern and split."""
    out = fx.folder(d.spark, "job")
    convert_split.convert(d.spark, f"{_sample_files(d)}/*", TEMPLATE, sorted(fx.PARENTS), _marks(d), d.genome, f"{out}/set", fx.WINDOW, fx.LEVEL)
    return convert_split.split(d.spark, f"{out}/se*", out=f"{out}/split", kernel=fx.KERNEL, min_reads=fx.MIN_READS, min_size=fx.MIN_SIZE)[1]


def _emissions(d: fx.Data) -> DataFrame:
    return emission.normalize(d.posterior.select("chrom", "bin", "i", "q"), d.cells, d.avail, 1e-6, fx.K)


@register
def a5_params_roundtrip(d):
    """Emissions estimated from the posteriors, saved as parameters of a run and loaded again."""
    e = {(r["k"], r["l"]): r["e"] for r in _emissions(d).collect()}
    path = fx.folder(d.spark, "params")
    for n, scale in ((0, 0.5), (1, 1.0)):
        tables.save_params(d.spark, {"emit": scale * np.array([[e[k, l] for l in range(fx.MARKS)] for k in range(fx.K)])}, path, "run", n)
    back = tables.params_frame(d.spark, tables.load_params(d.spark, path, "run"), "run", 1)
    return _six(back.select("name", F.get("idx", F.lit(0)).alias("k"), F.get("idx", F.lit(1)).alias("l"), "value"), "value")


@register
def a3_observations_round_trip(d):
    path = fx.folder(d.spark, "observations")
    tables.write_observations(d.cells, d.spark.createDataFrame([(fx.WINDOW, sorted(fx.PARENTS))], "window int, species array<string>"), path)
    return tables.read_observations(d.spark, path).select("i", "l", "chrom", "bin")


@register
def a6_posteriors_by_level(d):
    """The posteriors of two iterations, made by formula and a sweep later, as level 3 keeps them, read back."""
    path, q = fx.folder(d.spark, "posteriors"), fx.kept(_q(d), "posterior")
    after = relational.jacobi(q, d.log_likelihood(), d.tree_frame, fx.params())
    for n, found in enumerate([q, after]):
        tables.save_posteriors(decode.stitch(found, d.chunks), path, 3, n, n == 1)
    return _six(_states(d.spark.read.parquet(path).select(F.col("iter").cast("int").alias("iter"), "chrom", "bin", "i", "q")), "q")


@register
def a7_bed_round_trip(d):
    path = fx.folder(d.spark, "bed")
    tables.write_bed(decode.bed(d.posterior, d.species_dim, fx.WINDOW), path)
    return _six(tables.read_bed(d.spark, path), "score")


@register
def a8_restrict(d):
    return tables.restrict(d.cells, 100, 3)


@register
def b1_qc_filter(d):
    return convert.qc_filter(d.reads).select("species", "mark", "rep", "chrom", "pos", "flag", "mapq")


@register
def b2_pair_filter(d):
    return convert.pair_filter(convert.qc_filter(d.reads)).select("species", "mark", "rep", "chrom", "pos", "flag")


@register
def b3_chrom_select(d):
    return d.reads.join(F.broadcast(d.sizes), "chrom").groupBy("chrom", "length", "bins").agg(F.count(F.lit(1)).alias("n"))


@register
def b4_midpoint_bin(d):
    return d.binned.select("species", "mark", "rep", "chrom", "pos", "flag", "bin")


@register
def b5_clamp(d):
    last = F.col("bin") == F.col("bins") - 1
    return d.binned.join(F.broadcast(d.sizes), "chrom").groupBy("chrom").agg(F.max("bin").alias("last_bin"), F.count_if(last).alias("n_last"))


@register
def b6_wide_export(d):
    return convert.wide(d.cells, convert.grid(d.sizes), fx.SPECIES, fx.MARKS)


@register
def c1_histogram(d):
    return convert.histogram(d.binned)


@register
def c2_pool(d):
    return d.counts


@register
def c3_rate(d):
    return _six(d.rates, "rate")


@register
def c4_calls(d):
    return d.calls


@register
def c5_diagnostics(d):
    return convert.diagnostics(d.kept_counts, d.least)


@register
def c6_assemble(d):
    return d.cells


@register
def c7_mark_avail(d):
    return d.avail


@register
def d1_density(d):
    return d.density


@register
def d3_smooth(d):
    return _six(d.smooth, "s")


@register
def d3_smooth_blocks(d):
    return _six(segment.smooth_blocks(d.density, d.sizes, fx.KERNEL, 64), "s")


@register
def d4_runs(d):
    return d.runs


@register
def d5_min_size(d):
    return d.runs.filter(F.col("end") - F.col("start") >= fx.MIN_SIZE)


@register
def d6_chunks(d):
    return d.found


@register
def d7_cut(d):
    return d.cut


@register
def d8_coverage(d):
    return _six(segment.coverage(d.chunks, d.runs, d.sizes), "ratio")


@register
def d9_size_hist(d):
    return segment.size_histogram(d.chunks)


@register
def e1_tree(d):
    """The species of the reads with their parents' numbers."""
    parents = d.spark.createDataFrame(list(fx.PARENTS.items()), "species string, parent_name string")
    named = d.species_dim.join(F.broadcast(parents), "species", "left")
    above = d.species_dim.select(F.col("species").alias("parent_name"), F.col("i").alias("parent"))
    root = F.col("parent").isNull() | (F.col("parent") == F.col("i"))
    return named.join(F.broadcast(above), "parent_name", "left").select("i", "species", F.when(~root, F.col("parent")).alias("parent"), root.alias("is_root"))


@register
def e2_normalize(d):
    """Transitions between neighbouring bins' likeliest states, as rows that sum to 1."""
    states = d.posterior.select("chunk_id", "i", "t", decode.likeliest().alias("k"))
    after = states.select("chunk_id", "i", (F.col("t") + 1).alias("t"), F.col("k").alias("h"))
    counts = states.join(after, ["chunk_id", "i", "t"]).groupBy(F.lit("alpha").alias("name"), F.array("h", "k").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _six(relational.normalize_table(counts), "value").select("name", F.get("idx", F.lit(0)).alias("h"), F.get("idx", F.lit(1)).alias("k"), "value")


def _vectors(d: fx.Data) -> DataFrame:
    return d.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _centres(d: fx.Data) -> list[list[float]]:
    return [list(r["x"]) for r in _vectors(d).filter("id IN (0, 1, 2)").orderBy("id").collect()]


@register
def e3_min_distance(d):
    return _six(gaussian_init.distances(_vectors(d), _centres(d)), "distance").select("id", "distance", "nearest")


@register
def e3_spread_centres(d):
    """Three centres of all vectors, by two passes of six candidates each: their ids, how many vectors each stood for as a
    candidate, and their components."""
    found = gaussian_init.weighed_centres(_vectors(d), 3, passes=2, per_pass=6)
    rows = d.spark.createDataFrame([(k, *c) for k, c in enumerate(found)], "k int, id long, weight long, x array<double>")
    return _six(rows.select("k", "id", "weight", F.posexplode("x").alias("l", "value")), "value")


@register
def e4_start_variance(d):
    """The variances of the vectors nearest to each of those three centres, as a fit of continuous signal starts from them."""
    start = gaussian_init.gaussian_start(_vectors(d), 3, passes=2, per_pass=6)
    rows = [(k, l, float(v)) for (k, l), v in np.ndenumerate(start["variances"])]
    return _six(d.spark.createDataFrame(rows, "k int, l int, variance double"), "variance")


@register
def e4_cluster_variance(d):
    return _six(gaussian_init.cluster_variances(_vectors(d), _centres(d)), "variance")


@register
def e5_bernoulli_ll(d):
    return _six(emission.bernoulli(d.nodes, d.cells, d.emit(), d.avail), "ll")


@register
def e6_gaussian_ll(d):
    centres = _vectors(d).filter("id IN (0, 1, 2)").select(F.col("id").cast("int").alias("k"), F.col("x").alias("mean"), F.transform("x", lambda _, j: 0.25 * (j + 1)).alias("variance"))
    return _six(emission.gaussian(_vectors(d), centres), "ll")


@register
def e7_emission_normalize(d):
    return _six(_emissions(d), "e")


def _q(d: fx.Data) -> DataFrame:
    return d.posterior.select("chunk_id", "i", "t", "q")


@register
def f2_jacobi(d):
    return _six(_states(relational.jacobi(_q(d), d.log_likelihood(), d.tree_frame, fx.params())), "q")


@register
def f3_mean_field_stats(d):
    stats = relational.statistics(_q(d), d.tree_frame)
    return _six(stats, "value").select("name", F.array_join(F.transform("idx", lambda i: i.cast("string")), ",").alias("idx"), "value")


@register
def f4_mean_field_energy(d):
    return _six(relational.free_energy(_q(d), d.log_likelihood(), d.tree_frame, fx.params()), "energy")


@register
def f5_convergence(d):
    return _six(relational.largest_change(_q(d), relational.jacobi(_q(d), d.log_likelihood(), d.tree_frame, fx.params())), "change")


def _packed(d: fx.Data) -> DataFrame:
    return em.pack(d.cut, d.chunks)


def _units(d: fx.Data) -> DataFrame:
    return em.balanced(fx.kept(chains.pack_units(d.cut, d.chunks, fx.SPECIES), "units"))


@register
def f11_independent(d):
    q = em.posteriors(_units(d), "indep", fx.params(2), fx.tree(), d.availability_matrix())
    return q.select("chunk_id", "i", "t", F.round(F.get("q", F.lit(0)), 6).alias("q0"))


@register
def f11_independent_blocks(d):
    """The same posteriors with chunks cut into blocks of three bins, which a scan ties together."""
    units = em.balanced(fx.kept(chains.pack_units(d.cut, d.chunks, fx.SPECIES, 3), "units"))
    q = chains.posteriors(units, fx.params(2), d.availability_matrix(), fan=4)
    return q.select("chunk_id", "i", "t", F.round(F.get("q", F.lit(0)), 6).alias("q0"))


@register
def f6_forward_likelihood(d):
    """The log-likelihood of each chunk, all species as chains of their own."""
    found = em.objectives(_units(d), "indep", fx.params(2), fx.tree(), d.availability_matrix())
    return _six(found, "objective").select("chunk_id", (-F.col("objective")).alias("loglik"))


@register
def f12_clique_pair(d):
    """The exact log-likelihood of each chunk, of the first two species."""
    names = sorted(fx.PARENTS)[:2]
    tree = Tree(names, {n: fx.PARENTS[n] for n in names})
    return _six(em.objectives(em.balanced(_packed(d)), "clique", fx.params(2), tree, d.availability_matrix()[:2]), "objective").select("chunk_id", (-F.col("objective")).alias("loglik"))


@register
def f17_gaussian_m(d):
    w = [(1 + (F.col("id") * 3 + k * 7) % 11).cast("double") for k in range(fx.K)]
    rows = _vectors(d)
    q = rows.select("id", F.array(*[x / sum(w[1:], w[0]) for x in w]).alias("q"))
    return _six(relational.gaussian_statistics(q, rows), "mean", "variance").select("k", "l", "mean", "variance")


@register
def f18_viterbi_chain(d):
    q = em.posteriors(_units(d), "viterbi_chain", fx.params(2), fx.tree(), d.availability_matrix())
    return q.select("chunk_id", "i", "t", decode.likeliest().alias("state"))


@register
def f18_viterbi_blocks(d):
    """The same paths with chunks cut into blocks of three bins."""
    units = em.balanced(fx.kept(chains.pack_units(d.cut, d.chunks, fx.SPECIES, 3), "units"))
    return chains.best_paths(units, fx.params(2), d.availability_matrix(), fan=4)


@register
def g1_map(d):
    return d.posterior.select("chrom", "bin", "i", decode.likeliest().alias("state"))


@register
def g2_bed(d):
    return _six(decode.bed(d.posterior, d.species_dim, fx.WINDOW), "score")


@register
def g3_bed_probabilities(d):
    return _six(decode.bed_probabilities(d.posterior, d.species_dim, fx.WINDOW), "score")


@register
def g4_stitch(d):
    return _six(_states(decode.stitch(_q(d), d.chunks)), "q")


@register
def g5_mark_load(d):
    return _six(decode.mark_load(d.nodes.select("chrom", "bin", "i"), d.cells, fx.MARKS), "load")


@register
def h1_trim(d):
    return segment.trim(d.sizes, d.calls)


@register
def h2_asinh(d):
    return _six(features.scaled(d.kept_counts), "value")


@register
def h3_smooth_signal(d):
    return _six(features.smooth_signal(features.scaled(d.kept_counts), d.sizes), "s")


@register
def h4_gradient(d):
    return _six(features.gradient(features.scaled(d.kept_counts), d.sizes), "g", "gg").drop("value")


@register
def h5_raw_regions(d):
    return segment.regions_of_signal(features.scaled(d.kept_counts), 200.0, fx.MIN_SIZE).select("chrom", "start", "end")


def _model_rows(d: fx.Data, mode: str, species: int | None = None, **how) -> DataFrame:
    avail, tree = d.availability_matrix(), fx.tree()
    params = fx.params()
    if how.pop("separate", False):
        params["theta"] = row_normalize(params["theta"][None] + [[[[0.1 * b]]] for b in range(len(tree.branch()))])
    return em.posteriors(em.balanced(_packed(d)), mode, params, tree, avail, **how)


@register
def f2_mean_field(d):
    return _model_rows(d, "mf")


@register
def f7_product_of_chains(d):
    return _model_rows(d, "poc")


@register
def f10_separate_theta(d):
    return _model_rows(d, "poc", separate=True)


@register
def f12_clique(d):
    return _model_rows(d, "clique")


@register
def f13_loopy(d):
    return _model_rows(d, "loopy")


@register
def f18_viterbi_joint(d):
    return _model_rows(d, "viterbi")


@register
def f19_em(d):
    """Parameters after EM with product of chains, by iteration's objective."""
    packed = em.balanced(_packed(d)).persist()
    params, path = em.fit(packed, "poc", fx.tree(), d.availability_matrix(), fx.K, iterations=3)
    packed.unpersist()
    return tables.params_frame(d.spark, params, "fit", len(path))


@register
def f19_em_relational(d):
    """Two iterations of mean-field EM as joins and sums, of two sweeps each, from the posteriors made by formula: the last sweep's
    largest change and the free energy of each iteration."""
    nodes, q = fx.kept(d.nodes, "nodes"), fx.kept(_q(d), "posterior")
    _, _, path = relational_em.fit(q, nodes, d.cells, d.avail, d.tree_frame, fx.params(), iterations=2, epsilon=0.0, most=2, limit=0.0)
    rows = [(p.number, p.sweeps, float(p.change), float(p.energy)) for p in path]
    return _six(d.spark.createDataFrame(rows, "iter int, sweeps int, change double, energy double"), "change", "energy")


def _signal_packed(d: fx.Data) -> DataFrame:
    return fx.kept(em.pack(segment.cut(d.signal, d.chunks), d.chunks, "value"), "packed")


@register
def f19_em_gaussian(d):
    """Means and variances after EM on the continuous signal, with product of chains, started from spread-out bins."""
    packed = em.balanced(_signal_packed(d)).persist()
    params, path = em.fit(packed, "poc", fx.tree(), d.availability_matrix(), fx.K, iterations=3, gaussian=True)
    packed.unpersist()
    return tables.params_frame(d.spark, params, "fit", len(path))


@register
def f2_mean_field_gaussian(d):
    """Posteriors of the continuous signal under means 0, 3 and 6 and variances of 4."""
    params = {n: v for n, v in fx.params().items() if n != "emit"} | {"means": np.repeat(3.0 * np.arange(fx.K)[:, None], fx.MARKS, axis=1), "variances": np.full((fx.K, fx.MARKS), 4.0)}
    return em.posteriors(em.balanced(_signal_packed(d)), "mf", params, fx.tree(), d.availability_matrix())


@register
def f11_independent_gaussian(d):
    """The log-likelihood of each chunk of the continuous signal, all species as chains of their own, of two states with means 2
    and 5 and variances of 4."""
    params = {n: v for n, v in fx.params(2).items() if n != "emit"} | {"means": np.repeat(np.array([[2.0], [5.0]]), fx.MARKS, axis=1), "variances": np.full((2, fx.MARKS), 4.0)}
    units = fx.kept(chains.pack_units(segment.cut(d.signal, d.chunks), d.chunks, fx.SPECIES, value="value"), "units")
    found = em.objectives(em.balanced(units), "indep", params, fx.tree(), d.availability_matrix())
    return _six(found, "objective").select("chunk_id", (-F.col("objective")).alias("loglik"))


@register
def f21_range_k(d):
    packed = _units(d).persist()
    rows = em.sweep(packed, "indep", fx.tree(), d.availability_matrix(), [2, 3], iterations=3)
    packed.unpersist()
    return d.spark.createDataFrame(rows, "k int, iter int, objective double")


@register
def f22_compare(d):
    packed = em.balanced(_packed(d)).persist()
    rows = em.compare(packed, fx.tree(), d.availability_matrix(), fx.params(), ["mf", "poc", "indep", "clique", "loopy"])
    packed.unpersist()
    return d.spark.createDataFrame(rows, "mode string, kind string, objective double")


@register
def g6_parameter_report(d):
    """Presence in percent by state and mark, from the emission statistics."""
    return decode.emission_report(_emissions(d), fx.MARKS)


@register
def g6_theta_slice(d):
    """The transitions of the first species' children from the parent's state 0, from the mean field's sums."""
    return _six(decode.slice_report(relational.normalize_table(relational.statistics(_q(d), d.tree_frame)), "theta", 0, 0, fx.K), *[f"state{s}" for s in range(fx.K)])


@register
def f7_leaf_posterior(d):
    """The posteriors of a species without children, given its parent's."""
    q = em.leaf_posteriors(em.balanced(_packed(d)), _q(d), 1, fx.params(), fx.tree(), d.availability_matrix())
    return _six(_states(q.select("chunk_id", "t", "q")), "q")


@register
def f9_leaf_energy(d):
    """The log of the sum over all paths of that species' chain, by chunk."""
    q = em.leaf_posteriors(em.balanced(_packed(d)), _q(d), 1, fx.params(), fx.tree(), d.availability_matrix())
    return _six(q.filter("t = 0").select("chunk_id", "value"), "value")


@register
def g7_trajectory(d):
    """The saved objectives of two runs, one behind the other: chains of their own on the calls, and on the continuous signal."""
    out, avail = fx.folder(d.spark, "runs"), d.availability_matrix()
    signal = {n: v for n, v in fx.params(2).items() if n != "emit"} | {"means": np.repeat(np.array([[2.0], [5.0]]), fx.MARKS, axis=1), "variances": np.full((2, fx.MARKS), 4.0)}
    on_signal = fx.kept(chains.pack_units(segment.cut(d.signal, d.chunks), d.chunks, fx.SPECIES, value="value"), "units")
    for run, units, start, gaussian in (("a", _units(d), fx.params(2), False), ("b", em.balanced(on_signal), signal, True)):
        jobs.infer(units, d.chunks, "indep", fx.tree(), avail, 2, out, run, save_q=0, iterations=1, start=start, gaussian=gaussian)
    return _six(jobs.progress(d.spark, out), "gain")


@register
def g2_bed_of_paths(d):
    """The likeliest paths as BED rows: each bin's state on its species' path, with certainty."""
    paths = fx.kept(em.posteriors(_units(d), "viterbi_chain", fx.params(2), fx.tree(), d.availability_matrix()), "paths")
    return decode.bed(decode.stitch(paths, d.chunks), d.species_dim, fx.WINDOW)


def segment_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: convert, split, fit by product of chains (three iterations), decode to BED rows."""
    d = fx.Data(spark, sf_dir)
    avail, tree = d.availability_matrix(), fx.tree()
    packed = fx.kept(em.balanced(_packed(d)), "packed")
    params, _ = em.fit(em.balanced(packed), "poc", tree, avail, fx.K, iterations=3)
    q = em.posteriors(em.balanced(packed), "poc", params, tree, avail)
    return decode.bed(decode.stitch(q, d.chunks), d.species_dim, fx.WINDOW)


QUERIES["w_segment_tracks"] = segment_tracks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
