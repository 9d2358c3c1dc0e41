"""Tables that the jobs keep: steps, observation sets, parameters, posteriors and BED rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = "run_id string, iter int, name string, idx array<int>, value double"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps shared files: spark.checkpoint.dir. Where it is unset, the warehouse of a session on
    one machine serves; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read from a table from then on."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_observations(calls: DataFrame, meta: DataFrame, path: str) -> None:
    """Calls by chromosome, sorted by bin, and the set's metadata (window, names as asked for)."""
    calls.repartition("chrom").sortWithinPartitions("bin", "i", "l").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/calls")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_observations(spark: SparkSession, *patterns: str) -> DataFrame:
    """The calls of all sets that the patterns match; a pattern without a match is an error."""
    parts = []
    for p in patterns:
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{p}/calls")
        matched = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
        if not matched:
            raise FileNotFoundError(f"no observation set matches {p}/calls")
        parts += [m.getPath().toString() for m in matched]
    out = spark.read.parquet(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spark.read.parquet(p))
    return out


def restrict(calls: DataFrame, max_bins: int | None = None, max_species: int | None = None) -> DataFrame:
    """Calls in the first bins of each chromosome, and of the first species."""
    if max_bins is not None:
        calls = calls.filter(F.col("bin") < max_bins)
    return calls if max_species is None else calls.filter(F.col("i") < max_species)


def params_frame(spark: SparkSession, params: dict[str, np.ndarray], run_id: str, iteration: int) -> DataFrame:
    rows = [(run_id, iteration, name, [int(i) for i in idx], float(v)) for name, a in sorted(params.items()) for idx, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, PARAMS)


def save_params(spark: SparkSession, params: dict[str, np.ndarray], path: str, run_id: str, iteration: int) -> None:
    params_frame(spark, params, run_id, iteration).coalesce(1).write.mode("append").parquet(path)


def load_params(spark: SparkSession, path: str, run_id: str, iteration: int | None = None, children: int | None = None) -> dict[str, np.ndarray]:
    """A run's parameters of an iteration, the last by default. With children, a theta that all branches share is repeated
    for each of them."""
    rows = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    at = rows.agg(F.max("iter")).first()[0] if iteration is None else iteration
    if at is None:
        raise FileNotFoundError(f"no parameters of run {run_id}")
    held = rows.filter(F.col("iter") == at).collect()  # a model: some thousand numbers
    out = {}
    for name in {r["name"] for r in held}:
        cells = [(r["idx"], r["value"]) for r in held if r["name"] == name]
        a = np.zeros([1 + max(i[d] for i, _ in cells) for d in range(len(cells[0][0]))])
        for i, v in cells:
            a[tuple(i)] = v
        out[name] = a
    if children is not None and out["theta"].ndim == 3:
        out["theta"] = np.repeat(out["theta"][None], children, axis=0)
    return out


def save_posteriors(posterior: DataFrame, path: str, level: int, iteration: int, last: bool) -> DataFrame | None:
    """Level 0 keeps none, 1 the last iteration's, 2 every one's, 3 also the last one's stitched by chromosome. Returns the
    stitched table at level 3, in order of chrom, i, bin; a chromosome spreads over as many tasks as its bins call for. An iteration
    is a folder with a file for each task, in order of chrom, however many chromosomes there are."""
    if level >= 2 or (level == 1 and last):
        posterior.sortWithinPartitions("chrom", "i", "bin").write.mode("append").parquet(f"{path}/iter={iteration}")
    if level >= 3 and last:
        return posterior.repartitionByRange("chrom", "i", "bin").sortWithinPartitions("chrom", "i", "bin")
    return None


def write_bed(bed: DataFrame, path: str) -> None:
    """One folder for each species and state, tab-separated, sorted by place within a file; a large one has several files, each
    of a range of places."""
    order = ["species", "state", "chrom", "start"]
    bed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("species", "state").csv(path, sep="\t")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start bigint, end bigint, name string, score double, strand string, species string, state int")
