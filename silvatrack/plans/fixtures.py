"""Reads, dimensions, parameters and posteriors derived from the given tables, on which the queries run. What several steps
need (pooled counts, thresholds, calls, chunks) is worked out once and kept as a table in the session's shared folder.

Line items stand for reads: the supplier's region is the species, return flag and line status the mark, a range of orders
the chromosome, the ship date the place. Expressions are the same in the SQL that the queries are held against.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.model import Tree, row_normalize
from ..operators import convert, features, segment
from ..sources.tables import folder, kept  # noqa: F401

WINDOW, LEVEL, KERNEL, MIN_READS, MIN_SIZE, K, SPECIES, MARKS = 2000, 0.1, 5, 4.5, 5, 3, 5, 6
#: Nodes that a task makes, about.
TASK_NODES = 50_000
#: Orders of a chromosome: the genome grows with the tables, and stays as densely read.
ORDERS = 3750
#: The name of the chromosome with number c, and its length, which is not always whole windows.
CHROM, LENGTH = "CASE WHEN c = 3 THEN 'chrX' ELSE concat('chr', c) END", "500000 - c % 3 * 1250"
PARENTS = {"AFRICA": "AFRICA", "AMERICA": "AFRICA", "ASIA": "AFRICA", "EUROPE": "ASIA", "MIDDLE EAST": "ASIA"}


def tree() -> Tree:
    return Tree(sorted(PARENTS), PARENTS)


def params(k: int = K, marks: int = MARKS) -> dict[str, np.ndarray]:
    """Tables made by formula."""
    a = lambda *shape: np.indices(shape)
    h, s = a(k, k)
    v3, h3, s3 = a(k, k, k)
    ks, ls = a(k, marks)
    return {
        "gamma": row_normalize(1.0 + np.arange(k)),
        "alpha": row_normalize(1.0 + 6 * (h == s) + (h * 2 + s) % 3),
        "beta": row_normalize(1.0 + 4 * (h == s) + (h + 2 * s) % 3),
        "theta": row_normalize(1.0 + 5 * (h3 == s3) + 3 * (v3 == s3) + (v3 + h3 + s3) % 2),
        "emit": (1 + (ks * 7 + ls * 3) % 9) / 10.0,
    }


@dataclass
class Data:
    """The steps from the tables of a folder, each built when asked for."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def reads(self) -> DataFrame:
        t = self.table
        region = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
        places = t("supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
        b = t("lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("r_name").alias("species"), F.concat("l_returnflag", "l_linestatus").alias("mark"), (1 + F.col("l_partkey") % 2).cast("int").alias("rep"),
            F.expr(f"l_orderkey div {ORDERS}").alias("c"),
            F.expr("CAST(datediff(l_shipdate, date'1995-01-01') * 200 + (l_partkey * 37 + l_linenumber * 11) % 200 AS bigint)").alias("pos"),
            (F.col("l_linenumber") % 2 == 0).alias("paired"), (F.col("l_partkey") % 5 != 0).alias("proper"), "l_orderkey", "l_quantity",
        )
        return b.select(
            "species", "mark", "rep", F.expr(CHROM).alias("chrom"), "pos", F.expr("CASE WHEN paired THEN pos + 150 ELSE 0 END").cast("long").alias("mpos"), F.lit(36).alias("rlen"),
            F.expr("CAST((CASE WHEN paired THEN 1 ELSE 0 END) + (CASE WHEN paired AND proper THEN 2 ELSE 0 END) + (CASE WHEN l_orderkey % 32 = 5 THEN 1024 ELSE 0 END) AS int)").alias("flag"),
            F.expr("CAST(CASE WHEN l_quantity = 1 THEN 0 ELSE 37 END AS int)").alias("mapq"),
        )

    @cached_property
    def genome(self) -> DataFrame:
        """(chrom, length), as a header has them."""
        last = self.table("lineitem").agg(F.max("l_orderkey")).first()[0]
        genome = self.spark.range(0 if last is None else last // ORDERS + 1).toDF("c")
        return genome.select(F.expr(CHROM).alias("chrom"), F.expr(LENGTH).cast("long").alias("length"))

    @cached_property
    def sizes(self) -> DataFrame:
        return convert.select_chroms(self.genome, WINDOW)

    @cached_property
    def binned(self) -> DataFrame:
        return convert.bin_reads(convert.pair_filter(convert.qc_filter(self.reads)), self.sizes, WINDOW)

    @cached_property
    def counts(self) -> DataFrame:
        return convert.pool(self.binned)

    @cached_property
    def kept_counts(self) -> DataFrame:
        return kept(self.counts, "counts")

    @cached_property
    def rates(self) -> DataFrame:
        return convert.rates(self.kept_counts, self.sizes)

    @cached_property
    def least(self) -> DataFrame:
        return kept(convert.thresholds(self.rates, LEVEL), "thresholds")

    @cached_property
    def calls(self) -> DataFrame:
        return convert.call(self.kept_counts, self.least, self.sizes)

    @cached_property
    def kept_calls(self) -> DataFrame:
        return kept(self.calls, "calls")

    def _dim(self, name: str, number: str) -> DataFrame:
        order = Window.orderBy(name)  # a row for each name
        return self.least.select(name).distinct().select(name, (F.row_number().over(order) - 1).cast("int").alias(number))

    @cached_property
    def species_dim(self) -> DataFrame:
        return self._dim("species", "i")

    @cached_property
    def mark_dim(self) -> DataFrame:
        return self._dim("mark", "l")

    @cached_property
    def cells(self) -> DataFrame:
        return convert.index_calls(self.kept_calls, self.species_dim, self.mark_dim)

    @cached_property
    def avail(self) -> DataFrame:
        return convert.availability(self.least, self.species_dim, self.mark_dim)

    @cached_property
    def density(self) -> DataFrame:
        return segment.density(self.kept_calls)

    @cached_property
    def smooth(self) -> DataFrame:
        return segment.smooth(self.density, self.sizes, KERNEL)

    @cached_property
    def runs(self) -> DataFrame:
        return segment.runs(self.smooth, MIN_READS)

    @cached_property
    def found(self) -> DataFrame:
        return segment.chunks(self.runs, MIN_SIZE)

    @cached_property
    def chunks(self) -> DataFrame:
        return kept(self.found, "chunks")

    @cached_property
    def cut(self) -> DataFrame:
        return segment.cut(self.cells, self.chunks)

    @cached_property
    def signal(self) -> DataFrame:
        """(i, l, chrom, bin, value): scaled counts."""
        scaled = features.scaled(self.kept_counts)
        return scaled.join(F.broadcast(self.species_dim), "species").join(F.broadcast(self.mark_dim), "mark").select("i", "l", "chrom", "bin", "value")

    @cached_property
    def nodes(self) -> DataFrame:
        """(chunk_id, chrom, bin, t, i): every bin of every chunk and species. Chunks are dealt to tasks first: their table is one small file."""
        total = self.chunks.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
        tasks = max(1, min(math.ceil(total * SPECIES / TASK_NODES), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        bins = self.chunks.repartition(tasks, "chunk_id").select("chunk_id", "chrom", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("bin"))
        return bins.select("chunk_id", "chrom", "bin", (F.col("bin") - F.col("start")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(SPECIES - 1))).alias("i"))

    @cached_property
    def posterior(self) -> DataFrame:
        """nodes with q, made by formula."""
        w = [(1 + (F.col("i") * 5 + F.col("bin") * 3 + k * 7) % 11).cast("double") for k in range(K)]
        return self.nodes.withColumn("q", F.array(*[x / sum(w[1:], w[0]) for x in w]))

    @cached_property
    def tree_frame(self) -> DataFrame:
        return self.spark.createDataFrame(tree().rows(), "i int, parent int, is_root boolean")

    def emit(self, k: int = K) -> DataFrame:
        e = params(k)["emit"]
        return self.spark.createDataFrame([(s, l, float(e[s, l])) for s in range(k) for l in range(MARKS)], "k int, l int, e double")

    def log_likelihood(self) -> DataFrame:
        """(chunk_id, i, t, ll array of K)."""
        from ..operators import emission

        return emission.bernoulli_arrays(self.nodes, self.cells, self.emit(), self.avail).select("chunk_id", "i", "t", "ll")

    def availability_matrix(self) -> np.ndarray:
        """The pairs with data, as an array of SPECIES by MARKS."""
        out = np.zeros((SPECIES, MARKS))
        for r in self.avail.collect():
            out[r["i"], r["l"]] = 1
        return out
