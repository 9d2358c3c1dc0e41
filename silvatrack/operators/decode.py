"""From posteriors to states, BED rows and reports. Posteriors are (chrom, bin, i, q array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def likeliest() -> Column:
    """The state of q with the largest probability, the lowest among equals."""
    return (F.array_position("q", F.array_max("q")) - 1).cast("int")


def _bed(rows: DataFrame, species_dim: DataFrame, window: int) -> DataFrame:
    return rows.join(F.broadcast(species_dim), "i").select(
        "chrom", (F.col("bin") * window).alias("start"), ((F.col("bin") + 1) * window).alias("end"), F.concat("species", F.lit(".state"), "state").alias("name"),
        F.col("score"), F.lit("+").alias("strand"), "species", "state",
    )


def bed(posterior: DataFrame, species_dim: DataFrame, window: int) -> DataFrame:
    """A row for each bin and species: its likeliest state, with its probability. Neighbouring bins are not merged."""
    return _bed(posterior.select("chrom", "bin", "i", likeliest().alias("state"), F.array_max("q").alias("score")), species_dim, window)


def bed_probabilities(posterior: DataFrame, species_dim: DataFrame, window: int) -> DataFrame:
    """A row for each bin, species and state."""
    return _bed(posterior.select("chrom", "bin", "i", F.posexplode("q").alias("state", "score")), species_dim, window)


def stitch(posterior: DataFrame, found: DataFrame) -> DataFrame:
    """Posteriors of chunks, (chunk_id, i, t, q), by chromosome and bin: all chunks, in order."""
    return posterior.join(found.select("chunk_id", "chrom", "start"), "chunk_id").select("chrom", (F.col("start") + F.col("t")).alias("bin"), "i", "q")


def mark_load(nodes: DataFrame, calls: DataFrame, marks: int) -> DataFrame:
    """(chrom, bin, i, load): the share of marks present at each node (chrom, bin, i)."""
    n = calls.groupBy("chrom", "bin", "i").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, ["chrom", "bin", "i"], "left").select("chrom", "bin", "i", (F.coalesce("n", F.lit(0)) / marks).alias("load"))


def emission_report(emit: DataFrame, marks: int) -> DataFrame:
    """A row for each state, a column for each mark: presence in percent, rounded."""
    return emit.groupBy("k").pivot("l", list(range(marks))).agg(F.max(F.round(F.col("e") * 100)).cast("long")).select("k", *[F.col(f"`{l}`").alias(f"mark{l}") for l in range(marks)])


def slice_report(values: DataFrame, name: str, axis: int, at: int, states: int) -> DataFrame:
    """A table of one name with one index fixed: a row for each value of the first other index, a column for each state."""
    rest = [d for d in range(3) if d != axis]
    rows = values.filter((F.col("name") == name) & (F.size("idx") == 3) & (F.get("idx", F.lit(axis)) == at)).select(F.get("idx", F.lit(rest[0])).alias("from"), F.get("idx", F.lit(rest[1])).alias("to"), "value")
    return rows.groupBy("from").pivot("to", list(range(states))).agg(F.max("value")).select("from", *[F.col(f"`{s}`").alias(f"state{s}") for s in range(states)])


def trajectory(energies: DataFrame) -> DataFrame:
    """(run_id, iter, step, gain): minus the objective of each iteration (log-likelihoods as they are), with steps counted over
    runs in order, so that a run that was taken up again goes on where the one before it ended."""
    value = F.when(F.col("kind") == "loglik", F.col("objective")).otherwise(-F.col("objective"))
    order = Window.orderBy("run_id", "iter")  # a row for each iteration
    return energies.select("run_id", "iter", (F.row_number().over(order) - 1).alias("step"), value.alias("gain"))
