"""What the operators on conversations share: turns in order, numbered without any conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import meet, partitions, written  # noqa: F401

#: Rows of a key that one window sums.
BLOCK = 4096


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256, as hex, of a turn's role and text together."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def number_turns(turns: DataFrame, order: list[str], parts: int | None = None, out: str = "pos") -> DataFrame:
    """turns with out: gapless numbers from 0 within each conv_id (null is one of them), by the columns order, nulls first.

    Rows are dealt by ranges of (conv_id, order, place), so that a conversation of any size, also of rows that are all equal,
    spreads over tasks; each range is numbered on its own, from where the ranges before it end. Rows equal in conv_id and
    order are taken in any one order: order should have all that tells rows apart."""
    ranged = (
        turns.withColumn("place_", F.monotonically_increasing_id())
        .repartitionByRange(parts or partitions(turns.sparkSession), "conv_id", *order, "place_").withColumn("range_", F.spark_partition_id())
    )
    ranged = written(ranged)
    inside = Window.partitionBy("range_", "conv_id").orderBy(*order, "place_")
    before = Window.partitionBy("conv_id").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy("range_", "conv_id").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select(F.col("range_").alias("at_"), F.col("conv_id").alias("of_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    numbered = ranged.withColumn("inside_", F.row_number().over(inside) - 1)
    return numbered.join(starts.filter("start_ > 0"), (F.col("range_") == F.col("at_")) & F.col("conv_id").eqNullSafe(F.col("of_")), "left").select(
        *turns.columns, (F.col("inside_") + F.coalesce("start_", F.lit(0))).cast("long").alias(out)
    )


def prefix_sums(df: DataFrame, key: str, at: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """df with each value replaced by the sum of those at the same and at smaller places of its key; at, from 0, is unique
    within a key. Blocks are summed on their own, and the blocks' sums in the same way."""
    last = df.agg(F.max(at)).first()[0] or 0
    part, of, up = (f"{at}_{n}" for n in ("block", "of", "up"))  # at grows with each level, so names never clash
    inside = df.withColumn(part, F.expr(f"{at} div {block}"))
    inside = inside.withColumns({v: F.sum(v).over(Window.partitionBy(key, part).orderBy(at)) for v in values})
    if last < block:
        return inside.drop(part)
    before = {v: f"{v}_{at}" for v in values}
    whole = written(df.groupBy(F.col(key).alias(of), F.expr(f"{at} div {block}").alias(up)).agg(*[F.sum(v).alias(b) for v, b in before.items()]))
    carried = prefix_sums(whole, of, up, list(before.values()), block).withColumn(up, F.col(up) + 1)
    met = inside.join(carried, (F.col(key) == F.col(of)) & (F.col(part) == F.col(up)), "left")
    return met.withColumns({v: F.col(v) + F.coalesce(b, F.lit(0)) for v, b in before.items()}).select(*df.columns)
