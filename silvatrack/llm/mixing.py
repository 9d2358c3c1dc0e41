"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets its source's ratio of target to size as an expected number of copies. The whole part is certain;
the fractions are rounded in pairs: words move between two documents, at random and without changing the sum, until
one of them has a whole number of copies. Blocks of a source's documents are rounded in Spark tasks and leave at most
one fraction each; these are rounded in the same way, level by level (a reduction tree), until a source has one left.
So a source's taken words miss its target by less than one document.
"""

from __future__ import annotations

import math
from itertools import cycle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKEN, free_name, meet, partitions, row_hash, unit_hash, written
from .sharding import number_rows

WEIGHTS = (5.0, 2.0, 1.0)
#: Of all words, how many the mix takes.
SHARE = 1.5
#: Copies of a document at most.
CAP = 2
#: Copies of a row that repeats which one task writes.
RUN = 10_000
#: Fractions that one task rounds.
BLOCK = 4096
#: The table of sources is handled on the driver, and broadcast (32 bytes each), up to this many; more stay in Spark.
MAX_SOURCES = 1_000_000


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """The words to take of each source: shares of share times all sizes by weight, sources by code point with null
    last; a source stops at cap times its size, and the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = dict(zip((s for s, _ in order), cycle(weights)))
    limit = {s: cap * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), dict(limit), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= open_[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(limit[s])
            del open_[s]
        left = max(0.0, left - sum(out[s] for s in full))
    return out


def spread_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source_targets without the driver: sizes (of, n, docs) with target. Sources are numbered by ranges of their names; a source
    is full if its limit is at most its weight times a level, which rises with each pass until no more are."""
    spark = sizes.sparkSession
    order = [F.col("of").isNull(), F.col("of")]
    parts = written(sizes.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    counts = counts.select("part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    numbered = parts.join(F.broadcast(counts), "part").withColumn("number", number)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    held = written(numbered.select("of", "n", "docs", weight.alias("weight"), (F.lit(float(cap)) * F.col("n")).alias("limit")))
    total = share * (held.agg(F.sum("n")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        is_full = F.col("limit") <= F.col("weight") * level
        n, used, rest = held.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not rest:
            break
        full, level = n, max(0.0, total - used) / rest
    return held.select("of", "n", "docs", F.when(F.lit(not rest), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level)).alias("target"))


def pivotal(parts: list[float], sizes: list[float], draws: list[float], last: bool) -> list[float]:
    """Rounds fractions of a copy, in order, to 0 or 1 such that sum(part * size) stays; at most one fraction is left,
    which is rounded by its draw's lower bits if this is the last block of its source."""
    out = list(parts)
    held = -1
    for j, p in enumerate(out):
        if p <= 0.0 or p >= 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, q, a, b = held, out[held], sizes[held], sizes[j]
        up, down = min((1 - q) * a, p * b), min(q * a, (1 - p) * b)  # words that i can gain from j, and lose to j
        if draws[j] * (up + down) < down:
            if (1 - q) * a <= p * b:
                out[i], out[j] = 1.0, p - up / b
            else:
                out[i], out[j] = q + up / a, 0.0
        elif q * a <= (1 - p) * b:
            out[i], out[j] = 0.0, p + down / b
        else:
            out[i], out[j] = q - down / a, 1.0
        for k in (i, j):
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = float(round(out[k]))
        held = next((k for k in (i, j) if 0.0 < out[k] < 1.0), -1)
    if last and held >= 0:
        out[held] = 1.0 if math.modf(draws[held] * 2**24)[0] < out[held] else 0.0
    return out


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "doc_id", "size", "nth"], kind="stable", na_position="last")
    last = bool(pdf["blocks"].iloc[0] == 1)
    pdf["part"] = pivotal(pdf["part"].tolist(), pdf["size"].astype(float).tolist(), pdf["draw"].tolist(), last)
    return pdf


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, a kept table, with nth: 0, and numbers from 0 on among rows that are equal."""
    again = written(rows.groupBy("row_key", "row_key2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("weight", F.col("n")))
    first = F.lit(0).cast("long").alias("nth")
    if again.isEmpty():
        return rows.select("*", first)
    repeated = written(meet(rows, again, ["row_key", "row_key2"], "weight").select(*rows.columns))
    few = again.select("row_key", "row_key2")
    once = rows.join(F.broadcast(few) if few.count() <= MAX_SOURCES else few, ["row_key", "row_key2"], "left_anti").select(*rows.columns)
    return written(once.select("*", first).unionByName(number_rows(repeated, "row_key", ["row_key2"], out="nth")))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """Of each row: doc_id, size (white-space separated words of the text, null: 0), source_size, target (its source's),
    taken (words that the mix takes, repeats counted), copies (whole, 0 to cap), row_key and row_key2 (two hashes of the row).

    The draws are hashes of the rows, so reruns agree. Rows without words are not taken. A null source is a source,
    the last. Rows that repeat get a row each, and draws and blocks of their own; which of them is taken makes no difference.
    Further columns only enter the hashes, maps as their JSON.
    """
    rows = written(
        documents.select(
            "doc_id", F.col("source").alias("source"), row_hash(documents).alias("row_key"), row_hash(documents, 2).alias("row_key2"),
            F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
        )
    )
    rows = _numbered(rows)
    found = written(rows.groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")))
    few = found.count() <= MAX_SOURCES
    if few:
        totals = found.collect()
        targets = source_targets([(r["of"], r["n"]) for r in totals], weights, share, cap)
        found = rows.sparkSession.createDataFrame([(r["of"], r["n"], r["docs"], targets[r["of"]]) for r in totals], "of string, n long, docs long, target double")
    else:
        found = spread_targets(found, weights, share, cap)
    sources = found.select("of", F.col("n").alias("source_size"), "target", F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0).alias("ratio"), F.ceil(F.col("docs") / block).cast("long").alias("blocks"))
    most = math.ceil((found.agg(F.max("docs")).first()[0] or 0) / block)
    sources = F.broadcast(sources) if few else sources
    whole = F.floor(F.col("ratio")).cast("int")

    def draw(number: int) -> Column:
        return F.when(F.col("nth") == 0, unit_hash("doc_id", "row_key", F.lit(number))).otherwise(unit_hash("doc_id", "row_key", F.lit(number), "nth"))

    start = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "row_key", "row_key2", "source", "size", "source_size", "target", whole.alias("whole"),
        F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(0.0).alias("part"), draw(seed).alias("draw"), "blocks",
        F.pmod(F.when(F.col("nth") == 0, F.xxhash64("doc_id", "row_key", F.lit(seed + 1))).otherwise(F.xxhash64("doc_id", "row_key", F.lit(seed + 1), "nth")), F.col("blocks")).alias("block"), "nth",
    )
    schema = "doc_id {}, row_key long, row_key2 long, source string, size long, source_size long, target double, whole int, part double, draw double, blocks long, block long, nth long"
    schema = schema.format(rows.schema["doc_id"].dataType.simpleString())
    level, done = start, []
    while True:
        level = written(level.groupBy("source", "block").applyInPandas(_round_block, schema))
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(level.filter(~open_))
        if most <= 1:
            break
        most = math.ceil(most / block)
        up = F.ceil(F.col("blocks") / F.lit(block)).cast("long")
        level = (
            level.filter(open_).withColumn("draw", draw(seed + 2 * len(done)))
            .withColumn("blocks", up).withColumn("block", F.pmod(F.xxhash64("block", F.lit(len(done))), F.col("blocks")))
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.least(F.lit(cap), F.col("whole") + F.col("part").cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), "row_key", "row_key2")


def take(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: documents, all their columns, each row as often as the mix takes it. Of rows that repeat there is one
    with all their copies, which are dealt out in runs of bounded length."""
    key, key2, mine, mine2, n, held, run = (free_name(documents, x) for x in ("row_key", "row_key2", "mixed_key", "mixed_key2", "copies", "rows", "run"))
    chosen = mix(documents, **how).groupBy(F.col("row_key").alias(mine), F.col("row_key2").alias(mine2)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(held)).filter(F.col(n) > 0)
    chosen = written(chosen)
    keyed = documents.withColumn(key, row_hash(documents)).withColumn(key2, row_hash(documents, 2))
    match = (F.col(key) == F.col(mine)) & (F.col(key2) == F.col(mine2))
    times = lambda x: F.explode(F.sequence(F.lit(1).cast("long"), x.cast("long")))
    once = keyed.join(chosen.filter(F.col(held) == 1), match).withColumn(run, times(F.col(n))).select(*documents.columns)
    many = chosen.filter(F.col(held) > 1)
    if many.isEmpty():
        return once
    whole = keyed.join(many, match).groupBy(key, key2, n).agg(F.first(F.struct(*[F.col(c) for c in documents.columns])).alias(held))
    runs = whole.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))).repartition(partitions(documents.sparkSession), key, run)
    again = runs.withColumn(run, times(F.least(F.lit(RUN), F.col(n) - F.col(run) * RUN))).select(f"{held}.*")
    return once.unionByName(again)
