"""Sharding by Karmarkar-Karp differencing: documents with equal texts form groups that stay together, and the groups
are dealt to shards so that the shards' bytes come out near equal.

A partial partition is a way to split some groups among the shards, kept as its bytes per shard. The two of largest
spread (most bytes in a shard less fewest) are combined again and again, the fullest shard of one with the emptiest
of the other. Blocks of groups are combined in Spark tasks, each into one partial partition; then the blocks' partial
partitions are combined in the same way, level by level, until one is left.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, meet, written

SHARDS = 16
#: Partial partitions that one task combines.
BLOCK = 4096
#: Rows that one task numbers.
CELL = 20_000
#: Rows from which a group of equal texts is met by a broadcast.
HOT_ROWS = 10_000


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines the rows of sums (partial partitions by shards) into one: returns the shard that shard j of each row
    becomes, as an array of the same shape, and the combined bytes per shard, largest first. Ties are broken by row."""
    m, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, order, axis=1))
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = nodes[a] + nodes[b][::-1]
        rank = np.argsort(-both, kind="stable")
        nodes.append(both[rank])
        nodes[a] = nodes[b] = None
        joined.append((a, b, rank))
        heapq.heappush(heap, (int(both[rank[-1]] - both[rank[0]]), len(nodes) - 1))
    place = [None] * (len(nodes) - 1) + [np.arange(k)]  # where each node's j-th largest shard ends up
    for i in range(len(joined) - 1, -1, -1):
        a, b, rank = joined[i]
        up = np.empty(k, dtype=np.int64)
        up[rank] = place[m + i]  # where the pair's shard of a's rank j ends up
        place[a], place[b] = up, up[::-1]
    out = np.empty((m, k), dtype=np.int64)
    for i in range(m):
        out[i, order[i]] = place[i]
    return out, nodes[-1]


def _combine(k: int, name: str):
    """For each block: the rows of its partial partitions (id, sums), with the shards that theirs become."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable")
        sums = np.stack([np.asarray(x, dtype=np.int64) for x in pdf["sums"]])
        out, total = differencing(sums)
        return pd.DataFrame({name: pdf[name], "block": pdf["block"], "becomes": list(out.astype(np.int32)), "total": [total if i == 0 else None for i in range(len(pdf))]})

    return block


def assign_groups(groups: DataFrame, about: int, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """groups has group (a string, unique), bytes and rows, and is computed once; about is near their number, and only sets
    how many blocks there are. Returns (group, rows, shard)."""
    blocks = max(1, math.ceil(about / block))
    at = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(blocks)).cast("long")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(pdf), shards), dtype=np.int64)
        sums[:, 0] = pdf["bytes"].to_numpy()
        out, total = differencing(sums)
        return pd.DataFrame({"group": pdf["group"], "rows": pdf["rows"], "block": pdf["block"], "inner": out[:, 0].astype(np.int32), "total": [total if i == 0 else None for i in range(len(pdf))]})

    dealt = written(
        groups.select("group", "bytes", "rows", at.alias("block")).groupBy("block").applyInPandas(first, "group string, rows long, block long, inner int, total array<long>")
    )
    level = dealt.filter("total IS NOT NULL").select(F.col("block").alias("part"), F.col("total").alias("sums"))
    maps = []
    while blocks > 1:
        up = max(1, math.ceil(blocks / block))
        step = written(
            level.select("part", "sums", F.pmod(F.xxhash64("part", F.lit(11 + len(maps))), F.lit(up)).cast("long").alias("block"))
            .groupBy("block").applyInPandas(_combine(shards, "part"), "part long, block long, becomes array<int>, total array<long>")
        )
        maps.append(step.select("part", F.col("block").alias("up"), "becomes"))
        level = step.filter("total IS NOT NULL").select(F.col("block").alias("part"), F.col("total").alias("sums"))
        blocks = up
    out = dealt.select("group", "rows", F.col("block").alias("part"), F.col("inner").alias("shard"))
    for m in maps:
        out = out.join(m, "part").select("group", "rows", F.col("up").alias("part"), F.get("becomes", F.col("shard")).alias("shard"))
    return out.select("group", "rows", "shard")


def number_rows(df: DataFrame, by: str, order: list[str], cell: int = CELL, out: str = "slot") -> DataFrame:
    """df, a table that is kept, with gapless numbers from 0 among the rows that share by: cells of near equal, bounded counts
    are numbered in tasks of their own, and start where the cells before them end. Rows are dealt to cells by their place
    in the table, so that equal rows are too."""
    counts, sub, start, n, place = (free_name(df, x) for x in ("counts", "cell", "cell_start", "cell_n", "place"))
    rows = df.count()
    cells = max(1, math.ceil(rows / cell))
    held = df.withColumn(place, F.monotonically_increasing_id()).withColumn(sub, F.pmod(F.xxhash64(place), F.lit(cells)).cast("int"))
    sizes = held.groupBy(by, sub).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(by).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(by).alias(counts), F.col(sub).alias(f"{sub}_at"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(by, sub).orderBy(*order, place)) - 1
    numbered = held.withColumn(out, inside.cast("long"))
    return (
        numbered.join(starts, (F.col(by) == F.col(counts)) & (F.col(sub) == F.col(f"{sub}_at")))
        .withColumn(out, F.col(out) + F.col(start))
        .select(*df.columns, out)
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Of each row: doc_id, size (UTF-8 bytes of the text, and 1), text_crc32, law ("bytes": the shards' sizes come out
    near equal), shard, slot (gapless from 0 in its shard) and grown_shard (null: this law has none).

    Rows with equal texts share a shard, null and empty texts being equal; a group larger than a shard's share makes
    its shard the fullest by as much as it must. Rows that repeat get a slot each. No row is looked at beyond doc_id
    and text; null ids are like any other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group"))
    )
    about = rows.agg(F.approx_count_distinct("group")).first()[0]
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # A text that very many rows have, as null and empty ones may, would be one key of a shuffle.
    placed = meet(rows, assign_groups(groups, about, shards, block), ["group"], "rows", HOT_ROWS).drop("group")
    numbered = number_rows(written(placed), "shard", ["doc_id", "text_crc32", "size"], cell)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
