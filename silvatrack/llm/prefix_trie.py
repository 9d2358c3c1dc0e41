"""The prefix trie of conversations, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by the smallest conv_id of its members and its depth, which no two
nodes share. Sequences are told apart by 128 bits: of each place's turn a hash, of the hashes of a prefix their sums, which
add up in blocks, so that no conversation has to be in one task.

Sums over subtrees. Let the weight of a node be the number of turns at and below it, counted once for each member: the groups
of the trie's rows give it, without a sum over the tree. In a component whose top has weight W, the nodes of more than W / 2
are a path from the top down; its last one is the component's centroid. Taking the centroid and what is below it out leaves
a component above, of less than W / 2, and one below each child, of at most W / 2. What was taken out is summed once, added
to every node of the path from the centroid to the top, and taken from the weights there. A node's sum is complete when it is
a centroid itself. Components are split again and again, all at once: by Spark as long as they have more than LOCAL nodes, by
the same rule inside tasks that hold many components each after that. The rounds grow with the logarithm of the weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .conversations import BLOCK, meet, number_turns, prefix_sums, turn_digest

#: Conversations that share their beginnings: c takes those of c - c % SHARED; their turns are fewer than HEADS.
SHARED, HEADS = 5, 9
#: Nodes of a component that one task decomposes.
LOCAL = 20_000
#: Components that are broadcast at most; more are met by a shuffle, and are then small parts of all nodes.
MAX_BROADCAST = 100_000
#: conv_ids that are joined to one text before the texts of a node are hashed one after the other: those of a range of so many bits.
RANGE_BITS = 12


def rebuild(conversations: DataFrame, shared: int = SHARED, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """Of every rebuilt conversation, (conv_id, depth, f1, f2, bytes, length): a row for each prefix, with its 128 bits, the
    UTF-8 bytes of its last text and the whole conversation's number of turns; depth 0 is the empty prefix."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = written(
        conversations.filter(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(text("role"), text("text")).alias("digest"), F.octet_length(text("text")).cast("long").alias("bytes")
        )
    )
    numbered = number_turns(turns, ["turn", "digest"])
    own = written(numbered.select("conv_id", "pos", F.xxhash64("digest").alias("g1"), F.xxhash64(F.lit(1), "digest").alias("g2"), "bytes"))
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    base = F.col("conv_id") - F.col("conv_id") % shared
    wanted = counts.select("conv_id", "n_own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    there = counts.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plans = written(wanted.join(there, "base", "left").select("conv_id", "base", "h", "n_own", taken.alias("k"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")))
    head = own.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(plans.select("conv_id", "base", "k", "length"), "base").filter("pos < k")
    tail = meet(own, plans.select("conv_id", "h", "k", "length", F.col("n_own").alias("weight")), ["conv_id"], "weight").filter("pos >= h")
    rows = (
        plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), F.lit(0).cast("long").alias("bytes"), "length")
        .unionByName(head.select("conv_id", (F.col("pos") + 1).alias("depth"), "g1", "g2", "bytes", "length"))
        .unionByName(tail.select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "g1", "g2", "bytes", "length"))
    )
    term = {"t1": F.xxhash64("g1", "g2", "depth"), "t2": F.xxhash64("depth", "g2", "g1")}
    halves = {f"{t}{s}": F.expr(f"{t} & 4294967295" if s == "a" else f"shiftrightunsigned({t}, 32)") for t in term for s in "ab"}  # sums of halves never overflow
    terms = written(rows.withColumns(term).withColumns(halves).select("conv_id", "depth", *halves, "bytes", "length"))
    summed = prefix_sums(terms, "conv_id", "depth", list(halves), block)
    return summed.select("conv_id", "depth", F.xxhash64(*halves).alias("f1"), F.xxhash64(F.lit(2), *halves).alias("f2"), "bytes", "length")


def split_components(depth: np.ndarray, parent: np.ndarray, comp: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (nodes, columns) over the subtrees within each component, by centroids. Nodes are in order of depth; parent
    is a node's parent in its component, or -1 at the top; comp is the number of the top."""
    n, sums, weight, comp = len(depth), np.zeros_like(values), weight.copy(), comp.copy()
    alive = np.ones(n, dtype=bool)
    levels = np.split(np.arange(n), np.flatnonzero(np.diff(depth)) + 1) if n else []
    up = np.where(parent >= 0, parent, np.arange(n))
    while alive.any():
        path = alive & (2 * weight > weight[comp])
        on = np.flatnonzero(path)
        centre = np.full(n, -1)
        centre[comp[on]] = on  # the deepest comes last
        is_centre = np.zeros(n, dtype=bool)
        is_centre[centre[centre >= 0]] = True
        below, new = np.zeros(n, dtype=bool), comp.copy()
        for level in levels:
            v = level[alive[level] & ~is_centre[level]]
            v = v[comp[v] != v]  # tops have nothing above them
            p = up[v]
            first, further = is_centre[p], below[p]
            new[v[first]] = v[first]
            new[v[further]] = new[p[further]]
            below[v[first | further]] = True
        out, total = np.flatnonzero(below | is_centre), np.zeros_like(values)
        np.add.at(total, comp[out], values[out])
        sums[on] += total[comp[on]]
        higher = on[~is_centre[on]]
        weight[higher] -= weight[centre[comp[higher]]]
        alive &= ~is_centre
        comp = new
    return sums


def _local(names: list[str]):
    """Decomposes the components of a group, adding to the sums that they have."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["depth", "node"], kind="stable").reset_index(drop=True)
        at = pd.MultiIndex.from_arrays([pdf["node"], pdf["depth"]])
        comp = at.get_indexer(pd.MultiIndex.from_arrays([pdf["top"], pdf["top_depth"]]))
        is_top = comp == np.arange(len(pdf))
        parent = at.get_indexer(pd.MultiIndex.from_arrays([pdf["parent"].fillna(0).astype(np.int64), pdf["depth"] - 1]))
        values = pdf[names].to_numpy(dtype=np.int64)
        sums = split_components(pdf["depth"].to_numpy(), np.where(is_top, -1, parent), comp, pdf["weight"].to_numpy(), values)
        out = pdf[["node", "depth"]].copy()
        for i, name in enumerate(names):
            out[f"{name}_sum"] = pdf[f"{name}_sum"].to_numpy() + sums[:, i]
        return out

    return run


def roll_up(nodes: DataFrame, member: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(node, depth, and of each value, name_sum: its sum over the node's subtree). nodes is a kept table (node, depth, parent,
    weight, values); member has (conv_id, depth, node, parent) of every prefix of every conversation."""
    sums = [f"{v}_sum" for v in values]
    root = nodes.filter("parent IS NULL").select("node").first()
    top = F.lit(root["node"] if root else None).cast("long")
    active = nodes.select("node", "depth", "parent", top.alias("top"), F.lit(0).cast("long").alias("top_depth"), "weight", *values, *[F.lit(0).cast("long").alias(s) for s in sums])
    key, done, small = ["top", "top_depth"], [], []
    while True:
        comps = written(active.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole")))
        large = comps.filter(F.col("n") > local)
        n_large = large.count()
        if not n_large:
            small.append(active)
            break
        few = F.broadcast if n_large <= MAX_BROADCAST else (lambda df: df)
        met = active.join(few(large.select(*key, "whole")), key, "left")
        small.append(met.filter("whole IS NULL").drop("whole"))
        held = met.filter("whole IS NOT NULL").withColumn("path", 2 * F.col("weight") > F.col("whole")).drop("whole")
        centres = written(held.filter("path").groupBy(*key).agg(F.max(F.struct("depth", "node", "weight")).alias("c")).select(*key, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        held = held.join(few(centres), key)
        # The node of a conversation one below the centroid's depth tells whether it runs through the centroid, and into which child.
        runs = member.select(F.col("conv_id").alias("node"), F.col("depth").alias("at"), F.col("node").alias("child"), F.col("parent").alias("child_of"))
        deep = held.filter("depth > c_depth").withColumn("at", F.col("c_depth") + 1).join(runs, ["node", "at"]).drop("at")
        high = held.filter("depth <= c_depth").withColumns({"child": F.lit(None).cast("long"), "child_of": F.lit(None).cast("long")})
        is_centre = (F.col("node") == F.col("c_node")) & (F.col("depth") == F.col("c_depth"))
        found = written(deep.unionByName(high).withColumns({"below": F.coalesce(F.col("child_of") == F.col("c_node"), F.lit(False)), "centre": is_centre}))
        totals = found.filter("below OR centre").groupBy(*key).agg(*[F.sum(v).alias(f"{v}_total") for v in values])
        found = found.join(few(written(totals)), key)
        added = {s: F.col(s) + F.when(F.col("path"), F.col(f"{v}_total")).otherwise(0) for v, s in zip(values, sums)}
        moved = {"weight": F.col("weight") - F.when(F.col("path"), F.col("c_weight")).otherwise(0), "top": F.when(F.col("below"), F.col("child")).otherwise(F.col("top")), "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))}
        found = found.withColumns(added)
        done.append(found.filter("centre").select("node", "depth", *sums))
        active = written(found.filter("NOT centre").withColumns(moved).select(*active.columns))
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    rest = written(rest)
    groups = max(1, math.ceil(rest.count() / local))
    out = rest.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups))).groupBy("group").applyInPandas(_local(values), "node long, depth long, " + ", ".join(f"{s} long" for s in sums))
    for d in done:
        out = out.unionByName(d)
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the SHA-256 of each node's conv_ids, ascending and comma-joined. ends is (node, depth, conv_id).
    Ids are joined in ranges first; a hash is sequential, so one task reads a node's ranges, a batch at a time."""
    ranges = ends.groupBy("node", "depth", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashed = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids"))):
                if (node, depth) == held:
                    hashed.update(b"," + ids.encode())
                else:
                    if held:
                        out.append((*held, hashed.hexdigest()))
                    held, hashed = (node, depth), hashlib.sha256(ids.encode())
            yield _table(out)
        if held:
            yield _table([(*held, hashed.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["node", "depth", "ends_sha256"])

    return ranges.repartition("node", "depth").sortWithinPartitions("node", "depth", "range").mapInArrow(digest, "node long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: int = SHARED, heads: int = HEADS, local: int = LOCAL, block: int = BLOCK, hot_rows: int | None = None) -> DataFrame:
    """Of each node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, over conversations rebuilt from the first turns of others.

    Turns are ordered by turn, null first; turns of one number by the SHA-256 of role and text, repeated rows each being a turn
    of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out, whatever
    else they hold. An empty table has no conversations, so no root and no rows. Columns besides the four are not looked at.
    """
    rows = written(rebuild(conversations, shared, heads, block))
    groups = rows.groupBy("depth", "f1", "f2").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("turns"), F.max("bytes").alias("bytes"))
    groups = written(groups.withColumn("weight", F.col("turns") - F.col("n_convs") * (F.col("depth") - 1)))
    named = written(meet(rows.select("conv_id", "depth", "f1", "f2", "length"), groups.select("depth", "f1", "f2", "node", F.col("n_convs").alias("met")), ["depth", "f1", "f2"], "met", hot_rows).select("conv_id", "depth", "node", "length"))
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    member = written(named.join(above, ["conv_id", "depth"], "left"))
    own = member.filter("conv_id = node").select("node", "depth", "parent")
    children = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.select("node", "depth", "n_convs", "bytes", "weight").join(own, ["node", "depth"]).join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    summed = roll_up(nodes.select("node", "depth", "parent", "weight", "n_leaves", "saved_tokens"), member, ["n_leaves", "saved_tokens"], local)
    ends = end_digests(member.filter("depth = length").select("node", "depth", "conv_id"))
    return nodes.select("node", "depth", "parent", "n_convs", "n_children").join(summed, ["node", "depth"]).join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("n_leaves_sum").alias("n_leaves"),
        F.col("saved_tokens_sum").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
