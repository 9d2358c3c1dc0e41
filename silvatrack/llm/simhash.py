"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ by a self-join of the
fingerprints' binary trie, and grouped by connected components.

The trie is entered from four sides. Where at most three bits differ, one of the four runs of 16 bits is equal; so four
tries, each over the bits turned to begin with another run, need only be entered at equal nodes of depth 16. Below
such a node, pairs of nodes are walked down together; their differing bits add up, and a pair is dropped when the sum
is over the budget. A node that holds too many fingerprints for one task is opened further first, by pairs of deeper
nodes within the budget. Each task returns a spanning forest of the links it found, so that a group of n near copies
costs n links, not n * n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import HOT_ROWS, free_name, give_back, meet, partitions, row_hash, tidy, written

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints below one node that a task walks; larger nodes are opened.
NODE = 30_000
#: Fingerprints that a task gets at a time, about; it takes whole nodes, and many small ones together.
CELL_FPS = 8000
#: Pairs of nodes that a task holds at a time.
FRONTIER = 400_000
#: Shingles that are hashed at a time.
STEP = 50_000


def shingle_hashes(text: bytes | None, k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of k words (lower-cased A-Z, split at ASCII white space, joined by spaces), repeats
    included, in pieces; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    for i in range(0, len(starts), STEP):
        pairs = zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist())
        yield np.fromiter((digest(joined[s:e], seed) for s, e in pairs), dtype=np.uint64, count=min(STEP, len(starts) - i))


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit integer: a bit is 1 if it is set in over half of the shingles' hashes; 0 if none."""
    set_, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, k):
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(each), f"doc_id {kind}, fp long")


class Forest:
    """Union-find that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def flatten(self) -> None:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 100_000):
            self.flatten()
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            apart = self.up[x] != self.up[y]
            for p, q in zip(x[apart].tolist(), y[apart].tolist()):
                r, s = self.root(p), self.root(q)
                if r != s:
                    self.up[max(r, s)] = min(r, s)
                    self.a.append(p)
                    self.b.append(q)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, all of lo..hi-1: the row's number and the value."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Trie:
    """Nodes of a binary trie over sorted distinct 64-bit numbers, from depth start on, every second level: children[d][i]
    to children[d][i + 1] are node i's at the next level. It ends where every node holds one number."""

    def __init__(self, values: np.ndarray, start: int):
        self.levels, self.children, depth = [np.unique(values >> np.uint64(64 - start))], [], start
        while len(self.levels[-1]) < len(values):
            depth += 2
            nodes = np.unique(values >> np.uint64(64 - depth))
            self.children.append(np.append(np.searchsorted(nodes >> np.uint64(2), self.levels[-1]), len(nodes)))
            self.levels.append(nodes)


def trie_links(values: np.ndarray, start: int, budget: int, forest: Forest, left: np.ndarray | None = None) -> None:
    """Joins in forest all pairs of values (sorted, distinct, 64 bits) that are equal in their first start bits and differ in
    at most budget others; with left, a mask over values, only pairs of one inside and one outside it."""
    trie = Trie(values, start)
    roots = np.arange(len(trie.levels[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.uint8))]
    while stack:
        depth, a, b, err = stack.pop()
        if depth == len(trie.children):
            off = (a < b) if left is None else ((a < b) & (left[a] != left[b]))
            a, b = a[off], b[off]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.join(a[near], b[near])
            continue
        if len(a) > FRONTIER // 8:
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:], err[half:]), (depth, a[:half], b[:half], err[:half])]
            continue
        down, nodes = trie.children[depth], trie.levels[depth + 1]
        row, x = _spread(down[a], down[a + 1])
        row2, y = _spread(down[b[row]], down[b[row] + 1])
        x, row = x[row2], row[row2]
        ordered = x <= y
        x, y, row = x[ordered], y[ordered], row[ordered]
        e = err[row] + np.bitwise_count((nodes[x] ^ nodes[y]) & np.uint64(3))
        ok = e <= budget
        stack.append((depth + 1, x[ok], y[ok], e[ok].astype(np.uint8)))


def _turned(fp: Column, run: int) -> Column:
    """fp turned left so that its run-th 16 bits come first."""
    return fp if run == 0 else F.shiftleft(fp, 16 * run).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * run))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links below the nodes of depth 16 that a task has, or between the two of a pair of deeper
    nodes (sides 1 and 2)."""
    links = []
    for run, rows in pdf.groupby("run"):
        fps, at = np.unique(rows["turned"].to_numpy().astype(np.int64).view(np.uint64), return_index=True)
        side = rows["side"].to_numpy()[at]
        forest = Forest(len(fps))
        trie_links(fps, 16, MAX_BITS, forest, side == 1 if (side != 0).any() else None)
        found = fps[np.array([forest.a, forest.b], dtype=np.int64)]
        right, left = np.uint64(16 * run), np.uint64(64 - 16 * run)
        links.append(((found >> right) | (found << left) if run else found).view(np.int64))
    a, b = np.concatenate(links, axis=1)
    give_back()
    return pd.DataFrame({"a": a, "b": b})


def trie_self_join(fps: DataFrame, node: int = NODE) -> DataFrame:
    """fps has fp (distinct longs). Returns links (a, b) of fingerprints with at most MAX_BITS differing bits that connect
    whatever all such links connect: each node's are a spanning forest."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), _turned(F.col("fp"), r).alias("turned")) for r in range(4)])).alias("t")
    rows = fps.select(runs).select("t.run", "t.turned", F.shiftrightunsigned("t.turned", 48).cast("int").alias("first"))
    counts = rows.groupBy("run", "first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return rows.limit(0).select(F.col("turned").alias("a"), F.col("turned").alias("b"))
    cells, schema = math.ceil(total / CELL_FPS), "a long, b long"
    tasks = partitions(fps.sparkSession)  # named, since the work is many times what the few bytes would be coalesced for
    whole = rows.join(counts.filter(F.col("n") <= node), ["run", "first"]).select("run", "turned", F.lit(0).alias("side"), F.pmod(F.xxhash64("run", "first"), F.lit(cells)).alias("cell"))
    links = whole.repartition(tasks, "cell").groupBy("cell").applyInPandas(_walk, schema)
    if top > node:
        # Large nodes: the next bits (as many as make the largest small enough) name deeper nodes; all pairs of these
        # with at most MAX_BITS between them get a task each.
        deep = min(16, math.ceil(math.log2(top / node)) + 1)
        masks = [sum(1 << i for i in c) for r in range(MAX_BITS + 1) for c in combinations(range(deep), r)]
        big = rows.join(counts.filter(F.col("n") > node), ["run", "first"]).withColumn("own", F.shiftrightunsigned(F.shiftleft("turned", 16), 64 - deep).cast("int"))
        big = big.select("run", "first", "turned", "own", F.explode(F.expr("array(" + ",".join(map(str, masks)) + ")")).alias("mask"))
        opened = big.withColumn("other", F.col("own").bitwiseXOR(F.col("mask"))).select(
            "run", "first", "turned", F.least("own", "other").alias("node_a"), F.greatest("own", "other").alias("node_b"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        )
        links = links.unionByName(opened.repartition(tasks, "run", "first", "node_a", "node_b").groupBy("run", "first", "node_a", "node_b").applyInPandas(_walk, schema))
    return links


def components(links: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(node, root): for each node of links (a, b long) the smallest node that it is connected to, by alternating large-star
    and small-star rounds until the links no longer change."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A star's centre has as many rows as its class has nodes: where there are large ones, they are met by a broadcast.
        hot = (both.groupBy("u").count().agg(F.max("count")).first()[0] or 0) >= (HOT_ROWS if hot_rows is None else hot_rows)
        keep = written if hot else (lambda df: df)

        def met(rows: DataFrame, known: DataFrame) -> DataFrame:
            return meet(rows, known, ["u"], "n", hot_rows) if hot else rows.join(known, "u").drop("n")

        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = keep(met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_least = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = met(large, small_least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = written(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(documents: DataFrame, k: int = SHINGLE, node: int = NODE, hot_rows: int | None = None) -> DataFrame:
    """Of each row: doc_id, fingerprint (16 lower-case hex digits) and component_id (the smallest doc_id among the rows that
    a chain of links of at most MAX_BITS differing bits reaches, its own included; null if none of them has an id).

    A null or empty text, or one of white space alone, has the fingerprint zero and is linked like any other. Equal
    fingerprints meet before the join, so a group of copies costs no more than one of them. Repeated rows keep a row
    each. Columns beside doc_id and text are not looked at.
    """
    rows = written(fingerprints(documents, k))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = components(trie_self_join(fps.select("fp"), node), hot_rows)
    rooted = written(fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("met")))
    classes = written(meet(rooted, least, ["root"], "met", hot_rows).select("fp", "component_id", "n"))
    return meet(rows, classes, ["fp"], "n", hot_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by similarity. Three differing bits of a whole text's fingerprint are a similarity of shingles of about
# 0.97; those down to 0.8 are brought together by bands of least hashes too, and what comes together is verified.

#: Words in a shingle, and the least share of common shingles (Jaccard), for removal.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Bands of a text, and in each the least of its shingles' hashes in so many orders. Of texts with a share s of common
#: shingles, 1 - (1 - s ** ORDERS) ** BANDS have a band in common: at 0.8 all but 3 in 100,000.
BANDS, ORDERS = 20, 4
#: Places of a sketch: a byte of the least shingle of each of so many ranges of hashes.
PLACES = 256
#: Texts whose sketches are this much less alike than asked for are not looked at more closely: over five standard
#: deviations of what a sketch can miss.
SKETCH_MARGIN = 0.15
#: Texts that are compared at a time; a larger group is cut into blocks of half as many, and these are compared two by two.
GROUP = 4000
#: Pairs for each text of a unit above which they are not sent out, but compared where they are, with all shingles.
DENSE = 4
#: Keys of rows that are broadcast (24 bytes each); more are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000
#: Texts that a task compares, about, in whole groups or pairs of blocks.
CELL = 20_000
_ORDERS = (2 * np.random.default_rng(64).integers(1, 2**31, BANDS * ORDERS, dtype=np.uint64) + 1).astype(np.uint32)


def shingle_set(text: bytes | None, k: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 32-bit hashes."""
    h = list(shingle_hashes(text, k))
    return np.unique(np.concatenate(h) >> np.uint64(32)).astype(np.uint32) if h else np.empty(0, dtype=np.uint32)


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band; none where there are no shingles."""
    from xxhash import xxh64_intdigest as digest

    if not len(shingles):
        return []
    least = np.full(len(_ORDERS), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * _ORDERS).min(axis=0), out=least)
    return [digest(least[i * ORDERS : (i + 1) * ORDERS].tobytes(), seed=i) - 2**63 for i in range(BANDS)]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A byte (1 to 255) of the least shingle of each range of hashes, 0 where there is none."""
    out = np.zeros(PLACES, dtype=np.uint8)
    place, first = np.unique(shingles >> np.uint32(24), return_index=True)
    out[place] = shingles[first] % np.uint32(255) + np.uint32(1)
    return out


def sketch_similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """About the share of common shingles of one sketch with each of many, or of each with its own."""
    same = ((many == one) & (one != 0)).sum(axis=1)
    either = ((many != 0) | (one != 0)).sum(axis=1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def describe(text: bytes | None, k: int = WIDE_SHINGLE) -> tuple[int, int, int, list[int], bytes, int]:
    """Of a text: two hashes of all its words, its fingerprint, its bands, its sketch and how many shingles it has; all zero or
    empty where there are no words."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0, 0, 0, [], bytes(PLACES), 0
    joined = b" ".join(words)
    h = np.concatenate(list(shingle_hashes(joined, k)))
    bits = sum(np.unpackbits(h[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), STEP))
    whole = int(np.packbits(2 * bits > len(h), bitorder="little").view("<i8")[0])
    s = np.unique(h >> np.uint64(32)).astype(np.uint32)
    return digest(joined, seed=1) - 2**63, digest(joined, seed=2) - 2**63, whole, bands(s), sketch(s).tobytes(), len(s)


def _near(similarity: float):
    """Whether sketches are near enough to look at the texts' shingles."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for x in (a, b))
        m, n = (x.to_numpy(zero_copy_only=False) for x in (m, n))
        sizes = np.minimum(m, n) >= similarity * np.maximum(m, n)
        alike = pa.array(sizes & (sketch_similarity(one, two) >= similarity - SKETCH_MARGIN))
        give_back()
        return alike

    return near


def _similar(similarity: float):
    """Whether two sets of shingles have at least this share in common."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = (np.frombuffer(z.as_buffer(), dtype="<u4") for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        give_back()
        return pa.array(out)

    return similar


def _compare_cell(similarity: float, exact: bool):
    """Pairs (unit, a, b) of texts of different classes in the units that a task has; of a unit with both halves, of different
    halves. Not exact: pairs with near sketches; of a unit with very many, one row without a pair. Exact: links that hold
    by all shingles and connect whatever all such links in the unit do, at most one for each text."""

    def unit(pdf: pd.DataFrame) -> list[np.ndarray] | None:
        pdf = pdf.sort_values("node", kind="stable")
        node, size, part, half = (pdf[c].to_numpy() for c in ("node", "m", "class", "half"))
        part = np.unique(part, return_inverse=True)[1]
        sketches = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(-1, PLACES)
        if exact:
            flat = np.frombuffer(b"".join(pdf["shingles"]), dtype="<u4")
            past = np.cumsum(size)
        both_halves, pairs, n = half.min() != half.max(), [], 0
        for i in range(len(node) - 1):
            near = (part[i + 1 :] != part[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]))
            if both_halves:
                near &= half[i + 1 :] != half[i]
            others = np.flatnonzero(near) + i + 1
            for j in range(0, len(others), 512):
                some = others[j : j + 512]
                some = some[sketch_similarity(sketches[i], sketches[some]) >= similarity - SKETCH_MARGIN]
                if exact:
                    some = some[part[some] != part[i]]
                    if len(some):
                        own = flat[past[i] - size[i] : past[i]]
                        row, at = _spread(past[some] - size[some], past[some])
                        both = np.bincount(row, weights=own[np.minimum(np.searchsorted(own, flat[at]), len(own) - 1)] == flat[at], minlength=len(some))
                        some = some[both >= similarity * (size[i] + size[some] - both)]
                    if len(some):  # one link to each class
                        some = some[np.unique(part[some], return_index=True)[1]]
                        part[np.isin(part, part[some])] = part[i]
                if len(some):
                    pairs.append(np.stack([np.full(len(some), node[i]), node[some]], axis=1))
                    n += len(some)
                    if not exact and n > DENSE * len(node):
                        return None
        return pairs

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, rows in pdf.groupby("unit"):
            pairs = unit(rows)
            a, b = ([None], [None]) if pairs is None else np.concatenate([np.empty((0, 2), dtype=np.int64), *pairs]).T
            out.append(pd.DataFrame({"unit": name, "a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64")}))
        give_back()
        return pd.concat(out)

    return compare


def _units(members: DataFrame) -> DataFrame:
    """members: (group, node, m, class), of groups with several classes. Returns (unit, half, node, m, class) such that any two
    texts of one group and different classes meet in a unit, of at most about GROUP texts: whole groups, or pairs of
    blocks of larger ones. Texts of a group's largest class do not meet again; blocks hold texts of like sizes, and only
    such with like enough ones meet."""
    sizes = members.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class"))["class"].alias("most"))
    sizes = written(sizes)
    small = members.join(sizes.filter(F.col("n") <= GROUP).select("group"), "group").select(F.xxhash64("group").alias("unit"), F.lit(0).alias("half"), "node", "m", "class")
    large = sizes.filter(F.col("n") > GROUP)
    if large.isEmpty():
        return small
    width = -math.log(SIMILARITY) + 1e-9
    sided = members.join(large.select("group", "most"), "group").withColumn("rest", F.col("class") != F.col("most")).drop("most")
    sided = written(sided.withColumn("band", F.floor(F.log(F.greatest("m", F.lit(1))) / width)))
    counts = written(sided.groupBy("group", "rest", "band").agg(F.ceil(F.count(F.lit(1)) * 2 / GROUP).alias("blocks")))
    blocks = counts.select("group", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct("rest", "band", i.alias("i")))).alias("x"))
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "group").filter("x <= y AND (x.rest OR y.rest) AND abs(x.band - y.band) <= 1")
    pairs = pairs.withColumn("unit", F.xxhash64("group", "x", "y"))
    halves = pairs.select("group", "x.*", "unit", F.lit(0).alias("half")).unionByName(pairs.filter("x < y").select("group", "y.*", "unit", F.lit(1).alias("half")))
    placed = sided.join(counts, ["group", "rest", "band"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return small.unionByName(placed.join(halves, ["group", "rest", "band", "i"]).select("unit", "half", "node", "m", "class"))


def similar_texts(texts: DataFrame, sets, similarity: float = SIMILARITY) -> DataFrame:
    """texts: (node, fp, bands, sketch, m), a row for each distinct text; sets, a function that gives (node, shingles) of a table
    of nodes. Returns (node, root): for each node with a similar one, the smallest in its class.

    Candidates share a band, or the self-join of the fingerprints' trie connects them. Each is compared with the least of
    its group first; then, in groups that this leaves in several classes, all texts of different classes are compared,
    whatever the group's size. Each link holds by all shingles of its texts."""
    trie = components(trie_self_join(texts.filter("m > 0").select("fp").distinct())).withColumnRenamed("node", "of")
    rooted = texts.filter("m > 0").select("node", "fp").join(trie, F.col("fp") == F.col("of"), "left")
    groups = texts.select("node", F.explode("bands").alias("group")).unionByName(
        rooted.select("node", F.xxhash64(F.lit("trie"), F.coalesce("root", "fp")).alias("group"))
    )
    shared = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").drop("n")
    members = written(groups.join(shared, "group"))
    known = texts.select("node", "sketch", "m")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (a, b) of pairs that hold."""
        pairs = written(pairs)
        of = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(of.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(of.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        return both.filter(_similar(similarity)(F.col("of_a"), F.col("of_b"))).select("a", "b")

    pairs = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(known.toDF("a", "sketch_a", "m_a"), "a").join(known.toDF("b", "sketch_b", "m_b"), "b")
    links = written(verified(pairs.filter(_near(similarity)(F.col("sketch_a"), F.col("sketch_b"), F.col("m_a"), F.col("m_b"))).select("a", "b")))
    classes = components(links).withColumnRenamed("node", "mine")
    sorted_out = written(members.select("group", "node").join(classes, F.col("node") == F.col("mine"), "left").select("group", "node", F.coalesce("root", "node").alias("class")))
    several = sorted_out.groupBy("group").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("group")
    units = written(_units(written(sorted_out.join(several, "group").join(known.select("node", "m"), "node"))))

    def compared(units: DataFrame, texts_in_cell: int, exact: bool) -> DataFrame:
        cells = max(1, math.ceil(units.count() / texts_in_cell))
        rows = units.join(known.select("node", "sketch"), "node").withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(cells)))
        if exact:
            rows = rows.join(sets(units.select("node").distinct()), "node")
        return written(rows.repartition(partitions(units.sparkSession), "cell").groupBy("cell").applyInPandas(_compare_cell(similarity, exact), "unit long, a long, b long"))

    pairs = compared(units, CELL, False)
    links = links.unionByName(verified(pairs.filter("a IS NOT NULL").select("a", "b").distinct()))
    dense = pairs.filter("a IS NULL").select("unit").distinct()
    if not dense.isEmpty():
        links = links.unionByName(compared(written(units.join(dense, "unit")), GROUP, True).select("a", "b"))
    return components(links)


def deduplicate(documents: DataFrame, similarity: float = SIMILARITY, k: int = WIDE_SHINGLE) -> DataFrame:
    """documents, all their columns, with one row of each class of near duplicates: texts of the same words, or connected by
    links of at least this share of common shingles of k words. The row with the smallest doc_id stays (null ids last,
    then by a hash of the row).

    Texts without words are one class. Every link holds by the texts' whole sets of shingles; a pair at just the least
    similarity is brought together with a probability of about 0.99997. Groups of any size are compared in full.
    """
    key, key2 = free_name(documents, "row_key"), free_name(documents, "row_key2")
    keyed = documents.withColumn(key, row_hash(documents)).withColumn(key2, row_hash(documents, 2))
    names = ["doc_id", "k1", "k2", "t1", "t2", "fp", "bands", "sketch", "m", "node"]
    types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33  # a number for each row, kept with it
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                columns = list(zip(*[describe(t.as_py(), k) for t in part.column(3)]))
                columns = [*part.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types[3:])], pa.array(range(at, at + part.num_rows), pa.int64())]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, names)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), k).astype("<u4").tobytes() for t in part.column(1)], pa.binary())], ["node", "shingles"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = written(
        keyed.select("doc_id", F.col(key).alias("k1"), F.col(key2).alias("k2"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(tidy(each), f"doc_id {kind}, k1 long, k2 long, t1 long, t2 long, fp long, bands array<long>, sketch binary, m long, node long")
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
    texts = written(rows.groupBy("t1", "t2").agg(F.min("node").alias("node"), best, *[F.first(c).alias(c) for c in ("fp", "bands", "sketch", "m")]))

    def some(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MAX_BROADCAST_KEYS else df

    def sets(nodes: DataFrame) -> DataFrame:
        """(node, shingles), from the texts themselves: of few, so that no shingles need to be kept of all."""
        need = written(nodes.join(texts.select("node", F.col("best.k1").alias("need1"), F.col("best.k2").alias("need2")), "node").withColumnRenamed("node", "need_node"))
        found = keyed.select(F.col(key).alias("k1"), F.col(key2).alias("k2"), F.col("text").cast("binary").alias("text"))
        found = found.join(some(need), (F.col("k1") == F.col("need1")) & (F.col("k2") == F.col("need2"))).select(F.col("need_node").alias("node"), "text")
        return written(found.mapInArrow(tidy(shingles), "node long, shingles binary").dropDuplicates(["node"]))

    classes = similar_texts(texts.select("node", "fp", "bands", "sketch", "m"), sets, similarity).withColumnRenamed("node", "mine")
    rooted = texts.select("node", "best").join(classes, F.col("node") == F.col("mine"), "left")
    stay = rooted.groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("best").alias("best")).select("best.k1", "best.k2", F.lit(True).alias("stays"))
    times = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    fate = times.join(stay, ["k1", "k2"], "left").filter("stays IS NULL OR n > 1")
    fate = written(fate.select(F.col("k1").alias("mine1"), F.col("k2").alias("mine2"), "stays"))
    match = (F.col(key) == F.col("mine1")) & (F.col(key2) == F.col("mine2"))
    kept = keyed.join(some(fate.drop("stays")), match, "left_anti").select(*documents.columns)
    again = fate.filter("stays")
    if again.isEmpty():
        return kept
    nth = free_name(keyed, "nth")  # rows that stay, but repeat: the first of each
    once = keyed.join(some(again.drop("stays")), match, "left_semi")
    once = once.withColumn(nth, F.row_number().over(Window.partitionBy(key, key2).orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    return kept.unionByName(once.select(*documents.columns))
