"""Merkle trees of documents: lines are paragraphs, runs of paragraphs are sections, and the root stands for the text.

Equal roots mean equal texts. Where roots differ, a comparison goes down only into sections and paragraphs whose
digests differ, and there into phrases (runs of some bytes that end where a hash of the last few says so, so that an edit
moves no bounds further on); this locates the edits and gives a likeness. Phrases are hashed only where they are asked
for, since most paragraphs are equal or not compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

#: A section ends at an empty paragraph, or at one whose digest's first byte is divisible by this.
SECTION = 8
#: A phrase ends where the hash of its last LAST bytes (a power of two) is divisible by PHRASE (another), and after LONGEST bytes.
PHRASE, LONGEST, LAST = 16, 16, 8
#: Characters of a text that part rows of one id among tasks.
PREFIX = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, i, 2**64) for i in range(LONGEST)], dtype=np.uint64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """The tree of one text: paragraphs and their digests, sections (first paragraph, past the last, digest), root."""

    __slots__ = ("paragraphs", "leaves", "sections", "root", "size", "_all")

    def __init__(self, text: bytes):
        self.size, self._all = len(text), None
        self.paragraphs = text.split(b"\n")
        self.leaves = [_digest(p) for p in self.paragraphs]
        self.sections, start = [], 0
        for i, (p, d) in enumerate(zip(self.paragraphs, self.leaves)):
            if not p or d[0] % SECTION == 0 or i == len(self.leaves) - 1:
                self.sections.append((start, i + 1, _digest(b"".join(self.leaves[start : i + 1]))))
                start = i + 1
        self.root = _digest(b"".join(s[2] for s in self.sections))

    def phrases(self, paragraphs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(paragraphs) < len(self.paragraphs):
            return phrases([self.paragraphs[i] for i in paragraphs])
        if self._all is None:
            self._all = phrases(self.paragraphs)
        return self._all

    def hex(self) -> str:
        return self.root.hex()


def _unmatched(a: list[bytes], b: list[bytes]) -> tuple[list[int], list[int]]:
    """Places in a and in b that are left when equal digests are paired off, in order."""
    spare = Counter(b)
    left = []
    for i, d in enumerate(a):
        if spare[d] > 0:
            spare[d] -= 1
        else:
            left.append(i)
    used = Counter(b) - spare
    right = []
    for j, d in enumerate(b):
        if used[d] > 0:
            used[d] -= 1
        else:
            right.append(j)
    return left, right


def differing(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """The paragraphs of a and of b that the other does not have, by going down differing branches only."""
    if a.root == b.root:
        return [], []
    sa, sb = _unmatched([s[2] for s in a.sections], [s[2] for s in b.sections])
    pa_ = [i for s in sa for i in range(a.sections[s][0], a.sections[s][1])]
    pb = [j for s in sb for j in range(b.sections[s][0], b.sections[s][1])]
    left, right = _unmatched([a.leaves[i] for i in pa_], [b.leaves[j] for j in pb])
    return [pa_[i] for i in left], [pb[j] for j in right]


def phrases(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of some paragraphs, each once, and how many bytes they hold in all."""
    data = np.frombuffer(b"".join(paragraphs), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h, n = data.astype(np.uint32), 1
    while n < min(LAST, len(data)):  # sums over twice as many bytes each time
        h[n:] = h[n:] + h[:-n] * np.uint32(_POWERS[n] & np.uint64(0xFFFFFFFF))
        n *= 2
    ends = (h * np.uint32(0x9E3779B1)) >> np.uint32(20) & np.uint32(PHRASE - 1) == 0
    lengths = np.array([len(p) for p in paragraphs if p])
    past = np.cumsum(lengths)
    ends &= np.arange(len(data)) - np.repeat(past - lengths, lengths) >= LAST - 1  # bytes of one paragraph alone
    ends[past - 1] = True
    at = np.flatnonzero(ends) + 1
    starts = np.append(0, at[:-1])
    cuts = -(-(at - starts) // LONGEST)  # a long stretch is cut from its beginning
    first = np.repeat(starts, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    sizes = np.diff(np.append(first, len(data)))
    place = np.arange(len(data)) - np.repeat(first, sizes)
    hashes = np.add.reduceat((data + np.uint64(1)) * _POWERS[place], first)  # bytes as numbers of 64 bits, times powers
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _ODD
    found, which = np.unique(hashes, return_inverse=True)
    return found, np.bincount(which, weights=sizes).astype(np.int64)


def likeness(a: Tree, b: Tree) -> float:
    """1 if the roots are equal; else twice the bytes that matched sections, paragraphs and phrases share, by the bytes of
    both: 0 if nothing matches."""
    if a.root == b.root:
        return 1.0
    if not a.size or not b.size:
        return 0.0
    left, right = differing(a, b)
    weigh = lambda t, skip: sum(map(len, t.paragraphs)) - sum(len(t.paragraphs[i]) for i in skip)
    shared = weigh(a, left)
    (one, n), (two, m) = a.phrases(left), b.phrases(right)
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    shared += int(np.minimum(n[i], m[j]).sum())
    total = sum(map(len, a.paragraphs)) + sum(map(len, b.paragraphs))
    return min(1.0, 2.0 * shared / total) if total else 0.0


def fingerprint_edits(documents: DataFrame, files: int | None = None) -> DataFrame:
    """Of each row: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (32 hex digits each),
    near_edited and near_next. The edited text is the text with its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's, in descending order of doc_id; after the last comes the first.

    Null texts are empty. Null ids come last, rows with one id are ordered by text (null as empty) and parted among tasks
    by its first characters; a row that repeats is its own next. A lone row's next is itself. Texts are sorted once, by ranges of ids; each task hands the row at
    either end of its range to a second, small join.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    rows = rows.repartitionByRange(files or partitions(documents.sparkSession), order[0], F.left("text", F.lit(PREFIX))).sortWithinPartitions(*order)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, task int, place string, end_text string"
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def one(doc_id, text: str, tree: Tree, after: str, after_tree: Tree) -> tuple:
        n = len(text)
        k = n // 3
        edited = (text[: n - k] + after[:k]).encode()
        new = Tree(edited)
        return doc_id, n, hashlib.sha256(edited).hexdigest(), tree.hex(), new.hex(), likeness(tree, new), likeness(tree, after_tree)

    def pack(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(columns, types)], names + ["task", "place", "end_text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, id_type = None, None
        for b in batches:
            id_type, out = b.schema.field(0).type, []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                tree = Tree(text.encode())
                if held is None:
                    out.append((doc_id, *[None] * 6, task, "first", text))
                else:
                    out.append((*one(*held, text, tree), task, "row", None))
                held = doc_id, text, tree
                if len(out) == 2000:
                    yield pack(out, id_type)
                    out = []
            if out:
                yield pack(out, id_type)
        if held is not None:
            yield pack([(held[0], *[None] * 6, task, "last", held[1])], id_type)

    done = written(rows.mapInArrow(each, schema))
    tasks = done.filter("place <> 'row'").groupBy("task").agg(
        F.max(F.when(F.col("place") == "first", F.col("end_text"))).alias("first_text"),
        F.max(F.when(F.col("place") == "last", F.struct("doc_id", "end_text"))).alias("last"),
    )
    # One row for each task: its last row meets the first of the next task that has rows, by a join on their ranks.
    numbers = sorted(r["task"] for r in done.filter("place = 'first'").select("task").collect())
    follow = documents.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "task int, next_task int")
    ends = tasks.join(follow, "task").select("next_task", "last")
    ends = ends.join(tasks.select(F.col("task").alias("next_task"), "first_text"), "next_task").select("last.doc_id", F.col("last.end_text").alias("text"), "first_text")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                out.append((*one(r["doc_id"], r["text"], Tree(r["text"].encode()), r["first_text"], Tree(r["first_text"].encode())), 0, "row", None))
            if out:
                yield pack(out, b.schema.field(0).type)

    return done.filter("place = 'row'").select(*names).unionByName(ends.mapInArrow(last, schema).select(*names))
