"""Token counts by a two-tier lookup in the map stage: a compact table of the most frequent pre-tokens with how many tokens
each has is broadcast; what it lacks goes to a cache of the Python worker, and to the tokenizer the first time. Texts stay
where they are read: no pre-token is ever a row, and none is shuffled.

Frequent pre-tokens are found over the whole table. Every task keeps a summary of bounded size of the pre-tokens it sees
(counters, all of which are lowered when they are too many, so that whatever makes up more than 1 in SUMMARY of the pre-tokens
stays); summaries merge by the same rule, FAN at a time, until one is left. The table decides the time alone, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_output import _CLASS, PieceEncoder, _steps, encoder

#: Tokens from which a document is over the limit: more than these.
LIMIT = 2048
#: Pre-tokens in the broadcast table, and the longest of them in bytes: together its size's bound (2.4 MB with the counts).
FREQUENT, LONGEST = 1 << 15, 64
#: Counters of a task's summary, and summaries that one task merges.
SUMMARY, FAN = 1 << 16, 16
#: Pre-tokens outside the table whose counts a worker remembers; the older half goes when they are more.
CACHE = 300_000


def pieces_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts, one after the other, and where each text's begin and the last one's end. They end at white
    space and between ASCII letters and punctuation, where the tokenizer of PieceEncoder never joins."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, dtype=np.int64)
    kind = _CLASS[data]
    solid, begins = kind != 0, np.ones(len(data), dtype=bool)
    step = kind[1:] + 4 * kind[:-1]
    begins[1:] = (kind[:-1] == 0) | (step == 1 + 4 * 2) | (step == 2 + 4 * 1)
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    begins &= solid
    bounds = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data[solid])])
    return pieces, np.searchsorted(np.flatnonzero(begins), np.concatenate([[0], ends]))


class Summary:
    """Counters of the most frequent pre-tokens, at most size of them: what is left out was seen fewer than 1 in size times."""

    def __init__(self, size: int = SUMMARY, pieces: pa.Array | None = None, counts: np.ndarray | None = None):
        self.size = size
        self.pieces = pa.array([], pa.large_binary()) if pieces is None else pieces
        self.counts = np.zeros(0, dtype=np.int64) if counts is None else counts

    def add(self, pieces: pa.Array, counts: np.ndarray | None = None) -> None:
        """Adds pre-tokens, each once or as often as counts says."""
        met = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        weights = np.concatenate([self.counts, np.ones(len(pieces), dtype=np.int64) if counts is None else counts])
        total = np.bincount(met.indices.to_numpy(zero_copy_only=False), weights=weights, minlength=len(met.dictionary)).astype(np.int64)
        kept = met.dictionary
        if len(total) > self.size:
            total -= np.partition(total, -self.size - 1)[-self.size - 1]
            stay = np.flatnonzero(total > 0)
            kept, total = kept.take(pa.array(stay)), total[stay]
        self.pieces, self.counts = kept, total

    def row(self, part: int) -> dict:
        return {"part": part, "pieces": b" ".join(self.pieces.to_pylist()), "counts": self.counts.tobytes()}

    @classmethod
    def of(cls, size: int, pieces: bytes, counts: bytes) -> Summary:
        return cls(size, pa.array(pieces.split(), pa.large_binary()), np.frombuffer(counts, dtype=np.int64))


def frequent_pieces(documents: DataFrame, most: int = FREQUENT, size: int = SUMMARY, fan: int = FAN) -> list[bytes]:
    """The most frequent pre-tokens of the texts, of at most LONGEST bytes, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        summary = Summary(size)
        for batch in batches:
            for step in _steps(x.as_py() for x in batch.column(0)):
                pieces, _ = pieces_of(step)
                summary.add(pieces.filter(pc.less_equal(pc.binary_length(pieces), LONGEST)))
        if len(summary.pieces):
            yield pa.RecordBatch.from_pylist([summary.row(TaskContext.get().partitionId())])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Summary(size)
        for pieces, counts in pdf[["pieces", "counts"]].itertuples(index=False):
            one = Summary.of(size, pieces, counts)
            total.add(one.pieces, one.counts)
        return pd.DataFrame([total.row(int(pdf["part"].iloc[0]))])

    schema = "part long, pieces binary, counts binary"
    found = written(documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, schema))
    last = found.agg(F.max("part")).first()[0]
    while last:
        last //= fan
        found = written(found.withColumn("part", F.expr(f"part div {fan}")).groupBy("part").applyInPandas(merge, schema))
    top = found.first()
    if top is None:
        return []
    best = Summary.of(size, top["pieces"], top["counts"])
    order = np.argsort(-best.counts, kind="stable")[:most]
    return best.pieces.take(pa.array(order)).to_pylist()


class Lengths:
    """How many tokens texts have: the table of frequent pre-tokens first, then what this worker remembers, then the tokenizer.
    Texts that hold a special token go to the tokenizer whole."""

    def __init__(self, pieces: list[bytes], lengths: np.ndarray, tokenizer: PieceEncoder, limit: int = CACHE):
        self.table, self.lengths = pa.array(pieces, pa.large_binary()), lengths
        self.tokenizer, self.limit = tokenizer, limit
        self.known: dict[bytes, int] = {}
        self.encoded = 0

    def _missed(self, pieces: pa.Array) -> np.ndarray:
        met = pieces.dictionary_encode()
        distinct = met.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        if new:
            self.encoded += len(new)
            self.known.update(zip(new, self.tokenizer._encode_pieces(pa.array(new, pa.large_binary()))[1].tolist()))
        found = np.fromiter((self.known[p] for p in distinct), dtype=np.int64, count=len(distinct))
        if len(self.known) > self.limit:
            self.known = dict(list(self.known.items())[len(self.known) - self.limit // 2 :])
        return found[met.indices.to_numpy(zero_copy_only=False)]

    def count(self, texts: list[bytes]) -> np.ndarray:
        special = [any(s in t for s in self.tokenizer.special) for t in texts]
        pieces, at = pieces_of([b"" if s else t for t, s in zip(texts, special)])
        where = pc.index_in(pieces, value_set=self.table)
        held = where.is_valid().to_numpy(zero_copy_only=False)
        each = np.zeros(len(pieces), dtype=np.int64)
        each[held] = self.lengths[where.drop_null().to_numpy(zero_copy_only=False)]
        if not held.all():
            each[~held] = self._missed(pieces.filter(pc.is_null(where)))
        out = np.diff(np.concatenate([[0], np.cumsum(each)])[at])
        for i in np.flatnonzero(special):
            out[i] = len(self.tokenizer._whole([texts[i].decode()])[0])
        return out


_lengths: dict[str, tuple[Broadcast, Lengths]] = {}


def _lengths_of(table: Broadcast, path: str | None) -> Lengths:
    """The Python worker's lookup; it outlives a task, as the cache does."""
    if path not in _lengths or _lengths[path][0].value is not table.value:
        pieces, lengths = table.value
        _lengths[path] = (table, Lengths(pieces.split(), np.frombuffer(lengths, dtype=np.int64), encoder(path)))
    return _lengths[path][1]


class _Model:
    """A sentencepiece model; texts go to it whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[bytes]) -> np.ndarray:
        return np.array([len(x) for x in self.model.encode([t.decode() for t in texts], num_threads=1)], dtype=np.int64)


class _Whole:
    """A tokenizer whose pre-tokens cannot be told from the text alone; texts go to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[bytes]) -> np.ndarray:
        return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)], dtype=np.int64)


_others: dict[str, _Model | _Whole] = {}


def in_pieces(path: str | None) -> bool:
    """Whether the tokenizer's words end at white space and between letters and punctuation: its merges mark the ends of words,
    and its text has no mark for white space."""
    if path is None:
        return True
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    pattern = [p.get("pattern", {}).get("Regex", "") for p in (found.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return found["model"].get("end_of_word_suffix") == "</w>" and not found.get("truncation") and not found.get("padding") and any(p.endswith("[^\\s\\p{L}\\p{N}]+") for p in pattern)


def count_tokens(documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT, cache: int = CACHE) -> DataFrame:
    """Of each row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens), as the tokenizer's library counts
    the whole text, without begin, end, truncation or padding; special tokens inside a text are one token each, as is the
    library's default. tokenizer is the path of a .json of tokenizers or a .model of sentencepiece, by default
    word_bpe_49k.json; one whose pre-tokens cannot be told from the text alone gets whole texts, without a table.

    A null text counts as empty: no bytes and no tokens. Null ids and repeated rows are rows like others; an empty table
    gives no rows; columns besides doc_id and text are not looked at.
    """
    spark = documents.sparkSession
    two_tiers = in_pieces(tokenizer)
    if two_tiers:
        pieces = frequent_pieces(documents, frequent)
        lengths = encoder(tokenizer)._encode_pieces(pa.array(pieces, pa.large_binary()))[1] if pieces else np.zeros(0, dtype=np.int64)
        table = (b" ".join(pieces), lengths.astype(np.int64).tobytes())
        if len(pieces) > frequent or sum(map(len, table)) > frequent * (LONGEST + 9):
            raise ValueError("the table of frequent pre-tokens is larger than its bound")
        shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if two_tiers:
            counter = _lengths_of(shared, tokenizer)
            counter.limit = cache
        else:
            if tokenizer not in _others:
                _others[tokenizer] = _Whole(tokenizer) if tokenizer.endswith(".json") else _Model(tokenizer)
            counter = _others[tokenizer]
        for batch in batches:
            sizes, tokens = [], []
            for step in _steps(x.as_py() for x in batch.column(1)):
                sizes += [len(t) for t in step]
                tokens.append(counter.count(step))
            n = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
