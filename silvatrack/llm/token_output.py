"""Token files: documents in ascending doc_id order as token ids, in independent zstandard frames with a trailing index
and seek table, so that a reader decompresses only the frames of the documents it wants.

A file is, in this order (numbers are little-endian):
- frames: each a zstandard frame of token ids, unsigned 32-bit, of one or more whole documents;
- the index: a skippable frame (magic 0x184D2A5D) with an entry for each document: doc_id int64, has_id uint8 (0: the
  id is null), frame uint32, first uint32 (place of its first id in the frame), count uint32;
- the seek table: a skippable frame (magic 0x184D2A5E) as in the public seekable format: for each frame its compressed
  size, decompressed size and checksum (low 32 bits of the XXH64 of what it holds), uint32 each; then the number of
  frames uint32, a descriptor byte (0x80: with checksums) and the magic number 0x8F92EAB1.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shared_dir, tidy, written

END_ID = 2
#: Bytes of ids after which a frame ends; a longer document is a frame of its own.
FRAME_BYTES = 1 << 18
#: Bytes of text that are encoded at a time; a longer text is taken alone.
STEP_BYTES = 1 << 20
#: Distinct pieces of text whose ids a Python worker remembers (about 60 bytes each), and half of which it keeps when they are more.
CACHE = 300_000
#: Bytes of ids, and documents, after which a task begins a new file; a file's index is held until it ends.
FILE_BYTES, FILE_DOCS = 1 << 29, 4_000_000
#: Characters of a text that part rows of one id among tasks.
PREFIX = 16
#: Words that the tokenizer gets as one text.
JOINED = 1000
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("first", "<u4"), ("count", "<u4")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])

# Classes of bytes: white space, ASCII letters, ASCII punctuation but the apostrophe, all else.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(65, 91)) + list(range(97, 123))] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2
# Letters, ASCII's and Latin-1's: in any order they are one word.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class PieceEncoder:
    """Encodes texts with a tokenizer that splits its input at white space and between letters and punctuation before
    it merges: each distinct piece between such places is encoded once and remembered. Pieces keep apostrophes,
    digits and all that is not ASCII with their neighbours, since those can join across. Texts that hold a special
    token are encoded whole.

    Pieces of Latin letters alone are one word to the tokenizer, whose last id says that a word ends: many of these go to
    it as one text. What is remembered is kept as arrays, and met by Arrow's dictionary encoding; of over limit pieces,
    those that were met least lately go first, and those met once before others."""

    def __init__(self, path: str, limit: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._keep(pa.array([], pa.large_binary()), np.empty(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
        self.step = 0

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, met: np.ndarray, again: np.ndarray) -> None:
        """Remembers pieces: their ids one after the other, how many each has, when it was met, and whether more than once."""
        self.pieces, self.ids, self.sizes, self.met, self.again = pieces, ids, sizes, met, again

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        plain = pc.match_substring_regex(pieces.cast(pa.large_string()), _PLAIN)
        at, ids, sizes = plain.to_numpy(zero_copy_only=False), [], []
        words = pieces.filter(plain).to_pylist()
        for i in range(0, len(words), JOINED):
            found = np.array(self._whole([b" ".join(words[i : i + JOINED]).decode()])[0], dtype="<u4")
            ids.append(found)
            sizes.append(np.diff(np.flatnonzero(self.ends[found]), prepend=-1))
            if len(sizes[-1]) != len(words[i : i + JOINED]):
                raise ValueError("the tokenizer does not end each word of letters with an id of its own")
        others = pieces.filter(pc.invert(plain)).to_pylist()
        for i in range(0, len(others), JOINED):
            found = self._whole([p.decode() for p in others[i : i + JOINED]])
            ids.append(np.array([x for f in found for x in f], dtype="<u4"))
            sizes.append(np.array([len(f) for f in found], dtype=np.int64))
        if not sizes:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        flat, held = np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(np.concatenate([np.flatnonzero(at), np.flatnonzero(~at)]), kind="stable")
        return _gather(flat, held, order), held[order]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        joined = b"".join(texts)
        if any(s in joined for s in self.special):
            out = [np.array(self._whole([t.decode()])[0], dtype="<u4") if any(s in t for s in self.special) else self.encode([t])[0] for t in texts]
            return np.concatenate(out), np.array([len(o) for o in out], dtype=np.int64)
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not len(data):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        kind = _CLASS[data]
        begins = np.empty(len(data), dtype=bool)
        begins[0] = True
        step = kind[1:] + 4 * kind[:-1]
        begins[1:] = (kind[:-1] == 0) | (step == 1 + 4 * 2) | (step == 2 + 4 * 1)
        starts = ends[:-1]
        begins[starts[starts < len(data)]] = True
        solid = kind != 0
        begins &= solid
        at = np.flatnonzero(begins)
        bounds = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int64)
        here = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid])])
        known = len(self.pieces)
        found = pa.concat_arrays([self.pieces, here]).dictionary_encode()  # known pieces, being distinct, come first
        which = found.indices.to_numpy(zero_copy_only=False)[known:]
        new_ids, new_sizes = self._encode_pieces(found.dictionary.slice(known))
        ids, sizes = np.concatenate([self.ids, new_ids]), np.concatenate([self.sizes, new_sizes])
        out, each = _gather(ids, sizes, which), sizes[which]
        self._remember(found.dictionary, ids, sizes, np.flatnonzero(np.bincount(which, minlength=len(sizes))))
        total = np.concatenate([[0], np.cumsum(each)])
        return out, np.diff(total[np.searchsorted(at, np.concatenate([[0], ends]))])

    def _remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        known, self.step = len(self.pieces), self.step + 1
        again = np.concatenate([self.again, np.zeros(len(pieces) - known, dtype=bool)])
        again[used[used < known]] = True
        met = np.concatenate([self.met, np.zeros(len(pieces) - known, dtype=np.int64)])
        met[used] = self.step
        if len(pieces) > self.limit:
            stay = np.sort(np.lexsort((met, again))[len(pieces) - self.limit // 2 :])
            ids = _gather(ids, sizes, stay)
            pieces, sizes, met, again = pieces.take(pa.array(stay)), sizes[stay], met[stay], again[stay]
        self._keep(pieces, ids, sizes, met, again)


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat has sizes[i] numbers for each i, in order: those of each of which, one after the other."""
    first, held = np.cumsum(sizes) - sizes, sizes[which]
    total = np.cumsum(held)
    return flat[np.repeat(first[which] - (total - held), held) + np.arange(total[-1] if len(total) else 0)]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str | None, limit: int = CACHE) -> PieceEncoder:
    """The Python worker's encoder; it outlives a task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if (path, limit) not in _encoders:
        _encoders[path, limit] = PieceEncoder(path, limit)
    return _encoders[path, limit]


class TokenWriter:
    """Writes one file; out is an open binary file."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level).compress
        self.open: list[bytes] = []
        self.open_bytes, self.tokens = 0, 0
        self.entries: list[tuple] = []  # of the open frame
        self.index: list[bytes] = []
        self.docs = 0
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.open_bytes + len(ids) > FRAME_BYTES:
            self._end_frame()
        self.entries.append((doc_id or 0, doc_id is not None, len(self.frames), self.open_bytes // 4, len(ids) // 4))
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.tokens += len(ids) // 4
        self.docs += 1

    def _end_frame(self) -> None:
        import xxhash

        data = b"".join(self.open)
        packed = self.pack(data)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)
        self.index.append(np.array(self.entries, dtype=ENTRY).tobytes())
        self.open, self.open_bytes, self.entries = [], 0, []

    def close(self) -> None:
        if self.open:
            self._end_frame()
        index = b"".join(self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, dtype=SEEK).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenReader:
    """Reads a file that TokenWriter wrote; file must be seekable. Only the frames of the documents asked for are read."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        file.seek(size - 9 - n * SEEK.itemsize)
        self.frames = np.frombuffer(file.read(n * SEEK.itemsize), dtype=SEEK)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        file.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index where the frames end")
        self.index = np.frombuffer(file.read(length), dtype=ENTRY)

    def frame(self, i: int) -> np.ndarray:
        import xxhash
        import zstandard

        self.file.seek(int(self.offsets[i]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames["packed"][i])))
        if len(data) != self.frames["size"][i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames["checksum"][i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(data, dtype="<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents in order, or of those at the places wanted in the index."""
        held, ids = -1, None
        for i in range(len(self.index)) if wanted is None else wanted:
            e = self.index[i]
            if e["frame"] != held:
                held, ids = int(e["frame"]), self.frame(int(e["frame"]))
            yield (int(e["doc_id"]) if e["has_id"] else None), ids[e["first"] : e["first"] + e["count"]]


def _steps(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    step, held = [], 0
    for t in texts:
        if step and held + len(t or b"") > STEP_BYTES:
            yield step
            step, held = [], 0
        step.append(t or b"")
        held += len(t or b"")
    if step:
        yield step


def write_tokens(documents: DataFrame, to: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes documents as token files into the folder to, one for each range of doc_ids, and returns their table (kept
    in the shared folder): file_no (in order of doc_id), path, docs, tokens.

    A document's ids end with end_id; a null or empty text has that alone. Null ids come first; rows with the same id
    are ordered by their text, and parted among tasks by its first characters. A task begins a new file when one has
    grown to FILE_BYTES or FILE_DOCS. A task that runs twice writes its files twice, and the table names one of each.
    """
    spark = documents.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.left("text", F.lit(PREFIX)).cast("binary").alias("begin"))
    ordered = ordered.repartitionByRange(files or partitions(spark), "doc_id", "begin").drop("begin").sortWithinPartitions("doc_id", "text")
    tail = np.array([end_id], dtype="<u4").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        system, folder = fs.FileSystem.from_uri(to)
        writer, done = None, 0

        def begin() -> tuple:
            system.create_dir(folder, recursive=True)
            path = f"{folder}/part-{no:06d}-{done:04d}-{uuid.uuid4().hex}.tok"
            out = system.open_output_stream(path)
            return TokenWriter(out), out, path

        def end() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"file_no": [(no << 32) + done], "path": [path], "docs": [writer.docs], "tokens": [writer.tokens]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for step in _steps(x.as_py() for x in batch.column(1)):
                if writer is None:
                    writer, out, path = begin()
                flat, sizes = encoder(tokenizer).encode(step)
                raw, ends = flat.tobytes(), np.cumsum(sizes) * 4
                for i, e, n in zip(ids[at : at + len(step)], ends.tolist(), (sizes * 4).tolist()):
                    writer.add(i, raw[e - n : e] + tail)
                at += len(step)
                if writer.tokens * 4 >= FILE_BYTES or writer.docs >= FILE_DOCS:
                    yield end()
                    writer, done = None, done + 1
        if writer is not None:
            yield end()

    return written(ordered.mapInArrow(tidy(put), "file_no long, path string, docs long, tokens long"))


def read_tokens(table: DataFrame, to: str) -> DataFrame:
    """Reads the files that write_tokens wrote into the folder to; table is what it returned. Of each document: doc_id,
    start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit)."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(to)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(path) as file:
                    rows = [], [], [], []
                    for doc_id, ids in TokenReader(file, file.size()).documents():
                        for held, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))):
                            held.append(value)
                        start += len(ids)
                        if len(rows[0]) == 10_000:
                            yield _rows(rows)
                            rows = [], [], [], []
                    yield _rows(rows)

    def _rows(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = table.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, table.count())
    files = files.withColumn("at", (F.row_number().over(Window.orderBy("file_no")) - 1).cast("int"))
    return files.repartitionById(n, "at").select("path", "start").mapInArrow(tidy(get), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(documents: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, to: str | None = None) -> DataFrame:
    """Writes documents as token files and reads them back: doc_id, start, n_tokens and ids_crc32 of each row. An empty
    table gives no files and no rows."""
    to = to or f"{shared_dir(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(documents, to, tokenizer, end_id), to)
