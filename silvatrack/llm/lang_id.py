"""Language identification: a text's letters are cut into subwords of two to four bytes, hashed to rows of an embedding
table; the mean of the rows goes through a linear layer and a softmax. The model is trained here, by stochastic gradient
descent in numpy, on a bounded sample of labelled rows; its scores are calibrated on rows kept out of the training,
which also set the score below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, give_back, tidy, unit_hash

BITS = 15
BUCKETS = 1 << BITS
DIM = 16
#: About how many labelled rows train and calibrate the model, shared evenly among the languages; of more languages than
#: that, each has a row.
MAX_ROWS = 2400
#: Up to so many labels their table is broadcast; more are joined by a shuffle.
MAX_BROADCAST_LANGS = 10_000
#: Share of the sampled rows kept for calibration.
HELD = 0.2
#: Share of rightly predicted calibration rows that the rejection may cost.
REJECT_SHARE = 0.001
#: No score from this up is rejected.
REJECT_MOST = 0.5
#: Bytes of a text that are counted at a time.
STEP = 1 << 20
UNKNOWN = "und"

_FOLD = np.full(256, 32, dtype=np.uint8)  # what is not a letter becomes a space
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end at a space where there is one."""
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def count_subwords(text: bytes) -> np.ndarray:
    """How often each bucket has a subword of the text: runs of 2 to 4 bytes that have a space at most at either end."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for piece in _pieces(text):
        a = np.empty(len(piece) + 2, dtype=np.uint8)
        a[0] = a[-1] = 32
        a[1:-1] = _FOLD[np.frombuffer(piece, dtype=np.uint8)]
        solid = a != 32
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = solid[1:] | solid[:-1]
        a, solid = a[keep].astype(np.uint32), solid[keep]
        h = a[:-1] * np.uint32(257) + a[1:]
        grams = [h * np.uint32(2654435761)]
        if len(a) > 2:
            h = h[:-1] * np.uint32(8191) + a[2:]
            grams.append((h * np.uint32(2246822519))[solid[1:-1]])
        if len(a) > 3:
            h = h[:-1] * np.uint32(131071) + a[3:]
            grams.append((h * np.uint32(3266489917))[solid[1:-2] & solid[2:-1]])
        total += np.bincount(np.concatenate(grams) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return total


@dataclass
class Model:
    """langs in order; emb: each bucket's row; out: the linear layer; bias; temperature; threshold: scores below it are rejected."""

    langs: list[str]
    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self):
        # Of few languages, each bucket's score for each is fewer numbers than its row.
        self.table = self.emb @ self.out if len(self.langs) < DIM else None

    def logits(self, counts: np.ndarray) -> np.ndarray:
        n = max(1, int(counts.sum()))
        if self.table is not None:
            return counts.astype(np.float32) @ self.table / n + self.bias
        return counts.astype(np.float32) @ self.emb / n @ self.out + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        z = self.logits(count_subwords(text)).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        i = int(p.argmax())
        return self.langs[i], float(p[i] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], held: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 2.0, seed: int = 1) -> Model | None:
    """rows and held have (lang, buckets, counts); held are for calibration. None if there are no rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    number = {l: i for i, l in enumerate(langs)}
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)

    def dense(part: list) -> np.ndarray:
        x = np.zeros((len(part), BUCKETS), dtype=np.float32)
        for i, (_, at, n) in enumerate(part):
            x[i, at] = n / n.sum()
        return x

    steps, done = epochs * ((len(rows) + batch - 1) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = [rows[j] for j in order[i : i + batch]]
            lr = rate * (1 - done / steps)
            done += 1
            x = dense(part)
            mean = x @ emb
            p = _softmax(mean @ out + bias)
            p[np.arange(len(part)), [number[r[0]] for r in part]] -= 1
            p /= len(part)
            grad = mean.T @ p
            # A bucket's share of a text is small, so its row moves by a rate scaled up by the usual count of buckets.
            emb -= lr * 100 * (x.T @ (p @ out.T))
            out -= lr * grad
            bias -= lr * 0.1 * p.sum(axis=0)
    model = Model(langs, emb, out, bias, 1.0, 0.0)
    check = [r for r in held if r[0] in number]
    if check:
        z = np.stack([r[2] @ emb[r[1]] / r[2].sum() @ out + bias for r in check]).astype(np.float64)
        y = np.array([number[r[0]] for r in check])
        grid = np.geomspace(0.25, 8, 81)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            model.threshold = float(min(REJECT_MOST, np.quantile(right, REJECT_SHARE)))
    return model


def held_out() -> Column:
    """True for rows that the model never learns from: crc32 of doc_id as text, mod 4, is 2; a null id has none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame, max_rows: int = MAX_ROWS, seed: int = 1) -> Model | None:
    """Learns from text and lang of rows that are not held_out() and have both and an id: every label that any has. The sample
    is chosen by hashes of the ids; of it, only bucket counts reach the driver (at most 2 ** 15 a row)."""
    labelled = documents.select("doc_id", F.col("text").alias("text"), F.col("lang").alias("lang"), held_out().alias("out")).filter(
        "NOT out AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return None
    quota = max(1, max_rows // n_langs)
    # A few more than asked for pass the hash, so that every label has its share; of these the first are taken.
    shares = counts.select(F.col("lang").alias("of"), ((quota + 4 * quota**0.5 + 10) / F.col("n")).alias("share"))
    shares = F.broadcast(shares) if n_langs <= MAX_BROADCAST_LANGS else shares

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(2):
                counts = count_subwords(t.as_py())
                at.append(np.flatnonzero(counts).astype(np.int32))
                n.append(counts[at[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))],
                ["pick", "lang", "at", "n"],
            )

    sample = labelled.withColumn("pick", unit_hash("doc_id", F.lit(seed))).join(shares, F.col("lang") == F.col("of")).filter(F.col("pick") < F.col("share"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))
    sample = sample.select("pick", "lang", F.col("text").cast("binary").alias("text")).withColumn("nth", first).filter(F.col("nth") <= quota)
    sample = sample.select("pick", "lang", "text").mapInArrow(tidy(features), "pick double, lang string, at array<int>, n array<float>")
    rows = []
    for batch in sample.orderBy("pick").toArrow().to_batches():  # as arrays: a number costs four bytes
        lang, bounds = batch.column("lang").to_pylist(), batch.column("at").offsets.to_numpy()
        at, n = (batch.column(c).values.to_numpy() for c in ("at", "n"))
        rows += [(lang[i], at[s:e].copy(), n[s:e].copy()) for i, (s, e) in enumerate(zip(bounds, bounds[1:])) if e > s]
    learned, rest = split(rows, seed)
    return train(learned, rest, seed=seed)


def split(rows: list, seed: int = 1) -> tuple[list, list]:
    """Rows to learn from, and a share HELD of all rows to calibrate on. A label's first row is always learned from, so a label of one row
    is calibrated on none."""
    keep = max(1, int(len(rows) * (1 - HELD)))
    first: dict = {}
    for i, r in enumerate(rows):
        first.setdefault(r[0], i)
    only = set(first.values())
    order = np.random.default_rng(seed).permutation(len(rows))
    order = [*sorted(only), *[i for i in order if i not in only]]
    keep = max(keep, len(only))
    return [rows[i] for i in order[:keep]], [rows[i] for i in order[keep:]]


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents, all its columns, with held_out, lang_pred, score (0 to 1) and rejected (names taken get underscores).

    A null text, or one without a letter, is "und" with score 0 and rejected; so is every text when there is no model
    (no labelled rows). Otherwise lang_pred is the likeliest learned label, the first by name among equals; rejected
    says that the calibrated score is below the model's threshold. Whole texts are read, in pieces of bounded size.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [(UNKNOWN, 0.0) if shared.value is None else shared.value.predict(t.as_py()) for t in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    names = [free_name(documents, n) for n in ("held_out", "lang_pred", "score", "rejected")]
    p = free_name(documents, "prediction")
    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    least = model.threshold if model else 1.0
    out = documents.withColumn(p, predict(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    return out.select(
        *documents.columns, held_out().alias(names[0]), F.when(letter, F.col(p)["lang"]).otherwise(UNKNOWN).alias(names[1]),
        F.when(letter, F.col(p)["score"]).otherwise(0.0).alias(names[2]), (~letter | (F.col(p)["score"] < least)).alias(names[3]),
    )
