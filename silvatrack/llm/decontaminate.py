"""Benchmark decontamination: a hash set of the benchmark's word windows is broadcast to the scan of the documents;
what it lets through is verified by its words; contaminated documents, or their spans, are taken out.

All of it is DataFrame functions: the documents' windows are never rows, save those whose hash is in the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, free_name, words

#: Words in a window.
WINDOW = 10
#: A benchmark with more windows is not broadcast: hashes of windows are joined by a shuffle, and what they find is verified,
#: with the same result.
MAX_BROADCAST_WINDOWS = 100_000
#: Words of a window that are hashed first; the whole window only where these are in the set.
HEAD = 3


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, n_window, window): every n consecutive words of an item, once; an item of fewer words, but not none,
    is one window. A null text has no words."""
    w = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - k + 1)
    return (
        w.select("item_id", k.alias("n_window"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, k), " "))).alias("window"))
        .distinct()
    )


def _head(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(min(k, HEAD))])


def _literal(hashes: list[int]) -> str:
    return ",".join(f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for h in hashes)


def _candidates(w: str, k: int, heads: list[int] | None, wholes: list[int] | None) -> Column:
    """The windows of k words in the array column w, as structs of their first word's place, length and words; with
    hashes given, only windows whose hashes are among them (a hash set after optimisation)."""
    n = F.size(w)
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    if heads is not None:
        p = min(k, HEAD)
        head = ", ".join(f"get({w}, i + {j})" for j in range(p))
        held = f"xxhash64({head}) IN ({_literal(heads)}) AND xxhash64(slice({w}, i + 1, {k})) IN ({_literal(wholes)})"
        places = F.expr(f"filter(CASE WHEN size({w}) >= {k} THEN sequence(0, size({w}) - {k}) ELSE cast(array() AS array<int>) END, i -> {held})")
    return F.transform(
        places,
        lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.array_join(F.slice(w, i + 1, k), " ").alias("window")),
    )


def find_hits(
    documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS
) -> DataFrame:
    """(doc_id, text_key, pos, len, item_id): each verified window of each document, with each item that has it.

    text_key is a hash of the text: rows that share doc_id and text have the same hits, and get them once.
    """
    table = item_windows(benchmark, n)
    counts = {r["n_window"]: r["n"] for r in table.groupBy("n_window").agg(F.count_distinct("window").alias("n")).collect()}
    small = sum(counts.values()) <= max_broadcast
    sets: dict[int, tuple[list[int], list[int]]] = {}
    if small:
        split = F.split("window", " ")
        hashed = table.select("n_window", "window").distinct().select("n_window", split.alias("w")).select(
            "n_window",
            F.xxhash64("w").alias("whole"),
            F.when(F.size("w") == 1, F.xxhash64(F.get("w", F.lit(0)))).when(F.size("w") == 2, F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)))).otherwise(_head(F.col("w"), F.lit(0), HEAD)).alias("head"),
        )
        for r in hashed.groupBy("n_window").agg(F.collect_set("whole").alias("whole"), F.collect_set("head").alias("head")).collect():
            sets[r["n_window"]] = (r["head"], r["whole"])
    spread = documents.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    if not small:
        return _large_hits(spread, table, sorted(counts))
    none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
    found = [_candidates("w", k, *sets.get(k, (None, None))) for k in sorted(counts)]
    rows = spread.select("doc_id", "text_key", F.explode(F.concat(none, *found)).alias("c")).select("doc_id", "text_key", "c.*")
    table = table.select("window", "item_id")
    return rows.join(F.broadcast(table), "window").drop("window")


def _large_hits(spread: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """find_hits of a benchmark whose windows are not broadcast: of each window of a document only its place and hash go to the
    shuffle; words go there of windows whose hash an item has."""
    none = F.array().cast("array<struct<pos:int,len:int,hash:bigint>>")

    def places(k: int) -> Column:
        every = F.expr(f"CASE WHEN size(w) >= {k} THEN sequence(0, size(w) - {k}) ELSE cast(array() AS array<int>) END")
        return F.transform(every, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.xxhash64(F.slice("w", i + 1, k)).alias("hash")))

    hashed = spread.select("doc_id", "text_key", F.explode(F.concat(none, *map(places, lengths))).alias("c")).select("doc_id", "text_key", "c.*")
    known = table.select(F.col("n_window").alias("len"), F.xxhash64(F.split("window", " ")).alias("hash")).distinct()
    found = hashed.join(known, ["len", "hash"]).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
    back = spread.dropDuplicates(["doc_id", "text_key"]).join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    rows = back.select("doc_id", "text_key", "w", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.pos", "s.len", F.array_join(F.slice("w", F.col("s.pos") + 1, F.col("s.len")), " ").alias("window"))
    return rows.join(table.select("window", "item_id"), "window").drop("window")


def _covered(spans: Column) -> Column:
    """Places inside at least one of the spans, structs of (pos, len)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = (s["pos"] + s["len"]).cast("long")
        return F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(s["pos"].cast("long"), a["end"]))).alias("n"),
            F.greatest(a["end"], end).alias("end"),
        )

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Of each row of documents: doc_id, n_words, n_hit (words inside a window that an item has), n_items,
    items_sha256 and contaminated (n_hit > 0), with text_key and spans (array of pos, len; null if none).

    Null and empty texts have no words and no hits. Rows that repeat give a row each. A null doc_id is like any other;
    items with a null id count as one item, of an empty name. Further columns of the input are not looked at.
    """
    hits = find_hits(documents, benchmark, n, max_broadcast).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("pos", "len")).alias("spans"),
        F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"),
    )
    hits = hits.select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    base = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), "text_key", "spans",
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """documents, all its columns, without what the benchmark's items share with it.

    remove="documents" drops each row with a hit; remove="spans" keeps every row and takes the hit words, with what
    stands between them, from its text. Rows without a hit are as they were.
    """
    hits = find_hits(documents, benchmark, n, max_broadcast)
    key, doc, hid = free_name(documents, "text_key"), free_name(documents, "hit_id"), free_name(documents, "hit_key")
    keyed = documents.withColumn(key, F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(hid))
    if remove == "documents":
        return keyed.join(hits.select(F.col("doc_id").alias(doc), F.col("text_key").alias(hid)).distinct(), match, "left_anti").drop(key)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    spans = free_name(documents, "spans")
    grouped = hits.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(hid)).agg(F.collect_set(F.struct("pos", "len")).alias(spans))
    # One piece for each word, with what follows it; what stands before the first word joins none of them.
    inside = NOT_WORD[1:-2].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    body = F.regexp_replace("text", f"^[{inside}]+", "")
    pieces = F.split(body, f"(?<=[{inside}])(?=[^{inside}])")
    kept = F.filter(pieces, lambda p, i: ~F.exists(F.col(spans), lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"])))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    out = [text.alias(c) if c == "text" else F.col(c) for c in documents.columns]
    return keyed.join(grouped, match, "left").select(*out)
