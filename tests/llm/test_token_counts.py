import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from silvatrack.llm import token_counts as counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_force(rows, path=PATH):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        length = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        length = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    return sorted(repr((r[0], len((r[1] or "").encode()), length(r[1] or ""), length(r[1] or "") > 20)) for r in rows)


@pytest.mark.parametrize("how", [{}, {"frequent": 5, "cache": 7}, {"frequent": 0}])
def test_counts_equal_the_librarys(documents, rows, how):
    got = counts.count_tokens(documents, limit=20, **how)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_force(rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(documents, rows, name):
    path = public_tokenizers.path(name)
    assert not counts.in_pieces(path) and counts.in_pieces(PATH)
    got = counts.count_tokens(documents, path, limit=20)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_force(rows, path)


def test_long_text_and_texts_that_join_badly(spark):
    texts = ["it's don''t !!'s 's'S o'ne-two's", "a≮b ≠ ｆｕｌｌ", "Å̱ ǅ İI ß", "x y z\x1cw\x85v", "日本語、です", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftex", "word " * 300_000, "x" * 50_000, "\n" * 10_000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(table).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert [got[i] for i in range(len(texts))] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_table(nothing):
    assert counts.count_tokens(nothing).collect() == []


def test_the_most_frequent_pieces_are_found(spark):
    texts = [" ".join(["often"] * 60 + ["second"] * 30 + [f"rare{i}x{j}" for j in range(40)] + ["w" * 100] * 50) for i in range(64)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(20)
    found = counts.frequent_pieces(table, most=2, size=30, fan=3)
    assert found == [b"often", b"second"]  # nothing longer than LONGEST, however frequent


def test_a_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(0)
    draws = [b"p%d" % min(int(x), 5000) for x in rng.pareto(0.6, 20_000)]
    parts, size = [counts.Summary(50) for _ in range(4)], 50
    for i in range(0, len(draws), 500):
        parts[(i // 500) % 4].add(pa.array(draws[i : i + 500], pa.large_binary()))
    total = counts.Summary(size)
    for p in parts:
        again = counts.Summary.of(size, *(p.row(0)[n] for n in ("pieces", "counts")))
        total.add(again.pieces, again.counts)
    exact = {p: draws.count(p) for p in set(draws)}
    held = dict(zip(total.pieces.to_pylist(), total.counts.tolist()))
    assert len(held) <= size and all(p in held for p, n in exact.items() if n > len(draws) / size)
    assert all(n <= exact[p] <= n + len(draws) / size for p, n in held.items())


def test_the_tokenizer_is_asked_once(rows):
    texts = [(r[1] or "").encode() for r in rows]
    lookup = counts.Lengths([b"the", b"of"], np.array([1, 1]), counts.encoder(PATH))
    first = lookup.count(texts)
    asked = lookup.encoded
    assert (lookup.count(texts) == first).all() and lookup.encoded == asked and b"the" not in lookup.known
