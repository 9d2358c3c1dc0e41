import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from silvatrack.llm import merkle, mixing, sharding


def test_targets_stop_at_the_cap_and_add_up():
    sizes = [("b", 10), ("a", 1000), (None, 500), ("é", 300), ("z", 7)]
    got = mixing.source_targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 1817)
    assert got["b"] == 20 and all(got[s] <= 2 * n + 1e-9 for s, n in sizes)
    free = {s: got[s] / w for (s, n), w in zip(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")), [5, 2, 1, 5, 2]) if got[s] < 2 * n - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6
    assert mixing.source_targets([]) == {} and mixing.source_targets([("a", 0)]) == {"a": 0.0}


def test_pivotal_keeps_the_sum_and_the_expectation():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 50) for _ in range(40)]
    taken = np.zeros(40)
    for _ in range(2000):
        out = mixing.pivotal([0.3] * 40, sizes, [rng.random() for _ in sizes], True)
        assert set(out) <= {0.0, 1.0}
        assert abs(sum(p * a for p, a in zip(out, sizes)) - 0.3 * sum(sizes)) <= max(sizes)
        taken += out
    assert np.abs(taken / 2000 - 0.3).max() < 0.06


@pytest.mark.parametrize("block", [4096, 3])
def test_mix_by_source(documents, rows, block):
    got = mixing.mix(documents, block=block).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, count(r[1])) for r in rows)
    by, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        by[r[3]] += count(r[1])
        largest[r[3]] = max(largest[r[3]], count(r[1]))
    want = mixing.source_targets(list(by.items()))
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[round(r.target, 6)] += r.taken
    for s, t in want.items():
        assert abs(taken[round(t, 6)] - t) <= largest[s]
    again = mixing.mix(documents.repartition(5), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_without_the_driver(spark, documents, monkeypatch):
    for weights in ((5.0, 2.0, 1.0), (1.0,)):
        for sizes in ([("b", 10), ("a", 1000), (None, 500), ("é", 300), ("z", 7)], [(f"s{i}", i * i % 97) for i in range(200)], [("a", 0)], [("a", 5)]):
            want = mixing.source_targets(sizes, weights)
            table = spark.createDataFrame([(s, n, 1) for s, n in sizes], "of string, n long, docs long")
            assert {r.of: r.target for r in mixing.spread_targets(table, weights).collect()} == pytest.approx(want)
    assert mixing.spread_targets(spark.createDataFrame([], "of string, n long, docs long")).collect() == []
    want = sorted((str(r.doc_id), r.taken, round(r.target, 6)) for r in mixing.mix(documents).collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    assert sorted((str(r.doc_id), r.taken, round(r.target, 6)) for r in mixing.mix(documents).collect()) == want


def test_rows_that_repeat_are_taken_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    docs = spark.createDataFrame([(1, "the same words", "a", 5)] * 40 + [(i, f"word {i}", "a", 5) for i in range(2, 30)] + [(50, "", "b", 5)] * 9, "doc_id long, text string, source string, rows int")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.take(docs).collect()) == +want and want[1] > 40


def test_take_repeats_rows(documents, nothing):
    decided = mixing.mix(documents)
    want = sorted(str(r.doc_id) for r in decided.collect() for _ in range(r.copies))
    out = mixing.take(documents)
    assert out.columns == documents.columns and sorted(str(r.doc_id) for r in out.collect()) == want
    assert mixing.take(nothing).collect() == [] and mixing.mix(nothing).collect() == []


def test_differencing_beats_greedy_dealing():
    rng = np.random.default_rng(2)
    sizes = rng.lognormal(6, 1, 400).astype(np.int64)
    sums = np.zeros((400, 16), dtype=np.int64)
    sums[:, 0] = sizes
    became, total = sharding.differencing(sums)
    loads = np.bincount(became[:, 0], weights=sizes, minlength=16).astype(np.int64)
    assert sorted(loads) == sorted(total) and sorted(became[5]) == list(range(16))
    greedy = np.zeros(16)
    for s in sorted(sizes)[::-1]:
        greedy[greedy.argmin()] += s
    assert np.ptp(loads) <= np.ptp(greedy)


@pytest.mark.parametrize("block", [4096, 5])
def test_shards(documents, rows, nothing, block):
    got = sharding.shard_documents(documents, block=block, cell=7).collect()
    text = lambda r: (r[1] or "").encode()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((r[0] or -1, len(text(r)) + 1, zlib.crc32(text(r))) for r in rows)
    shards, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        by_text[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_documents(nothing).collect() == []


def test_hot_texts_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    rows = [(1, None)] * 60 + [(2, "")] * 30 + [(3, "hot text")] * 50 + [(i, f"text {i % 30}") for i in range(10, 110)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell=10).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len({r.shard for r in got if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in got})


def test_shards_come_out_near_equal(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(50 + pmod(xxhash64(id), 3000) as int)) || id AS text")
    loads = [r[0] for r in sharding.shard_documents(docs, block=512).groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 0.0005 * sum(loads) / 16


def test_sharding_keeps_three_tables_of_one_block(spark, monkeypatch):
    """Each file of a kept table costs a process on a local disk; rows, dealt groups and placed rows are what is read again."""
    kept, keep = [], sharding.written
    monkeypatch.setattr(sharding, "written", lambda df: kept.append(df.columns) or keep(df))
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id % 7 = 0, null, 'text ' || id % 90) AS text")
    got = sharding.shard_documents(docs, cell=10).collect()
    assert len(kept) == 3 and len(got) == 300
    by_text = defaultdict(set)
    for r in got:
        by_text[None if r.doc_id % 7 == 0 else r.doc_id % 90].add(r.shard)
    assert len(by_text) == 91 and all(len(s) == 1 for s in by_text.values())


def test_merkle_rows(documents, rows, nothing):
    got = merkle.fingerprint_edits(documents).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = (t[: len(t) - k] + after[:k]).encode()
        a, b, c = merkle.Tree(t.encode()), merkle.Tree(edited), merkle.Tree(after.encode())
        want.append((i, len(t), hashlib.sha256(edited).hexdigest(), a.hex(), b.hex(), merkle.likeness(a, b), merkle.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert merkle.fingerprint_edits(nothing).collect() == []
    assert len(merkle.fingerprint_edits(documents.limit(1)).collect()) == 1


def test_merkle_trees_locate_edits():
    lines = [f"paragraph {i} has some words, and more of them. End {i * i}" for i in range(60)]
    a = merkle.Tree("\n".join(lines).encode())
    b = merkle.Tree("\n".join(lines[:20] + ["something else"] + lines[21:] + ["one more"]).encode())
    assert merkle.differing(a, b) == ([20], [20, 60])
    assert merkle.differing(a, a) == ([], []) and merkle.likeness(a, a) == 1.0
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.Tree(b"")) == 0.0
    assert merkle.Tree(b"").hex() == merkle.Tree(b"").hex() != merkle.Tree(b"\n").hex()


def brute_phrases(paragraph):
    out, start = [], 0
    for i in range(len(paragraph)):
        h = sum(paragraph[i - j] * pow(0x100000001B3, j, 2**32) for j in range(8)) % 2**32 if i >= 7 else None
        ends = h is not None and (h * 0x9E3779B1 % 2**32 >> 20) % 16 == 0
        if ends or i - start + 1 == 16 or i == len(paragraph) - 1:
            out.append(paragraph[start : i + 1])
            start = i + 1
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    one, two = Counter(a.split(b"\n")), Counter(b.split(b"\n"))
    weigh = lambda c: sum(len(x) * n for x, n in c.items())
    shared = weigh(one & two)
    phrases = [Counter(y for x in c.elements() for y in brute_phrases(x)) for c in (one - two, two - one)]
    total = weigh(one) + weigh(two)
    return 2 * (shared + weigh(phrases[0] & phrases[1])) / total if total else 0.0


def test_likeness_against_brute_force(rows):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé#%☃") for _ in range(rng.randrange(1, 9)))
    texts = [r[1] or "" for r in rows]
    texts += ["eux### de%%% les&&& " * 40, "x" * 500, " ".join(word() for _ in range(300)), "\n".join(word() for _ in range(200)), "", "\n", "ab"]
    for t in texts:
        for after in (rng.choice(texts), texts[-5]):
            k = len(t) // 3
            edited = t[: len(t) - k] + after[:k]
            for other in (edited, after):
                a, b = t.encode(), other.encode()
                assert merkle.likeness(merkle.Tree(a), merkle.Tree(b)) == pytest.approx(brute_likeness(a, b), abs=1e-12)
            if len(t) >= 200 and t != after:
                near = merkle.likeness(merkle.Tree(t.encode()), merkle.Tree(edited.encode()))
                assert near > 0.5 and (near > merkle.likeness(merkle.Tree(t.encode()), merkle.Tree(after.encode())) or t in after or after in t)


def test_very_many_equal_rows_are_rounded_in_blocks(spark):
    from pyspark.sql import functions as F

    from silvatrack.llm import mixing

    equal = spark.range(6000).selectExpr("7L AS doc_id", "'one two three' AS text", "'a' AS source")
    others = spark.range(500).selectExpr("id + 100 AS doc_id", "concat('word ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    docs = equal.unionByName(others)
    got = mixing.mix(docs, weights=(1.0, 2.0), share=0.5, block=256)
    sums = {r.source_size: (r.taken, r.target) for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert got.count() == 6500 and all(abs(taken - target) < 3 + 1e-6 for taken, target in sums.values())
    again = mixing.mix(docs.repartition(7), weights=(1.0, 2.0), share=0.5, block=256)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "taken", "copies").collect())
    assert key(got) == key(again)
    numbered = mixing._numbered(mixing.written(docs.withColumns({"row_key": F.xxhash64("doc_id"), "row_key2": F.xxhash64("text")})))
    assert [r.nth for r in numbered.filter("doc_id = 7").orderBy("nth").collect()] == list(range(6000))
    assert numbered.filter("doc_id <> 7").agg(F.max("nth")).first()[0] == 0
