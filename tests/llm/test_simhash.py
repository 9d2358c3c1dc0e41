import re
from collections import defaultdict

import numpy as np
import xxhash

from silvatrack.llm import simhash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    """Smallest member of each value's class, by comparing all pairs."""
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_documents_match_brute_force(documents, rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    classes = brute_classes(set(fps))
    ids = defaultdict(list)
    for r, f in zip(rows, fps):
        if r[0] is not None:
            ids[classes[f]].append(r[0])
    want = sorted(((r[0], f"{f:016x}", min(ids[classes[f]], default=None)) for r, f in zip(rows, fps)), key=str)
    assert got == want


def planted(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    near = [int(f) for f in fps[:300]]
    for f in list(near):
        for _ in range(3):
            flip = rng.choice(64, rng.integers(1, 6), replace=False)
            near.append(f ^ sum(1 << int(b) for b in flip))
    dense = [0xABCD0000FFFF1234 ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)]  # one large group of near copies
    return sorted({int(f) for f in fps} | set(near) | set(dense) | {0, 7, 2**64 - 1, 2**63})


def test_trie_join_finds_all_links_also_when_nodes_are_opened(spark):
    fps = planted()
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = brute_classes(fps)
    for node in (30_000, 40):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.trie_self_join(df, node).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        found = {(r.node % 2**64): r.root for r in simhash.components(spark.createDataFrame([(a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b) for a, b in links], "a long, b long")).collect()}
        classes, expected = defaultdict(set), defaultdict(set)
        for f in fps:
            classes[found.get(f, f - 2**64 if f >= 2**63 else f)].add(f)
            expected[want[f]].add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
