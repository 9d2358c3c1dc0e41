import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from silvatrack.llm import prefix_trie as trie
from silvatrack.llm import queries
from silvatrack.llm.conversations import number_turns, prefix_sums

SCHEMA = "conv_id long, turn long, role string, text string, parent string, Depth int"


def talk(seed: int = 1) -> list[tuple]:
    """Conversations that share beginnings, with nulls in any column, gaps, turns of one number, repeated rows, long ones, and
    columns with the operator's own names."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 37), 41, 42, 49, 103, -7, -5]:
        if c in (10, 22, 36):
            continue
        n = 60 if c == 25 else rng.choice([1, 1, 2, 3, 4, 7, 12])
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["a", "bé", "", None, "longer text " * 9]), "p", 1) for t in range(n)]
    same = [(t, ("user", "assistant")[t % 2], f"t{t}") for t in range(5)]
    rows += [(200 + 5 * i, *s, None, None) for i in range(20) for s in same[: 1 + i % 5]]
    return rows + [rows[3], rows[3], (None, 0, "user", "no id", "p", 2), (None, None, None, None, None, None)]


def brute_force(rows: list[tuple]) -> list[tuple]:
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def sums(p):
        parts = [sums(k) for k in children[p]]
        last = len(p[-1][1].encode()) if p else 0
        return (sum(x[0] for x in parts) if parts else 1), (len(members[p]) - 1) * last + sum(x[1] for x in parts)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *sums(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("how", [{}, {"local": 4, "block": 3, "hot_rows": 2}])
def test_against_brute_force(spark, how):
    rows = talk()
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes[:7]] == ["bigint"] * 7
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_one_conversation_holds_nearly_all(spark):
    rows = [(5, t, "user", f"x{t % 3}", None, None) for t in range(300)] + [(6, 0, "user", "y", None, None)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), local=16, block=7, hot_rows=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_empty_and_without_ids(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", None, None)], SCHEMA)).collect() == []


def test_rounds_grow_with_the_logarithm(monkeypatch):
    """A path of 5,000 nodes: one centroid a round in each half."""
    n = 5000
    depth, parent, comp = np.arange(n), np.arange(n) - 1, np.zeros(n, dtype=np.int64)
    rounds, flatnonzero = [], np.flatnonzero
    values = np.ones((n, 1), dtype=np.int64)
    monkeypatch.setattr(trie.np, "add", type("Add", (), {"at": staticmethod(lambda *a, at=np.add.at: (rounds.append(1), at(*a)))}))
    got = trie.split_components(depth, parent, comp, n - depth, values)
    assert flatnonzero(got[:, 0] != n - depth).size == 0 and len(rounds) <= 14


def test_random_forests_by_centroids():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 80))
        parent = np.array([-1 if i == 0 or rng.random() < 0.05 else int(rng.integers(max(0, i - 6), i)) for i in range(n)])
        depth, top = np.zeros(n, dtype=int), np.arange(n)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i], top[i] = depth[p] + 1, top[p]
        order = np.argsort(depth, kind="stable")
        place = np.argsort(order)
        parent, depth, top = np.where(parent[order] >= 0, place[parent[order]], -1), depth[order], place[top[order]]
        values, own = rng.integers(0, 9, (n, 2)), rng.integers(1, 5, n)
        want, weight = values.copy(), own.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
                weight[parent[i]] += weight[i]
        assert (trie.split_components(depth, parent, top, weight, values) == want).all()


def test_numbers_and_sums_across_ranges_and_blocks(spark):
    rows = [(1, None)] * 500 + [(1, t % 7) for t in range(300)] + [(None, 3)] * 20 + [(c, 1) for c in range(2, 60)]
    got = number_turns(spark.createDataFrame(rows, "conv_id long, turn long").repartition(6), ["turn"], 9).collect()
    for c in {r[0] for r in rows}:
        mine = sorted((r["pos"], r["turn"]) for r in got if r["conv_id"] == c) if c != 1 else sorted(((r["pos"], r["turn"] if r["turn"] is not None else -1) for r in got if r["conv_id"] == 1))
        assert [p for p, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
    table = spark.createDataFrame([(k, i, i * i) for k in (1, 2) for i in range(0, 200 * k, k)], "key long, at long, v long")
    for r in prefix_sums(table, "key", "at", ["v"], 5).collect():
        assert r["v"] == sum(i * i for i in range(0, r["at"] + 1, r["key"]))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no tables here")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    found = con.execute(queries.oracle_sql()["op12_prefix_trie"])
    names = [c[0] for c in found.description]
    got = queries.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, found.fetchall()))
