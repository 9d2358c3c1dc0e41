import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from silvatrack.llm import queries
from silvatrack.llm import turn_repair as fix

SCHEMA = "conv_id long, turn long, role string, text string, pos string, Edit int"
LEGAL = re.compile(r"(s?(ua)+)?")


def talk(seed: int = 2, n: int = 60) -> list[tuple]:
    """Conversations with missing, repeated and null turns, odd roles, blank, equal and cut texts, and nulls in any column."""
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "and then", "Really? ", " \t", "", None, "Ende\x0b", "…", "What?!\n"]
    for c in [*range(n), -3, 7_000_000_000]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "User"]) if rng.random() < 0.25 else ("user", "assistant")[t % 2]
            rows.append((c, t * rng.choice([1, 1, 1, 2]) if rng.random() > 0.05 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(40)}.", "p", 1))
    return rows + [rows[2], rows[2], rows[7], (None, 0, "user", "no id.", "p", 2), (None, None, None, None, None, None)]


def cheapest(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """(cost, audit, lines) by a search over all prefixes of edits: rows are (role, text, gone, truncated)."""
    end = None
    # States by the roles' initials: all that a prefix of a legal sequence can be.
    frontier = {(0, "0"): (0, "", [])}
    nexts = {"0": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}
    for i in range(len(rows) + 1):
        for _ in range(3):  # insertions
            for (j, s), (c, a, t) in list(frontier.items()):
                if j == i:
                    key, new = (i, nexts[s]), (c + 3, a + "I", [*t, word[nexts[s]] + ":"])
                    frontier[key] = min(frontier.get(key, new), new)
        here = {s: v for (j, s), v in frontier.items() if j == i}
        if i == len(rows):
            end = min(v for s, v in here.items() if s in "0a")
            break
        role, text, gone, cut = rows[i]
        new_frontier: dict = {}
        for s, (c, a, t) in here.items():
            moves = [(s, c + 4, a + "D", t)]
            if not gone:
                more = 3 if cut else 0
                x = role[:1]
                if (s == "0" and x in ("s", "u")) or (s in "sa" and x == "u") or (s == "u" and x == "a"):
                    moves.append((x, c + more, a + "K", [*t, f"{role}:{text}"]))
                moves.append((nexts[s], c + 3 + more, a + "R", [*t, f"{word[nexts[s]]}:{text}"]))
            for s2, *v in moves:
                key = (i + 1, s2)
                new_frontier[key] = min(new_frontier.get(key, tuple(v)), tuple(v))
        frontier = new_frontier
    return end


def brute_force(rows: list[tuple]) -> list[tuple]:
    held = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        held[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        held[c] += [(turn is not None, turn or 0, digest, role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, v in held.items():
        v = sorted(v)
        turns = [x[1] for x in v if x[0]]
        seen, count, marked = set(), [0, 0, 0], []
        for *_, role, text in v:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        odd = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(v))
        cost, audit, lines = cheapest(marked) if v else (0, "", [])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *count, odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"block": 3, "fan": 2, "hot_rows": 2, "parts": 7}])
def test_against_search(spark, how):
    rows = talk()
    got = fix.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got.columns == fix.NAMES
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_one_conversation_holds_nearly_all(spark):
    rng = random.Random(4)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}"]), None, 0) for t in range(900)] + [(2, 0, "user", "hi.", None, 0)]
    got = fix.repair(spark.createDataFrame(rows, SCHEMA), block=16, fan=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_empty_table(spark):
    assert fix.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_auction_gives_distances_and_the_least_audit():
    """All sequences of up to four turns: prices against the search, the audit against every string of edits."""
    rows = {"s-": ("s", "x", False, False), "u-": ("u", "x", False, False), "at": ("a", "x", False, True), "o-": ("o", "x", False, False), "ub": ("u", "x", True, False)}
    for n in range(5):
        for codes in itertools.product(rows, repeat=n):
            price = fix.auction(list(codes), fix.END)
            steps, state = fix.trace(list(codes), price, fix.START)
            cost, audit, _ = cheapest([rows[c] for c in codes])
            assert price[0][fix.START] == cost and "".join(steps) + "I" * fix.CLOSING[state] == audit


def test_blocks_combine_to_the_whole():
    rng = random.Random(1)
    for _ in range(60):
        codes = [rng.choice("suao") + rng.choice("--btd") for _ in range(rng.randrange(3, 30))]
        whole = fix.auction(codes, fix.END)[0]
        cut = rng.randrange(1, len(codes) - 1)
        tables = fix.combine_tables(fix.cost_table(codes[cut:], True), fix.cost_table(codes[:cut], False))
        assert [tables[4 * s] for s in range(4)] == whole


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no tables here")
@pytest.mark.parametrize("made", [False, True])
def test_query_equals_its_sql(spark, made, tmp_path):
    folder = "/root/testdata/sf0.001"
    if made:
        folder = str(tmp_path)
        spark.createDataFrame(talk(5, 20), SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if made else ''}'")
    found = con.execute(queries.oracle_sql()["op13_repair_turns"])
    names = [c[0] for c in found.description]
    got = queries.queries()["op13_repair_turns"](spark, folder).select(*names)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, found.fetchall()))
