"""Repair of conversations: the cheapest edits that leave an optional system turn and then pairs of user and assistant, found by
the auction algorithm for shortest paths.

The lattice. A node is (turns read, state), the states being START, SYSTEM, USER and ASSISTANT; an arc is an edit, with its
integer cost: Keep and Rerole read a turn and move to a state, Delete reads one and stays, Insert moves without reading.
The auction keeps a price for each node, at most any arc's cost and the price behind it, and a path from an origin: at the
path's end it raises the price to the best that the arcs offer and takes the node off the path (contraction), or, where the
price is that already, goes along the best arc (extension), until it reaches the end. Origins are taken from the last turn
to the first and prices are kept between them, so that each path is short; in the end every price is the exact distance to
the end. Then an arc is on a cheapest path if and only if it is tight, that is, its cost is the fall of price along it, and
the least edit's initial among the tight arcs, again and again, spells the least audit in the order of ASCII.

Conversations are cut into blocks of BLOCK turns, whatever their length. For a block that is not its conversation's last,
auctions towards each state at its end give a table of costs (min-plus) from state to state; tables combine by a scan of
bounded groups, which gives each block the prices at its end. With these a block's paths are final; where a path that starts
in each state ends is a map from states to states, and maps combine by the same scan, which gives each block its first state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .conversations import meet, number_turns, turn_digest

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a block, and blocks (or blocks of blocks) that one group of a scan combines.
BLOCK, FAN = 256, 1024
#: Solved blocks that a Python worker remembers.
REMEMBERED = 50_000
DAMAGES = 20
SPACE = " \t\n\x0b\f\r"
NEVER = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept turn of an initial leads to; a rerolled or inserted turn leads to the state after its state in TURN.
MOVES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
TURN = [USER, USER, ASSISTANT, USER]
#: States that can lead to each state at a block's end; START and SYSTEM are never come back to.
BEFORE = [(START,), (START, SYSTEM), (START, SYSTEM, USER, ASSISTANT), (START, SYSTEM, USER, ASSISTANT)]
#: After the last turn: the cost of the insertions that a state still needs, and how many these are.
END, CLOSING = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
ROLE = {USER: "user", ASSISTANT: "assistant"}


def _arcs(codes: list[str], i: int, s: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, next turn, next state) of a node's arcs, in the order of the initials. A code is a role's initial and a fault:
    b blank, d duplicate, t truncated, - none."""
    out = [("D", DELETE, i + 1, s), ("I", INSERT, i, TURN[s])]
    initial, fault = codes[i]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        if initial in MOVES[s]:
            out.append(("K", KEEP + more, i + 1, MOVES[s][initial]))
        out.append(("R", REROLE + more, i + 1, TURN[s]))
    return out


def auction(codes: list[str], ends: tuple[int, ...], states: tuple[int, ...] = (0, 1, 2, 3)) -> list[list[int]]:
    """Exact prices [turn][state]: the least cost from each node to the end of the block, where ends are the prices. Only nodes of the
    given states are used; a cost of NEVER or more is none."""
    n = len(codes)
    price = [[NEVER] * 4 for _ in range(n)] + [[ends[s] for s in range(4)]]
    for i in range(n - 1, -1, -1):
        arcs = {s: [(c, j, t) for _, c, j, t in _arcs(codes, i, s) if t in states] for s in states}
        floor = min(price[i + 1][s] for s in states)  # prices that no arc undercuts, to begin with
        row = price[i]
        for s in states:
            row[s] = floor
        for origin in states:
            path = [origin]
            while True:
                s = path[-1]
                best, turn, state = min((c + price[j][t], j, t) for c, j, t in arcs[s])
                best = min(best, NEVER)
                if row[s] < best:
                    row[s] = best
                    if len(path) > 1:
                        path.pop()  # contraction
                elif turn > i or best == NEVER:
                    break  # extension into the next turn, whose prices are exact
                else:
                    path.append(state)  # extension by an insertion
    return price


def trace(codes: list[str], price: list[list[int]], start: int) -> tuple[list[str], int]:
    """The least path over tight arcs from a state at the first turn: for each turn the initials of the edits before and at it, and
    the state where it ends."""
    out, s, i, step = [], start, 0, ""
    while i < len(codes):
        initial, _, j, t = next(a for a in _arcs(codes, i, s) if price[i][s] == a[1] + price[a[2]][a[3]])
        step += initial
        if j > i:
            out.append(step)
            step = ""
        i, s = j, t
    return out, s


_solved: dict[tuple, object] = {}


def _once(what: Callable, codes: str, *more):
    """what of a block's codes, remembered: most blocks are short and alike. A turn that has to go is the same whatever its role."""
    plain = tuple("-b" if codes[i + 1] in "bd" else codes[i : i + 2] for i in range(0, len(codes), 2))
    key = (what.__name__, plain, *more)
    if key not in _solved:
        if len(_solved) >= REMEMBERED:
            _solved.clear()
        _solved[key] = what(list(plain), *more)
    return _solved[key]


def cost_table(codes: list[str], last: bool) -> list[int]:
    """Costs from each state at the block's start to each at its end, row by row; of a last block to the conversation's end."""
    out = [NEVER] * 16
    for e in (START,) if last else range(4):
        states = BEFORE[ASSISTANT] if last else BEFORE[e]
        price = auction(codes, END if last else tuple(0 if s == e else NEVER for s in range(4)), states)
        for s in states:
            out[4 * s + e] = price[0][s]
    return out


def path_ends(codes: list[str], ends: tuple[int, ...]) -> list[int]:
    price = auction(codes, ends)
    return [trace(codes, price, s)[1] if price[0][s] < NEVER else s for s in range(4)]


def edits_of(codes: list[str], ends: tuple[int, ...], start: int) -> tuple[list[str], int]:
    return trace(codes, auction(codes, ends), start)


def combine_tables(later: list[int], earlier: list[int]) -> list[int]:
    """Min-plus product of the table of what comes first and that of what comes after."""
    return [min(NEVER, min(earlier[4 * s + m] + later[4 * m + e] for m in range(4))) for s in range(4) for e in range(4)]


def combine_maps(first: list[int], then: list[int]) -> list[int]:
    return [then[s] for s in first]


def scan(table: DataFrame, op: Callable, fan: int = FAN) -> DataFrame:
    """(conv_id, at, before): of a table (conv_id, at, value), at from 0, the op of all values before each, null for the first. Groups of
    fan values are combined on their own, and their results in the same way."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        held = list(pdf["value"].iloc[0])
        for v in pdf["value"].iloc[1:]:
            held = op(held, list(v))
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "at": [pdf["group"].iloc[0]], "value": [held]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        held = pdf["before"].iloc[0]
        held, out = None if held is None else list(held), []
        for v in pdf["value"]:
            out.append(held)
            held = list(v) if held is None else op(held, list(v))
        return pd.DataFrame({"conv_id": pdf["conv_id"], "at": pdf["at"], "before": out})

    grouped = table.withColumn("group", F.expr(f"at div {fan}"))
    if (table.agg(F.max("at")).first()[0] or 0) < fan:
        carried = grouped.withColumn("before", F.lit(None).cast("array<long>"))
    else:
        sums = written(grouped.groupBy("conv_id", "group").applyInPandas(total, "conv_id string, at long, value array<long>"))
        carried = grouped.join(scan(sums, op, fan).withColumnRenamed("at", "group"), ["conv_id", "group"])
    return written(carried.groupBy("conv_id", "group").applyInPandas(inside, "conv_id string, at long, before array<long>"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id string, turn, role, text, copies): each row as it is after damage, and how often it is there (0 to 2). Nulls are one
    space; a null turn stays null beside that."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn"))) % DAMAGES
    return conversations.select(
        held("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(held("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(held("text"), "[.!?]", "")).otherwise(held("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _binary_digest() -> Column:
    return F.unhex(turn_digest(F.col("role"), F.col("text")))


def faults(damaged: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, pos, turn, digest, code) of each row after damage, in order: its role's initial and its first fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    fault = F.when(trimmed == "", "b").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    found = damaged.select("conv_id", "turn", _binary_digest().alias("digest"), initial.alias("initial"), fault.alias("fault"), "copies")
    rows = written(found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies"))
    numbered = written(number_turns(rows, ["turn", "digest"], parts))
    first = numbered.filter("fault != 'b'").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("first").isNull() & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))
    return numbered.join(first, ["conv_id", "pos"], "left").select("conv_id", "pos", "turn", "digest", F.concat("initial", fault).alias("code"))


def block_edits(rows: DataFrame, block: int = BLOCK, fan: int = FAN, hot_rows: int | None = None) -> DataFrame:
    """(conv_id, tail, turn, digest, pos, code, edit): of each of the rows that faults gives, the initials of the insertions before it and
    of its own edit; with tail 1, the insertions after a conversation's last row."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "code", "turn", "digest")))
    grouped = rows.groupBy("conv_id", F.expr(f"pos div {block}").alias("block")).agg(cells.alias("c"))
    sizes = written(rows.groupBy("conv_id").agg(F.expr(f"max(pos) div {block} + 1").alias("n_blocks")).withColumn("weight", F.col("n_blocks")))
    blocks = written(meet(grouped.select("conv_id", "block", F.array_join("c.code", "").alias("codes"), F.col("c.turn").alias("turns"), F.col("c.digest").alias("digests")), sizes, ["conv_id"], "weight", hot_rows))
    many = blocks.filter("n_blocks > 1").select("conv_id", "block", "n_blocks", "codes")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [_once(cost_table, c, b == n - 1) for c, b, n in zip(pdf["codes"], pdf["block"], pdf["n_blocks"])]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "at": pdf["n_blocks"] - 1 - pdf["block"], "value": value})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [_once(path_ends, c, tuple(e)) for c, e in zip(pdf["codes"], pdf["ends"])]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "at": pdf["block"], "value": value})

    known = blocks.select("conv_id", "block", F.lit(None).cast("array<long>").alias("ends"), F.lit(None).cast("int").alias("start")).limit(0)
    if not many.isEmpty():
        after = scan(written(many.mapInPandas(tables, "conv_id string, at long, value array<long>")), combine_tables, fan)
        numbers = many.withColumn("at", F.col("n_blocks") - 1 - F.col("block")).join(after, ["conv_id", "at"])
        ends = F.when(F.col("before").isNull(), F.array(*[F.lit(e) for e in END]).cast("array<long>")).otherwise(F.array(*[F.get("before", F.lit(4 * s)) for s in range(4)]))
        priced = written(numbers.select("conv_id", "block", "codes", ends.alias("ends")))
        reached = scan(written(priced.mapInPandas(maps, "conv_id string, at long, value array<long>")), combine_maps, fan)
        start = F.coalesce(F.get("before", F.lit(START)), F.lit(START)).cast("int")
        known = priced.select("conv_id", "block", "ends").join(reached.select("conv_id", F.col("at").alias("block"), start.alias("start")), ["conv_id", "block"])

    names = ["conv_id", "tail", "turn", "digest", "pos", "code", "edit"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at, codes = r["block"] * block, r["codes"]
                steps, state = _once(edits_of, codes, tuple(r["ends"] or END), r["start"] or START)
                for i, (turn, digest, step) in enumerate(zip(r["turns"], r["digests"], steps)):
                    out.append((r["conv_id"], 0, turn, digest, at + i, codes[2 * i : 2 * i + 2], step))
                if r["block"] == r["n_blocks"] - 1 and CLOSING[state]:
                    out.append((r["conv_id"], 1, None, None, 0, "", "I" * CLOSING[state]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), types)], names)

    solved = blocks.join(known, ["conv_id", "block"], "left")
    return solved.mapInArrow(edits, "conv_id string, tail int, turn long, digest binary, pos long, code string, edit string")


class _Repaired:
    """One conversation as its rows come by, in order: what is kept does not grow with it but for the audit."""

    def __init__(self, conv_id: str):
        self.conv_id, self.state, self.held, self.lines = conv_id, START, None, 0
        self.hash, self.audit = hashlib.sha256(), []
        self.count = dict.fromkeys("bdt", 0)
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def edit(self, turn: int | None, code: str, edit: str) -> None:
        if code:
            if turn is not None and turn != self.high:  # in order
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if code[1] != "-":
                self.count[code[1]] += 1
            if self.before is not None and self.before + code[0] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = code[0]
        self.audit.append(edit)
        for e in edit:
            if e == "D":
                self.cost += DELETE
                continue
            self.state = MOVES[self.state][code[0]] if e == "K" else TURN[self.state]
            role = self.held[0] if e == "K" else ROLE[self.state]
            self.cost += {"K": KEEP, "R": REROLE, "I": INSERT}[e] + (TRUNCATED if e != "I" and code[1] == "t" else 0)
            self._line(role, "" if e == "I" else self.held[1])

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (None if self.conv_id == " " else int(self.conv_id), gaps, *(self.count[f] for f in "bdt"), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN, hot_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """Damages the rows of conversations and repairs what is left. Of each conv_id: gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256.

    Rows are ordered by turn, null first; rows of one turn by the SHA-256 of role and text, which puts the copies of a row side
    by side. A null role or text is one space; rows whose conv_id is null are one conversation, with a null conv_id. A
    conversation of any length is solved in blocks; only its hash, which is sequential, and its audit, which is one value,
    are made by one task, a row at a time. An empty table gives no rows; columns besides the four are not looked at.
    """
    damaged = damage(conversations)
    edits = block_edits(written(faults(damaged, parts)), block, fan, hot_rows)
    blank = {"role": "string", "text": "string", "code": "string", "edit": "string", "pos": "long"}
    there = F.col("copies") > 0
    texts = damaged.select("conv_id", F.lit(0).alias("tail"), "turn", F.when(there, _binary_digest()).alias("digest"), F.lit(0).alias("kind"), F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).alias("text"))
    both = texts.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in texts.columns}).unionByName(
        edits.withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast("string") for c in ("role", "text")})
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for conv_id, turn, kind, role, text, code, edit in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "kind", "role", "text", "code", "edit"))):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        out.append(held.row())
                    held = _Repaired(conv_id)
                if kind == 0:
                    held.held = (role, text)
                else:
                    held.edit(turn, code, edit)
            yield _rows(out)
            out = []
        if held is not None:
            yield _rows([held.row()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in NAMES[-2:] else pa.int64()) for n, c in zip(NAMES, columns)], NAMES)

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "tail", "turn", "digest", "kind", "pos").drop("tail", "digest", "pos")
    return ordered.mapInArrow(walk, ", ".join(f"{n} {'string' if n in NAMES[-2:] else 'long'}" for n in NAMES))
