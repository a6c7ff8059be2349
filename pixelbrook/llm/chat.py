"""Chat formatting: the cheapest repair of each conversation's roles, then rendering.

A legal conversation is an optional system turn and then user and assistant turns by turns, the user's first. Turns can be
kept, given another role, or merged into the turn before, and empty turns can be inserted; dynamic programming over the
automaton's four states (start, after system, after user, after assistant) finds the least cost.

Of equally cheap repairs the one is taken whose last move comes first in the order of moves (cheapest, plainest, states), then the
one before it, and so on.

Rows are sorted into ranges of (conversation, turn, role, text), so a conversation that holds a third of all rows is dealt out
like any other, and each range is read once. A conversation that lies within a range, in up to ``STRETCH`` turns, is repaired
there and then. One that goes over a range's edge, or is longer, is read in stretches: a turn's step is a (min, +) matrix
over the states, and such matrices can be multiplied in any grouping, so each stretch gives its matrix (and which beginning
comes first among equally cheap ones), a fold over a conversation's matrices (one small row each) fixes the states in which
every stretch begins and ends, and the stretches are traced back between them.

The rendered sequence of a conversation is its pieces in order; turn number n of it (from 0) is piece 2n + 1, and what is inserted
before it is piece 2n. Each turn begins with ``<|role|>`` and a line end; ``<|`` in a text is written ``< |``.

Defined results: turns are ordered by (turn, first 32 characters of the role, first 64 of the text, hash of both), nulls
first; a role that isn't one of the three, null too, gets the cheapest one; null text is empty; texts are rendered whole;
repeated rows are turns of their own; a null conv_id is a conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column
from .components import written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs.
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
STRETCH = 16_384
FAR = 1 << 30

#: Pieces, and stretches that wait for the states at their ends.
PIECES = "conv_id long, piece long, turn long, role_in string, role_out string, action string, cost int, rendered string"
READ = PIECES + ", stretch long, matrix array<int>, first array<int>, turns array<long>, roles array<string>, texts array<string>"


def moves(role: str | None) -> list[tuple[int, int, int, str, int]]:
    """What can be done with a turn of this role: (state before, state after, cost, action, inserted role or 0), cheapest and
    then plainest first."""
    out = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            named = ROLES[after - 1] == role
            extra = 0 if named else NAME if role not in ROLES else RELABEL
            how = "" if named else "relabel"
            if after in NEXT[before]:
                out.append((before, after, extra, how or "keep", 0))
            if before == after:
                out.append((before, after, extra + MERGE, f"{how}+merge".strip("+"), 0))
            for between in NEXT[before]:
                if after in NEXT[between]:
                    out.append((before, after, extra + INSERT, f"insert+{how or 'keep'}", between))
    return sorted(out, key=lambda m: (m[2], len(m[3]), m[0], m[1], m[4]))


_MOVES = {r: moves(r) for r in (*ROLES, None)}
_STEP = {}
for _r, _m in _MOVES.items():
    _STEP[_r] = np.full((4, 4), FAR, np.int64)
    for _a, _b, _c, *_ in _m:
        _STEP[_r][_a, _b] = min(_STEP[_r][_a, _b], _c)


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def product(roles: list[str | None]) -> np.ndarray:
    """The matrix of a stretch."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        out = times(out, _STEP[known(r)])
    return out


def traced(roles: list[str | None], begin: int, end: int) -> list[tuple[int, int, int, str, int]]:
    """The cheapest moves from one state to another; of equally cheap ones always the same."""
    cost = [FAR] * 4
    cost[begin] = 0
    back = []
    for r in roles:
        now, via = [FAR] * 4, [None] * 4
        for m in _MOVES[known(r)]:
            if cost[m[0]] + m[2] < now[m[1]]:
                now[m[1]], via[m[1]] = cost[m[0]] + m[2], m
        cost = now
        back.append(via)
    out, state = [], end
    for via in reversed(back):
        out.append(via[state])
        state = via[state][0]
    return out[::-1]


def rendered(role: int, text: str | None, new: bool) -> str:
    body = (text or "").replace("<|", "< |")
    return f"<|{ROLES[role - 1]}|>\n{body}\n" if new else f"{body}\n"


_PIECES = [("conv_id", pa.int64()), ("piece", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()), ("action", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())]
_READ = pa.schema([*_PIECES, ("stretch", pa.int64()), ("matrix", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECES = pa.schema(_PIECES)
_ENDS = pa.schema([("conv_id", pa.int64()), ("ends", pa.list_(pa.struct([("stretch", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("before", pa.int64())])))])


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def pieces(conv: int | None, rows: list[tuple], begin: int, end: int, before: int = 0) -> Iterator[tuple]:
    """The pieces of a stretch of (turn, role, text) with so many turns before it."""
    for n, ((turn, role, text), (_, after, cost, action, between)) in enumerate(zip(rows, traced([r[1] for r in rows], begin, end)), before):
        if between:
            yield conv, 2 * n, None, None, ROLES[between - 1], "insert", INSERT, rendered(between, "", True)
            cost, action = cost - INSERT, action.removeprefix("insert+")
        yield conv, 2 * n + 1, turn, role, ROLES[after - 1], action, cost, rendered(after, text, "merge" not in action)


def whole_conversation(conv: int | None, rows: list[tuple]) -> Iterator[tuple]:
    return pieces(conv, rows, START, int(product([r[1] for r in rows])[START].argmin()))


def first_beginnings(roles: list[str | None]) -> np.ndarray:
    """For each state at the end, the order of the beginnings that lead there, by their moves read backwards."""
    cost, out = product(roles), np.zeros((4, 4), np.int64)
    for end in range(4):
        ways = sorted(((traced(roles, begin, end)[::-1] if cost[begin, end] < FAR else []), begin) for begin in range(4))
        keyed = sorted((cost[begin, end] >= FAR, [move_order(m, r) for m, r in zip(way, reversed(roles))], begin) for way, begin in ways)
        for place, (_, _, begin) in enumerate(keyed):
            out[end, begin] = place
    return out


def move_order(move: tuple, role: str | None) -> int:
    return _MOVES[known(role)].index(move)


def _read(stretch: int):
    """A sorted range of turns: pieces of the conversations that lie within it, stretches of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, nothing = (None,) * (len(_READ) - len(_PIECES)), (None,) * (len(_PIECES) - 1)
        rows = (r for b in batches for r in zip(*(column(b, c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text"))))
        out, n = [], 0
        state = {"stretch": 0}

        def waiting(part: int, conv: int | None, held: list[tuple]) -> tuple:
            state["stretch"] += 1
            roles = [r[1] for r in held]
            return conv, *nothing, part << 32 | state["stretch"], product(roles).ravel().tolist(), first_beginnings(roles).ravel().tolist(), [r[0] for r in held], roles, [r[2] for r in held]

        first = True  # a range's first and last conversation may go on in others
        keys = groupby(rows, key=lambda r: r[1])
        ahead = next(keys, None)
        while ahead is not None:
            conv, group = ahead
            held, cut, part = [], first, 0
            for part, _, *row in group:
                if len(held) >= stretch:
                    out.append(waiting(part, conv, held))
                    held, cut = [], True
                    if len(out) >= 16:
                        yield _flush(out, _READ)
                        out, n = [], 0
                held.append(row)
            ahead, first = next(keys, None), False
            if cut or ahead is None:
                out.append(waiting(part, conv, held))
            else:
                out += [(*p, *none) for p in whole_conversation(conv, held)]
            n += len(held)
            if n >= 4096:
                yield _flush(out, _READ)
                out, n = [], 0
        yield _flush(out, _READ)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            costs, before = [np.where(np.arange(4) == START, 0, FAR)], [0]
            steps = [np.array(p["matrix"], np.int64).reshape(4, 4) for p in parts]
            for m, p in zip(steps, parts):
                costs.append(np.minimum((costs[-1][:, None] + m).min(0), FAR))
                before.append(before[-1] + p["n"])
            state, ends = int(costs[-1].argmin()), []
            for k in range(len(steps) - 1, -1, -1):
                ways = costs[k] + steps[k][:, state]
                order = np.array(parts[k]["first"]).reshape(4, 4)[state]
                begin = min(np.flatnonzero(ways == ways.min()).tolist(), key=lambda a: order[a])
                ends.append({"stretch": parts[k]["stretch"], "begin": begin, "end": state, "before": before[k]})
                state = begin
            out.append((conv, ends))
        yield _flush(out, _ENDS)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "turns", "roles", "texts", "begin", "end", "before")
    for batch in batches:
        for k in range(batch.num_rows):
            conv, turns, roles, texts, begin, end, before = (column(batch.slice(k, 1), c).to_pylist()[0] for c in names)
            yield _flush(list(pieces(conv, list(zip(turns, roles, texts)), begin, end, before)), _PIECES)


def repaired(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> pieces of the rendered conversations, in the order (conv_id, piece)."""
    text, role = F.col("text").cast("string"), F.col("role").cast("string")
    empty = lambda c: F.coalesce(c, F.lit(""))
    keyed = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.left(role, F.lit(32)).alias("k1"), F.left(text, F.lit(64)).alias("k2"), F.md5(F.concat(empty(role), F.lit("\0"), empty(text))).alias("k3"), F.monotonically_increasing_id().alias("k4"),
    )
    order = ("conv_id", "turn", "k1", "k2", "k3", "k4")  # the last one only parts equal rows
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # ranges aren't the same twice, so what is read is written
    read = written(ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "role", "text").mapInArrow(_read(stretch), READ))
    names = [f.name for f in _PIECES]
    done, waiting = read.where("stretch is null").select(*names), read.where("stretch is not null")
    lists = waiting.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", F.size("turns").alias("n"), "matrix", "first"))).alias("parts"))
    ends = lists.mapInArrow(_fold, "conv_id long, ends array<struct<stretch:long,begin:int,end:int,before:long>>").select(F.explode("ends").alias("e")).select("e.*")
    return done.unionByName(waiting.join(ends, "stretch").select("conv_id", "turns", "roles", "texts", "begin", "end", "before").mapInArrow(_trace, PIECES))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The pieces of a conversation's sorted (turn, role, text), by trying every sequence of moves, for tests."""
    ways = [((), START, 0)]
    for _, role, _ in rows:
        grown = []
        for path, before, cost in ways:
            for after in (SYSTEM, USER, ASSISTANT):
                extra = 0 if ROLES[after - 1] == role else NAME if role not in ROLES else RELABEL
                how = "" if ROLES[after - 1] == role else "relabel"
                options = [(extra, how or "keep", 0)] * (after in NEXT[before])
                options += [(extra + MERGE, how + "+merge" if how else "merge", 0)] * (before == after)
                options += [(extra + INSERT, "insert+" + (how or "keep"), b) for b in NEXT[before] if after in NEXT[b]]
                grown += [((*path, ((c, len(a), before, after, b), a)), after, cost + c) for c, a, b in options]
        ways = grown
    path, _, _ = min(ways, key=lambda w: (w[2], w[1], [m for m, _ in reversed(w[0])]))
    out = []
    for n, ((turn, role, text), ((cost, _, _, after, between), action)) in enumerate(zip(rows, path)):
        if between:
            out.append((2 * n, None, None, ROLES[between - 1], "insert", INSERT, f"<|{ROLES[between - 1]}|>\n\n"))
            cost, action = cost - INSERT, action[len("insert+") :]
        body = (text or "").replace("<|", "< |") + "\n"
        out.append((2 * n + 1, turn, role, ROLES[after - 1], action, cost, body if "merge" in action else f"<|{ROLES[after - 1]}|>\n{body}"))
    return out
