"""Chat formatting: minimum-cost role repair, then rendering.

Legal turns follow a small automaton: start -> system | user, system -> user, user -> assistant,
assistant -> user.  A row may be kept (cost 0), merged into the turn before (1), preceded by an
inserted empty turn (2), relabelled (3; 1 if its role is missing or unknown), or relabelled and
merged.  Dynamic programming finds a cheapest repair of each conversation; among equals the
first in the order above is taken, row by row, so the result does not depend on partitioning.

A row's options are a matrix over the automaton's states under (min, +), which is associative:
rows are range-partitioned by (conversation, turn), so one huge conversation spreads over many
tasks; a first pass folds the piece of a conversation at each partition's edges to one matrix, the
driver chains these (two rows per partition), a second pass finds the state and the counts each
piece hands on, a third renders.  Output has a row per input row and inserted turn; the rendered
conversation is the concatenation of ``rendered`` by ``position``, never built in one place.

Defined cases: rows order by (turn, role, hash of the text, text), nulls first; repeated rows are turns of their
own; a null conv_id is a conversation of its own; null and empty texts render as empty; roles
compare without case and outer blanks; marker text inside a message is broken up so that it
cannot open a turn; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import checkpoint_root

from .common import prepare

# States and roles: 0 start / unknown role.
SYSTEM, USER, ASSISTANT = 1, 2, 3
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
LEGAL = {0: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 1, 2, 3, 1
FAR = 1 << 40
OPEN, CLOSE, JOIN, MARKER = "<|im_start|>{}\n", "<|im_end|>\n", "\n", "<|"


@functools.cache
def options(state: int, role: int) -> tuple[tuple[int, str, int, int], ...]:
    """(cost, action, inserted role or 0, next state), in the order of preference."""
    out = []
    if role in LEGAL[state]:
        out.append((0, "keep", 0, role))
    if state and role == state:
        out.append((MERGE, "merge", 0, state))
    out += [(INSERT, "keep", t, role) for t in LEGAL[state] if role in LEGAL[t]]
    change = RELABEL if role else RELABEL_UNKNOWN
    out += [(change, "relabel", 0, r) for r in LEGAL[state] if r != role]
    if state and role != state:
        out.append((change + MERGE, "relabel and merge", 0, state))
    return tuple(out)


def cost_to_go(roles: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state before row i to the end, for i = 0 .. n; ``end`` is the last."""
    out = [tuple(end)]
    for role in reversed(roles):
        after = out[-1]
        out.append(tuple(min(c + after[t] for c, _, _, t in options(s, role)) for s in range(4)))
    return out[::-1]


def fold(roles: list[int]) -> list[int]:
    """The piece's (min, +) matrix, by rows: least cost from state s to state t."""
    columns = [cost_to_go(roles, tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def choose(roles: list[int], state: int, end: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(action, inserted role or 0, state after) of each row of a cheapest repair."""
    go, out = cost_to_go(roles, end), []
    for i, role in enumerate(roles):
        _, action, inserted, state = next(o for o in options(state, role) if o[0] + go[i + 1][o[3]] == go[i][state])
        out.append((action, inserted, state))
    return out


def _hand_on(roles: list[int], end: tuple[int, ...]) -> list[int]:
    """For each entry state: state, turns and pieces that the piece adds."""
    out = []
    for s in range(4):
        steps = choose(roles, s, end)
        out += [steps[-1][2], sum((a in ("keep", "relabel")) + (t > 0) for a, t, _ in steps), sum(1 + (t > 0) for _, t, _ in steps)]
    return out


def _pieces(batches):
    """Runs of rows of one conversation: (conv_id, turns, roles, texts)."""
    key, now = None, None
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or conv != key:
                if now is not None:
                    yield key, now
                key, now = conv, ([], [], [])
            for part, value in zip(now, (turn, ROLES.get((role or "").strip().lower(), 0), text)):
                part.append(value)
    if now is not None:
        yield key, now


EDGE = "pid int, first long, last long, single boolean, head array<long>, tail array<long>"


def _edges(of):
    """A mapper that returns ``of(head or tail, roles, pid)`` of a partition's outer pieces."""
    def run(batches):
        pid, first, last, head, tail, n = TaskContext.get().partitionId(), None, None, None, None, 0
        held = None
        for key, (_, roles, _) in _pieces(batches):
            if n == 0:
                first, head = key, of("head", roles, pid)
            held, last, n = roles, key, n + 1
        if n:
            tail = head if n == 1 else of("tail", held, pid)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((pid, pa.int32()), (first, pa.int64()), (last, pa.int64()), (n == 1, pa.bool_()), (head, pa.list_(pa.int64())), (tail, pa.list_(pa.int64())))],
                                             ["pid", "first", "last", "single", "head", "tail"])

    return run


def _broken(text: str | None) -> str:
    return (text or "").replace(MARKER, "<\u200b|")


REPAIRED = "conv_id long, position long, out_turn long, turn long, role string, action string, rendered string"


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, position, out_turn, turn, role, action, rendered`` (see the module's notes)."""
    spark = rows.sparkSession
    prepare(spark)
    checkpoint_root(spark)
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # Rows of one turn are ordered by role, then by a hash of their texts: range partitioning samples
    # its keys to the driver, which must not hold texts.  Equal rows are interchangeable; the
    # number only lets range partitioning part them.
    keys = ["conv_id", "turn", "role", "text_hash"]
    base = base.withColumns({"text_hash": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    base = base.repartitionByRange(*keys, "n").sortWithinPartitions(*keys, "text", "n").select("conv_id", "turn", "role", "text").checkpoint()
    edges = {r["pid"]: r for r in base.mapInArrow(_edges(lambda _, roles, pid: fold(roles)), EDGE).collect()}  # a row per partition
    pids = sorted(edges)
    going, free = {}, (0, 0, 0, 0)  # cost after a partition's last piece; conversations go on?
    for a, b in reversed(list(zip(pids, pids[1:] + [None]))):
        e = edges.get(b)
        if e is not None and e["first"] == edges[a]["last"]:
            end = going[b][0] if e["single"] else free
            going[a] = (tuple(min(e["head"][4 * s + t] + end[t] for t in range(4)) for s in range(4)), True)
        else:
            going[a] = (free, False)

    def end_of(side: str, pid: int, single: bool) -> tuple[int, ...]:
        return going[pid][0] if side == "tail" or single else free

    one = {p: edges[p]["single"] for p in pids}
    passed = {r["pid"]: r for r in base.mapInArrow(_edges(lambda side, roles, pid: _hand_on(roles, end_of(side, pid, one[pid]))), EDGE).collect()}
    entry, carry = {}, (0, 0, 0)  # state, turns and pieces before a partition's first piece
    for i, p in enumerate(pids):
        before = pids[i - 1] if i else None
        entry[p] = carry if i and edges[before]["last"] == edges[p]["first"] else (0, 0, 0)
        state, turns, pieces = entry[p] if one[p] else (0, 0, 0)
        s, t, k = passed[p]["tail"][3 * state:3 * state + 3]
        carry = (s, turns + t, pieces + k)

    def render(batches):
        pid = TaskContext.get().partitionId()
        waiting = None
        for key, piece in _pieces(batches):
            if waiting is not None:
                yield from piece_rows(*waiting, free, False)
            state = entry[pid] if waiting is None else (0, 0, 0)
            waiting = (key, piece, state)
        if waiting is not None:
            yield from piece_rows(*waiting, *going[pid])

    def piece_rows(key, piece, state, end, goes_on):
        turns, roles, texts = piece
        state, out_turn, position = state
        rows, size = [], 0
        steps = choose(roles, state, end)
        for i, (turn, text, (action, inserted, state)) in enumerate(zip(turns, texts, steps)):
            if inserted:
                rows.append((key, position, out_turn, None, NAMES[inserted], "insert", (CLOSE if out_turn else "") + OPEN.format(NAMES[inserted])))
                position, out_turn = position + 1, out_turn + 1
            body = _broken(text)
            if action in ("keep", "relabel"):
                body = (CLOSE if out_turn else "") + OPEN.format(NAMES[state]) + body
                out_turn += 1
            else:
                body = JOIN + body
            if i == len(steps) - 1 and not goes_on:
                body += CLOSE
            rows.append((key, position, out_turn - 1, turn, NAMES[state], action, body))
            position += 1
            size += len(body)
            if size > 4_000_000 or len(rows) >= 4096:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return base.mapInArrow(render, REPAIRED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()] * 3
    names = ["conv_id", "position", "out_turn", "turn", "role", "action", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names)
