"""Chat formatting by minimum-cost role repair.

The legal turns are those of an automaton: perhaps a system turn, then user and assistant in turn, from the user on and
ending with the assistant. A source turn keeps its role, takes another one (relabelled), or joins the turn before it when
both end up with the same role (merged); empty turns may be inserted before it and at the end. Dynamic programming finds
the cheapest repair; among equal costs a checksum of the turns decides, so the result does not depend on how rows are dealt
out. Cost and checksum share one number, which holds for conversations of up to `TURNS` turns; a longer one is an error.

The states are four, so a stretch of turns is a 4 x 4 matrix of costs, and matrices join by (min, +). A conversation is
cut into stretches of at most `STRETCH` turns: each gives its matrix, the matrices of a conversation are walked once, and
each stretch then finds its own choices between a known start and end. Turns are ordered by a range-partitioned sort over
the whole table, so a conversation that holds a third of all rows is spread over many tasks, and the result is one row per
rendered turn: reading `rendered` in the order of (segment, n) gives the text of the conversation.

Turns are ordered by turn, then role and text; null turns come first; rows that repeat in all four columns count once.
Roles are compared without case and outer blanks; null and unknown roles are relabelled at a lower cost. Null texts count
as empty, and empty turns stay. Rows with a null conv_id form one conversation. Further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
STRETCH = 1024
TURNS = 1 << 24
UNIT = 1 << 36
NEVER = 1 << 61
# (state, role) -> roles of the empty turns to insert before a turn of that role
FOLLOWS: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
ENDS: dict[int, tuple[int, ...]] = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role: str | None) -> int:
    """1 to 3 for a known role, 0 for any other."""
    own = (role or "").strip().lower()
    return ROLES.index(own) + 1 if own in ROLES else 0


def _steps() -> np.ndarray:
    """cost[source role, state, new role]; a state and an equal role merge."""
    out = np.full((4, 4, 4), NEVER, np.int64)
    for own in range(4):
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                relabel = 0 if own == role else RELABEL if own else RELABEL_UNKNOWN
                if state == role:
                    out[own, state, role] = (relabel + MERGE) * UNIT
                elif (state, role) in FOLLOWS:
                    out[own, state, role] = (relabel + INSERT * len(FOLLOWS[state, role])) * UNIT
    return out


STEPS = _steps()
LAST = np.array([NEVER, *[INSERT * len(ENDS[s]) * UNIT for s in (SYSTEM, USER, ASSISTANT)]], np.int64)


def _step(role: int, tie: int) -> np.ndarray:
    """cost[state, new role] of a turn; twelve bits of its checksum for each new role break ties."""
    return STEPS[role] + ((tie >> np.array([0, 0, 10, 20])) & 0xFFF)


def stretch_matrix(roles: list[int], ties: list[int]) -> np.ndarray:
    """Cost from every state before the stretch to every state after it."""
    m = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for r, t in zip(roles, ties):
        m = np.minimum((m[:, :, None] + _step(r, t)[None]).min(axis=1), NEVER)
    return m


_WAYS = [[[(state, int(STEPS[own, state, role])) for state in range(4) if STEPS[own, state, role] < NEVER] for role in range(4)] for own in range(4)]


def choices(roles: list[int], ties: list[int], start: int, end: int | None) -> tuple[list[int], int]:
    """State after each turn on the cheapest way from `start` to `end`, or to the best end of a conversation; and its cost."""
    cost = [NEVER] * 4
    cost[start] = 0
    came = []
    for own, tie in zip(roles, ties):
        now, back = [NEVER] * 4, [0] * 4
        for role in (SYSTEM, USER, ASSISTANT):
            best, at = NEVER, 0
            for state, step in _WAYS[own][role]:
                if cost[state] + step < best:
                    best, at = cost[state] + step, state
            if best < NEVER:
                now[role], back[role] = best + (tie >> 10 * (role - 1) & 0xFFF), at
        came.append(back)
        cost = now
    if end is None:
        closed = [c + int(x) for c, x in zip(cost, LAST)]
        end = closed.index(min(closed))
        cost[end] = closed[end]
    out = [end]
    for back in reversed(came[1:]):
        out.append(back[out[-1]])
    return out[::-1], cost[end] // UNIT


ROW_SCHEMA = "conv_id bigint, turn bigint, role string, text string, tie bigint, segment bigint, n int, own int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the stretches of a sorted partition: a new one at a new conversation and after STRETCH turns."""
    part, count, at, last = TaskContext.get().partitionId(), 0, 0, object()
    for b in batches:
        segments, places = [], []
        for c in b.column("conv_id").to_pylist():
            if c != last or at == STRETCH:
                count, at, last = count + 1, 0, c
            segments.append((part << 33) + count)
            places.append(at)
            at += 1
        own = [role_number(r) for r in b.column("role").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("conv_id", "turn", "role", "text", "tie")], pa.array(segments, pa.int64()), pa.array(places, pa.int32()), pa.array(own, pa.int32())],
            names=["conv_id", "turn", "role", "text", "tie", "segment", "n", "own"])


def _matrices(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    m = stretch_matrix(rows["own"].tolist(), rows["tie"].tolist())
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "segment": [key[0]], "cost": [m.ravel().tolist()]})


def _joints(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Start and end state of every stretch of one conversation, and whether it is the last."""
    if len(rows) > TURNS // STRETCH:
        raise ValueError(f"a conversation of more than {TURNS} turns")
    rows = rows.sort_values("segment", ignore_index=True)
    cost = np.full(4, NEVER, np.int64)
    cost[START] = 0
    came = []
    for m in rows["cost"]:
        ways = cost[:, None] + np.asarray(m, np.int64).reshape(4, 4)
        came.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), NEVER)
    state = int((cost + LAST).argmin())
    total = int((cost + LAST).min()) // UNIT
    ends = []
    for c in reversed(came):
        ends.append(state)
        state = int(c[state])
    ends = ends[::-1]
    return pd.DataFrame({"segment": rows["segment"], "start": [START, *ends[:-1]], "end": ends, "last": [False] * (len(ends) - 1) + [True],
                         "cost": total})


OUT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n", pa.int32()), ("turn", pa.int64()), ("role", pa.string()),
                        ("action", pa.string()), ("rendered", pa.string()), ("cost", pa.int64())])
READY = ("segment", "n", "conv_id", "turn", "text", "own", "tie", "start", "end", "last", "cost")
_MARK = ["", *[f"<|{r}|>\n" for r in ROLES]]
_END = "<|end|>\n"


def _stretch(rows: list[tuple]) -> Iterator[tuple]:
    """Rendered turns of one stretch. A turn opens with its mark unless it joins the one before; the one before closes
    when the next one opens. Empty turns are rendered before the turn that needs them, and after the last one."""
    segment, _, conv, _, _, _, _, start, end, last, cost = rows[0]
    ways, own_cost = choices([r[5] for r in rows], [r[6] for r in rows], START if start is None else start, end)
    # a stretch without joints is a whole conversation
    state, last, cost = (START, True, own_cost) if start is None else (start, last, cost)
    for i, ((_, n, _, turn, text, source, *_), role) in enumerate(zip(rows, ways)):
        parts, actions = [], []
        if role == state:
            parts.append("\n\n")
            actions.append("merge")
        else:
            if state != START:
                parts.append(_END)
            for empty in FOLLOWS[state, role]:
                parts += (_MARK[empty], _END)
                actions.append(f"insert {ROLES[empty - 1]}")
            parts.append(_MARK[role])
        parts.append(text or "")
        if source != role:
            actions.append("relabel")
        if last and i == len(rows) - 1:
            parts.append(_END)
            for empty in ENDS[role]:
                parts += (_MARK[empty], _END)
                actions.append(f"insert {ROLES[empty - 1]}")
        yield conv, segment, n, turn, ROLES[role - 1], ", ".join(actions) or "keep", "".join(parts), cost
        state = role


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (segment, n), so one stretch at a time is held."""
    own: list[tuple] = []
    for b in batches:
        out = []
        for row in zip(*[b.column(c).to_pylist() for c in READY]):
            if own and own[0][0] != row[0]:
                out += _stretch(own)
                own = []
            own.append(row)
        if out:
            yield from arrow_batches(dict(zip(OUT_SCHEMA.names, zip(*out))), OUT_SCHEMA)
    if own:
        yield from arrow_batches(dict(zip(OUT_SCHEMA.names, zip(*_stretch(own)))), OUT_SCHEMA)


def formatted(turns: DataFrame) -> DataFrame:
    """Per source turn of `turns` (conv_id, turn, role, text): conv_id, segment, n, turn, new role, action, rendered, and the conversation's cost."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "tie", F.crc32(F.concat_ws("|", "turn", "role", "text").cast("binary"))).mapInArrow(_cut, ROW_SCHEMA), "turns")
    # only conversations of several stretches need the matrices
    long = cut.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).filter("a < b").select(F.col("conv_id").alias("c"))
    several = cut.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    matrices = several.select("conv_id", "segment", "n", "own", "tie").groupBy("segment").applyInPandas(
        _matrices, "conv_id bigint, segment bigint, cost array<bigint>")
    joints = matrices.groupBy("conv_id").applyInPandas(_joints, "segment bigint, start int, end int, last boolean, cost bigint")
    ready = cut.join(joints, "segment", "left").select(*READY)
    return ready.repartition("segment").sortWithinPartitions("segment", "n").mapInArrow(
        _render, "conv_id bigint, segment bigint, n int, turn bigint, role string, action string, rendered string, cost bigint")
