"""Minimum-cost repair of conversations' roles, and their rendering."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

#: Turns of a conversation that one task repairs together, and tables it walks together.
STRETCH = 512
ROLES = ("system", "user", "assistant")
SAME = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant",
        "model": "assistant", "ai": "assistant"}
#: States: nothing yet, then the role of the last turn. A turn may follow as listed.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What a repair costs: joining a turn to the one before, another role for a turn, a
    role for a turn that has none of the known, an empty turn put before it."""

    merge: int = 2
    relabel: int = 5
    unknown: int = 1
    insert: int = 3


#: Ways to take a turn, the cheaper-looking first where costs are equal.
KEEP, MERGE, RELABEL, MERGE_RELABEL, INSERT, INSERT_RELABEL = range(6)
ACTIONS = ("keep", "merge", "relabel", "merge", "keep", "relabel")


@lru_cache(maxsize=1000)
def moves(role: str | None, costs: Costs) -> tuple:
    """``(cost, way, turns added)`` from each state to each for a turn of this role, the
    cheapest way, or None."""
    out = [[None] * 4 for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            same = ROLES[b - 1] == role
            change = 0 if same else costs.relabel if role else costs.unknown
            ways = []
            if b in NEXT[a]:
                ways.append((change, KEEP if same else RELABEL, 1))
            if a == b:
                ways.append((costs.merge + change, MERGE if same else MERGE_RELABEL, 0))
            if any(b in NEXT[x] for x in NEXT[a]):
                ways.append((costs.insert + change, INSERT if same else INSERT_RELABEL, 2))
            out[a][b] = min(ways, default=None)
    return tuple(map(tuple, out))


@lru_cache(maxsize=20_000)
def table(roles: tuple, costs: Costs) -> tuple:
    """``(cost, turns added)`` from each state to each over a stretch of turns."""
    return tuple(tuple((total[-1][b][0], total[-1][b][2]) for b in range(4))
                 for total in (_forward(roles, a, costs) for a in range(4)))


def _forward(roles: tuple, start: int, costs: Costs) -> list:
    """Per turn and state: cost from ``start``, state before, turns added, way. Equal costs
    go to the earlier way, then the lower state before."""
    rows = [[(0 if s == start else FAR, s, 0, None) for s in range(4)]]
    for role in roles:
        step, last, now = moves(role, costs), rows[-1], []
        for b in range(4):
            best = (FAR, 9, b, 0)
            for a in range(4):
                if step[a][b] and last[a][0] < FAR:
                    cost, way, added = step[a][b]
                    best = min(best, (last[a][0] + cost, way, a, last[a][2] + added))
            now.append((best[0], best[2], best[3], best[1]))
        rows.append(now)
    return rows


def path(roles: tuple, start: int, end: int, costs: Costs) -> list[tuple[int, int, int]]:
    """``(state before, state after, way)`` of each turn on the cheapest way."""
    rows, out = _forward(roles, start, costs), []
    for i in range(len(roles), 0, -1):
        _, before, _, way = rows[i][end]
        out.append((before, end, way))
        end = before
    return out[::-1]


def repair_roles(turns: DataFrame, costs: Costs = Costs(), stretch: int = STRETCH) -> DataFrame:
    """Make every conversation legal at the least cost, and render it.

    Legal is: at most one system turn, first; then user and assistant in turn, user first.
    A turn may keep its role, get another, or be merged into the turn before; an empty turn
    may be inserted before it. ``turns`` has ``conv_id, turn, role, text``; other columns
    are ignored. Turns go by ``turn`` (null last), then role, then the first 64 characters
    of the text, then its hash. Roles are compared without case and blanks, usual other
    names count as the role itself, and a null or other role is unknown and cheap to name.
    A null text is empty. Rows with a null ``conv_id`` form one conversation; repeated rows
    are turns like any other, which merge.

    Returns a row per input turn and per inserted one: ``conv_id``, ``turn`` (null:
    inserted), ``out_turn`` (from 0), ``part`` (0, then rising with each turn merged),
    ``role``, ``action`` (keep, relabel, merge, insert), ``text`` and ``rendered``: joined
    by ``out_turn, part``, these make up the conversation. An empty table gives none.

    How: dynamic programming over the automaton of last roles. Turns are range-partitioned
    in their order and written once; counts per task and conversation give each its rank.
    A stretch is ``stretch`` turns that follow each other by rank, whatever their numbers
    are, and a block is ``stretch`` stretches. The cheapest costs over a stretch form a
    table from state to state, tables of a block combine to one, and so a conversation of
    any length is split: the blocks of a conversation are walked first, then the stretches
    of each block, and last each stretch is repaired between its states. Only roles and
    ranks go through these steps; texts join what was decided. A task holds one stretch,
    the tables of one block, or a table for each ``stretch ** 2`` turns of a conversation.
    """
    laid, ranked = _ranked(turns, stretch)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((conv, part, _cells(table(tuple(r["role"] for r in group), costs)))
                         for (conv, part), group in _groups(batches, 2)), _TABLE)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((conv, block, _combined([r["costs"] for r in group]))
                         for (conv, block), group in _groups(batches, 2)), _TABLE)

    def over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for _, group in _groups(batches, 1)
                         for row in _walked(group, START, None, 0)), _STATES)

    def over_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for _, group in _groups(batches, 2) for row in _walked(
            group, *(group[0][k] for k in ("enter", "leave", "first_turn")))), _STATES)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for _, group in _groups(batches, 2)
                         for row in _repaired(group, costs)), _DECIDED)

    made = materialise(
        ranked.select("conv_id", "part", "at", "role").repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "at").mapInArrow(tables, _TABLE)
        .select("conv_id", F.floor(F.col("part") / stretch).alias("block"), "part", "costs"), "tables")
    blocks = (made.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part")
              .mapInArrow(combine, _TABLE)
              .repartition("conv_id").sortWithinPartitions("conv_id", "part")
              .mapInArrow(over_blocks, _STATES))
    states = (made.join(blocks.withColumnRenamed("p", "b"), F.col("conv_id").eqNullSafe(F.col("c"))
                        & (F.col("block") == F.col("b")))
              .select("conv_id", "block", "part", "costs", "enter", "leave", "first_turn")
              .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part")
              .mapInArrow(over_stretches, _STATES))
    decided = (ranked.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
               .select("conv_id", "part", "at", "row", "role", "enter", "leave", "first_turn")
               .repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
               .mapInArrow(repaired, _DECIDED))
    mark = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    own = F.struct("conv_id", "turn", "out_turn", "part", "role", "action", "text", F.when(
        F.col("action") == "merge", F.col("text")).otherwise(F.concat(mark, "text")).alias("rendered"))
    empty = F.struct(
        "conv_id", F.lit(None).cast("long").alias("turn"), (F.col("out_turn") - 1).alias("out_turn"),
        F.lit(0).cast("long").alias("part"), F.col("before").alias("role"),
        F.lit("insert").alias("action"), F.lit("").alias("text"),
        F.concat(F.lit("<|"), F.col("before"), F.lit("|>\n")).alias("rendered"))
    return (laid.select("row", "conv_id", "turn", "text").join(decided, "row")
            .select(F.explode(F.when(F.col("before").isNull(), F.array(own))
                              .otherwise(F.array(empty, own))).alias("out"))
            .select("out.*"))


_TABLE = "conv_id long, part long, costs array<long>"
_STATES = "c long, p long, enter long, leave long, first_turn long"
_DECIDED = "row long, out_turn long, part long, role string, action string, before string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _ranked(turns: DataFrame, stretch: int) -> tuple[DataFrame, DataFrame]:
    """The turns as written in their order, each with its ``row``, and for each row its
    rank ``at`` in its conversation and its stretch ``part``.

    Copies of a row stand in the order they are read in, so that even they are spread."""
    role = F.lower(F.trim(F.col("role")))
    for name, known in SAME.items():
        role = F.when(role == name, known).otherwise(role)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(role.isin(*ROLES), role).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_copy"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", F.substring("text", 1, 64),
             F.xxhash64("text"), "_copy"]
    laid = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_copy")
        .withColumn("_task", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id()), "turns")
    pieces = laid.groupBy("_task", "conv_id").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = W.partitionBy("conv_id").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(
        F.col("_task").alias("t"), F.col("conv_id").alias("c"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    at = F.col("row") + F.col("shift")
    ranked = laid.select("_task", "conv_id", "row", "role").join(
        shifts, (F.col("_task") == F.col("t")) & F.col("conv_id").eqNullSafe(F.col("c"))).select(
            "conv_id", F.floor(at / stretch).alias("part"), at.alias("at"), "row", "role")
    return laid, materialise(ranked, "ranks")


def _groups(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows that stand together and agree in their first ``keys`` columns."""
    key, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row.values())[:keys]
            if group and own != key:
                yield key, group
                group = []
            key = own
            group.append(row)
    if group:
        yield key, group


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of 5,000, with a last one that may be empty."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    out, full = [], True
    while full:
        out = list(islice(rows, 5000))
        full = len(out) == 5000
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], _KINDS[kind]) for k, kind in enumerate(kinds)], list(names))


def _cells(made: tuple) -> list[int]:
    """A table's costs and turns in one list, by state before and after."""
    return [x for line in made for cell in line for x in cell]


def _over(tables: list[list[int]], start: int) -> list:
    """Per table and state after it: cost from ``start``, state before it, turns added."""
    rows = [[(0 if s == start else FAR, s, 0) for s in range(4)]]
    for cells in tables:
        last = rows[-1]
        rows.append([min((min(last[a][0] + cells[8 * a + 2 * b], FAR), a,
                          last[a][2] + cells[8 * a + 2 * b + 1]) for a in range(4))
                     for b in range(4)])
    return rows


def _combined(tables: list[list[int]]) -> list[int]:
    """The table over all of these tables."""
    if len(tables) == 1:
        return tables[0]
    return _cells(tuple(tuple((cost, turns) for cost, _, turns in _over(tables, a)[-1])
                        for a in range(4)))


def _walked(group: list[dict], start: int, end: int | None, turns: int) -> list[tuple]:
    """States before and after each table, from ``start`` to ``end`` (None: the cheapest),
    and turns put out before it."""
    rows = _over([r["costs"] for r in group], start)
    if end is None:
        end = min(range(4), key=lambda s: (rows[-1][s][0], s))
    between = [end]
    for line in rows[:0:-1]:
        between.append(line[between[-1]][1])
    between.reverse()
    out = []
    for r, a, b in zip(group, between[:-1], between[1:], strict=True):
        out.append((r["conv_id"], r["part"], a, b, turns))
        turns += r["costs"][2 * (4 * a + b) + 1]
    return out


def _repaired(group: list[dict], costs: Costs) -> list[tuple]:
    first = group[0]
    at, out = first["first_turn"] - 1, []
    steps = path(tuple(r["role"] for r in group), first["enter"], first["leave"], costs)
    # Turns merged at the start of a stretch continue a turn of the stretch before: their
    # parts start at a number of the stretch's own, so that they stay in order.
    part = first["part"] << 20
    for r, (before, after, way) in zip(group, steps, strict=True):
        empty = None
        if way in (INSERT, INSERT_RELABEL):
            empty = ROLES[next(x for x in NEXT[before] if after in NEXT[x]) - 1]
            at += 1
        if way in (MERGE, MERGE_RELABEL):
            part += 1
        else:
            at, part = at + 1, 0
        out.append((r["row"], at, part, ROLES[after - 1], ACTIONS[way], empty))
    return out
