"""Chat formatting: repair a conversation's roles at minimum cost, then render it.

A legal conversation is an optional system turn followed by user and assistant turns in
alternation, the last an assistant's. Dynamic programming over that automaton's states chooses,
for every turn, to keep it, relabel it, merge it into the turn before, and whether to insert an
empty turn first.

The step from state to state that a turn allows is a small matrix of costs, and following turns
compose by (min, +) products. A long conversation is therefore cut into chunks of turns: chunk
matrices are composed, level by level in groups of bounded size, the states at the chunks' borders
are found from the top down, and every chunk is then repaired by itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROLES = ("system", "user", "assistant")
#: states of the automaton: nothing yet, or the role of the last turn
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
FAR = 1 << 60


@dataclass(frozen=True)
class Settings:
    """Costs of the repairs, and the turns of a chunk and chunks of a level's group."""

    relabel: int = 4
    unknown: int = 1  # giving a legal role to a turn that has none
    merge: int = 2
    insert: int = 3
    chunk_turns: int = 512
    fan: int = 512


#: (cost, new state, inserted roles, merged, role): one way to take a turn
Step = tuple[int, int, tuple[int, ...], bool, int]


def _inserted(state: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """States within reach by empty user or assistant turns; no state twice but the state itself."""
    yield state, ()
    seen, ends = {state}, [(state, ())]
    while ends:
        now, roles = ends.pop(0)
        for role in FOLLOWS[now]:
            if role != SYSTEM and role not in seen:
                seen.add(role)
                ends.append((role, (*roles, role)))
                yield role, (*roles, role)


def steps(role: int, state: int, s: Settings) -> list[Step]:
    """All ways to take a turn with a role (0 for an unknown one) in a state; the least cost to
    each new state comes first, ties in a fixed order."""
    out: list[Step] = []

    def label(new: int) -> int:
        return 0 if new == role else s.relabel if role else s.unknown

    for reached, roles in _inserted(state):
        cost = s.insert * len(roles)
        for new in FOLLOWS[reached]:
            out.append((cost + label(new), new, roles, False, new))
        if reached != START and not roles:
            out.append((s.merge + label(reached), reached, (), True, reached))
    return sorted(out)


def matrix(role: int, s: Settings) -> list[list[int]]:
    """Least cost from state to state over one turn."""
    return [[min((c for c, new, *_ in steps(role, a, s) if new == b), default=FAR) for b in range(4)] for a in range(4)]


def compose(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """The (min, +) product: first a, then b."""
    return [[min(min(x[k] + b[k][j] for k in range(4)), FAR) for j in range(4)] for x in a]


def ending(state: int, s: Settings) -> tuple[int, tuple[int, ...]]:
    """Least cost and empty turns from a state to a legal end."""
    return min((s.insert * len(roles), roles) for reached, roles in _inserted(state) if reached == FINAL)


def best_exit(costs: list[int], s: Settings) -> int:
    """The state to stop in, given the cost of each."""
    return min(range(4), key=lambda k: (costs[k] + ending(k, s)[0], k))


def borders(matrices: list[list[list[int]]], entry: int, leave: int) -> list[int]:
    """States before each of the matrices on the cheapest way from entry to leave."""
    cost = [[FAR] * 4]
    cost[0][entry] = 0
    for m in matrices:
        cost.append([min(min(cost[-1][k] + m[k][j] for k in range(4)), FAR) for j in range(4)])
    out = [leave]
    for at in range(len(matrices) - 1, -1, -1):
        out.append(min(range(4), key=lambda k: (cost[at][k] + matrices[at][k][out[-1]], k)))
    return out[:0:-1]


def number(role: str | None) -> int:
    """A role's state, whatever its case and outer space; 0 if it is none of ROLES."""
    plain = (role or "").strip().lower()
    return ROLES.index(plain) + 1 if plain in ROLES else 0


def repair(roles: list[int], entry: int, leave: int | None, s: Settings) -> tuple[int, list[Step], int]:
    """Cost, the step taken for each turn, and the last state; leave None: stop where ending is cheapest."""
    table = {(r, a): steps(r, a, s) for r in set(roles) for a in range(4)}
    cost, chosen = [FAR] * 4, []
    cost[entry] = 0
    for r in roles:
        new, how = [FAR] * 4, [None] * 4
        for a in range(4):
            if cost[a] < FAR:
                for step in table[r, a]:
                    total = cost[a] + step[0]
                    if total < new[step[1]]:
                        new[step[1]], how[step[1]] = total, (a, step)
        cost = new
        chosen.append(how)
    state = best_exit(cost, s) if leave is None else leave
    total, out, at = cost[state], [], state
    for how in reversed(chosen):
        at, step = how[at]
        out.append(step)
    return total, out[::-1], state


def escape(text: str) -> str:
    """Text in which no marker can be read."""
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def opening(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSING = "\n<|end|>\n"


def render(texts: list[str], taken: list[Step], entry: int, closing: tuple[int, ...] | None) -> str:
    """The repaired turns; closing: the empty turns at the conversation's end, None if it goes on.

    Renderings of a conversation's chunks, joined, are the rendering of the whole.
    """
    out, opened = [], entry != START
    for text, (_, _, inserted, merged, role) in zip(texts, taken, strict=True):
        for extra in inserted:
            out.append((CLOSING if opened else "") + opening(extra))
            opened = True
        out.append("\n" if merged else (CLOSING if opened else "") + opening(role))
        out.append(escape(text))
        opened = True
    if closing is not None:
        out += [CLOSING + opening(role) for role in closing]
        out.append(CLOSING if opened else "")
    return "".join(out)


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _border_states(turns: DataFrame, kind: str, s: Settings) -> DataFrame:
    """(conv_id, chunk, entry, leave) for the conversations that have several chunks."""
    several = turns.groupBy("conv_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select(F.col("conv_id").alias("many"))
    roles = turns.join(several, F.col("conv_id").eqNullSafe(F.col("many")), "left_semi").select("conv_id", "chunk", "place", "role", "tie")

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = {r: matrix(r, s) for r in range(4)}
        for (conv, chunk), group in _grouped(batches, 2):
            m = each[number(group[0][3])]
            for row in group[1:]:
                m = compose(m, each[number(row[3])])
            yield _row((conv, chunk, sum(m, [])), kind)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, up), group in _grouped(batches, 2):
            m = _square(group[0][3])
            for row in group[1:]:
                m = compose(m, _square(row[3]))
            yield _row((conv, up, sum(m, [])), kind)

    schema = f"conv_id {kind}, chunk long, cost array<long>"
    # levels go on until no conversation has two chunks
    at = roles.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place", "tie").drop("tie").mapInArrow(chunks, schema)
    levels = [materialize(at, "chat-level")]
    while True:
        up = levels[-1].select("conv_id", F.floor(F.col("chunk") / s.fan).alias("up"), "chunk", "cost")
        if up.groupBy("conv_id").agg(F.min("up").alias("a"), F.max("up").alias("b")).where("a < b").isEmpty():
            break
        levels.append(materialize(up.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "chunk").mapInArrow(join, schema), "chat-level"))

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), group in _grouped(batches, 2):
            squares = [_square(row[3]) for row in group]
            entry, leave = group[0][4], group[0][5]
            if leave is None:
                whole = squares[0]
                for m in squares[1:]:
                    whole = compose(whole, m)
                leave = best_exit(whole[entry], s)
            states = [*borders(squares, entry, leave), leave]
            last = [group[0][6] and k == len(group) - 1 for k in range(len(group))]
            columns = [pa.array([conv] * len(group), _type(kind)), *(pa.array(c, pa.int64()) for c in ([r[2] for r in group], states[:-1], states[1:])), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "entry", "leave", "last"])

    known = None
    for level in reversed(levels):
        below = level.select("conv_id", F.floor(F.col("chunk") / s.fan).alias("up"), "chunk", "cost")
        if known is None:
            below = below.select("*", F.lit(START).cast("long").alias("entry"), F.lit(None).cast("long").alias("leave"), F.lit(True).alias("last"))
        else:
            above = known.select(F.col("conv_id").alias("conv0"), F.col("chunk").alias("up0"), "entry", "leave", "last")
            below = below.join(above, F.col("conv_id").eqNullSafe(F.col("conv0")) & (F.col("up") == F.col("up0"))).drop("conv0", "up0")
        known = materialize(below.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "chunk").mapInArrow(resolve, f"conv_id {kind}, chunk long, entry long, leave long, last boolean"), "chat-borders")
    return known


def _type(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.string()


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[4 * k : 4 * k + 4] for k in range(4)]


def _row(row: tuple, kind: str) -> pa.RecordBatch:
    conv, chunk, cost = row
    return pa.RecordBatch.from_arrays([pa.array([conv], _type(kind)), pa.array([chunk], pa.int64()), pa.array([cost], pa.list_(pa.int64()))], ["conv_id", "chunk", "cost"])


def repaired(turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Repair and render every conversation of turns (conv_id, turn, role, text).

    One row per conversation of up to s.chunk_turns turns; a longer one comes in several segments, of
    as many turns at most: conv_id, segment, n_turns, n_out (turns it opens, with inserted ones), cost,
    merges, relabels, inserts, rendered. The segments of a conversation, joined in the order of their
    numbers, which ascend but have gaps, are its rendering.

    Turns go by turn number, then role and text; a null number comes last; repeated rows are turns
    of their own. A null text is empty. An unknown or null role costs less to relabel. Null conv_ids
    form one conversation. No rows: no rows. Markers within texts are escaped; other columns are not
    read. However many rows have one conversation or turn number, no task holds more than a chunk.
    """
    kind = "bigint" if turns.schema["conv_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    place = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1))
    rows = turns.select(F.col("conv_id").cast(kind).alias("conv_id"), place.alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.struct(F.coalesce("role", F.lit("")), F.xxhash64("text")))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > s.chunk_turns)
    sizes = materialize(sizes.select(F.col("conv_id").alias("conv0")), "chat-long")
    same = F.col("conv_id").eqNullSafe(F.col("conv0"))
    rows, states = _placed(rows, sizes, same, kind, s)
    states = states.select(F.col("conv_id").alias("conv0"), F.col("chunk").alias("chunk0"), "entry", "leave", "last")
    joined = rows.join(states, same & (F.col("chunk") == F.col("chunk0")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for (conv, chunk), group in _grouped(batches, 2):
            entry, leave, last = group[0][4:7]
            alone = leave is None
            entry = START if alone else entry
            cost, taken, state = repair([number(r[2]) for r in group], entry, leave, s)
            closing = ending(state, s) if alone or last else None
            inserts = sum(len(t[2]) for t in taken) + (len(closing[1]) if closing else 0)
            merges = sum(t[3] for t in taken)
            relabels = sum(t[4] != number(r[2]) for t, r in zip(taken, group, strict=True))
            text = render([r[3] for r in group], taken, entry, closing[1] if closing else None)
            held.append((conv, chunk, len(group), len(group) - merges + inserts, cost + (closing[0] if closing else 0), merges, relabels, inserts, text))
            if len(held) >= 1000 or len(text) > 1 << 20:
                yield _batch(held, kind)
                held = []
        if held:
            yield _batch(held, kind)

    ordered = joined.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place", "tie").select("conv_id", "chunk", "role", "text", "entry", "leave", "last")
    return ordered.mapInArrow(run, f"conv_id {kind}, segment long, n_turns long, n_out long, cost long, merges long, relabels long, inserts long, rendered string")


def _placed(rows: DataFrame, sizes: DataFrame, same: Column, kind: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """rows with their chunk, and the states at the borders of long conversations' chunks.

    Long conversations are sorted across tasks, by row where all else is alike, and cut by position.
    """
    short = rows.join(sizes, same, "left_anti").select("conv_id", F.lit(0).cast("long").alias("chunk"), "place", "tie", "role", "text")
    if sizes.isEmpty():
        return short, rows.sparkSession.createDataFrame([], f"conv_id {kind}, chunk long, entry long, leave long, last boolean")
    order = ["conv_id", "place", "tie", "row"]
    dealt = rows.join(sizes, same, "left_semi").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # numbers ascend through partitions, and a partition's first one is a multiple of any power of two
    step = 1 << (s.chunk_turns.bit_length() - 1)
    numbered = dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), "tie", "role", "text")
    long = materialize(numbered.select("conv_id", F.floor(F.col("place") / step).alias("chunk"), "place", "tie", "role", "text"), "chat-chunks")
    return short.unionByName(long), _border_states(long, kind, s)


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = [_type(kind), *[pa.int64()] * 7, pa.string()]
    names = ["conv_id", "segment", "n_turns", "n_out", "cost", "merges", "relabels", "inserts", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
