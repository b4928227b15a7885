"""Chat formatting: role repair at least cost over an automaton of legal turns, then rendering.

Legal is an optional system turn, then user and assistant in turn, user first, assistant last. Each turn of a
conversation is kept, relabelled, or merged into the turn before it, and empty turns may be inserted before it or at the
end, at the costs below. Dynamic programming finds the cheapest repair; of equal repairs the one whose actions come first
in ``ACTIONS``, from the last turn back.

The costs of a stretch of turns are a matrix over automaton states, and stretches compose by min-plus products. So
conversations are cut into chunks: of ``CHUNK`` turn numbers, and these, where numbers are null or repeat, of ``CHUNK``
rows. A task reduces a chunk to 16 numbers, the chunks of a conversation are then chained (one row in 4,096; what the
chain keeps of each is 20 bytes), and each chunk is traced back by itself between its fixed states. A conversation that
holds a third of all turns, or a third of all turns without conversation or number, is thus many groups. Texts take no
part in this: they are stored with a row number, and meet what was decided for their row in one join.

Result: a row a turn. ``rendered`` of a conversation's turns, joined in order, is its text.

Defined results. Null role, or one that isn't system, user or assistant (any case, spaces trimmed): unknown, relabelled at
``UNKNOWN``. Null text: empty. Turns are ordered by number, null last, then role and a hash of the text, so equal rows are
turns of their own. Null conv_id is a conversation. Marks within texts are broken up so that they aren't read as marks.
Empty table: no rows. Other columns are never read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import numbered, partitions, stored

MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
CHUNK = 4096
ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn. Unknown roles are number 4.
START, SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3, 4
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "relabel", "merge", "merge_relabel", "insert_keep", "insert_relabel")
_FAR = 1 << 40
BEGIN, END = "<|im_start|>", "<|im_end|>"


@cache
def _moves(role: int) -> dict[int, list[tuple[int, int, int, tuple[int, ...]]]]:
    """From each state: ``(cost, action, next state, roles inserted before)``, the best for each next state."""
    relabel = UNKNOWN if role == OTHER else RELABEL
    out = {}
    for q in range(4):
        best: dict[int, tuple[int, int, int, tuple[int, ...]]] = {}

        def offer(cost: int, action: int, to: int, inserted: tuple[int, ...] = (), best=best) -> None:
            if to not in best or (cost, action, len(inserted)) < (best[to][0], best[to][1], len(best[to][3])):
                best[to] = (cost, action, to, inserted)

        for to in _NEXT[q]:
            offer(0 if to == role else relabel, 0 if to == role else 1, to)
        if q != START:
            offer(MERGE + (0 if q == role else relabel), 2 if q == role else 3, q)
        # Up to two empty turns lead to any role that may still come.
        for mid in _NEXT[q]:
            for to in _NEXT[mid]:
                offer(INSERT + (0 if to == role else relabel), 4 if to == role else 5, to, (mid,))
                for last in _NEXT[to]:
                    offer(2 * INSERT + (0 if last == role else relabel), 4 if last == role else 5, last, (mid, to))
        out[q] = list(best.values())
    return out


#: Empty turns that end a conversation legally from each state.
_ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else OTHER


def matrix(roles: list[int]) -> list[int]:
    """Least costs of a stretch, from each state to each, row by row."""
    cost = [[0 if a == b else _FAR for b in range(4)] for a in range(4)]
    for role in roles:
        moves = _moves(role)
        new = [[_FAR] * 4 for _ in range(4)]
        for q in range(4):
            for c, _, to, _ in moves[q]:
                for a in range(4):
                    if cost[a][q] + c < new[a][to]:
                        new[a][to] = cost[a][q] + c
        cost = new
    return [x for row in cost for x in row]


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """The moves of the cheapest way through a stretch between two states."""
    cost, back = [_FAR] * 4, []
    cost[entry] = 0
    for role in roles:
        new, via = [_FAR] * 4, [None] * 4
        for q in range(4):
            if cost[q] < _FAR:
                for move in _moves(role)[q]:
                    key = (cost[q] + move[0], move[1], q)
                    if via[move[2]] is None or key < via[move[2]][0]:
                        via[move[2]] = (key, q, move)
        for to, v in enumerate(via):
            if v:
                new[to] = v[0][0]
        back.append(via)
        cost = new
    out, state = [], leave
    for via in reversed(back):
        _, q, move = via[state]
        out.append(move)
        state = q
    return out[::-1]


def chain(matrices: Iterable[list[int]]) -> list[tuple[int, int]]:
    """The entry and exit state of each stretch of a conversation, for the least total cost with a legal end."""
    cost, back = [0, _FAR, _FAR, _FAR], bytearray()
    for m in matrices:
        via = [min((cost[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
        back += bytes(a for _, a in via)
        cost = [c for c, _ in via]
    state = min(range(4), key=lambda q: (cost[q] + INSERT * len(_ENDS[q]), q))
    states = bytearray([state])
    for k in range(len(back) - 4, -1, -4):
        state = back[k + state]
        states.append(state)
    states.reverse()
    return list(zip(states, states[1:]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _long(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(n, pa.int64()) for n in names]


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place among the rows of its ``(conv_id, chunk)`` in this partition, and the partition's number."""
    pid = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        now, k = None, 0
        for conv, chunk, row, r in _rows(batches):
            k = k + 1 if (conv, chunk) == now else 0
            now = (conv, chunk)
            yield conv, chunk, row, r, pid, k

    return _batches(rows(), pa.schema(_long("conv_id", "chunk", "row", "r", "pid", "local")))


def _grouped(rows: Iterator[tuple], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    for key, group in groupby(rows, lambda row: row[:n_keys]):
        yield key, (row[n_keys:] for row in group)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_long("conv_id", "chunk", "sub"), ("m", pa.list_(pa.int64()))])
    return _batches(((*key, matrix([r for (r,) in rows])) for key, rows in _grouped(_rows(batches), 3)), schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv,), group in _grouped(_rows(batches), 1):
            chunks, subs, no_chunk = array("q"), array("q"), bytearray()

            def matrices(group=group, chunks=chunks, subs=subs, no_chunk=no_chunk) -> Iterator[list[int]]:
                for chunk, sub, m in group:
                    chunks.append(chunk or 0)
                    no_chunk.append(chunk is None)
                    subs.append(sub)
                    yield m

            ways = chain(matrices())
            for k, (entry, leave) in enumerate(ways):
                yield conv, None if no_chunk[k] else chunks[k], subs[k], entry, leave, k == len(ways) - 1

    return _batches(rows(), pa.schema([*_long("conv_id", "chunk", "sub", "entry", "leave"), ("last", pa.bool_())]))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each row of a chunk: new role, action, turns inserted, cost, and what stands before and after its text."""
    name = lambda q: ROLES[q - 1]
    empty = lambda q: f"{BEGIN}{name(q)}\n{END}\n"

    def rows() -> Iterator[tuple]:
        for (_, _, _, entry, leave, last), group in _grouped(_rows(batches), 6):
            turns = list(group)
            state = entry
            moves = trace([r for _, r in turns], entry, leave)
            for k, ((row, _), (cost, action, to, inserted)) in enumerate(zip(turns, moves)):
                if action in (2, 3):
                    before = "\n\n"
                else:
                    before = (f"{END}\n" if state != START else "") + "".join(map(empty, inserted)) + f"{BEGIN}{name(to)}\n"
                extra, after = len(inserted), ""
                if last and k == len(turns) - 1:
                    after = f"{END}\n" + "".join(map(empty, _ENDS[to]))
                    extra += len(_ENDS[to])
                    cost += INSERT * len(_ENDS[to])
                yield row, name(to), ACTIONS[action], extra, cost, before, after
                state = to

    return _batches(rows(), pa.schema([*_long("row"), ("new_role", pa.string()), ("action", pa.string()), *_long("inserted", "cost"), ("before", pa.string()), ("after", pa.string())]))


def format_chats(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, turn, role, new_role, action, inserted, cost, rendered)`` from ``turns(conv_id, turn, role, text)``."""
    n = partitions(turns.sparkSession)
    base = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    base = numbered(base, "turns", "row")
    known = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    number = F.coalesce(F.array_position(F.lit(list(ROLES)), known), F.lit(0))
    small = base.select(
        "conv_id", F.floor(F.col("turn") / chunk).cast("bigint").alias("chunk"), "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("h"), "row",
        F.when(number > 0, number).otherwise(OTHER).cast("bigint").alias("r"),
    )
    # In order, with the row number last, equal rows may lie in several partitions; a chunk's parts then follow each other.
    order = ["conv_id", F.col("chunk").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "h", "row"]
    laid = small.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "chunk", "row", "r")
    laid = stored(laid.mapInArrow(_ordinals, "conv_id bigint, chunk bigint, row bigint, r bigint, pid bigint, local bigint"), "laid")
    # A row a partition for each chunk: what comes before a part of a chunk is the sum of the parts before it.
    parts = laid.groupBy("conv_id", "chunk", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id", "chunk").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    later = parts.select(F.col("conv_id").alias("c2"), F.col("chunk").alias("k2"), F.col("pid").alias("p2"), before.alias("before")).filter("before is not null")
    joined = laid.join(later, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("chunk").eqNullSafe(F.col("k2")) & (F.col("pid") == F.col("p2")), "left")
    place = F.col("local") + F.coalesce("before", F.lit(0))
    cut = stored(joined.select("conv_id", "chunk", F.floor(place / chunk).cast("bigint").alias("sub"), place.alias("place"), "row", "r"), "cut")
    keys, by_chunk = ["conv_id", "chunk", "sub"], ["conv_id", F.col("chunk").asc_nulls_last(), "sub", "place"]
    reduced = cut.repartition(n, *keys).sortWithinPartitions(*by_chunk).select(*keys, "r").mapInArrow(_reduce, "conv_id bigint, chunk bigint, sub bigint, m array<bigint>")
    chained = reduced.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("chunk").asc_nulls_last(), "sub")
    states = stored(chained.mapInArrow(_chain, "conv_id bigint, chunk bigint, sub bigint, entry bigint, leave bigint, last boolean"), "states")
    s = states.select(F.col("conv_id").alias("c2"), F.col("chunk").alias("k2"), F.col("sub").alias("s2"), "entry", "leave", "last")
    fixed = cut.join(s, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("chunk").eqNullSafe(F.col("k2")) & (F.col("sub") == F.col("s2")))
    fixed = fixed.repartition(n, *keys).sortWithinPartitions(*by_chunk).select(*keys, "entry", "leave", "last", "row", "r")
    decided = fixed.mapInArrow(_decide, "row bigint, new_role string, action string, inserted bigint, cost bigint, before string, after string").withColumnRenamed("row", "own")
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return base.join(decided, F.col("row") == F.col("own")).select("conv_id", "turn", "role", "new_role", "action", "inserted", "cost", F.concat("before", body, "after").alias("rendered"))
