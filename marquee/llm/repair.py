"""Repair of conversations: the cheapest edits that make their turns alternate, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import SPACES, stored

#: Turns that are searched at a time; longer conversations are put together from searches of this many.
PIECE = 256
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
NEVER = 1 << 60
#: States of a repaired conversation: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is inserted or given a new role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
COMPLETE = (START, ASSISTANT)
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = ("su", "ua", "au")


class Search:
    """Cheapest edits of a run of turns.

    A turn is a letter: d has to be deleted, s, u, a are kept roles, x any other; in capitals, it is unfinished. With a
    `goal` the edits lead to that state and nothing is inserted after the last turn; without one, to a complete
    conversation. `bounds[state][i]` is never more than the cost from turn i on; it starts as a heuristic and rises
    where a search has failed, so it is the table of failed states: a state is entered only with enough to spend.
    """

    def __init__(self, turns: str, goal: int | None = None):
        self.turns, self.goals, self.open = turns, COMPLETE if goal is None else (goal,), goal is None
        n = len(turns)
        alone, pairs = [0] * (n + 1), [0] * (n + 1)
        plain, blocked = [n] * (n + 1), [False] * (n + 1)  # the next plain turn; whether an x comes before it
        for i in range(n - 1, -1, -1):
            t = turns[i]
            alone[i] = alone[i + 1] + (DELETE if t == "d" or t.isupper() else REROLE if t == "x" else 0)
            if t in "sua":
                plain[i], j = i, plain[i + 1]
                clash = j < n and not blocked[i + 1] and t + turns[j] not in LEGAL
                pairs[i] = max(pairs[i + 1], REROLE + pairs[j + 1] if clash else 0)
            else:
                plain[i], blocked[i], pairs[i] = plain[i + 1], t == "x" or blocked[i + 1], pairs[i + 1]
        self.bounds = [[0] * (n + 1) for _ in range(4)]
        for state, bounds in enumerate(self.bounds):
            for i in range(n + 1):
                j = plain[i]
                misfit = j < n and not blocked[i] and (turns[j], state) not in KEEPS
                bounds[i] = alone[i] + max(pairs[i], REROLE + pairs[j + 1] if misfit else 0)
                if goal is not None and (goal == START < state or goal == SYSTEM < state):
                    bounds[i] = NEVER
            if goal is not None:
                bounds[n] = 0 if state == goal else NEVER
        if goal == SYSTEM:  # only a turn of the system that is there leads to it
            last = max((i for i, t in enumerate(turns) if t in "sS"), default=-1)
            self.bounds[START][last + 1 :] = [NEVER] * (n - last)

    def cheapest(self, start: int = START) -> tuple[int, str] | None:
        """(cost, edits), of equally cheap ones those least in ASCII; None if the goal is out of reach."""
        while (limit := self.bounds[start][0]) < NEVER:
            found = self._descend(start, limit)
            if found is not None:
                return limit, found
        return None

    def _descend(self, start: int, limit: int) -> str | None:
        """Depth first, edits in ASCII order, no dearer than `limit`; raises bounds where it fails."""
        turns, bounds, goals, n = self.turns, self.bounds, self.goals, len(self.turns)
        path: list[str] = []
        frames = [[0, start, limit, 0, NEVER, 0]]  # turn, state, left to spend, edits tried, least cost seen, cost to get here
        while frames:
            frame = frames[-1]
            i, state, left, tried = frame[:4]
            if i == n and state in goals:
                return "".join(path)
            if tried == 4 or (tried == 2 and i == n):
                bounds[state][i] = max(bounds[state][i], frame[4])
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], frame[5] + bounds[state][i])
                continue
            frame[3] += 1
            if tried == 1:
                if i == n and not self.open:
                    continue
                cost, at, to = INSERT, i, FOLLOWS[state]
            elif i == n:
                continue
            elif tried == 0:
                cost, at, to = DELETE, i + 1, state
            else:
                turn = turns[i]
                kept = KEEPS.get((turn.lower(), state))
                if turn == "d" or (kept is None if tried == 2 else kept == FOLLOWS[state]):
                    continue
                cost = (UNFINISHED if turn.isupper() else 0) + (0 if tried == 2 else REROLE)
                at, to = i + 1, kept if tried == 2 else FOLLOWS[state]
            need = cost + bounds[to][at]
            if need <= left:
                frames.append([at, to, left - cost, 0, NEVER, cost])
                path.append("DIKR"[tried])
            else:
                frame[4] = min(frame[4], need)
        return None


@lru_cache(100_000)
def whole(turns: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return Search(turns).cheapest()


def piece(turns: str) -> tuple[list[int], list[int], list[str]]:
    """For every pair of states at both ends, at 4 * first + last: cost, place among the edits of that first state, edits."""
    costs, edits = [NEVER] * 16, [""] * 16
    for last in range(4):
        search = Search(turns, last)
        for first in range(4):
            found = search.cheapest(first)
            if found:
                costs[4 * first + last], edits[4 * first + last] = found
    places = [0] * 16
    for first in range(4):
        order = sorted(range(4 * first, 4 * first + 4), key=edits.__getitem__)
        for place, k in enumerate(order):
            places[k] = place
    return costs, places, edits


#: (cost, edits) that complete a conversation which ends in a state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def chain(costs: list[list[int]], places: list[list[int]]) -> tuple[int, list[int], str]:
    """(cost, 4 * first + last of each piece, edits after the last) of the cheapest and ASCII-least way through."""
    rest = [[c for c, _ in ENDS]]
    for cost in reversed(costs):
        after = rest[-1]
        rest.append([min(cost[4 * q + p] + after[p] for p in range(4)) for q in range(4)])
    rest.reverse()
    state, ways = START, []
    for k, cost in enumerate(costs):
        good = [p for p in range(4) if cost[4 * state + p] + rest[k + 1][p] == rest[k][state]]
        last = min(good, key=lambda p: places[k][4 * state + p])
        ways.append(4 * state + last)
        state = last
    return rest[0][START], ways, ENDS[state][1]


def damage(rows: DataFrame, id_column="conv_id", turn_column="turn", role_column="role", text_column="text") -> DataFrame:
    """`rows` with faults put in by crc32("id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its .!? out,
    3 repeats it, 4 makes its role user. Null in any of the four columns counts as one space (turn and id stay null)."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_column, turn_column)])
    fault = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_column, text_column))
    return (
        rows.where(fault != 0)
        .withColumns(
            {
                role_column: F.when(fault == 4, "user").otherwise(role),
                text_column: F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
            }
        )
        .withColumn(id_column, F.explode(F.array_repeat(F.struct(F.col(id_column)), F.when(fault == 3, 2).otherwise(1))))
        .withColumn(id_column, F.col(id_column)[id_column])
    )


def _turns(rows: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_column, text_column))
    return rows.select(
        F.col(id_column).alias("id"),
        F.col(turn_column).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"),
        text.alias("text"),
    )


PIECES = "part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, last_turn long, n_turns long, costs array<long>, places array<int>, edits array<string>"


class _Run:
    """Successive turns of one conversation, up to a piece."""

    def __init__(self):
        self.turns, self.blank, self.duplicate, self.truncated, self.illegal = [], 0, 0, 0, 0
        self.head = self.tail = self.first = self.last = None
        self.distinct = 0

    def add(self, letter: str, initial: str, fault: str | None, turn: int | None) -> None:
        self.turns.append(letter)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1

    def row(self, conversation, part: int, seq: int, is_whole: bool) -> tuple:
        turns = "".join(self.turns)
        if is_whole:
            cost, edits = whole(turns)
            found = ([cost], [0], [edits])
        else:
            found = piece(turns)
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return conversation, part, seq, is_whole, *counts, self.head, self.tail, self.first, self.last, self.distinct, *found


def _with_id(schema: str, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL(schema).fields])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), schema.types)], schema=schema)
            buffer = []
    if buffer:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), schema.types)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _searched(turns: DataFrame, per_piece: int) -> DataFrame:
    """Pieces of conversations in order, each with its cheapest edits."""
    bare = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    known = turns.select(
        "id", "turn", "role", "h",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (bare == "").alias("is_blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    keys = ["id", "turn", "role", "h"]
    # equal rows of a turn come as one, with their number
    known = stored(known.groupBy(*keys, "initial", "is_blank", "is_cut").agg(F.count("*").alias("n")), "turns")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = known.groupBy("id", "role", "h").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a < b")
    again = again.select(*[F.col(c).alias(c + "_") for c in ("id", "role", "h")], "a")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("role") == F.col("role_")) & (F.col("h") == F.col("h_"))
    seen = known.join(again, same, "left").withColumn("is_again", F.coalesce(at > F.col("a"), F.lit(False)))
    order = [F.col(c).asc_nulls_first() for c in keys]
    columns = ["id", "turn", "initial", "is_blank", "is_cut", "is_again", "n"]
    sorted_rows = seen.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    schema = _with_id(PIECES, turns.schema["id"].dataType)
    arrow = _arrow(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, run, current, split = TaskContext.get().partitionId(), 0, None, None, True
        for batch in batches:
            for conversation, turn, initial, blank, cut, again, n in zip(*[c.to_pylist() for c in batch.columns]):
                if run is None or conversation != current:
                    if run is not None:
                        yield run.row(current, part, seq, not split)
                        seq, split = seq + 1, False  # only the first conversation may have begun in another partition
                    run, current = _Run(), conversation
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                letter = "d" if blank or again else initial.upper() if cut else initial
                for k in range(n):
                    if len(run.turns) == per_piece:
                        yield run.row(current, part, seq, False)
                        run, seq, split = _Run(), seq + 1, True
                    if k == 1:
                        fault, letter = fault if blank else "duplicate", "d"
                    run.add(letter, initial, fault, turn)
        if run is not None:  # it may go on in the next partition
            yield run.row(current, part, seq, False)

    return stored(sorted_rows.mapInArrow(lambda b: _batches(pieces(b), arrow, 100), schema), "pieces")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _gaps(first: int | None, last: int | None, distinct: int) -> int | None:
    gaps = 0 if first is None else last - first + 1 - distinct
    return gaps if gaps < 1 << 63 else None


def _solved(pieces: DataFrame) -> DataFrame:
    """(id, part, seq, edits, counts): the edits of each piece; the first piece of a conversation bears its counts."""
    schema = _with_id(f"part int, seq long, way int, tail_edits string, {COUNTS}", pieces.schema["id"].dataType)
    arrow = _arrow(schema)

    def link(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        cost, ways, ending = chain([r["costs"] for r in rows], [r["places"] for r in rows])
        first = next((r["first_turn"] for r in rows if r["n_turns"]), None)
        distinct, last, illegal, tail = 0, None, 0, None
        for r in rows:
            illegal += r["illegal"] + (tail is not None and tail + r["head"] not in LEGAL)
            tail = r["tail"]
            if r["n_turns"]:
                distinct, last = distinct + r["n_turns"] - (r["first_turn"] == last), r["last_turn"]
        sums = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")]
        counts, none = (_gaps(first, last, distinct), *sums, illegal, cost), (None,) * 6
        out = [
            (r["id"], r["part"], r["seq"], ways[k], ending if k + 1 == len(rows) else "", *(none if k else counts))
            for k, r in enumerate(rows)
        ]
        return pa.Table.from_batches(list(_batches(out, arrow, len(out))), arrow)

    counted = ["blank", "duplicate", "truncated", "illegal"]
    alone = pieces.where("whole").select(
        "id", "part", "seq", F.col("edits")[0].alias("edits"),
        F.when(F.col("n_turns") == 0, 0).otherwise(
            F.expr("try_cast(cast(last_turn as decimal(38,0)) - first_turn + 1 - n_turns as bigint)")
        ).alias("gaps"),
        *counted, F.col("costs")[0].alias("cost"),
    )
    cut = pieces.where("not whole")
    ways = cut.drop("edits").groupBy("id").applyInArrow(link, schema)
    chosen = ways.join(cut.select("part", "seq", F.col("edits").alias("each")), ["part", "seq"])
    linked = chosen.select(
        "id", "part", "seq", F.concat(F.get("each", F.col("way")), "tail_edits").alias("edits"), "gaps", *counted, "cost"
    )
    return alone.unionByName(linked)


ROLES = {USER: "user", ASSISTANT: "assistant"}


class _Repair:
    """Applies edits to the turns of one conversation as they come."""

    def __init__(self):
        self.parts, self.edits, self.at, self.state = [], "", 0, START
        self.counts = None

    def learn(self, edits: str, counts: tuple | None) -> None:
        self.parts.append(edits)
        self.counts = counts or self.counts

    def begin(self) -> None:
        if self.parts:
            self.edits, self.parts = "".join(self.parts), []

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at, self.state = self.at + 1, FOLLOWS[self.state]
            yield ROLES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.state = KEEPS[role[:1], self.state]
            yield role, text
        elif edit == "R":
            self.state = FOLLOWS[self.state]
            yield ROLES[self.state], text


def _streamed(turns: DataFrame, ids: DataFrame, per_piece: int) -> DataFrame:
    """Every conversation in one stream: its id, the edits of its pieces, then its turns in order."""
    solved = _solved(_searched(turns, per_piece))
    counts = F.when(F.col("cost").isNotNull(), F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    kind = {"step": F.lit(1), "edits": F.col("edits"), "counts": counts, "part": F.col("part"), "seq": F.col("seq")}
    edits = solved.select("id", *[v.alias(k) for k, v in kind.items()])
    rows = turns.withColumn("step", F.lit(2)).unionByName(edits, allowMissingColumns=True)
    rows = rows.unionByName(ids.select("id", F.lit(0).alias("step")), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("id", "step", "part", "seq", "turn", "role", "h")]
    return rows.repartition("id").sortWithinPartitions(*order).select("id", "step", "edits", "counts", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Repair | None, tuple | None]]:
    """(id, repair, turn): a repair without a turn ends its conversation."""
    repair, current = None, None
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, 256):
            batch = whole_batch.slice(start, 256)
            for conversation, step, edits, counts, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if repair is None or conversation != current:
                    if repair is not None:
                        yield current, repair, None
                    repair, current = _Repair(), conversation
                if step == 1:
                    repair.learn(edits, counts and tuple(counts.values()))
                elif step == 2:
                    repair.begin()
                    yield current, repair, (role, text)
    if repair is not None:
        yield current, repair, None


def repair_conversations(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    ids: DataFrame | None = None,
    per_piece: int = PIECE,
) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    The turns of a conversation come by turn (nulls first), equal turns by role and the SHA-256 of the text. A turn's
    first fault counts: blank (no sign but white space), duplicate (role and text of an earlier turn), truncated (its
    last sign is none of .!?). `gaps` are whole numbers missing between least and largest turn (nulls do not count; null
    where a long cannot hold it), `illegal` the neighbours whose roles begin with none of su, ua, au. Edits: Keep costs
    0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn of user or assistant) 5; blank and duplicate
    turns are deleted, a truncated one that is not costs 5 more. `audit` holds the initials of the cheapest edits after
    which the roles begin like `(s?(ua)+)?`, of equally cheap ones the least in ASCII; the digest is over the lines
    `role:text` of what they leave (`repaired_turns` has the turns themselves).

    Null role or text counts as one space; a null id is a conversation of its own, repeated rows are duplicates, texts
    may be of any length. `ids`, a table with id_column, adds conversations without turns: zeros, an empty audit and the digest
    of nothing. An empty table gives an empty result; other columns are ignored.

    Search takes runs of turns that follow each other in a range-partitioned order, `per_piece` at most: a conversation
    in several runs is put together from the cheapest way between every two states of each, which gives the same
    answer. So only the digest, which has no other form, passes a conversation through one task, turn by turn.
    """
    columns = (id_column, turn_column, role_column, text_column)
    turns = _turns(rows, *columns)
    each = (rows if ids is None else ids).select(F.col(id_column).alias("id")).distinct()
    schema = T.StructType([T.StructField(id_column, rows.schema[id_column].dataType)])
    for field in T.StructType.fromDDL(f"{COUNTS}, audit string, repaired_sha256 string").fields:
        schema.add(field)
    arrow = _arrow(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, empty = hashlib.sha256(), True
        for conversation, repair, turn in _conversations(batches):
            for role, text in repair.turn(*turn) if turn else repair.inserts():
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if turn is None:
                yield conversation, *(repair.counts or (0,) * 6), repair.edits, digest.hexdigest()
                digest, empty = hashlib.sha256(), True

    return _streamed(turns, each, per_piece).mapInArrow(lambda b: _batches(digests(b), arrow), schema)


def repaired_turns(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    per_piece: int = PIECE,
) -> DataFrame:
    """(id, turn, role, text): what the edits of `repair_conversations` leave, turns numbered from 0."""
    turns = _turns(rows, id_column, turn_column, role_column, text_column)
    schema = T.StructType([T.StructField(id_column, rows.schema[id_column].dataType)])
    schema = schema.add(turn_column, "long").add(role_column, "string").add(text_column, "string")
    arrow = _arrow(schema)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        n = 0
        for conversation, repair, turn in _conversations(batches):
            for role, text in repair.turn(*turn) if turn else repair.inserts():
                yield conversation, n, role, text
                n += 1
            n = n if turn else 0

    return _streamed(turns, turns.select("id").distinct(), per_piece).mapInArrow(lambda b: _batches(left(b), arrow, 256), schema)
