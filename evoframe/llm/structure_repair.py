"""Repair of conversation structure by tight arcs of a cost graph.

A conversation's rows, in order, are to become one whose role initials read `(s?(ua)+)?`. Keep costs 0, Rerole (to user or
assistant) 3, Delete 4, Insert of an empty user or assistant turn 3; a blank row or one whose role and text came before has
to be deleted, and a row that does not end in `.`, `!` or `?` costs 3 more unless it is deleted. Of the cheapest edits those
with the least letters (D, I, K, R) are taken.

The nodes of the graph are (rows read, state), the states being: nothing yet, after the system turn, after a user's, after
an assistant's. Forward costs F from the start and backward costs B to the end are found for all nodes; an arc u -> v of
cost c is on a cheapest path exactly if F[u] + c + B[v] is the least total. The walk starts with the first node as its
frontier, takes the least letter of all such arcs that leave the frontier, and goes on with the set of nodes they lead to.
Only differences of costs at one place matter and these are few, so every step is remembered by what it depends on.

Scale: rows are dealt to tasks by ranges of (conversation, turn, role, beginning of the text), so a conversation of any
size is spread over tasks, in segments of some SEGMENT bytes. Each segment has the costs from each state to each other; a
pass over these from the last segment back gives the backward costs at the end of every segment, and then the segments of
a conversation are walked in order, one at a time. Identical rows are counted before the shuffle, and earlier occurrences
come from the least turn of (conversation, digest of role and text), joined only where a text is in several turns.

Cases: rows go by turn (nulls first), then role, then text, by bytes; null roles and texts read as one space; an empty role
has no initial and cannot be kept; a null conversation is one of its own; an empty table gives an empty result; other columns
are ignored. `copies`, if named, is a column that says how often a row is there; a row with 0 only says that there is such a
conversation. The digest of a repaired conversation reads its turns one after another, which no machine can share; it takes
a segment at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, returning

SEGMENT = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: What the initial of a row's role says; a row's code is its initial and 4 times its fault.
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = [[pair in ("su", "ua", "au") for pair in (x + y for y in "sua ")] for x in "sua "]
RE_ROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
NEVER = 64  #: states differ by less than this where they matter: a delete and two inserts reach whatever the others do
END = (0, 2 * INSERT, INSERT, 0)
Costs = tuple[int, int, int, int]


@functools.cache
def arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of the edits that read a row."""
    found = [("D", s, s, DELETE) for s in range(4)]
    if code >> 2 <= TRUNCATED:
        more = CUT if code >> 2 == TRUNCATED else 0
        found += [("K", s, t, more) for s, t in KEPT[code & 3].items()] + [("R", s, t, RE_ROLE + more) for s, t in NEXT.items()]
    return tuple(found)


def _least(costs: list[int]) -> tuple[Costs, int]:
    base = min(costs)
    return tuple(c - base if c - base < NEVER else NEVER for c in costs), base


def _inserted(costs: list[int]) -> list[int]:
    for _ in range(2):
        for s, t in NEXT.items():
            costs[t] = min(costs[t], costs[s] + INSERT)
    return costs


@functools.cache
def forward(f: Costs, code: int) -> tuple[Costs, int]:
    """Costs to the states after a row (and inserts), less the least of them, and that least."""
    after = [NEVER * 4] * 4
    for _, s, t, c in arcs(code):
        after[t] = min(after[t], f[s] + c)
    return _least(_inserted(after))


@functools.cache
def backward(b: Costs, code: int) -> tuple[Costs, int]:
    """Costs from the states before a row (and inserts) to the end, given those after it."""
    before = [NEVER * 4] * 4
    for _, s, t, c in arcs(code):
        before[s] = min(before[s], c + b[t])
    for _ in range(2):
        for s, t in NEXT.items():
            before[s] = min(before[s], INSERT + before[t])
    return _least(before)


@functools.cache
def walk(f: Costs, code: int, b: Costs, frontier: frozenset[int]) -> tuple[str, tuple[int, ...], frozenset[int]]:
    """The least letters up to and with the one that reads the row, the states they lead to, and the frontier after it.
    f: forward costs before the row; b: backward costs after it."""
    here, base = backward(b, code)
    total = min(x + y for x, y in zip(f, here)) + base
    letters, states = "", []
    while True:
        tight = [("I", t, False) for s, t in NEXT.items() if s in frontier and f[s] + INSERT + here[t] + base == total]
        tight += [(letter, t, True) for letter, s, t, c in arcs(code) if s in frontier and f[s] + c + b[t] == total]
        letter, _, reads = min(tight)
        frontier = frozenset(t for other, t, _ in tight if other == letter)
        letters += letter
        states.append(min(frontier))
        if reads:
            return letters, tuple(states), frontier


FIRST = _least(_inserted([0, NEVER, NEVER, NEVER]))[0]


def between(codes: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row; -1 where there is no way."""
    ways = [_least([0 if s == t else NEVER for t in range(4)]) for s in range(4)]
    for q in codes:
        for s in range(4):
            f, base = ways[s]
            # inserts come before the row that is read, as the next segment has those at its beginning
            after = [NEVER * 4] * 4
            f = _inserted(list(f))
            for _, u, v, c in arcs(q):
                after[v] = min(after[v], f[u] + c)
            made, more = _least(after)
            ways[s] = made, base + more
    return [base + c if c < NEVER else -1 for f, base in ways for c in f]


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where texts and copies come to `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.binary_length(batch.column("t")), np.int64) + np.asarray(batch.column("m")) + 16
        total = np.concatenate([[0], np.cumsum(size)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


SEGMENTS = "conv_id long, place long, codes binary, ways array<int>, turns array<long>, roles array<string>, texts array<string>, copies array<long>"


def _segments(most: int):
    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33  # tasks are in the order of the rows
        for b in _slices(batches, most):
            key, null = np.asarray(b.column("c").fill_null(0)), np.asarray(b.column("c").is_null())
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (null[1:] != null[:-1])]))
            bounds = np.append(first, b.num_rows).astype(np.int32)
            copies = np.asarray(b.column("m"), np.int64)
            at = np.concatenate([[0], np.cumsum(copies)])
            codes = np.repeat(np.asarray(b.column("again"), np.uint8), copies)
            codes[at[:-1][copies > 0]] = np.asarray(b.column("code"), np.uint8)[copies > 0]
            held = [codes[at[x] : at[y]].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.concat_arrays([b.column(k)])) for k in ("n", "r", "t", "m")]
            places = pa.array(place + np.arange(len(first)))
            place += len(first)
            # a conversation that goes on in other segments is the first or the last here
            ways = [between(x) if i in (0, len(held) - 1) else [] for i, x in enumerate(held)]
            yield pa.RecordBatch.from_arrays([b.column("c").take(pa.array(first)), places, pa.array(held, pa.binary()), pa.array(ways, pa.list_(pa.int32())), *lists], ["conv_id", "place", "codes", "ways", "turns", "roles", "texts", "copies"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first of each conversation that has several: backward costs at their ends."""
    conv, cost = object(), list(END)
    for b in batches:
        out = []
        for c, place, ways, parts in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "ways", "parts"))):
            if c != conv:
                conv, cost = c, list(END)
            out.append((place, parts, _least(cost)[0]))
            cost = [min([w + cost[t] for t in range(4) if (w := ways[4 * s + t]) >= 0], default=NEVER) for s in range(4)]
            for _ in range(2):
                for s, t in NEXT.items():
                    cost[s] = min(cost[s], INSERT + cost[t])
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([list(x) for x in columns[2]], pa.list_(pa.int32()))], ["at", "parts", "after"])


NUMBERS = ["cost", "gaps", "blank", "duplicate", "truncated", "illegal"]
REPAIRED = f"conv_id long, part long, parts long, edits string, repaired array<struct<role: string, text: string>>, {', '.join(f'{k} long' for k in NUMBERS)}"


class _Rows:
    """Repaired segments that are still to be given out."""

    def __init__(self):
        self.ids, self.numbers, self.edits, self.ends, self.roles, self.texts, self.size = [], [], [], [0], [], [], 0

    def add(self, conv: int | None, part: int, parts: int, edits: str, made: list[tuple[str, str]], numbers: tuple[int, ...]) -> None:
        self.ids.append((conv, part, parts))
        self.numbers.append(numbers)
        self.edits.append(edits)
        self.roles += [r for r, _ in made]
        self.texts += [t for _, t in made]
        self.ends.append(len(self.roles))
        self.size += 100 + sum(len(t) for _, t in made)

    def batch(self) -> pa.RecordBatch:
        turns = pa.StructArray.from_arrays([pa.array(self.roles, pa.string()), pa.array(self.texts, pa.string())], ["role", "text"])
        repaired = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), turns)
        columns = [pa.array(c, pa.int64()) for c in (*zip(*self.ids), *zip(*self.numbers))]
        return pa.RecordBatch.from_arrays([*columns[:3], pa.array(self.edits, pa.string()), repaired, *columns[3:]], ["conv_id", "part", "parts", "edits", "repaired", *NUMBERS])


@returning
def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, those of a conversation next to one another; one row for each."""
    conv, part, last, f, frontier, role, turn = object(), 0, 0, FIRST, frozenset([START]), None, None
    rows = _Rows()
    name = {USER: "user", ASSISTANT: "assistant"}
    paid = {"D": DELETE, "K": 0, "R": RE_ROLE}
    for b in batches:
        for c, codes, turns, roles, texts, copies, parts, after in zip(*(b.column(k).to_pylist() for k in ("conv_id", "codes", "turns", "roles", "texts", "copies", "parts", "after"))):
            if c != conv or part == last:
                conv, part, f, frontier, role, turn = c, 0, FIRST, frozenset([START]), None, None
            last = parts
            costs = [tuple(after)]
            for q in reversed(codes):
                costs.append(backward(costs[-1], q)[0])
            costs.reverse()
            counts, illegal = [0] * 4, 0
            for q in codes:
                counts[q >> 2] += 1
                illegal += role is not None and not LEGAL[role][q & 3]
                role = q & 3
            gaps = 0
            for t, m in zip(turns, copies):
                if m and t is not None:
                    gaps += t - turn - 1 if turn is not None and t > turn else 0
                    turn = t
            letters, made, cost, at = [], [], 0, 0
            for row, m in enumerate(copies):
                for _ in range(m):
                    q = codes[at]
                    edits, states, frontier = walk(f, q, costs[at + 1], frontier)
                    f, at = forward(f, q)[0], at + 1
                    letters.append(edits)
                    made += [(name[s], "") for s in states[:-1]]
                    how = edits[-1]
                    cost += INSERT * (len(edits) - 1) + paid[how] + (CUT if q >> 2 == TRUNCATED and how != "D" else 0)
                    if how != "D":
                        made.append((roles[row] if how == "K" else name[states[-1]], texts[row]))
            part += 1
            if part == last:  # what is still to be inserted at the end of the conversation
                state = min(frontier)
                while END[state]:
                    state = NEXT[state]
                    letters.append("I")
                    made.append((name[state], ""))
                    cost += INSERT
            rows.add(c, part - 1, last, "".join(letters), made, (cost, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal))
            if rows.size > SEGMENT:
                yield rows.batch()
                rows = _Rows()
    if rows.ids:
        yield rows.batch()


def repair_conversations(df: DataFrame, copies: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row a conversation, or several numbered parts of a long one: its edits, the repaired turns, the cost, and how many
    turn numbers lack, rows are blank, repeated or cut off, and neighbours' roles are out of order. Joining and adding up the
    parts in order gives the whole."""
    scratch = Scratch(df.sparkSession, "repair")
    space = F.lit(" ")
    rows = df.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("n"), F.coalesce("role", space).alias("r"), F.coalesce("text", space).alias("t"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("m"))
    rows = rows.groupBy("c", "n", "r", "t").agg(F.sum("m").alias("m"))
    rows = scratch.save(rows.withColumn("k", F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), F.col("r"), F.col("t")), 256)), "rows")
    turn = F.struct(F.col("n").isNotNull().alias("set"), F.col("n").alias("n"))
    again = rows.where("m > 0").groupBy(F.col("c").alias("c2"), F.col("k").alias("k2")).agg(F.min(turn).alias("least"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select("c2", "k2", "least")
    rows = rows.join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("k") == F.col("k2")), "left")
    last = F.right(F.rtrim("t", F.lit(BLANKS)), F.lit(1))
    initial = F.substring("r", 1, 1)
    place = F.coalesce(*(F.when(initial == x, i) for i, x in enumerate(INITIALS)), F.lit(3))
    fault = F.when(last == "", BLANK).when(F.col("least").isNotNull() & (F.col("least") < turn), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    other = F.when(last == "", BLANK).otherwise(DUPLICATE)
    # a row that is there very often comes in several pieces, of which only the first can be the first occurrence
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / segment))))
    rows = rows.select("c", "n", "r", "t", "m", (place + 4 * fault).alias("code"), (place + 4 * other).alias("again"), piece.alias("x"))
    rows = rows.withColumns({"m": F.least(F.lit(segment), F.col("m") - F.col("x") * segment), "code": F.when(F.col("x") == 0, F.col("code")).otherwise(F.col("again"))})
    # the beginning of a text is enough to deal by, and agrees with the order of the whole
    rows = rows.repartitionByRange("c", "n", "r", F.substring("t", 1, 64)).sortWithinPartitions("c", "n", "r", "t", "x")
    made = scratch.save(rows.mapInArrow(_segments(segment), SEGMENTS), "segments")
    parts = made.groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    long = made.select("conv_id", "place", "ways").join(parts, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    ends = scratch.save(long.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(_ends, "at long, parts long, after array<int>"), "ends")
    once = made.join(ends, F.col("place") == F.col("at"), "left_anti").withColumns({"parts": F.lit(1).cast("long"), "after": F.array(*(F.lit(x) for x in END))})
    several = made.join(ends, F.col("place") == F.col("at")).drop("at").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    columns = ["conv_id", "codes", "turns", "roles", "texts", "copies", "parts", "after"]
    return once.select(*columns).mapInArrow(_repair, REPAIRED).unionByName(several.select(*columns).mapInArrow(_repair, REPAIRED))


def report(repaired: DataFrame) -> DataFrame:
    """One row a conversation: the sums of its parts, all edits, and the digest of the repaired `role:text` lines."""
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id long, {', '.join(f'{k} long' for k in sums)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, edits, digest, before = [0] * len(sums), [], hashlib.sha256(), False
        for b in batches:
            rows, turns = [], b.column("repaired")
            ends = np.asarray(turns.offsets)
            said = turns.values
            lines = [f"{r}:{t}" for r, t in zip(said.field("role").to_pylist(), said.field("text").to_pylist())]
            for i, (conv, part, parts, letters, *counts) in enumerate(zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "parts", "edits", *sums)))):
                total = [x + y for x, y in zip(total, counts)]
                edits.append(letters)
                own = lines[ends[i] : ends[i + 1]]
                if own:
                    digest.update(("\n" * before + "\n".join(own)).encode())
                    before = True
                if part + 1 == parts:
                    rows.append((conv, *total, "".join(edits), digest.hexdigest()))
                    total, edits, digest, before = [0] * len(sums), [], hashlib.sha256(), False
            columns = list(zip(*rows)) or [[]] * (len(sums) + 3)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * (len(sums) + 1) + [pa.string()] * 2)], ["conv_id", *sums, "audit", "repaired_sha256"])

    rows = repaired.select("conv_id", "part", "parts", "edits", "repaired", *sums)
    several = rows.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.where("parts = 1").mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults put in by a checksum of conversation and turn; `copies` is 0 where the row is dropped."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(k).cast("string"), space) for k in ("conv_id", "turn"))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("x"))
    x = F.col("x")
    text = F.when(x == 1, "").when(x == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    here = x != 0
    copies = F.when(x == 0, 0).when(x == 3, 2).otherwise(1)
    return rows.select("conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.when(x == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(here, text).alias("text"), copies.alias("copies"))
