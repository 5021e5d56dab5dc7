"""Chat formatting by columnar byte assembly.

A turn becomes `### ROLE: TEXT </turn>\\n`. Inside TEXT a backslash goes before each backslash, `#` and `<`; in ROLE also
before each `:`. So no text can forge a header or an end mark, and dropping each escaping backslash restores it.
Segment lengths, cumulative offsets and scatter indices are computed in numpy for all turns of an Arrow batch, and
headers and contents are copied into one preallocated buffer; a conversation is a range of that buffer.

Cases: null text or role is empty; turns sort by turn (null first), then role, then text, so ties and repeated rows have
a fixed order and all stay; a null conversation id is a conversation of its own; an empty table gives an empty result;
other columns are ignored.

A conversation of more than `part_bytes` comes as numbered parts, ranges of its turns in order, each in its own row: the
turns are dealt to tasks by range, so no task holds such a conversation, whatever its size. `part` counts from 0 to
`parts` - 1, `start` is the code-point offset of the part in the conversation, and joining the parts in order gives the
whole. Spans count from the start of the conversation. Digests are folded over the parts in order, one part at a time.
A single turn has to be under 2 GB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sized, text_slices, utf8

HEAD, MIDDLE, TAIL = b"### ", b": ", b" </turn>\n"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, length: long>>"
_TEXT = np.zeros(256, bool)
_TEXT[list(b"\\#<")] = True
_ROLE = _TEXT.copy()
_ROLE[ord(":")] = True


def _escape(data: np.ndarray, at: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and the new row offsets."""
    mark = special[data]
    before = np.concatenate([[0], np.cumsum(mark)])
    out = np.full(len(data) + before[-1], ord("\\"), np.uint8)
    out[np.arange(len(data)) + before[1:]] = data
    return out, at + before[at]


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    out[np.arange(len(data)) + np.repeat(to - at[:-1], np.diff(at))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all segments, their byte offsets (n + 1), and the start and end byte of each text in it."""
    role, role_at = _escape(*utf8(roles), _ROLE)
    text, text_at = _escape(*utf8(texts), _TEXT)
    n = len(roles)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(role_at) + np.diff(text_at) + len(HEAD + MIDDLE + TAIL), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    role_to = at[:-1] + len(HEAD)
    middle = role_to + np.diff(role_at)
    start = middle + len(MIDDLE)
    end = start + np.diff(text_at)
    _scatter(out, role_to, role, role_at)
    _scatter(out, start, text, text_at)
    for fixed, to in ((HEAD, at[:-1]), (MIDDLE, middle), (TAIL, end)):
        out[to[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    return out, at, start, end


def _format(table: pa.Table) -> pa.RecordBatch:
    """One row per conversation; the rows of each are next to one another and in order."""
    ids, roles, texts = (table.column(i).combine_chunks() for i in range(3))
    out, at, start, end = assemble(roles, texts)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    key, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(null.astype(np.int8)) != 0)]))
    bounds = np.concatenate([first, [len(key)]])
    spoken = np.flatnonzero(np.asarray(pa.compute.equal(roles.fill_null(""), "assistant")))
    conv = np.searchsorted(first, spoken, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(points[start[spoken]] - points[at[first]][conv]), pa.array(points[end[spoken]] - points[start[spoken]])], ["start", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(spoken, bounds).astype(np.int32)), spans)
    if at[-1] >= 1 << 31:
        raise ValueError("a slice of turns has over 2 GB of formatted text")
    text = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(bounds)), text, lists], ["conv_id", "n_turns", "formatted", "loss_spans"])


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_bytes: int = 256 << 10) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (code-point start and length of each assistant text), part, parts, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in text_slices(batches, 2):
            key = b.column(0)
            same = np.asarray(pa.compute.equal(key.fill_null(0), key[-1].as_py() or 0)) & (np.asarray(key.is_null()) == (not key[-1].is_valid))
            last = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last or held and not held[-1].column(0)[-1].equals(key[0]):
                held.append(b.slice(0, last))
                yield _format(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(last))  # the last conversation may go on in the next batch
        if held:
            yield _format(pa.Table.from_batches(held))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32  # tasks are in the order of the turns
        for i, b in enumerate(text_slices(batches, 2, part_bytes)):
            made = _format(pa.Table.from_batches([b]))
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(made.num_rows, place + i))], [*made.schema.names, "place"])

    rows = df.select(F.col(conv_col).cast("long").alias("c"), F.col(role_col).alias("r"), F.col(text_col).alias("t"), F.col(turn_col).alias("n"))
    scratch = Scratch(df.sparkSession, "chat")
    bytes_ = [F.coalesce(F.octet_length(x), F.lit(0)).cast("long") for x in ("r", "t")]
    hot = scratch.save(rows.groupBy("c").agg(F.sum(bytes_[0] + bytes_[1] + 16).alias("size")).where(F.col("size") > part_bytes).select(F.col("c").alias("hot")), "hot")
    split = not hot.isEmpty()
    cold = rows.join(sized(hot), F.col("c").eqNullSafe(F.col("hot")), "left_anti") if split else rows
    cold = cold.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInArrow(run, FORMATTED)
    cold = cold.withColumns({"part": F.lit(0).cast("long"), "parts": F.lit(1).cast("long"), "start": F.lit(0).cast("long")})
    if not split:
        return cold
    # The beginning of a text is enough to deal by, and agrees with the order of the whole.
    warm = rows.join(sized(hot), F.col("c").eqNullSafe(F.col("hot")), "left_semi").repartitionByRange("c", "n", "r", F.substring("t", 1, 64))
    made = scratch.save(warm.sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInArrow(ranges, f"{FORMATTED}, place long"), "parts")
    own = Window.partitionBy("id")
    order = own.orderBy("place")
    at = made.select(F.col("conv_id").alias("id"), "place", F.length("formatted").cast("long").alias("size"))
    at = at.select("id", F.col("place").alias("at"), (F.row_number().over(order) - 1).cast("long").alias("part"), F.count(F.lit(1)).over(own).alias("parts"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    placed = made.join(sized(scratch.save(at, "places")), F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("place") == F.col("at")))
    spans = F.transform("loss_spans", lambda x: F.struct((x["start"] + F.col("start")).alias("start"), x["length"].alias("length")))
    return cold.unionByName(placed.select("conv_id", "n_turns", "formatted", spans.alias("loss_spans"), "part", "parts", "start"))


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    found = []
    for part in formatted.split(TAIL.decode())[:-1]:
        role, text = _TURN.fullmatch(part).groups()
        found.append((unescape(role), unescape(text)))
    return found


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations()'s output: turns and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, n, read, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for b in batches:
            rows = []
            for conv, text, spans, part, parts, start in zip(*(b.column(i) for i in range(6))):
                text, start = text.as_py(), start.as_py()
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    read += 1
                for s in spans.as_py():
                    said = unescape(text[s["start"] - start : s["start"] - start + s["length"]])
                    loss.update(said.encode())
                    n += len(said)
                size += len(text)
                if part.as_py() + 1 == parts.as_py():  # the parts before have been added
                    rows.append((conv.as_py(), read, turns.hexdigest(), n, loss.hexdigest(), size))
                    turns, loss, n, read, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select("conv_id", "formatted", "loss_spans", "part", "parts", "start")
    several = rows.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.where("parts = 1").mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))
