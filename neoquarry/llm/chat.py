"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says how a turn of each role opens and closes and which part of it bears loss. The machine reads a
conversation's turns in order and validates the order of roles; a step it does not allow is marked, not dropped, and
the machine goes on from the role it has read. Each turn becomes segments (text, loss flag).

Control strings inside texts are escaped: the escape character is put before every character that could begin a mark,
and before itself. So a mark in the output is always the template's own, and texts come back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<conversation>", "<turn order broken>"


@dataclass(frozen=True)
class Template:
    """How turns are written, and which roles may follow which."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    escape: str = "\\"
    loss_roles: frozenset = frozenset({"assistant"})
    # the machine: state (last role, or the start) to the roles it allows
    follows: dict = field(default_factory=lambda: {
        START: {"system", "user"},
        "system": {"user"},
        "user": {"assistant"},
        "assistant": {"user"},
    })

    def escaped(self, text: str) -> str:
        for mark in dict.fromkeys((self.escape, self.opening[0], self.closing[0])):
            text = text.replace(mark, self.escape + mark)
        return text

    def escaped_role(self, role: str) -> str:
        return self.escaped(role).replace(self.after_role, self.escape + self.after_role)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The pieces of one turn with their loss flags; those that bear loss hold a text and nothing else."""
        head = self.opening + self.escaped_role(role) + self.after_role
        return [(head, False), (self.escaped(text), role in self.loss_roles), (self.closing + self.after_turn, False)]

    def allows(self, state: str, role: str) -> bool:
        return role in self.follows.get(state, ())


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``place``, ``segment``, ``loss``, ``in_order``: a row for each segment, in order.

    Turns of a conversation are sorted by turn, then role and text (nulls first), so that ties and repeated rows have
    one order; each row is a turn. A null text or role is an empty string; rows with a null conv_id are one
    conversation. Extra columns are ignored, an empty table gives an empty result. A conversation is read as a stream:
    a turn is held at a time, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, START, False
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for conv_id, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not begun or conv_id != conv:
                    conv, state, begun = conv_id, START, True
                role, text = role or "", text or ""
                in_order = template.allows(state, role)
                state = role
                for place, (segment, loss) in enumerate(template.segments(role, text)):
                    for column, value in zip(out, (conv_id, turn, role, place, segment, loss, in_order)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            names = ("conv_id", "turn", "role", "place", "segment", "loss", "in_order")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(names))

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, turn long, role string, place int, segment string, loss boolean, in_order boolean"
    return ordered.mapInArrow(run, schema)


class Reader:
    """Reads one conversation back from its segments, one after the other, and keeps digests only."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.broken = 0
        # what is being read: outside a turn, the role, or the text of a turn
        self.state, self.piece = "between", []

    def read(self, segment: str, loss: bool) -> None:
        t = self.template
        self.chars += len(segment)
        if loss:
            plain = self._plain(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        at = 0
        while at < len(segment):
            if self.state == "between":
                if not segment.startswith(t.opening, at):
                    raise ValueError("a turn does not open where one should")
                at += len(t.opening)
                self.state, self.piece = "role", []
                continue
            mark = t.after_role if self.state == "role" else t.closing
            end = self._next_mark(segment, at, mark)
            self.piece.append(self._plain(segment[at : end if end >= 0 else None]))
            if end < 0:
                return
            at = end + len(mark)
            if self.state == "text":
                if not segment.startswith(t.after_turn, at):
                    raise ValueError("a turn does not close where it should")
                at += len(t.after_turn)
                self.n_turns += 1
            self.turns.update(("".join(self.piece) + "\n").encode())
            self.state, self.piece = ("text", []) if self.state == "role" else ("between", [])

    def _next_mark(self, segment: str, at: int, mark: str) -> int:
        """Where a mark stands that is not escaped."""
        escape = self.template.escape
        while at < len(segment):
            end, skip = segment.find(mark, at), segment.find(escape, at)
            if skip < 0 or 0 <= end < skip:
                return end
            at = skip + 2
        return -1

    def _plain(self, piece: str) -> str:
        escape = self.template.escape
        if escape not in piece:
            return piece
        out, at = [], 0
        while (skip := piece.find(escape, at)) >= 0:
            out += [piece[at:skip], piece[skip + 1 : skip + 2]]
            at = skip + 2
        return "".join(out) + piece[at:]

    def row(self) -> tuple:
        if self.state != "between":
            raise ValueError("the last turn is not closed")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.broken


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the output of ``formatted`` alone: counts and digests of what is written in it.

    ``n_broken`` counts turns the machine does not allow. The segments are read in the order in which they were
    written, without another shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, done = None, None, []
        for batch in batches:
            for conv_id, place, segment, loss, in_order in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if reader is None or conv_id != conv:
                    if reader is not None:
                        done.append((conv, *reader.row()))
                    conv, reader = conv_id, Reader(template)
                reader.read(segment, loss)
                reader.broken += place == 0 and not in_order
            if len(done) >= 4096:
                yield _rows(done)
                done = []
        if reader is not None:
            done.append((conv, *reader.row()))
        yield _rows(done)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_broken long"
    return segments.select("conv_id", "place", "segment", "loss", "in_order").mapInArrow(run, schema)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_broken"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*done)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
