"""Operator 7: chat formatting by a finite-state machine over roles and a declarative template.

The machine walks over the turns of a conversation: each move emits the turn's text segments, each with a flag for the loss, as
the template says, and a turn that has no move leads astray, from where all turns are emitted but the order counts as wrong. Control strings inside texts (and odd role names) are escaped, so the
formatted text can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked. A turn is its role's head, the escaped text and the tail.

    A role without a head of its own gets other_head with its escaped name in it. Escaping puts the escape character before
    itself and before every control string, of which none may start with it.
    """

    heads: tuple[tuple[str, str], ...] = (("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    other_head: tuple[str, str] = ("### Role <", ">: ")
    tail: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>", ">: ")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        e = self.escape
        text = text.replace(e, e + e)
        for c in self.controls:
            text = text.replace(c, e + c)
        return text

    def head(self, role: str) -> str:
        return dict(self.heads).get(role) or self.other_head[0] + self.escaped(role) + self.other_head[1]

    def turn(self, role: str, text: str) -> tuple[tuple[str, bool], ...]:
        """The parts of a turn, each with whether it is learned from."""
        return (self.head(role), False), (self.escaped(text), role in self.learned), (self.tail, False)


@dataclass
class Formatted:
    text: str = ""
    segments: list[tuple[int, int, bool]] = field(default_factory=list)  # start, end (code points), loss
    wrong: str | None = None


@dataclass(frozen=True)
class Machine:
    """Allowed orders of roles: (state, role) -> state. A conversation is valid if it ends in one of ends."""

    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    ends: tuple[str, ...] = ("answered",)

    def run(self, turns: list[tuple[str, str]], template: Template) -> Formatted:
        """The formatted conversation: what each move emits, as segments that cover the text without a gap; and what is wrong with
        the order, as 'turn k: role after state' or 'ends in state', or None."""
        to = {(a, r): b for a, r, b in self.moves}
        state, wrong, parts, segments, at = self.start, None, [], [], 0
        for k, (role, text) in enumerate(turns):
            if wrong is None and (state, role) not in to:
                wrong = f"turn {k}: {role or 'no role'} after {state}"
            state = to.get((state, role), "astray") if wrong is None else "astray"
            for part, loss in template.turn(role, text):
                parts.append(part)
                if part:
                    segments.append((at, at + len(part), loss))
                at += len(part)
        if wrong is None and state not in self.ends:
            wrong = f"ends in {state}"
        return Formatted("".join(parts), segments, wrong)


def _read_to(text: str, at: int, stop: str, escape: str) -> tuple[str, int]:
    """Unescaped text up to stop, and where stop begins."""
    out = []
    end = -1
    while True:
        if end < at:
            end = text.find(stop, at)
        mark = text.find(escape, at)
        if end < 0:
            raise ValueError("a turn isn't closed")
        if mark < 0 or end < mark:
            out.append(text[at:end])
            return "".join(out), end
        out += [text[at:mark], text[mark + 1]]
        at = mark + 2


def parse(text: str, template: Template) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, read back."""
    turns, at = [], 0
    while at < len(text):
        for role, head in template.heads:
            if text.startswith(head, at):
                at += len(head)
                break
        else:
            first, second = template.other_head
            if not text.startswith(first, at):
                raise ValueError("no turn begins here")
            role, at = _read_to(text, at + len(first), second, template.escape)
            at += len(second)
        said, at = _read_to(text, at, template.tail, template.escape)
        turns.append((role, said))
        at += len(template.tail)
    return turns


def unescaped(text: str, template: Template) -> str:
    """The text of a segment as it was before escaping."""
    out, at = [], 0
    while (mark := text.find(template.escape, at)) >= 0:
        out += [text[at:mark], text[mark + 1]]
        at = mark + 2
    return "".join([*out, text[at:]])


def _format(template: Template, machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, segments, wrong = [], [], []
            for turns in batch.column("turns").to_pylist():
                said = [(t["role"] or "", t["text"] or "") for t in turns]
                f = machine.run(said, template)
                texts.append(f.text)
                segments.append([{"start": a, "stop": b, "loss": c} for a, b, c in f.segments])
                wrong.append(f.wrong)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(segments, kind), pa.array(wrong, pa.string())], ["conv_id", "formatted", "segments", "wrong"])

    return run


def format_chats(turns: DataFrame, template: Template | None = None, machine: Machine | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats conversations, a row each: (conv_id, formatted, segments, wrong).

    segments is an array of (start, stop, loss) in code points; wrong is null if the machine accepts the order of the
    roles, else it says why not. Conversations in a wrong order are formatted all the same, for the caller to drop or keep.

    Turns go by number, nulls last, then role and text, so that ties and repeated rows, which all stay, have one order. A null
    text or role is an empty one. Rows without a conversation id can't be put together: each is a conversation of one turn.
    Other columns are ignored, whatever their names. An empty table gives an empty result. A conversation becomes one string, so
    its turns meet in one task; a task holds the conversations of one batch at a time.
    """
    order = F.struct(F.col(turn_col).isNull().alias("none"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    said = turns.select(F.col(conv_col).cast("long").alias("conv_id"), alone.alias("alone"), order.alias("turn"))
    grouped = said.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.selectExpr("conv_id", "transform(turns, x -> struct(x.role as role, x.text as text)) as turns").mapInArrow(
        _format(template or Template(), machine or Machine()), "conv_id long, formatted string, segments array<struct<start:long,stop:long,loss:boolean>>, wrong string"
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted conversations back: (conv_id, turns, learned, formatted_chars, wrong).

    turns is an array of (role, text); learned holds the unescaped texts of the segments with loss, in order.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": x} for r, x in parse(text, t)] for text in texts]
            learned = [
                [unescaped(text[s["start"] : s["stop"]], t) for s in segments if s["loss"]]
                for text, segments in zip(texts, batch.column("segments").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array(learned, pa.list_(pa.string())), pa.array([len(x) for x in texts], pa.int64()), batch.column("wrong"),
                ], ["conv_id", "turns", "learned", "formatted_chars", "wrong"],
            )

    return formatted.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, learned array<string>, formatted_chars long, wrong string")
