"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a string. Rendering the turns up to each one and comparing
successive outputs gives the span each turn adds; rendering the last turn with two probe texts gives the place
of its text inside the span. A template that changes what it has already written is found because an output no
longer starts with the one before.

Every prefix is rendered whole, which is quadratic in the turns. A template may say how many earlier turns it looks at (``context``; None:
all). Then a conversation of which ``WHOLE`` characters have been rendered goes on behind those turns alone, and what that gives is not taken on
trust: the further prefixes of a power of two of turns and of all turns are rendered whole and compared with the pieces so far, a cost linear in the conversation.

Rows are sorted by conversation and turn inside partitions and streamed; a task holds one conversation's turns and output.

Defined results: null roles and texts are empty; a null conversation id is a conversation of its own; equal turn numbers
are ordered by role and text, null turn numbers come first; other columns are ignored; no rows give no rows. Where
history is rewritten, or turns depend on more than ``context`` says, ``rewrites`` is true, ``formatted`` is the rendering of all turns,
and there are no spans, as a loss mask on changing text cannot be trusted. Where a text cannot be found in its
span (the template alters it), its text span is null and the turn carries no loss.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
FLUSH = 1 << 24  # characters of output gathered before they are handed to Spark
WHOLE = 1 << 26  # characters rendered of a conversation before a declared context is made use of


@dataclass(frozen=True)
class Template:
    render: Callable[[Sequence[Turn]], str]
    read: Callable[[str], list[Turn]]  # turns of a rendered text
    unescape: Callable[[str], str]  # of a piece of text inside the output
    context: int | None = None


def _escape(text: str) -> str:
    return re.sub(r"\\|</?turn", r"\\\g<0>", text)


def _escape_role(role: str) -> str:
    return re.sub(r"[\\>\n]", r"\\\g<0>", role)


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _render(turns: Sequence[Turn]) -> str:
    return "".join(f"<turn {_escape_role(role)}>\n{_escape(text)}</turn>\n" for role, text in turns)


_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.DOTALL)


def _read(formatted: str) -> list[Turn]:
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((_unescape(found[1]), _unescape(found[2])))
        at = found.end()
    return turns


#: <turn ROLE>, the text, </turn>. A backslash goes before backslashes and before the marks inside texts.
TURNS = Template(_render, _read, _unescape, context=0)

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("role", pa.string()), ("loss", pa.bool_())])
SPAN_SQL = "array<struct<start:bigint,end:bigint,text_start:bigint,text_end:bigint,role:string,loss:boolean>>"


def _common_end(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


class Conversation:
    """One conversation's output, growing turn by turn."""

    def __init__(self, template: Template, loss_roles: frozenset[str]):
        self.template, self.loss_roles = template, loss_roles
        self.turns: list[Turn] = []
        self.window: list[Turn] = []
        self.before = template.render([])
        self.pieces, self.size = [self.before], len(self.before)
        self.spans: list[dict] = []
        self.rewrites = False
        self.whole, self.rendered = True, 0

    def add(self, role: str, text: str) -> None:
        render, context, turn = self.template.render, self.template.context, (role, text)
        after = render([*self.window, turn])
        if not self.rewrites and after.startswith(self.before):
            piece = after[len(self.before):]
            self.spans.append(self._span(role, piece))
            self.pieces.append(piece)
            self.size += len(piece)
        else:
            self.rewrites = True
        self.rendered += 3 * len(after)  # with both probes
        self.whole = self.whole and (context is None or self.rendered <= WHOLE)
        if self.whole:
            self.window.append(turn)
            self.before = after
        else:
            self.window = [*self.window, turn][-context:] if context else []
            self.before = render(self.window)
        self.turns.append(turn)
        if len(self.turns).bit_count() == 1:
            self._check()

    def _check(self) -> None:
        """Compare the pieces with the whole prefix, unless every turn's prefix was rendered."""
        if self.whole or self.rewrites:
            return
        self.pieces = ["".join(self.pieces)]
        self.rewrites = self.template.render(self.turns) != self.pieces[0]

    def _span(self, role: str, piece: str) -> dict:
        probes = [self.template.render([*self.window, (role, text)])[len(self.before):] for text in "01"]
        head = len(commonprefix(probes))
        tail = min(_common_end(*probes), min(map(len, probes)) - head)
        found = head + tail <= len(piece) and piece[:head] == probes[0][:head] and piece[len(piece) - tail:] == probes[0][len(probes[0]) - tail:]
        return {"start": self.size, "end": self.size + len(piece), "text_start": self.size + head if found else None,
                "text_end": self.size + len(piece) - tail if found else None, "role": role, "loss": found and role in self.loss_roles}

    def row(self, key: int | None) -> dict:
        self._check()
        if not self.rewrites:
            return {"conv_id": key, "formatted": "".join(self.pieces), "spans": self.spans, "rewrites": False}
        return {"conv_id": key, "formatted": self.template.render(self.turns), "spans": [], "rewrites": True}


def format_chats(df: DataFrame, template: Template = TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (of turns, of their texts, role, loss), rewrites."""
    roles = frozenset(loss_roles)
    rows = df.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(SPAN)), ("rewrites", pa.bool_())])
        current, key, done, size = None, None, [], 0
        for batch in batches:
            for own, who, said in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if current is None or own != key:
                    if current is not None:
                        done.append(current.row(key))
                        size += current.size
                    if size > FLUSH:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                    current, key = Conversation(template, roles), own
                current.add(who, said)
        if current is not None:
            done.append(current.row(key))
        yield pa.RecordBatch.from_pylist(done, schema)

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
            .mapInArrow(run, f"conv_id bigint, formatted string, spans {SPAN_SQL}, rewrites boolean"))


def read_chats(df: DataFrame, template: Template = TURNS, formatted: str = "formatted", spans: str = "spans") -> DataFrame:
    """Add what the output says: turns (role, text), and loss_text, all text under the loss mask, unescaped.

    Both are read from ``formatted``, the first through its marks, the second through the spans alone.
    """
    kind = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])

    @F.arrow_udf("turns array<struct<role:string,text:string>>, loss_text string")
    def read(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), places.to_pylist()):
            loss = "".join(template.unescape(text[s["text_start"]:s["text_end"]]) for s in own or () if s["loss"]) if text else ""
            out.append({"turns": [{"role": r, "text": t} for r, t in template.read(text or "")], "loss_text": loss})
        return pa.array(out, kind)

    both = df.withColumn("_read", read(F.col(formatted), F.col(spans)))
    return both.withColumns({"turns": F.col("_read.turns"), "loss_text": F.col("_read.loss_text")}).drop("_read")
