"""Chat formatting: a finite-state machine over roles, and a declarative template that marks turns.

`segments` sorts the turns of each conversation once (hash partitions of conv_id, sorted by turn) and streams them through the
machine, carrying only its state from batch to batch; a conversation of any length takes bounded memory. Each turn gives three
segments: what opens it, its text, what closes it. Control strings inside a text are escaped: a backslash is doubled, and one is put
after the first character of each control string, so none is left whole; reading back undoes that exactly.
`digests` reads the segments back, by parsing their concatenated characters, in the same sorted partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.llm.common import bounded_batches


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn of each role; `other` is for any further role, whose escaped name stands between its two strings.

    `loss` names the roles whose texts are learned; `moves` maps (last role, role) to whether the turn may follow: START is the first state.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    loss: frozenset[str] = frozenset({"assistant"})
    moves: frozenset[tuple[str, str]] = frozenset({("START", "system"), ("START", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    ends: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> tuple[str, ...]:
        """Every control string, without the spaces around it."""
        found = {x.strip() for pair in self.turns.values() for x in pair} | {x.strip() for x in self.other}
        return tuple(sorted(found, key=lambda x: (-len(x), x)))

    @property
    def _marks(self) -> re.Pattern:
        return re.compile("|".join(f"(?={re.escape(x)})" for x in self.controls))

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        at = [m.start() + 1 for m in self._marks.finditer(text)]
        if not at:
            return text
        return "\\".join(text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def render(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: (characters, under the loss)."""
        if role in self.turns:
            opens, closes = self.turns[role]
        else:
            opens, closes = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(opens, False), (self.escape(text), role in self.loss), (closes, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted string; ValueError if it isn't one."""
        out, i = [], 0
        while i < len(formatted):
            if formatted.startswith(self.other[0], i):
                j = formatted.index(self.other[1], i)
                role, i, closes = self.unescape(formatted[i + len(self.other[0]) : j]), j + len(self.other[1]), self.other[2]
            else:
                role = next((r for r, (o, _) in self.turns.items() if formatted.startswith(o, i)), None)
                if role is None:
                    raise ValueError(f"no turn opens at {i}")
                i, closes = i + len(self.turns[role][0]), self.turns[role][1]
            j = formatted.index(closes, i)
            out.append((role, self.unescape(formatted[i:j])))
            i = j + len(closes)
        return out


SEGMENTS = "conv_id long, turn_no long, part int, role string, segment string, loss boolean, valid boolean"


def _machine(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, no, valid = (None,), "START", 0, True
        for batch in bounded_batches(batches, 2):
            out: list[list] = [[] for _ in range(7)]
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != now or no == 0:
                    now, state, no, valid = (conv,), "START", 0, True
                role, text = role or "", text or ""
                valid = valid and (state, role) in template.moves
                for part, (segment, loss) in enumerate(template.render(role, text)):
                    for column, value in zip(out, (conv, no, part, role, segment, loss, valid), strict=True):
                        column.append(value)
                state, no = role, no + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "turn_no", "part", "role", "segment", "loss", "valid"])

    return run


def segments(df: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, part, role, segment, loss, valid of every turn of (conv_id, turn, role, text), in order within each partition.

    `valid` is false from the first turn on that the machine refuses. A null role or text counts as empty; a null turn goes first; turns of the same
    number follow by role, then text; repeated rows are turns of their own; rows of a null conv_id are one conversation. Refused turns are
    still emitted. Columns other than the four are not read. An empty table gives an empty result.
    """
    template = template or Template()
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_machine(template), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _reader(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        turns = loss = None
        n = chars = loss_chars = 0
        valid, role, pending = True, "", ""

        def row() -> list:
            return [now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid and role in template.ends]

        for batch in bounded_batches(batches, 2):
            out = []
            for conv, part, segment, learned, fine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(row())
                    now, turns, loss, n, chars, loss_chars, valid, pending = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, ""
                chars += len(segment)
                pending += segment
                valid = valid and fine
                if learned:
                    plain = template.unescape(segment)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if part == 2:
                    ((role, text),) = template.parse(pending)
                    turns.update(f"{role}\n{text}\n".encode())
                    n, pending = n + 1, ""
            yield _packed(out)
        if now is not None:
            yield _packed([row()])

    return run


def _packed(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from the output of `segments`, which must come straight from it (its partitions hold whole conversations in order).

    One row per conversation: n_turns, the SHA-256 of its turns and of its text under the loss, lengths in code points, and whether the machine
    accepts it, last turn included.
    """
    return formatted.select("conv_id", "part", "segment", "loss", "valid").mapInArrow(_reader(template or Template()), DIGESTS)
