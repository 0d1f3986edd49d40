"""Chat formatting (operator 2).

A :class:`ChatTemplate` declares how a turn is written and which roles may follow each other. One
ordered pass per conversation runs a finite-state machine over the roles and emits text segments, each
with a loss flag. Control strings inside texts and roles are escaped, so that the formatted text can be
parsed back without loss.

The pass is a ``mapInArrow`` over rows that Spark has dealt by conversation and sorted by turn. It keeps
the state of one conversation only, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW, bound_batches

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``open + role + says + text + close``; only texts of ``loss_roles`` carry loss.

    ``allowed`` maps a state (the role of the turn before, "" at the start) to the roles that may come
    next; ``final`` lists the roles a complete conversation may end with. ``reserved`` are further
    strings that must not appear unescaped in a formatted text.
    """

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "</s>\n"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    allowed: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> tuple[str, ...]:
        found = tuple(dict.fromkeys((self.open, self.says, self.close.rstrip("\n"), *self.reserved)))
        firsts = {c[0] for c in found}
        if any(set(c[1:]) & firsts or ESCAPE in c or len(c) < 2 for c in found):
            raise ValueError("a control string's first character must not recur in control strings")
        return found

    @cached_property
    def _escape(self) -> re.Pattern:
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return re.compile(f"{re.escape(ESCAPE)}|{heads}")

    def escape(self, text: str) -> str:
        """Puts the escape character after each escape character and after the first character of each control string."""
        return self._escape.sub(lambda m: m[0] + ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


SEGMENTS = "conv_id long, turn_no long, role string, segment_no int, segment string, loss boolean, turn_ok boolean, last_state string"


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """A batch's rows as Python values, one at a time; ids stay whole numbers beside nulls."""
    for values in zip(*(batch.column(c) for c in columns), strict=True):
        yield tuple(v.as_py() for v in values)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def format_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Formats every conversation; one row per segment.

    Input: ``conv_id, turn, role, text``; other columns are ignored. Turns are taken in the order of
    ``turn``; ties are ordered by role, then text, and repeated rows are kept as turns of their own.
    A null text or role counts as empty, null turns come first, rows with a null ``conv_id`` form one
    conversation, and an empty table gives no rows.

    Output: ``conv_id, turn_no`` (from 0), ``role, segment_no`` (within the turn), ``segment`` (a piece of
    the formatted text), ``loss`` (whether the piece is trained on), ``turn_ok`` (whether the machine allows
    this role here; a turn out of order is still formatted, and flagged), ``last_state`` (the state after the
    turn: the role, or ``error`` for good after a turn out of order).
    """
    template = template or ChatTemplate()
    template.controls  # noqa: B018  checks the template on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, turn_no = object(), "", 0
        for batch in batches:
            out = []
            for conv_id, role, text in _rows(batch, "conv_id", "role", "text"):
                if conv_id != conv:
                    conv, state, turn_no = conv_id, "", 0
                ok = role in template.allowed.get(state, ())
                state = role if ok else "error"
                pieces = (
                    (template.open + template.escape(role) + template.says, False),
                    (template.escape(text), role in template.loss_roles),
                    (template.close, False),
                )
                out += [(conv_id, turn_no, role, i, piece, loss, ok, state) for i, (piece, loss) in enumerate(pieces)]
                turn_no += 1
            yield _batch(out, SEGMENTS)

    bound_batches(conversations.sparkSession)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "valid boolean"
)


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parses formatted conversations again and returns one digest row for each.

    ``segments`` is the output of :func:`format_chat`, still in its order (it follows in the same task, no
    shuffle). Roles and texts come from the formatted text alone, by its control strings; loss text from
    the loss flags. ``valid``: all turns in order and the last role is a final one.
    """
    template = template or ChatTemplate()
    turn = re.compile(f"{re.escape(template.open)}(.*?){re.escape(template.says)}(.*?){re.escape(template.close)}", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None
        done = []

        def finish() -> None:
            if state:
                if state["rest"]:
                    raise ValueError("a formatted conversation does not parse")
                done.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"], state["ok"] and state["role"] in template.final))

        for batch in batches:
            done = []
            for conv_id, piece, loss, ok in _rows(batch, "conv_id", "segment", "loss", "turn_ok"):
                if conv_id != conv:
                    finish()
                    conv = conv_id
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0, "rest": "", "ok": True, "role": ""}
                state["length"] += len(piece)
                state["ok"] &= bool(ok)
                if loss:
                    plain = template.unescape(piece)
                    state["chars"] += len(plain)
                    state["loss"].update(plain.encode())
                state["rest"] += piece
                if piece.endswith(template.close) and (m := turn.fullmatch(state["rest"])):
                    role, text = map(template.unescape, m.groups())
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["role"], state["rest"] = role, ""
            yield _batch(done, DIGESTS)
        done = []
        finish()
        yield _batch(done, DIGESTS)

    return segments.mapInArrow(run, DIGESTS)
