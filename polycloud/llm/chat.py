r"""Chat formatting with a grammar round trip.

    conversation := turn*            turn := "### " role ": " text "</turn>\n"

Inside role and text a backslash makes the next character literal. Rendered text is reparsed by a deterministic parser;
a turn that does not come back identical is rendered again with its control strings escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: What each round of escaping protects: first what closes a turn, then every control string.
_LEVELS = (None, re.compile(r"\\|</turn>|### "), re.compile(r"[\\<#]"))
_ROLE = re.compile(r"[\\:<#\n]")
LEARNT = frozenset({"assistant"})


class Parser:
    """Reads turns from text that comes in pieces; holds no more than the turn that is open."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str, int, int]]:
        """(role, text, raw turn, start and end of the escaped text within it) of each turn that is complete."""
        self.rest += piece
        at = 0
        while True:
            if len(self.rest) - at < len(OPEN):
                break
            if not self.rest.startswith(OPEN, at):
                raise ValueError("a turn must start with its opening")
            mid = self._find(MID, at + len(OPEN))
            end = self._find(CLOSE, mid + len(MID)) if mid >= 0 else -1
            if end < 0:
                break
            a = mid + len(MID)
            stop = end + len(CLOSE)
            yield unescape(self.rest[at + len(OPEN) : mid]), unescape(self.rest[a:end]), self.rest[at:stop], a - at, end - at
            at = stop
        self.rest = self.rest[at:]

    def _find(self, what: str, at: int) -> int:
        """First place of ``what`` from ``at`` that an odd run of backslashes does not make literal."""
        while (k := self.rest.find(what, at)) >= 0:
            n = k
            while n > 0 and self.rest[n - 1] == "\\":
                n -= 1
            if (k - n) % 2 == 0:
                return k
            at = k + 1
        return -1


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def parse(text: str) -> list[tuple[str, str]]:
    p = Parser()
    turns = [(role, body) for role, body, *_ in p.feed(text)]
    if p.rest:
        raise ValueError("the text ends inside a turn")
    return turns


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn as formatted text, and the start and end of its (escaped) text."""
    role, text = role or "", text or ""
    head = OPEN + _ROLE.sub(lambda m: "\\" + m.group(), role) + MID
    for level in _LEVELS:
        body = text if level is None else level.sub(lambda m: "\\" + m.group(), text)
        out = head + body + CLOSE
        try:
            if parse(out) == [(role, text)] and (level is not None or (OPEN not in text and "</turn>" not in text)):
                return out, len(head), len(head) + len(body)
        except ValueError:
            pass
    raise AssertionError("escaping every control character must round-trip")


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` plus formatted, mask_start, mask_end: each turn rendered by itself.

    A conversation's formatted text is its turns' in order. The mask spans the texts to be learnt (of assistants), in code
    points of ``formatted``; elsewhere it is empty. Null roles and texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [render(r.as_py(), t.as_py()) for r, t in zip(batch.column(2), batch.column(3))]
            learnt = [r.as_py() in LEARNT for r in batch.column(2)]
            cols = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] if y else x[1] for x, y in zip(rows, learnt)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["conv_id", "turn", "role", "text", "formatted", "mask_start", "mask_end"])

    some = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return some.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, mask_start long, mask_end long")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text by the parser: its turns, the text under the loss mask, its size.

    Rows stream in order through one task per conversation with digests carried along, so a conversation of any length
    holds one turn in memory. Turns of equal number follow role and text; null numbers come first.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = object(), None, []

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        def close() -> None:
            if state is not None:
                if state["parser"].rest:
                    raise ValueError(f"conversation {conv} ends inside a turn")
                done.append((conv, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["size"]))

        for batch in batches:
            for c, piece, a, b in zip(*[x.to_pylist() for x in batch.columns]):
                if state is None or c != conv:
                    close()
                    if len(done) >= 5000:
                        yield flush()
                        done = []
                    conv, state = c, {"parser": Parser(), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "size": 0}
                for role, text, raw, start, end in state["parser"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["size"] += len(raw)
                    if b > a:
                        if (start, end) != (a, b):
                            raise ValueError("the loss mask does not lie on a turn's text")
                        masked = unescape(raw[a:b])
                        state["loss"].update(masked.encode())
                        state["loss_n"] += len(masked)
        close()
        if done:
            yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from its formatted text.

    Null roles and texts are empty; a null conv_id is a conversation of its own; repeated rows are turns of their own, in the
    order of turn, role, text; texts of any length are kept whole; other columns are not read; an empty table gives no row.
    """
    return digest_conversations(format_turns(conversations))
