"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of turn tokens say how
many new turns fit behind the system turn and a limited number of repeated ones; only
assistant texts that a window shows for the first time are under its loss mask.

Control strings cannot occur inside a text: every backslash, hash and less-than sign
of a text is written as an escape, and read back from it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
BUDGET = 512
HISTORY = 128
TURN_TOKENS = 4  # what the control strings of a turn count

_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_TEXT = str.maketrans({c: _ESCAPES[c] for c in "\\#<"})
_ROLE = str.maketrans(_ESCAPES)
_TURN = re.compile(re.escape(OPEN) + r"([^:]*)" + re.escape(BETWEEN) + r"([^<]*)" + re.escape(CLOSE))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def tokens(text: str) -> int:
    return len(text.split()) + TURN_TOKENS


@dataclass
class Window:
    """Turns of one window: repeated ones first, then new ones."""

    repeated: list[tuple[str, str]] = field(default_factory=list)
    new: list[tuple[str, str]] = field(default_factory=list)
    used: int = 0

    def row(self, key, number: int) -> dict:
        parts, masks, at = [], [], 0
        for i, (role, text) in enumerate(self.repeated + self.new):
            head, body = OPEN + role.translate(_ROLE) + BETWEEN, text.translate(_TEXT)
            if role == "assistant" and i >= len(self.repeated):
                masks.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        return {
            "_null": key[0], "conv_id": key[1], "window": number, "text": "".join(parts), "n_repeated": len(self.repeated),
            "loss_starts": [a for a, _ in masks], "loss_ends": [b for _, b in masks], "n_tokens": self.used,
        }


class Conversation:
    """Turns in, windows out; holds no more than the turns of one window."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: list[tuple[str, str]] = []
        self.window, self.number, self.turns = Window(), 0, 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        size = tokens(text)
        if self.window.new and self.window.used + size > self.budget:
            yield from self.close()
            self.window = self._next(size)
        if not self.turns and role == "system":
            self.system = [(role, text)]
        self.window.new.append((role, text))
        self.window.used += size
        self.turns += 1

    def _next(self, size: int) -> Window:
        """A window that begins with the system turn and the last turns, as far as they leave room for a turn of ``size``."""
        base = sum(tokens(t) for _, t in self.system)
        room = min(self.history, self.budget - base - size)
        before = self.window.repeated + self.window.new
        repeated: list[tuple[str, str]] = []
        for turn in reversed(before[len(self.system):]):
            room -= tokens(turn[1])
            if room < 0:
                break
            repeated.insert(0, turn)
        repeated = self.system + repeated
        return Window(repeated, [], sum(tokens(t) for _, t in repeated))

    def close(self) -> Iterator[dict]:
        if self.window.new:
            yield self.window.row(self.key, self.number)
            self.number += 1


def _in_frames(rows: Iterator[dict], most_chars: int = 1 << 22) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text", "")) + 64
        if size > most_chars:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def _windows(budget: int, history: int):
    def rows(batches):
        now = None
        for batch in batches:
            for null, conv, role, text in zip(batch["_null"], batch["conv_id"], batch["role"], batch["text"]):
                if now is None or now.key != (null, conv):
                    if now is not None:
                        yield from now.close()
                    now = Conversation((null, conv), budget, history)
                yield from now.add(role, text)
        if now is not None:
            yield from now.close()

    return lambda batches: _in_frames(rows(batches))


def windows(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """Windows of all conversations: ``conv_id``, ``_null``, ``window``, ``text``, ``n_repeated``, ``loss_starts``, ``loss_ends``, ``n_tokens``.

    Turns go by ``turn`` (NULL first), then role and text; repeated rows are turns of
    their own. A NULL role or text counts as empty, rows with a NULL id form one
    conversation (``_null``, ``conv_id`` 0). A first turn of role system is kept in
    every window. A turn over the budget gets a window of its own, as a whole. Loss
    ranges are code points of ``text``, ends exclusive, escapes included.

    A conversation is streamed through one task in order, turn by turn; the task holds
    one window of it, however long it is.
    """
    rows = conversations.select(
        F.col(conv_id).isNull().alias("_null"), F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv_id"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    key = ["_null", "conv_id"]
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "_turn", "role", "text").drop("_turn")
    return ordered.mapInPandas(
        _windows(budget, history),
        "_null boolean, conv_id long, window long, text string, n_repeated int, loss_starts array<int>, loss_ends array<int>, n_tokens long",
    )


class _Reader:
    """Digests of one conversation, read from its windows."""

    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss = key, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, repeated: int, starts, ends) -> None:
        for role, body in _TURN.findall(text)[repeated:]:
            self.all.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
            self.turns += 1
        for a, b in zip(starts, ends):
            plain = unescaped(text[a:b])
            self.masked.update(plain.encode())
            self.loss += len(plain)
        self.chars += len(text)

    def row(self) -> dict:
        return {
            "_null": self.key[0], "conv_id": self.key[1], "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss, "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.chars,
        }


def _read(batches):
    now = None
    for batch in batches:
        done = []
        for null, conv, text, repeated, starts, ends in zip(*(batch[c] for c in ("_null", "conv_id", "text", "n_repeated", "loss_starts", "loss_ends"))):
            if now is None or now.key != (null, conv):
                if now is not None:
                    done.append(now.row())
                now = _Reader((null, conv))
            now.add(text, repeated, starts, ends)
        if done:
            yield pd.DataFrame(done)
    if now is not None:
        yield pd.DataFrame([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say: turns, and texts under the loss mask, unescaped.

    Windows have to come in the order that ``windows`` gives them; reading adds no shuffle.
    """
    read = formatted.mapInPandas(
        _read, "_null boolean, conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return read.withColumn("conv_id", F.when(~F.col("_null"), F.col("conv_id"))).drop("_null")
