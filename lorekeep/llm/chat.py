"""Chat formatting in budgeted windows.

A conversation's rows, by turn, become windows of formatted text. The prefix
sums of the turns' tokens choose turn-aligned spans: a window takes as many
new turns, as formatted with their marks and escapes, as the budget allows beside the system turns so far, which every
later window retains whatever their length (equal ones once), and a limited
history of turns already shown. Only assistant turns
that are new in a window stand under its loss mask, so each is a target once.

Control strings inside texts are escaped: a backslash is put behind the first
character of a control string, before any backslashes already there; reading
takes one away. Windows never cut a turn: one that is over the budget by
itself, or with the system turns, stands in a window marked over_budget.

Null texts and roles are empty; null conversation ids form one conversation;
ids are integers, or strings that hold one. Null turns come first. Rows with equal turns are ordered by role, then text.
Repeated rows are turns of their own. An empty table gives no windows. Extra
columns are not carried. A conversation streams through its task turn by
turn: memory holds a window, the history and the system turns, never the
conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, tidied
from lorekeep.llm.tokenize import default_path, encoder

#: Markers of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Control strings of this and other templates, cut behind their first character.
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>)")

SCHEMA = "conv_id bigint, window_no bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>, n_repeated bigint, n_new bigint, n_tokens bigint, over_budget boolean"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text begins."""
    head = f"{TURN}{escape(role)}{BODY}"
    return f"{head}{escape(text)}{END}", len(head)


class Windows:
    """Cuts one conversation's stream of turns into windows."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: dict[str, tuple] = {}  # by text, the turns that every later window retains
        self.held = 0  # their tokens
        self.before: list[tuple] = []  # turns shown, newest last, within the history's tokens
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the new turns' tokens
        self.number = 0

    def _repeated(self) -> list[tuple]:
        return [*self.system.values(), *self.before]

    def _taken(self) -> int:
        return self.held + sum(t[2] for t in self.before)

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.new and self._taken() + self.sums[-1] + tokens > self.budget:
            yield self.close()
        while self.before and self._taken() + tokens > self.budget:
            self.before.pop(0)  # history gives way to a new turn
        self.new.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def close(self) -> tuple:
        repeated = self._repeated()
        parts, spans, at = [], [], 0
        for i, (role, text, _) in enumerate(repeated + self.new):
            out, skip = _turn(role, text)
            if i >= len(repeated) and role == "assistant":
                spans.append({"start": at + skip, "end": at + len(out) - len(END)})
            parts.append(out)
            at += len(out)
        total = self._taken() + self.sums[-1]
        row = (self.conv, self.number, "".join(parts), spans, len(repeated), len(self.new), total, total > self.budget)
        for turn in self.new:
            if turn[0] == "system" and turn[1] not in self.system:
                self.system[turn[1]] = turn
                self.held += turn[2]
        shown = self.before + [t for t in self.new if t[0] != "system"]
        self.before, used = [], 0
        for turn in reversed(shown):
            used += turn[2]
            if used > self.history:
                break
            self.before.insert(0, turn)
        self.new, self.sums, self.number = [], [0], self.number + 1
        return row


def format_windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 1024, history: int = 256, tokenizer_path: str | None = None) -> DataFrame:
    """One row per window, in order within a partition."""
    path = tokenizer_path or default_path()
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]):
        encode, _ = encoder(path)
        current: Windows | None = None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        out.append(current.close())
                    current = Windows(conv, budget, history)
                # a turn ends in a newline and begins with a mark, where the vocabulary's pieces part:
                # the tokens of a window are the sum of those of its turns
                made = list(current.add(role, text, len(encode(_turn(role, text)[0])) // 4))
                out += made
                size += len(text) + sum(len(m[2]) for m in made)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if current is not None:
            out.append(current.close())
        yield _batch(out)

    return dealt.mapInArrow(tidied(run), SCHEMA)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.string(), _SPAN, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
_NAMES = ["conv_id", "window_no", "formatted", "loss_spans", "n_repeated", "n_new", "n_tokens", "over_budget"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        head, _, rest = part.partition(BODY)
        turns.append((unescape(head), unescape(rest.removesuffix(END))))
    return turns


READ_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read from their text and masks alone."""
    dealt = windows.select("conv_id", "window_no", "formatted", "loss_spans", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window_no")

    def run(batches: Iterable[pa.RecordBatch]):
        conv, state, out = None, None, []

        def done():
            turns, n, loss, chars, formatted, count = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count))

        for batch in batches:
            for c, _, text, spans, repeated in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done()
                    conv, state = c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in parse(text)[repeated:]:
                    state[0].update(f"{role}\n{body}\n".encode())
                    state[1] += 1
                for s in spans:
                    target = unescape(text[s["start"] : s["end"]])
                    state[2].update(target.encode())
                    state[3] += len(target)
                state[4] += len(text)
                state[5] += 1
        if state is not None:
            done()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return dealt.mapInArrow(tidied(run), READ_SCHEMA)
