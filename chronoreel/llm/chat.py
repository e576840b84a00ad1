"""Chat formatting: budgeted windows of whole turns, with a mask for the loss.

A conversation's turns, in order, are cut into spans by the prefix sums of their tokens. A
window shows the system turn, a limited stretch of the turns before its span, and the span.
Only assistants' texts of the span are under the loss mask, so each is learned once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning to the template or to common chat models; fixed values.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = sorted({c[0] for c in CONTROLS})
_REST = {f: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == f) for f in _FIRST}
_PLAIN = re.compile("|".join(rf"{re.escape(f)}(?=\\*(?:{_REST[f]}))" for f in _FIRST))
_MARKED = re.compile("|".join(rf"{re.escape(f)}\\(?=\\*(?:{_REST[f]}))" for f in _FIRST))
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.DOTALL)
SCHEMA = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, n_repeated int, n_turns int, n_tokens long"


def escape(text: str) -> str:
    """No control string is left: a backslash goes in after its first character, one more where there are some."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0], text)


class Turn:
    """A formatted turn: its pieces, tokens, and tokens of the conversation up to it."""

    __slots__ = ("role", "head", "body", "begin", "end")

    def __init__(self, role: str, body: str, tokens: int, before: int):
        self.role, self.head, self.body = role, f"<|{escape(role)}|>\n", body
        self.begin, self.end = before, before + tokens


class Windows:
    """Windows of one conversation, turn by turn; holds no more than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system = None
        self.past: list[Turn] = []
        self.span: list[Turn] = []
        self.number = self.upto = 0

    def add(self, role: str, body: str, tokens: int):
        t = Turn(role, body, tokens, self.upto)
        self.upto = t.end
        if self.span and t.end - self.span[0].begin > self._room():
            yield self._close()
        if self.number and not self.span:  # the oldest history goes until the turn fits
            while self.past and t.end - t.begin > self._room():
                self.past.pop(0)
        if t.begin == 0 and not self.span and self.number == 0 and role == "system":
            self.system = t
        self.span.append(t)

    def _room(self) -> int:
        """What the span may take beside the turns that are shown again."""
        shown = self._shown()
        return self.budget - sum(t.end - t.begin for t in shown)

    def _shown(self) -> list[Turn]:
        if not self.number:
            return []
        return ([self.system] if self.system else []) + self.past

    def _close(self):
        shown, parts, loss, at = self._shown(), [], [], 0
        for i, t in enumerate(shown + self.span):
            parts += [t.head, t.body, "</s>\n"]
            if i >= len(shown) and t.role == "assistant":
                loss.append({"start": at + len(t.head), "end": at + len(t.head) + len(t.body)})
            at += len(t.head) + len(t.body) + 5
        row = (self.conv_id, self.number, "".join(parts), loss, len(shown), len(shown) + len(self.span), sum(t.end - t.begin for t in shown + self.span))
        last = self.span[-1].end
        self.past = [t for t in self.past + self.span if t is not self.system and last - t.begin <= self.history]
        self.span, self.number = [], self.number + 1
        return row

    def rest(self):
        if self.span:
            yield self._close()


def count_tokens(texts: list[str], tokenizer: str) -> np.ndarray:
    from chronoreel.llm.token_store import tokenize

    return tokenize([t.encode() for t in texts], tokenizer)[1]


def format_windows(
    turns: DataFrame,
    budget: int = 2_048,
    history: int = 256,
    tokenizer: str | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row a window: ``conv_id, window, text, loss, n_repeated, n_turns, n_tokens``.

    ``loss`` are spans of code points of ``text``. A window is over the budget only where the
    system turn and one more are over it together; that turn has a window of its own, whole. Null roles and texts are empty, rows without a conversation are one
    conversation, rows of equal turn stand in order of role and text. A conversation is read
    as a sorted stream by one task, in memory no more than a window.
    """
    from chronoreel.llm.token_store import default_tokenizer

    path = tokenizer or default_tokenizer()
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        open_, names = None, ["conv_id", "window", "text", "loss", "n_repeated", "n_turns", "n_tokens"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64()]
        for b in batches:
            bodies = [escape(t) for t in b.column("text").to_pylist()]
            roles, out = b.column("role").to_pylist(), []
            tokens = count_tokens([f"<|{r}|>\n{t}</s>\n" for r, t in zip(roles, bodies, strict=True)], path)
            for conv, role, body, n in zip(b.column("conv_id").to_pylist(), roles, bodies, tokens.tolist(), strict=True):
                if open_ is None or open_.conv_id != conv:
                    out += open_.rest() if open_ else []
                    open_ = Windows(conv, budget, history)
                out += open_.add(role, body, n)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)
        if open_:
            yield _last(open_, kinds, names)

    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def _last(open_: Windows, kinds, names) -> pa.RecordBatch:
    out = list(open_.rest())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, as they were."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def digest(windows: DataFrame) -> DataFrame:
    """Read windows back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows`` of each conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now = None

        def close():
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]]

        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        out.append(close())
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in read_turns(r["text"])[r["n_repeated"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    text = unescape(r["text"][s["start"] : s["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(r["text"])
                now[6] += 1
            yield _rows(out, names, schema)
        if now:
            yield _rows([close()], names, schema)

    return windows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)


def _rows(out: list, names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)
