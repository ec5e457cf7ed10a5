r"""Chat formatting in budgeted windows.

A conversation's turns are written as ``<turn ROLE>`` line feed, text, ``</turn>`` line
feed. In roles and texts a backslash goes before every backslash and before a ``<``
that begins a mark, so texts can hold any control string and are read back exactly.

Long conversations become several windows of at most ``budget`` tokens of the public
tokenizer, marks included: it cuts at white space, so a window's tokens are the sum of its
turns'. Prefix sums of the turns' tokens choose turn-aligned spans. Every window after the first repeats the
system turn (a first turn of role ``system``) and the last turns before its span, up
to ``history`` tokens; repeated turns are masked, so each assistant text is a target
exactly once. A turn that exceeds the budget alone gets a window of its own, whole.

Turns of a conversation are read as a stream in order, so the memory in use follows
the window, not the conversation.

Nulls: a null text or role is empty; each row with a null conversation id is a
conversation of its own, with a null id, and these are dealt over all tasks; null turn
numbers come first. Repeated rows are turns of their own, in order of turn, role and
text. Texts may be of any length. Columns of other names are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .bytescan import pieces, released

WINDOWS = "conv_id long, window int, text string, repeated int, turns int, tokens long, loss array<struct<start:int,stop:int>>"
_ESCAPE = re.compile(r"\\|<(?=/?turn)")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: Runs of plain characters and possessive repeats: nothing is kept for a character.
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\><]", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def written(role: str, text: str) -> str:
    """A turn as it stands in a window."""
    return f"<turn {escape_role(role)}>\n{escape(text)}</turn>\n"


def count_tokens(texts: list[str], path: str | None = None, most: int = 1 << 20) -> list[int]:
    """Tokens of each text by the public tokenizer, counted in slices that end at white space."""
    enc, counts, held, size = encoder(path or default_path()), [0] * len(texts), [], 0

    def flush():
        _, bounds = enc.encode(pa.array([t for _, t in held], pa.large_string()))
        for (i, _), n in zip(held, np.diff(bounds).tolist()):
            counts[i] += n

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > most:
                space = _SPACE.search(text, at + most)
                to = space.end() if space else to
            held.append((i, text[at:to]))
            size += to - at
            at = to
            if size >= most:
                flush()
                held, size = [], 0
    flush()
    return counts


class Conversation:
    """Takes turns in order and gives windows as soon as they are full."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.past, self.turns, self.window, self.seen = None, [], [], 0, 0

    def add(self, role: str, text: str, tokens: int):
        turn = (role, text, tokens)
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        if sum(t[2] for t in self.turns[-1:]) + self.held >= self.budget or len(self.turns) % 64 == 0:
            yield from self._windows(False)

    @property
    def held(self) -> int:
        return sum(t[2] for t in self.turns[:-1])

    def _windows(self, last: bool):
        while self.turns:
            before = self._repeat()
            sums = list(accumulate(t[2] for t in self.turns))
            room = self.budget - sum(t[2] for t in before)
            n = bisect_right(sums, room)
            if n == len(self.turns) and not last:
                return
            if n == 0 and before:  # rather the turn than its history
                before = before[: bool(self.system and self.window)]
                n = bisect_right(sums, self.budget - sum(t[2] for t in before))
            n = n or 1
            yield self._write(before, self.turns[:n])
            self.past += self.turns[:n]
            sums = list(accumulate(t[2] for t in reversed(self.past)))
            self.past = self.past[len(self.past) - bisect_right(sums, self.history) - 1 if sums[-1] > self.history else 0 :]  # what history can repeat, and one more
            self.turns = self.turns[n:]
            self.window += 1

    def _repeat(self) -> list:
        if not self.window:
            return []
        own = self.past[1:] if self.system and self.past and self.past[0] is self.system else self.past
        sums = list(accumulate(t[2] for t in reversed(own)))
        n = bisect_right(sums, self.history)
        return ([self.system] if self.system else []) + (own[-n:] if n else [])

    def _write(self, before: list, new: list) -> tuple:
        parts, at, loss = [], 0, []
        for k, (role, text, _) in enumerate(before + new):
            parts.append(written(role, text))
            if k >= len(before) and role == "assistant":
                loss.append({"start": at + len(written(role, "")) - len("</turn>\n"), "stop": at + len(parts[-1]) - len("</turn>\n")})
            at += len(parts[-1])
        return self.conv, self.window, "".join(parts), len(before), len(before) + len(new), sum(t[2] for t in before + new), loss

    def end(self):
        yield from self._windows(True)


def _batches(rows, schema: pa.Schema, size: int = 500, chars: int = 1 << 20):
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[2])
        if len(held) == size or n >= chars:
            n = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """The windows of ``turns(conv, turn, role, text)``; see ``WINDOWS``.

    ``loss`` are the targets as ranges of code points of the window's text; the first
    ``repeated`` turns of a window stand in earlier windows too.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def windows(batches):
        now = None
        for batch in batches:
            for part in pieces(batch, 2):
                cols = [x.to_pylist() for x in part.columns]
                tokens = count_tokens([written(r, t) for r, t in zip(*cols[1:])], path)
                for c, r, t, n in zip(*cols, tokens):
                    if now is None or c is None or now.conv != c:
                        if now is not None:
                            yield from now.end()
                        now = Conversation(c, budget, history)
                    yield from now.add(r, t, n)
        if now is not None:
            yield from now.end()

    run = released(lambda batches: _batches(windows(batches), schema))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = rows.withColumn("_alone", alone).repartition("conv_id", "_alone").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def read_turns(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a window; the window must be marks and turns throughout."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(windows: DataFrame) -> DataFrame:
    """What stands in the windows of each conversation, read back from their texts.

    Windows of a conversation must follow each other in one partition, as
    ``format_windows`` gives them.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "windows"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])))

    def read(batches):
        conv, state = None, None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for c, window, text, repeated, loss in zip(*(cols[n] for n in ("conv_id", "window", "text", "repeated", "loss"))):
                if state is None or c != conv or window == 0:
                    if state is not None:
                        yield finish(conv, state)
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, t in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    t = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(t)
                    state[3].update(t.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
        if state is not None:
            yield finish(conv, state)

    def finish(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

    return windows.mapInArrow(lambda b: _batches(read(b), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long")
