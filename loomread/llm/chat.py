"""Chat formatting in budgeted windows, with a loss mask, and the way back from the formatted text."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"\\|###|</turn>|:")
_FIRST_END = re.compile(r"((?:[^\\]|\\.)*?)</turn>\n", re.S)
_FIRST_COLON = re.compile(r"((?:[^\\]|\\.)*?):", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash, ``###``, ``</turn>`` and colon; unescape() undoes it exactly."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text starts and ends in it."""
    head = f"{HEAD}{escape(role)}: "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(window):
        if not window.startswith(HEAD, at):
            raise ValueError(f"no turn starts at {at}")
        role = _FIRST_COLON.match(window, at + len(HEAD))
        start = role.end() + 1
        body = _FIRST_END.match(window, start)
        out.append((unescape(role[1]), unescape(body[1]), start, start + len(body[1])))
        at = body.end()
    return out


class _Windows:
    """Turn-aligned windows of one conversation, given its turns in order; spans are chosen by prefix sums of turn tokens."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.sums = [0]               # tokens of all turns before each one
        self.start = 0                # first own turn of the open window
        self.turns: list[tuple] = []  # of the open window: repeated ones first
        self.repeated = self.carried = self.number = 0  # turns and tokens that the open window repeats

    def add(self, role: str, text: str):
        """Takes the next turn; the window that it closes, if any."""
        cost, k, done = len(TOKEN.findall(text)) + 4, len(self.sums) - 1, None
        self.sums.append(self.sums[-1] + cost)
        if k > self.start and self.carried + self.sums[k + 1] - self.sums[self.start] > self.budget:
            done, turns = self.close()
            # the system turn, then as many last turns as fit in half of the budget, beside the new turn
            head = self.sums[1] if self.system else 0
            most = min(self.budget // 2, self.budget - cost) - head
            own = k - self.start + max(0, self.repeated - bool(self.system))  # turns of the closed window that may be repeated
            back = 0
            while back < min(self.history, own) and k - back - 1 >= bool(self.system) and self.sums[k] - self.sums[k - back - 1] <= most:
                back += 1
            self.turns = ([self.system] if self.system else []) + turns[len(turns) - back:]
            self.repeated, self.carried, self.start = len(self.turns), head + self.sums[k] - self.sums[k - back], k
        if k == 0 and role == "system":
            self.system = (role, text)
        self.turns.append((role, text))
        return done

    def close(self):
        parts, spans, at = [], [], 0
        for i, (role, text) in enumerate(self.turns):
            piece, a, b = render(role, text)
            if role == "assistant" and i >= self.repeated:
                spans.append((at + a, at + b))
            parts.append(piece)
            at += len(piece)
        row = (self.number, "".join(parts), self.repeated, [x for x, _ in spans], [y for _, y in spans])
        self.number += 1
        return row, self.turns


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 512, history: int = 2) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, mask_starts, mask_ends): all turns in windows of about ``budget`` tokens.

    A window holds whole turns: from its first one on as many as prefix sums of turn tokens allow; only a turn that is
    too large beside the system turn makes it larger than the budget. After the first, a window repeats the system turn
    (if the conversation starts with one) and up to ``history`` last turns; masks cover the escaped text of assistant
    turns that are not repeated, so each is a target once. Rows are dealt by conversation and streamed in the order of
    turn, role, text: a task holds one window at a time, however long a conversation is. Null roles and texts are
    empty; null turns come first; null ids are one conversation; repeated rows are turns of their own; an empty table
    gives an empty result; other columns are not read, so clashing names do no harm.
    """
    ordered = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "window", "formatted", "n_repeated", "mask_starts", "mask_ends"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        now, state, rows = object(), None, []
        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != now:
                    if state:
                        rows.append((now, *state.close()[0]))
                    now, state = c, _Windows(budget, history)
                if done := state.add(r, t):
                    rows.append((c, *done))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
                rows = []
        if state:
            rows.append((now, *state.close()[0]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return ordered.mapInArrow(run, "conv_id long, window int, formatted string, n_repeated int, mask_starts array<int>, mask_ends array<int>")


def read_chats(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, per conversation: digests of its turns and of the text under the loss mask.

    Windows are streamed in order within a conversation; repeated turns are left out, texts are unescaped.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows, now, n = [], object(), None
        for b in batches:
            for x in b.to_pylist():
                if n is None or x["conv_id"] != now:
                    if n is not None:
                        rows.append((now, n, all_.hexdigest(), chars, loss.hexdigest(), size))
                    now, n, chars, size, all_, loss = x["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                size += len(x["formatted"])
                for role, text, _, _ in parse(x["formatted"])[x["n_repeated"]:]:
                    n += 1
                    all_.update(f"{role}\n{text}\n".encode())
                for s, e in zip(x["mask_starts"], x["mask_ends"]):
                    under = unescape(x["formatted"][s:e])
                    chars += len(under)
                    loss.update(under.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
                rows = []
        if n is not None:
            rows.append((now, n, all_.hexdigest(), chars, loss.hexdigest(), size))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_chats(format_chats(turns))
