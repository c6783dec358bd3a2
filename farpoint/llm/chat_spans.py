"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` to one string; nothing else is
assumed of it.  The prefixes of a conversation are rendered one turn longer each time.  What is
put into the output between two renderings is the turn's span; if anything else changed, the
template rewrites history and the turn is named.  A second rendering of the same prefix with a
lone sentinel as the last text shows where the text lies inside its span.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import fresh_name, small_batches

Messages = list[tuple[str, str]]

_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_ROLES = {v: k for k, v in _NAMES.items()}
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_END = "</turn>\n"


class MarkedTurns:
    """``### Role: text</turn>`` a line; control strings inside texts and roles get a backslash."""

    def __call__(self, messages: Messages) -> str:
        return "".join(f"### {self._name(role)}: {self.escape(text)}{_END}" for role, text in messages)

    @staticmethod
    def _name(role: str) -> str:
        if role in _NAMES:
            return _NAMES[role]
        escaped = re.sub(r"[\\:#<\n]", lambda m: "\\" + m[0], role)
        return "\\" + escaped if role in _ROLES else escaped

    @staticmethod
    def escape(text: str) -> str:
        return _CONTROL.sub(lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return _ESCAPED.sub(r"\1", text)

    def parse(self, formatted: str) -> Messages:
        """The messages of a rendering."""
        messages, at = [], 0
        while at < len(formatted):
            colon = _free(formatted, ": ", at + 4)
            end = _free(formatted, _END, colon + 2)
            name = formatted[at + 4 : colon]
            messages.append((_ROLES[name] if name in _ROLES else self.unescape(name), self.unescape(formatted[colon + 2 : end])))
            at = end + len(_END)
        return messages


def _free(text: str, mark: str, at: int) -> int:
    """Where ``mark`` next stands with an even number of backslashes before it."""
    while True:
        found = text.index(mark, at)
        back = found
        while back > 0 and text[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        at = found + 1


@dataclass(frozen=True)
class Span:
    """Where a turn stands in the whole rendering, and its text within it (code points)."""

    start: int
    stop: int
    text_start: int
    text_stop: int


def _common_end(a: str, b: str, most: int) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle :] == b[len(b) - middle :]:
            low = middle
        else:
            high = middle - 1
    return low


def absent(text: str) -> str:
    """A private-use character that ``text`` does not hold, or if it holds all a longer run of one than any in it."""
    single = next((c for c in map(chr, range(0xE000, 0xF900)) if c not in text), None)
    if single:
        return single
    longest = max(map(len, re.findall("\ue001+", text)))
    return "\ue000" + "\ue001" * (longest + 1) + "\ue000"


def turn_spans(render: Callable[[Messages], str], messages: Messages) -> tuple[str, list[Span | None], int | None]:
    """The whole rendering, each turn's span and the first turn at which history is rewritten.

    From that turn on, and for turns before it whose place is lost by that, spans are None.  A
    footer that stays at the end moves on with the text and is no rewriting.
    """
    before, spans, rewritten = render([]), [], None
    foot = 0
    for n in range(1, len(messages) + 1):
        now = render(messages[:n])
        foot_now = 0
        if now.startswith(before):
            start = len(before)
        else:  # what is new may stand before an unchanged ending
            head = len(os.path.commonprefix([before, now]))
            foot_now = _common_end(before, now, min(len(before), len(now)) - head)
            start = head
            if head + foot_now < len(before):
                rewritten = n - 1
                break
        if foot and start < spans[-1].stop - foot:
            rewritten = n - 1
            break
        role, text = messages[n - 1]
        sentinel = absent(now)
        probe = render([*messages[: n - 1], (role, sentinel)])
        text_start = probe.find(sentinel)
        tail = len(probe) - text_start - len(sentinel)
        if text_start < start or probe.count(sentinel) != 1 or text_start + tail > len(now):
            rewritten = n - 1  # the text is not where the turn is, or is shown twice
            break
        spans.append(Span(start, len(now) - foot_now, text_start, len(now) - tail))
        before, foot = now, foot_now
    whole = render(messages) if rewritten is not None else before
    if rewritten is not None:
        spans = [None] * len(messages)
    return whole, spans, rewritten


_TURN = pa.struct([pa.field(n, t) for n, t in (("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64()))])
_SCHEMA = "formatted string, turns array<struct<role:string,start:long,stop:long,text_start:long,text_stop:long>>, rewritten_at long"


def formatted(
    conversations: DataFrame, template: Callable[[Messages], str] | None = None,
    key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: its key, the ``formatted`` text, the spans of its ``turns`` and ``rewritten_at``.

    Turns follow ``turn`` (null first), then role, then text; repeated rows are turns of their
    own.  Null texts and roles are empty.  Rows without a key are one conversation.  An empty
    table gives an empty table.  Conversations are dealt out by key and read in order, one
    conversation in memory at a time.  ``rewritten_at`` is the turn (from 0) whose rendering
    changes earlier output, or null; such conversations have no spans.
    """
    render = template or MarkedTurns()
    names = [fresh_name(conversations, "k"), "t", "r", "x"]
    rows = conversations.select(
        F.col(key).alias(names[0]), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x")
    )
    ordered = small_batches(rows, 2_000).repartition(names[0]).sortWithinPartitions(names[0], "t", "r", "x").select(names[0], "r", "x")
    key_type = dict(rows.dtypes)[names[0]]

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, messages, kind, done = None, [], None, []
        for batch in batches:
            kind = batch.column(0).type
            for k, r, x in zip(*(c.to_pylist() for c in batch.columns)):
                if messages and k != now:
                    done.append((now, messages))
                    messages = []
                now = k
                messages.append((r, x))
            if done:
                yield _rendered(render, done, kind)
                done = []
        if messages:
            yield _rendered(render, [(now, messages)], kind)

    return ordered.mapInArrow(rendered, f"`{key}` {key_type}, {_SCHEMA}")


def _rendered(render: Callable[[Messages], str], done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    texts, turns, rewritten = [], [], []
    for _, messages in done:
        whole, spans, at = turn_spans(render, messages)
        texts.append(whole)
        rewritten.append(at)
        turns.append([{"role": r} | (vars(s) if s else {}) for (r, _), s in zip(messages, spans)])
    columns = [pa.array([k for k, _ in done], kind), pa.array(texts, pa.string()), pa.array(turns, pa.list_(_TURN)), pa.array(rewritten, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["k", "formatted", "turns", "rewritten_at"])


def digests(rendered: DataFrame, key: str = "conv_id", template: MarkedTurns | None = None) -> DataFrame:
    """What can be read back from ``rendered``: turns, and the assistants' texts under the loss mask."""
    read = template or MarkedTurns()
    key_type = dict(rendered.dtypes)[key]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(read, text, turns) for text, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], names=["k", "n", "t", "c", "l", "f", "w"])

    return rendered.select(key, "formatted", "turns", "rewritten_at").mapInArrow(
        digested,
        f"`{key}` {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long",
    )


def _digest(read: MarkedTurns, text: str, turns: list[dict]) -> tuple:
    messages = read.parse(text)
    whole = hashlib.sha256()
    for role, body in messages:
        whole.update(f"{role}\n{body}\n".encode())
    loss = [read.unescape(text[t["text_start"] : t["text_stop"]]) for t in turns if t["role"] == "assistant" and t["text_start"] is not None]
    joined = "".join(loss)
    return len(messages), whole.hexdigest(), len(joined), hashlib.sha256(joined.encode()).hexdigest(), len(text)


def with_control_case(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``conversations`` and conversation -7, whose two texts are made of control strings."""
    spark = conversations.sparkSession
    said: Column = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias(key),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return conversations.select(key, "turn", "role", "text").unionByName(added)
