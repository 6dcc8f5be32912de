"""Chat logs as events, folded into final messages and rendered with a loss mask.

An event is (conv_id, message, seq, kind, role, text). ``start`` opens a message with its role,
``delta`` appends streamed text, ``edit`` replaces what is there, ``regenerate`` throws it away
and streams anew. Logs are partitioned by (conversation, message), so that one endless
conversation is not one task, and sorted by sequence number.

The template of a message is ``### role: text</turn>`` and a line break. Inside a role or text
``\\``, ``#`` and ``<`` (in a role ``:`` too) get a backslash before them, so neither a turn head
nor a turn end can come from a text, and dropping the backslashes restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitframe.llm.common import batch

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# possessive: no way back is kept, so a text takes no memory beside itself
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+): ([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.DOTALL)
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("role", pa.string()),
                       ("text", pa.string())])
_RENDERED = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()),
                       ("rendered", pa.string()), ("loss_start", pa.int64()),
                       ("loss_end", pa.int64())])
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _rows(batches, names) -> Iterator[tuple]:
    for rows in batches:
        yield from zip(*(rows.column(rows.schema.get_field_index(n)).to_pylist() for n in names))


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few MB of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > limit:
            yield batch(schema, **dict(zip(schema.names, zip(*held))))
            held, size = [], 0
    if held:
        yield batch(schema, **dict(zip(schema.names, zip(*held))))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): what each message says in the end.

    Events of one message apply in order of (seq, kind, text), so ties have one result; repeated
    ``delta`` rows append twice. A null text is empty, a null kind or an unknown one does
    nothing, a null role leaves the role as it is (empty at first). Null ids group as a value.
    """
    def run(batches):
        def folded():
            key, role, parts = None, "", []
            for conv, message, kind, new_role, text in _rows(
                    batches, ("conv_id", "message", "kind", "role", "text")):
                if key != (conv, message):
                    if key:
                        yield *key, role, "".join(parts)
                    key, role, parts = (conv, message), "", []
                role = role if new_role is None else new_role
                if kind in ("start", "edit", "regenerate"):
                    parts = []
                if kind in ("start", "edit", "delta"):
                    parts.append(text or "")
            if key:
                yield *key, role, "".join(parts)

        yield from _batched(folded(), _MESSAGES)

    return events.select("conv_id", "message", "seq", "kind", "role", "text").repartition(
        "conv_id", "message").sortWithinPartitions(
            "conv_id", "message", "seq", "kind", "text").mapInArrow(
                run, "conv_id long, message long, role string, text string")


def escape(text: str, also: str = "") -> str:
    for sign in "\\#<" + also:
        text = text.replace(sign, "\\" + sign)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, message, rendered, loss_start, loss_end): a conversation is its segments in order.

    The loss span covers the escaped text of ``trained_role`` in code points of the segment; it
    is empty (0, 0) for other roles. Null role or text: empty.
    """
    def run(batches):
        def segments():
            for conv, message, role, text in _rows(batches, _MESSAGES.names):
                head = HEAD + escape(role or "", ":") + AFTER_ROLE
                body = escape(text or "")
                span = (len(head), len(head) + len(body)) if role == trained_role else (0, 0)
                yield conv, message, head + body + END, *span

        yield from _batched(segments(), _RENDERED)

    return messages.select(*_MESSAGES.names).mapInArrow(
        run, "conv_id long, message long, rendered string, loss_start long, loss_end long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the rendered segments in order of ``message``.

    A conversation streams through its task with running digests, so its length is not bounded
    by memory. A segment that is no sequence of whole turns is an error.
    """
    def run(batches):
        def digests():
            key = None
            for conv, text, start, end in _rows(
                    batches, ("conv_id", "rendered", "loss_start", "loss_end")):
                if key != (conv,):
                    if key:
                        yield *key, n, turns.hexdigest(), lost, loss.hexdigest(), size
                    key, n, lost, size = (conv,), 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                at = 0
                while at < len(text):
                    turn = _TURN.match(text, at)
                    if not turn:
                        raise ValueError(f"conversation {conv}: no turn at {at} of a segment")
                    turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                    n, at = n + 1, turn.end()
                masked = unescape(text[start:end])
                loss.update(masked.encode())
                lost, size = lost + len(masked), size + len(text)
            if key:
                yield *key, n, turns.hexdigest(), lost, loss.hexdigest(), size

        yield from _batched(digests(), _DIGESTS)

    return rendered.repartition("conv_id").sortWithinPartitions(
        "conv_id", "message", "rendered").mapInArrow(
            run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                 "loss_sha256 string, formatted_chars long")
