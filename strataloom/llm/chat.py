r"""Chat formatting with a grammar round trip.

A conversation is rendered by a small grammar, each turn on its own:

    turn = "### " name ": " body "</turn>\n"

A backslash takes the next character literally. A body holds neither "###" nor
"</turn>" unescaped, a name no ":" either. Every turn is rendered plain, parsed
again, and escaped where that gives anything but the source. The loss mask
covers the bodies of assistant turns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Batches, chained, columns, packed, slices

# The control strings of the template.
HEAD, AFTER, END, ESCAPE = "### ", ": ", "</turn>\n", "\\"
TRAINED = "assistant"
PART = 1 << 20  # characters of one output row; longer conversations go on in the next

_BODY = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_NAME = re.compile(r"[\\:#<]")
_STOP = re.compile(r"\\|###|</turn>|:")
FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.int64()))])
READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


class Malformed(ValueError):
    """The text is not of the grammar."""


def _literal(text: str, at: int, ends: tuple[str, ...], name: bool) -> tuple[str, int]:
    """Unescaped content from ``at`` up to one of ``ends``, and where that begins."""
    found = []
    while True:
        stop = _STOP.search(text, at)
        if stop is None:
            raise Malformed("no end")
        found.append(text[at : stop.start()])
        mark = stop[0]
        if mark == ESCAPE:
            if stop.end() >= len(text):
                raise Malformed("nothing to escape")
            found.append(text[stop.end()])
            at = stop.end() + 1
        elif mark == ":" and not name:
            found.append(mark)
            at = stop.end()
        elif mark in ends:
            return "".join(found), stop.start()
        else:
            raise Malformed(f"{mark} inside")


def parse(text: str, at: int = 0) -> list[tuple[str, str, int, int]]:
    """``name, body, start, stop`` of each turn; start and stop hold the escaped body in ``text``."""
    turns = []
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise Malformed("no head")
        name, at = _literal(text, at + len(HEAD), (":",), True)
        if not text.startswith(AFTER, at):
            raise Malformed("no body")
        start = at + len(AFTER)
        body, stop = _literal(text, start, ("</turn>",), False)
        if not text.startswith(END, stop):
            raise Malformed("no line end")
        turns.append((name, body, start, stop))
        at = stop + len(END)
    return turns


def render(name: str, body: str) -> tuple[str, int, int]:
    """A turn and where its body stands: plain if that parses back to the same, else escaped."""
    shown_name, shown = name, body
    for _ in range(2):
        text = f"{HEAD}{shown_name}{AFTER}{shown}{END}"
        try:
            turns = parse(text)
            if [t[:2] for t in turns] == [(name, body)]:
                return text, turns[0][2], turns[0][3]
        except Malformed:
            pass
        shown_name, shown = _NAME.sub(r"\\\g<0>", name), _BODY.sub(r"\\\g<0>", body)
    raise Malformed("no form of this turn parses back")  # escaping is complete: not reached


def format_batches(batches: Batches) -> Batches:
    """Turns in order to formatted rows with the places of the loss mask (start, stop, start, stop, ...)."""

    def rows():
        now, part, texts, loss, size = None, 0, [], [], 0
        for piece in slices(batches):
            for conv, role, body in zip(*columns(piece, "conv_id", "role", "text"), strict=True):
                if texts and (conv != now or size >= PART):
                    yield now, part, "".join(texts), loss
                    part = part + 1 if conv == now else 0
                    texts, loss, size = [], [], 0
                now = conv
                text, start, stop = render(role or "", body or "")
                if role == TRAINED:
                    loss += [size + start, size + stop]
                texts.append(text)
                size += len(text)
        if texts:
            yield now, part, "".join(texts), loss

    yield from packed(rows(), FORMATTED, lambda row: 4 * len(row[2]))


def read_batches(batches: Batches) -> Batches:
    """Formatted rows, read back by the parser and the mask, to a digest per conversation; nothing but digests is held."""

    def rows():
        now = None
        for piece in slices(batches, 16):
            for conv, part, text, loss in zip(*columns(piece, *FORMATTED.names), strict=True):
                if part == 0:
                    if now is not None:
                        yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for name, body, _, _ in parse(text):
                    now[1] += 1
                    now[2].update(f"{name}\n{body}\n".encode())
                for start, stop in zip(loss[::2], loss[1::2], strict=True):
                    under, _ = _literal(text[start:stop] + END, 0, ("</turn>",), False)
                    now[3] += len(under)
                    now[4].update(under.encode())
                now[5] += len(text)
        if now is not None:
            yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    yield from packed(rows(), READ, lambda row: 200)


def _in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; streams through a task, so a long conversation is never held whole."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def chat(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, text, loss`` of ``conversations(conv_id, turn, role, text)``.

    Null texts and roles count as empty, a null id is one conversation, null
    turns come first, turns of one number stand by role and text, repeated rows
    are turns of their own. Conversations over ``PART`` characters take several
    rows. Other columns are not looked at. An empty table gives no rows.
    """
    return _in_order(conversations).mapInArrow(format_batches, "conv_id long, part long, text string, loss array<long>")


def round_trip(conversations: DataFrame) -> DataFrame:
    """:func:`chat`, read back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(conversations).mapInArrow(chained(format_batches, read_batches), kind)
