"""Chat formatting with a grammar round trip (operator 9).

Grammar of the output, read without lookahead or guesses::

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" content "<|im_end|>" "\\n"

Role and content hold no ``<|``, and a role no line break. Each turn is rendered plain and parsed again; if
what comes back is not the source, its strings are escaped and it is rendered once more, until they agree. The escape
puts one more backslash between ``<`` and ``|`` of every ``<\\...\\|``; reading takes one away, so it is reversible for
any text, one that looks escaped included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_BACK = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\\\|\\n", lambda m: _ROLE_BACK[m[0]], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the content in ``rendered``) of each turn; None if the grammar does not fit."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END + "\n", line)
        if line < 0 or end < 0:
            return None
        role, content = rendered[at + len(START) : line], rendered[line + 1 : end]
        if "<|" in role or "<|" in content:
            return None
        turns.append((_unescape_role(role), unescape(content), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its content starts and ends in it."""
    for r, t in ((role, text), (_escape_role(role), escape(text))):
        piece = f"{START}{r}\n{t}{END}\n"
        back = parse(piece)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return piece, back[0][2], back[0][3]
    raise AssertionError("escaping did not make the round trip whole")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, piece, loss_from, loss_upto.

    The pieces of a conversation, in order of turn (ties: of piece), make its formatted text; characters from
    loss_from up to loss_upto of a piece are under the loss mask (assistant content), null for other roles. Null text
    and role are empty strings; null conv_ids are one conversation; extra columns are not read. Turns are formatted
    each on its own, so a conversation of any length needs no task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            mask = [r == TRAINED for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if k else None for m, k in zip(made, mask, strict=True)], pa.int64()),
                    pa.array([m[2] if k else None for m, k in zip(made, mask, strict=True)], pa.int64()),
                ],
                names=["conv_id", "turn", "piece", "loss_from", "loss_upto"],
            )

    chosen = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "conv_id long, turn long, piece string, loss_from long, loss_upto long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from format_turns() output: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Conversations are dealt out whole and read in order as a stream: a task holds one batch and the running
    hashes, never a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None

        def row() -> list:
            return [own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]]

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            done = []
            for conv, piece, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        done.append(row())
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(piece):
                    own[1] += 1
                    own[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                own[5] += len(piece)
                if start is not None:
                    loss = unescape(piece[start:end])
                    own[3] += len(loss)
                    own[4].update(loss.encode("utf-8", "surrogatepass"))
            yield batch(done)
        if own is not None:
            yield batch([row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
