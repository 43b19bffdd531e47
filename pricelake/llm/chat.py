"""Chat formatting by prefix-target expansion: each assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values). A turn is OPEN, role, newline, text, CLOSE, newline.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"

_EXAMPLES = [("conv_id", pa.int64()), ("example", pa.int64()), ("context", pa.string()), ("target", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
_DIGESTS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_DDL = {pa.int64(): "bigint", pa.string(): "string"}


def escape(text: str) -> str:
    """Puts a backslash between `<` and a following `|` or backslash, so that no control string is left."""
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return text.replace("<\\", "<")


def head(role: str) -> str:
    return OPEN + escape(role.replace("%", "%25").replace("\n", "%0A")) + "\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = part.removeprefix(OPEN).partition("\n")
        turns.append((unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)))
    return turns


def _ddl(fields: list) -> str:
    return ", ".join(f"{k} {_DDL[v]}" for k, v in fields)


def _sent(rows: list, fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example, context, target, loss_start, loss_end.

    `context` holds all preceding turns, formatted; `target` the assistant's
    header, reply and end mark.  The loss mask covers the characters from
    loss_start to loss_end of context + target: the reply's text alone.  A
    conversation whose last turns are not the assistant's, or that has no
    assistant turn, ends with one more row that has all turns as context, an
    empty target and an empty mask, so that no turn is lost.

    Conversations are hash-partitioned and streamed turn after turn; a task
    holds one context.  The rows come out grouped by conversation, in order.
    All contexts together grow with the square of a conversation's turns; that
    is the method's own output.

    Order: turn, then role, then text (nulls first), so ties have one result
    and repeated rows are repeated turns.  Null role and text are empty; rows
    with a null conv_id form one conversation with a null id.
    """
    by = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, prefix, n, owed = None, False, "", 0, False
        out, size = [], 0
        for part in parts:
            for c, role, text in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                if not open_ or c != conv:
                    if owed:
                        out.append((conv, n, prefix, "", len(prefix), len(prefix)))
                    conv, open_, prefix, n, owed = c, True, "", 0, False
                start, body = head(role), escape(text)
                if owed := role != ASSISTANT:
                    prefix += start + body + CLOSE + "\n"
                    continue
                target, at = start + body + CLOSE + "\n", len(prefix) + len(start)
                out.append((conv, n, prefix, target, at, at + len(body)))
                n, size = n + 1, size + len(prefix) + len(target)
                prefix += target
                if size > 4_000_000:
                    yield _sent(out, _EXAMPLES)
                    out, size = [], 0
        if owed:
            out.append((conv, n, prefix, "", len(prefix), len(prefix)))
        if out:
            yield _sent(out, _EXAMPLES)

    return rows.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(run, _ddl(_EXAMPLES))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``examples`` are as `expand_prefix_targets` returns them, or read from a
    table written so: a conversation's rows together and in order.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> tuple:
            turns, digest = parse(whole), hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(whole)

        conv, open_, whole, chars, loss, out = None, False, "", 0, hashlib.sha256(), []
        for part in parts:
            for c, _, context, target, lo, hi in zip(*(part.column(i).to_pylist() for i in range(6))):
                if not open_ or c != conv:
                    if open_:
                        out.append(done())
                    conv, open_, chars, loss = c, True, 0, hashlib.sha256()
                whole = context + target
                reply = unescape(whole[lo:hi])
                chars += len(reply)
                loss.update(reply.encode())
            if len(out) > 1000:
                yield _sent(out, _DIGESTS)
                out = []
        if open_:
            out.append(done())
        if out:
            yield _sent(out, _DIGESTS)

    return examples.mapInArrow(run, _ddl(_DIGESTS))
