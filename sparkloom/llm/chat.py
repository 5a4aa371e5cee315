"""Chat formatting with a grammar round trip.

Grammar: conversation = turn*; turn = "### " role ": " body " </turn>" LF. Inside a body a run of n
backslashes before a control string ("###" or "</turn>") is written as 2n+1 backslashes, and any other text
stands as it is. A turn is first rendered as it is; if the deterministic parser does not give the same turn
back, its conflicting content is escaped, until it does. Turns delimit themselves, so a conversation is
parsed turn by turn, in bounded memory however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices

OPEN, CLOSE, END = "### ", "</turn>", " </turn>\n"
# a run of backslashes is read from its first one only, so that any text is read in one pass
_CONTROL = re.compile(r"(?<!\\)(\\*+)(###|</turn>)")
#: Roles that are written as a capitalised name; any other role is written as "=" and a JSON string.
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_ROLES = {v: k for k, v in _NAMES.items()}
_ROLE = re.compile("|".join(_ROLES))


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def _unescape(m: re.Match) -> str:
    return m[1][: len(m[1]) // 2] + m[2]


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; GrammarError where the text is not in the grammar."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise GrammarError(f"no turn begins at {at}")
        at += len(OPEN)
        if formatted.startswith("=", at):
            try:
                role, at = json.JSONDecoder().raw_decode(formatted, at + 1)
            except ValueError as e:
                raise GrammarError(str(e)) from e
        elif m := _ROLE.match(formatted, at):
            role, at = _ROLES[m[0]], m.end()
        else:
            raise GrammarError(f"no role at {at}")
        if not formatted.startswith(": ", at):
            raise GrammarError(f"no colon at {at}")
        at += 2
        for m in _CONTROL.finditer(formatted, at):
            if len(m[1]) % 2 == 0:
                break
        else:
            raise GrammarError("a turn does not end")
        end = m.start(2) - 1
        if m[2] != CLOSE or m[1] or end < at or not formatted.startswith(END, end):
            raise GrammarError(f"a bare control string at {m.start(2)}")
        out.append((role, _CONTROL.sub(_unescape, formatted[at:end])))
        at = end + len(END)
    return out


def render(role: str | None, text: str | None) -> str:
    """One turn in the grammar. A null role or text counts as empty."""
    role, text = role or "", text or ""
    name = _NAMES.get(role) or "=" + json.dumps(role)
    body = text
    for _ in range(2):
        formatted = f"{OPEN}{name}: {body}{END}"
        try:
            if parse(formatted) == [(role, text)]:
                return formatted
        except GrammarError:
            pass
        body = escape(text)
    raise GrammarError("a turn can't be written in the grammar")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted) of each row: the turn in the grammar, checked by parsing it again.

    A null role or text counts as empty; a text of any length is one turn, read in one pass. Repeated rows are
    turns each. Other columns are ignored whatever their names; an empty table gives no rows.
    """
    bounded_batches(conversations.sparkSession)
    schema = T.StructType([*conversations.select("conv_id", "turn").schema, T.StructField("formatted", T.StringType())])

    def run(batches):
        for batch in slices(batches):
            formatted = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(formatted, pa.string())], names=["conv_id", "turn", "formatted"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation, read back from its formatted turns: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. The loss mask covers the texts of the role `learn`.

    Turns are in the order of turn, ties in that of their formatted text; a null conv_id is a conversation. A
    digest needs a conversation's text in order, so one task reads it, as a sorted stream that it never holds.
    """
    bounded_batches(formatted.sparkSession)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([*formatted.select("conv_id").schema, *(T.StructField(n, T.StringType() if n.endswith("256") else T.LongType()) for n in names)])

    def run(batches):
        key, state, rows, kind = None, None, [], None

        def flush():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, columns[1:], strict=True))], names=["conv_id", *names])

        def close():
            rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in slices(batches):
            kind = batch.column(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                    if role == learn:
                        state[2] += len(body)
                        state[3].update(body.encode())
                state[4] += len(text)
            if len(rows) >= 1024:
                yield flush()
                rows = []
        if state is not None:
            close()
        if rows:
            yield flush()

    return formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted").mapInArrow(run, schema)
