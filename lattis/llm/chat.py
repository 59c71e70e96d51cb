"""Chat formatting with a grammar round trip.

Template, one element per turn, in order::

    system      <<SYS>>\\n TEXT \\n<</SYS>>\\n\\n
    user        [INST] TEXT [/INST]
    assistant   <s> TEXT </s>\\n
    other       <<TURN>>ROLE\\nTEXT<</TURN>>\\n        (null role: empty)

A text never holds a control string: the parser refuses it.  A turn is rendered as it is
and parsed; if the parser refuses or gives anything but the source, control strings of the
content (and what would read as an escaped one) get one backslash more after their first
character, and the turn is parsed again.  Parsing takes one backslash away, so this is
reversible for every text.

Turns are formatted row by row, before the shuffle.  A conversation is put together from
its turns as they stream by in order (sorted inside a partition), so that one of any
length needs constant memory; nothing gathers a conversation.

Defined cases: null text is empty, null role is empty; turns in order of ``turn`` (null
first), then role, then text; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, to_arrow

#: The control strings of the template.
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<TURN>>", "<</TURN>>"]
OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": "\n<</SYS>>\n\n", "user": " [/INST]", "assistant": " </s>\n"}
OTHER_OPEN, OTHER_CLOSE = "<<TURN>>", "<</TURN>>\n"

_control = re.compile("|".join(map(re.escape, CONTROLS)))
#: A control string with any number of backslashes after its first character.
_guarded = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_escaped = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))

_role_escape = re.compile(r"\\(.)", re.DOTALL)


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _guarded.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[0][0] + m[0][2:], text)


def _put(role: str, text: str) -> tuple[str, int, int]:
    """An element, and where the text stands in it."""
    head = OPEN[role] if role in OPEN else f"{OTHER_OPEN}{role}\n"
    return head + text + CLOSE.get(role, OTHER_CLOSE), len(head), len(head) + len(text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at a place: role and text as in the source, where the raw text stands, where the turn ends."""
    for role, head in OPEN.items():
        if rendered.startswith(head, at):
            break
    else:
        if not rendered.startswith(OTHER_OPEN, at):
            raise GrammarError("no turn starts here")
        role = None
    start = at + len(OPEN[role] if role else OTHER_OPEN)
    close = CLOSE[role] if role else OTHER_CLOSE
    found = _control.search(rendered, start)
    if found is None or found[0] != close.strip():
        raise GrammarError("a control string in a text, or no end")
    end = found.start() - (len(close) - len(close.lstrip()))
    stop = end + len(close)
    if end < start or rendered[end:stop] != close:
        raise GrammarError("the end is not as the template has it")
    raw = rendered[start:end]
    if role is None:
        name, newline, raw = raw.partition("\n")
        if not newline or name in OPEN:
            raise GrammarError("no role")
        start += len(name) + 1
        role = _role_escape.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
    return role, unescape(raw), start, end, stop


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """An element that parses to its source, and where its (escaped) text stands."""
    role, text = role or "", text or ""
    for name, content in ((role, text), (role, escape(text)), (escape(role.replace("\\", "\\\\").replace("\n", "\\n")), escape(text))):
        out = _put(name, content)
        try:
            if parse_turn(out[0]) == (role, text, out[1], out[2], len(out[0])):
                return out
        except GrammarError:
            pass
    raise GrammarError(f"role can't be formatted: {role!r}")


def parse(rendered: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    out, at = [], 0
    while at < len(rendered):
        role, text, _, _, at = parse_turn(rendered, at)
        out.append((role, text))
    return out


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: conversation, place, ``formatted`` (a conversation's text is their concatenation), ``loss_start``, ``loss_end`` (code points of the trained text in it; null for other roles)."""
    bounded_batches(df.sparkSession)
    source = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    schema = f"conv_id {source.schema['conv_id'].dataType.simpleString()}, turn {source.schema['turn'].dataType.simpleString()}, role string, text string, formatted string, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            trained = [r == "assistant" for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if k else None for m, k in zip(made, trained)], pa.int32()),
                 pa.array([m[2] if k else None for m, k in zip(made, trained)], pa.int32())],
                names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
            )

    return source.mapInArrow(run, schema)


def in_order(turns: DataFrame) -> DataFrame:
    """Formatted turns, each conversation whole and in order inside one partition."""
    kept = ("conv_id", "turn", "formatted", "loss_start", "loss_end")
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).select(*kept)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted text and its loss mask alone: the digests."""
    ordered = in_order(turns)
    kind = ordered.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [to_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close():
            conv, n, turns_hash, chars, loss_hash, total = state
            done.append((conv, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total))

        def batch():
            columns = list(zip(*done)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            for conv, _, formatted, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(formatted):
                    role, text, _, _, at = parse_turn(formatted, at)
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(formatted[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(formatted)
            if done:
                yield batch()
                done.clear()
        if state is not None:
            close()
            yield batch()

    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
