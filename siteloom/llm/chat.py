r"""Chat formatting by a grammar that is read back.

    conversation = turn*
    turn         = "<turn>" role "\n" text "\n</turn>\n"

A control string `<turn>` or `</turn>` counts where no backslash stands before it. In
texts, a backslash before a (further backslashed) control string is taken off when
reading; in roles, `\\` is a backslash and `\n` a line break. A turn is first written
as it is. The deterministic parser then reads the text again; turns that come back
changed, or not at all, are escaped, until what is read equals what was written.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"(\\*)(</?turn>)")
_ESCAPED = re.compile(r"\\(\\*)(</?turn>)")
_MARK = re.compile(r"(?<!\\)</?turn>")
_ROLE = re.compile(r"\\([\\n])")
OPEN, CLOSE = "<turn>", "</turn>"
#: Code points after which a piece of a conversation ends, at the end of a turn.
PIECE = 1 << 16


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str, escaped: bool) -> str:
    if escaped:
        role, text = role.replace("\\", "\\\\").replace("\n", "\\n"), escape(text)
    return f"{OPEN}{role}\n{text}\n{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, the span being that of the text as
    formatted; None if it is not in the grammar."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        if line < 0 or not formatted.startswith(OPEN, at):
            return None
        m = _MARK.search(formatted, line + 1)
        if not m or m[0] != CLOSE or m.start() < line + 2 or formatted[m.start() - 1] != "\n" or not formatted.startswith("\n", m.end()):
            return None
        role = _ROLE.sub(lambda x: "\n" if x[1] == "n" else "\\", formatted[at + len(OPEN) : line])
        out.append((role, unescape(formatted[line + 1 : m.start() - 1]), line + 1, m.start() - 1))
        at = m.end() + 1
    return out


def format_turn(role: str, text: str) -> str:
    """The turn as formatted: as it is if it reads back the same, else escaped."""
    for escaped in (False, True):
        made = render(role, text, escaped)
        if [t[:2] for t in parse(made) or []] == [(role, text)]:
            return made
    raise ValueError(f"turn does not survive formatting: {role!r}, {text[:80]!r}")


def format_conversations(turns: DataFrame, mask_role: str = "assistant", piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, formatted, mask): conversations in pieces of whole turns, to be
    joined in order; mask has the spans of the texts under the loss, in each piece.

    Turns are in the order of turn, then role, then text (ties and repeated rows are
    all kept; nulls first). Null role and text: empty. Null conv_id: one conversation. Other
    columns are ignored; of an empty table nothing comes.
    Pieces stream through the task, so a conversation of any length needs little memory.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(it):
        conv, no, made, length, known = object(), 0, [], 0, []
        rows = {n: [] for n in schema.names}
        size = 0

        def close():
            nonlocal made, length, known, no, size
            if made:
                whole = "".join(made)
                back = parse(whole)
                if [t[:2] for t in back or []] != known:
                    raise ValueError(f"conversation {conv} does not survive formatting")
                for name, value in zip(schema.names, (conv, no, whole, [{"start": s, "end": e} for r, _, s, e in back if r == mask_role]), strict=True):
                    rows[name].append(value)
                no, size = no + 1, size + length
            made, length, known = [], 0, []

        def flush():
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
            rows, size = {n: [] for n in schema.names}, 0
            return out

        for batch in it:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != conv:
                    close()
                    conv, no = c, 0
                role, text = role or "", text or ""
                made.append(format_turn(role, text))
                known.append((role, text))
                length += len(made[-1])
                if length >= piece:
                    close()
                    if size >= 64 * piece:
                        yield flush()
            if size >= 16 * piece:
                yield flush()
        close()
        yield flush()

    given = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, piece long, formatted string, mask array<struct<start:long,end:long>>",
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces and their masks:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(it):
        conv, state, out = object(), None, []
        for batch in it:
            for c, text, mask in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or c != conv:
                    if state:
                        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = parse(text)
                if found is None:
                    raise ValueError(f"conversation {c} is not in the grammar")
                for role, said, _, _ in found:
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[0] += len(found)
                state[4] += len(text)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if state:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
