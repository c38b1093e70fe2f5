r"""Chat formatting by a grammar round trip.

Grammar: a conversation is a sequence of turns, each `### role: text</turn>` and a line break.
`\` before `\`, `#`, `<` or `:` stands for that character; any other `\` for itself. Each rendered
turn is parsed again. Where that doesn't give back the role and text, control strings are
escaped; where it still doesn't, backslashes too, after which it always does.

Rendering is narrow: a turn is a row, its text before and after, and the place of its loss mask.
Reading back streams each conversation's turns in order, one turn in memory at a time, so a
conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"\\([\\#<:])")
_ROLE = re.compile(r"((?:[^\\:]|\\[\\#<:]|\\(?![\\#<:])|:(?! ))*): ", re.S)
_TEXT = re.compile(r"((?:[^\\<]|\\[\\#<:]|\\(?![\\#<:])|<(?!/turn>\n))*+)</turn>\n", re.S)


class NotATurn(ValueError):
    """The text at this place doesn't follow the grammar."""


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, text, where the (escaped) text begins and ends, and where the turn ends, of the turn at `at`."""
    if not text.startswith(OPEN, at):
        raise NotATurn(f"no turn at {at}")
    role = _ROLE.match(text, at + len(OPEN))
    body = role and _TEXT.match(text, role.end())
    if not body:
        raise NotATurn(f"the turn at {at} has no end")
    plain = lambda s: _ESCAPED.sub(r"\1", s)
    return plain(role[1]), plain(body[1]), body.start(1), body.end(1), body.end()


def parse_all(text: str) -> list[tuple[str, str]]:
    """All (role, text) of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        role, body, _, _, at = parse(text, at)
        out.append((role, body))
    return out


def _controls(s: str) -> str:
    return s.replace("</turn>", "\\</turn>").replace("###", "\\###").replace(": ", "\\: ")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends in it; escaped no more than needed."""
    levels = [lambda s: s, _controls, lambda s: re.sub(r"[\\#<:]", r"\\\g<0>", s)]
    for escape in levels:
        out = OPEN + escape(role) + COLON + escape(text) + CLOSE
        try:
            again, body, begin, end, over = parse(out)
        except NotATurn:
            continue
        if (again, body, over) == (role, text, len(out)):
            return out, begin, end
    raise AssertionError("full escapes are reversible")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_end (code points in `formatted`, null unless the role is
    the assistant's) of every row. A conversation's formatted text is its rows', in order of turn.

    Null roles and texts are empty. Repeated rows stay, next to each other. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(*render(r or "", t or ""), r == LOSS_ROLE) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            columns = [pa.array([m[0] for m in made], pa.string())] + [pa.array([m[i] if m[3] else None for m in made], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    rows = only(conversations, "conv_id", "turn", "role", "text")
    cast = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    return rows.select(*cast).mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output of `format_turns` alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A null conv_id is one conversation. A digest goes over a conversation's turns in order, so one task
    reads all of these, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        rows: list[tuple] = []

        def close() -> None:
            if state:
                n, turns, chars, loss, total = state
                rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)
            rows.clear()
            return made

        for b in batches:
            for conv, text, begin, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_all(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if begin is not None:
                    masked = _ESCAPED.sub(r"\1", text[begin:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield out()
        close()
        yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted", "loss_start")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
