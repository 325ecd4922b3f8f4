r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (turns end to end)::

    turn      := user | system | assistant | other
    user      := "[INST] " body " [/INST]"
    system    := "<<SYS>>\n" body "\n<</SYS>>\n"
    other     := "[TURN " body "] " body " [/TURN]"      (the first body is the role)
    assistant := body "</s>"                             (whatever begins none of the above)
    body      := ( "\" any | any )*  up to the first closing mark outside an escape

A turn is rendered as it is and parsed again.  If that does not give the same
role and text, conflicting characters are escaped and it is parsed again.  As the
parser decides by the leftmost mark, turns that parse alone parse end to end.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged

MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": ("", "</s>")}
OTHER = "[TURN ", "] ", " [/TURN]"
#: What an escape breaks: each mark has one of these; and the escape itself.
_SPECIAL = re.compile(r"[\\\[\]<]")
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def _body(s: str, at: int, close: str) -> tuple[str, int]:
    """Raw body from ``at`` to the first ``close`` outside an escape, and where it ends behind that."""
    i = at
    while True:
        end, esc = s.find(close, i), s.find("\\", i)
        if end < 0:
            raise ValueError("a turn does not end")
        if esc < 0 or esc >= end:
            return s[at:end], end + len(close)
        i = esc + 2


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, end) of the turn that begins at ``at``."""
    for role in ("user", "system"):
        begin, close = MARKS[role]
        if s.startswith(begin, at):
            raw, end = _body(s, at + len(begin), close)
            return role, unescape(raw), end
    if s.startswith(OTHER[0], at):
        role, end = _body(s, at + len(OTHER[0]), OTHER[1])
        raw, end = _body(s, end, OTHER[2])
        return unescape(role), unescape(raw), end
    raw, end = _body(s, at, MARKS["assistant"][1])
    return "assistant", unescape(raw), end


def parse(s: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    out, at = [], 0
    while at < len(s):
        role, text, at = parse_turn(s, at)
        out.append((role, text))
    return out


def _write(role: str, text: str, escaped_role: str) -> str:
    if role in MARKS:
        begin, close = MARKS[role]
        return begin + text + close
    return OTHER[0] + escaped_role + OTHER[1] + text + OTHER[2]


def render_turn(role: str, text: str) -> str:
    """The turn in the template; escaped only as far as the round trip asks for it."""
    for r, t in ((role, text), (escape(role), text), (role, escape(text)), (escape(role), escape(text))):
        out = _write(role, t, r)
        try:
            if parse_turn(out) == (role, text, len(out)):
                return out
        except ValueError:
            pass
    raise AssertionError(f"no escape of {role!r} {text!r} parses")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, place, formatted of every row, contiguous and in order within each file of the output.

    Turns go by number (null first), then by role and text, so ties and repeated rows
    have one order.  Null roles and texts count as empty; a null conv_id is one conversation.  Only
    the four columns of the table are read.
    """
    cols = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def kernel(batch: pa.RecordBatch):
        out = [render_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["conv_id", "turn", "role", "text", "formatted"])

    made = map_arrow(cols.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), kernel, "conv_id long, turn long, role string, text string, formatted string")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "formatted", F.monotonically_increasing_id().alias("place"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, by parsing its formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss mask covers the texts of assistant turns.  Conversations stream through
    a task turn by turn; none is held as a whole.
    """
    rows = formatted.select("conv_id", "place", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches):
        now, started = None, False
        for batch in batches:
            done = []
            for conv, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not started or conv != now:
                    if started:
                        done.append((now, *state))
                    now, started, state = conv, True, [0, sha256(), 0, sha256(), 0]
                at = 0
                while at < len(s):
                    role, text, at = parse_turn(s, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "replace"))
                state[4] += len(s)
            yield rows_of(done)
        if started:
            yield rows_of([(now, *state)])

    def rows_of(done):
        cols = list(zip(*done)) or [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([x.hexdigest() for x in cols[2]], pa.string()), pa.array(cols[3], pa.int64()), pa.array([x.hexdigest() for x in cols[4]], pa.string()), pa.array(cols[5], pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_report(conversations: DataFrame) -> DataFrame:
    return read_back(staged(format_turns(conversations), "chat"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 18 WHEN 'assistant' THEN 4 ELSE 16 + length(role) END AS marks,
             length(text) - length(regexp_replace(text, '[\\\[\]<]', '', 'g')) AS n_special,
             contains(text, '\') OR (role = 'user' AND contains(text, ' [/INST]')) OR (role = 'system' AND contains(text, chr(10) || '<</SYS>>' || chr(10)))
             OR (role = 'assistant' AND (contains(text, '</s>') OR starts_with(text, '[INST] ') OR starts_with(text, '<<SYS>>' || chr(10)) OR starts_with(text, '[TURN '))) AS odd FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(marks + length(text) + CASE WHEN odd THEN n_special ELSE 0 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
