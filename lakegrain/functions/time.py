"""Unix-time functions: extraction as numbers, constants from strings, formatting."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime -> Spark pattern letters.
_PATTERN = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "I": "hh", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "e": "d", "Z": "z", "z": "Z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm"}


def wall(t: Column, zone: str, session: str) -> Column:
    """The wall clock of ``zone`` at t unix seconds, as a timestamp that shows it in the session's zone."""
    ts = F.timestamp_seconds(F.floor(t))
    return ts if zone == session else F.convert_timezone(F.lit(session), F.lit(zone), F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))).cast("timestamp")


def extract(t: Column, fmt: str, zone: str, session: str) -> Column:
    """The leading number of the formatted time."""
    ts = wall(t, zone, session)
    one = {"%H": F.hour, "%d": F.dayofmonth, "%m": F.month, "%Y": F.year, "%j": F.dayofyear, "%M": F.minute, "%S": F.second}
    if fmt in one:
        return one[fmt](ts).cast("double")
    if fmt == "%w":
        return (F.dayofweek(ts) - 1).cast("double")
    if fmt == "%u":
        return (F.weekday(ts) + 1).cast("double")
    if fmt == "%s":
        return F.floor(t).cast("double")
    return F.regexp_extract(_format(ts, fmt), r"^\s*([0-9]+\.?[0-9]*)", 1).try_cast("double")


def _format(ts: Column, fmt: str) -> Column:
    parts: list[Column] = []
    for piece in re.split(r"(%[A-Za-z%])", fmt):
        if piece in ("%w", "%u"):
            parts.append(((F.dayofweek(ts) - 1) if piece == "%w" else F.weekday(ts) + 1).cast("string"))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece.startswith("%") and len(piece) == 2:
            if piece[1] not in _PATTERN:
                raise ValueError(f"time format {piece} is not known")
            parts.append(F.date_format(ts, _PATTERN[piece[1]]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def format_time(t: Column, fmt: str, zone: str, session: str) -> Column:
    return _format(wall(t, zone, session), fmt)


def constant(text: str, fmt: str, zone: str) -> float:
    """Unix seconds of a time written as ``fmt`` says; parts that it lacks count from the first day."""
    return datetime.strptime(text, fmt).replace(tzinfo=ZoneInfo(zone)).timestamp()


def iso(t: Column, zone: str) -> Column:
    """Unix seconds of yyyymmddhhmmss written as a number, by the calendar of ``zone``."""
    s = F.lpad(t.cast("decimal(20,0)").cast("string"), 14, "0")
    return F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(s, "yyyyMMddHHmmss"), zone)).cast("double")
