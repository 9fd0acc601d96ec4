"""Times: non-negative whole microseconds, with text forms and arithmetic.

Every function has a column form (inside the plan) and a plain form (for
arguments on the driver). A text is ``h:mm:ss.f``, ``m:ss.f`` or ``s.f``, with
``:`` or ``-`` between parts; fractions round half to even at a microsecond.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

US, MS, S = 1, 1_000, 1_000_000
_TEXT = re.compile(r"(?:(?:(\d+)[:-])?(\d+)[:-])?(\d+)(?:\.(\d*))?")
PATTERN = r"^(?:(?:([0-9]+)[:-])?([0-9]+)[:-])?([0-9]+)(?:\.([0-9]*))?$"


def parse_time(text: str) -> int:
    m = _TEXT.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a time: {text!r}")
    hours, minutes, seconds, fraction = m.groups()
    whole = (int(hours or 0) * 60 + int(minutes or 0)) * 60 + int(seconds)
    return whole * S + int((Decimal(f"0.{fraction or 0}") * S).quantize(Decimal(1), ROUND_HALF_EVEN))


def microseconds(value: int | str | Time) -> int:
    """The microseconds of an argument given as a number, a text or a ``Time``."""
    us = value.us if isinstance(value, Time) else parse_time(value) if isinstance(value, str) else int(value)
    if us < 0:
        raise ValueError("times aren't negative")
    return us


def to_timecode(us: int, separator: str = ":") -> str:
    seconds, rest = divmod(us, S)
    return separator.join(f"{x:02d}" for x in (seconds // 3600, seconds // 60 % 60, seconds % 60)) + f".{rest:06d}"


def parse_time_column(text: Column) -> Column:
    """Microseconds of a text column; null where the text isn't a time."""
    part = lambda i: F.coalesce(F.regexp_extract(text, PATTERN, i).try_cast("long"), F.lit(0))
    fraction = F.bround(F.concat(F.lit("0."), F.regexp_extract(text, PATTERN, 4), F.lit("0")).cast("decimal(38,30)") * 1_000_000, 0).cast("long")
    return F.when(text.rlike(PATTERN), ((part(1) * 60 + part(2)) * 60 + part(3)) * S + fraction)


def timecode_column(us: Column, separator: str = ":") -> Column:
    seconds = F.floor(us / S)
    return F.format_string(f"%02d{separator}%02d{separator}%02d.%06d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, us % S)


def seconds_column(us: Column) -> Column:
    return us / F.lit(1e6)


def milliseconds_column(us: Column) -> Column:
    return us / F.lit(1e3)


@total_ordering
class Time:
    """A time or duration; results below zero are errors, and so is a time times a time."""

    __slots__ = ("us",)

    def __init__(self, us: int):
        if us < 0:
            raise ValueError("times aren't negative")
        self.us = us

    @classmethod
    def parse(cls, text: str) -> Time:
        return cls(parse_time(text))

    def _other(self, other: object) -> int:
        if not isinstance(other, Time):
            raise TypeError("expected a Time")
        return other.us

    def _number(self, other: object) -> float:
        if isinstance(other, bool) or not isinstance(other, (int, float)):
            raise TypeError("expected a number")
        return other

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Time) and self.us == other.us

    def __lt__(self, other: Time) -> bool:
        return self.us < self._other(other)

    def __hash__(self) -> int:
        return hash(self.us)

    def __repr__(self) -> str:
        return f"Time({self.to_timecode()})"

    def __add__(self, other: Time) -> Time:
        return Time(self.us + self._other(other))

    def __sub__(self, other: Time) -> Time:
        return Time(self.us - self._other(other))

    def __mul__(self, other: float) -> Time:
        return Time(round(self.us * self._number(other)))

    __rmul__ = __mul__

    def __truediv__(self, other: Time | float) -> float | Time:
        return self.us / other.us if isinstance(other, Time) else Time(round(self.us / self._number(other)))

    def __floordiv__(self, other: Time | float) -> int | Time:
        return self.us // other.us if isinstance(other, Time) else Time(int(self.us // self._number(other)))

    def __mod__(self, other: Time) -> Time:
        return Time(self.us % self._other(other))

    def __divmod__(self, other: Time) -> tuple[int, Time]:
        return self.us // self._other(other), self % other

    def to_timecode(self) -> str:
        return to_timecode(self.us)

    def to_timecode_with_dashes(self) -> str:
        return to_timecode(self.us, "-")

    def to_seconds(self) -> float:
        return self.us / 1e6

    def to_milliseconds(self) -> float:
        return self.us / 1e3

    def to_microseconds(self) -> int:
        return self.us


us, ms, s = Time(US), Time(MS), Time(S)
