"""Time windows and arithmetic on time values."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "time"
#: The hidden column that orders rows of equal time.
SEQ = "__seq"
_DAY = 86_400_000_000
_MICROSECOND = dt.timedelta(microseconds=1)


@dataclass(frozen=True, order=True)
class Months:
    """An offset of calendar months, whose length depends on the time it is added to; a day that a month lacks becomes its last."""

    count: int

    def __neg__(self) -> Months:
        return Months(-self.count)


def months(count: int) -> Months:
    return Months(count)


def years(count: int) -> Months:
    return Months(12 * count)


@dataclass(frozen=True)
class Context:
    """The window [start, stop] that a pipeline is evaluated over; sources fill [start, stop)."""

    start: Any
    stop: Any

    def __post_init__(self):
        start, stop = self.start, self.stop
        if isinstance(start, bool) or isinstance(stop, bool):
            raise TypeError("a window is bounded by times or numbers")
        if isinstance(start, float) != isinstance(stop, float) and isinstance(start, (int, float)) and isinstance(stop, (int, float)):
            object.__setattr__(self, "start", float(start))
            object.__setattr__(self, "stop", float(stop))
        if _is_date(start) != _is_date(stop) and isinstance(start, dt.date) and isinstance(stop, dt.date):
            object.__setattr__(self, "start", _midnight(start))
            object.__setattr__(self, "stop", _midnight(stop))
        if not self.start <= self.stop:
            raise ValueError(f"a window must not end before it starts: [{start}, {stop}]")

    @property
    def type(self) -> T.DataType:
        if isinstance(self.start, dt.datetime):
            return T.TimestampNTZType() if self.start.tzinfo is None else T.TimestampType()
        if isinstance(self.start, dt.date):
            return T.DateType()
        return T.DoubleType() if isinstance(self.start, float) else T.LongType()

    def shifted(self, offset: Any) -> Context:
        return Context(add(self.start, offset), add(self.stop, offset))

    def from_earlier(self, lookback: Any) -> Context:
        return Context(add(self.start, negative(lookback)), self.stop)

    def to_later(self, tolerance: Any) -> Context:
        return Context(self.start, add(self.stop, tolerance))

    def literal(self, value: Any) -> Column:
        return literal(value, self.type)


def _is_date(x: Any) -> bool:
    return isinstance(x, dt.date) and not isinstance(x, dt.datetime)


def _midnight(x: Any) -> dt.datetime:
    return dt.datetime(x.year, x.month, x.day) if _is_date(x) else x


def literal(value: Any, kind: T.DataType) -> Column:
    """A constant of the time type, so that comparisons with it reach the scan."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def add(value: Any, offset: Any) -> Any:
    if isinstance(offset, Months):
        if not isinstance(value, dt.date):
            raise TypeError(f"months need dates or timestamps, not {value!r}")
        year, month = divmod(value.year * 12 + value.month - 1 + offset.count, 12)
        return value.replace(year=year, month=month + 1, day=min(value.day, calendar.monthrange(year, month + 1)[1]))
    if _is_date(value) and isinstance(offset, int):
        return value + dt.timedelta(days=offset)
    return value + offset


def negative(offset: Any) -> Any:
    return -offset


def not_negative(offset: Any, what: str) -> None:
    if offset < type(offset)(0):
        raise ValueError(f"{what} must not be negative: {offset}")


def plus(column: Column, offset: Any) -> Column:
    """``column + offset`` on the executors; offsets are numbers, timedeltas or months."""
    if isinstance(offset, Months):
        return column + F.make_ym_interval(F.lit(0), F.lit(offset.count))
    if isinstance(offset, dt.timedelta):
        return column + F.make_dt_interval(F.lit(offset.days), F.lit(0), F.lit(0), F.lit(offset.seconds + offset.microseconds / 1e6).cast("decimal(18,6)"))
    return column + F.lit(offset)


def shift_time(column: Column, offset: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType) and isinstance(offset, Months):
        return F.add_months(column, offset.count)
    if isinstance(kind, T.DateType):
        return F.date_add(column, offset.days if isinstance(offset, dt.timedelta) else offset)
    return plus(column, offset).cast(kind)


def as_number(column: Column, kind: T.DataType) -> Column:
    """Times as numbers for range frames and buckets: microseconds, days, or the value itself."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    return column


def as_time(number: Column, kind: T.DataType) -> Column:
    """The time of a number of ``as_number``."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(number.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(number)
    if isinstance(kind, T.TimestampNTZType):
        day = F.pmod(number, F.lit(_DAY))  # microseconds of the day; whole days fit an integer in all years
        return F.lit("1970-01-01 00:00:00").cast(kind) + F.make_dt_interval(((number - day) / _DAY).cast("int"), F.lit(0), F.lit(0), (day / F.lit(1_000_000)).cast("decimal(18,6)"))
    return number.cast(kind)


def offset_number(offset: Any, kind: T.DataType) -> Any:
    """An offset in the unit of ``as_number``."""
    if isinstance(offset, dt.timedelta):
        if isinstance(kind, T.DateType):
            return offset.days
        return offset // _MICROSECOND
    return offset


def value_number(value: Any) -> Any:
    """A Python time in the unit of ``as_number``."""
    if isinstance(value, dt.datetime):
        base = dt.datetime(1970, 1, 1, tzinfo=value.tzinfo and dt.timezone.utc)
        return (value - base) // _MICROSECOND
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days
    return value
