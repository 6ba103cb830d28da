"""Sources without files: nothing, a clock, and existing DataFrames."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, Months, add, as_number, as_time, offset_number, value_number
from tidewheel.frame import TimeFrame, framed
from tidewheel.pipeline import Pipeline


#: Ticks of a floating-point clock in one block.
_BLOCK = 1 << 16


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def empty_frame() -> Pipeline:
    """No rows, only ``time``."""

    def run(context: Context) -> TimeFrame:
        return framed(session().createDataFrame([], T.StructType([T.StructField(TIME, context.type)])))

    return Pipeline(run)


def clock(interval: Any, batchsize: int = 1024) -> Pipeline:
    """Ticks start, start + interval, ... before stop, generated on the executors.

    ``interval`` is a number, a timedelta or months.  Months are added again and again, so a day that one
    month lacks stays lost: the calendar has few of them, and the driver counts them.  For floating-point time, ticks are repeated
    additions, because their rounding is part of the result; tasks make blocks of them, whose starts are
    found by arithmetic (see ``runs``).
    """
    if batchsize <= 0:
        raise ValueError("batchsize must be positive")

    def run(context: Context) -> TimeFrame:
        if interval <= type(interval)(0):
            raise ValueError(f"the interval must be positive: {interval}")
        spark, kind = session(), context.type
        if isinstance(interval, Months):
            ticks, at = [], context.start
            while at < context.stop:
                ticks.append((at, len(ticks)))
                at = add(at, interval)
            return TimeFrame(spark.createDataFrame(ticks, T.StructType([T.StructField(TIME, kind), T.StructField(SEQ, T.LongType())])))
        if isinstance(kind, T.DoubleType):
            return _float_ticks(spark, float(context.start), float(context.stop), float(interval))
        step = offset_number(interval, kind)
        first, last = value_number(context.start), value_number(context.stop)
        ids = spark.range(max(0, -(-(last - first) // step)))
        time = as_time(F.lit(first) + F.col("id") * F.lit(step), kind)
        return TimeFrame(ids.select(time.alias(TIME), F.col("id").alias(SEQ)))

    return Pipeline(run, step=None if isinstance(interval, Months) else interval)


def runs(start: float, stop: float, step: float) -> Iterator[tuple[float, int, float]]:
    """(first, count, spacing) of evenly spaced stretches of start, start + step, (start + step) + step, ... below stop.

    While sums stay between two powers of two they are rounded to the same grid, so each addition comes to the same: a
    stretch ends with such a range, and there are as many as the exponents passed.
    """
    at = start
    while at < stop:
        then = at + step
        if then == at:
            raise ValueError(f"the interval {step} is lost in rounding at {at}")
        first = then + step
        spacing = (first + step) - first
        edge = min(stop, math.ldexp(1.0, math.frexp(then)[1]) if then > 0 else -math.ldexp(0.5, math.frexp(then)[1]))
        yield at, 1, step
        if not first + spacing < edge:
            at = then
            continue
        # The first sum from within the range settles how halves are rounded (to an even neighbour, and even they stay);
        # it and those after it, up to the edge, are exact multiples of the grid.
        yield then, 1, step
        count = 1 + int((edge - first) // spacing)
        while not first + (count - 1) * spacing < edge:
            count -= 1
        yield first, count, spacing
        at = (first + (count - 1) * spacing) + step


def _float_ticks(spark: SparkSession, start: float, stop: float, step: float) -> TimeFrame:
    """start, start + step, (start + step) + step, ... below stop."""
    starts, index = [], 0
    for first, count, spacing in runs(start, stop, step):
        starts += [(first + k * spacing, index + k, min(_BLOCK, count - k), spacing) for k in range(0, count, _BLOCK)]
        index += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, index, count, spacing in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(count) * spacing), pa.array(np.arange(index, index + count))], [TIME, SEQ])

    blocks = spark.createDataFrame(starts, "first double, index bigint, count bigint, spacing double")
    return TimeFrame(blocks.mapInArrow(run, f"{TIME} double, {SEQ} bigint"))


def clipped(df: DataFrame, raw: Column, context: Context, seq: Column, kind: T.DataType) -> TimeFrame:
    """Rows inside [start, stop), filtered on the raw column so that the scan can skip."""
    if isinstance(kind, T.StringType):
        raise TypeError("the time column is text; give it a type or a function")
    inside = df.filter((raw >= _bound(context.start, kind)) & (raw < _bound(context.stop, kind)))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (TIME, SEQ)]
    return TimeFrame(inside.select(raw.cast(context.type).alias(TIME), *rest, seq.alias(SEQ)))


def _bound(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, dt.date):
        return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()).cast(kind if not isinstance(kind, T.DateType) or not isinstance(value, dt.datetime) else T.TimestampNTZType())
    return F.lit(value)


def from_dataframe(rows: DataFrame | Callable[[Context], DataFrame], time: str = TIME, order: str | Column | None = None) -> Pipeline:
    """Rows of a DataFrame (or of a function of the context), clipped to the window.

    ``order`` ranks rows of equal time; without it their order is undefined.
    """

    def run(context: Context) -> TimeFrame:
        df = rows(context) if callable(rows) else rows
        if time not in df.columns:
            raise ValueError(f"no column {time!r} among {df.columns}")
        seq = F.lit(0).cast("bigint") if order is None else F.col(order) if isinstance(order, str) else order
        kind = df.schema[time].dataType
        if time != TIME:
            if TIME in df.columns:
                raise ValueError(f"{time!r} cannot become {TIME!r}: there is one already")
            df = df.withColumnRenamed(time, TIME)
        return clipped(df, F.col(TIME), context, seq if order != time else F.col(TIME), kind)

    return Pipeline(run)


__all__ = ["as_number", "clipped", "clock", "empty_frame", "from_dataframe", "session"]
