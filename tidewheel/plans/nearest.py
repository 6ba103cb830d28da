"""The nearest row of another table in time: a tagged union and one sorted pass for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.context import SEQ, TIME, as_number
from tidewheel.frame import TimeFrame
from tidewheel.plans.ranges import BUCKET, HOT, Ranges, grid, ranged

SIDE, LEFT, RIGHT, LSEQ, RSEQ = "__side", "__left", "__right", "__lseq", "__rseq"
_CARRIED = "__carried"


def _packed(frame: TimeFrame, keys: list[str], names: list[str]) -> Column:
    return F.struct(F.lit(True).alias("__is"), F.col(TIME).alias("__time"), *[F.col(f"`{c}`") for c in names])


def tagged(left: TimeFrame, right: TimeFrame, keys: list[str], right_first: bool) -> DataFrame:
    """Rows of both sides with a side mark that orders equal times."""
    marks = (1, 0) if right_first else (0, 1)
    types = {k: left.type_of(k) for k in keys}
    names = [c for c in left.values if c not in keys]
    other = [c for c in right.values if c not in keys]
    key_columns = [F.col(f"`{k}`") for k in keys]
    l = left.df.select(F.col(TIME), *key_columns, F.lit(marks[0]).alias(SIDE), _packed(left, keys, names).alias(LEFT), F.col(SEQ).alias(LSEQ))
    r = right.df.select(F.col(TIME), *[c.cast(types[k]).alias(k) if right.type_of(k) != types[k] else c for c, k in zip(key_columns, keys)], F.lit(marks[1]).alias(SIDE), _packed(right, keys, other).alias(RIGHT), F.col(SEQ).alias(RSEQ))
    return l.unionByName(r, allowMissingColumns=True)


def nearest(left: TimeFrame, right: TimeFrame, keys: list[str], forward: bool, strict: bool, rows: int | bool | None = None) -> DataFrame:
    """Left rows (time, keys, __left, __lseq) with ``__right``: the nearest right row or null.

    Backward: the last right row at or before the time (before it, if strict), in stream order.  Forward: the
    first at or after it, which is the last one met when time runs backward; so either pass only ever keeps
    one row.  Keys with more rows than a task should sort are cut into time ranges (``plans.ranges``; both
    sides are evaluated once), and the nearest right row beyond a range comes in as its first row.
    """
    both = tagged(left, right, keys, right_first=forward == strict)
    dealt = ranged(both, keys, as_number(F.col(TIME), left.time_type), rows)
    turned = (lambda c: F.col(c).desc()) if forward else F.col
    order = [turned(c) for c in (TIME, SIDE, LSEQ, RSEQ)]
    df = dealt.df
    if dealt.cut is not None:
        order.insert(0, F.col(_CARRIED).desc())
        df = df.withColumn(_CARRIED, F.lit(False)).unionByName(_carried(dealt, keys, forward).withColumn(_CARRIED, F.lit(True)), allowMissingColumns=True)
    window = W.partitionBy(*[F.col(f"`{k}`") for k in dealt.by]).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = dealt.dealt(df).withColumn(RIGHT, F.last(RIGHT, ignorenulls=True).over(window)).filter(F.col(f"{LEFT}.__is"))
    return found.drop(HOT, BUCKET, _CARRIED)


def _carried(dealt: Ranges, keys: list[str], forward: bool) -> DataFrame:
    """A right row for each range of cut keys: the last of the ranges before it, or the first of those behind it."""
    edge, order = (F.min_by, F.col(BUCKET).desc()) if forward else (F.max_by, F.col(BUCKET))
    ends = dealt.df.filter((F.col(HOT) >= 0) & F.col(f"{RIGHT}.__is")).groupBy(HOT, BUCKET).agg(edge(RIGHT, F.struct(TIME, RSEQ)).alias("__edge"))
    beyond = W.partitionBy(HOT).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    every = grid(dealt, keys).join(ends, [HOT, BUCKET], "left")
    return every.withColumn(RIGHT, F.last("__edge", ignorenulls=True).over(beyond)).drop("__edge")
