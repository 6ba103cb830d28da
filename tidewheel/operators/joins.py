"""As-of joins: each left row with the nearest right row in time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tidewheel.context import SEQ, TIME, Context, Months, as_number, not_negative, offset_number, shift_time
from tidewheel.frame import TimeFrame
from tidewheel.operators.summarize import key_names
from tidewheel.pipeline import Pipeline, Transform, operator
from tidewheel.plans.nearest import LEFT, LSEQ, RIGHT, nearest


def nearest_join(right: Pipeline, forward: bool, key: Any, tolerance: Any, strict: bool, leftprefix: str | None, rightprefix: str | None, righttime: str | None, by_buckets: bool | int | None) -> Transform:
    keys = key_names(key)
    if righttime is not None and (righttime == TIME or righttime in keys):
        raise ValueError(f"the right time cannot be named {righttime!r}")

    def transform(left: Pipeline) -> Pipeline:
        def run(context: Context) -> TimeFrame:
            other = context
            if tolerance is not None:
                not_negative(tolerance, "a tolerance")
                other = context.to_later(tolerance) if forward else context.from_earlier(tolerance)
            l, r = left.run(context), right.run(other)
            for side, frame in (("left", l), ("right", r)):
                missing = [k for k in keys if k not in frame.values]
                if missing:
                    raise ValueError(f"the {side} side has no columns {missing}")
            prefixed = lambda p, c: f"{p}_{c}" if p else c
            names = {c: c if c in keys else prefixed(leftprefix, c) for c in l.values}
            added = {c: prefixed(rightprefix, c) for c in r.values if c not in keys}
            out = [TIME, *names.values(), *([righttime] if righttime else []), *added.values()]
            if len(set(out)) < len(out):
                raise ValueError(f"equal names on both sides: {sorted({c for c in out if out.count(c) > 1})}")
            joined = nearest(l, r, keys, forward, strict, by_buckets)
            near = F.lit(True)
            if tolerance is not None:
                here, there = as_number(F.col(TIME), l.time_type), as_number(F.col(f"{RIGHT}.__time"), r.time_type)
                if isinstance(tolerance, Months):
                    bound = as_number(shift_time(F.col(TIME), tolerance if forward else -tolerance, l.time_type), l.time_type)
                    near = there <= bound if forward else there >= bound
                else:
                    near = (there - here if forward else here - there) <= offset_number(tolerance, l.time_type)
            take = lambda c: F.when(near, F.col(f"{RIGHT}.`{c}`"))
            columns = [F.col(TIME)]
            columns += [(F.col(f"`{c}`") if c in keys else F.col(f"{LEFT}.`{c}`")).alias(n) for c, n in names.items()]
            columns += [take("__time").alias(righttime)] if righttime else []
            columns += [take(c).alias(n) for c, n in added.items()]
            return TimeFrame(joined.select(*columns, F.col(LSEQ).alias(SEQ))).with_sinks(l, r)

        return Pipeline(run)

    return transform


@operator
def asof_join(right: Pipeline, key: Any = None, tolerance: Any = None, strict: bool = False, leftprefix: str | None = None, rightprefix: str | None = None, righttime: str | None = None, by_buckets: bool | int | None = None) -> Transform:
    """Append the most recent right row at or before each left row (before it, with ``strict``).

    The last right row wins among equal times.  ``tolerance`` bounds, inclusively, how old the
    most recent row may be, and lets the right side reach back before the window.  Left rows
    without a match stay, with nulls.  Keys with too many rows for a task are cut into time ranges
    (see ``plans.ranges``); ``by_buckets`` sets that number, or is true for a task's even share.
    """
    return nearest_join(right, False, key, tolerance, strict, leftprefix, rightprefix, righttime, by_buckets)
