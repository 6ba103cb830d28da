"""Summaries of the intervals between the ticks of a clock."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, as_number, as_time, offset_number, value_number
from tidewheel.frame import TimeFrame
from tidewheel.functions.summarizers import distinct
from tidewheel.operators.summarize import check_keys, grouped, key_names, key_order
from tidewheel.pipeline import Pipeline, Transform, operator
from tidewheel.plans.nearest import LEFT, LSEQ, RIGHT, nearest


@operator
def intervalize(clock: Pipeline, summarizers: Any, key: Any = None, closelast: bool = False) -> Transform:
    """Summarize the rows between consecutive ticks b <= t < b', one row stamped b'.

    Rows before the first tick are dropped.  Without keys there is a row for every interval, also
    for empty ones; with keys only for those that have rows.  ``closelast`` adds the interval from
    the last tick to the window's end.  Equal ticks are one tick.

    Between the ticks of a plain clock a row's interval is found by arithmetic, and only partial
    aggregates are shuffled; other clocks are joined to the rows in time order.
    """
    keys = key_names(key)
    own = distinct(summarizers, keys)

    def transform(upstream: Pipeline) -> Pipeline:
        def run(context: Context) -> TimeFrame:
            frame, ticking = upstream.run(context), clock.run(context)
            check_keys(frame, keys)
            whole = isinstance(context.type, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType))
            if whole and clock.step is not None and isinstance(offset_number(clock.step, context.type), int):
                rows, grid = _by_arithmetic(frame, clock.step, context, closelast)
                return finish(frame, ticking, rows, grid)
            ticks = ticking.df.select(TIME).distinct()
            # Each tick knows the next one; rows take it over from the last tick at or before them.
            alone = TimeFrame(ticks.select(TIME, F.lit(0).alias(SEQ)))
            after = nearest(alone, alone, [], forward=True, strict=True)
            known = TimeFrame(after.select(TIME, F.col(f"{RIGHT}.__time").alias("__end"), F.lit(0).alias(SEQ)))
            placed = nearest(frame, known, [], forward=False, strict=False)
            end = F.col(f"{RIGHT}.__end")
            stop = context.literal(context.stop)
            placed = placed.filter(F.col(f"{RIGHT}.__is"))
            placed = placed.withColumn("__stop", F.coalesce(end, stop) if closelast else end).filter(F.col("__stop").isNotNull())
            rows = placed.select(F.col("__stop").alias("__end"), TIME, *[F.col(f"{LEFT}.`{c}`").alias(c) for c in frame.values], F.col(LSEQ).alias(SEQ))
            grid = known.df.filter("__end is not null").select("__end")
            if closelast:
                grid = grid.union(ticks.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(stop.alias("__end")))
            return finish(frame, ticking, rows, grid)

        def finish(frame: TimeFrame, ticking: TimeFrame, rows: DataFrame, grid: DataFrame) -> TimeFrame:
            """The summaries of ``rows`` by ``__end``; without keys, ``grid`` has all ends."""
            if keys:
                out = grouped(TimeFrame(rows), ["__end", *keys], own)
                out = out.select(F.col("__end").alias(TIME), *[F.col(f"`{c}`") for c in out.columns if c != "__end"], key_order(keys).alias(SEQ))
                return frame.with_df(out).with_sinks(ticking)
            # Grid rows join the rows as absent ones, so empty intervals get the identities.
            both = rows.withColumn("__is", F.lit(True)).unionByName(grid, allowMissingColumns=True)
            out = grouped(TimeFrame(both), ["__end"], own, present="__is")
            names = [n for s in own for n in s.outputs]
            out = out.select(F.col("__end").alias(TIME), *[F.col(f"`{n}`") for n in names], F.lit(0).cast("bigint").alias(SEQ))
            return frame.with_df(out).with_sinks(ticking)

        return Pipeline(run)

    return transform


def _by_arithmetic(frame: TimeFrame, step: Any, context: Context, closelast: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with the end of their interval between the ticks of a clock, and all ends."""
    kind = context.type
    size, first, last = offset_number(step, kind), value_number(context.start), value_number(context.stop)
    ticks = max(0, -(-(last - first) // size))
    final, stop = F.lit(first + (ticks - 1) * size), context.literal(context.stop)
    number = as_number(F.col(TIME), kind).cast("bigint")
    after = number - F.pmod(number - F.lit(first), F.lit(size)) + F.lit(size)
    end = F.when(after <= final, as_time(after, kind))
    end = F.coalesce(end, stop) if closelast else end
    rows = frame.df.filter(F.lit(ticks > 0)).withColumn("__end", end).filter("__end is not null")
    ids = frame.df.sparkSession.range(1, max(1, ticks))
    grid = ids.select(as_time(F.lit(first) + F.col("id") * F.lit(size), kind).alias("__end"))
    if closelast and ticks:
        grid = grid.union(frame.df.sparkSession.range(1).select(stop.alias("__end")))
    return rows.select("__end", TIME, *[F.col(f"`{c}`") for c in frame.values], SEQ), grid
