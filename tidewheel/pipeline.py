"""Pipelines are lazy functions of a context; evaluation binds the context and lets Spark plan the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import functions as F

from tidewheel.context import SEQ, TIME, Context, as_number
from tidewheel.frame import LoadedFrame, TimeFrame
from tidewheel.plans.durable import kept

Transform = Callable[["Pipeline"], "Pipeline"]
_METHODS: dict[str, Callable[..., Transform]] = {}


class Pipeline:
    """``run(context)`` gives the lazy table; nothing executes before an action.

    ``step`` is set where the times are the context's start and every so much after it; ``last`` is run
    in place of ``run`` where no rows are wanted, only what is done with them.
    """

    def __init__(self, run: Callable[[Context], TimeFrame], step: Any = None, last: Callable[[Context], TimeFrame] | None = None):
        self.run, self.step, self.last = run, step, last or run

    def __or__(self, transform: Transform) -> Pipeline:
        return transform(self)

    def pipe(self, *transforms: Transform) -> Pipeline:
        out = self
        for one in transforms:
            out = one(out)
        return out

    def __getattr__(self, name: str):
        """Every operator is a method too: ``p.op(args)`` is ``p | op(args)``."""
        if name in _METHODS:
            return lambda *args, **named: _METHODS[name](*args, **named)(self)
        raise AttributeError(name)

    def load(self, context: Context) -> LoadedFrame:
        return load(context, self)

    def scan(self, context: Context) -> None:
        scan(context, self)

    def stream(self, context: Context, slices: int = 8) -> Iterator[LoadedFrame]:
        return stream(context, self, slices)


def operator(make: Callable[..., Transform]) -> Callable[..., Transform]:
    """Register a transform builder as a method of pipelines."""
    _METHODS[make.__name__] = make
    return make


def mapped(change: Callable[[TimeFrame, Context], TimeFrame]) -> Transform:
    """A transform whose upstream runs over the same context."""
    return lambda upstream: Pipeline(lambda context: change(upstream.run(context), context))


def load(context: Context, pipeline: Pipeline) -> LoadedFrame:
    """Evaluate over ``context``.  Registered sinks are written; the rows themselves stay lazy."""
    frame = pipeline.run(context)
    for sink in frame.sinks:
        sink()
    return LoadedFrame(context, frame)


def scan(context: Context, pipeline: Pipeline) -> None:
    """Run for side effects: all sinks, or the whole plan without keeping rows."""
    frame = pipeline.last(context)
    for sink in frame.sinks:
        sink()
    if not frame.sinks:
        frame.df.write.format("noop").mode("overwrite").save()


def stream(context: Context, pipeline: Pipeline, slices: int = 8) -> Iterator[LoadedFrame]:
    """Frames whose contexts tile the window; equal times never part.

    Borders come from a quantile sketch of the times.  The plan is evaluated once, into the shared folder, and each frame is
    a lazy filter of that, so no rows pass through the driver.  Sinks are written first.
    """
    frame = pipeline.run(context)
    for sink in frame.sinks:
        sink()
    df = kept(frame.df)
    number = as_number(F.col(TIME), frame.time_type)
    # The times themselves are recovered as the least time at or after each quantile.
    quantiles = df.agg(F.percentile_approx(number, [k / slices for k in range(1, slices)] or [0.5], 10_000).alias("q")).first()["q"] if slices > 1 else None
    borders = []
    if quantiles:
        found = df.agg(*[F.min(F.when(number >= F.lit(q), F.col(TIME))).alias(f"b{k}") for k, q in enumerate(sorted(set(quantiles)))]).first()
        borders = sorted({b for b in found if b is not None and context.start < b <= context.stop})
    edges = [context.start, *borders, context.stop]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        last = k == len(edges) - 2
        if low == high and not last:
            continue
        part = df.filter(F.col(TIME) >= context.literal(low)) if k else df
        part = part if last else part.filter(F.col(TIME) < context.literal(high))
        yield LoadedFrame(Context(low, high), frame.with_df(part))


__all__ = ["Pipeline", "SEQ", "Transform", "load", "mapped", "operator", "scan", "stream"]
