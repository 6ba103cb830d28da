"""Summaries of the whole window, of each timestamp, and running ones."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, as_number
from tidewheel.frame import TimeFrame
from tidewheel.functions.summarizers import CarriedFolds, FoldSummarizer, Folds, FramedFolds, Inputs, Summarizer, build_all, distinct, expanded, resolved
from tidewheel.pipeline import Transform, mapped, operator
from tidewheel.plans.folding import Folding, arrow_type, fields_of, keyed_rows, running
from tidewheel.plans.ranges import Ranges, ranged, same


def key_names(key: Any) -> list[str]:
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    if len(set(keys)) < len(keys):
        raise ValueError(f"keys repeat: {keys}")
    if TIME in keys:
        raise ValueError("the time cannot be a key")
    return keys


def check_keys(frame: TimeFrame, keys: list[str]) -> None:
    missing = [k for k in keys if k not in frame.values]
    if missing:
        raise ValueError(f"no key columns {missing} among {frame.values}")


def inputs(frame: TimeFrame, present: Column | None = None) -> Inputs:
    return Inputs({c: frame.type_of(c) for c in frame.names}, F.struct(TIME, SEQ), present)


def key_order(keys: list[str]) -> Column:
    """The hidden order of a keyed result: by key, nulls last."""
    return F.struct(*[x for k in keys for x in (F.col(f"`{k}`").isNull().alias(f"{k}_null"), F.col(f"`{k}`"))]) if keys else F.lit(0).cast("bigint")


def grouped(frame: TimeFrame, by: list[str], summarizers: list[Summarizer], present: str | None = None) -> DataFrame:
    """One row for each group, columns ``by`` and all results in the order of the request; rows that are not ``present`` only make groups."""
    inp = inputs(frame, None if present is None else F.coalesce(F.col(present), F.lit(False)))
    summarizers = resolved(summarizers, inp.types)
    plain = [s for s in summarizers if not isinstance(s, FoldSummarizer)]
    folded = [s for s in summarizers if isinstance(s, FoldSummarizer)]
    names = [n for s in summarizers for n in s.outputs]
    results = build_all(plain, inp, Folds())
    df = frame.df.groupBy(*[F.col(f"`{c}`") for c in by]) if by else frame.df
    out = df.agg(*[c.alias(n) for n, c in results.items()]) if results else None
    if folded:
        other = _folded(frame, by, folded, present)
        if out is None:
            out = other
        elif by:
            out = out.alias("g").join(other.alias("e"), same(by)).select(*[F.col(f"g.`{c}`") for c in (*by, *results)], *[F.col(f"e.`{n}`") for s in folded for n in s.outputs])
        else:
            out = out.crossJoin(F.broadcast(other))  # one row each
    return out.select(*[F.col(f"`{c}`") for c in (*by, *names)])


def parted(summarizers: list[Summarizer], types: dict[str, T.DataType]) -> tuple[list[FoldSummarizer], list[Summarizer]]:
    """The Python folds among ``summarizers`` and their dependencies, in the order of these, and the others."""
    every = resolved(expanded(list(summarizers)), types)
    return [s for s in every if isinstance(s, FoldSummarizer)], [s for s in every if not isinstance(s, FoldSummarizer)]


def _folded(frame: TimeFrame, by: list[str], summarizers: list[FoldSummarizer], present: str | None = None) -> DataFrame:
    """Python folds: ordered partial states in each partition, then merged in order for each group.

    Rows are dealt by time, so a group of any size is folded in many tasks, and only one state of
    each task and group meets its fellows.
    """
    inp = inputs(frame, None if present is None else F.coalesce(F.col(present), F.lit(False)))
    folds, plain = parted(summarizers, inp.types)
    names = [c for c in frame.names if c != present]
    folding = Folding(folds, names, {})
    kinds = [frame.df.schema[c] for c in by]
    types = [arrow_type(f.dataType) for f in kinds]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        part = None
        for batch in batches:
            part = batch.column(batch.schema.get_field_index("__part"))[0].as_py() if batch.num_rows else part
            plain_keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by]) if by else [()] * batch.num_rows
            here = batch.column(batch.schema.get_field_index(present)).to_pylist() if present else [True] * batch.num_rows
            for counts, given, (key, values) in zip(here, plain_keys, keyed_rows(batch, by, names)):
                given, own = states.get(key) or (given, folding.zero())
                states[key] = (given, folding.update(own, values) if counts else own)
        if states:
            columns = list(zip(*[given for given, _ in states.values()])) if by else []
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(columns, types)], pa.array([part] * len(states), pa.int32()), pa.array([pickle.dumps(own) for _, own in states.values()], pa.binary())], [*by, "__part", "__state"]
            )

    hidden = build_all(plain, inp, Folds())
    hidden_names, wanted = list(hidden), [n for s in summarizers for n in s.outputs]
    result = T.StructType([*kinds, *fields_of(summarizers)])

    result_names = result.fieldNames()
    result_types = [arrow_type(f.dataType) for f in result.fields[len(by) :]]

    def merged(own: pa.Table) -> pa.Table:
        states = None
        for _, blob in sorted(zip(own.column("__part").to_pylist(), own.column("__state").to_pylist()), key=lambda x: x[0] or 0):
            if blob is not None:  # else there are no rows, only what folds depend on
                one = pickle.loads(blob)
                states = one if states is None else folding.merge(states, one)
        values = folding.finish(states or folding.zero(), {n: own.column(f"__dep_{n}")[0].as_py() if len(own) else None for n in hidden_names})
        return pa.table([*[own.column(c).slice(0, 1) for c in by], *[pa.array([values[n]], t) for n, t in zip(wanted, result_types)]], result_names)

    rows = frame.df.repartitionByRange(TIME).sortWithinPartitions(TIME, SEQ)
    chosen = rows.select(*[F.col(f"`{c}`") for c in frame.names], F.spark_partition_id().alias("__part"))
    states = chosen.mapInArrow(partial, T.StructType([*kinds, T.StructField("__part", T.IntegerType()), T.StructField("__state", T.BinaryType())]))
    if hidden:
        deps = (frame.df.groupBy(*[F.col(f"`{c}`") for c in by]) if by else frame.df).agg(*[c.alias(f"__dep_{n}") for n, c in hidden.items()])
        states = states.alias("g").join(deps.alias("e"), same(by)).select(*[F.col(f"g.`{c}`") for c in states.columns], *[F.col(f"e.`__dep_{n}`") for n in hidden]) if by else states.join(F.broadcast(deps), F.lit(True), "right")
    if by:
        return states.groupBy(*[F.col(f"`{c}`") for c in by]).applyInArrow(merged, result)
    # Without keys there is one state for each task; an empty input gives the empty state.
    filler = states.sparkSession.range(1).select(F.lit(0).alias("__one"))
    return filler.groupBy("__one").cogroup(states.withColumn("__one", F.lit(0)).groupBy("__one")).applyInArrow(lambda _, own: merged(own), result)


@operator
def summarize(summarizers: Any, key: Any = None) -> Transform:
    """One row at the window's end, or one for each key: the summary of all rows."""
    keys = key_names(key)

    def change(frame: TimeFrame, context: Context) -> TimeFrame:
        check_keys(frame, keys)
        out = grouped(frame, keys, distinct(summarizers, keys))
        return frame.with_df(out.select(context.literal(context.stop).alias(TIME), *[F.col(f"`{c}`") for c in out.columns], key_order(keys).alias(SEQ)))

    return mapped(change)


@operator
def summarize_cycles(summarizers: Any, key: Any = None) -> Transform:
    """One row for each distinct time (and key): the summary of its rows."""
    keys = key_names(key)

    def change(frame: TimeFrame, _: Context) -> TimeFrame:
        check_keys(frame, keys)
        out = grouped(frame, [TIME, *keys], distinct(summarizers, keys))
        return frame.with_df(out.withColumn(SEQ, key_order(keys)))

    return mapped(change)


@operator
def add_summary_columns(summarizers: Any, key: Any = None, by_buckets: bool | int | None = None) -> Transform:
    """Append the running summary after each row, for each key.

    Keys with too many rows for a task, and rows without keys, are cut into time ranges that take over a carry (see
    ``plans.ranges``); ``by_buckets`` sets that number, or is true for a task's even share.  Python folds always run in
    ranges of keys and rows, whatever the keys are.
    """
    keys = key_names(key)

    def change(frame: TimeFrame, context: Context) -> TimeFrame:
        check_keys(frame, keys)
        own = distinct(summarizers, keys)
        clash = [n for s in own for n in s.outputs if n in frame.names]
        if clash:
            raise ValueError(f"columns {clash} exist already")
        inp = inputs(frame)
        own = resolved(own, inp.types)
        folds, below = parted([s for s in own if isinstance(s, FoldSummarizer)], inp.types)
        plain = [s for s in own if not isinstance(s, FoldSummarizer)]
        names = [F.col(f"`{c}`") for c in frame.names]
        dealt = ranged(frame.df, keys, as_number(F.col(TIME), frame.time_type), by_buckets) if plain or below else Ranges(frame.df, keys)
        window = W.partitionBy(*[F.col(f"`{k}`") for k in dealt.by]).orderBy(TIME, SEQ).rowsBetween(W.unboundedPreceding, 0)
        engine = FramedFolds(window) if dealt.cut is None else CarriedFolds(dealt, window)
        results = build_all(plain, inp, engine)
        hidden = {n: c for n, c in build_all(below, inp, engine).items()}
        df = dealt.dealt(dealt.df)
        df = df if dealt.cut is None else engine.carried(df)
        df = df.select(*names, *[c.alias(n) for n, c in results.items()], *[c.alias(f"__dep_{n}") for n, c in hidden.items()], SEQ)
        if folds:
            wanted = fields_of([s for s in own if isinstance(s, FoldSummarizer)])
            df = running(df, keys, [TIME, SEQ], frame.names, Folding(folds, frame.names, {n: f"__dep_{n}" for n in hidden}), wanted)
        return frame.with_df(df.select(*names, *[F.col(f"`{n}`") for s in own for n in s.outputs], SEQ))

    return mapped(change)
