"""Operators over Structured Streaming sources.

Row-wise pipelines run unchanged (``live``).  Summaries close when the watermark passes them; late
rows are dropped by the watermark.  Running Python folds keep their state for each key.
"""

from __future__ import annotations

import datetime as dt
import itertools
import pickle
from collections import namedtuple
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.context import SEQ, TIME, Context
from tidewheel.frame import TimeFrame, framed
from tidewheel.functions.summarizers import FoldSummarizer, Folds, Inputs, build_all, distinct
from tidewheel.operators.summarize import key_names
from tidewheel.pipeline import Pipeline
from tidewheel.plans.folding import Folding, Queue, fields_of


def live(stream: DataFrame, pipeline, context: Context, time: str = TIME, delay: str = "0 seconds") -> DataFrame:
    """A streaming DataFrame through row-wise transforms: ``pipeline`` is a function of a Pipeline."""

    def run(ctx: Context) -> TimeFrame:
        df = stream.withColumnRenamed(time, TIME).withWatermark(TIME, delay)
        return framed(df.filter((F.col(TIME) >= ctx.literal(ctx.start)) & (F.col(TIME) < ctx.literal(ctx.stop))))

    return pipeline(Pipeline(run)).run(context).df.drop(SEQ)


def _inputs(stream: DataFrame) -> Inputs:
    return Inputs({f.name: f.dataType for f in stream.schema.fields}, F.struct(TIME))


def live_cycles(stream: DataFrame, summarizers: Any, key: Any = None, delay: str = "0 seconds") -> DataFrame:
    """One row for each time (and key), once the watermark has passed it."""
    keys = key_names(key)
    results = build_all(distinct(summarizers, keys), _inputs(stream), Folds())
    return stream.withWatermark(TIME, delay).groupBy(TIME, *keys).agg(*[c.alias(n) for n, c in results.items()])


def live_intervals(stream: DataFrame, every: str, summarizers: Any, key: Any = None, start: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """One row for each closed interval of a fixed clock (and key) that has rows, stamped at its end.

    The last, open interval is withheld until rows beyond it arrive.
    """
    keys = key_names(key)
    results = build_all(distinct(summarizers, keys), _inputs(stream), Folds())
    window = F.window(TIME, every, every, start) if start else F.window(TIME, every)
    out = stream.withWatermark(TIME, delay).groupBy(window.alias("__w"), *keys).agg(*[c.alias(n) for n, c in results.items()])
    return out.select(F.col("__w.end").alias(TIME), *keys, *results)


def _in_order(stream: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], Any], step: Callable[[Any, tuple], tuple | None], shape: T.StructType, delay: str | None) -> DataFrame:
    """Rows of each key in the order of time, then of ``order``, through ``step(memory, row)``, which gives a row of ``shape`` or None.

    Rows wait in the key's state until the watermark has passed them, since no earlier one can come after that; a timer wakes keys that get
    no more rows.  State is a key's memory and the rows that wait.
    """
    names = [c for c in stream.columns]
    at, ranks = names.index(TIME), [names.index(c) for c in order]
    columns = shape.fieldNames()

    def run(key_values: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        waiting, memory = pickle.loads(state.get[0]) if state.exists else ([], fresh())
        for batch in batches:
            waiting += batch[names].itertuples(index=False, name=None)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        waiting.sort(key=lambda r: (r[at], *[r[k] for k in ranks]))
        out, held = [], []
        for row in waiting:
            if pd.Timestamp(row[at]) > mark:
                held.append(row)
                continue
            made = step(memory, row)
            if made is not None:
                out.append(made)
        state.update((pickle.dumps((held, memory)),))
        if held:
            state.setTimeoutTimestamp(int(min(pd.Timestamp(r[at]) for r in held).timestamp() * 1000) + 1)
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(columns)}, columns=columns)

    marked = stream if delay is None else stream.withWatermark(TIME, delay)
    blob = T.StructType([T.StructField("blob", T.BinaryType())])
    return marked.groupBy(*keys).applyInPandasWithState(run, shape, blob, "append", GroupStateTimeout.EventTimeTimeout)


def _keyed(key: Any, what: str) -> list[str]:
    keys = key_names(key)
    if not keys:
        raise ValueError(f"{what} of a stream needs keys")
    return keys


def live_running(stream: DataFrame, summarizers: list[FoldSummarizer], key: Any, delay: str = "0 seconds") -> DataFrame:
    """Append running Python folds for each key."""
    keys = _keyed(key, "a running fold")
    own = distinct(summarizers, keys)
    names = [c for c in stream.columns]
    make = namedtuple("Row", names, rename=True)
    added = fields_of(own)

    def step(states: list, row: tuple) -> tuple:
        values: dict[str, Any] = {}
        for k, s in enumerate(own):
            states[k] = s.update(states[k], make(*row))
            values |= s.finish(states[k], values)
        return (*row, *[values[f.name] for f in added])

    return _in_order(stream, keys, [], lambda: [s.zero() for s in own], step, T.StructType([*stream.schema.fields, *added]), delay)


def live_asof(left: DataFrame, right: DataFrame, key: Any, tolerance: dt.timedelta | None = None, strict: bool = False, rightprefix: str | None = None, righttime: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Append to each row of the stream ``left`` the most recent row of the stream ``right`` with its key, as ``asof_join`` does.

    Both streams are one stream of rows that pass in time order, right ones first among equal times (last, if ``strict``); a key's
    memory is one right row.  Of right rows with equal keys and times, the one with the largest values is the last.
    """
    keys = _keyed(key, "an as-of join")
    added = {c: f"{rightprefix}_{c}" if rightprefix else c for c in right.columns if c not in (TIME, *keys)}
    clash = [n for n in (*added.values(), *([righttime] if righttime else [])) if n in left.columns]
    if clash:
        raise ValueError(f"columns {clash} exist already")
    own = [c for c in left.columns if c not in (TIME, *keys)]
    l = left.withWatermark(TIME, delay).select(TIME, *keys, F.lit(int(not strict)).alias("__side"), F.struct(*own).alias("__left") if own else F.lit(None).alias("__left"), F.lit("").alias("__rank"))
    r = right.withWatermark(TIME, delay).select(TIME, *keys, F.lit(int(strict)).alias("__side"), F.struct(*added).alias("__right") if added else F.lit(None).alias("__right"), F.to_json(F.struct(*added)).alias("__rank") if added else F.lit("").alias("__rank"))
    both = l.unionByName(r, allowMissingColumns=True).select(TIME, *keys, "__side", "__rank", "__left", "__right")
    mine, n = int(not strict), len(keys)
    shape = T.StructType([left.schema[TIME], *[left.schema[k] for k in keys], *[left.schema[c] for c in own], *([T.StructField(righttime, right.schema[TIME].dataType)] if righttime else []), *[T.StructField(a, right.schema[c].dataType) for c, a in added.items()]])
    empty = (None,) * len(added)

    def step(memory: dict, row: tuple) -> tuple | None:
        time, key_values, side, l_values, r_values = row[0], row[1 : 1 + n], row[1 + n], row[3 + n], row[4 + n]
        if side != mine:
            memory["last"] = (time, tuple((r_values or {}).get(c) for c in added) if isinstance(r_values, dict) else tuple(r_values or ()))
            return None
        then, values = memory.get("last", (None, empty))
        if then is not None and tolerance is not None and time - then > tolerance:
            then, values = None, empty
        first = tuple(l_values.get(c) for c in own) if isinstance(l_values, dict) else tuple(l_values or ())
        return (time, *key_values, *first, *([then] if righttime else []), *values)

    return _in_order(both, keys, ["__side", "__rank"], dict, step, shape, None)


def live_rolling(stream: DataFrame, window: str, lookback: dt.timedelta, summarizers: list[FoldSummarizer], key: Any, delay: str = "0 seconds") -> DataFrame:
    """Append ``{window}_{name}``: Python folds of the key's rows at most ``lookback`` before each row.

    A key's memory is the queue of the states in the window.  Rows of equal time see each other, as in ``add_rolling_columns``, so
    a row is given out with the next later one, or when its timer ends.
    """
    keys = _keyed(key, "a rolling fold")
    own = distinct(summarizers, keys)
    folding = Folding(own, [c for c in stream.columns], {})
    added = [T.StructField(f"{window}_{f.name}", f.dataType) for f in fields_of(own)]
    names = [f.name for f in fields_of(own)]
    at = stream.columns.index(TIME)
    shape = T.StructType([*stream.schema.fields, *added])

    def run(key_values: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        waiting, inside = pickle.loads(state.get[0]) if state.exists else ([], [])
        for batch in batches:
            waiting += batch.itertuples(index=False, name=None)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        waiting.sort(key=lambda r: r[at])
        passed = [r for r in waiting if pd.Timestamp(r[at]) <= mark]
        held = waiting[len(passed) :]
        queue = Queue(folding.zero, folding.merge)
        for time, one in inside:
            queue.push(time, one)
        out = []
        for time, tied in itertools.groupby(passed, key=lambda r: r[at]):
            tied = list(tied)
            queue.evict(time - lookback)
            for row in tied:
                one = folding.one(row)
                inside.append((time, one))
                queue.push(time, pickle.loads(pickle.dumps(one)))
            made = folding.finish(queue.fold(), {})
            out += [(*row, *[made[n] for n in names]) for row in tied]
        inside = [x for x in inside if not out or x[0] >= passed[-1][at] - lookback]
        state.update((pickle.dumps((held, inside)),))
        if held:
            state.setTimeoutTimestamp(int(min(pd.Timestamp(r[at]) for r in held).timestamp() * 1000) + 1)
        columns = shape.fieldNames()
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(columns)}, columns=columns)

    blob = T.StructType([T.StructField("blob", T.BinaryType())])
    return stream.withWatermark(TIME, delay).groupBy(*keys).applyInPandasWithState(run, shape, blob, "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["live", "live_asof", "live_cycles", "live_intervals", "live_rolling", "live_running"]
