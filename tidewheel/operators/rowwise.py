"""Row-wise transforms: filters, projections and time shifts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, Months, negative, not_negative, shift_time
from tidewheel.frame import TimeFrame
from tidewheel.pipeline import Pipeline, Transform, mapped, operator


class Row:
    """A row as expressions: ``row.bid``, ``row["bid"]`` and ``row.time`` are columns."""

    def __init__(self, df: DataFrame):
        object.__setattr__(self, "_names", [c for c in df.columns if c != SEQ])

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(f"no column {name!r} among {self._names}")
        return F.col(f"`{name}`")

    def __getattr__(self, name: str) -> Column:
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None


@operator
def filter_rows(predicate: Callable[[Any], Any], opaque: bool = False, strict: bool = False) -> Transform:
    """Keep rows for which ``predicate(row)`` is true.

    The predicate builds a boolean column.  ``opaque`` runs it as plain Python on pandas rows, in
    Arrow batches.  A null result drops the row; with ``strict`` it is an error.
    """

    def change(frame: TimeFrame, _: Context) -> TimeFrame:
        if opaque:
            def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
                for batch in batches:
                    yield batch[[bool(predicate(row)) for row in batch.itertuples(index=False, name="Row")]] if len(batch) else batch

            # Spark passes positional names, so hidden columns stay valid attribute names.
            return frame.with_df(frame.df.mapInPandas(run, frame.df.schema))
        kept = predicate(Row(frame.df))
        if isinstance(kept, bool):
            kept = F.lit(kept)
        if not isinstance(kept, Column):
            raise TypeError(f"a predicate gives a boolean column, not {type(kept).__name__}")
        if not isinstance(frame.df.select(kept.alias("p")).schema["p"].dataType, T.BooleanType):
            raise TypeError("a predicate gives a boolean column")
        if strict:
            kept = F.when(kept.isNull(), F.raise_error(F.lit("a predicate gave null"))).otherwise(kept)
        return frame.with_df(frame.df.filter(kept))

    return mapped(change)


@operator
def add_columns(make: Callable[[Any], dict[str, Any]], schema: str | None = None) -> Transform:
    """Append the columns that ``make(row)`` names.

    With ``schema`` the function is opaque Python: it takes a pandas row and returns a dict of values.
    """

    def change(frame: TimeFrame, _: Context) -> TimeFrame:
        if schema is None:
            made = make(Row(frame.df))
            if not isinstance(made, dict):
                raise TypeError(f"new columns come as a dict, not {type(made).__name__}")
            names = list(made)
        else:
            names = T.StructType.fromDDL(schema).fieldNames()
        if TIME in names:
            raise ValueError("new columns cannot replace the time")
        clash = [c for c in names if c in frame.df.columns]
        if clash:
            raise ValueError(f"columns {clash} exist already")
        if schema is None:
            values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in made.items()}
            df = frame.df.select(*[F.col(f"`{c}`") for c in frame.names], *[v.alias(k) for k, v in values.items()], SEQ)
            return frame.with_df(df)

        def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for batch in batches:
                rows = [make(row) for row in batch.itertuples(index=False, name="Row")]
                yield batch.assign(**{c: [r[c] for r in rows] for c in names})[order]

        order = [*frame.names, SEQ, *names]
        kinds = T.StructType([*[frame.df.schema[c] for c in order[: -len(names)]], *T.StructType.fromDDL(schema).fields])
        return frame.with_df(frame.df.select(*frame.names, SEQ).mapInPandas(run, kinds).select(*frame.names, *names, SEQ))

    return mapped(change)


Selector = Any


def _flat(selectors: Iterable[Selector]) -> list[Selector]:
    out = []
    for s in selectors:
        if isinstance(s, (str, re.Pattern)) or callable(s):
            out.append(s)
        elif isinstance(s, Iterable):
            out += _flat(s)
        else:
            raise TypeError(f"columns are selected by names, patterns or predicates, not {s!r}")
    return out


def _matching(names: list[str], selectors: list[Selector]) -> set[str]:
    out = set()
    for s in selectors:
        if isinstance(s, str):
            if s not in names:
                raise ValueError(f"no column {s!r} among {names}")
            out.add(s)
        else:
            out |= {n for n in names if (s.search(n) if isinstance(s, re.Pattern) else s(n))}
    return out


@operator
def select_columns(*selectors: Selector) -> Transform:
    """Keep the time and the columns that any selector matches, in their old order."""
    chosen = _flat(selectors)
    if not chosen:
        raise ValueError("no columns are selected")

    def change(frame: TimeFrame, _: Context) -> TimeFrame:
        kept = _matching(frame.names, chosen) | {TIME}
        return frame.with_df(frame.df.select(*[F.col(f"`{c}`") for c in frame.names if c in kept], SEQ))

    return mapped(change)


@operator
def drop_columns(*selectors: Selector) -> Transform:
    """Drop the columns that any selector matches; the time always stays."""
    chosen = _flat(selectors)
    if not chosen:
        raise ValueError("no columns are selected")
    if TIME in [s for s in chosen if isinstance(s, str)]:
        raise ValueError("the time cannot be dropped")

    def change(frame: TimeFrame, _: Context) -> TimeFrame:
        gone = _matching(frame.names, chosen) - {TIME}
        return frame.with_df(frame.df.select(*[F.col(f"`{c}`") for c in frame.names if c not in gone], SEQ))

    return mapped(change)


def shifted(offset: Any, back: bool, what: str) -> Transform:
    def transform(upstream: Pipeline) -> Pipeline:
        def run(context: Context) -> TimeFrame:
            not_negative(offset, what)
            by = negative(offset) if back else offset
            frame = upstream.run(context.shifted(negative(by)))
            rest = [F.col(f"`{c}`") for c in frame.values]
            # Months may make times equal that were not; their rows keep their order.
            seq = F.struct(TIME, SEQ).alias(SEQ) if isinstance(by, Months) else F.col(SEQ)
            return frame.with_df(frame.df.select(shift_time(F.col(TIME), by, frame.time_type).alias(TIME), *rest, seq))

        return Pipeline(run)

    return transform


@operator
def lag(offset: Any) -> Transform:
    """Move rows later in time; the upstream runs over the window moved earlier."""
    return shifted(offset, False, "a lag")
