"""Lazy ordered tables and evaluated results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, literal


@dataclass(frozen=True)
class TimeFrame:
    """A lazy table with columns ``time``, values, and the hidden ``__seq`` that orders equal times."""

    df: DataFrame
    sinks: tuple[Callable[[], None], ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != SEQ]

    @property
    def values(self) -> list[str]:
        return [c for c in self.names if c != TIME]

    @property
    def time_type(self) -> T.DataType:
        return self.df.schema[TIME].dataType

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def with_df(self, df: DataFrame) -> TimeFrame:
        return replace(self, df=df)

    def with_sinks(self, *others: TimeFrame) -> TimeFrame:
        """Also the sinks of other inputs, once each."""
        own = list(self.sinks)
        own += [s for o in others for s in o.sinks if s not in own]
        return replace(self, sinks=tuple(own))


def framed(df: DataFrame, time: Column | None = None, seq: Column | None = None) -> TimeFrame:
    """Columns in the order time, values, hidden order."""
    values = [F.col(f"`{c}`") for c in df.columns if c not in (TIME, SEQ)]
    return TimeFrame(df.select((time if time is not None else F.col(TIME)).alias(TIME), *values, (seq if seq is not None else F.col(SEQ) if SEQ in df.columns else F.lit(0).cast("bigint")).alias(SEQ)))


class LoadedFrame:
    """The result of evaluating a pipeline over a context.  It stays a lazy DataFrame."""

    def __init__(self, context: Context, frame: TimeFrame):
        self.context = context
        self._frame = frame

    @classmethod
    def from_df(cls, context: Context, df: DataFrame, validate: bool = True) -> LoadedFrame:
        """A frame of existing rows, checked by one aggregation to lie inside the closed window."""
        if TIME not in df.columns:
            raise ValueError(f"no column {TIME!r} among {df.columns}")
        if validate:
            low, high = literal(context.start, context.type), literal(context.stop, context.type)
            bad = df.agg(F.count_if(F.col(TIME).isNull()).alias("nulls"), F.count_if((F.col(TIME) < low) | (F.col(TIME) > high)).alias("out")).first()
            if bad["nulls"]:
                raise ValueError(f"{bad['nulls']} rows have no time")
            if bad["out"]:
                raise ValueError(f"{bad['out']} rows lie outside [{context.start}, {context.stop}]")
        return cls(context, framed(df))

    @property
    def columns(self) -> list[str]:
        return self._frame.names

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self._frame.df.schema.fields if f.name != SEQ])

    def to_df(self, ordered: bool = False) -> DataFrame:
        """The rows; with ``ordered`` sorted by time and stream order."""
        df = self._frame.df.orderBy(TIME, SEQ) if ordered else self._frame.df
        return df.drop(SEQ)

    toDF = to_df

    def count(self) -> int:
        return self._frame.df.count()

    __len__ = count

    def to_pandas(self):
        return self.to_df(ordered=True).toPandas()

    def to_arrow(self):
        return self.to_df(ordered=True).toArrow()

    def persist(self) -> LoadedFrame:
        self._frame.df.persist()
        return self

    def __repr__(self) -> str:
        return f"LoadedFrame({', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.schema)}) over [{self.context.start}, {self.context.stop}]"
