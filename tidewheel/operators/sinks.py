"""Sinks pass their rows on unchanged; evaluation writes them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tidewheel.context import SEQ, TIME, Context
from tidewheel.frame import TimeFrame
from tidewheel.pipeline import Pipeline, Transform, operator
from tidewheel.plans.durable import kept

#: Times keep their microseconds.
_CSV = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_TAKEN = ("append", "header", "writeheader", "partition", "compress", "mode")


def _checked(queue: int, options: dict[str, Any]) -> None:
    if queue < 0:
        raise ValueError("queue must not be negative")
    taken = [o for o in options if o in _TAKEN]
    if taken:
        raise ValueError(f"options {taken} are fixed")


def _ordered(frame: TimeFrame, single: bool) -> DataFrame:
    """Files in time order: sorted inside each part, or one globally sorted part."""
    df = frame.df.orderBy(TIME, SEQ).coalesce(1) if single else frame.df.sortWithinPartitions(TIME, SEQ)
    return df.drop(SEQ)


def _sink(write, single: bool) -> Transform:
    """Rows that are written and passed on are evaluated once, into the shared folder, and read from there by both; at the
    end of a ``scan`` nothing is passed on, and they are only written."""

    def transform(upstream: Pipeline) -> Pipeline:
        def passed(context: Context) -> TimeFrame:
            frame = upstream.run(context)
            df = kept(frame.df)
            return TimeFrame(df, (*frame.sinks, lambda: write(_ordered(frame.with_df(df), single))))

        def last(context: Context) -> TimeFrame:
            frame = upstream.run(context)
            return TimeFrame(frame.df, (*frame.sinks, lambda: write(_ordered(frame, single))))

        return Pipeline(passed, last=last)

    return transform


@operator
def write_csv(path: str, queue: int = 1, single: bool = False, delim: str = ",", **options: Any) -> Transform:
    """Write CSV with a header into the folder ``path``, replacing it."""
    _checked(queue, options)
    return _sink(lambda df: df.write.mode("overwrite").options(**_CSV | options, sep=delim).csv(path), single)


@operator
def write_parquet(path: str, queue: int = 1, rowgroupsize: int = 1_000_000, backend: str = "auto", single: bool = False, compression: str = "snappy", **options: Any) -> Transform:
    """Write Parquet into the folder ``path``, replacing it.  ``rowgroupsize`` bounds a file's rows."""
    _checked(queue, options)
    if backend != "auto":
        raise ValueError(f"Spark writes Parquet itself; backend must be 'auto', not {backend!r}")
    if rowgroupsize <= 0:
        raise ValueError("rowgroupsize must be positive")
    return _sink(lambda df: df.write.mode("overwrite").option("maxRecordsPerFile", 0 if single else rowgroupsize).options(compression=compression, **options).parquet(path), single)
