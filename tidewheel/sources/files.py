"""CSV and Parquet sources.  The window is filtered on the raw time column, so scans skip."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context
from tidewheel.frame import TimeFrame
from tidewheel.operators.rowwise import Row
from tidewheel.pipeline import Pipeline
from tidewheel.sources.memory import clipped, session

Rename = Mapping[str, str] | Callable[[str], str] | None


def _new_names(columns: Sequence[str], rename: Rename) -> dict[str, str]:
    if rename is None:
        return {c: c for c in columns}
    if not callable(rename):
        missing = [c for c in rename if c not in columns]
        if missing:
            raise ValueError(f"no columns {missing} to rename among {list(columns)}")
    out = {c: rename(c) if callable(rename) else rename.get(c, c) for c in columns}
    if len(set(out.values())) < len(out):
        raise ValueError(f"renaming makes equal names: {sorted(out.values())}")
    return out


def _types(columns: Sequence[str], types: Any) -> dict[str, Any]:
    """Column types by original name: from a map of names or positions, a list, a function or one type."""
    if types is None:
        return {}
    if isinstance(types, Mapping):
        out = {columns[k] if isinstance(k, int) else k: v for k, v in types.items()}
        missing = [c for c in out if c not in columns]
        if missing:
            raise ValueError(f"no columns {missing} among {list(columns)}")
        return out
    if isinstance(types, (list, tuple)):
        if len(types) != len(columns):
            raise ValueError(f"{len(types)} types for {len(columns)} columns")
        return dict(zip(columns, types))
    if callable(types) and not isinstance(types, type):
        return {c: t for k, c in enumerate(columns) if (t := types(k, c)) is not None}
    return {c: types for c in columns}


_PYTHON = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def _resolved(df: DataFrame, time: Any, context: Context, seq: Column) -> TimeFrame:
    if callable(time):
        made = time(Row(df))
        kind = df.select(made.alias(TIME)).schema[TIME].dataType
        df = df.withColumn(TIME, made)
        return clipped(df, F.col(TIME), context, seq, kind)
    name = time or TIME
    if name not in df.columns:
        raise ValueError(f"no time column {name!r} among {[c for c in df.columns if c != SEQ]}")
    if name != TIME and TIME in df.columns:
        raise ValueError(f"{name!r} cannot become {TIME!r}: there is one already")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        raise TypeError(f"the time column {name!r} is text; give it a type or a function")
    return clipped(df.withColumnRenamed(name, TIME), F.col(TIME), context, seq, kind)


def _checked(frame: TimeFrame, order: str) -> TimeFrame:
    """With ``order="strict"`` a source that is not sorted fails when it is read."""
    if order == "sort":
        return frame
    if order != "strict":
        raise ValueError(f"order is 'sort' or 'strict', not {order!r}")
    from pyspark.sql import Window as W

    # Each file is read in its own order; rows of one file are compared with their predecessor.
    before = F.lag(TIME).over(W.partitionBy(F.col(f"{SEQ}.file")).orderBy(SEQ))
    fine = F.when(F.col("__before") > F.col(TIME), F.raise_error(F.lit("the source is not sorted by time"))).otherwise(True)
    return frame.with_df(frame.df.withColumn("__before", before).filter(fine).drop("__before"))


def read_csv(path: str | list[str], types: Any = None, time: Any = None, rename: Rename = None, delim: str = ",", order: str = "sort", **options: Any) -> Pipeline:
    """A CSV file with a header.  Columns are strings unless ``types`` says otherwise.

    ``types`` goes by original names; then come ``rename`` and the time column: ``time`` names it,
    or is a function of the row that makes it.
    """
    if types is None and time is None:
        raise TypeError("the time column would be text; give it a type or a function")

    def run(context: Context) -> TimeFrame:
        reader = session().read.option("header", True).option("sep", delim).options(**options)
        columns = reader.csv(path).columns
        names, kinds = _new_names(columns, rename), _types(columns, types)
        raw = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
        seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        typed = [F.col(f"`{c}`").cast(_PYTHON.get(kinds[c], kinds[c]) if c in kinds else T.StringType()).alias(names[c]) for c in columns]
        return _checked(_resolved(raw.select(*typed, seq.alias(SEQ)), time, context, F.col(SEQ)), order)

    return Pipeline(run)


def read_parquet(path: str | list[str], time: Any = None, rename: Rename = None, backend: str = "auto", order: str = "sort") -> Pipeline:
    """Parquet files.  The window reaches the scan as pushed filters; unused columns are not read."""
    if backend != "auto":
        raise ValueError(f"Spark reads Parquet itself; backend must be 'auto', not {backend!r}")

    def run(context: Context) -> TimeFrame:
        raw = session().read.parquet(*([path] if isinstance(path, str) else path))
        names = _new_names(raw.columns, rename)
        seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        df = raw.select(*[F.col(f"`{c}`").alias(names[c]) for c in raw.columns], seq.alias(SEQ))
        return _checked(_resolved(df, time, context, F.col(SEQ)), order)

    return Pipeline(run)
