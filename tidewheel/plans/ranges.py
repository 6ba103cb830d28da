"""Time ranges of equal size for ordered passes, cut where the rows are.

An ordered pass over the rows of a key is one task.  Keys with more rows than a bound are cut into ranges at the
quantiles of their own times, from a mergeable sketch, so that a burst gets as many ranges as its rows
need; a pass then runs within ranges, and each range takes over a carry from those before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.plans.durable import estimated_bytes, kept

#: The range of a row, and the number of its key among those that are cut (negative for others).
BUCKET, HOT = "__bucket", "__hot"
_ALL, _AT, _BORDERS, _COUNT, _PARTS = "__all", "__at", "__borders", "__n", "__parts"
#: Rows of a range, ranges of a key at most (then they hold more), and bytes of input, as files hold it, under which a pass is no burden
#: to one task: a row of a few bytes there takes some 600 in a sort and a window.
ROWS, MOST, SMALL_BYTES = 150_000, 1 << 15, 4 << 20
#: Rows of a task of a pass, on the average: tasks grow in number with the rows, whatever the session's shuffle partitions are.
TASK_ROWS = 150_000
#: Borders are looked up in two steps: among every so many, then among those between.
_STEP = 64
#: Tables of ranges with so many borders at most are broadcast (8 bytes each, and a key).
_SENT = 1 << 18


@dataclass(frozen=True)
class Ranges:
    """Rows and what an ordered pass is partitioned by; ``cut`` has the keys that are cut, their number and ranges, if any are;
    ``tasks``, in how many a pass should run, where rows were counted."""

    df: DataFrame
    by: list[str]
    cut: DataFrame | None = None
    tasks: int | None = None

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df``, of the rows of ``self.df`` and others, dealt to the tasks of a pass."""
        if self.tasks is None:
            return df
        by = self.by if self.cut is None else [HOT, BUCKET]  # which carries are joined on
        return df.repartition(self.tasks, *[F.col(f"`{c}`") for c in by]) if by else df.repartition(1)


def same(names: list[str]) -> Column:
    """Equal values, or both null, of the columns of ``g`` and ``e``."""
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"g.`{n}`").eqNullSafe(F.col(f"e.`{n}`"))
    return on


def ranged(df: DataFrame, keys: list[str], number: Column, rows: int | bool | None = None) -> Ranges:
    """``df`` ready for passes in the order of ``number`` over each key; equal numbers of a key share a range.

    Without ``rows``, inputs that the optimizer takes for small are left as they are, unevaluated.  All others are
    evaluated once and counted, and keys of more than ``rows`` rows (``ROWS`` by default; a task's even share, if true) are cut.
    """
    if not rows and estimated_bytes(df) <= SMALL_BYTES:
        return Ranges(df, list(keys))
    own = list(keys) or [_ALL]
    df = kept(df if keys else df.withColumn(_ALL, F.lit(0)))
    if rows is True:
        rows = max(1, -(-df.count() // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows or ROWS
    columns = [F.col(f"`{k}`") for k in own]
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(_COUNT))
    counts = counts.withColumn(_PARTS, F.when(F.col(_COUNT) > rows, F.least(F.ceil(F.col(_COUNT) / rows), F.lit(MOST)).cast("int")))
    total = counts.agg(F.max(_PARTS).alias("most"), F.sum(_PARTS).alias("all"), F.sum(_COUNT).alias("n")).first()
    tasks = max(1, -(-(total["n"] or 0) // TASK_ROWS))
    if total["most"] is None:
        return Ranges(df if keys else df.drop(_ALL), list(keys), None, tasks)
    counts = counts.filter(F.col(_PARTS).isNotNull())
    if total["all"] > _SENT:  # the joins below sort the rows
        df = df.repartition(tasks, *columns)
    most, sent = total["most"], (lambda t: F.broadcast(t) if total["all"] <= _SENT else t)
    marked = df.withColumn(_AT, number).alias("g").join(sent(counts).alias("e"), same(own)).select(*[F.col(f"g.`{k}`") for k in own], f"g.{_AT}", f"e.{_PARTS}")
    sketch = marked.groupBy(*columns).agg(F.percentile_approx(_AT, [k / most for k in range(1, most)], max(10_000, 20 * most)).alias("q"), F.first(_PARTS).alias(_PARTS))
    # A key takes as many of the quantiles as it needs ranges; repeated ones are one border.
    borders = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col(_PARTS) - 1), lambda j: F.get("q", F.floor(j * most / F.col(_PARTS)).cast("int") - 1)))
    cut = kept(sketch.select(*columns, F.array_sort(borders).alias(_BORDERS), F.monotonically_increasing_id().alias(HOT)))
    joined = df.withColumn(_AT, number).alias("g").join(sent(cut).alias("e"), same(own), "left")
    joined = joined.select(*[F.col(f"g.`{c}`") for c in df.columns], f"g.{_AT}", f"e.{_BORDERS}", f"e.{HOT}")
    other = -F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) - 1
    dealt = joined.withColumns({BUCKET: F.coalesce(_place(F.col(_BORDERS), F.col(_AT)), F.lit(0)), HOT: F.coalesce(F.col(HOT), other)}).drop(_AT, _BORDERS, *([] if keys else [_ALL]))
    return Ranges(dealt, [HOT, BUCKET, *keys], cut.withColumn(_PARTS, F.size(_BORDERS) + 1), tasks)


def _place(borders: Column, at: Column) -> Column:
    """How many of the sorted borders are at or before ``at``."""
    tops = F.transform(F.sequence(F.lit(0), F.greatest((F.size(borders) - 1), F.lit(0)), F.lit(_STEP)), lambda i: F.get(borders, i))
    chunk = F.size(F.filter(tops, lambda t: t <= at))
    inside = F.size(F.filter(F.slice(borders, F.greatest(chunk - 1, F.lit(0)) * _STEP + 1, _STEP), lambda b: b <= at))
    return F.when(borders.isNull(), F.lit(0)).when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * _STEP + inside).cast("int")


def grid(ranges: Ranges, keys: list[str]) -> DataFrame:
    """keys, number and range of every range of every cut key."""
    return ranges.cut.select(*[F.col(f"`{k}`") for k in keys], HOT, F.explode(F.sequence(F.lit(0), F.col(_PARTS) - 1)).alias(BUCKET))
