"""Summarizers: aggregate functions that work whole-window, per group, running and rolling.

A summarizer builds its result from a few primitive folds.  How a fold is evaluated - in a
grouping, over a window frame, or in time buckets with a carry - is the caller's choice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from tidewheel.plans.ranges import BUCKET, HOT, Ranges

#: More factors than a product that fits a long can have, ones left out.
FACTORS = 63
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_NAN = float("nan")


@dataclass
class Inputs:
    """The rows to fold: their columns and types, which rows count, and their order."""

    types: dict[str, T.DataType]
    order: Column
    present: Column | None = None

    def column(self, name: str) -> Column:
        if name not in self.types:
            raise ValueError(f"no column {name!r} among {list(self.types)}")
        return F.col(f"`{name}`")

    def type(self, name: str) -> T.DataType:
        self.column(name)
        return self.types[name]

    def only(self, value: Column) -> Column:
        return value if self.present is None else F.when(self.present, value)


class Folds:
    """Primitive folds as plain aggregates, for groupings."""

    def _apply(self, kind: str, value: Column) -> Column:
        return _aggregate(kind, value)

    def rows(self, inp: Inputs) -> Column:
        return self._apply("count", F.lit(1) if inp.present is None else F.when(inp.present, 1))

    def nulls(self, inp: Inputs, *values: Column) -> Column:
        missing = values[0].isNull()
        for v in values[1:]:
            missing = missing | v.isNull()
        return self._apply("count", F.when(missing if inp.present is None else inp.present & missing, 1))

    def sum(self, value: Column) -> Column:
        return self._apply("sum", value)

    def min(self, value: Column) -> Column:
        return self._apply("min", value)

    def max(self, value: Column) -> Column:
        return self._apply("max", value)

    def product(self, value: Column) -> Column:
        return self._apply("product", value)

    def largest(self, value: Column) -> Column:
        """The ``FACTORS`` largest values, as an array."""
        return self._apply("largest", value)

    def first(self, inp: Inputs, value: Column) -> Column:
        return self._apply("first", inp.only(F.struct(inp.order.alias("o"), value.alias("v"))))["v"]

    def last(self, inp: Inputs, value: Column) -> Column:
        return self._apply("last", inp.only(F.struct(inp.order.alias("o"), value.alias("v"))))["v"]


def _aggregate(kind: str, value: Column) -> Column:
    if kind == "first":
        return F.min_by(value, value["o"])
    if kind == "last":
        return F.max_by(value, value["o"])
    if kind == "largest":
        return InternalFunction.collect_top_k(value, FACTORS, False)
    return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "product": F.product}[kind](value)


def merged(kind: str, a: Column, b: Column) -> Column:
    """The fold of rows from their folds ``a`` of the earlier and ``b`` of the later ones; null where there are none."""
    if kind == "first":
        return F.coalesce(a, b)
    if kind == "last":
        return F.coalesce(b, a)
    if kind in ("min", "max"):
        return F.least(a, b) if kind == "min" else F.greatest(a, b)
    if kind == "largest":
        none = F.array().cast("array<bigint>")
        return F.slice(F.sort_array(F.concat(F.coalesce(a, none), F.coalesce(b, none)), asc=False), 1, FACTORS)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b if kind == "product" else a + b)


@dataclass
class FramedFolds(Folds):
    """Primitive folds over a window frame."""

    window: Any

    def _apply(self, kind: str, value: Column) -> Column:
        return _aggregate(kind, value).over(self.window)


@dataclass
class CarriedFolds(Folds):
    """Folds that run over each key in the order of ``window``, within ranges that take over a carry from those before.

    Expressions refer to carry columns, which ``carried`` joins to the rows.  ``backward`` passes run from the last range.
    """

    ranges: Ranges
    window: Any
    backward: bool = False
    found: list[tuple[str, Column]] = field(default_factory=list)

    def _carry(self, k: int) -> str:
        return f"__{'behind' if self.backward else 'carry'}{k}"

    def _apply(self, kind: str, value: Column) -> Column:
        carry = F.col(self._carry(len(self.found)))
        self.found.append((kind, value))
        local = _aggregate(kind, value).over(self.window)
        return merged(kind, local, carry) if self.backward else merged(kind, carry, local)

    def carried(self, df):
        """``df`` with the folds of all ranges that the pass meets earlier: a row for each range of a cut key, at most."""
        if not self.found:
            return df
        parts = self.ranges.df.filter(F.col(HOT) >= 0).groupBy(HOT, BUCKET).agg(*[_aggregate(kind, value).alias(f"__part{k}") for k, (kind, value) in enumerate(self.found)])
        before = W.partitionBy(HOT).orderBy(F.col(BUCKET).desc() if self.backward else F.col(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
        again = lambda k, kind: self._again(kind, F.col(f"__part{k}"), before).alias(self._carry(k))
        return df.join(parts.select(HOT, BUCKET, *[again(k, kind) for k, (kind, _) in enumerate(self.found)]), [HOT, BUCKET], "left")

    @staticmethod
    def _again(kind: str, part: Column, window: Any) -> Column:
        """The fold of folds."""
        if kind == "largest":  # at most FACTORS values of each range
            return F.slice(F.sort_array(F.flatten(F.collect_list(part).over(window)), asc=False), 1, FACTORS)
        return _aggregate("sum" if kind == "count" else kind, part).over(window)


@dataclass
class TwoSidedFolds(Folds):
    """Folds of a frame that ends one block of time and begins the next: what it holds of the earlier, then of the later."""

    earlier: Folds
    later: Folds
    is_earlier: Column
    is_later: Column

    def _apply(self, kind: str, value: Column) -> Column:
        return merged(kind, self.earlier._apply(kind, F.when(self.is_earlier, value)), self.later._apply(kind, F.when(self.is_later, value)))


class Summarizer:
    """``outputs`` names the results; ``build`` makes them from folds."""

    outputs: tuple[str, ...]

    def build(self, inp: Inputs, folds: Folds) -> dict[str, Column]:
        raise NotImplementedError


def _nulled(nulls: Column, value: Column) -> Column:
    return F.when(nulls > 0, F.lit(None)).otherwise(value)


def sum_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, _INTEGERS):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return kind
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    raise TypeError(f"values of type {kind.simpleString()} cannot be summed")


def _number(inp: Inputs, name: str) -> Column:
    kind = inp.type(name)
    if isinstance(kind, T.BooleanType):
        return inp.column(name).cast("int").cast("bigint")
    return inp.column(name).cast(sum_type(kind))


def _divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(_NAN)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def _powered(value: Column, kind: T.DataType, n: Any) -> Column:
    if isinstance(kind, _INTEGERS) and isinstance(n, int) and n >= 0:
        out = F.lit(1).cast("bigint") if n == 0 else value
        for _ in range(n - 1):
            out = out * value
        return F.when(value.isNotNull(), out)
    return F.pow(value.cast("double"), F.lit(float(n)))


@dataclass(frozen=True)
class Count(Summarizer):
    """Rows, nulls included."""

    outputs = ("count",)

    def build(self, inp, folds):
        return {"count": F.coalesce(folds.rows(inp), F.lit(0)).cast("bigint")}


class _Named(Summarizer):
    suffix = ""

    @property
    def outputs(self) -> tuple[str, ...]:
        return (f"{self.x}_{self.suffix}",)


def _summed(inp: Inputs, folds: Folds, value: Column, kind: T.DataType, *of: Column) -> Column:
    total = folds.sum(inp.only(value))
    return _nulled(folds.nulls(inp, *of), F.coalesce(total, F.lit(0).cast(kind))).cast(kind)


@dataclass(frozen=True)
class Sum(_Named):
    """Sum; ``compensated`` keeps what cancellation loses (see ``CompensatedSum``)."""

    x: str
    compensated: bool = False
    suffix = "sum"

    def build(self, inp, folds):
        kind, value = sum_type(inp.type(self.x)), _number(inp, self.x)
        return {self.outputs[0]: _summed(inp, folds, value, kind, value)}


@dataclass(frozen=True)
class SumPower(Summarizer):
    x: str
    n: Any

    @property
    def outputs(self):
        return (f"{self.x}_sumpower_{self.n}",)

    def build(self, inp, folds):
        kind, value = sum_type(inp.type(self.x)), _number(inp, self.x)
        out = kind if not isinstance(kind, T.LongType) or isinstance(self.n, int) and self.n >= 0 else T.DoubleType()
        return {self.outputs[0]: _summed(inp, folds, _powered(value, inp.type(self.x), self.n), out, value)}


@dataclass(frozen=True)
class Product(_Named):
    """Product.  Integers multiply exactly, from their largest factors: more than 62 beyond 1 overflow a long, which is
    an error, so a group of any size keeps ``FACTORS`` of them, a count of zeros and one of signs."""

    x: str
    suffix = "product"

    def build(self, inp, folds):
        kind, value = sum_type(inp.type(self.x)), _number(inp, self.x)
        if isinstance(kind, T.LongType):
            size = F.abs(value)
            factors = folds.largest(inp.only(F.when(size > 1, size)))
            whole = F.aggregate(factors, F.lit(1).cast("bigint"), lambda a, v: a * v)
            zeros, minus = folds.sum(inp.only((value == 0).cast("bigint"))), folds.sum(inp.only((value < 0).cast("bigint")))
            total = F.when(F.coalesce(zeros, F.lit(0)) > 0, F.lit(0).cast("bigint")).otherwise(whole * F.when(F.coalesce(minus, F.lit(0)) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)))
        else:
            total = F.coalesce(folds.product(inp.only(value.cast("double"))), F.lit(1.0))
        return {self.outputs[0]: _nulled(folds.nulls(inp, value), total).cast(kind)}


@dataclass(frozen=True)
class DotProduct(Summarizer):
    x: str
    y: str

    @property
    def outputs(self):
        return (f"{self.x}_{self.y}_dotproduct",)

    def build(self, inp, folds):
        a, b = _number(inp, self.x), _number(inp, self.y)
        kinds = (sum_type(inp.type(self.x)), sum_type(inp.type(self.y)))
        kind = kinds[0] if kinds[0] == kinds[1] else T.DoubleType() if T.DoubleType() in kinds else T.FloatType() if T.FloatType() in kinds else kinds[0]
        return {self.outputs[0]: _summed(inp, folds, a * b, kind, a, b)}


def _mean_type(kind: T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.FloatType) else T.DoubleType()


def _total(inp: Inputs, folds: Folds, value: Column) -> Column:
    """Sum as a double; null on no rows or a null among them."""
    return _nulled(folds.nulls(inp, value), folds.sum(inp.only(value)).cast("double"))


@dataclass(frozen=True)
class Moment(Summarizer):
    x: str
    n: Any

    @property
    def outputs(self):
        return (f"{self.x}_moment_{self.n}",)

    def build(self, inp, folds):
        kind, value = inp.type(self.x), _number(inp, self.x)
        total = _nulled(folds.nulls(inp, value), folds.sum(inp.only(_powered(value, kind, self.n))).cast("double"))
        rows = folds.rows(inp)
        return {self.outputs[0]: F.when(rows > 0, total / rows).cast(_mean_type(kind))}


@dataclass(frozen=True)
class Mean(_Named):
    x: str
    suffix = "mean"

    def build(self, inp, folds):
        rows = folds.rows(inp)
        return {self.outputs[0]: F.when(rows > 0, _total(inp, folds, _number(inp, self.x)) / rows).cast(_mean_type(inp.type(self.x)))}


def _comoment(inp: Inputs, folds: Folds, a: Column, b: Column, corrected: bool) -> Column:
    """(sum of products - product of sums / n) / (n - corrected); NaN where that divides by zero."""
    a, b, rows = a.cast("double"), b.cast("double"), folds.rows(inp)
    left = folds.sum(inp.only(a * b)) - folds.sum(inp.only(a)) * folds.sum(inp.only(b)) / F.when(rows > 0, rows)
    return F.when(rows > 0, _nulled(folds.nulls(inp, a, b), _divided(left, rows - F.lit(int(corrected)))))


def _rooted(v: Column) -> Column:
    return F.sqrt(F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(0.0))) if True else v)


@dataclass(frozen=True)
class Variance(_Named):
    x: str
    corrected: bool = True
    suffix = "variance"

    def build(self, inp, folds):
        value = _number(inp, self.x)
        return {self.outputs[0]: _comoment(inp, folds, value, value, self.corrected).cast(_mean_type(inp.type(self.x)))}


def _deviation(inp: Inputs, folds: Folds, name: str, corrected: bool) -> Column:
    value = _number(inp, name)
    v = _comoment(inp, folds, value, value, corrected)
    return F.when(v.isNotNull(), _rooted(v))


@dataclass(frozen=True)
class Std(_Named):
    x: str
    corrected: bool = True
    suffix = "std"

    def build(self, inp, folds):
        return {self.outputs[0]: _deviation(inp, folds, self.x, self.corrected).cast(_mean_type(inp.type(self.x)))}


@dataclass(frozen=True)
class Covariance(Summarizer):
    x: str
    y: str
    corrected: bool = True

    @property
    def outputs(self):
        return (f"{self.x}_{self.y}_covariance",)

    def build(self, inp, folds):
        return {self.outputs[0]: _comoment(inp, folds, _number(inp, self.x), _number(inp, self.y), self.corrected)}


@dataclass(frozen=True)
class Correlation(Summarizer):
    x: str
    y: str

    @property
    def outputs(self):
        return (f"{self.x}_{self.y}_correlation",)

    def build(self, inp, folds):
        both = _comoment(inp, folds, _number(inp, self.x), _number(inp, self.y), True)
        r = _divided(both, _deviation(inp, folds, self.x, True) * _deviation(inp, folds, self.y, True))
        return {self.outputs[0]: F.when(both.isNotNull(), F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(r, F.lit(1.0)))))}


class _Extreme(_Named):
    def build(self, inp, folds):
        kind, value = inp.type(self.x), inp.column(self.x)
        out = (folds.min if self.suffix == "min" else folds.max)(inp.only(value))
        if isinstance(kind, (T.FloatType, T.DoubleType)) and self.suffix == "min":  # NaN ranks last, but it wins here
            nans = folds.sum(inp.only(F.isnan(value).cast("bigint")))
            out = F.when(nans > 0, F.lit(_NAN).cast(kind)).otherwise(out)
        return {self.outputs[0]: _nulled(folds.nulls(inp, value), out).cast(kind)}


@dataclass(frozen=True)
class Min(_Extreme):
    x: str
    suffix = "min"


@dataclass(frozen=True)
class Max(_Extreme):
    x: str
    suffix = "max"


@dataclass(frozen=True)
class First(_Named):
    x: str
    suffix = "first"

    def build(self, inp, folds):
        return {self.outputs[0]: folds.first(inp, inp.column(self.x))}


@dataclass(frozen=True)
class Last(_Named):
    x: str
    suffix = "last"

    def build(self, inp, folds):
        return {self.outputs[0]: folds.last(inp, inp.column(self.x))}


class FoldSummarizer(Summarizer):
    """A custom summarizer in Python: an ordered monoid over rows.

    ``fields`` are the results with their Spark types.  ``zero()`` makes a state, ``update(state,
    row)`` takes a row (a named tuple) and returns the state, ``merge(a, b)`` joins the states of
    consecutive rows, and ``finish(state, values)`` gives a dict of results; ``values`` holds the
    results of ``dependencies()``, which are folded first and stay hidden unless requested.
    """

    fields: dict[str, str]

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(self.fields)

    def zero(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, row: Any) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any, values: dict[str, Any]) -> dict[str, Any]:
        raise NotImplementedError

    def dependencies(self) -> Iterable[Summarizer]:
        return ()


class CompensatedSum(FoldSummarizer):
    """A sum that keeps the low-order parts of its additions: a state is the running sum, what its roundings lost, and counts
    of nulls, NaNs and infinities.  States of consecutive rows are merged by an addition that loses nothing either."""

    def __init__(self, x: str, kind: T.DataType):
        self.x, self.kind = x, sum_type(kind)
        self.fields = {f"{x}_sum": self.kind.simpleString()}

    def zero(self):
        return (0.0, 0.0, 0, 0, 0, 0)

    def update(self, state, row):
        v = getattr(row, self.x)
        total, lost, nulls, nans, up, down = state
        if v is None:
            return (total, lost, nulls + 1, nans, up, down)
        v = float(v)
        if math.isfinite(v):
            return (*_added(total, lost, v), nulls, nans, up, down)
        return (total, lost, nulls, nans + (v != v), up + (v == math.inf), down + (v == -math.inf))

    def merge(self, a, b):
        total, lost = _added(a[0], a[1] + b[1], b[0])
        return (total, lost, *[x + y for x, y in zip(a[2:], b[2:])])

    def finish(self, state, values):
        total, lost, nulls, nans, up, down = state
        out = None if nulls else math.nan if nans or up and down else math.inf if up else -math.inf if down else total + lost
        return {f"{self.x}_sum": out}


def _added(total: float, lost: float, v: float) -> tuple[float, float]:
    out = total + v
    if math.isinf(out):
        return out, lost
    return out, lost + ((total - out) + v if abs(total) >= abs(v) else (v - out) + total)


def resolved(summarizers: list[Summarizer], types: dict[str, T.DataType]) -> list[Summarizer]:
    """With compensated sums of floats as the folds they are; sums of integers and decimals are exact as they are."""
    floats = lambda s: isinstance(s, Sum) and s.compensated and isinstance(types.get(s.x), (T.FloatType, T.DoubleType))
    return [CompensatedSum(s.x, types[s.x]) if floats(s) else s for s in summarizers]


def distinct(summarizers: Summarizer | Iterable[Summarizer], keys: list[str], time: str = "time") -> list[Summarizer]:
    """The requested summarizers, once each by their outputs, with their names checked."""
    given = [summarizers] if isinstance(summarizers, Summarizer) else list(summarizers)
    if not given:
        raise ValueError("at least one summarizer is needed")
    out: dict[tuple[str, ...], Summarizer] = {}
    for one in given:
        out.setdefault(one.outputs, one)
    expanded(list(out.values()))
    names: set[str] = set()
    for one in out.values():
        for name in one.outputs:
            if name == time or name in keys:
                raise ValueError(f"a result cannot be named {name!r}")
            if name in names:
                raise ValueError(f"two summarizers give {name!r}")
            names.add(name)
    return list(out.values())


def expanded(summarizers: list[Summarizer]) -> list[Summarizer]:
    """Summarizers after their dependencies, once each by outputs; cycles are errors."""
    out: dict[tuple[str, ...], Summarizer] = {}

    def visit(one: Summarizer, above: tuple) -> None:
        if one.outputs in above:
            raise ValueError(f"summarizers depend on themselves: {one.outputs}")
        for other in one.dependencies() if isinstance(one, FoldSummarizer) else ():
            visit(other, (*above, one.outputs))
        out.setdefault(one.outputs, one)

    for one in summarizers:
        visit(one, ())
    return list(out.values())


def build_all(summarizers: list[Summarizer], inp: Inputs, folds: Folds) -> dict[str, Column]:
    return {name: column for one in summarizers for name, column in one.build(inp, folds).items()}


def is_nan(x: Any) -> bool:
    return isinstance(x, float) and math.isnan(x)


Maker = Callable[..., Summarizer]
