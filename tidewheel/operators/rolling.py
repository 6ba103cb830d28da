"""Trailing-window summaries."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.context import SEQ, TIME, Context, Months, as_number, not_negative, offset_number, shift_time
from tidewheel.frame import TimeFrame
from tidewheel.functions.summarizers import CarriedFolds, FoldSummarizer, FramedFolds, Inputs, Summarizer, TwoSidedFolds, build_all, distinct, resolved
from tidewheel.operators.summarize import check_keys, key_names, parted
from tidewheel.pipeline import Pipeline, Transform, operator
from tidewheel.plans.folding import Folding, fields_of, trailing
from tidewheel.plans.ranges import Ranges, ranged

FROM, NUMBER, OWN = "__from", "__number", "__own"
#: Where a row meets the others: the block, its places for the forward and the backward pass, and whether it lies in the block or in the one before.
BLOCK, AT, BACK, ROLE = "__block", "__place", "__back", "__role"
EARLIER, LATER = 0, 1
HERE, ORDER, SIDE = "__here", "__order", "__side"


def _named(windows: Any) -> dict[str, Any]:
    pairs = list(windows.items()) if isinstance(windows, Mapping) else [windows] if isinstance(windows, tuple) and len(windows) == 2 and isinstance(windows[0], str) else list(windows)
    out = dict(pairs)
    if not out:
        raise ValueError("at least one window is needed")
    if len(out) < len(pairs):
        raise ValueError(f"window names repeat: {[n for n, _ in pairs]}")
    return out


def _scale(kind: T.DataType, lookbacks: list[Any]) -> tuple[int, list[int]]:
    """A factor that makes all look-backs whole.  For floats it is a power of two, so times scale exactly."""
    if not isinstance(kind, T.DoubleType):
        return 1, [int(x) for x in lookbacks]
    ratios = [float(x).as_integer_ratio() for x in lookbacks]
    factor = max((d for _, d in ratios), default=1)
    return factor, [n * (factor // d) for n, d in ratios]


@operator
def add_rolling_columns(windows: Any, summarizers: Any, key: Any = None, from_: Pipeline | None = None, by_buckets: bool | int | None = None) -> Transform:
    """Append ``{window}_{name}``: the summary of the rows with t - lookback <= s <= t, for each row's t.

    All rows at t count, also later ones in the stream.  The summarized rows come from the pipeline itself or from
    ``from_``, over a window that starts a look-back earlier.

    Time is cut into blocks of one look-back, so the frame of a row is the end of the block before its own and the
    start of its own.  Starts are folds that run forward over a block's rows, and ends folds that run backward, both
    met at the row's time; no frame is folded anew and nothing is subtracted, so the work grows with the rows whatever the
    look-back, and any fold will do.  Each window costs one shuffle by key and block.  Blocks with too many rows
    for a task are cut into ranges that take over a carry (see ``plans.ranges`` and ``by_buckets`` of the joins).  Python folds hold the rows of a frame in a queue of
    states instead.  Blocks of a look-back in months are so many months; they are not cut.
    """
    named, keys = _named(windows), key_names(key)
    own = distinct(summarizers, keys)
    outputs = [f"{w}_{n}" for w in named for s in own for n in s.outputs]
    if len(set(outputs)) < len(outputs) or TIME in outputs or any(n in keys for n in outputs):
        raise ValueError(f"result names clash: {outputs}")

    def transform(upstream: Pipeline) -> Pipeline:
        def run(context: Context) -> TimeFrame:
            for lookback in named.values():
                not_negative(lookback, "a look-back")
            wide = context
            for lookback in named.values():
                earlier = context.from_earlier(lookback)
                wide = earlier if earlier.start < wide.start else wide
            left, source = upstream.run(context), (from_ or upstream).run(wide)
            check_keys(left, keys), check_keys(source, keys)
            clash = [n for n in outputs if n in left.names]
            if clash:
                raise ValueError(f"columns {clash} exist already")
            kind = left.time_type
            factor, whole = _scale(kind, [offset_number(x, kind) for x in named.values() if not isinstance(x, Months)])
            whole = iter(whole)
            spans = [x if isinstance(x, Months) and x.count else 0 if isinstance(x, Months) else next(whole) for x in named.values()]
            number = as_number(F.col(TIME), kind) * F.lit(factor) if factor != 1 else as_number(F.col(TIME), kind)
            key_columns = [F.col(f"`{k}`") for k in keys]
            values = [c for c in source.values if c not in keys]
            rolled = source.df.select(F.col(TIME), *key_columns, number.alias(NUMBER), F.struct(F.lit(True).alias("__is"), *[F.col(f"`{c}`") for c in values], F.col(SEQ).alias(SEQ)).alias(FROM))
            mine = left.df.select(F.col(TIME), *key_columns, number.alias(NUMBER), F.struct(F.lit(True).alias("__is"), *[F.col(f"`{c}`") for c in left.values if c not in keys], F.col(SEQ).alias(SEQ)).alias(OWN))
            for name, span in zip(named, spans):
                mine = _rolled(rolled, mine, source, keys, name, span, own, by_buckets)
            kept = [F.col(f"`{c}`") if c in keys else F.col(f"{OWN}.`{c}`").alias(c) for c in left.values]
            result = mine.select(TIME, *kept, *[F.col(f"`{n}`") for n in outputs], F.col(f"{OWN}.{SEQ}").alias(SEQ))
            return left.with_df(result).with_sinks(source)

        return Pipeline(run)

    return transform


def _block(number: Column, span: int, floating: bool) -> Column:
    """Which look-back a time lies in; exact, also where a division rounds."""
    if not floating:
        return F.call_function("div", number - F.pmod(number, F.lit(span)), F.lit(span)).cast("bigint")
    guess = F.floor(number / F.lit(float(span)))
    over, under = number < guess * F.lit(float(span)), number >= (guess + 1) * F.lit(float(span))
    return guess - over.cast("bigint") + under.cast("bigint")


def _rolled(rolled: DataFrame, mine: DataFrame, source: TimeFrame, keys: list[str], name: str, span: int | Months, own: list[Summarizer], rows: int | bool | None) -> DataFrame:
    """``mine`` with the results of one window over the rows ``rolled``."""
    floating = isinstance(rolled.schema[NUMBER].dataType, T.DoubleType)
    monthly = isinstance(span, Months)
    if monthly:  # a look-back from a month leads into the month so many before it
        place = F.call_function("div", F.year(TIME) * 12 + F.month(TIME) - 1, F.lit(span.count)).cast("bigint")
        kind = mine.schema[TIME].dataType
        asked = {AT: F.col(NUMBER), BACK: as_number(shift_time(F.col(TIME), -span, kind), kind)}
        shift = F.col(NUMBER)
    else:
        place = _block(F.col(NUMBER), span, floating) if span else F.col(NUMBER)
        asked = {AT: F.col(NUMBER), BACK: F.col(NUMBER)}
        shift = F.col(NUMBER) + span
    roles = [F.struct(F.lit(LATER).alias(ROLE), place.alias(BLOCK), F.col(NUMBER).alias(AT), F.col(NUMBER).alias(BACK))]
    if span:  # without a look-back, a row sees its own time only
        roles.append(F.struct(F.lit(EARLIER).alias(ROLE), (place + 1).alias(BLOCK), shift.alias(AT), shift.alias(BACK)))
    seen = rolled.select("*", F.inline(F.array(*roles)))
    both = seen.unionByName(mine.withColumns({BLOCK: place, **asked}), allowMissingColumns=True)
    types = {c: source.type_of(c) for c in source.names}
    inp = _Inside(types, F.struct(F.col(TIME), F.col(f"{FROM}.{SEQ}")), F.coalesce(F.col(f"{FROM}.__is"), F.lit(False)), set(keys))
    resolved_own = resolved(own, types)
    folds, below = parted([s for s in resolved_own if isinstance(s, FoldSummarizer)], types)
    plain = [s for s in resolved_own if not isinstance(s, FoldSummarizer)]
    before = [c for c in mine.columns]
    hidden: dict[str, str] = {}
    if plain or below:
        by = [*keys, BLOCK]
        dealt = Ranges(both, by) if monthly else ranged(both, by, F.col(AT), rows)  # both places would have to agree on ranges
        group = W.partitionBy(*[F.col(f"`{c}`") for c in dealt.by])
        forward, backward = (group.orderBy(c).rangeBetween(W.unboundedPreceding, 0) for c in (F.col(AT), F.col(BACK).desc()))
        start, end = (FramedFolds(forward), FramedFolds(backward)) if dealt.cut is None else (CarriedFolds(dealt, forward), CarriedFolds(dealt, backward, backward=True))
        engine = TwoSidedFolds(end, start, F.col(ROLE) == EARLIER, F.col(ROLE) == LATER)
        made = {f"{name}_{n}": c for n, c in build_all(plain, inp, engine).items()}
        made |= {f"__dep_{n}": c for n, c in build_all(below, inp, engine).items()}
        hidden = {n: f"__dep_{n}" for s in below for n in s.outputs}
        df = dealt.dealt(dealt.df)
        df = df if dealt.cut is None else end.carried(start.carried(df))
        df = df.select(*[F.col(f"`{c}`") for c in before], *[c.alias(n) for n, c in made.items()])
        mine = df.filter(F.col(f"{OWN}.__is"))
    if folds and monthly:
        raise ValueError("Python summarizers do not roll over months")
    if folds:
        mine = _queued(seen, mine, place, keys, name, span, types, folds, hidden, fields_of([s for s in resolved_own if isinstance(s, FoldSummarizer)]))
    return mine.drop(*hidden.values())


def _queued(seen: DataFrame, mine: DataFrame, place: Column, keys: list[str], name: str, span: int, types: dict[str, T.DataType], folds: list[FoldSummarizer], hidden: dict[str, str], wanted: list[T.StructField]) -> DataFrame:
    """``mine`` with the results of Python folds: a block's rows and those of the block before go through one task in order."""
    plain = {TIME, *keys}
    columns = {c: c if c in plain else f"__v{k}" for k, c in enumerate(types)}
    unpacked = seen.select(TIME, *[F.col(f"`{k}`") for k in keys], BLOCK, NUMBER, F.lit(True).alias(HERE), F.col(f"{FROM}.{SEQ}").alias(ORDER), *[F.col(f"{FROM}.`{c}`").alias(columns[c]) for c in types if c not in plain])
    asking = mine.withColumns({BLOCK: place, HERE: F.lit(False), ORDER: F.col(f"{OWN}.{SEQ}")})
    both = unpacked.unionByName(asking, allowMissingColumns=True).withColumn(SIDE, F.when(F.col(HERE), 0).otherwise(1))
    folding = Folding(folds, list(types), hidden)
    named = [T.StructField(f"{name}_{f.name}", f.dataType) for f in wanted]
    return trailing(both, [*keys, BLOCK], [NUMBER, SIDE, ORDER], NUMBER, HERE, columns, span, mine.columns, folding, wanted).withColumnsRenamed({f.name: n.name for f, n in zip(wanted, named)})


class _Inside(Inputs):
    """Summarized rows inside the union: their columns are packed, only the keys and the time are not."""

    def __init__(self, types: dict[str, T.DataType], order: Column, present: Column, plain: set[str]):
        super().__init__(types, order, present)
        self.plain = plain | {TIME}

    def column(self, name: str) -> Column:
        super().column(name)
        return F.col(f"`{name}`") if name in self.plain else F.col(f"{FROM}.`{name}`")
